"""Versioned Parquet: immutable versions, a pointer that is flipped last, and removal of old versions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintain import newest_versions


def content_version(df: DataFrame) -> str:
    """Twelve hexadecimal digits that depend on the rows only, whatever their order: an exact sum of row digests, so nothing is gathered."""
    digest = F.md5(F.to_json(F.struct(*sorted(df.columns))))
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return hashlib.sha1("|".join(str(x) for x in row).encode()).hexdigest()[:12]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def publish(tables: dict[str, DataFrame], root: str, version: str, created_at: str) -> None:
    """Write every table under root/table/version=..., then the version's marker, and flip the pointer last; a failure before that leaves the active version as it was. Publishing a version again replaces it."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/version={version}")
    spark.createDataFrame([(version, created_at)], "version string, created_at string").coalesce(1).write.mode("overwrite").json(f"{root}/versions/{version}")
    fs, new, jvm = _fs(spark, f"{root}/active.new")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{root}/active"), replace)


def active_version(spark: SparkSession, root: str) -> str | None:
    fs, p, _ = _fs(spark, f"{root}/active")
    if not fs.exists(p):
        return None
    row = spark.read.text(f"{root}/active").first()
    return json.loads(row[0])["version"]


def read_active(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table of the active version; other versions' folders are not listed."""
    return spark.read.parquet(f"{root}/{name}/version={active_version(spark, root)}")


def collect_garbage(spark: SparkSession, root: str, names: list[str], keep: int = 2) -> list[str]:
    """Remove all versions but the `keep` newest and the active one, in every table; returns them."""
    versions = spark.read.json(f"{root}/versions/*")
    gone = [r["version"] for r in newest_versions(versions, keep, active_version(spark, root) or "").collect()]
    for version in gone:
        for path in (*(f"{root}/{n}/version={version}" for n in names), f"{root}/versions/{version}"):
            fs, p, _ = _fs(spark, path)
            fs.delete(p, True)
    return gone


def person_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document per person's graph: faculty_id, n_nodes, payload. What is gathered is bounded by one person's papers."""
    n = nodes.groupBy("faculty_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("id"), "kind"))).alias("nodes"))
    e = edges.groupBy("faculty_id").agg(F.array_sort(F.collect_list(F.struct("source", "target", "label"))).alias("links"))
    return n.join(e, "faculty_id", "left").select("faculty_id", F.size("nodes").alias("n_nodes"), F.to_json(F.struct("nodes", "links")).alias("payload"))


def write_documents(documents: DataFrame, key: str, root: str) -> None:
    """One folder per document below root, and an index of all keys beside them."""
    documents.select(key, "payload").write.mode("overwrite").partitionBy(key).text(f"{root}/documents")
    documents.drop("payload").write.mode("overwrite").json(f"{root}/index")


def write_json(rows: DataFrame, path: str) -> None:
    """A table as JSON lines, replacing what was there: explorer terms, reports, statistics."""
    rows.write.mode("overwrite").json(path)
