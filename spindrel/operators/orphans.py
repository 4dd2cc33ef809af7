"""References to records that are missing, deleted or created later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import salted_lookup

#: An id is 24 hexadecimal digits, whatever is written around it.
ID_PATTERN = r"(?<![0-9a-f])([0-9a-f]{24})(?![0-9a-f])"
#: Notations written around an id or code.
WRAPPER = r"(?i)objectid|\$oid|[^A-Za-z0-9]"


def reference_id(value: Column) -> Column:
    """The id inside a stored reference, in lower case, or '' if it holds none."""
    return F.regexp_extract(F.lower(value), ID_PATTERN, 1)


def reference_key(value: Column) -> Column:
    """The id inside, or else what is left without notation, in upper case (a code)."""
    found = reference_id(value)
    return F.when(found != "", found).otherwise(F.upper(F.regexp_replace(value, WRAPPER, "")))


def present(value: Column) -> Column:
    """Not null and not blank."""
    return F.trim(F.regexp_replace(value, r"\s+", " ")) != ""


def references(papers: DataFrame) -> DataFrame:
    """One row per stored reference: ref_field, paper_id, ref_value, at. Null and blank values are no references."""
    people = F.transform(
        F.coalesce(F.col("iitd_authors"), F.array()),
        lambda x: F.array(
            F.struct(F.lit("faculty_ref").alias("ref_field"), x["faculty_ref"].alias("ref_value")),
            F.struct(F.lit("department_ref").alias("ref_field"), x["department_ref"].alias("ref_value")),
        ),
    )
    labels = F.array(
        F.struct(F.lit("domain_id").alias("ref_field"), F.col("classification.domain_id").alias("ref_value")),
        F.struct(F.lit("thematic_area_id").alias("ref_field"), F.col("classification.thematic_area_id").alias("ref_value")),
    )
    return (
        papers.select("paper_id", F.col("createdAt").alias("at"), F.explode(F.concat(F.flatten(people), labels)).alias("r"))
        .select("r.ref_field", "paper_id", "r.ref_value", "at")
        .filter(present(F.col("ref_value")))
        .withColumn("key", reference_key(F.col("ref_value")))
    )


def lifetimes(**parents: tuple[DataFrame, list[str]]) -> DataFrame:
    """Distinct (ref_field, key, born, gone) of the parent tables; a parent may be known by several columns."""
    out = None
    for field, (df, columns) in parents.items():
        for c in columns:
            own = df.select(F.lit(field).alias("ref_field"), reference_key(F.col(c)).alias("key"), F.col("created_at").alias("born"), F.col("deleted_at").alias("gone"))
            out = own if out is None else out.unionByName(own)
    return out.filter(F.col("key") != "").distinct()


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References for which no parent record lives at their time.

    refs: ref_field, paper_id, ref_value, key, at. parents: ref_field, key, born, gone.
    Result: distinct ref_field, paper_id, ref_value, at.

    Distinct keys with the span of their times (map-side combined, so a key that
    holds a third of all rows costs one row per task) meet the parents once; a key
    whose single parent record lives through the whole span is settled there. Only
    keys without parent, or with one born or gone within the span, are joined back.
    A row without time, and a parent record without birth, count as not living.
    Repeated rows count once; parents repeated with other times are all tried.
    """
    keys = refs.groupBy("ref_field", "key").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count_if(F.col("at").isNull()).alias("timeless"), F.count(F.lit(1)).alias("_n"))
    lives = parents.groupBy("ref_field", "key").agg(F.collect_set(F.struct("born", F.coalesce("gone", F.lit("9999-12-31").cast("timestamp_ntz")).alias("gone"))).alias("lives"))
    covers = lambda a, b: F.exists("lives", lambda x: (x["born"] <= a) & (x["gone"] > b))
    doubtful = (
        keys.join(lives, ["ref_field", "key"], "left")
        .filter(F.col("lives").isNull() | (F.col("timeless") > 0) | ~F.coalesce(covers(F.col("first"), F.col("last")), F.lit(False)))
        .select("ref_field", "key", "lives", "_n")
    )
    # a written table of the doubtful keys: they and their numbers are used twice
    doubtful = cut(doubtful)
    return (
        salted_lookup(refs, doubtful.drop("_n"), ["ref_field", "key"], "paper_id", counts=doubtful.select("ref_field", "key", "_n"))
        .filter(F.col("lives").isNull() | ~F.coalesce(covers(F.col("at"), F.col("at")), F.lit(False)))
        .select("ref_field", "paper_id", "ref_value", "at")
        .distinct()
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references per referenced table and month: ref_field, month (text, null without time), n_references, n_papers."""
    return orphans.groupBy("ref_field", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_references"),
        F.countDistinct("paper_id").alias("n_papers"),
    )
