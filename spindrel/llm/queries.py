"""Queries and SQL of the llm operators; every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import reference_id, reference_key
from ..session import tune
from ..sources.tables import table
from . import fmindex, linkage, merkle, names, packing, pii, residue, setjoin, topn

PAPERS = "researchmetadatascopus"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(tune(spark), sf_dir, name)


# 1: personal information in free text


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_items(_t(spark, sf_dir, "suggestion")).select("suggestion_id", "pii_type", "start_pos").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with typed placeholders in place of personal items."""
    return pii.redacted(_t(spark, sf_dir, "suggestion"))


# 2: free-entered values and the canonical list


def _typed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = (("build_kg", "IITD_Department"), ("department_sheet_roster", "sheetUnitName"), ("faculty_upsert", "department_code"))
    out = None
    for name, column in sources:
        own = _t(spark, sf_dir, name).select("row_key", F.col(column).alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    living = _t(spark, sf_dir, "departments").filter(F.col("deleted_at").isNull())
    return living.select(F.col("dept_id").alias("canonical_id"), "name", "code")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.map_to_canonical(_typed_units(spark, sf_dir), _units(spark, sf_dir)).select(F.col("canonical_id").alias("dept_id"), "row_key")


def p2_unmatched_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that name no unit, with the number of rows."""
    mapped = setjoin.map_to_canonical(_typed_units(spark, sf_dir), _units(spark, sf_dir))
    return mapped.filter("canonical_id = ''").groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))


# 4: variant spellings of names


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: _t(spark, sf_dir, name)
    return names.same_person(t(PAPERS), t("faculty"), t("departments"))


# 5: duplicates hidden by formatting

_WORK = merkle.Ordered([merkle.Text("title"), merkle.Exact("publication_year")])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = _t(spark, sf_dir, PAPERS).filter(F.col("title").isNotNull())
    return merkle.copies(papers, "paper_id", _WORK).select(F.col("first").alias("first_paper_id"), F.col("copy").alias("copy_paper_id"))


def p5_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per work with its number of copies, the authors compared in any order."""
    names = F.transform(F.col("authors"), lambda a: a["author_name"])
    tree = merkle.Ordered([merkle.Text("title"), merkle.Exact("publication_year"), merkle.TextBag(names)])
    return merkle.collapsed(_t(spark, sf_dir, PAPERS), "paper_id", tree).select(F.col("first").alias("first_paper_id"), "n_copies")


# 6: matching entities across sources


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: _t(spark, sf_dir, name)
    named = t(PAPERS)
    for column, source in (("domain_id", "domains"), ("thematic_area_id", "themes")):
        lookup = t(source).groupBy(F.lower("id").alias(f"_{column}")).agg(F.max("name").alias(f"{column}_name"))
        named = named.withColumn(f"_{column}", reference_id(F.col(f"classification.{column}"))).join(lookup, f"_{column}", "left")
    works = named.select(
        "paper_id", "title", F.col("publication_year").alias("year"), F.transform("authors", lambda a: a["author_name"]).alias("people"),
        F.array_compact(F.concat(F.coalesce("classification.topics", F.array()), F.array("domain_id_name", "thematic_area_id_name"))).alias("labels"),
        F.transform("authors", lambda a: a["author_id"]).alias("author_ids"), F.array_distinct(F.transform("iitd_authors", lambda a: reference_key(a["department_ref"]))).alias("units"),
    )
    sheets = t("build_kg").select(F.col("row_key").alias("record"), F.col("Title").alias("title"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("array<string>").alias("people"), F.array("Topic", "Domain", "Broad_Theme").alias("labels"), F.array("IITD_Department").alias("units"))
    profiles = t("scholar_papers").select(F.col("row_key").alias("record"), "title", "year", F.col("authors").alias("people"), F.lit(None).cast("array<string>").alias("labels"), F.lit(None).cast("array<string>").alias("units"))
    return linkage.match_works(works, sheets.unionByName(profiles)).select("paper_id", F.col("record").alias("row_key"), "confidence")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select("paper_id", "row_key")


def p6_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching rows with the confidence of each match."""
    return _linked(spark, sf_dir)


# 7: top items within every group


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = _t(spark, sf_dir, PAPERS)
    rows = topn.latest(papers, "paper_id", "ingested_at", ["kerberos", "publication_year", "citation_count"])
    rows = rows.filter((F.trim("kerberos") != "") & F.col("publication_year").isNotNull())
    return topn.top_n(rows, ["kerberos", "publication_year"], "citation_count", "paper_id", 3).select("kerberos", "publication_year", "paper_id")


_P7 = """
WITH papers AS (SELECT * FROM researchmetadatascopus QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC) = 1)
SELECT kerberos, publication_year, paper_id FROM papers WHERE trim(kerberos) <> '' AND publication_year IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY kerberos, publication_year ORDER BY citation_count DESC NULLS LAST, paper_id) <= 3
"""

# 8: containers of fixed capacity

CAPACITY = 2048


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_t(spark, sf_dir, "documents"), CAPACITY).drop("source", "cluster")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, and that none breaks a rule."""
    return packing.audit(packing.pack(_t(spark, sf_dir, "documents"), CAPACITY), CAPACITY)


# 9: evaluation passages in the corpus


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.matches(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p9_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of characters to cut out of each document."""
    documents = _t(spark, sf_dir, "documents")
    return fmindex.removal_spans(documents, fmindex.matches(documents, _t(spark, sf_dir, "eval_items")))


_P9 = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(regexp_replace(text, '([\p{L}\p{N}])-[ \t]*\r?\n[ \t]*([\p{L}\p{N}])', '\1\2', 'g')), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(regexp_replace(text, '([\p{L}\p{N}])-[ \t]*\r?\n[ \t]*([\p{L}\p{N}])', '\1\2', 'g')), '[\p{L}\p{N}]+') FROM eval_items),
g AS (SELECT side, id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT side, id, w, unnest(range(1, len(w) - 10)) AS k FROM w WHERE len(w) >= 12))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.g = i.g WHERE d.side = 'd' AND i.side = 'i'
"""


# 10: template residue


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(_t(spark, sf_dir, "documents")).select("doc_id")


def p10_clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without residue, counted per source and language."""
    documents = _t(spark, sf_dir, "documents")
    kept = residue.without_residue(documents, residue.residue(documents))
    return kept.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("n_chars")).cast("bigint").alias("n_chars"))


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p2_unmatched_values": p2_unmatched_values,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_works": p5_works,
    "p6_found": p6_found,
    "p6_confidence": p6_confidence,
    "p7_found": p7_found,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_removal_spans": p9_removal_spans,
    "p10_found": p10_found,
    "p10_clean_corpus": p10_clean_corpus,
}
SQL = {"p7_found": _P7, "p9_found": _P9}
