"""Queries and SQL of problem 3, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.orphans import lifetimes, orphan_counts, orphan_references, references
from ..session import tune
from ..sources.tables import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(tune(spark), sf_dir, name)
    parents = lifetimes(
        faculty_ref=(t("faculty"), ["faculty_id"]),
        department_ref=(t("departments"), ["dept_id", "code"]),
        domain_id=(t("domains"), ["id"]),
        thematic_area_id=(t("themes"), ["id"]),
    )
    return orphan_references(references(t("researchmetadatascopus")), parents)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_field", "paper_id", "ref_value").distinct()


def by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(_orphans(spark, sf_dir))


_SQL = r"""
WITH papers AS (SELECT DISTINCT paper_id, createdAt AS created, iitd_authors, classification FROM researchmetadatascopus),
people AS (SELECT paper_id, created, unnest(iitd_authors) AS u FROM papers),
refs AS (
  SELECT 'faculty_ref' AS ref_field, paper_id, u.faculty_ref AS ref_value, created FROM people
  UNION ALL SELECT 'department_ref', paper_id, u.department_ref, created FROM people
  UNION ALL SELECT 'domain_id', paper_id, classification.domain_id, created FROM papers
  UNION ALL SELECT 'thematic_area_id', paper_id, classification.thematic_area_id, created FROM papers),
keyed AS (
  SELECT DISTINCT *, CASE WHEN regexp_matches(lower(ref_value), '(^|[^0-9a-f])[0-9a-f]{24}($|[^0-9a-f])')
      THEN regexp_extract(lower(ref_value), '(^|[^0-9a-f])([0-9a-f]{24})($|[^0-9a-f])', 2)
      ELSE upper(regexp_replace(ref_value, 'objectid|\$oid|[^A-Za-z0-9]', '', 'gi')) END AS key
  FROM refs WHERE trim(ref_value) <> ''),
parents AS (
  SELECT 'faculty_ref' AS ref_field, lower(faculty_id) AS key, created_at, deleted_at FROM faculty
  UNION ALL SELECT 'department_ref', lower(dept_id), created_at, deleted_at FROM departments
  UNION ALL SELECT 'department_ref', upper(code), created_at, deleted_at FROM departments
  UNION ALL SELECT 'domain_id', lower(id), created_at, deleted_at FROM domains
  UNION ALL SELECT 'thematic_area_id', lower(id), created_at, deleted_at FROM themes),
orphans AS (
  SELECT DISTINCT ref_field, paper_id, ref_value, created FROM keyed k WHERE NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.ref_field = k.ref_field AND p.key = k.key AND p.created_at <= k.created AND (p.deleted_at IS NULL OR p.deleted_at > k.created)))
"""

QUERIES = {"p3_found": found, "p3_orphans_by_month": by_month}
SQL = {
    "p3_found": _SQL + "SELECT DISTINCT ref_field, paper_id, ref_value FROM orphans",
    "p3_orphans_by_month": _SQL + "SELECT ref_field, strftime(created, '%Y-%m') AS month, count(*) AS n_references, count(DISTINCT paper_id) AS n_papers FROM orphans GROUP BY ALL",
}
