"""People, units and papers in canonical form, once per row and one row per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import full_name, mailbox
from .orphans import reference_id, reference_key


def units(departments: DataFrame) -> DataFrame:
    return departments.select("dept_id", "name", "code", "category").distinct()


def unit_names(departments: DataFrame) -> DataFrame:
    """Every way a reference may name a unit: ref (id in lower case or code in upper case), dept_id."""
    u = units(departments)
    return u.select(F.lower("dept_id").alias("ref"), "dept_id").union(u.select(F.upper("code"), "dept_id")).distinct()


def people(faculty: DataFrame) -> DataFrame:
    """One row per record (rows loaded twice count once), with full name, mailbox, and the unit reference in canonical form."""
    return (
        faculty.distinct()
        .withColumn("name", full_name(F.col("firstName"), F.col("lastName")))
        .withColumn("kerberos", mailbox(F.col("email")))
        .withColumn("unit_ref", reference_key(F.col("department")))
    )


def with_unit(rows: DataFrame, departments: DataFrame, ref: str = "unit_ref", how: str = "inner") -> DataFrame:
    """Resolve references by id, id as text, or code: adds dept_id, unit_name, code, category. The list of units is left to Catalyst to broadcast by its size."""
    lookup = unit_names(departments).join(units(departments).withColumnRenamed("name", "unit_name"), "dept_id").withColumnRenamed("ref", ref)
    return rows.join(lookup, ref, how)


def memberships(persons: DataFrame, departments: DataFrame) -> DataFrame:
    """One row per person and unit, home and further ones, each once: faculty_id, dept_id, ..."""
    refs = F.array_union(F.array("department"), F.coalesce("affiliations", F.array().cast("array<string>")))
    each = persons.withColumn("unit_ref", F.explode(F.array_distinct(F.transform(refs, reference_key))))
    return with_unit(each, departments).dropDuplicates(["faculty_id", "dept_id"])


def works(papers: DataFrame) -> DataFrame:
    """One row per paper_id; rows loaded twice are equal but for the time of loading."""
    return papers.dropDuplicates(["paper_id"])


def label_names(papers: DataFrame, themes: DataFrame, domains: DataFrame) -> DataFrame:
    """Adds theme and domain names ('' if unknown), first topic, and sub-domain ('' if none)."""
    out = papers
    for name, field, source in (("theme", "thematic_area_id", themes), ("domain", "domain_id", domains)):
        lookup = source.groupBy(F.lower("id").alias("_ref")).agg(F.max("name").alias(name))
        out = out.withColumn("_ref", reference_id(F.col(f"classification.{field}"))).join(lookup, "_ref", "left").drop("_ref").withColumn(name, F.coalesce(name, F.lit("")))
    return out.withColumn("topic", F.coalesce(F.get("classification.topics", F.lit(0)), F.lit(""))).withColumn("subdomain", F.coalesce("classification.subdomain_id", F.lit("")))


def owners(papers: DataFrame, persons: DataFrame) -> DataFrame:
    """Which papers are whose, by reference array, author id or mailbox, each pair once: paper_id, faculty_id.

    Three equi-joins under a distinct union instead of one join with alternatives.
    """
    by_ref = papers.select("paper_id", F.explode(F.array_distinct(F.transform(F.coalesce("iitd_authors", F.array()), lambda x: reference_id(x["faculty_ref"])))).alias("faculty_id")).join(persons.select("faculty_id").distinct(), "faculty_id").select("paper_id", "faculty_id")
    stored = persons.select("faculty_id", F.explode("scopus_id").alias("author_id")).filter(F.trim("author_id") != "").distinct()
    by_author = papers.select("paper_id", F.explode(F.transform("authors", lambda a: a["author_id"])).alias("author_id")).join(stored, "author_id").select("paper_id", "faculty_id")
    boxes = persons.filter("kerberos <> ''").select("faculty_id", "kerberos").distinct()
    by_box = papers.filter(F.trim("kerberos") != "").select("paper_id", F.lower("kerberos").alias("kerberos")).join(boxes, "kerberos").select("paper_id", "faculty_id")
    return by_ref.union(by_author).union(by_box).distinct()


def tag_of(category: Column) -> Column:
    """Tags of a unit: 'all' and that of its category."""
    tags = F.create_map(*[F.lit(x) for pair in CATEGORY_TAGS.items() for x in pair])
    return F.array_compact(F.array(F.lit("all"), tags[category]))


# ---- fixed values: categories and their tags ----
CATEGORY_TAGS = {"Department": "departments", "School": "schools", "Centre": "centres", "Research Lab / Facility": "researchlabs"}
