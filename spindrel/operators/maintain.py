"""Maintenance as plans: every operator returns the rows it would change, so the dry run is the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .identity import unit_names
from .orphans import reference_key


def upsert(existing: DataFrame, incoming: DataFrame, key: str, columns: list[str], insert_only: tuple[str, ...] = ()) -> DataFrame:
    """Existing and incoming records as one table: an incoming value replaces unless null or empty; `insert_only` columns are set on new records only. action says insert, update or none. Incoming keys must be unique."""
    blank = lambda c: F.nullif(F.col(c), F.lit("")) if dict(incoming.dtypes)[c.removeprefix("n.")] == "string" else F.col(c)
    joined = existing.select(key, *columns, F.lit(True).alias("_old")).alias("o").join(incoming.select(key, *columns, F.lit(True).alias("_new")).alias("n"), key, "full")
    merged = [(F.coalesce(f"o.{c}", f"n.{c}") if c in insert_only else F.coalesce(blank(f"n.{c}"), F.col(f"o.{c}"))).alias(c) for c in columns]
    changed = F.lit(False)
    for c in columns:
        if c not in insert_only:
            changed = changed | ~F.coalesce(blank(f"n.{c}"), F.col(f"o.{c}")).eqNullSafe(F.col(f"o.{c}"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNotNull() & changed, "update").otherwise("none")
    return joined.select(key, *merged, action.alias("action"))


def new_units(codes: DataFrame, departments: DataFrame) -> DataFrame:
    """Codes that no unit has, in upper case and each once: those a find-or-create would create."""
    wanted = codes.select(F.upper(F.trim("code")).alias("code")).filter("code <> ''").distinct()
    return wanted.join(departments.select(F.upper("code").alias("code")), "code", "left_anti")


def email_kind(email: Column, domain: str) -> Column:
    """central (the bare domain), department (one label before it), other, or invalid."""
    host = F.lower(F.substring_index(F.trim(email), "@", -1))
    ok = F.regexp_like(F.trim(email), F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))
    return F.when(~F.coalesce(ok, F.lit(False)), "invalid").when(host == domain, "central").when(F.endswith(host, F.lit("." + domain)) & (F.size(F.split(F.replace(host, F.lit("." + domain), F.lit("")), r"\.")) == 1), "department").otherwise("other")


def email_plan(persons: DataFrame, departments: DataFrame, domain: str) -> DataFrame:
    """Where a central address would become mailbox@code.domain: faculty_id, email, new_email, action (update, or collision if someone else has that address)."""
    lookup = unit_names(departments).join(departments.select("dept_id", "code").distinct(), "dept_id").select(F.col("ref").alias("unit_ref"), "code")
    plain = persons.filter(email_kind(F.col("email"), domain) == "central").join(lookup, "unit_ref").withColumn("new_email", F.lower(F.concat("kerberos", F.lit("@"), "code", F.lit("." + domain))))
    taken = persons.select(F.lower("email").alias("new_email"), F.col("faculty_id").alias("owner")).groupBy("new_email").agg(F.min("owner").alias("owner"), F.max("owner").alias("owner2"))
    other = (F.col("owner") != F.col("faculty_id")) | (F.col("owner2") != F.col("faculty_id"))
    return plain.join(taken, "new_email", "left").select("faculty_id", "email", "new_email", F.when(F.coalesce(other, F.lit(False)), "collision").otherwise("update").alias("action"))


def reconcile(rows: DataFrame, persons: DataFrame, departments: DataFrame) -> DataFrame:
    """Rows of (row_key, kerberos, department_code) against people and units: action update, none, or skip with its reason."""
    lookup = unit_names(departments).withColumnRenamed("ref", "_code")
    held = persons.select("kerberos", "faculty_id", "unit_ref").join(unit_names(departments).withColumnRenamed("ref", "unit_ref").withColumnRenamed("dept_id", "own"), "unit_ref", "left")
    one = held.groupBy("kerberos").agg(F.min(F.struct("faculty_id", "own")).alias("p"))  # the first record of a mailbox
    joined = rows.withColumn("_code", F.upper(F.trim("department_code"))).join(lookup, "_code", "left").withColumn("kerberos", F.lower(F.trim("kerberos"))).join(one, "kerberos", "left")
    reason = F.when(F.coalesce("_code", F.lit("")) == "", "no unit given").when(F.col("dept_id").isNull(), "unknown unit").when(F.col("p").isNull(), "unknown person").otherwise("")
    action = F.when(reason != "", "skip").when(F.col("p.own").eqNullSafe(F.col("dept_id")), "none").otherwise("update")
    return joined.select("row_key", "kerberos", F.col("p.faculty_id").alias("faculty_id"), F.col("dept_id").alias("new_dept_id"), action.alias("action"), reason.alias("reason"))


def add_affiliations(persons: DataFrame, listed: DataFrame) -> DataFrame:
    """People (faculty_id, dept_id listed) whose further units would grow: the unit is added once and not if it is there or is the home unit."""
    held = F.array_union(F.coalesce("affiliations", F.array().cast("array<string>")), F.array("department"))
    pairs = listed.select("faculty_id", "dept_id").distinct()
    return pairs.join(persons.select("faculty_id", held.alias("held")), "faculty_id").filter(~F.array_contains("held", F.col("dept_id"))).select("faculty_id", "dept_id")


def unlisted(listed: DataFrame, persons: DataFrame) -> DataFrame:
    """Listed people that have no record."""
    return listed.select("faculty_id").distinct().join(persons.select("faculty_id"), "faculty_id", "left_anti")


def year_backfill(points: DataFrame, works: DataFrame, low: int = 1900, high: int = 2200) -> DataFrame:
    """Points (paper_id, year) whose year would change to that of the paper, if that is valid: paper_id, old_year, new_year."""
    source = works.select("paper_id", F.col("publication_year").alias("new_year")).filter(F.col("new_year").between(low, high))
    return points.select("paper_id", F.col("year").alias("old_year")).join(source, "paper_id").filter(~F.col("old_year").eqNullSafe(F.col("new_year")))


def newest_versions(versions: DataFrame, keep: int, active: str) -> DataFrame:
    """Versions to remove: all but the `keep` newest and the active one."""
    w = Window.orderBy(F.col("created_at").desc(), F.col("version").desc())  # a handful of versions
    return versions.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") > keep) & (F.col("version") != active)).select("version")


def last_writer(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rejected(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with all messages in order."""
    messages = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in rules.items()]))
    return rows.withColumn("messages", F.array_join(messages, "; ")).filter("messages <> ''")




def set_by_mailbox(persons: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """People whose fields a change list (kerberos and some of the columns) sets: faculty_id, the columns, changed. A null says nothing; the address must begin with kerberos@; of several changes of a mailbox the largest value of each column counts."""
    one = changes.select(F.lower(F.trim("kerberos")).alias("_box"), *columns).filter("_box <> ''").groupBy("_box").agg(*[F.max(c).alias(f"_new_{c}") for c in columns])
    rows = persons.withColumn("_box", F.when(F.contains("email", F.lit("@")), F.lower(F.substring_index("email", "@", 1)))).join(one, "_box", "left")
    new = {c: F.coalesce(f"_new_{c}", F.col(c)) for c in columns}
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~new[c].eqNullSafe(F.col(c))
    return rows.select("faculty_id", *[v.alias(c) for c, v in new.items()], changed.alias("changed"))


def recategorised(departments: DataFrame, corrections: dict[str, str]) -> DataFrame:
    """Units with a list of categories by code applied: dept_id, code, previous, category. A listed code that no unit has is an error row of its own with no dept_id."""
    table = departments.sparkSession.createDataFrame(sorted(corrections.items()), "_code string, wanted string")
    rows = departments.select("dept_id", "code", F.col("category").alias("previous")).distinct().join(table, F.lower("code") == F.lower("_code"), "full")
    return rows.select("dept_id", F.coalesce("code", "_code").alias("code"), "previous", F.coalesce("wanted", "previous").alias("category"))


def unit_sync(wanted: DataFrame, departments: DataFrame) -> DataFrame:
    """What a membership file (code, name, category, may_create) would do to the units: code, action (create, update, none, skip), name, category."""
    held = departments.select(F.upper("code").alias("code"), F.col("name").alias("_name"), F.col("category").alias("_category")).groupBy("code").agg(F.max("_name").alias("_name"), F.max("_category").alias("_category"))
    rows = wanted.select(F.upper(F.trim("code")).alias("code"), "name", "category", "may_create").join(held, "code", "left")
    same = F.col("name").eqNullSafe(F.col("_name")) & F.col("category").eqNullSafe(F.col("_category"))
    action = F.when(F.col("_name").isNull(), F.when(F.col("may_create"), "create").otherwise("skip")).when(same, "none").otherwise("update")
    return rows.select("code", action.alias("action"), "name", "category")


def verified_matches(matches: DataFrame, persons: DataFrame, departments: DataFrame) -> DataFrame:
    """Whether a match list (row_key, faculty_id, email, code) holds: same_email, home_unit (the unit is the person's home), affiliated (it is a further one), covered (either)."""
    lookup = unit_names(departments).select(F.col("ref").alias("_code"), F.lower("dept_id").alias("unit"))
    held = persons.select("faculty_id", F.lower("email").alias("_email"), F.col("unit_ref"), F.transform(F.coalesce("affiliations", F.array().cast("array<string>")), reference_key).alias("more"))
    home = unit_names(departments).select(F.col("ref").alias("unit_ref"), F.lower("dept_id").alias("home"))
    rows = matches.withColumn("_code", F.upper(F.trim("code"))).join(lookup, "_code", "left").join(held, "faculty_id").join(home, "unit_ref", "left")
    no = F.lit(False)
    is_home = F.coalesce(F.col("home") == F.col("unit"), no)
    further = F.coalesce(F.array_contains("more", F.col("unit")) | F.array_contains("more", F.col("_code")), no)
    return rows.select("row_key", "faculty_id", F.coalesce(F.lower(F.trim("email")) == F.col("_email"), no).alias("same_email"), is_home.alias("home_unit"), further.alias("affiliated"), (is_home | further).alias("covered"))


def on_roster(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """Rows (dept_id, faculty_id, ...) that a roster (dept_id, faculty_id) admits: for every listed unit, rows of other units, or people it lists."""
    units = roster.select(F.lower("dept_id").alias("_unit")).distinct().withColumn("_listed", F.lit(True))
    listed = roster.select(F.lower("dept_id").alias("_unit"), F.lower("faculty_id").alias("_who")).distinct().withColumn("_on", F.lit(True))
    keyed = rows.withColumn("_unit", F.lower("dept_id")).withColumn("_who", F.lower("faculty_id"))
    return keyed.join(units, "_unit", "left").join(listed, ["_unit", "_who"], "left").filter("_listed IS NULL OR _on").drop("_unit", "_who", "_listed", "_on")


def report(sections: dict[str, DataFrame], key: str) -> DataFrame:
    """Several plans as one report table: section, key, detail (the row as JSON), ready to be written as JSON lines."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(df.columns))).alias("detail")) for name, df in sections.items()])
