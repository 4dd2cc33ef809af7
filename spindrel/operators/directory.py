"""Browsing and searching the directory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp_arg, rounded, shown
from ..functions.text import first_given, holds, listed_once, tokens, word_in
from .identity import CATEGORY_TAGS, memberships, tag_of, with_unit


def grouped(persons: DataFrame, departments: DataFrame, category: str = "all") -> DataFrame:
    """People per unit, home or further: number, mean h-index, and their ids from the highest h-index down. Unknown category tags filter nothing."""
    rows = memberships(persons, departments)
    wanted = {tag: name for name, tag in CATEGORY_TAGS.items()}.get(category)
    rows = rows.filter(F.col("category") == wanted) if wanted else rows
    ranked = F.array_sort(F.collect_list(F.struct((-F.coalesce("h_index", F.lit(-1))).alias("h"), "faculty_id")))
    return rows.groupBy("dept_id", "unit_name").agg(F.count(F.lit(1)).alias("n_faculty"), rounded(F.avg("h_index")).alias("mean_h_index"), F.array_join(F.transform(ranked, lambda x: x["faculty_id"]), ",").alias("faculty_ids"))


def grouped_cards(persons: DataFrame, departments: DataFrame) -> DataFrame:
    """The cards of every unit's people, home or further, as rows: dept_id, place (from 1, by h-index, highest first), and the card. One row per person, so no unit is gathered."""
    rows = memberships(persons, departments)
    place = F.row_number().over(Window.partitionBy("dept_id").orderBy(F.coalesce("h_index", F.lit(-1)).desc(), "faculty_id")).cast("bigint")
    v = "metric_visibility"
    return rows.select("dept_id", place.alias("place"), "faculty_id", "name", "designation", shown(F.col("h_index"), F.col(f"{v}.h_index")).alias("h_index"), shown(F.col("citation_count"), F.col(f"{v}.citations")).alias("citation_count"))


def totals(persons: DataFrame, departments: DataFrame) -> DataFrame:
    """One row over all units: units with people, memberships, different people."""
    rows = memberships(persons, departments).select("dept_id", "faculty_id")
    return rows.agg(F.countDistinct("dept_id").alias("n_units"), F.count(F.lit(1)).alias("n_memberships"), F.countDistinct("faculty_id").alias("n_faculty"))


def best_text(persons: DataFrame, query: str, limit: object = 10) -> DataFrame:
    """The people `search_text` scores highest, ties by id."""
    return search_text(persons, query).orderBy(F.desc("score"), "faculty_id").limit(clamp_arg(limit, 10, 1, 100))


def units_in_order(departments: DataFrame, limit: int) -> DataFrame:
    """Units by name as a reader would sort them, letter case last: place (from 1), name."""
    names = departments.select("name").distinct().orderBy(F.collate("name", "UNICODE"), "name").limit(limit)
    return names.select(F.row_number().over(Window.orderBy(F.collate("name", "UNICODE"), "name")).cast("bigint").alias("place"), "name")


def unit_summary(persons: DataFrame, departments: DataFrame) -> DataFrame:
    """Units with their number of people and tags."""
    counts = memberships(persons, departments).groupBy("dept_id", "unit_name", "category").agg(F.count(F.lit(1)).alias("n_faculty"))
    return counts.select("dept_id", "unit_name", "n_faculty", F.array_join(tag_of(F.col("category")), ",").alias("tags"))


def unit_members(persons: DataFrame, departments: DataFrame, code: str) -> DataFrame:
    """The people of one unit, home or further."""
    return memberships(persons, departments).filter(F.col("code") == code).select("faculty_id", "name", "h_index")


SORTS = {"name": ["firstName", "lastName"], "h_index": ["h_index"], "citations": ["citation_count"]}


def page(persons: DataFrame, departments: DataFrame, page_no: object = 1, limit: object = 9, sort_by: str = "h_index", order: str = "desc") -> DataFrame:
    """One page of cards. The page is cut before units are looked up, so a person without known unit leaves a gap."""
    n, size = clamp_arg(page_no, 1, 1), clamp_arg(limit, 9, 1, 100)
    columns = SORTS.get(sort_by, SORTS["h_index"])
    keys = [F.col(c).asc_nulls_first() if order == "asc" else F.col(c).desc_nulls_last() for c in columns]
    cut = persons.orderBy(*keys, "faculty_id").offset((n - 1) * size).limit(size)
    return cards(with_unit(cut, departments))


def pagination(total: int, page_no: object = 1, limit: object = 9) -> dict:
    n, size = clamp_arg(page_no, 1, 1), clamp_arg(limit, 9, 1, 100)
    pages = -(-total // size)
    return {"page": n, "limit": size, "total": total, "totalPages": pages, "hasNext": n < pages, "hasPrev": n > 1}


def cards(rows: DataFrame) -> DataFrame:
    """The short form of a person with a unit."""
    v = "metric_visibility"
    return rows.select(
        "faculty_id", "name", "title", "designation", "kerberos", "unit_name", shown(F.col("h_index"), F.col(f"{v}.h_index")).alias("h_index"), shown(F.col("citation_count"), F.col(f"{v}.citations")).alias("citation_count"), "profile_image_url"
    )


def details(persons: DataFrame, departments: DataFrame) -> DataFrame:
    """The long form: metrics as shown, research areas, first identifiers, unit and its tags."""
    v = "metric_visibility"
    areas = listed_once([F.transform("dominant_domains", lambda d: d["name"]), F.col("expertise"), F.col("brief_expertise"), F.col("subjects"), F.col("wos_subjects")])
    return with_unit(persons, departments, how="left").select(
        "faculty_id", "name", "kerberos", shown(F.col("h_index"), F.col(f"{v}.h_index")).alias("h_index"), shown(F.col("citation_count"), F.col(f"{v}.citations")).alias("citation_count"),
        F.array_join(areas, "|").alias("research_areas"), first_given(F.col("scopus_id")).alias("scopus_id"), first_given(F.col("google_scholar_id")).alias("google_scholar_id"), first_given(F.col("orcid_id")).alias("orcid_id"),
        "unit_name", F.array_join(F.when(F.col("dept_id").isNotNull(), tag_of(F.col("category"))).otherwise(F.array(F.lit("all"))), ",").alias("tags"),
    )


def profile_extras(persons: DataFrame) -> DataFrame:
    """Background and qualifications, only where the flag is exactly true."""
    return persons.select(
        "faculty_id", F.when(F.col("background_visible").eqNullSafe(True), F.coalesce("background", F.lit(""))).otherwise(F.lit("")).alias("background"),
        F.when(F.col("qualifications_visible").eqNullSafe(True), F.array_join(F.coalesce("qualifications", F.array().cast("array<string>")), "|")).otherwise(F.lit("")).alias("qualifications"),
    )


def main_domains(persons: DataFrame) -> DataFrame:
    """A person's main domains that have a name and a slug; a missing count is 0."""
    d = persons.select("faculty_id", F.posexplode("dominant_domains").alias("pos", "d"))
    return d.filter((F.col("d.name") != "") & (F.col("d.slug") != "")).select("faculty_id", "pos", F.col("d.name").alias("domain"), "d.slug", F.coalesce("d.paper_count", F.lit(0)).alias("paper_count"))


def search_people(persons: DataFrame, query: str, limit: object = 10) -> DataFrame:
    """People whose name contains every token (two letters or more): 3 for the whole name, and per token 2 as a word or else 1; ties by h-index, then id."""
    parts = [t for t in query.lower().split() if len(t) >= 2]
    size = clamp_arg(limit, 10, 1, 20)
    if not parts:
        return persons.select("faculty_id", "name", F.lit(0).alias("score")).limit(0)
    score = F.when(F.lower("name") == " ".join(query.lower().split()), 3).otherwise(0)
    for t in parts:
        score = score + F.when(word_in(F.col("name"), t), 2).otherwise(1)
    hits = persons.filter(reduce(lambda a, b: a & b, [holds(F.col("name"), t) for t in parts])).withColumn("score", score)
    return hits.orderBy(F.col("score").desc(), F.col("h_index").desc_nulls_last(), "faculty_id").limit(size).select("faculty_id", "name", "score")


# ---- fixed values: weights of the fields of a person's text ----
FIELD_WEIGHTS = {"firstName": 10, "lastName": 10, "expertise": 5, "brief_expertise": 5, "subjects": 3, "wos_subjects": 3}


def search_text(persons: DataFrame, query: str) -> DataFrame:
    """People whose fields hold any token of the query as a word; the score adds field weight by occurrence."""
    wanted = F.array(*[F.lit(t) for t in query.lower().split()])
    score = F.lit(0)
    for c, w in FIELD_WEIGHTS.items():
        text = F.col(c) if c in ("firstName", "lastName") else F.array_join(c, " ")
        score = score + F.size(F.filter(tokens(F.coalesce(text, F.lit("")), 1), lambda t: F.array_contains(wanted, t))) * w
    return persons.withColumn("score", score).filter("score > 0").select("faculty_id", "name", "score")


def search_units(departments: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Units whose name holds the query's tokens in order."""
    pattern = "(?i)" + ".*".join(rf"\Q{t}\E" for t in query.split())
    return departments.select("dept_id", "name").distinct().filter(F.regexp_like("name", F.lit(pattern))).orderBy("name", "dept_id").limit(limit)
