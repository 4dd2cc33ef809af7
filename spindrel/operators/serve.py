"""Read queries composed of the others: ranked matches, base sets, suggestions, payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import holds
from .search import FIELDS, paper_hits, phrases, related


def ranked_matches(rows: DataFrame, column: str, query: str, weight: str, limit: int) -> DataFrame:
    """Rows whose text holds the query, or all its tokens (two letters or more) if it has several: exact ones first, then those that begin with it, then by weight; ties by text."""
    q = query.strip().lower()
    parts = [t for t in q.split() if len(t) >= 2]
    hit = holds(F.col(column), q)
    if len(parts) > 1:
        hit = hit | reduce(lambda a, b: a & b, [holds(F.col(column), t) for t in parts])
    low = F.lower(F.trim(column))
    return rows.filter(hit).orderBy((low == q).desc(), F.startswith(low, F.lit(q)).desc(), F.col(weight).desc(), column).limit(max(1, min(50, limit)))


def base_set(points: DataFrame, unit_points: DataFrame, people_points: DataFrame, query: str, entity: str = "") -> DataFrame:
    """The positions a first query stands for: those of a unit or person if asked for or named exactly, else of the matching texts. unit_points: i, unit_name; people_points: i, name."""
    q = query.strip().lower()
    exact = lambda df, c: df.filter(F.lower(F.trim(c)) == q).select("i")
    by_unit, by_name = exact(unit_points, "unit_name"), exact(people_points, "name")
    if entity == "department":
        return by_unit.distinct()
    if entity == "faculty":
        return by_name.distinct()
    if not by_unit.isEmpty():
        return by_unit.distinct()
    if not by_name.isEmpty():
        return by_name.distinct()
    return points.filter(reduce(lambda a, b: a & b, [reduce(lambda x, y: x | y, [holds(F.col(c), t) for c in FIELDS]) for t in q.split()], F.lit(True))).select("i").distinct()


def suggestions(points: DataFrame, terms: DataFrame, units: DataFrame, people: DataFrame, query: str, limit: int = 8, papers: DataFrame | None = None) -> DataFrame:
    """What to offer for a query, in one table: kind (keyword, theme, term, unit, person, paper), text, n. papers: paper_id, title, abstract."""
    size = max(1, min(20, limit))
    own = lambda df, kind, c, n: df.select(F.lit(kind).alias("kind"), F.col(c).alias("text"), F.col(n).cast("bigint").alias("n"))
    parts = [
        own(phrases(points, query, size), "keyword", "term", "n"),
        own(related(points, query, size), "theme", "theme", "n_papers"),
        own(ranked_matches(terms, "term", query, "n_papers", size), "term", "term", "n_papers"),
        own(ranked_matches(units, "unit_name", query, "n_faculty", size), "unit", "unit_name", "n_faculty"),
        own(ranked_matches(people, "name", query, "h_index", size), "person", "name", "h_index"),
    ]
    if papers is not None:
        parts.append(own(paper_hits(papers, points, query).limit(size), "paper", "title", "score"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def coordinates(points: DataFrame, wanted: DataFrame, most: int = 70_000) -> DataFrame:
    """Points of the wanted positions (i); negative ones are none, and at most `most` are answered, the lowest first."""
    ids = wanted.select(F.col("i").cast("bigint").alias("i")).filter("i >= 0").distinct().orderBy("i").limit(most)
    return points.join(ids, "i", "left_semi")


def wire(rows: DataFrame, numbers: list[str]) -> DataFrame:
    """The contract's form: a missing number is 0, which a hidden metric becomes too."""
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})


def json_lines(rows: DataFrame, key: str) -> DataFrame:
    """One JSON document per row with its key; nulls are kept as nulls."""
    return rows.select(F.col(key), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("payload"))


def people_for(hits: DataFrame, owned: DataFrame, homes: DataFrame, people: DataFrame) -> DataFrame:
    """Who works on matching papers: unit, person, number of papers."""
    return hits.select("paper_id").join(owned, "paper_id").groupBy("faculty_id").agg(F.count(F.lit(1)).alias("n_papers")).join(homes, "faculty_id").join(people.select("faculty_id", "name"), "faculty_id").select("unit_name", "faculty_id", "name", "n_papers")


def first_existing(spark, names: list[str]) -> str | None:
    """The first of several tables the catalogue knows."""
    return next((n for n in names if spark.catalog.tableExists(n)), None)
