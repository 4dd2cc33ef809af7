"""The catalogue of papers as a service sees it: filtered search with paging, facets and counts, people and papers of a cluster, reads by id."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp_arg
from ..functions.text import holds, tokens
from .search import FIELDS, WEIGHTS, in_theme, tokens_of

#: At most so many refining queries are chained.
MOST_REFINEMENTS = 8


@dataclass
class Filters:
    """What a catalogue search is narrowed to; what is not given narrows nothing."""

    years: tuple[int | None, int | None] = (None, None)
    kinds: tuple[str, ...] = ()
    themes: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    least_citations: int | None = None
    author_id: str | None = None
    refinements: tuple[str, ...] = field(default_factory=tuple)

    def condition(self) -> Column:
        low, high = self.years
        tests = [
            F.col("year") >= low if low is not None else None, F.col("year") <= high if high is not None else None, F.col("document_type").isin(*self.kinds) if self.kinds else None,
            F.col("theme").isin(*self.themes) if self.themes else None, F.col("domain").isin(*self.domains) if self.domains else None,
            F.coalesce("citation_count", F.lit(0)) >= self.least_citations if self.least_citations is not None else None,
            F.exists("author_ids", lambda a: a == self.author_id) if self.author_id else None,
            *[reduce(lambda a, b: a | b, [holds(F.col(c), q) for c in FIELDS]) for q in self.refinements[:MOST_REFINEMENTS]],
        ]
        return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests if t is not None], F.lit(True))


def relevance(query: str, fields: tuple[str, ...] = FIELDS) -> Column:
    """Occurrences of the query's words in the chosen fields, by field weight; 1 for an empty query."""
    asked = F.array(*[F.lit(t) for t in tokens_of(query)]).cast("array<string>")
    if not tokens_of(query):
        return F.lit(1)
    return reduce(lambda a, b: a + b, [F.size(F.filter(tokens(F.coalesce(c, F.lit(""))), lambda t: F.array_contains(asked, t))) * WEIGHTS[c] for c in fields])


def hits(catalog: DataFrame, query: str, filters: Filters | None = None, fields: tuple[str, ...] = FIELDS, basic: bool = False) -> DataFrame:
    """The papers that match with their score. basic: every word must occur; else any does. The filters reach the scan."""
    rows = catalog.filter((filters or Filters()).condition())
    if basic:
        for t in tokens_of(query):
            rows = rows.filter(reduce(lambda a, b: a | b, [F.array_contains(tokens(F.coalesce(c, F.lit(""))), t) for c in fields]))
    return rows.withColumn("score", relevance(query, fields)).filter("score > 0")


#: Orders a caller may ask for; citations per year of age is what normalises them.
ORDERS = {
    "relevance": ["score"], "date": ["year"], "citations": ["citation_count"], "normalized": ["per_year"],
}


def found_page(rows: DataFrame, sort: str = "relevance", page: object = 1, size: object = 20, current_year: int = 2026) -> DataFrame:
    """One page of `hits`, the highest first and missing values last, ties by paper_id."""
    n, each = clamp_arg(page, 1, 1), clamp_arg(size, 20, 1, 100)
    aged = rows.withColumn("per_year", F.coalesce("citation_count", F.lit(0)) / F.greatest(F.lit(1), F.lit(current_year) - F.coalesce("year", F.lit(current_year)) + 1))
    order = [F.col(c).desc_nulls_last() for c in ORDERS.get(sort, ORDERS["relevance"])]
    return aged.orderBy(*order, "paper_id").offset((n - 1) * each).limit(each)


def facet_counts(rows: DataFrame) -> DataFrame:
    """How many hits each year, kind, theme and domain has: facet, value, n; one pass over the hits."""
    values = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value")) for name, c in (("year", "year"), ("kind", "document_type"), ("theme", "theme"), ("domain", "domain"))])
    return rows.select(F.explode(values).alias("f")).filter("f.value <> ''").groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def suggested(catalog: DataFrame, people: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """People and papers for a half-typed query: intent (author, paper), id, text, confidence in percent: 100 for the whole text, 80 if it begins with the query, 50 if it holds it; ties by text."""
    q = query.strip().lower()

    def ranked(df: DataFrame, intent: str, key: str, text: str) -> DataFrame:
        low = F.lower(F.trim(text))
        sure = F.when(low == q, 100).when(F.startswith(low, F.lit(q)), 80).when(F.contains(low, F.lit(q)), 50)
        own = df.select(F.lit(intent).alias("intent"), F.col(key).alias("id"), F.col(text).alias("text"), sure.alias("confidence")).filter("confidence IS NOT NULL")
        return own.orderBy(F.desc("confidence"), "text", "id").limit(limit)

    return ranked(people, "author", "faculty_id", "name").unionByName(ranked(catalog, "paper", "paper_id", "title"))


def combination_counts(catalog: DataFrame, owned: DataFrame, filters: Filters) -> DataFrame:
    """One row: papers and people for a combination of filters."""
    rows = catalog.filter(filters.condition()).select("paper_id")
    return rows.join(owned, "paper_id", "left").agg(F.countDistinct("paper_id").alias("n_papers"), F.countDistinct("faculty_id").alias("n_faculty"))


def ranked_people(catalog: DataFrame, owned: DataFrame, filters: Filters, page: object = 1, size: object = 20) -> DataFrame:
    """People by their papers under the filters, most first, ties by id: one page."""
    n, each = clamp_arg(page, 1, 1), clamp_arg(size, 20, 1, 100)
    counted = catalog.filter(filters.condition()).select("paper_id").join(owned, "paper_id").groupBy("faculty_id").agg(F.count(F.lit(1)).alias("n_papers"))
    return counted.orderBy(F.desc("n_papers"), "faculty_id").offset((n - 1) * each).limit(each)


def papers_of(catalog: DataFrame, owned: DataFrame, faculty_id: str, filters: Filters | None = None, page: object = 1, size: object = 20) -> DataFrame:
    """One page of a person's papers under the filters, newest first."""
    n, each = clamp_arg(page, 1, 1), clamp_arg(size, 20, 1, 100)
    own = catalog.filter((filters or Filters()).condition()).join(owned.filter(F.col("faculty_id") == faculty_id).select("paper_id"), "paper_id", "left_semi")
    return own.orderBy(F.col("year").desc_nulls_last(), "paper_id").offset((n - 1) * each).limit(each)


def reranked(vectors: DataFrame, query: list[float], top_n: int | None = None) -> DataFrame:
    """Vectors (vec_id, embedding) by cosine to a query's vector, highest first, ties by id."""
    norm = sum(x * x for x in query) ** 0.5 or 1.0
    asked = F.array(*[F.lit(float(x) / norm) for x in query])
    dot = F.aggregate(F.zip_with("embedding", asked, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = vectors.select("vec_id", F.round(dot / F.nullif(size, F.lit(0.0)), 5).alias("relevance")).orderBy(F.col("relevance").desc_nulls_last(), "vec_id")
    return rows.limit(top_n) if top_n else rows


# clusters: a theme and a query, its units, their people, their papers


def cluster_units(points: DataFrame, unit_points: DataFrame, theme: str, query: str, most: int = 200) -> DataFrame:
    """Per unit of a cluster: number of papers and the first `most` positions (1 to 500) in order. Only the first ones are gathered."""
    size = clamp_arg(most, 200, 1, 500)
    placed = in_theme(points, theme, query).select("i").join(unit_points.select("i", "unit_name").distinct(), "i", "left").withColumn("unit_name", F.coalesce("unit_name", F.lit("Unassigned")))
    rank = F.row_number().over(Window.partitionBy("unit_name").orderBy("i"))
    first = placed.withColumn("k", rank).filter(F.col("k") <= size).groupBy("unit_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda x: x.cast("string")), ",").alias("first_papers"))
    return placed.groupBy("unit_name").agg(F.count(F.lit(1)).alias("n_papers")).join(first, "unit_name")


def cluster_people(points: DataFrame, people_points: DataFrame, theme: str, query: str, most: int = 20) -> DataFrame:
    """Per unit and person of a cluster: how many of its papers are theirs, and the first of them. people_points: i, unit_name, faculty_id, name; units agree in any letter case."""
    met = in_theme(points, theme, query).select("i").join(people_points.select("i", F.lower(F.trim("unit_name")).alias("unit"), "faculty_id", "name").distinct(), "i")
    rank = F.row_number().over(Window.partitionBy("unit", "faculty_id", "name").orderBy("i"))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.col("i")))), lambda x: x.cast("string")), ",")
    return met.withColumn("k", rank).groupBy("unit", "faculty_id", "name").agg(F.count(F.lit(1)).alias("n_papers"), first.alias("first_papers"))


def cluster_papers(points: DataFrame, unit_points: DataFrame, theme: str, query: str, most: int = 3) -> DataFrame:
    """The first papers of every unit of a cluster as they are shown: unit_name, rank, i, paper_id, title, domain, topic, citations."""
    rows = in_theme(points, theme, query).join(unit_points.select("i", "unit_name").distinct(), "i", "left").withColumn("unit_name", F.coalesce("unit_name", F.lit("Unassigned")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("unit_name").orderBy("i")).cast("bigint")).filter(F.col("rank") <= most)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return ranked.select("unit_name", "rank", "i", "paper_id", text("title"), text("domain"), text("topic"), F.coalesce("citation_count", F.lit(0)).alias("citations"))


# reads


def since(points: DataFrame, year: int, current_year: int) -> DataFrame:
    """Positions of papers from a year on; a year before 1900 or after the next one has none."""
    return points.filter(F.lit(1900 <= year <= current_year + 1) & (F.col("year") >= year)).select("i")


def clean_id(c: Column) -> Column:
    """An id with anything but letters, digits, hyphens and underscores dropped."""
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "")


def within(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Rows at the positions of an index set."""
    return rows.join(base.select("i").distinct(), "i", "left_semi")


def positions_of_matches(matches: DataFrame, placed: DataFrame, column: str, query: str) -> DataFrame:
    """The positions behind a list of name matches, each once; if a match is exactly the query, only those behind it."""
    exact = matches.withColumn("exact", F.lower(F.trim(column)) == query.strip().lower())
    any_exact = exact.agg(F.max("exact").alias("any"))
    kept = exact.crossJoin(F.broadcast(any_exact)).filter(F.col("exact") | ~F.col("any"))
    return placed.join(kept.select(column).distinct(), column, "left_semi").select("i").distinct()


def prefetched(rows: DataFrame, ordinal: str, fetch: int, by: str, limit: int) -> DataFrame:
    """The first `fetch` rows by their stored order, and of those the `limit` highest: a bounded look, not the best of all."""
    return rows.orderBy(ordinal).limit(fetch).orderBy(F.col(by).desc_nulls_last(), ordinal).limit(limit)


def resolve_mailboxes(wanted: DataFrame, persons: DataFrame, most: int = 100) -> DataFrame:
    """The people behind mailbox names (kerberos): lower-cased, distinct, the first `most` in order; an address belongs to a name if it begins with name@."""
    names = wanted.select(F.lower(F.trim("kerberos")).alias("asked")).filter("asked <> ''").distinct().orderBy("asked").limit(most)
    owned = persons.select("faculty_id", "name", F.lower(F.substring_index("email", "@", 1)).alias("asked"), F.contains("email", F.lit("@")).alias("whole")).filter("whole")
    return names.join(owned, "asked").select("asked", "faculty_id", "name")


def timeline_years(works: DataFrame, offset: object = 0, limit: object = 5) -> DataFrame:
    """A page of every mailbox's years, the newest first: kerberos, publication_year, n_papers, place (from 0). 1 to 20 years, 5 if not said."""
    start, size = max(0, clamp_arg(offset, 0, 0)), clamp_arg(limit, 5, 1, 20)
    years = works.filter((F.trim("kerberos") != "") & F.col("publication_year").isNotNull()).groupBy("kerberos", "publication_year").agg(F.count(F.lit(1)).alias("n_papers"))
    place = (F.row_number().over(Window.partitionBy("kerberos").orderBy(F.desc("publication_year"))) - 1).cast("bigint")
    return years.withColumn("place", place).filter((F.col("place") >= start) & (F.col("place") < start + size))


def profile_timeline(papers: DataFrame, owner: str, most: int = 3) -> DataFrame:
    """Per owner and year: papers, and the best cited titles; papers without year, or year 0, are dropped first, missing counts are 0."""
    dated = papers.filter(F.coalesce("year", F.lit(0)) != 0).withColumn("citations", F.coalesce("citations", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(owner, "year").orderBy(F.desc("citations"), "title", "row_key"))
    ranked = dated.withColumn("k", rank)
    best = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "title")))), lambda x: F.coalesce(x["title"], F.lit("")))
    return ranked.groupBy(owner, "year").agg(F.count(F.lit(1)).alias("n_papers"), F.sum("citations").alias("n_citations"), F.array_join(best, "|").alias("top_titles"))


def newest_papers(papers: DataFrame, owner: str, most: int) -> DataFrame:
    """Each owner's papers by year, newest first and those without year last, cut to `most`."""
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.col("year").desc_nulls_last(), "row_key")).cast("bigint")
    return papers.withColumn("rank", rank).filter(F.col("rank") <= most)


def profile_papers(persons: DataFrame, works: DataFrame, profiles: DataFrame) -> DataFrame:
    """A person's profile papers, stored ones first: faculty_id, source (stored, fetched), title, year, citations.

    Stored are works under a profile key in the person's mailbox; only people
    without any get those of a fetched profile (scholar_id, title, year,
    citations), by their first profile id. A profile that could not be fetched
    has no rows, and so the person none.
    """
    stored = works.filter(F.startswith("document_eid", F.lit("scholar_")) & (F.trim("kerberos") != "")).select(F.lower("kerberos").alias("kerberos"), "title", F.col("publication_year").alias("year"), F.coalesce("citation_count", F.lit(0)).alias("citations"))
    boxed = persons.filter("kerberos <> ''").select("faculty_id", "kerberos")
    first = boxed.join(stored, "kerberos").select("faculty_id", F.lit("stored").alias("source"), "title", "year", "citations")
    rest = persons.select("faculty_id", F.get(F.filter("google_scholar_id", lambda x: F.trim(x) != ""), F.lit(0)).alias("scholar_id")).join(first.select("faculty_id").distinct(), "faculty_id", "left_anti")
    fetched = rest.join(profiles.select("scholar_id", "title", "year", F.coalesce("citations", F.lit(0)).alias("citations")), "scholar_id").select("faculty_id", F.lit("fetched").alias("source"), "title", "year", "citations")
    return first.unionByName(fetched)


def research_summary(persons: DataFrame, owned: DataFrame, works: DataFrame, profile: DataFrame) -> DataFrame:
    """Where a person's research figures come from and what they are: those of their papers if they have author ids, else those of their profile papers; faculty_id, source, n_papers, n_citations."""
    has = F.exists(F.coalesce("scopus_id", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    people = persons.select("faculty_id", has.alias("has"))
    own = owned.join(works.select("paper_id", F.coalesce("citation_count", F.lit(0)).alias("c")), "paper_id").groupBy("faculty_id").agg(F.count(F.lit(1)).alias("a"), F.sum("c").alias("ac"))
    other = profile.groupBy("faculty_id").agg(F.count(F.lit(1)).alias("b"), F.sum("citations").alias("bc"))
    joined = people.join(own, "faculty_id", "left").join(other, "faculty_id", "left")
    source = F.when(F.col("has"), "papers").when(F.col("b").isNotNull(), "profile").otherwise("none")
    pick = lambda x, y: F.coalesce(F.when(F.col("has"), F.col(x)).otherwise(F.col(y)), F.lit(0))
    return joined.select("faculty_id", source.alias("source"), pick("a", "b").alias("n_papers"), pick("ac", "bc").alias("n_citations"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each part of the service holds: part, n. Each table is counted by itself, no rows meet."""
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in tables.items()])


def digest_key(ids: Column) -> Column:
    """A short key of a set of ids, whatever their order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), ","), 256), 1, 16)


def clipped(c: Column, size: int) -> Column:
    """A text cut to a report's column and filled up with blanks; null is blank."""
    return F.rpad(F.substring(F.coalesce(c, F.lit("")), 1, size), size, " ")


def plain_title(c: Column) -> Column:
    """Lower case, ASCII letters and digits with single blanks between."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def named_first(entries: Column, name: str) -> Column:
    """Entries that have a name before those that have none, otherwise in order."""
    has = lambda e: F.coalesce(F.trim(e[name]) != "", F.lit(False))
    return F.concat(F.filter(entries, has), F.filter(entries, lambda e: ~has(e)))

