"""Searching the atlas of papers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PHRASE_STOPWORDS, all_tokens_in_any, ascii_words, holds, tokens

FIELDS = ("title", "topic", "subdomain", "domain", "theme")
# ---- fixed values: weights of the fields for a single word ----
WEIGHTS = {"title": 5, "topic": 4, "subdomain": 3, "domain": 2, "theme": 1}


def search(points: DataFrame, query: str, limit: int = 5000) -> DataFrame:
    """One token matches words and is ranked by field weight; several must each be contained in some field. The limit is clamped to 70,000."""
    size = max(1, min(70_000, limit))
    parts = tokens_of(query)
    if len(parts) == 1:
        score = reduce(lambda a, b: a + b, [F.size(F.filter(tokens(F.coalesce(c, F.lit(""))), lambda t: t == parts[0])) * w for c, w in WEIGHTS.items()])
        return points.withColumn("score", score).filter("score > 0").orderBy(F.col("score").desc(), "i").limit(size).select("i", "paper_id", "score")
    hits = points.filter(all_tokens_in_any(" ".join(parts), [F.col(c) for c in FIELDS]))
    return hits.orderBy("i").limit(size).select("i", "paper_id", F.lit(0).alias("score"))


def tokens_of(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[^\w-]+", query.lower()) if len(t) >= 2]


def paper_hits(papers: DataFrame, points: DataFrame, query: str, most: int = 500) -> DataFrame:
    """Papers (paper_id, title, abstract) with a word of the query, the `most` best by occurrences in title and abstract, 10 to 1; of these the plotted ones by relevance: i, paper_id, title, score."""
    asked = F.array(*[F.lit(t) for t in tokens_of(query)]).cast("array<string>")
    count = lambda c: F.size(F.filter(tokens(F.coalesce(c, F.lit(""))), lambda t: F.array_contains(asked, t)))
    best = papers.select("paper_id", "title", (10 * count("title") + count("abstract")).alias("score")).filter("score > 0").orderBy(F.col("score").desc(), "paper_id").limit(most)
    return best.join(points.select("i", "paper_id"), "paper_id").select("i", "paper_id", "title", "score").orderBy(F.col("score").desc(), "paper_id")


def in_theme(points: DataFrame, theme: str, query: str) -> DataFrame:
    """Points of a theme with the whole query in some field."""
    return points.filter((F.col("theme") == theme) & reduce(lambda a, b: a | b, [holds(F.col(c), query) for c in FIELDS]))


def refine(points: DataFrame, base: DataFrame, query: str, unit_points: DataFrame, people_points: DataFrame | None = None, kind: str = "", tags: DataFrame | None = None) -> DataFrame:
    """Positions of a base set that match the query; each once. people_points: i, faculty_id, name; tags: i, department.

    `kind` is department, faculty, or found by an exact name of a unit, else of a
    person; without it text, units and people count together. Of a department,
    papers tagged to another one are dropped; of a person not named exactly, the three best matches count.
    """
    q = query.strip().lower()
    exact = lambda df, c: df.filter(F.lower(F.trim(c)) == q)
    units = exact(unit_points, "unit_name")
    people = people_points if people_points is not None else unit_points.limit(0).select("i", F.lit("").alias("faculty_id"), F.lit("").alias("name"))
    named = exact(people, "name")
    kind = kind or ("department" if not units.isEmpty() else "faculty" if not named.isEmpty() else "")
    parts = [t for t in q.split() if len(t) >= 2]
    by_name = people.filter(holds(F.col("name"), q) | (all_tokens_in_any(" ".join(parts), [F.col("name")]) if len(parts) > 1 else F.lit(False)))
    by_unit = unit_points.filter(holds(F.col("unit_name"), q))
    if kind == "department":
        found = (by_unit if units.isEmpty() else units).select("i")
        if tags is not None:
            tag = F.lower(F.trim("department"))
            other = tags.filter((tag != "") & ~F.contains(tag, F.lit(q)) & ~F.contains(F.lit(q), tag))
            found = found.join(other.select("i"), "i", "left_anti")
    elif kind == "faculty":
        best = by_name.groupBy("faculty_id", "name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.startswith(F.lower(F.trim("name")), F.lit(q)).desc(), F.col("n").desc(), "name", "faculty_id").limit(3)
        found = (by_name.join(best.select("faculty_id"), "faculty_id", "left_semi") if named.isEmpty() else named).select("i")
    else:
        found = points.filter(all_tokens_in_any(query, [F.col(c) for c in FIELDS])).select("i").union(by_unit.select("i")).union(by_name.select("i"))
    return found.distinct().join(base.select("i").distinct(), "i", "left_semi")


def phrases(titles: DataFrame, query: str, limit: int) -> DataFrame:
    """Completions of the query's last word: words that begin with it and their continuations up to three words, counted per occurrence; most frequent, then shortest, then by letters."""
    import re

    asked = [w for w in re.split(r"[^a-z0-9]+", query.lower()) if w]
    head = asked[-1] if asked else None
    if head is None:
        return titles.select(F.lit("").alias("term"), F.lit(0).cast("bigint").alias("n")).limit(0)
    words = titles.select(ascii_words(F.col("title")).alias("w"))
    stop = F.array(*[F.lit(s) for s in PHRASE_STOPWORDS])
    at = lambda k: F.coalesce(F.get("w", F.col("pos") + k), F.lit(""))
    goes_on = lambda c: (F.length(c) >= 2) & ~F.array_contains(stop, c)
    starts = words.select("w", F.posexplode("w").alias("pos", "x")).filter(F.startswith("x", F.lit(head)) & (F.length("x") >= 2))
    one, two, three = F.col("x"), at(1), at(2)
    made = F.array_compact(F.array(one, F.when(goes_on(two), F.concat_ws(" ", one, two)), F.when(goes_on(two) & goes_on(three), F.concat_ws(" ", one, two, three))))
    counted = starts.select(F.explode(made).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(~F.col("term").isin(*PHRASE_STOPWORDS)).orderBy(F.col("n").desc(), F.length("term"), "term").limit(limit)


def related(points: DataFrame, query: str, most: int = 8) -> DataFrame:
    """Themes of the papers whose title holds the query, with their number."""
    return points.filter(holds(F.col("title"), query) & (F.col("theme") != "")).groupBy("theme").agg(F.count(F.lit(1)).alias("n_papers")).orderBy(F.col("n_papers").desc(), "theme").limit(most)


def breakdown(points: DataFrame, unit_points: DataFrame, theme: str, query: str) -> DataFrame:
    """Papers of a theme and query per unit; papers without unit under 'Unassigned'."""
    hits = in_theme(points, theme, query).select("i", "paper_id", "citation_count")
    placed = hits.join(unit_points.select("i", "unit_name").distinct(), "i", "left").withColumn("unit_name", F.coalesce("unit_name", F.lit("Unassigned")))
    return placed.groupBy("unit_name").agg(F.count(F.lit(1)).alias("n_papers"), F.sum(F.coalesce("citation_count", F.lit(0))).alias("n_citations"), F.min("i").alias("first_i"))


def similar(vectors: DataFrame, anchors: DataFrame, n: int = 5) -> DataFrame:
    """The n nearest vectors by cosine for each anchor, the anchor itself aside. Anchors are a stated query set and meet all vectors once."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    a = anchors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).withColumn("qn", norm(F.col("q")))
    v = vectors.withColumn("vn", norm(F.col("embedding")))
    dot = F.aggregate(F.zip_with("q", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = v.join(a, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(dot / (F.col("qn") * F.col("vn")), 6).alias("cosine"))
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)


#: Wanted and offered titles that meet in one task.
BLOCKS = (200_000, 50_000)


def fit_counts(wanted: DataFrame, offered: DataFrame, share: float = 0.6) -> DataFrame:
    """How many offered titles (paper_id, title; each pair once) fit each wanted one (row_key, title) by the rule of `title_fits`: row_key, n_fits. Null titles fit nothing.

    Exact. A word is contained in a title if it is in one of its words, which then
    shares the word's first four letters; so containment is settled between distinct
    words. Blocks of titles, as numbers of the words they contain, meet in pairs.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 3)
    asks = wanted.filter(F.col("title").isNotNull()).select("row_key", F.lower("title").alias("wanted"))
    a = asks.select("wanted").distinct().select("wanted", F.xxhash64("wanted").alias("a"), words(F.col("wanted")).alias("w"))
    titles = offered.filter(F.col("title").isNotNull()).select("paper_id", "title").distinct()
    b = titles.groupBy(F.lower("title").alias("offered")).agg(F.count(F.lit(1)).alias("n")).select(F.xxhash64("offered").alias("b"), "offered", "n")

    there = b.select("b", "n", F.explode(F.array_distinct(words(F.col("offered")))).alias("around"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("around") - 3), lambda k: F.substring(F.col("around"), k, F.lit(4))))
    within = (
        a.select(F.explode("w").alias("word")).distinct().select("word", F.substring("word", 1, 4).alias("gram"))
        .join(there.select("around").distinct().select("around", F.explode(grams).alias("gram")), "gram")
        .filter(F.contains("around", F.col("word")))
        .select(F.xxhash64("word").alias("word"), "around")
    )
    found = there.join(within, "around").groupBy("b", "n").agg(F.collect_set("word").alias("w"))
    mine = a.filter(F.size("w") > 0).select("a", F.transform("w", lambda w: F.xxhash64(w)).alias("w"))
    n_mine, n_theirs = (max(1, -(-df.count() // size)) for df, size in zip((a, b), BLOCKS))
    left = mine.select(F.pmod("a", F.lit(n_mine)).alias("x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_theirs - 1).cast("bigint"))).alias("y"), "a", "w")
    right = found.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_mine - 1).cast("bigint"))).alias("x"), F.pmod("b", F.lit(n_theirs)).alias("y"), "n", "w")
    counted = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(lambda p, q: _block_fits(p, q, share), "a bigint, n bigint")
    fits = counted.groupBy("a").agg(F.sum("n").alias("n")).join(a, "a").select("wanted", "n")
    every = a.filter(F.size("w") == 0).select("wanted").crossJoin(b.agg(F.sum("n").alias("n"))).filter("n > 0").select("wanted", "n")  # without long words a title fits all
    return asks.join(fits.unionByName(every), "wanted").groupBy("row_key").agg(F.sum("n").alias("n_fits"))


def _block_fits(mine: pa.Table, theirs: pa.Table, share: float) -> pa.Table:
    """Per wanted title (a, w) the sum of n of the titles (n, w) that contain `share` of its words."""
    flat = lambda t: (t.column("w").combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(t.column("w")).to_numpy())]).astype(np.int64))
    ids, sums = [], []
    if mine.num_rows and theirs.num_rows:
        (w, at), (v, end) = flat(mine), flat(theirs)
        n = theirs.column("n").to_numpy()
        order = np.argsort(v, kind="stable")
        titles = np.repeat(np.arange(len(n)), np.diff(end))[order]
        known, first = np.unique(v[order], return_index=True)
        first = np.append(first, len(titles))
        place = np.minimum(np.searchsorted(known, w), len(known) - 1)
        place[known[place] != w] = -1
        names = mine.column("a").to_numpy()
        met = np.zeros(len(n), np.int32)
        for i in range(len(names)):
            size = at[i + 1] - at[i]
            need = next(k for k in range(max(0, int(size * share) - 1), size + 1) if k / size >= share)
            lists = [k for k in place[at[i] : at[i + 1]] if k >= 0]
            if len(lists) < need:
                continue
            met.fill(0)
            for k in lists:
                met[titles[first[k] : first[k + 1]]] += 1
            total = int(n[met >= need].sum())
            if total:
                ids.append(names[i])
                sums.append(total)
    return pa.table({"a": pa.array(ids, pa.int64()), "n": pa.array(sums, pa.int64())})
