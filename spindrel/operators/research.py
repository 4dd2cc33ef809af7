"""Publication counts, lists, subjects and metrics of people."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp_arg
from ..functions.text import listed_once


def timeline(works: DataFrame, per_year: int = 3) -> DataFrame:
    """Per mailbox and year: number of papers and the most cited ones' ids."""
    own = works.filter((F.trim("kerberos") != "") & F.col("publication_year").isNotNull())
    w = Window.partitionBy("kerberos", "publication_year").orderBy(F.col("citation_count").desc_nulls_last(), "paper_id")
    # the window cuts to `per_year` before anything is gathered
    top = own.select("kerberos", "publication_year", "paper_id", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= per_year)
    best = top.groupBy("kerberos", "publication_year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))), lambda x: x["paper_id"]), ",").alias("top_papers"))
    return own.groupBy("kerberos", "publication_year").agg(F.count(F.lit(1)).alias("n_papers")).join(best, ["kerberos", "publication_year"])


def facets(works: DataFrame) -> DataFrame:
    """Per mailbox: papers, different years with 'no year' as one of them, and years on the timeline."""
    own = works.filter(F.trim("kerberos") != "")
    per_year = own.groupBy("kerberos", "publication_year").agg(F.count(F.lit(1)).alias("n"))
    return per_year.groupBy("kerberos").agg(F.sum("n").alias("total_papers"), F.count(F.lit(1)).alias("total_years"), F.count("publication_year").alias("timeline_years"))


def publications(works: DataFrame, kerberos: str | None, author_ids: list[str], year: int, skip: object = 0, limit: object = 20) -> DataFrame:
    """One page of a person's papers of a year, most cited first; with neither mailbox nor author ids there are none."""
    start, size = max(0, clamp_arg(skip, 0, 0)), clamp_arg(limit, 20, 1, 50)
    match = F.lit(False)
    if kerberos:
        match = match | F.coalesce(F.col("kerberos") == kerberos, F.lit(False))
    if author_ids:
        match = match | F.coalesce(F.exists("authors", lambda a: a["author_id"].isin(author_ids)), F.lit(False))
    hits = works.filter(match & (F.col("publication_year") == year))
    return hits.orderBy(F.col("citation_count").desc_nulls_last(), "paper_id").offset(start).limit(size).select("paper_id", "title", "publication_year", F.coalesce("citation_count", F.lit(0)).alias("citation_count"))


def subjects(works: DataFrame, persons: DataFrame, most: int = 8) -> DataFrame:
    """A person's most frequent subjects: counted by mailbox and by each author id, the larger count holds; ties by subject."""
    by_box = works.filter(F.trim("kerberos") != "").select("kerberos", F.explode("subject_area").alias("subject")).groupBy("kerberos", "subject").agg(F.count(F.lit(1)).alias("n"))
    boxes = by_box.join(persons.select("kerberos", "expert_id"), "kerberos").select("expert_id", "subject", "n")
    stored = persons.select("expert_id", F.explode("scopus_id").alias("author_id")).filter(F.trim("author_id") != "").distinct()
    # the ids are joined before subjects are exploded, so that only known authors multiply
    by_id = works.select(F.explode(F.transform("authors", lambda a: a["author_id"])).alias("author_id"), "subject_area").join(stored, "author_id").select("expert_id", "author_id", F.explode("subject_area").alias("subject")).groupBy("expert_id", "author_id", "subject").agg(F.count(F.lit(1)).alias("n"))
    merged = boxes.union(by_id.select("expert_id", "subject", "n")).filter(F.trim("subject") != "").groupBy("expert_id", F.trim("subject").alias("subject")).agg(F.max("n").alias("n_papers"))
    w = Window.partitionBy("expert_id").orderBy(F.col("n_papers").desc(), "subject")
    return merged.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= most)


def research_areas(persons: DataFrame, subject_rows: DataFrame) -> DataFrame:
    """Up to eight areas from six sources in order, each once whatever its letter case."""
    own = subject_rows.groupBy("expert_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "subject"))), lambda x: x["subject"]).alias("_subjects"))
    buckets = [F.transform("dominant_domains", lambda d: d["name"]), F.col("expertise"), F.col("brief_expertise"), F.col("subjects"), F.col("wos_subjects"), F.col("_subjects")]
    return persons.join(own, "expert_id", "left").select("faculty_id", F.array_join(listed_once(buckets), "|").alias("research_areas"))


def h_index(works: DataFrame) -> DataFrame:
    """Per author id: papers, citations, and h; missing counts are 0. The rank is that among counts, so a running count per distinct value suffices."""
    cited = works.select(F.explode("authors").alias("a"), F.coalesce("citation_count", F.lit(0)).alias("c")).select(F.col("a.author_id").alias("author_id"), "c").filter(F.col("author_id") != "")
    counts = cited.groupBy("author_id", "c").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("author_id").orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # with m papers of at least c citations, h is at least min(m, c)
    return counts.withColumn("m", F.sum("n").over(w)).groupBy("author_id").agg(F.sum("n").alias("n_papers"), F.sum(F.col("n") * F.col("c")).alias("n_citations"), F.max(F.least("m", F.col("c").cast("bigint"))).alias("h_index"))


def metric_sources(persons: DataFrame, derived: DataFrame, force: bool = False) -> DataFrame:
    """Where a person's missing metrics would come from: a stored profile (id given), else the author id's papers, else nowhere. Only people with a metric that is 0 or missing, unless forced."""
    wanted = persons.filter(F.lit(force) | (F.coalesce("h_index", F.lit(0)) == 0) | (F.coalesce("citation_count", F.lit(0)) == 0))
    one = wanted.withColumn("author_id", F.substring_index(F.get(F.filter("scopus_id", lambda x: F.trim(x) != ""), F.lit(0)), "&", 1))
    profile = F.exists("google_scholar_id", lambda x: F.trim(x) != "")
    joined = one.join(derived.select("author_id", F.col("h_index").alias("h"), F.col("n_citations").alias("c")), "author_id", "left")
    source = F.when(profile, "profile").when(F.col("h").isNotNull(), "papers").otherwise("skip")
    return joined.select("faculty_id", source.alias("source"), F.when(source == "papers", F.col("h")).alias("new_h_index"), F.when(source == "papers", F.col("c")).alias("new_citations"))


def stored_totals(works: DataFrame, persons: DataFrame, enough: int = 10) -> DataFrame:
    """Papers stored per person: those keyed by profile in the mailbox plus those of each author id; a paper may count twice."""
    keyed = works.filter(F.startswith("document_eid", F.lit("scholar_")) & (F.trim("kerberos") != "")).groupBy("kerberos").agg(F.count(F.lit(1)).alias("a"))
    ids = works.select(F.explode(F.transform("authors", lambda a: a["author_id"])).alias("author_id")).groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))
    by_id = persons.select("faculty_id", F.explode("scopus_id").alias("author_id")).join(ids, "author_id").groupBy("faculty_id").agg(F.sum("n").alias("b"))
    total = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
    return persons.select("faculty_id", "kerberos").join(keyed, "kerberos", "left").join(by_id, "faculty_id", "left").select("faculty_id", total.alias("n_stored"), (total >= enough).alias("enough"))


def coauthors(works: DataFrame) -> DataFrame:
    """Different co-authors' names per author id, in any letter case, without the author. A paper's authors are one row's array, so its pairs come from that row; equal ones are combined before the shuffle."""
    name = lambda x: F.lower(F.trim(x["author_name"]))
    each = works.select("authors", F.explode("authors").alias("a"))
    others = F.filter("authors", lambda o: (o["author_id"] != F.col("a.author_id")) & (name(o) != F.lower(F.trim("a.author_name"))))
    pairs = each.select(F.col("a.author_id").alias("author_id"), F.explode(F.array_distinct(F.transform(others, name))).alias("other"))
    return pairs.groupBy("author_id").agg(F.countDistinct("other").alias("n_coauthors"))


def collaborators(works: DataFrame) -> DataFrame:
    """How often two people of the directory publish together: faculty_a < faculty_b. A paper's pairs come from its own array."""
    refs = works.select(F.array_distinct(F.filter(F.transform("iitd_authors", lambda x: F.lower(F.trim(x["faculty_ref"]))), lambda f: f != "")).alias("refs"))
    pairs = refs.select("refs", F.explode("refs").alias("faculty_a")).select("faculty_a", F.explode(F.filter("refs", lambda f: f > F.col("faculty_a"))).alias("faculty_b"))
    return pairs.groupBy("faculty_a", "faculty_b").agg(F.count(F.lit(1)).alias("n_papers"))


def year_histogram(works: DataFrame) -> DataFrame:
    return works.groupBy("publication_year").agg(F.count(F.lit(1)).alias("n_papers"))
