"""Variant spellings of person names: which author ids and faculty records are one person.

Blocking is by the suffixes of name tokens from a minimum length on. The shortest
one of every token is refined with another field: the faculty id or mailbox that
papers name beside the author, a stored author id, or the unit that at least half
of the author's papers name, without which no author counts whom no paper names.
However many share a suffix, all who also share that field are compared. Pairs are compared by longest-common-subsequence
ratio, and accepted by the name together with what the papers say.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from ..operators.orphans import reference_id, reference_key
from ..session import cut

#: Least length of an indexed suffix; shorter tokens are indexed whole.
SUFFIX = 4
#: No suffix is too common to be compared any more; a RARE_LEAST of 0 leaves out the authors whom no paper names.
RARE_SHARE, RARE_LEAST = 2000, 3
# ---- fixed values: forms of address dropped from names ----
TITLES = frozenset("dr prof professor mr mrs ms miss sir shri smt".split())


def name_tokens(name: str | None) -> list[str]:
    """Tokens of a name in lower case, without accents, hyphens and titles."""
    if not name:
        return []
    low = "".join(c for c in unicodedata.normalize("NFKD", name).lower() if not unicodedata.combining(c))
    return [t for t in re.findall(r"[^\W\d_]+", re.sub(r"[-'’]", "", low)) if t not in TITLES]


@F.pandas_udf(StringType())
def plain_name(names: pd.Series) -> pd.Series:
    """The tokens of each name in the order given."""
    return names.map(lambda n: " ".join(name_tokens(n)) if isinstance(n, str) else "")


def lcs_ratio(a: list[str], b: list[str]) -> np.ndarray:
    """2 * LCS / (|a| + |b|) of many pairs of texts at once; two empty texts have 0."""
    out = np.zeros(len(a))
    lengths = np.array([max(len(x), len(y)) for x, y in zip(a, b)])
    for low, high in ((0, 16), (16, 32), (32, 64), (64, 10**9)):  # pairs of like length share a table
        pick = np.flatnonzero((lengths > low) & (lengths <= high))
        for part in np.array_split(pick, max(1, len(pick) // 4096 + 1)):
            if not len(part):
                continue
            la, lb = np.array([len(a[i]) for i in part]), np.array([len(b[i]) for i in part])
            x, y = np.zeros((len(part), la.max()), np.int32), np.full((len(part), lb.max()), -1, np.int32)
            for r, i in enumerate(part):
                x[r, : la[r]] = np.frombuffer(a[i].encode("utf-32-le"), np.int32)
                y[r, : lb[r]] = np.frombuffer(b[i].encode("utf-32-le"), np.int32)
            row = np.zeros((len(part), lb.max() + 1), np.int32)
            for k in range(la.max()):
                step = np.maximum(row[:, 1:], row[:, :-1] + ((y == x[:, k : k + 1]) & (y >= 0) & (x[:, k : k + 1] > 0)))
                row[:, 1:] = np.maximum.accumulate(step, 1)
            out[part] = 2 * row[:, -1] / np.maximum(1, la + lb)
    return out


def _forms(typed: list[str], first: str, last: str) -> list[tuple[str, str, float]]:
    """Ways to lay a typed name against a record's parts: either order, shortened given names, and initials."""
    full = [first.replace(" ", "") + last.replace(" ", "")]
    out = [("".join(t), f, 1.0) for t in (typed, typed[::-1]) for f in full]
    long = [t for t in typed if len(t) > 2]
    for given, family in ((first, last), (last, first)):
        if not given or not family or not long:
            continue
        family = family.replace(" ", "")
        initials = [t for t in typed if len(t) <= 2]
        if len(long) == 1 and (any(t[0] == given[0] for t in initials) or (not initials and long[0][0] == given[0] and len(long[0]) > len(family))):
            out.append((long[0] if initials else long[0][1:], family, 0.98))
        if len(long) >= 2 and given == first:  # a nickname keeps the beginning of the given name
            for nick, rest in ((long[0], "".join(long[1:])), (long[-1], "".join(long[:-1]))):
                shared = len(_common(nick, given))
                if shared >= 3:
                    out.append((rest, family, 0.95))
    return out


def _common(a: str, b: str) -> str:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return a[:n]


@F.pandas_udf(DoubleType())
def name_likeness(typed: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    """How well a typed name (plain) fits a record's given and family name (plain), from 0 to 1."""
    left, right, weight, owner = [], [], [], []
    for i, (t, f, s) in enumerate(zip(typed, first, last)):
        for a, b, w in _forms((t or "").split(), f or "", s or ""):
            left.append(a)
            right.append(b)
            weight.append(w)
            owner.append(i)
    best = np.zeros(len(typed))
    if left:
        np.maximum.at(best, np.array(owner), lcs_ratio(left, right) * np.array(weight))
    return pd.Series(best)


def tokens_of(name: Column) -> Column:
    """The tokens of a plain name that are more than initials."""
    return F.array_distinct(F.filter(F.split(name, " "), lambda t: F.length(t) > 1))


def suffixes(name: Column) -> Column:
    """The shortest indexed suffix of every token of a plain name."""
    return F.array_distinct(F.transform(tokens_of(name), lambda t: F.right(t, F.lit(SUFFIX))))


def faculty_people(faculty: DataFrame, departments: DataFrame) -> DataFrame:
    """One row per faculty_id (rows loaded twice count once): first, last, mailbox, unit, unit_refs (id and code the unit is named by), scopus_id."""
    units = departments.select(reference_key(F.col("dept_id")).alias("ref"), F.lower("dept_id").alias("unit")).union(departments.select(F.upper("code"), F.lower("dept_id"))).distinct()
    named = units.groupBy("unit").agg(F.collect_set("ref").alias("unit_refs"))
    one = faculty.filter(F.col("faculty_id").isNotNull()).groupBy("faculty_id").agg(F.max(F.struct("firstName", "lastName", "email", "department", "scopus_id")).alias("r"))
    return (
        one.select(
            F.lower("faculty_id").alias("faculty_id"), plain_name("r.firstName").alias("first"), plain_name("r.lastName").alias("last"),
            F.lower(F.substring_index("r.email", "@", 1)).alias("mailbox"), reference_key(F.col("r.department")).alias("ref"), F.coalesce("r.scopus_id", F.array()).alias("scopus_id"),
        )
        .join(units, "ref", "left")
        .drop("ref")
        .join(named, "unit", "left")
    )


def author_links(papers: DataFrame, people: DataFrame, least: float = 0.75, share: float = 0.08, alone: float = 0.95) -> DataFrame:
    """Author ids that are a faculty record's person: author_id, faculty_id, likeness, share (of the author's papers that name the record, its mailbox, or at least its unit).

    Named records need a name of `least` likeness, 0.85 if few papers name them;
    where papers name only the unit, the whole name must agree by `alone` and half
    of the papers be the unit's.
    """
    listed = papers.select(F.explode("authors").alias("a"), "iitd_authors", "kerberos").filter(F.col("a.author_id") != "")
    ids = lambda field, read: F.filter(F.transform(F.coalesce("iitd_authors", F.array()), lambda x: read(x[field])), lambda x: x != "")
    boxed = F.when(F.trim("kerberos") != "", F.array(F.concat(F.lit("@"), F.lower(F.trim("kerberos"))))).otherwise(F.array().cast("array<string>"))
    refs = F.array_distinct(F.concat(ids("faculty_ref", reference_id), boxed))
    beside = listed.select(F.col("a.author_id").alias("author_id"), F.explode(F.concat(F.array(F.lit("")), refs)).alias("ref"))
    counted = beside.groupBy("author_id", "ref").agg(F.count(F.lit(1)).alias("n"))
    total = counted.filter("ref = ''").select("author_id", F.col("n").alias("total"))
    often = counted.filter("ref <> ''").join(total, "author_id").filter(F.col("n") >= F.lit(share) * F.col("total")).select("author_id", "ref", (F.col("n") / F.col("total")).alias("share"))
    known = people.select("faculty_id", F.col("faculty_id").alias("ref")).union(people.filter("mailbox <> ''").select("faculty_id", F.concat(F.lit("@"), F.col("mailbox"))))
    stored = people.select(F.explode("scopus_id").alias("author_id"), "faculty_id", F.lit(1.0).alias("share")).filter(F.col("author_id") != "")
    evidence = often.join(known, "ref").select("author_id", "faculty_id", "share").unionByName(stored).groupBy("author_id", "faculty_id").agg(F.max("share").alias("share"))

    each = listed.select(F.col("a.author_id").alias("author_id"), F.explode(F.concat(F.array("a.author_name"), F.coalesce("a.author_avaialable_names", F.array()))).alias("name")).filter(F.col("name") != "").distinct()
    spelled = cut(each.withColumn("name", plain_name("name")).filter("name <> ''").distinct())
    index = spelled.select("author_id", F.explode(suffixes(F.col("name"))).alias("suffix")).distinct()
    tails = people.select("faculty_id", F.explode(suffixes(F.concat_ws(" ", "first", "last"))).alias("suffix"))
    # common suffixes, refined by what the papers name beside the author
    refined = evidence.join(tails, "faculty_id").join(index, ["author_id", "suffix"]).select("author_id", "faculty_id", "share").distinct()
    compared = refined.join(people.select("faculty_id", "first", "last"), "faculty_id").join(spelled, "author_id").withColumn("likeness", name_likeness("name", "first", "last"))
    judged = compared.groupBy("author_id", "faculty_id").agg(F.max("likeness").alias("likeness"), F.max("share").alias("share"))
    # colleagues with like names meet on a few papers; a weak share needs a better name
    named = cut(judged.filter((F.col("likeness") >= least) & ((F.col("share") >= 0.3) | (F.col("likeness") >= 0.85))))

    if RARE_LEAST < 1:
        return named.select("author_id", "faculty_id", "likeness", "share")
    # whom no paper names: the unit that half of an author's papers name refines every suffix, rare or common; whole names must agree
    refs = people.select("unit", F.explode("unit_refs").alias("ref")).distinct().groupBy("ref").agg(F.collect_set("unit").alias("units"))
    lookup = refs.agg(F.map_from_entries(F.collect_list(F.struct("ref", "units"))).alias("units_of"))
    meant = lambda x: F.coalesce(F.try_element_at("units_of", x), F.array().cast("array<string>"))
    homes = papers.crossJoin(F.broadcast(lookup)).select("authors", F.array_distinct(F.flatten(F.transform(ids("department_ref", reference_key), meant))).alias("units"))
    homes = homes.select(F.explode("authors.author_id").alias("author_id"), "units").filter(F.col("author_id") != "").join(named.select("author_id"), "author_id", "left_anti")
    said = homes.select("author_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), "units")).alias("unit")).groupBy("author_id", "unit").agg(F.count(F.lit(1)).alias("n"))
    total = said.filter("unit is null").select("author_id", F.col("n").alias("total"))
    housed = said.filter("unit is not null").join(total, "author_id").select("author_id", "unit", (F.col("n") / F.col("total")).alias("share")).filter("share >= 0.5")
    letters = lambda *c: F.length(F.translate(F.concat(*c), " ", ""))
    beginnings = lambda *c: F.array_sort(F.transform(F.filter(F.split(F.concat_ws(" ", *c), " "), lambda t: t != ""), lambda t: F.substring(t, 1, 1)))
    every = spelled.join(housed, "author_id").select("author_id", "share", "name", "unit", F.explode(suffixes(F.col("name"))).alias("suffix"))
    own = people.select("faculty_id", "first", "last", "unit", F.explode(suffixes(F.concat_ws(" ", "first", "last"))).alias("suffix"))
    met = every.join(own, ["unit", "suffix"])
    whole = met.filter((F.abs(letters("name") - letters("first", "last")) <= 0.1 * letters("first", "last")) & (F.size(F.array_intersect(beginnings("name"), beginnings("first", "last"))) > 0))
    alike = whole.select("author_id", "faculty_id", "share", "name", "first", "last").distinct().withColumn("likeness", name_likeness("name", "first", "last"))
    unnamed = alike.filter(F.col("likeness") >= alone).groupBy("author_id", "faculty_id").agg(F.max("likeness").alias("likeness"), F.max("share").alias("share"))
    return named.select("author_id", "faculty_id", "likeness", "share").unionByName(unnamed)


def twice_entered(people: DataFrame, links: DataFrame, sure: float = 0.9, least: float = 0.8) -> DataFrame:
    """Pairs of faculty records of one person: faculty_a, faculty_b.

    Records are compared under a suffix within one department, however many share
    both, and under all their suffixes together where no department is known; and
    wherever they are linked to the same author id. A pair is one person if the
    names are all but equal, or alike and linked to the same author id.
    """
    name = F.concat_ws(" ", "first", "last")
    block = F.when(F.col("unit").isNotNull(), F.transform(suffixes(name), lambda x: F.concat_ws("|", "unit", x))).otherwise(F.array(F.array_join(F.array_sort(suffixes(name)), "+")))
    tails = people.withColumn("name", name).filter("name <> ''").select("faculty_id", "first", "last", "name", F.explode(block).alias("block"))
    a = tails.select("block", F.col("faculty_id").alias("faculty_a"), F.col("name").alias("name_a"))
    pairs = a.join(tails.select("block", F.col("faculty_id").alias("faculty_b"), "first", "last"), "block").filter("faculty_a < faculty_b").select("faculty_a", "faculty_b", "name_a", "first", "last")
    linked = links.select("author_id", "faculty_id")
    together = cut(linked.withColumnRenamed("faculty_id", "faculty_a").join(linked.withColumnRenamed("faculty_id", "faculty_b"), "author_id").filter("faculty_a < faculty_b").select("faculty_a", "faculty_b").distinct().withColumn("together", F.lit(True)))
    own = people.select(F.col("faculty_id").alias("faculty_a"), name.alias("name_a"))
    other = people.select(F.col("faculty_id").alias("faculty_b"), "first", "last")
    met = together.drop("together").join(own, "faculty_a").join(other, "faculty_b").select("faculty_a", "faculty_b", "name_a", "first", "last")
    alike = pairs.unionByName(met).distinct().withColumn("likeness", name_likeness("name_a", "first", "last")).filter(F.col("likeness") >= least)
    return alike.join(together, ["faculty_a", "faculty_b"], "left").filter((F.col("likeness") >= sure) | F.col("together")).select("faculty_a", "faculty_b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Classes of the records that `edges` (a, b) connects: id, class (the smallest id). Labels spread until nothing changes; each round is checkpointed."""
    both = cut(edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("id").agg(F.least(F.min("id"), F.min("other")).alias("class")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("class").alias("near"))
        # and jump to the class of the own class, so that chains shorten fast
        step = labels.join(near, "id").select("id", F.least("class", "near").alias("class"), F.col("class").alias("was"))
        jump = step.join(step.select(F.col("id").alias("class"), F.col("class").alias("up")), "class", "left").select("id", F.least("class", F.coalesce("up", "class")).alias("class"), "was")
        fresh = cut(jump, rounds=True)
        labels = fresh.select("id", "class")
        if fresh.filter("class <> was").isEmpty():
            return labels


def same_person(papers: DataFrame, faculty: DataFrame, departments: DataFrame) -> DataFrame:
    """Pairs of one person: key_a, key_b; each author id with each of the person's faculty ids, and the faculty ids among each other, the smaller key first.

    Null and empty names, ids and references are no evidence; rows loaded twice
    change no share and count once in faculty; names of any length are compared
    whole; an author id belongs to one person, that with the larger evidence, ties
    by the smaller faculty id; empty tables give no rows.
    """
    people = cut(faculty_people(faculty, departments))
    links = cut(author_links(papers, people))
    twins = cut(twice_entered(people, links))
    classes = components(twins.select(F.col("faculty_a").alias("a"), F.col("faculty_b").alias("b")))
    person = people.select("faculty_id").join(classes.withColumnRenamed("id", "faculty_id"), "faculty_id", "left").select("faculty_id", F.coalesce("class", "faculty_id").alias("person"))
    person = cut(person)
    owner = (
        links.join(person, "faculty_id")
        .groupBy("author_id", "person")
        .agg(F.sum(F.col("share") * F.col("likeness")).alias("weight"))
        .groupBy("author_id")
        .agg(F.min(F.struct((-F.round("weight", 9)).alias("w"), "person")).alias("best"))
        .select("author_id", F.col("best.person").alias("person"))
    )
    authors = owner.join(person, "person").select(F.col("author_id").alias("x"), F.col("faculty_id").alias("y"))
    shared = person.join(classes.select(F.col("class").alias("person")).distinct(), "person", "left_semi")
    records = shared.withColumnRenamed("faculty_id", "x").join(shared.withColumnRenamed("faculty_id", "y"), "person").filter("x < y").select("x", "y")
    return authors.unionByName(records).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
