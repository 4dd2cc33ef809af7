"""Free-entered values mapped to a canonical list by a prefix-filter set-similarity join."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..operators.skew import salted_lookup
from ..session import cut


def similar_sets(left: DataFrame, right: DataFrame, threshold: float | None = None) -> DataFrame:
    """Pairs (left_id, right_id, kind, jaccard) of token sets with Jaccard of at least the threshold, exactly all of them.

    Both sides: id, tokens (array of text without nulls; repeated tokens count
    once; empty and null sets match nothing), and, if no threshold is given, kind
    and least: sets of different kinds have no token in common and each kind its
    own threshold. Tokens are ordered by rarity over both sides; two sets can only
    reach the threshold t if they share a token among their first
    |x| - ceil(t|x|) + 1, so only these rare prefixes are joined; candidates pass the
    length and the positional filter before the exact check. Ids may be of any
    type; of an id with several sets of a kind, the best pair counts.
    """

    def tagged(df: DataFrame, side: str) -> DataFrame:
        kind, least = (F.lit(""), F.lit(float(threshold))) if threshold is not None else (F.col("kind"), F.col("least"))
        return df.select(F.lit(side).alias("side"), "id", kind.alias("kind"), least.alias("least"), F.array_distinct("tokens").alias("tokens"))

    both = tagged(left, "l").unionByName(tagged(right, "r")).filter(F.size("tokens") > 0)
    both = cut(both.withColumn("set", F.monotonically_increasing_id()))  # the running numbers must not change when a task is repeated
    listed = both.select("set", F.explode("tokens").alias("token"))
    rarity = listed.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = listed.join(rarity, "token").groupBy("set").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("t"))
    sets = both.drop("tokens").join(ordered, "set").withColumn("len", F.size("t"))
    prefix = sets.withColumn("p", F.slice("t", 1, (F.col("len") - F.ceil(F.col("least") * F.col("len") - 1e-9) + 1).cast("int")))
    probes = prefix.select("side", "id", "kind", "least", "set", "t", "len", F.posexplode("p").alias("pos", "token"))
    a = probes.filter("side = 'l'").select(F.col("id").alias("left_id"), "kind", "least", F.col("set").alias("ls"), F.col("t").alias("lt"), F.col("len").alias("ll"), F.col("pos").alias("lp"), "token")
    b = probes.filter("side = 'r'").select(F.col("id").alias("right_id"), F.col("set").alias("rs"), F.col("t").alias("rt"), F.col("len").alias("rl"), F.col("pos").alias("rp"), "token")
    t = F.col("least")
    overlap = F.ceil(t / (1 + t) * (F.col("ll") + F.col("rl")) - 1e-9)
    pairs = (
        a.join(b, "token")
        .filter((F.col("rl") >= t * F.col("ll") - 1e-9) & (F.col("ll") >= t * F.col("rl") - 1e-9))
        .filter(F.lit(1) + F.least(F.col("ll") - F.col("lp") - 1, F.col("rl") - F.col("rp") - 1) >= overlap)
        .dropDuplicates(["ls", "rs"])
    )
    same = F.size(F.array_intersect("lt", "rt"))
    return (
        pairs.withColumn("jaccard", same / (F.col("ll") + F.col("rl") - same))
        .filter(F.col("jaccard") >= t - 1e-9)
        .groupBy("left_id", "right_id", "kind")
        .agg(F.max("jaccard").alias("jaccard"))
    )


# ---- fixed values: words that say what kind of unit it is, and words of form ----
KINDS = ("department", "school", "centre", "center", "laboratory", "laboratories", "research", "facility", "unit", "group", "division", "section", "office")
SHORT_FORMS = frozenset("institute institutes dept deptt depts departments schools centres centers lab labs do d o of for the and in at".split())


def says_kind(word: str) -> bool:
    """A word for a kind of unit, or one cut short after four letters or more."""
    return word in SHORT_FORMS or word in KINDS or (len(word) >= 4 and any(k.startswith(word) for k in KINDS))


def plain(text: str) -> str:
    """NFKC, lower case, accents dropped, white space collapsed."""
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)).lower()
    return re.sub(r"\s+", " ", "".join(c for c in t if not unicodedata.combining(c))).strip()


def _grams(words: list[str]) -> list[str]:
    """Padded pairs of letters of every word."""
    return sorted({f"g{p[i : i + 2]}" for w in words for p in [f"^{w}$"] for i in range(len(p) - 1)})


def _stems(words: list[str]) -> list[str]:
    """Beginnings of up to four letters of every word, as abbreviations keep them."""
    return sorted({f"p{w[:i]}" for w in words for i in range(1, min(4, len(w)) + 1)})


def _letters(words: list[str]) -> list[str]:
    """All letters with their running number, whatever their order: swapped letters change nothing."""
    seen: dict[str, int] = {}
    for c in "".join(words):
        seen[c] = seen.get(c, 0) + 1
    return sorted(f"l{c}{i}" for c, n in seen.items() for i in range(n))


def views(text: str | None) -> list[tuple[str, list[str]]]:
    """The token sets under which a value may be looked up: name (letter pairs), stem (beginnings of words), letters (in any order), code (the whole code)."""
    if not text or not text.strip():
        return []
    low = plain(text)
    low = re.sub(r"\b(?:[a-z]\.){2,}[a-z]?\b\.?", lambda m: m.group().replace(".", "") + " ", low)  # p.l.d. is pld
    low = re.sub(r"\bd/o\b", " ", low)
    parts = re.findall(r"[a-z]+|\d+", low)
    core = [w for w in parts if not w.isdigit() and not says_kind(w)]
    out = []
    inside = re.search(r"\(([a-z]{2,5})\)", low)
    lead = re.match(r"\s*([a-z]{2,5})\s+[-–—:|]\s+\w", low)
    codes = {m.group(1) for m in (inside, lead) if m}
    if len(core) == 1 and 2 <= len(core[0]) <= 5:
        codes.add(core[0])
    named = [w for w in core if w not in codes] if len(core) > 1 else core
    if named and not (len(core) == 1 and codes):
        out += [("name", _grams(named)), ("stem", _stems(named)), ("letters", _letters(named))]
    out += [("code", [f"#{c}"]) for c in sorted(codes)]
    return out


_VIEWS = ArrayType(StructType([StructField("view", StringType()), StructField("tokens", ArrayType(StringType()))]))


@F.pandas_udf(_VIEWS)
def _views(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [{"view": a, "tokens": b} for a, b in views(v)])


#: The least Jaccard by view: letter pairs bear typing errors, beginnings of words and letters must nearly agree, codes must be equal.
LEAST = {"name": 0.5, "stem": 0.75, "letters": 0.8, "code": 1.0}


def map_to_canonical(typed: DataFrame, canonical: DataFrame, least: dict[str, float] | None = None) -> DataFrame:
    """Each typed value with the canonical record it names: row_key, value, canonical_id ('' if none), score.

    typed: row_key, value; null and blank values are left out, repeated rows count
    once. canonical: canonical_id, name, code (null allowed), only records that may
    be meant; repeated records count once. Distinct values are looked up, not rows,
    and joined back by a salted lookup, so a value typed in a third of all rows is
    no burden. The best view wins; if two records are equally good for a value, it
    names none. An empty list leaves every value unmatched.
    """
    least = {**LEAST, **(least or {})}
    rows = typed.filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select("row_key", "value").distinct()
    values = rows.select("value").distinct()
    names = canonical.select("canonical_id", F.col("name").alias("text")).distinct()
    listed = names.select(F.col("canonical_id").alias("id"), F.explode(_views("text")).alias("v")).filter("v.view <> 'code'")
    codes = canonical.filter(F.col("code").isNotNull()).select(F.col("canonical_id").alias("id"), F.struct(F.lit("code").alias("view"), F.array(F.concat(F.lit("#"), F.lower("code"))).alias("tokens")).alias("v")).distinct()
    right = listed.unionByName(codes)
    left = values.select(F.col("value").alias("id"), F.explode(_views("value")).alias("v"))
    bound = F.create_map(*[x for view, t in least.items() for x in (F.lit(view), F.lit(float(t)))])
    sets = lambda df: df.select("id", F.col("v.view").alias("kind"), bound[F.col("v.view")].alias("least"), F.col("v.tokens").alias("tokens"))
    found = similar_sets(sets(left), sets(right)).withColumnRenamed("kind", "view")
    # a code counts as certain only where the name does not speak for another record
    score = F.when(F.col("view") == "code", F.lit(0.85)).when(F.col("view") == "stem", F.col("jaccard") * 0.95).when(F.col("view") == "letters", F.col("jaccard") * 0.8).otherwise(F.col("jaccard"))
    ranked = found.groupBy(F.col("left_id").alias("value"), "right_id").agg(F.max(score).alias("score"), F.sum(score).alias("total"))
    # the best with the smallest and with the largest id differ where several are equally good
    up, down = F.max(F.struct("score", "total", "right_id")), F.min(F.struct((-F.col("score")).alias("s"), (-F.col("total")).alias("t"), "right_id"))
    best = ranked.groupBy("value").agg(up.alias("up"), down.alias("down"))
    best = best.select("value", F.when(F.col("up.right_id") == F.col("down.right_id"), F.col("up.right_id")).otherwise(F.lit("")).alias("canonical_id"), F.col("up.score").alias("score"))
    return salted_lookup(rows, best, ["value"], "row_key", "left").select("row_key", "value", F.coalesce("canonical_id", F.lit("")).alias("canonical_id"), "score")
