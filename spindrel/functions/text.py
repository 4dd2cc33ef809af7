"""Text expressions of the directory queries; all stay in Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: words that end or void a suggested phrase ----
PHRASE_STOPWORDS = (
    "the a an of and or for to in on at with by using used use based via from into over under new novel study studies analysis approach approaches "
    "effect effects role review toward towards between their its this that these those as is are be we our"
).split()


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends, not blanks only."""
    return F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def or_default(c: Column, default: str) -> Column:
    """The stripped text, or the default where nothing is left."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def full_name(first: Column, last: Column) -> Column:
    """The parts that are not empty, with single blanks."""
    return strip(F.regexp_replace(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))), r"(?U)\s+", " "))


def mailbox(email: Column, bare: str = "whole") -> Column:
    """The part before @ in lower case. Without @: the whole text, '' or null (`bare` = whole, empty, null)."""
    local = F.lower(strip(F.substring_index(email, "@", 1)))
    without = {"whole": local, "empty": F.lit(""), "null": F.lit(None).cast("string")}[bare]
    return F.when(F.contains(email, F.lit("@")), local).otherwise(F.when(email.isNotNull(), without))


def tokens(c: Column, least: int = 2) -> Column:
    """Runs of letters, digits and hyphens in lower case, at least `least` long."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}-]+"), lambda t: F.length(t) >= least)


def ascii_words(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda t: t != "")


def holds(c: Column, part: str) -> Column:
    """Literal, case-insensitive containment; null holds nothing."""
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))


def all_tokens_in_any(query: str, columns: list[Column]) -> Column:
    """Every blank-separated token of the query is contained in at least one of the columns."""
    parts = [t for t in query.lower().split() if t]
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [holds(c, t) for c in columns]) for t in parts], F.lit(True))


def word_in(c: Column, word: str) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(rf"(?i)\b\Q{word}\E\b")), F.lit(False))


def synthetic_key(title: Column, year: Column) -> Column:
    """A stable key of a work known by title and year only."""
    return F.concat(F.lit("scholar_"), F.substring(F.md5(F.concat(F.lower(strip(F.coalesce(title, F.lit("")))), F.lit("_"), F.coalesce(year.cast("string"), F.lit("")))), 1, 16))


def doi(url: Column) -> Column:
    """What follows doi.org/ (any host that starts with doi.), or null."""
    return F.nullif(F.regexp_extract(url, r"(?i)doi\.[a-z]+/(.+)", 1), F.lit(""))


def title_fits(wanted: Column, offered: Column, share: float = 0.6) -> Column:
    """At least `share` of the wanted title's words longer than three letters are contained in the offered one; without such words it fits."""
    long = F.filter(F.split(F.lower(wanted), r"\s+"), lambda w: F.length(w) > 3)
    met = F.size(F.filter(long, lambda w: F.contains(F.lower(offered), w)))
    return F.when(F.size(long) == 0, F.lit(True)).otherwise(met / F.nullif(F.size(long), F.lit(0)) >= share)


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"</?[^>]+(>|$)", "")


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def first_given(values: Column) -> Column:
    """The first element that is not blank, as stored."""
    return F.get(F.filter(values, lambda x: F.length(F.trim(x)) > 0), F.lit(0))


def listed_once(buckets: list[Column], limit: int = 8) -> Column:
    """Values of several arrays in order, stripped, each once whatever its letter case (first spelling stays), at most `limit`."""
    values = F.filter(F.transform(F.flatten(F.array(*[F.coalesce(b, F.array().cast("array<string>")) for b in buckets])), strip), lambda x: x != "")
    keys = F.transform(values, F.lower)
    # the position of a value's first spelling is its own only for that spelling
    firsts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1))), lambda i: F.array_position(keys, F.get(keys, i - 1)) == i)
    return F.slice(F.transform(firsts, lambda i: F.get(values, i - 1)), 1, limit)
