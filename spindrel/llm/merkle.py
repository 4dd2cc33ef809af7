"""Duplicates hidden by formatting: bottom-up hashing of nested records.

A record is described as a tree. Leaves are normalised values, an ordered node
keeps the order of its children, an unordered node sorts their digests first, so
records that differ in field order, letter case, white space or punctuation get
the same root digest. Rows are grouped by root digest; only groups with more than
one row are compared in full, by their canonical form.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold, fold_each
from ..operators.skew import salted_lookup
from ..session import cut

NULL = "\x00"


@dataclass
class Text:
    """A text column: letters and digits only, in any letter case and Unicode form."""

    column: str


@dataclass
class Exact:
    """A value compared as it is; null equals null."""

    column: str


@dataclass
class Folded:
    """A text column that holds the letters and digits of a Text already; with `bag`, an array of them in any order."""

    column: str
    bag: bool = False


@dataclass
class TextBag:
    """An array column of texts in any order, each normalised as Text."""

    column: Column | str


@dataclass
class Ordered:
    children: list = field(default_factory=list)


@dataclass
class Unordered:
    children: list = field(default_factory=list)


def _sealed(tag: str, value: Column) -> Column:
    """A leaf with its kind; a null differs from any text."""
    return F.concat(F.lit(tag), F.coalesce(value, F.lit(NULL)))


def folded_once(tree, taken: list[Column]):
    """The tree over columns folded beforehand, which are added to `taken`; so no text is folded twice for form and digest."""
    if isinstance(tree, (Text, TextBag)):
        name, bag = f"_leaf{len(taken)}", isinstance(tree, TextBag)
        column = F.col(tree.column) if isinstance(tree.column, str) else tree.column
        taken.append((fold_each(column) if bag else fold(column)).alias(name))
        return Folded(name, bag)
    if isinstance(tree, Exact):
        name = f"_leaf{len(taken)}"
        taken.append(F.col(tree.column).cast("string").alias(name))
        return Exact(name)
    return type(tree)([folded_once(x, taken) for x in tree.children])


def keyed_rows(rows: DataFrame, key: str, tree) -> DataFrame:
    """_key, _root (the digest of the tree) and _form (its canonical form) of every row with a key."""
    taken: list[Column] = []
    own = folded_once(tree, taken)
    return rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *taken).select("_key", _digest(own).alias("_root"), _form(own).alias("_form"))


def _form(node) -> Column:
    """The canonical form of a node, readable text whose parts are length-prefixed so that it can't be ambiguous."""
    prefixed = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    if isinstance(node, Exact):
        return _sealed("e", F.col(node.column))
    if isinstance(node, Folded) and not node.bag:
        return _sealed("t", F.col(node.column))
    if isinstance(node, Folded):
        items = F.transform(F.coalesce(node.column, F.array().cast("array<string>")), lambda x: prefixed(_sealed("t", x)))
        return F.concat(F.lit("b"), F.array_join(F.array_sort(items), ""))
    forms = F.array(*[prefixed(_form(x)) for x in node.children])
    return F.concat(F.lit("o"), F.array_join(forms, "")) if isinstance(node, Ordered) else F.concat(F.lit("u"), F.array_join(F.array_sort(forms), ""))


def _digest(node) -> Column:
    """Digest of a node from the digests of its children."""
    if isinstance(node, Exact) or (isinstance(node, Folded) and not node.bag):
        return F.md5(_form(node))
    if isinstance(node, Folded):
        leaves = F.transform(F.coalesce(node.column, F.array().cast("array<string>")), lambda x: F.md5(_sealed("t", x)))
        return F.md5(F.concat(F.lit("b"), F.array_join(F.array_sort(leaves), "")))
    below = F.array(*[_digest(x) for x in node.children])
    return F.md5(F.concat(F.lit("o" if isinstance(node, Ordered) else "u"), F.array_join(below if isinstance(node, Ordered) else F.array_sort(below), "")))


def copies(rows: DataFrame, key: str, tree) -> DataFrame:
    """Every row key that has equals, with its class: (first, copy) where first is the smallest key of the class and copy each other one.

    rows: any columns; key: a text column. Rows with a null key are left out, a
    key that occurs in several rows counts once (with each of its forms). An empty
    table gives an empty result, and so does one without equals. Texts of any
    length are folded whole; empty texts equal each other, nulls equal nulls.

    The first shuffle carries one digest and the smallest and largest key per
    digest and task, so a class with a third of all rows is combined on the map
    side; the rows of larger classes are compared by canonical form through a
    salted lookup of the class's first row.
    """
    keyed = keyed_rows(rows, key, tree)
    classes = cut(keyed.groupBy("_root").agg(F.min("_key").alias("_a"), F.max("_key").alias("_b"), F.count(F.lit(1)).alias("_n")).filter(F.col("_a") < F.col("_b")).select("_root", "_n"))
    shared = cut(salted_lookup(keyed, classes.select("_root"), ["_root"], "_key", counts=classes))
    # the full comparison: rows of one digest but another form are another class
    first = shared.groupBy("_root", "_form").agg(F.min("_key").alias("first"), F.max("_key").alias("_b"), F.count(F.lit(1)).alias("_n")).filter(F.col("first") < F.col("_b")).drop("_b")
    return (
        salted_lookup(shared, first.drop("_n"), ["_root", "_form"], "_key", counts=first.select("_root", "_form", "_n"))
        .filter(F.col("_key") != F.col("first"))
        .select("first", F.col("_key").alias("copy"))
        .distinct()
    )


def collapsed(rows: DataFrame, key: str, tree) -> DataFrame:
    """One record per class with its number of copies: (first, n_copies), classes of one included; keys count once."""
    keyed = keyed_rows(rows, key, tree).distinct()
    return keyed.groupBy("_root", "_form").agg(F.min("_key").alias("first"), F.count(F.lit(1)).alias("n_copies")).select("first", "n_copies")
