"""Joins against one row per key that hold even if one key carries a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above one row in so many (and above the floor), which bounds the number of hot keys and so the broadcast.
HOT_SHARE = 10_000
#: Rows of a hot key a piece holds about.
FLOOR = 20_000


def counts_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key: keys and _n, combined on the map side."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def hot_keys(counts: DataFrame, keys: list[str], floor: int = FLOOR) -> DataFrame:
    """The hot keys of `counts` (keys, _n) with the number of pieces each is cut into, in proportion to its rows.

    A key counts as hot above `floor` rows and above one row in HOT_SHARE of all, so
    there are fewer than HOT_SHARE of them at any size; what is below that share is
    left to the adaptive splitting of skewed partitions.
    """
    total = counts.agg(F.sum("_n").alias("_all"))
    line = F.greatest(F.lit(floor), F.col("_all") / HOT_SHARE)
    return counts.crossJoin(F.broadcast(total)).filter(F.col("_n") > line).select(*keys, F.ceil(F.col("_n") / line).cast("int").alias("_pieces"))


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str, how: str = "inner", floor: int = FLOOR, counts: DataFrame | None = None) -> DataFrame:
    """`rows` joined with `lookup`, which has at most one row per key.

    Rows of hot keys are spread over pieces by a hash of `spread`; only the lookup
    rows of hot keys are repeated. `counts` (keys, _n) spares counting where the
    rows per key are known. Null keys never match. Empty inputs give an empty
    result (for `how="left"`, the rows with nulls).
    """
    hot = F.broadcast(hot_keys(counts if counts is not None else counts_of(rows, keys), keys, floor))
    left = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_pieces")).cast("int"))).drop("_pieces")
    right = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
