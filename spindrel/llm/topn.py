"""Top N items within every group by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _changes(column: pa.Array) -> np.ndarray:
    """True where a row's value differs from the row before, in one batch; nulls equal nulls."""
    a, b = column[1:], column[:-1]
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    return differ | (nulls[1:] != nulls[:-1])


def first_of_each(group: list[str], n: int):
    """A function over sorted Arrow batches that lets the first n rows of each run of `group` through.

    It keeps the last group and its count between batches, never a group's rows.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            start = np.zeros(size, bool)
            for c in group:
                column = batch.column(c)
                start[1:] |= _changes(column)
            head = tuple(batch.column(c)[0].as_py() for c in group)
            carried = seen if last is not None and head == last else 0
            begins = np.flatnonzero(start)
            run_start = np.zeros(size, np.int64)
            run_start[begins] = begins
            run_start = np.maximum.accumulate(run_start)
            rank = np.arange(size) - run_start
            first_end = begins[0] if len(begins) else size
            rank[:first_end] += carried
            last = tuple(batch.column(c)[size - 1].as_py() for c in group)
            seen = int(rank[-1]) + 1
            keep = rank < n
            if keep.any():
                yield batch.filter(pa.array(keep))

    return stream


def top_n(rows: DataFrame, group: list[str], score: str, identifier: str, n: int) -> DataFrame:
    """The n rows of every group with the highest score, nulls last, ties by identifier ascending.

    Rows are sorted and cut to n per group inside each task first, so at most n
    rows per group and task are shuffled however large a group is; then they are
    hash-partitioned by group, sorted by score and identifier, and streamed again.
    Null group values form groups of their own; rows equal in score and identifier
    keep any order. An empty table gives an empty result; other columns pass.
    """
    order = [*group, F.col(score).desc_nulls_last(), F.col(identifier).asc_nulls_last()]
    cut = first_of_each(group, n)
    local = rows.sortWithinPartitions(*order).mapInArrow(cut, rows.schema)
    return local.repartition(*group).sortWithinPartitions(*order).mapInArrow(cut, rows.schema)


def latest(rows: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row per key: rows loaded twice count once, the one loaded last wins (then the larger values). Null keys are left out."""
    best = F.max(F.struct(F.col(at).alias("_at"), *columns)).alias("_r")
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_r.{c}") for c in columns])
