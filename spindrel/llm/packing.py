"""Filling containers of fixed capacity: conflict-constrained best fit.

Texts are measured in tokens, cut only if they exceed the capacity, and spread
over shards by a hash. Within a shard, items go from the largest to the smallest
into the tightest open container that has room and no conflict. Containers are
ordered by residual space; each carries a bitmap of the sources in it and one of
the duplicate clusters in it, and the search goes on to the next larger residual
while the bitmaps forbid a container. A cluster is the texts that are equal in
letters and digits; sources that largely mirror each other, as found in the data,
are kept apart too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold_array
from ..session import cut

#: Tokens a shard holds about; bounds the memory of a task and the search.
SHARD_TOKENS = 2_000_000
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

def token_counts(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens of the whole text (0 for null and empty ones), source, and cluster (a number of the letters and digits of the text, or of the text if it has none). Batches are small so that very long texts fit. The tokenizer's file must be found under one path on every executor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = loaded.get(tokenizer)
        if t is None:
            t = Tokenizer.from_file(tokenizer)
            t.encode_special_tokens = True
            loaded[tokenizer] = t
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            forms = fold_array(pa.array(texts, pa.string())).to_pylist()
            clusters = [int.from_bytes(hashlib.blake2b((f or x).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for f, x in zip(forms, texts)]
            sizes: list[int] = []
            for i in range(0, len(texts), 64):
                sizes += [len(e.ids) for e in t.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), batch.column(2), pa.array(clusters, pa.int64())], ["doc_id", "n_tokens", "source", "cluster"])

    loaded: dict[str, object] = {}  # one tokenizer per task
    chosen = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    return chosen.mapInArrow(count, "doc_id bigint, n_tokens int, source string, cluster bigint")


class Shelf:
    """Open containers by residual space; finds the tightest one that is compatible."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_residual: dict[int, list[int]] = {}
        self.present = 0  # bit r: some container has residual r
        self.sources: list[int] = []
        self.clusters: list[int] = []  # a bit per duplicate cluster of the shard
        self.residual: list[int] = []

    def _add(self, container: int, residual: int) -> None:
        self.residual[container] = residual
        if residual:
            self.by_residual.setdefault(residual, []).append(container)
            self.present |= 1 << residual

    def _remove(self, container: int, place: int) -> None:
        residual = self.residual[container]
        row = self.by_residual[residual]
        row[place] = row[-1]
        row.pop()
        if not row:
            del self.by_residual[residual]
            self.present &= ~(1 << residual)

    def put(self, size: int, source_bit: int, forbidden: int, cluster: int, start: int) -> tuple[int, int, int]:
        """Place one item; returns container, offset within it, and the residual where the search ended.

        `start`: no container with less residual can take the item (used for runs of one duplicate cluster, whose earlier containers all hold it).
        """
        at = max(size, start)
        while True:
            rest = self.present >> at
            if not rest:
                break
            at += (rest & -rest).bit_length() - 1
            row = self.by_residual[at]
            for place in range(len(row) - 1, -1, -1):
                c = row[place]
                if self.sources[c] & forbidden or self.clusters[c] & cluster:
                    continue
                self._remove(c, place)
                offset = self.capacity - at
                self._note(c, source_bit, cluster)
                self._add(c, at - size)
                return c, offset, at
            at += 1
        c = len(self.residual)
        self.sources.append(0)
        self.clusters.append(0)
        self.residual.append(self.capacity)
        self._note(c, source_bit, cluster)
        self._add(c, self.capacity - size)
        return c, 0, self.capacity

    def _note(self, container: int, source_bit: int, cluster: int) -> None:
        self.sources[container] |= source_bit
        self.clusters[container] |= cluster


def pack_shard(items: pd.DataFrame, capacity: int, apart: list[tuple[str, str]]) -> pd.DataFrame:
    """Pack (doc_id, piece, size, source, cluster) of one shard; adds container and place (the offset in tokens)."""
    names = sorted(set(items["source"]))
    bit = {s: 1 << i for i, s in enumerate(names)}
    forbidden = {s: 0 for s in names}
    for a, b in apart:
        if a in bit and b in bit:
            forbidden[a] |= bit[b]
            forbidden[b] |= bit[a]
    # only clusters with several items can conflict; each of them is a bit
    several = items["cluster"][items["cluster"].duplicated(keep=False)].unique()
    cluster_bit = {c: 1 << k for k, c in enumerate(sorted(several))}
    ordered = items.sort_values(["size", "cluster", "source", "doc_id", "piece"], ascending=[False, True, True, True, True], kind="stable")
    shelf = Shelf(capacity)
    containers, places = np.zeros(len(ordered), np.int64), np.zeros(len(ordered), np.int64)
    last, start = None, 0
    for k, (size, source, cluster) in enumerate(zip(ordered["size"].tolist(), ordered["source"].tolist(), ordered["cluster"].tolist())):
        run = (size, source, cluster)
        start = start if run == last else 0
        containers[k], places[k], start = shelf.put(size, bit[source], forbidden[source], cluster_bit.get(cluster, 0), start)
        last = run
    return ordered.assign(container=containers, place=places)


def mirrors(sized: DataFrame, share: float = 0.5) -> DataFrame:
    """Pairs of sources (a < b) that mirror each other: at least `share` of the clusters of one of them are in the other too."""
    each = sized.select("source", "cluster").distinct()
    size = each.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    both = each.groupBy("cluster").agg(F.array_sort(F.collect_set("source")).alias("s")).filter(F.size("s") > 1)
    pairs = both.select("s", F.explode("s").alias("a")).select("a", F.explode(F.filter("s", lambda x: x > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    least = F.least(F.col("na"), F.col("nb"))
    return pairs.join(size.select(F.col("source").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("source").alias("b"), F.col("n").alias("nb")), "b").filter(F.col("shared") >= share * least).select("a", "b")


#: Pairs of mirroring sources that are kept apart; more than so many are an error, since every task holds them.
MOST_PAIRS = 10_000


def pack(documents: DataFrame, capacity: int = 2048, tokenizer: str = DEFAULT_TOKENIZER, apart: tuple[tuple[str, str], ...] | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Every text's container and place: doc_id, piece, n_pieces, n_tokens (of the piece), container_id, place (first token's offset in the container), source, cluster.

    A text of at most `capacity` tokens is never cut; a longer one becomes pieces of
    exactly `capacity` and a rest. No container holds two texts of one duplicate
    cluster, nor texts of two sources named in `apart`; if it is not given, of
    sources that mirror each other. Null and empty texts have no tokens and get no container. Repeated ids
    are packed as often as they occur; an empty table gives no rows.

    Shards are cut by a hash of the id, as many as the tokens need, so each is
    bounded; a cluster with a third of all rows is spread over all of them. In a
    shard only the last few containers stay open, so the unused space per shard is
    bounded too.
    """
    sized = cut(token_counts(documents, tokenizer).filter("n_tokens > 0"))
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_tokens))
    full = F.lit(capacity)
    pieces = (
        sized.withColumn("n_pieces", F.ceil(F.col("n_tokens") / full).cast("int"))
        .withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
        .withColumn("size", F.when(F.col("piece") < F.col("n_pieces"), full).otherwise(F.col("n_tokens") - (F.col("n_pieces") - 1) * full).cast("int"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
        .select("shard", "doc_id", "piece", "n_pieces", "size", "source", "cluster")
    )
    if apart is None:
        found = [(x["a"], x["b"]) for x in mirrors(sized).limit(MOST_PAIRS + 1).collect()]
        if len(found) > MOST_PAIRS:
            raise ValueError("too many sources mirror each other; name those to keep apart")
        apart = tuple(found)
    apart_ = list(apart)

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(items, capacity, apart_)
        out["container_id"] = out["container"] * shards + int(key[0])
        return out[["doc_id", "piece", "n_pieces", "size", "container_id", "place", "source", "cluster"]]

    packed = pieces.groupBy("shard").applyInPandas(run, "doc_id bigint, piece int, n_pieces int, size int, container_id bigint, place int, source string, cluster bigint")
    return packed.withColumnRenamed("size", "n_tokens")


def audit(packed: DataFrame, capacity: int) -> DataFrame:
    """One row that proves a packing: containers and the least that could hold the tokens, mean fill, and how many containers are overfull, hold a cluster twice, or have pieces that overlap or leave gaps, and how many texts are split though they would fit."""
    per = packed.groupBy("container_id").agg(
        F.sum("n_tokens").alias("used"), (F.count(F.lit(1)) - F.countDistinct("cluster")).alias("again"), F.countDistinct(F.when(F.col("n_pieces") > 1, F.col("doc_id"))).alias("cut"), F.array_sort(F.collect_list(F.struct("place", "n_tokens"))).alias("laid")
    )
    # what lies first begins at 0, and each next one where the last one ends
    ends = F.aggregate("laid", F.lit(0), lambda at, x: F.when(x["place"] == at, at + x["n_tokens"]).otherwise(F.lit(-1)))
    texts = packed.groupBy("doc_id").agg(F.max("n_pieces").alias("n"), F.sum("n_tokens").alias("all")).agg(F.count_if((F.col("n") > 1) & (F.col("all") <= capacity)).alias("n_split"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.ceil(F.sum("used") / capacity).alias("least_containers"), F.round(F.avg("used") / capacity, 6).alias("mean_fill"),
        F.count_if(F.col("used") > capacity).alias("n_overfull"), F.count_if((F.col("again") > 0) & (F.col("cut") == 0)).alias("n_conflicts"), F.count_if(ends != F.col("used")).alias("n_misplaced"),
    ).crossJoin(texts)
