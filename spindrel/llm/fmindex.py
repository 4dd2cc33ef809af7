"""Evaluation passages inside corpus documents, by an FM-index per shard of the corpus.

A shard is a run of documents as sequences of word numbers, every word of every
document among them. Its suffixes are sorted once; the Burrows-Wheeler transform is
kept in a wavelet matrix of bits with counts per block, so a phrase is found by
backward search with two rank queries per word, and its occurrences by walking back
to sampled suffix positions. Shards are cut inside the tasks from bounded stretches
of text and stored as rows, so an index serves any number of item sets.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A word is a run of letters and digits; one broken by a hyphen and a line end is one word.
WORD = re.compile(r"[^\W_]+(?:-[^\S\r\n]*(?:\r\n|\r|\n)[^\S\r\n]*[^\W_]+)*")
BREAK = re.compile(r"-\s+")
#: Words of a shard; a single longer document is a shard of its own.
SHARD_WORDS = 400_000
#: Every SAMPLE-th text position keeps its suffix position.
SAMPLE = 8


def words(text: str) -> list[str]:
    """The words of a text in lower case, across line-end hyphens."""
    return [(BREAK.sub("", w) if "-" in w else w).lower() for w in WORD.findall(text)]


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each word of `words`, as character positions."""
    return [m.span() for m in WORD.finditer(text)]


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """The sorted suffixes of a sequence whose last symbol is the only 0, by prefix doubling from packed symbols."""
    n = len(symbols)
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(width):
        key <<= bits
        if i < n:
            key[: n - i] |= symbols[i:]
    order = np.argsort(key, kind="stable")
    rank, step = _ranks(key, order), width
    while rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        if step < n:
            second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank = _ranks(key, order)
        step *= 2
    return order


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return rank


class Bits:
    """A bit vector with rank: 64 bits a word and a running count per word, 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits.astype(bool), bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, position: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = position >> 6, (position & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.counts[word].astype(np.int64) + np.bitwise_count(below)

    def at(self, position: np.ndarray) -> np.ndarray:
        return (self.words[position >> 6] >> (position & 63).astype(np.uint64)).astype(np.int64) & 1


class WaveletMatrix:
    """Rank of a symbol in a prefix, for many queries at once."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels, self.zeros = bits, [], []
        current = symbols
        for b in range(bits - 1, -1, -1):
            bit = (current >> b) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros_like(position), position
        for level in range(self.bits):
            zeros = self.zeros[level]
            is_one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            both = self.levels[level].rank(np.concatenate([lo, hi]))
            a, b = both[: len(lo)], both[len(lo) :]
            lo, hi = np.where(is_one, zeros + a, lo - a), np.where(is_one, zeros + b, hi - b)
        return hi - lo

    def at(self, position: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        symbol = np.zeros_like(position)
        for level in range(self.bits):
            bit, before = self.levels[level].at(position), self.levels[level].rank(position)
            symbol = symbol * 2 + bit
            position = np.where(bit == 1, self.zeros[level] + before, position - before)
        return symbol


class FMIndex:
    """Count and locate phrases in a sequence of positive word numbers."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        bits = max(1, int(n_symbols).bit_length())
        suffixes = suffix_array(text, bits)
        bwt = text[suffixes - 1]  # position -1 is the final 0
        self.size = len(text)
        self.tree = WaveletMatrix(bwt, bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))]).astype(np.int64)
        sampled = suffixes % SAMPLE == 0
        self.marked = Bits(sampled)
        self.samples = suffixes[sampled].astype(np.int32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases, one per row, all of one length."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k]
            start = self.before[symbol]
            lo, hi = start + self.tree.rank(symbol, lo), start + self.tree.rank(symbol, hi)
            keep = hi > lo
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if not len(alive):
                break
        low[alive], high[alive] = lo, hi
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back until a sampled one."""
        position, steps = rows.copy(), np.zeros_like(rows)
        walking = np.flatnonzero(self.marked.at(position) == 0)
        while len(walking):
            p = position[walking]
            symbol = self.tree.at(p)
            position[walking] = self.before[symbol] + self.tree.rank(symbol, p)
            steps[walking] += 1
            walking = walking[self.marked.at(position[walking]) == 0]
        return self.samples[self.marked.rank(position)] + steps


class Shard:
    """The FM-index of a run of documents, with its own words and the place of each document."""

    def __init__(self, docs: list[int], texts: list[list[str]]) -> None:
        self.words: dict[str, int] = {}
        number = self.words.setdefault
        parts = []
        for found in texts:
            parts += [number(w, len(self.words) + 2) for w in found]
            parts.append(1)  # parts documents
        self.docs = np.array(docs, np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
        self.index = FMIndex(np.array(parts, np.int64), len(self.words) + 1)

    def stored(self) -> bytes:
        """The shard as plain arrays."""
        i = self.index
        bits = lambda b: (b.words, b.counts)
        plain = (list(self.words), self.docs, self.starts, i.size, i.before, bits(i.marked), i.samples, i.tree.zeros, [bits(b) for b in i.tree.levels])
        return pickle.dumps(plain, protocol=5)

    @classmethod
    def read(cls, stored: bytes) -> Shard:
        found, docs, starts, size, before, marked, samples, zeros, levels = pickle.loads(stored)  # noqa: S301 - written by `stored`

        def bits(parts: tuple) -> Bits:
            b = Bits.__new__(Bits)
            b.words, b.counts = parts
            return b

        tree = WaveletMatrix.__new__(WaveletMatrix)
        tree.bits, tree.zeros, tree.levels = len(levels), zeros, [bits(b) for b in levels]
        index = FMIndex.__new__(FMIndex)
        index.size, index.before, index.marked, index.samples, index.tree = size, before, bits(marked), samples, tree
        shard = cls.__new__(cls)
        shard.words, shard.docs, shard.starts, shard.index = {w: k + 2 for k, w in enumerate(found)}, docs, starts, index
        return shard

    def find(self, items: list[tuple[int, list[str]]], least: int) -> tuple[list, list, list, list]:
        """Stretches (doc, item, start, length) that repeat at least `least` words of an item in a row."""
        phrases: dict[tuple[int, ...], set[int]] = {}
        for item, found in items:
            ids = [self.words.get(w, 0) for w in found]
            gap = -1  # the last word the shard does not have
            for i, x in enumerate(ids):
                if not x:
                    gap = i
                elif i - gap >= least:
                    phrases.setdefault(tuple(ids[i - least + 1 : i + 1]), set()).add(item)
        if not phrases:
            return [], [], [], []
        table, owners = np.array(list(phrases), np.int64), [sorted(x) for x in phrases.values()]
        lo, hi = self.index.search(table)
        counts = hi - lo
        hit = np.flatnonzero(counts)
        if not len(hit):
            return [], [], [], []
        which = np.repeat(hit, counts[hit])
        rows = np.repeat(lo[hit], counts[hit]) + np.arange(counts[hit].sum()) - np.repeat(np.cumsum(counts[hit]) - counts[hit], counts[hit])
        positions = self.index.locate(rows)
        place = np.searchsorted(self.starts, positions, "right") - 1
        found_at: dict[tuple[int, int], list[int]] = {}
        for phrase, s, p in zip(which.tolist(), place.tolist(), (positions - self.starts[place]).tolist()):
            for item in owners[phrase]:
                found_at.setdefault((s, item), []).append(p)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for (s, item), at in found_at.items():
            at.sort()
            begin = end = at[0]
            for p in [*at[1:], None]:
                if p is not None and p <= end + least:
                    end = p
                    continue
                for column, value in zip(out, (int(self.docs[s]), item, begin, end + least - begin)):
                    column.append(value)
                begin = end = p
        return out


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index of a corpus: shard (bytes), n_docs, n_words; one row per shard of about `shard_words` words, every word of every text in one of them.

    Null and empty texts have no words; a text longer than a shard is one of its
    own; repeated ids and equal texts are all indexed; an empty table gives no rows.
    No shuffle: shards are cut from the scan's own partitions. Store the result to
    search it again with other items.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        texts: list[list[str]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([Shard(docs, texts).stored()], pa.binary()), pa.array([len(docs)], pa.int32()), pa.array([held], pa.int64())], ["shard", "n_docs", "n_words"])

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(body.as_py() or "")
                if not found or key is None:
                    continue
                docs.append(key)
                texts.append(found)
                held += len(found)
                if held >= shard_words:
                    yield flush()
                    docs, texts, held = [], [], 0
        if docs:
            yield flush()

    chosen = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(shards, "shard binary, n_docs int, n_words bigint")


#: Items that are sent to a shard at once.
ITEM_BATCH = 2000


def search_index(index: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """Each stretch of an indexed document that repeats at least `least` consecutive words of an item: doc_id, item_id, start, length (in words, from 0).

    Items (item_id bigint, text) meet the shards in blocks of ITEM_BATCH, gathered
    by a hash; every block goes to every shard, as a stated query set against all
    rows. Blocks are joined, nothing is collected. Overlapping occurrences of one
    item are merged. An item of fewer than `least` words cannot occur.
    """
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.length("text") > 0).distinct()
    n = asked.agg(F.ceil(F.count(F.lit(1)) / ITEM_BATCH).alias("n"))
    blocks = asked.crossJoin(F.broadcast(n)).groupBy(F.pmod(F.xxhash64("item_id"), F.col("n")).alias("block")).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, Shard] | None = None
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for stored, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                data = stored.as_py()
                if last is None or last[0] != data:
                    last = (data, Shard.read(data))
                found = last[1].find([(x["item_id"], words(x["text"])) for x in wanted], least)
                for column, values in zip(out, found):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "start", "length"])

    return index.select("shard").crossJoin(blocks.select("items")).mapInArrow(run, "doc_id bigint, item_id bigint, start int, length int")


def matches(documents: DataFrame, items: DataFrame, least: int = 12, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """`search_index` over a freshly built index, which is stored in the shared folder for the time of the query."""
    return search_index(cut(build_index(documents, doc_id, text, shard_words)), items, least)


def removal_spans(documents: DataFrame, found: DataFrame) -> DataFrame:
    """What to cut out of each document: doc_id, start_pos, end_pos (1-based characters, both included), n_items; touching stretches of different items are merged.

    found: the result of `matches`. A document id that occurs in several rows of
    documents is expected to carry one text. Positions refer to the text as stored.
    """
    per_doc = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "length", "item_id")).alias("hits"))
    schema = "doc_id bigint, start_pos int, end_pos int, n_items int"

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, hits in zip(*(batch.column(i).to_pylist() for i in range(3))):
                places = word_spans(text)
                end, items = None, set()
                for h in sorted(hits, key=lambda h: (h["start"], h["length"], h["item_id"])):
                    last = h["start"] + h["length"] - 1
                    if end is None or h["start"] > end + 1:
                        if end is not None:
                            rows.append((doc, places[begin][0] + 1, places[end][1], len(items)))
                        begin, end, items = h["start"], last, set()
                    end = max(end, last)
                    items.add(h["item_id"])
                if end is not None:
                    rows.append((doc, places[begin][0] + 1, places[end][1], len(items)))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "start_pos", "end_pos", "n_items"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    return texts.join(per_doc, "doc_id").select("doc_id", "text", "hits").mapInArrow(spans, schema)
