"""Benchmark decontamination with SimHash fingerprints of item-sized windows.

Texts and items are lower-cased and split into words of letters and digits. An item of L words is compared with the
windows of L words of each text (the whole text where it is shorter). Windows and items get a 64-bit SimHash over
their shingles of ``SHINGLE`` words (fewer words: the whole sequence), each weighted by its inverse frequency among
the items. The 64 bits are four blocks; an index of each block of the items holds every value within
``RADIUS // 4`` bits, so that, by the pigeonhole principle, every fingerprint within ``RADIUS`` is found. What is
found is verified on full sets: weighted Jaccard similarity of at least ``threshold``. Only windows that hold some
shingle of the items are looked up; the others have similarity 0 with each item.

The items are the stated query set. They are taken in blocks of about ``block_items``, so what a task holds is
bounded however many there are; each block passes over the texts without a shuffle.

Weights are taken over all items, whatever block they are in. Only shingles of several items come to the driver for that.

Defined results: a null or empty text matches nothing and is kept, as does a text of which no word is left; a null
or empty item matches nothing; an item without an id matches as a null in the list; a null doc_id is kept as null; repeated rows each give a row; empty tables give no
rows or no matches. An item id that stands twice is named once for a text. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import textkit as tk
from tidelog.llm.cluster import documents, ship, table, text_of

SHINGLE = 5
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
BLOCK_ITEMS = 1024
THRESHOLD = 0.8


def _ball(radius: int) -> np.ndarray:
    """The block values within radius bits of 0."""
    bits = [1 << i for i in range(BLOCK_BITS)]
    return np.array([sum(c) for r in range(radius + 1) for c in combinations(bits, r)], np.int64)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of a fresh mix of the shingles."""
    bits = np.unpackbits(tk.mix(shingles + tk.U(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int64) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).reshape(-1, 8).copy().view(np.uint64).ravel()


class Items:
    """An index of benchmark items: their shingles, weights and fingerprints in multi-index blocks."""

    def __init__(self, ids: list[int | None], texts: list[str], total: int, common: dict[int, int], shingle: int = SHINGLE, radius: int = RADIUS):
        """total: number of all items; common: how many items hold a shingle, of those that several do."""
        column = pa.array([t.encode() for t in texts], pa.binary())
        data, offs = tk.buffers(column)
        hashes, owner, _, _ = tk.words(data, offs, lower=True, alphabet=tk.ALNUM)
        self.ids, self.shingle, self.radius = ids, shingle, radius
        self.length = np.bincount(owner, minlength=len(ids))
        made, owner = tk.shingles(hashes, owner, len(ids), shingle)
        values, bounds = tk.distinct(made, owner, len(ids))
        self.sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.known = np.unique(values)
        counts = np.array([common.get(int(v), 1) for v in self.known.view(np.int64)], np.float64)
        self.weight = np.round(1000 * np.log1p(total / counts)).astype(np.int64)
        self.unknown = int(round(1000 * np.log1p(total)))
        sums = np.zeros((len(ids), 64), np.int64)
        np.add.at(sums, owner, _signs(made) * self.weights(made)[:, None])
        self.print = _packed(sums)
        by = np.repeat(np.arange(len(ids)), np.diff(bounds))
        order = np.argsort(values, kind="stable")
        self.shingle_sorted, self.shingle_item = values[order], by[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.known & tk.U((1 << 20) - 1)).astype(np.int64)] = True
        near = _ball(radius // BLOCKS)
        live = np.flatnonzero(self.length)
        self.tables = []
        for b in range(BLOCKS):
            own = (self.print[live] >> tk.U(BLOCK_BITS * b)).astype(np.int64) & 0xFFFF
            value, item = (own[:, None] ^ near[None, :]).ravel(), np.repeat(live, len(near))
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1)), item[order].astype(np.int32)))

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(shingles), self.unknown)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.weight[at], self.unknown)

    def near(self, prints: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius whose item has the window's length."""
        window, item = [], []
        for b, (firsts, items) in enumerate(self.tables):
            value = (prints >> tk.U(BLOCK_BITS * b)).astype(np.int64) & 0xFFFF
            n = firsts[value + 1] - firsts[value]
            w = np.repeat(np.arange(len(prints)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(firsts[value], n)
            i = items[at]
            same = self.length[i] == lengths[w]
            window.append(w[same])
            item.append(i[same].astype(np.int64))
        pairs = np.unique(np.concatenate(window) * (len(self.ids) + 1) + np.concatenate(item))
        window, item = pairs // (len(self.ids) + 1), pairs % (len(self.ids) + 1)
        apart = np.bitwise_count(prints[window] ^ self.print[item])
        near = apart <= self.radius
        return window[near], item[near], apart[near]

    def matches(self, words: np.ndarray, threshold: float) -> list[int]:
        """Places in ids of the items that one text, given as word hashes, holds."""
        n, k = len(words), self.shingle
        found: set[int] = set()
        everywhere, _ = tk.shingles(words, np.zeros(n, np.int64), 1, k)
        # texts and items of k words or more share k-word shingles; shorter items are looked up by their own size
        by_length: dict[int, np.ndarray] = {}
        for size in {min(k, int(length)) for length in np.unique(self.length) if length}:
            made = tk.grams(words, size) if size < k and size <= n else everywhere
            at = np.flatnonzero(self.seen[(made & tk.U((1 << 20) - 1)).astype(np.int64)]) if size == k else np.arange(len(made))
            lo, hi = np.searchsorted(self.shingle_sorted, made[at], "left"), np.searchsorted(self.shingle_sorted, made[at], "right")
            for place, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for length in {int(x) for x in self.length[self.shingle_item[a:b]] if min(k, x) == size}:
                    span = max(1, min(length, n) - size + 1)
                    marks = by_length.setdefault(length, np.zeros(max(1, n - length + 1), bool))
                    marks[max(0, place - span + 1) : place + 1] = True
        for length, marks in by_length.items():
            size = min(k, length)
            made = tk.grams(words, size) if size < k and size <= n else everywhere
            starts = np.flatnonzero(marks)
            span = max(1, min(length, n) - size + 1)
            lo, hi = starts.min(), min(len(made), starts.max() + span)
            sums = np.zeros((hi - lo + 1, 64), np.int64)
            np.cumsum(_signs(made[lo:hi]) * self.weights(made[lo:hi])[:, None], axis=0, out=sums[1:])
            ends = np.minimum(starts + span, len(made))
            prints = _packed(sums[ends - lo] - sums[starts - lo])
            window, item, apart = self.near(prints, np.full(len(starts), length))
            for j in np.lexsort((window, apart)):
                i = int(item[j])
                if i not in found and self.similar(made[starts[window[j]] : ends[window[j]]], i, threshold):
                    found.add(i)
        return sorted(found)

    def similar(self, shingles: np.ndarray, item: int, threshold: float) -> bool:
        own, other = np.unique(shingles), self.sets[item]
        both = self.weights(np.intersect1d(own, other, assume_unique=True)).sum()
        union = self.weights(own).sum() + self.weights(other).sum() - both
        return bool(both >= threshold * union - 1e-9 * union)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS, found: str = "item_ids") -> DataFrame:
    """docs with one more column: the ids, ascending, of the items that each text holds."""
    ship(docs.sparkSession)
    names, n = docs.columns, len(docs.columns)
    texts = [i for i, c in enumerate(names) if c == "text"]
    plain = docs.toDF(*(f"c{i}" for i in range(n)))
    out = plain.withColumns({"t": text_of(f"c{texts[0]}"), "i": F.array().cast("array<long>")})
    schema = out.schema
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    total = items.count()
    common = dict(items.select("text").mapInArrow(_shingled, "shingle long").groupBy("shingle").count().where("count > 1").collect())
    blocks = max(1, -(-total // block_items))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        ids, own = [r["item_id"] for r in rows], [r["text"] for r in rows]
        out = out.mapInArrow(_scan(ids, own, total, common, threshold, schema), schema)
    out = out.withColumn("i", F.array_sort(F.array_distinct("i")))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("i").alias(found))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each item."""
    for batch in batches:
        for a, b, data, offs in tk.pieces(batch.column(0)):
            hashes, owner, _, _ = tk.words(data, offs, lower=True, alphabet=tk.ALNUM)
            values, _ = tk.distinct(*tk.shingles(hashes, owner, b - a, SHINGLE), b - a)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["shingle"])


@lru_cache(2)
def _index(ids: tuple, own: tuple[str, ...], total: int, common: tuple) -> Items:
    """Built once per worker and block."""
    return Items(list(ids), list(own), total, dict(common))


def _scan(ids: list, own: list[str], total: int, common: dict[int, int], threshold: float, schema: T.StructType):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(tuple(ids), tuple(own), total, tuple(common.items()))
        for batch in batches:
            at = batch.schema.get_field_index("t")
            lists = batch.column(at + 1).to_pylist()
            for a, b, data, offs in tk.pieces(batch.column(at)):
                hashes, owner, _, _ = tk.words(data, offs, lower=True, alphabet=tk.ALNUM)
                for d, lo, hi in _places(index, hashes, owner, b - a):
                    lists[a + d] = [*lists[a + d], *(index.ids[i] for i in index.matches(hashes[lo:hi], threshold))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + 1], pa.array(lists, pa.list_(pa.int64()))], names=batch.schema.names)

    return scan


def _places(index: Items, hashes: np.ndarray, owner: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(text, first word, end word) of the texts that hold a shingle of some item, or could hold a short item."""
    bounds = np.searchsorted(owner, np.arange(n + 1))
    some = np.diff(bounds) < index.shingle
    if len(index.length) and index.length[index.length > 0].size and index.length[index.length > 0].min() < index.shingle:
        some[:] = True
    made = tk.grams(hashes, index.shingle)
    hit = np.flatnonzero(index.seen[(made & tk.U((1 << 20) - 1)).astype(np.int64)])
    if len(hit) and len(index.known):
        at = np.minimum(np.searchsorted(index.known, made[hit]), len(index.known) - 1)
        hit = hit[index.known[at] == made[hit]]
        some[owner[hit]] = True
    some &= np.diff(bounds) > 0
    for d in np.flatnonzero(some).tolist():
        yield d, int(bounds[d]), int(bounds[d + 1])


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with docs' own columns."""
    names, found = docs.columns, "item_ids"
    while found in names:
        found += "_"
    return contamination(docs, benchmark, threshold, found=found).where(F.size(found) == 0).select(names)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: the benchmark items that it holds, and whether it holds none."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_ids", (F.size("item_ids") > 0).alias("contaminated"), (F.size("item_ids") == 0).alias("kept"))


QUERIES = {"op9_decontamination": op9_decontamination}
