"""Removal of long repeated passages with run-length compressed Burrows-Wheeler indexes.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too, in the same text or another.

1. Where equal strings meet. Each ``length``-byte window has a minimizer, the 32-byte gram of least hash; equal windows
   have equal ones. Neighbouring windows with one minimizer are a stretch, whose ``length`` + k bytes are its span.
   Windows can be equal only if their stretches have the same anchor (the gram's hash), so anchors that stand once
   are done with, and so are spans that are equal as wholes: all their windows are repeated.
2. Where spans of one anchor differ, one copy of each goes to a bucket by anchor. A bucket joins its spans, builds
   the suffix array and the Burrows-Wheeler transform, and keeps it run-length compressed with samples at run ends:
   text position and length of the match with the neighbour suffix. Inside a run these lengths fall by one per
   position, so the samples are enough to stream the matching statistics of all positions; in repetitive texts there
   are few. A window that matches another place over ``length`` bytes or more is repeated.
3. Repeated windows go back to every stretch with that span and are joined to removed runs per text.

Nothing is gathered per anchor but the distinct spans, and of an anchor with more than ``HOT_SPANS`` of them (a
passage in very many surroundings) windows are counted by their hashes, spread over all tasks. Window, gram and span
equality is by 64-bit hashes of their bytes in steps 1 and 3 and for hot anchors; step 2 compares bytes.

Defined results: a null or empty text has 0 bytes and nothing removed; a null doc_id is kept; rows that repeat a text
repeat all its windows, also if they repeat the doc_id; a removed run may break a multi-byte character (kept bytes are
hashed, not decoded). An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import textkit as tk
from tidelog.llm.cluster import documents, release, saved, ship, text_of

LENGTH, GRAM = 200, 32
HOT_SPANS = 20_000
BUCKET_BYTES = 4 << 20
#: Bytes of texts hashed at once: each takes over a hundred bytes of memory.
PIECE = 1 << 18
STRETCHES = "row long, lo int, hi int, anchor long, span long"
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: minima up to and from the edges of blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def stretches(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, span) of each run of windows in one text with one minimizer."""
    n = len(data) - length + 1
    if n <= 0:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, tk.U), np.zeros(0, tk.U))
    prefix = tk.Sums(data, False)
    at = np.arange(len(data) - gram + 1)
    hashes = tk.spans(prefix, at, at + gram)
    bits = tk.U(int(len(at)).bit_length())
    place = (sliding_min((hashes >> bits << bits) | at.astype(tk.U), length - gram + 1)[:n] & ((tk.U(1) << bits) - tk.U(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    whole = np.arange(n) + length <= offs[text + 1]
    turn = np.ones(n + 1, bool)
    turn[1:-1] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    first, last = np.flatnonzero(turn[:-1] & whole), np.flatnonzero(turn[1:] & whole)
    return text[first], first, last, hashes[place[first]], tk.spans(prefix, first, last + length)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the compared length from seven bytes on; those already told apart are left alone.

    A suffix's rank is the first place of those equal to it so far.
    """
    n = len(data)
    padded = np.zeros(n + 7, tk.U)
    padded[:n] = data.astype(tk.U) + tk.U(1)  # the end of the text comes before every byte
    key = np.zeros(n, tk.U)
    for i in range(7):
        key = key << tk.U(9) | padded[i : n + i]
    order = np.argsort(key)
    new = np.ones(n + 1, bool)
    new[1:-1] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new[:-1], np.arange(n), 0))
    step = 7
    while len(todo := np.flatnonzero(~(new[:-1] & new[1:]))):
        own = order[todo]
        after = np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        key = rank[own].astype(tk.U) << tk.U(32) | after.astype(tk.U)
        again = np.argsort(key)
        order[todo], key = own[again], key[again]
        new[todo] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[todo]] = np.maximum.accumulate(np.where(new[todo], todo, 0))
        step *= 2
    return order


def common(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes."""
    out = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    width = 16
    while len(todo):
        x, y = a[todo] + out[todo], b[todo] + out[todo]
        room = np.minimum(len(data) - np.maximum(x, y), width)
        step = np.arange(width)
        inside = step[None, :] < room[:, None]
        same = inside & (data[np.minimum(x[:, None] + step, len(data) - 1)] == data[np.minimum(y[:, None] + step, len(data) - 1)])
        run = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        out[todo] += run
        todo = todo[run == width]
        width = min(256, 2 * width)
    return out


class RunLengthIndex:
    """A run-length compressed Burrows-Wheeler transform, sampled at run ends.

    ``chars`` and ``sizes`` are the transform's runs. For the first suffix of each run ``down_at`` is its text
    position and ``down`` its match with the suffix before; for the last ``up_at`` and ``up`` are the same with the
    suffix behind.
    """

    def __init__(self, data: np.ndarray):
        order = suffix_array(data)
        before = np.where(order > 0, data.astype(np.int16)[order - 1], np.int16(-1))  # the first suffix has an end mark of its own before it
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        tails = np.concatenate([heads[1:] - 1, [len(order) - 1]])
        self.n, self.chars, self.sizes = len(data), before[heads], tails - heads + 1
        self.down_at, self.up_at = order[heads], order[tails]
        self.down = np.zeros(len(heads), np.int64)
        self.down[1:] = common(data, order[heads[1:]], order[heads[1:] - 1])
        self.up = np.zeros(len(tails), np.int64)
        self.up[:-1] = common(data, order[tails[:-1]], order[tails[:-1] + 1])

    def matching_statistics(self) -> np.ndarray:
        """For each text position the longest match that also starts elsewhere, from the samples."""
        return np.maximum(self._streamed(self.down_at, self.down), self._streamed(self.up_at, self.up))

    def _streamed(self, at: np.ndarray, match: np.ndarray) -> np.ndarray:
        """Between samples a match loses one byte per position."""
        sampled = np.full(self.n, -1, np.int64)
        sampled[at] = match + at
        held = np.maximum.accumulate(np.where(sampled >= 0, np.arange(self.n), -1))
        return np.where(held >= 0, sampled[held] - np.arange(self.n), 0)


def _ranges(marks: np.ndarray) -> np.ndarray:
    """(begin, end) of the runs of true."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def _bucket(length: int):
    def match(table: pa.Table) -> pa.Table:
        data, offs = tk.buffers(table.column("bytes"))
        n = len(offs) - 1
        joined = np.full(len(data) + n, 0xFF, np.uint8)  # no byte of UTF-8
        starts = offs[:-1] + np.arange(n)
        joined[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offs))] = data
        repeated = RunLengthIndex(joined).matching_statistics() >= length
        found = [_ranges(repeated[a : a + size - length + 1]) for a, size in zip(starts.tolist(), np.diff(offs).tolist(), strict=True)]
        return pa.table({"anchor": table.column("anchor"), "span": table.column("span"), "ranges": pa.array([f.ravel().tolist() for f in found], pa.list_(pa.int32()))})

    return match


def _scan(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for a, _, data, offs in tk.pieces(batch.column(1), PIECE):
                text, first, last, anchor, span = stretches(data, offs, length, min(GRAM, length))
                own = [pa.array(rows[a + text]), pa.array((first - offs[text]).astype(np.int32)), pa.array((last - offs[text]).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64))]
                yield pa.RecordBatch.from_arrays(own, names=["row", "lo", "hi", "anchor", "span"])

    return scan


def _cut_out(length: int):
    """The bytes of the wanted spans of each text."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data, wanted = text.as_py().encode(), wanted.as_py()
                columns = [[w["anchor"] for w in wanted], [w["span"] for w in wanted], [data[w["lo"] : w["hi"] + length] for w in wanted]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "span", "bytes"])

    return cut_out


def _window_hashes(length: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tk.pieces(batch.column(2), PIECE):
                counts = np.diff(offs) - length + 1
                owner = np.repeat(np.arange(b - a), counts)
                shift = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = offs[owner] + shift
                own = [batch.column(i).slice(a, b - a).take(pa.array(owner)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(shift.astype(np.int32)), pa.array(tk.spans(tk.Sums(data, False), at, at + length).view(np.int64))], names=["anchor", "span", "at", "window"])

    return windows


def repeated_windows(texts: DataFrame, length: int = LENGTH, hot_spans: int = HOT_SPANS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, lo, hi, ranges) of texts (row, text): stretches with repeated windows, and where these start within it: as
    begin and end in turn, counted from lo; null for all of them."""
    spark = texts.sparkSession
    found = saved(texts.select("row", "text").mapInArrow(_scan(length), STRETCHES))
    spans = found.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "hi")).alias("at"))
    often = spans.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1").select("anchor", "kinds")
    spans = saved(spans.join(often, "anchor"))
    release(spark)
    whole = spans.where("n > 1").select("anchor", "span", F.lit(None).cast("array<int>").alias("ranges"))
    mixed = spans.where("kinds > 1").select("anchor", "span", "n", "kinds", "at.*")
    size = mixed.where(F.col("kinds") <= hot_spans).agg(F.sum(F.col("hi") - F.col("lo") + length)).first()[0] or 0
    wanted = mixed.groupBy("row").agg(F.collect_list(F.struct("anchor", "span", "lo", "hi")).alias("wanted"))  # at most a text's stretches
    bytes_of = texts.select("row", "text").join(wanted, "row").groupBy("row").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted")).select("text", "wanted")
    bytes_of = saved(bytes_of.mapInArrow(_cut_out(length), "anchor long, span long, bytes binary"))
    release(spark)
    hot = spans.where(F.col("kinds") > hot_spans).select("anchor").distinct()
    buckets = max(1, -(-size // bucket_bytes))
    cool = bytes_of.join(hot, "anchor", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    part = cool.groupBy("bucket").applyInArrow(_bucket(length), "anchor long, span long, ranges array<int>")
    windows = bytes_of.join(hot, "anchor", "left_semi").select("anchor", "span", "bytes").mapInArrow(_window_hashes(length), "anchor long, span long, at int, window long")
    again = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    one = windows.join(again, "window").groupBy("anchor", "span").agg(F.flatten(F.sort_array(F.collect_list(F.array(F.col("at"), F.col("at") + 1)))).alias("ranges"))
    part = part.unionByName(one).where(F.size("ranges") > 0)
    part = part.join(spans.where("n > 1").select("anchor", "span"), ["anchor", "span"], "left_anti")
    covered = saved(whole.unionByName(part))
    release(spark)
    return found.join(covered, ["anchor", "span"]).select("row", "lo", "hi", "ranges")


def _remove(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            for text, marks in zip(batch.column(1), batch.column(2), strict=True):
                data, marks = text.as_py().encode(), marks.as_py()
                edges = np.zeros(len(data) + 1, np.int64)
                for m in marks or ():
                    pairs = np.array(m["ranges"] if m["ranges"] is not None else [0, m["hi"] - m["lo"] + 1], np.int64).reshape(-1, 2) + m["lo"]
                    np.add.at(edges, pairs[:, 0], 1)
                    np.add.at(edges, pairs[:, 1] + length - 1, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for column, value in zip(columns, (len(data), int(gone.sum()), len(_ranges(gone)), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[f.split()[0] for f in REMOVED.split(", ")])

    return remove


def suffix_dedup(docs: DataFrame, length: int = LENGTH, hot_spans: int = HOT_SPANS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row per document: its bytes, those removed, in how many runs, and the digest of what is left."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    marks = repeated_windows(texts, length, hot_spans, bucket_bytes)
    marks = marks.groupBy("row").agg(F.collect_set(F.struct("lo", "hi", "ranges")).alias("marks"))  # at most a text's stretches
    return texts.join(marks, "row", "left").select("doc_id", "text", "marks").mapInArrow(_remove(length), REMOVED)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
