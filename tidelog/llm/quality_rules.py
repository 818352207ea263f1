"""Quality rules by a hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

Words and word pairs are hashed into ``buckets`` cells. The raw multinomial counts every text of the corpus; the
trusted one counts the texts of at most ``target_rows`` labelled rows (quality 1, not toxic; those with the smallest
hash of their id: a bounded sample with a documented parameter). A document's score is the mean over its n-grams
of log(p_target / p_raw): the ratio is normalised by length. Both counts, the raw one scaled to the size of the
target, get ``smoothing`` added, so a cell with little evidence says little. Documents scoring ``threshold`` or more
are kept, unless a base rule fails (see ``judge``).

Only the cells' counts (their number is fixed) and the bounded list of target ids come to the driver or are broadcast.

Defined results: a null or empty text has no words and fails the base rules; a null doc_id is kept as null and is
never a target; repeated rows are judged alike, each on its own; an empty table gives no rows; without any target
row the ratio is 0 for each document. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import textkit as tk
from tidelog.llm.cluster import documents, ship, table, text_of

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
SMOOTHING = 10.0
THRESHOLD = -0.115
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def cells(hashes: np.ndarray, text: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text) of each word and each pair of neighbours in one text."""
    pairs = tk.grams(hashes, 2)
    at = np.flatnonzero(text[:-1] == text[1:]) if len(text) > 1 else np.zeros(0, np.int64)
    return np.concatenate([hashes, pairs[at]]) % tk.U(buckets), np.concatenate([text, text[at]])


def target_ids(labels: DataFrame, most: int = TARGET_ROWS) -> DataFrame:
    """At most ``most`` ids of trusted rows."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratio(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(p_target / p_raw) of each cell, smoothed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offs in tk.pieces(batch.column(0)):
                cell, owner = cells(*tk.words(data, offs)[:2], buckets)
                raw += np.bincount(cell.astype(np.int64), minlength=buckets)
                good += np.bincount(cell[trusted[a:b][owner]].astype(np.int64), minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(good[some])], names=["cell", "raw", "good"])

    ids = F.broadcast(targets.select(F.col("doc_id").alias("target_id")))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(ids, F.col("doc_id") == F.col("target_id"), "left")
    counted = marked.select("text", F.col("target_id").isNotNull().alias("trusted")).mapInArrow(count, "cell int, raw long, good long")
    rows = counted.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[rows["cell"]], good[rows["cell"]] = rows["raw"], rows["good"]
    if not good.sum():
        return np.zeros(buckets)
    return np.log((good + smoothing) / (raw * (good.sum() / raw.sum()) + smoothing))


def _duplicates(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier with the same owner."""
    order = np.lexsort((keys, owner))
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(keys), bool)
    out[order] = again
    return out


def _repeated(hashes: np.ndarray, text: np.ndarray, n: int, k: int = 8) -> np.ndarray:
    """Per text: words in k-word windows that stand twice or more in the text."""
    windows = tk.grams(hashes, k)
    at = np.flatnonzero(text[: len(windows)] == text[k - 1 :]) if len(windows) else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(n, np.int64)
    keys, owner = windows[at], text[at]
    order = np.lexsort((keys, owner))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, at[order[twice]], 1)
    np.add.at(edges, at[order[twice]] + k, -1)
    return np.bincount(text[np.cumsum(edges[:-1]) > 0], minlength=n)


def measure(data: np.ndarray, offs: np.ndarray, ratio: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and the score of each text."""
    n = len(offs) - 1
    hashes, text, starts, ends = tk.words(data, offs)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = np.zeros(n, np.int64)
    np.add.at(word_chars, text, heads[ends] - heads[starts])
    line_from, line_to, line_text = tk.runs(data != 0x0A, offs)
    with_word = np.searchsorted(starts, line_from) < np.searchsorted(starts, line_to)
    line_from, line_to, line_text = line_from[with_word], line_to[with_word], line_text[with_word]
    dup = _duplicates(tk.spans(tk.Sums(data, False), line_from, line_to), line_text)
    cell, owner = cells(hashes, text, len(ratio))
    total, grams = np.bincount(owner, ratio[cell.astype(np.int64)], n), np.bincount(owner, minlength=n)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    return {
        "n_words": np.bincount(text, minlength=n),
        "word_chars": word_chars,
        "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]],
        "n_dup_lines": np.bincount(line_text[dup], minlength=n),
        "n_repeat_words": _repeated(hashes, text, n),
        "score": np.round(total / np.maximum(grams, 1), 9),
    }


def verdict(m: dict[str, np.ndarray], threshold: float, min_words: int = 20, max_repeat_percent: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(base rules failed, kept): under min_words words, or repeats over max_repeat_percent of them, fail."""
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
    return failed, ~failed & (m["score"] >= threshold)


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of JUDGED for each document."""
    ratio = ratio.astype(np.float64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tk.pieces(batch.column(1)):
                m = measure(data, offs, ratio)
                failed, kept = verdict(m, threshold)
                rest = [pa.array(m[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                own = [batch.column(0).slice(a, b - a), *rest, pa.array(failed), pa.array(kept), pa.array(m["score"])]
                yield pa.RecordBatch.from_arrays(own, names=[f.split()[0] for f in JUDGED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(score, JUDGED)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose document is kept, with docs' own columns. The verdict is found row by row: nothing is shuffled."""
    ship(docs.sparkSession)
    ratio = log_ratio(docs, target_ids(labels)).astype(np.float64)
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("t", text_of(f"c{names.index('text')}"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in tk.pieces(batch.column(len(names))):
                m = measure(data, offs, ratio)
                yield batch.slice(a, b - a).select(range(len(names))).filter(pa.array(verdict(m, threshold)[1]))

    return plain.mapInArrow(keep, plain.drop("t").schema).toDF(*names)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document with its base counts, score and verdict."""
    ship(docs.sparkSession)
    return judge(docs, log_ratio(docs, target_ids(labels)), threshold)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_rules": op4_quality_rules}
