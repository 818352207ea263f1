"""Cross-entropy difference between matched target and background n-gram models.

Both are bigram models over one vocabulary, every word of the corpus and one more for unknown words. Bigrams back off
to unigrams by Dirichlet smoothing: p(w | v) = (c(v w) + prior p(w)) / (c(v) + prior), and p(w) has ``added`` added to each
count. The target counts the texts of all trusted rows (quality 1, not toxic), the background all other texts. Its
counts are scaled to the target's number of tokens, so that both models know equally much. A text is scored by models
without its own tokens: else a trusted text would find its rarest bigrams in the target and any other in the
background, and the score would say which rows were trusted. A document's score is the mean over its tokens of its
loss under the target model less that under the background model: the lower, the more like the target.

How counts are gathered. The texts are taken in chunks of about ``chunk_bytes``. N-grams are hashed; a hash is dealt
into a bucket, and its other 40 bits name the n-gram there. A chunk sends each bucket one packed row of the distinct
n-grams that fall in it, ascending, with their counts in this chunk. A bucket adds up the chunks' counts and sends
each of them the totals of its own n-grams, in the order in which it asked. So each distinct n-gram of a chunk crosses
the network once, in three to four bytes, and comes back as its totals, which pack well; a word that all texts share is
asked for once per chunk. The number of buckets grows with the corpus; a bucket holds about ``bucket_grams`` n-grams.
(Packing pays while a chunk has many n-grams for each bucket: for tens of terabytes both parameters should be 16 times
their defaults, and a task then holds a few hundred megabytes.) Only numbers of tokens and words come to the driver.

Defined results: a null or empty text, or one without words, has 0 tokens, losses and score null; a null doc_id is
kept and is no target; repeated rows each give a row; an empty table gives no rows; without any other target row, or
without any other background row, both models are the one there is and the score is 0. Other columns of the input are
ignored. N-grams of equal hashes are counted as one (about one in 2**40 / bucket_grams, a millionth).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import textkit as tk
from tidelog.llm.cluster import discard, documents, release, saved, ship, table, text_of

#: Weight of the unigram estimate, in tokens; and what is added to each unigram count.
PRIOR, ADDED = 100.0, 0.05
CHUNK_BYTES, BUCKET_GRAMS = 3 << 20, 3 << 18
#: Bits that name an n-gram in its bucket.
NAME_BITS = 40
#: The word before the first of a text.
START = tk.U(0x5851F42D4C957F2D)
GATHERED = "chunk long, ids array<long>, data binary"
CHUNKS = "chunk long, bucket int, n long, data binary"
SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number: first all lowest ones, and so on, which packs well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _packed(*columns: tuple[np.ndarray, int]) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b"".join(_planes(v, size) for v, size in columns))


def _unpacked(data: bytes, n: int, *sizes: int) -> list[np.ndarray]:
    flat, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if n else np.zeros(0, np.uint8), 0, []
    for size in sizes:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = flat[at : at + n * size].reshape(size, n).T
        out.append(wide.view("<u8").ravel().astype(np.int64))
        at += n * size
    return out


def n_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, bigram with the word before) of each token: its text's row, and hashes."""
    text, word, pair = [np.zeros(0, np.int64)], [np.zeros(0, tk.U)], [np.zeros(0, tk.U)]
    for a, _, data, offs in tk.pieces(column):
        hashes, owner, _, _ = tk.words(data, offs)
        before = np.full(len(hashes), START)
        before[1:] = np.where(owner[1:] == owner[:-1], hashes[:-1], START)
        text.append(owner + a)
        word.append(hashes)
        pair.append(tk.mix(before * tk.U(0x9E3779B97F4A7C15) + hashes ^ tk.U(1 << 63)))
    return np.concatenate(text), np.concatenate(word), np.concatenate(pair)


class Chunk:
    """The n-grams of some texts (doc_id, text, trusted), numbered by bucket and name."""

    def __init__(self, texts: pa.Table, buckets: int):
        self.n, self.trusted = texts.num_rows, texts.column(2).to_numpy().astype(bool)
        self.text, word, pair = n_grams(texts.column(1))
        self.size = np.bincount(self.text, minlength=self.n)
        self.some = np.flatnonzero(self.size)  # their starts are counted as words before the first one
        hashes = tk.mix(np.concatenate([word, np.full(len(self.some), START), pair]))
        codes = (hashes >> tk.U(NAME_BITS)) % tk.U(buckets) << tk.U(NAME_BITS) | hashes & tk.U((1 << NAME_BITS) - 1)
        self.codes, self.at = np.unique(codes, return_inverse=True)
        self.word, self.start, self.pair = np.split(self.at, [len(word), len(word) + len(self.some)])

    def asked(self, buckets: int) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, n-grams, their names, counts in all and in trusted texts, and which are words) of each bucket."""
        n = len(self.codes)
        raw = np.bincount(self.at, minlength=n)
        good = np.bincount(self.at, np.concatenate([self.trusted[self.text], self.trusted[self.some], self.trusted[self.text]]), n)
        word = np.zeros(n, bool)
        word[self.word] = word[self.start] = True
        names = self.codes & tk.U((1 << NAME_BITS) - 1)
        ends = np.searchsorted(self.codes, np.arange(buckets + 1, dtype=tk.U) << tk.U(NAME_BITS))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            part = slice(ends[b], ends[b + 1])
            yield b, int(ends[b + 1] - ends[b]), _packed((np.diff(names[part], prepend=tk.U(0)), 5), (raw[part], 4), (good[part], 4), (word[part], 1))


def _gather(chunk_bytes: int):
    """Rows of GATHERED: the texts as packed tables of about chunk_bytes, with the ids that stand there."""

    def packed(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        texts, sink = pa.Table.from_batches(batches).select([0, 1]).combine_chunks(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(texts)
        ids = texts.column(0).drop_null().unique().to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "ids", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = number = 0
        for batch in batches:
            for a, b, data, _ in tk.pieces(batch.column(1)):
                if not held:
                    number = batch.column(2)[a].as_py()  # a chunk is named by the number of its first text
                held.append(batch.slice(a, b - a))
                size += len(data)
                if size >= chunk_bytes:
                    yield packed(number, held)
                    held, size = [], 0
        if held:
            yield packed(number, held)

    return gather


def _texts(data: pa.BinaryScalar, trusted: pa.ListScalar) -> pa.Table:
    """(doc_id, text, trusted) of a chunk."""
    texts = pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()
    good = pc.is_in(texts.column(0), trusted.values) if trusted.is_valid else pa.array([False] * texts.num_rows)
    return texts.append_column("trusted", pc.fill_null(good, False))


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ([],) * 4, kinds, strict=True)], names=["chunk", "bucket", "n", "data"])


def _ask(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, trusted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                yield from _rows([(number, *row) for row in Chunk(_texts(data, trusted), buckets).asked(buckets)]).to_batches()

    return ask


def _total(asked: pa.Table) -> pa.Table:
    """Of one bucket: to each chunk the totals (all, trusted) of its n-grams; and to none the numbers of its words, tokens and trusted tokens."""
    sizes = asked.column("n").to_pylist()
    parts = [_unpacked(data.as_py(), n, 5, 4, 4, 1) for n, data in zip(sizes, asked.column("data"), strict=True)]
    names = np.concatenate([np.cumsum(p[0]) for p in parts])
    raw, good, word = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    del parts
    distinct, at = np.unique(names, return_inverse=True)
    raw, good = np.bincount(at, raw, len(distinct)).astype(np.int64), np.bincount(at, good, len(distinct)).astype(np.int64)
    words = np.zeros(len(distinct), bool)
    words[at[word == 1]] = True
    tokens = words & (distinct != int(tk.mix(np.array([START]))[0]) & ((1 << NAME_BITS) - 1))  # starts are no tokens
    ends = np.cumsum([0, *sizes]).tolist()
    bucket = asked.column("bucket")[0].as_py()
    rows = [(c, bucket, n, _packed((raw[at[a:b]], 8), (good[at[a:b]], 8))) for c, n, a, b in zip(asked.column("chunk").to_pylist(), sizes, ends[:-1], ends[1:], strict=True)]
    return _rows([*rows, (None, -1, int(words.sum()), b""), (None, -2, int(raw[tokens].sum()), b""), (None, -3, int(good[tokens].sum()), b"")])


def losses(raw: np.ndarray, good: np.ndarray, own: np.ndarray, trusted: np.ndarray, tokens: np.ndarray, totals: tuple[int, int], words: int, prior: float = PRIOR, added: float = ADDED) -> tuple[np.ndarray, np.ndarray]:
    """Losses in nats of tokens under the target and under the background.

    raw, good and own: counts, in all texts, in trusted texts and in the token's own text, of (the word before, the
    word, the bigram). trusted and tokens: kind and size of the token's text. A model without tokens gives way to the other.
    """
    target, rest = good - np.where(trusted, own, 0), raw - good - np.where(trusted, 0, own)
    n_target, n_rest = totals[1] - np.where(trusted, tokens, 0), totals[0] - totals[1] - np.where(trusted, 0, tokens)
    target, n_target = np.where(n_target > 0, target, rest), np.where(n_target > 0, n_target, n_rest)
    rest, n_rest = np.where(n_rest > 0, rest, target), np.where(n_rest > 0, n_rest, n_target)
    scale = n_target / np.maximum(n_rest, 1)

    def loss(before: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        single = (word + added) / (n_target + added * (words + 1))
        return -np.log((pair + prior * single) / (before + prior))

    return loss(*target), loss(*(rest * scale))


def _own(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """How often each token's n-gram stands in the token's text."""
    _, where, counts = np.unique(text * max(n, 1) + at, return_inverse=True, return_counts=True)
    return counts[where]


def _scorer(buckets: int, totals: tuple[int, int], words: int, prior: float, added: float):
    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        texts = _texts(texts.column("data")[0], texts.column("trusted")[0])
        own = Chunk(texts, buckets)
        counts = counts.sort_by("bucket")
        parts = [_unpacked(d.as_py(), n, 8, 8) for n, d in zip(counts.column("n").to_pylist(), counts.column("data"), strict=True)]
        raw, good = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1))
        n, text = len(own.codes), own.text
        own_word, own_pair = _own(text, own.word, n), _own(text, own.pair, n)
        first = np.ones(len(text), bool)
        first[1:] = text[1:] != text[:-1]
        at = np.stack([np.where(first, own.start[0] if len(text) else 0, np.roll(own.word, 1)), own.word, own.pair])
        mine = np.stack([np.where(first, 1, np.roll(own_word, 1)), own_word, own_pair])
        found = losses(raw[at], good[at], mine, own.trusted[text], own.size[text], totals, words, prior, added)
        target, background = (np.round(np.bincount(text, x, own.n) / np.maximum(own.size, 1), 9) for x in found)
        some = lambda x: pa.array(x, pa.float64(), mask=own.size == 0)
        columns = [texts.column(0), pa.array(own.size), some(target), some(background), some(np.round(target - background, 9))]
        return pa.Table.from_arrays(columns, names=[f.split()[0] for f in SCORED.split(", ")])

    return score


def lm_scoring(docs: DataFrame, labels: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_grams: int = BUCKET_GRAMS, prior: float = PRIOR, added: float = ADDED) -> DataFrame:
    """A row per document with its mean losses in nats and their difference."""
    ship(docs.sparkSession)
    ids = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("target_id")).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (3 * bucket_grams)))  # about one n-gram for three bytes of text
    # texts are not shuffled to mark trusted ones: each chunk is told which of its ids are
    gathered = saved(own.withColumn("number", F.monotonically_increasing_id()).mapInArrow(_gather(chunk_bytes), GATHERED))
    trusted = gathered.select("chunk", F.explode("ids").alias("target_id")).join(ids, "target_id").groupBy("chunk").agg(F.collect_set("target_id").alias("trusted"))
    chunks = saved(gathered.join(trusted, "chunk", "left").select("chunk", "data", "trusted"))
    discard(gathered)
    release(docs.sparkSession)
    totals = saved(chunks.mapInArrow(_ask(buckets), CHUNKS).groupBy("bucket").applyInArrow(_total, CHUNKS))
    release(docs.sparkSession)
    found = {r["bucket"]: r["n"] for r in totals.where("chunk is null").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    score = _scorer(buckets, (found.get(-2, 0), found.get(-3, 0)), found.get(-1, 0), prior, added)
    return chunks.groupBy("chunk").cogroup(totals.where("chunk is not null").groupBy("chunk")).applyInArrow(score, SCORED)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
