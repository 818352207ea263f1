"""Best-fit packing of tokenised documents, certified by dual-feasible-function bounds.

Documents become token ids (byte-level BPE, then an end id). Longer ones are cut into pieces of ``capacity``; the
first piece may be shorter. Pieces are dealt by a hash into groups of bounded size, and each group is packed by
best-fit decreasing. A group whose number of bins equals the best dual-feasible-function lower bound is certified:
no packing of its pieces uses fewer. But several certified groups can have room left that one group would not, so
every group releases its emptiest bins, and one with a gap to its bound the more of them; the pieces released by
``fan`` groups meet and are packed again, until one group is left. How many bins a group releases is bounded; that
decides how tight the packing is, never what is packed. A repacking that does not save bins is not taken.

Defined results: a null or empty text is the end id alone; a null doc_id is kept; repeated rows are packed as
documents of their own; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.cluster import cut, documents, ship, text_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, round int, group long, bins long, bound long, released boolean"
#: The largest character whose class no version of Unicode has changed lately. Texts with larger ones, with controls or
#: with special tokens are encoded whole.
LAST = 0x24F
#: Parts of texts whose ids a worker remembers.
REMEMBERED = 300_000


def _plain(pattern: str) -> tuple[re.Pattern, re.Pattern]:
    """The tokenizer's pattern with its classes of letters and numbers written out up to LAST, for Python's own regular
    expressions; and what a text must not contain to be split by it."""
    known = [chr(c) for c in range(LAST + 1)]
    of = lambda kinds: "".join(re.escape(c) for c in known if unicodedata.category(c)[0] in kinds)
    letters, numbers = of("L"), of("N")
    own = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(own), re.compile(f"[^\t\n\r -~\xa1-\xac\xae-{chr(LAST)}]|<[|]")


def _shown() -> dict[int, str]:
    """The character by which a byte-level model writes each byte: its own if that is visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(visible)))}


_SHOWN = _shown()


class Parts(dict):
    """Ids of parts of texts, made by the model when first asked for; those of an older generation are taken over."""

    def __init__(self, model, before: dict[str, bytes]):
        super().__init__()
        self.model, self.before = model, before

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            made = self.model.tokenize(part.encode().decode("latin-1").translate(_SHOWN))
            ids = struct.pack(f"<{len(made)}I", *[token.id for token in made])
        self[part] = ids
        return ids


class Encoder:
    """Ids of texts as the tokenizer gives them. A byte-level tokenizer merges within the parts into which its pattern
    splits a text; most parts come again, so they are remembered. There are two generations of them: when the younger one
    is half of ``REMEMBERED``, those parts are forgotten that have not come since it began."""

    def __init__(self, path: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        # the pattern belongs to the default file
        self.pattern, self.other = _plain(public_tokenizers.PATTERN) if path is None else (None, None)
        self.known = Parts(self.tokenizer.model, {})

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.pattern is None or self.other.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if 2 * len(self.known) > REMEMBERED:
            self.known.before = {}
            self.known = Parts(self.known.model, self.known)
        return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))


@cache
def _encoder(path: str | None) -> Encoder:
    return Encoder(path)


def encode(text: str, path: str | None = None) -> bytes:
    """The text's ids, as the tokenizer gives them, as little-endian unsigned 32-bit numbers."""
    return _encoder(path).encode(text)


def tokenised(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """A row per piece of each document: its place among the document's ids and their CRC-32."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py(), path) + end
                n = len(ids) // 4
                begins = [0, *range(n % capacity or capacity, n, capacity)]
                for k, (a, b) in enumerate(zip(begins, [*begins[1:], n], strict=True)):
                    for column, value in zip(rows, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(pieces, PIECES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of two families of dual-feasible functions: no packing of these sizes has fewer bins."""
    x, n = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    if not len(x):
        return 0
    best = -(-int((x * n).sum()) // capacity)
    for e in range(1, capacity // 2 + 1):  # sizes over capacity - e fill a bin, those under e count nothing
        f = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int((f * n).sum()) // capacity))
    for k in range(1, 33):  # rounds (k + 1) x / capacity down to a multiple of 1 / k, unless it is whole
        whole = (k + 1) * x % capacity == 0
        f = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((f * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin of each size, offset of each, what each bin has left)."""
    where, offset, left = [0] * len(sizes), [0] * len(sizes), []
    by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set if a bin has r left
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        if fits := some >> size:
            r = size + (fits & -fits).bit_length() - 1
            b = by_left[r].pop()
            if not by_left[r]:
                some &= ~(1 << r)
        else:
            b, r = len(left), capacity
            left.append(r)
        where[i], offset[i], left[b] = b, capacity - r, r - size
        by_left[r - size].append(b)
        some |= 1 << (r - size)
    return where, offset, left


def _packed(pdf: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    """One group's pieces, packed; sequence_id -1 before the first round."""
    pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
    group, turn = int(pdf["group"].iloc[0]), int(pdf["round"].iloc[0]) + 1
    where, offset, left = best_fit_decreasing(pdf["length"].tolist(), capacity)
    before = pdf["sequence_id"].nunique() if turn else len(left) + 1
    if len(left) < before:
        pdf["sequence_id"] = np.array(where, np.int64) + (turn << 58 | group << 26)
        pdf["offset"] = offset
        free = pd.Series(left, dtype="int64")[where].to_numpy()
    else:
        free = capacity - pdf.groupby("sequence_id")["length"].transform("sum").to_numpy()
    bins = pdf["sequence_id"].nunique()
    bound = lower_bound(pdf["length"].to_numpy(), capacity)
    gap = bins - bound
    emptiest = pdf.assign(free=free)[["sequence_id", "free"]].drop_duplicates().sort_values(["free", "sequence_id"], ascending=[False, True])
    emptiest = emptiest[emptiest["free"] > 0]["sequence_id"].head(0 if last else 16 + 64 * gap)
    return pdf.assign(round=turn, bins=bins, bound=bound, released=pdf["sequence_id"].isin(emptiest))


def _packer(capacity: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _packed(pdf, capacity, last)


def pack(pieces: DataFrame, capacity: int = 1024, group_size: int = 8192, fan: int = 32) -> DataFrame:
    """pieces (see PIECES), each with its sequence and the certificate of the group in which it was packed last."""
    pieces = cut(pieces)
    groups = max(1, -(-pieces.count() // group_size))
    names = [f.split()[0] for f in PACKED.split(", ")]
    todo = pieces.withColumns(
        {"sequence_id": F.lit(-1).cast("long"), "offset": F.lit(0).cast("long"), "round": F.lit(-1), "group": F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)), "bins": F.lit(0).cast("long"), "bound": F.lit(0).cast("long"), "released": F.lit(False)}
    )
    done = []
    while True:
        last = groups == 1
        now = cut(todo.select(names).groupBy("group").applyInPandas(_packer(capacity, last), PACKED))
        done.append(now.where(~F.col("released")))
        if last or now.where("released").isEmpty():
            break
        groups = -(-groups // fan)
        todo = now.where("released").withColumn("group", F.floor(F.col("group") / fan).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("released", "group")


def best_fit_packing(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_path: str | None = None, group_size: int = 8192) -> DataFrame:
    """Every document's pieces with sequence and offset."""
    ship(docs.sparkSession)
    return pack(tokenised(docs, capacity, end_id, tokenizer_path), capacity, group_size)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
