"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set is its distinct shingles of ``shingle`` words; documents with equal sets are one node. Sets are told
apart by 128 bits: a node's number is 64 of them, and sets that share these but not the others get numbers of their
own. A node's signature has ``COORDINATES`` minima of universal hashes. Nodes are posted under each coordinate-value pair, and a
pair of nodes is a candidate if at least ``MATCHES`` coordinates collide. Of sets of similarity 0.8, 51.2 of 64
coordinates collide on average (deviation 3.2); the chance that under 36 do is about 4e-6, and smaller above 0.8.

Counting collisions is done with prefix and skip merging. Values that no other node has cannot collide and are
skipped, as are nodes with fewer than MATCHES shared values. Of a node's shared values, rarest first, those beyond
the first (shared - MATCHES + 1) are skipped too: two nodes with MATCHES collisions meet in some value before that.
So the frequent values of passages that many documents hold are not merged. A pair that meets goes on if bitmaps of
the sets leave it possible (a bit of one map that the other lacks is a shingle outside the intersection), and if
MATCHES collisions are counted on the whole signatures. Links are confirmed on the full sets: 100 * intersection >=
percent * union.

Defined results: a null or empty text, or one without words, has the empty set and is a component of its own. A
null doc_id is a row with null kept and counts for no component's smallest id (a component of null ids only has
null). Rows that repeat a doc_id are documents that have the same id: each row gets a result, and their links join.
An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import textkit as tk
from tidelog.llm.cluster import discard, documents, release, saved, ship, text_of
from tidelog.llm.linking import groups, lists_of

COORDINATES, MATCHES = 64, 36
#: Longs of a set's bitmap.
MAPS = 16
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | tk.U(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
SIGNED = "doc_id long, hash long, n_shingles long, node long, other long, signature array<int>"


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingles, their offsets) by chunks of texts."""
    for a, b, data, offs in tk.pieces(column):
        hashes, text, _, _ = tk.words(data, offs, lower=True)
        made, owner = tk.shingles(hashes, text, b - a, shingle)
        yield a, b, *tk.distinct(made, owner, b - a)


def _nodes(values: np.ndarray, bounds: np.ndarray, bits: int) -> list[pa.Array]:
    """Two numbers of each set, the first one of so many bits; equal sets have equal ones."""
    out = []
    for key in (0xA24BAED4963EE407, 0x3C79AC492BA7B653):
        sums = np.concatenate([np.zeros(1, tk.U), np.cumsum(tk.mix(values ^ tk.U(key)))])
        out.append(tk.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(tk.U)))
    out[0] &= tk.U((1 << bits) - 1)
    return [pa.array(x.view(np.int64)) for x in out]


def _told_apart(df: DataFrame, shared: DataFrame) -> DataFrame:
    """df with numbers of nodes that no two sets have. shared: (node, first) of the numbers that several sets have."""
    own = F.col("first").isNull() | (F.col("other") == F.col("first"))
    return df.join(shared, "node", "left").withColumn("node", F.when(own, F.col("node")).otherwise(F.xxhash64("other", "node"))).drop("other", "first")


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """COORDINATES minima of each set, as 32-bit integers; of an empty set zeros."""
    out = np.zeros((len(bounds) - 1, COORDINATES), np.int32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        starts = bounds[:-1][some]
        for i in range(COORDINATES):
            out[some, i] = np.minimum.reduceat(((values ^ _B[i]) * _A[i] >> tk.U(32)).astype(np.uint32), starts).view(np.int32)
    return out


def signed(texts: DataFrame, shingle: int, bits: int = 64) -> DataFrame:
    """doc_id and hash as they are; size, numbers and signature of each text's set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, bounds in _sets(batch.column(2), shingle):
                flat = pa.array(signatures(values, bounds).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * COORDINATES), flat)
                own = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(bounds)), *_nodes(values, bounds, bits), lists]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "hash", "n_shingles", "node", "other", "signature"])

    return texts.select("doc_id", "hash", "text").mapInArrow(sign, SIGNED)


def postings(nodes: DataFrame) -> DataFrame:
    """(key, node, weight): the coordinate-value pairs under which each node must be merged, and how common its values are."""
    each = nodes.select("node", F.posexplode("signature").alias("pos", "value"))
    each = each.select("node", (F.shiftleft(F.col("pos").cast("long"), 32) + (F.col("value").cast("long") + (1 << 31))).alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    own = each.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"))  # at most COORDINATES
    weight = F.aggregate("own", F.lit(0).cast("long"), lambda total, one: total + one["n"])  # large in the midst of a group of near copies
    first = F.slice("own", 1, F.size("own") - MATCHES + 1)
    return own.where(F.size("own") >= MATCHES).select("node", weight.alias("weight"), F.explode(first).alias("one")).select("node", "weight", "one.key")


def _full_sets(texts: DataFrame, shingle: int, bits: int) -> DataFrame:
    """(node, other, n, set, maps): each text's numbers, its sorted distinct shingles and a bitmap of their hashes; a node once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, bounds in _sets(batch.column(0), shingle):
                owner = np.repeat(np.arange(b - a), np.diff(bounds))
                maps = np.zeros((b - a, 64 * MAPS), bool)
                maps[owner, (tk.mix(values) % tk.U(64 * MAPS)).astype(np.int64)] = True
                flat = np.packbits(maps, axis=1, bitorder="little").view(np.int64)
                own = [*_nodes(values, bounds, bits), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64))), *(pa.array(flat[:, i]) for i in range(MAPS))]
                yield pa.RecordBatch.from_arrays(own, names=["node", "other", "n", "set", *(f"m{i}" for i in range(MAPS))])

    schema = "node long, other long, n long, set array<long>, " + ", ".join(f"m{i} long" for i in range(MAPS))
    return texts.mapInArrow(gather, schema).dropDuplicates(["node", "other"])


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, bits: int = 64) -> DataFrame:
    """A row per document: size of its set, its component and whether it is the document kept of it. bits: see ``_nodes``."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("hash"), text_of().alias("text"))
    rows = saved(signed(texts, shingle, bits))
    one_of = F.min(F.struct("doc_id", "hash")).alias("pick")  # the document whose text is read again
    nodes = saved(rows.where("n_shingles > 0").groupBy("node", "other").agg(F.min("doc_id").alias("least_id"), one_of, F.first("signature").alias("signature")))
    release(docs.sparkSession)
    shared = saved(nodes.groupBy("node").agg(F.min("other").alias("first"), F.max("other").alias("last")).where("first <> last").drop("last"))
    nodes = _told_apart(nodes, shared)
    posts = saved(postings(nodes))
    release(docs.sparkSession)
    active = nodes.join(posts.select("node").distinct(), "node", "left_semi").select(F.col("pick.doc_id").alias("id"), F.col("pick.hash").alias("h"))
    read = texts.join(active, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")), "left_semi")
    sets = saved(_told_apart(_full_sets(read.select("text"), shingle, bits), shared))
    lists = lists_of(posts)
    discard(posts)
    features = sets.drop("set").join(nodes.select("node", "signature"), "node")

    def possible(x: str, y: str) -> Column:
        """Each bit that one set's map has and the other's lacks is a shingle outside the intersection; and enough coordinates must collide."""
        lone = lambda a, b: sum((F.bit_count(F.col(f"{a}_m{i}").bitwiseAND(F.bitwise_not(f"{b}_m{i}"))) for i in range(MAPS)), F.lit(0))
        most = F.least(F.col(f"{x}_n") - lone(x, y), F.col(f"{y}_n") - lone(y, x))
        sizes = 100 * F.least(f"{x}_n", f"{y}_n") >= percent * F.greatest(f"{x}_n", f"{y}_n")
        same = F.size(F.filter(F.zip_with(f"{x}_signature", f"{y}_signature", lambda p, q: p == q), lambda z: z))
        return sizes & (100 * most >= percent * (F.col(f"{x}_n") + F.col(f"{y}_n") - most)) & (same >= MATCHES)

    def verify(pairs: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
        both = pairs.join(one, "a").join(two, "b").withColumns({"sizes": F.size("x") + F.size("y"), "both": F.size(F.array_intersect("x", "y"))})
        return both.where(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select(pairs.columns)

    features = saved(features)
    labels = groups(lists, features, possible, verify)
    discard(sets, features)
    named = nodes.select("node", "least_id").join(labels, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "label").select("node", "component_id")
    out = _told_apart(rows.select("doc_id", "n_shingles", "node", "other"), shared).join(named, "node", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns. A null doc_id is kept; of rows with one id, all or none."""
    gone = near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op1_near_duplicates": op1_near_duplicates}
ORACLES = {
    "op1_near_duplicates": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, list_distinct(case when len(ws) = 0 then cast([] as varchar[]) when len(ws) < 4 then [array_to_string(ws, ' ')]
    else [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] for i in range(1, len(ws) - 2)] end) as sh from w),
n as (select doc_id, len(sh) as n from s),
e as (select doc_id, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * k >= 80 * (na.n + nb.n - k)),
r as (select doc_id, doc_id as c from n union select r.doc_id, l.b from r join l on r.c = l.a)
select r.doc_id, n.n as n_shingles, min(c) as component_id, min(c) = r.doc_id as kept from r join n on n.doc_id = r.doc_id group by r.doc_id, n.n
"""
}
