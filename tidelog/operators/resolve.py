"""Last-writer-wins resolution of an op-log (key, value, is_tombstone, lsn).

The newest version of a key is a ``max_by`` aggregate: partial maxima are taken before the one exchange on the key,
so a key with a third of all versions costs no more than any other. Predicates on the key commute with resolution
and are applied before it, where they reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.sources.files import shared_dir

ENTRY = ("value", "is_tombstone", "lsn")


def newest(ops: DataFrame, by: str | list[str] = "key", order: str | list[str] = "lsn", carry: tuple[str, ...] = ENTRY) -> DataFrame:
    """One row per ``by``: the columns of ``carry`` from the row that is last in ``order``. Tombstones are rows too."""
    keys, rank = [by] if isinstance(by, str) else by, [order] if isinstance(order, str) else order
    last = F.max_by(F.struct(*carry), F.struct(*rank)).alias("last")
    return ops.groupBy(*keys).agg(last).select(*keys, "last.*")


def live(resolved: DataFrame) -> DataFrame:
    """Resolved rows that are not deleted. An empty value is live; a tombstone is not."""
    return resolved.where(~F.col("is_tombstone")).drop("is_tombstone")


def in_range(ops: DataFrame, start, end) -> DataFrame:
    """Ops of keys from start to end, both inclusive; none if start > end. None is unbounded."""
    cond: Column = F.lit(True)
    if start is not None:
        cond = cond & (F.col("key") >= F.lit(start))
    if end is not None:
        cond = cond & (F.col("key") <= F.lit(end))
    return ops.where(cond)


def as_of(ops: DataFrame, lsn: int) -> DataFrame:
    """Ops with a smaller sequence number: the snapshot taken when ``lsn`` was next."""
    return ops.where(F.col("lsn") < lsn)


def scan(ops: DataFrame, start=None, end=None) -> DataFrame:
    """Live (key, value) of an inclusive key range, in key order."""
    return live(newest(in_range(ops, start, end))).select("key", "value").orderBy("key")


#: Longest list of keys that is compared in the scan itself.
LISTED = 1000


def lookup(ops: DataFrame, probes: DataFrame | list) -> DataFrame:
    """(key, value) of each probed key, null if it is deleted or missing. Probes come first: only their versions are resolved.

    A short list of keys becomes a predicate, which reaches the files' statistics and bloom filters; then no op but
    theirs is read or shuffled. Other probes are a semi-join, whose side the planner broadcasts if it knows it to be small.
    """
    if isinstance(probes, list):
        keys = sorted(set(probes))
        probes = ops.sparkSession.createDataFrame([(k,) for k in keys], f"key {ops.schema['key'].dataType.simpleString()}")
        own = ops.where(F.col("key").isin(keys)) if keys and len(keys) <= LISTED else ops.join(probes, "key", "left_semi")
    else:
        probes = probes.select("key").distinct()
        own = ops.join(probes, "key", "left_semi")
    return probes.join(live(newest(own)).select("key", "value"), "key", "left")


def missing(probes: DataFrame, ops: DataFrame) -> DataFrame:
    """Probes of which no version exists in any tier."""
    return probes.select("key").join(ops.select("key"), "key", "left_anti")


def flat_reply(rows: DataFrame) -> DataFrame:
    """(pos, item): ordered (key, value) rows as one flat array reply, key at 2i and value at 2i + 1.

    Positions come from range partitions: rows are sorted by partition, counted per partition, and numbered from the
    partition's offset. The counts are one small row per partition; no task sees all rows. The sorted rows are written
    once to the shared folder, so that counts and positions are of the same partitions and nothing is resolved twice.
    """
    shared_dir(rows.sparkSession)
    spread = rows.select("key", "value").repartitionByRange("key").sortWithinPartitions("key").withColumns({"part": F.spark_partition_id(), "mono": F.monotonically_increasing_id()})
    spread = spread.withColumn("i", F.col("mono") - F.shiftleft(F.col("part").cast("long"), 33)).drop("mono").checkpoint()
    counts = {r["part"]: r["n"] for r in spread.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offset, cases = 0, [F.lit(-1), F.lit(0)]
    for part in sorted(counts):
        cases += [F.lit(part), F.lit(offset)]
        offset += counts[part]
    at = F.element_at(F.create_map(*cases), F.col("part")) + F.col("i")
    pair = F.array(F.struct((2 * at).cast("long").alias("pos"), F.col("key").alias("item")), F.struct((2 * at + 1).cast("long").alias("pos"), F.col("value").alias("item")))
    return spread.select(F.explode(pair).alias("e")).select("e.pos", "e.item")


def number_batch(batches: DataFrame, start: int = 0) -> DataFrame:
    """(batch_id, ops array) rows as an op-log: consecutive sequence numbers in batch and array order.

    Batches get their first number from the sizes of those before, summed in one window over batch sizes only.
    """
    from pyspark.sql import Window

    sizes = batches.select("batch_id", F.size("ops").cast("long").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.lit(start)
    placed = batches.join(sizes.select("batch_id", first.alias("first")), "batch_id")
    each = placed.select("batch_id", "first", F.posexplode("ops").alias("op_idx", "op"))
    return each.select((F.col("first") + F.col("op_idx")).alias("lsn"), "op.key", "op.value", (F.col("op.op") == "DELETE").alias("is_tombstone"), "batch_id", "op_idx")
