"""Flush, compaction and statistics of sorted runs. A run is the rows of one file_id; higher ids are newer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.resolve import newest

#: Bytes that an entry has besides key and value, in a run and in a log record; the size of a block.
ENTRY_BYTES, RECORD_BYTES, BLOCK_BYTES = 17, 21, 4096
#: Oldest runs taken by one compaction.
COMPACT_RUNS = 10


def flush(ops: DataFrame) -> DataFrame:
    """One version per key and run; tombstones stay, as they shadow older runs."""
    return newest(ops, by=["file_id", "key"])


def compact(ops: DataFrame) -> DataFrame:
    """The merge into the bottom level: newest version of each key, tombstones dropped. Every older run must be among ops."""
    return newest(ops).where(~F.col("is_tombstone")).select("key", "value", "lsn")


def purged(ops: DataFrame) -> DataFrame:
    """How many keys a compaction of ops removes."""
    return newest(ops).where("is_tombstone").agg(F.count("*").alias("purged"))


def run_stats(ops: DataFrame) -> DataFrame:
    """Key and sequence bounds, distinct keys and entry bytes of each run."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + ENTRY_BYTES
    by_key = ops.groupBy("file_id", "key").agg(F.min("lsn").alias("lo"), F.max("lsn").alias("hi"), F.sum(size).alias("bytes"))
    return by_key.groupBy("file_id").agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("lo").alias("first_seq"), F.max("hi").alias("last_seq"), F.count("*").alias("entries"), F.sum("bytes").cast("long").alias("raw_bytes")
    )


def log_bytes(ops: DataFrame) -> DataFrame:
    """Bytes, ops and next sequence number of each log file."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + RECORD_BYTES
    return ops.groupBy("file_id").agg(F.sum(size).cast("long").alias("wal_bytes"), F.count("*").alias("ops"), (F.max("lsn") + 1).alias("next_lsn"))


def read_cost(ops: DataFrame) -> DataFrame:
    """Runs that hold each key: what a lookup may have to open."""
    return ops.select("key", "file_id").distinct().groupBy("key").agg(F.count("*").alias("tables_holding"))


def versions(ops: DataFrame) -> DataFrame:
    return ops.groupBy("key").agg(F.count("*").alias("versions"), F.sum(F.col("is_tombstone").cast("long")).alias("tombstones"))


def torn(ops: DataFrame, bad: str) -> DataFrame:
    """Ops before the first bad record of their file. The first bad record is an aggregate, so no file is sorted in one task."""
    cut = ops.where(bad).groupBy("file_id").agg(F.min("lsn").alias("torn_at"))
    return ops.join(cut, "file_id", "left").where("torn_at is null or lsn < torn_at").drop("torn_at")


def pick_inputs(manifest: DataFrame) -> DataFrame:
    """(level, id) that the next compaction reads: the oldest runs of level 0 and all of level 1."""
    oldest = manifest.where("level = 0").orderBy("id").limit(COMPACT_RUNS)
    return oldest.unionByName(manifest.where("level = 1"))


def saturated(runs: DataFrame, threshold: int = 4) -> DataFrame:
    """Runs of level 0 after each flush, and whether writers must wait then. runs: one row per flush, so few."""
    count = F.count("*").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, 0))
    return runs.select("file_id").distinct().select("file_id", count.alias("l0")).withColumn("saturated", F.col("l0") >= threshold)


def block_index(ops: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file_id, block, first_key, entries, raw_bytes): entries of a flushed run in key order, packed greedily into blocks.

    Packing depends on all entries before, so a run is one task; runs are bounded in size when they are written.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used, n = [], 0, 0
        pdf = pdf.sort_values("key", key=lambda k: k.map(lambda x: x if isinstance(x, bytes) else str(x).encode()))
        for key, size in zip(pdf["key"], pdf["bytes"], strict=True):
            if n and used + size > block_bytes:
                out[-1][3:] = [n, used]
                n = 0
            if not n:
                out.append([int(pdf["file_id"].iloc[0]), len(out), key, 0, 0])
                used = 0
            used, n = used + int(size), n + 1
        if out:
            out[-1][3:] = [n, used]
        return pd.DataFrame(out, columns=["file_id", "block", "first_key", "entries", "raw_bytes"])

    size = (F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + ENTRY_BYTES).alias("bytes")
    return flush(ops).select("file_id", "key", size).groupBy("file_id").applyInPandas(pack, "file_id int, block int, first_key string, entries long, raw_bytes long")
