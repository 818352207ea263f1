"""The driver's tables seen as an op-log and a replicated log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _with_count(df: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias("n"))))  # one row


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lsn, key, value, is_tombstone, batch_id, op_idx, file_id: ``error`` events are deletions; ten files."""
    events = _with_count(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "props"))
    dead = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("lsn"), F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.when(~dead, F.col("props")).alias("value"), dead.alias("is_tombstone"),
        F.floor(F.col("event_id") / 10).cast("long").alias("batch_id"), (F.col("event_id") % 10).cast("int").alias("op_idx"), F.floor(F.col("event_id") * 10 / F.col("n")).cast("int").alias("file_id"),
    )


def rlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, term, kind, key, value: open orders are puts, finished ones deletions, others blank; four terms."""
    orders = _with_count(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    status = F.col("o_orderstatus")
    kind = F.when(status == "O", "PUT").when(status == "F", "DELETE").otherwise("BLANK")
    return orders.select(
        F.col("o_orderkey").alias("idx"), (1 + F.floor(F.col("o_orderkey") * 4 / F.col("n"))).cast("long").alias("term"), kind.alias("kind"),
        F.concat(F.lit("cust:"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("key"), F.when(status == "O", F.col("o_orderpriority")).alias("value"),
    )


def manifest_events(ops: DataFrame) -> DataFrame:
    """seq, event, level, id: each file is added to level 0; the first four are then rewritten to level 1 under new ids."""
    files = ops.select("file_id").distinct()
    moved = files.where("file_id < 4")
    added = files.select((3 * F.col("file_id")).alias("seq"), F.lit("ADD").alias("event"), F.lit(0).alias("level"), F.col("file_id").alias("id"))
    gone = moved.select((100 + 3 * F.col("file_id")).alias("seq"), F.lit("RM").alias("event"), F.lit(0).alias("level"), F.col("file_id").alias("id"))
    made = moved.select((101 + 3 * F.col("file_id")).alias("seq"), F.lit("ADD").alias("event"), F.lit(1).alias("level"), (100 + F.col("file_id")).alias("id"))
    return added.unionByName(gone).unionByName(made)
