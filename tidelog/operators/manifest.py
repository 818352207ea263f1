"""Manifest events as a table: seq, event (ADD, RM or WAL), level, id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(lines: DataFrame) -> DataFrame:
    """(seq, line) text rows as events. Unknown lines are left out; a number that cannot be read is 0."""
    part = F.split("line", ",")
    number = lambda i: F.coalesce(F.expr(f"try_cast(try_element_at(split(line, ','), {i}) as bigint)"), F.lit(0).cast("long"))
    rows = lines.select("seq", part[0].alias("event"), F.size(part).alias("n"), number(2).alias("x"), number(3).alias("y"))
    two = F.col("event").isin("ADD", "RM") & (F.col("n") >= 3)
    log = (F.col("event") == "WAL") & (F.col("n") >= 2)
    return rows.where(two | log).select("seq", "event", F.when(two, F.col("x").cast("int")).alias("level"), F.when(two, F.col("y")).otherwise(F.col("x")).alias("id"))


def active(events: DataFrame) -> DataFrame:
    """(level, id) whose last event is ADD."""
    last = events.where("event <> 'WAL'").groupBy("level", "id").agg(F.max_by("event", "seq").alias("event"))
    return last.where("event = 'ADD'").select("level", "id")


def watermark(events: DataFrame) -> DataFrame:
    """One row: first log file still needed, and next file id."""
    wal = F.max_by("id", F.when(F.col("event") == "WAL", F.col("seq")))
    return events.agg(F.coalesce(wal, F.lit(0)).alias("wal_id"), (F.coalesce(F.max(F.when(F.col("event") != "RM", F.col("id"))), F.lit(0)) + 1).alias("next_id"))


def garbage(listing: DataFrame, events: DataFrame) -> DataFrame:
    """Files of a listing (id) that the manifest does not hold."""
    return listing.select("id").join(active(events).select("id").distinct(), "id", "left_anti")
