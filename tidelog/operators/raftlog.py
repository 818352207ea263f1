"""A replicated log as a table: idx, term, kind (PUT, DELETE, BLANK), key, value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.resolve import newest

PREFIX = "data:"


def log_key(idx: str = "idx"):
    """The key of a log entry in the store: decimal, 20 digits, so byte order is index order."""
    return F.concat(F.lit("log:"), F.lpad(F.col(idx).cast("string"), 20, "0"))


def entries(log: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Entries with start <= idx <= end; None is unbounded; none if start > end."""
    if start is not None:
        log = log.where(F.col("idx") >= start)
    return log if end is None else log.where(F.col("idx") <= end)


def last_entry(log: DataFrame) -> DataFrame:
    return log.agg(F.max_by("term", "idx").alias("term"), F.max("idx").alias("idx")).where("idx is not null")


def truncate(log: DataFrame, idx: int) -> DataFrame:
    """The log without entries from idx on."""
    return log.where(F.col("idx") < idx)


def purge(log: DataFrame, idx: int) -> DataFrame:
    """The log without entries up to idx."""
    return log.where(F.col("idx") > idx)


def apply(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(key, value) of the state machine after the entries up to an index. Blank entries change nothing."""
    own = entries(log, None, upto).where("kind <> 'BLANK'")
    last = newest(own, order="idx", carry=("value", "kind")).where("kind = 'PUT'")
    return last.select(F.concat(F.lit(PREFIX), "key").alias("key"), "value")


def responses(log: DataFrame) -> DataFrame:
    """(idx, reply) of each applied entry: a command echoes its payload, others answer with nothing."""
    return log.select("idx", F.when(F.col("kind") == "BLANK", F.lit("")).otherwise(F.concat_ws(" ", "kind", "key", "value")).alias("reply"))


def snapshot(log: DataFrame, upto: int) -> DataFrame:
    """(key, value, cnt): the state at an index, with the count that heads the snapshot."""
    state = apply(log, upto)
    return state.crossJoin(F.broadcast(state.agg(F.count("*").alias("cnt"))))  # one row


def install(state: DataFrame, snap: DataFrame) -> DataFrame:
    """The state after installing a snapshot: its rows; every other ``data:`` key is wiped, other keyspaces stay."""
    rest = state.where(~F.col("key").startswith(PREFIX))
    return rest.select("key", "value").unionByName(snap.select("key", "value"))


def wiped(state: DataFrame, snap: DataFrame) -> DataFrame:
    """Keys that an installation deletes."""
    return state.where(F.col("key").startswith(PREFIX)).select("key").join(snap.select("key"), "key", "left_anti")


def diverging(*replicas: DataFrame) -> DataFrame:
    """Keys on whose visible value some replica differs from another. replicas: resolved rows of each.

    A replica that lacks a key, or has deleted it, shows nothing. One aggregate over all replicas' keys tells.
    """
    seen = [r.where(~F.col("is_tombstone")).select("key", "value") for r in replicas]
    all_of = seen[0]
    for other in seen[1:]:
        all_of = all_of.unionByName(other)
    found = all_of.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return found.where((F.col("n") < len(seen)) | (F.col("lo") != F.col("hi"))).select("key")


def committed(matches: DataFrame) -> DataFrame:
    """(term, committed): the largest index that a majority of each term's replicas has reached. matches: one row per replica and term."""
    by_term = Window.partitionBy("term")
    own = matches.withColumns({"rn": F.row_number().over(by_term.orderBy(F.desc("m"))), "n": F.count("*").over(by_term)})
    return own.where(F.col("rn") == F.floor(F.col("n") / 2) + 1).select("term", F.col("m").alias("committed"))


def leaders(reports: DataFrame) -> DataFrame:
    """(term, leaders): distinct nodes that called themselves leader; more than one is a safety violation."""
    return reports.where("is_leader").groupBy("term").agg(F.count_distinct("node_id").alias("leaders"))
