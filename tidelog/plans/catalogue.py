"""Named queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import columns
from tidelog.operators import faults, levels, manifest, raftlog, resolve
from tidelog.plans.fixtures import manifest_events, oplog, rlog
from tidelog.plans.oracles import ORACLES as ORACLES
from tidelog.sources import wal
from tidelog.sources.files import fresh_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _live(spark: SparkSession, d: str) -> DataFrame:
    return resolve.live(resolve.newest(oplog(spark, d)))


@_query
def live_view(spark, d):
    return _live(spark, d)


@_query
def range_scan(spark, d):
    return resolve.live(resolve.newest(resolve.in_range(oplog(spark, d), "user:000010", "user:000020"))).select("key", "value")


@_query
def keys_only_scan(spark, d):
    return _live(spark, d).select("key")


@_query
def snapshot_at(spark, d):
    return resolve.live(resolve.newest(resolve.as_of(oplog(spark, d), 5000))).select("key", "value")


@_query
def point_get(spark, d):
    return resolve.lookup(oplog(spark, d), ["user:000003", "user:000007", "user:999999"])


@_query
def batch_lww(spark, d):
    return resolve.newest(oplog(spark, d), by=["batch_id", "key"], order="op_idx", carry=("value", "is_tombstone"))


@_query
def flush(spark, d):
    return levels.flush(oplog(spark, d))


@_query
def compact(spark, d):
    return levels.compact(oplog(spark, d).where("file_id < 8"))


@_query
def tomb_gc(spark, d):
    return levels.purged(oplog(spark, d).where("file_id < 8"))


@_query
def table_stats(spark, d):
    return levels.run_stats(oplog(spark, d))


@_query
def wal_bytes(spark, d):
    return levels.log_bytes(oplog(spark, d))


@_query
def read_amp(spark, d):
    return levels.read_cost(oplog(spark, d))


@_query
def version_count(spark, d):
    return levels.versions(oplog(spark, d))


@_query
def scan_flat(spark, d):
    return resolve.flat_reply(_live(spark, d))


@_query
def level_get(spark, d):
    return resolve.live(resolve.newest(oplog(spark, d), order=["file_id", "lsn"]))


@_query
def block_index(spark, d):
    return levels.block_index(oplog(spark, d))


@_query
def bloom_probe(spark, d):
    customer = spark.read.parquet(f"{d}/customer.parquet")
    probes = customer.select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return resolve.missing(probes, oplog(spark, d))


@_query
def saturation(spark, d):
    return levels.saturated(oplog(spark, d))


@_query
def manifest_replay(spark, d):
    return manifest.active(manifest_events(oplog(spark, d)))


@_query
def manifest_watermark(spark, d):
    lines = manifest_events(oplog(spark, d)).select("seq", F.concat_ws(",", "event", "level", "id").alias("line"))
    mark = spark.createDataFrame([(50, "WAL,8"), (51, "NOTE,1"), (52, "ADD,x")], "seq int, line string")
    return manifest.watermark(manifest.parse(lines.unionByName(mark)))


@_query
def compaction_pick(spark, d):
    return levels.pick_inputs(manifest.active(manifest_events(oplog(spark, d)))).select("level", F.col("id").cast("long").alias("id"))


@_query
def startup_gc(spark, d):
    ops = oplog(spark, d)
    files = ops.select("file_id").distinct()
    listing = files.select(F.col("file_id").alias("id")).unionByName(files.select((100 + F.col("file_id")).alias("id"))).unionByName(spark.createDataFrame([(999,)], "id int"))
    return manifest.garbage(listing, manifest_events(ops))


@_query
def wal_replay(spark, d):
    ops = oplog(spark, d)
    names = ["key", "value", "is_tombstone", "lsn"]
    return resolve.live(resolve.newest(ops.where("file_id >= 8").select(names).unionByName(levels.flush(ops.where("file_id < 8")).select(names))))


@_query
def wal_torn(spark, d):
    return levels.torn(oplog(spark, d), "lsn % 1000 = 700").select("lsn", "key", "file_id")


@_query
def wal_crc(spark, d):
    ops = oplog(spark, d)
    back = wal.decoded(wal.encoded(ops)).join(ops.select("lsn", F.col("key").alias("k"), F.col("value").alias("v"), F.col("is_tombstone").alias("t")), "lsn")
    same = F.col("ok") & (F.col("key").cast("string") == F.col("k")) & F.col("value").cast("string").eqNullSafe(F.col("v")) & (F.col("is_tombstone") == F.col("t"))
    return back.agg(F.count("*").alias("records"), F.count_if(~same).cast("int").alias("bad"))


@_query
def raft_range(spark, d):
    return raftlog.entries(rlog(spark, d), 100, 199).select("idx", raftlog.log_key().alias("log_key"), "term", "kind")


@_query
def raft_last(spark, d):
    return raftlog.last_entry(rlog(spark, d))


@_query
def raft_truncate(spark, d):
    return raftlog.truncate(rlog(spark, d), 12000).select("idx", "term", "kind")


@_query
def raft_purge(spark, d):
    return raftlog.purge(rlog(spark, d), 3000).select("idx", "term", "kind")


@_query
def raft_apply(spark, d):
    return raftlog.apply(rlog(spark, d))


@_query
def raft_responses(spark, d):
    return raftlog.responses(rlog(spark, d))


@_query
def raft_snapshot(spark, d):
    return raftlog.snapshot(rlog(spark, d), 10000)


@_query
def raft_install(spark, d):
    log = rlog(spark, d)
    meta = log.select(F.concat(F.lit("meta:"), "kind").alias("key"), F.lit(None).cast("string").alias("value")).distinct()
    return raftlog.install(meta.unionByName(raftlog.apply(log)), raftlog.snapshot(log, 10000))


@_query
def raft_wiped(spark, d):
    log = rlog(spark, d)
    return raftlog.wiped(raftlog.apply(log), raftlog.apply(log, 10000))


@_query
def convergence(spark, d):
    """Three replicas that have applied the log up to different places."""
    ops = oplog(spark, d)
    return raftlog.diverging(*(resolve.newest(resolve.as_of(ops, upto)) for upto in (9000, 9500, 10**12)))


@_query
def commit_index(spark, d):
    last = rlog(spark, d).groupBy("term").agg(F.max("idx").alias("m"))
    matches = last.unionByName(last.withColumn("m", F.col("m") - 3)).unionByName(last.withColumn("m", F.col("m") - 50))
    return raftlog.committed(matches)


@_query
def leader_count(spark, d):
    """One node per term leads, but for every 1,000th report of the third term; followers report too."""
    other = (F.col("term") == 3) & (F.col("idx") % 1000 == 7)
    reports = rlog(spark, d).select("term", F.when(other, 5).otherwise(F.col("term") % 3).alias("node_id"), (F.col("idx") % 2 == 1).alias("is_leader"))
    return raftlog.leaders(reports)


@_query
def fault_actions(spark, d):
    """Each op as a message between five nodes, under rules of every kind."""
    rules = [(1, "partition", 0, 1, None, None, None), (2, "delay", 1, 2, None, 40, None), (3, "random_delay", 1, 2, None, 10, 30), (4, "drop", 2, 3, 0.25, None, None), (5, "duplicate", 2, 3, 0.5, None, None), (6, "delay", 3, 4, None, 7, None)]
    messages = oplog(spark, d).select(F.col("lsn").alias("seq"), (F.col("lsn") % 5).alias("src"), (F.floor(F.col("lsn") / 5) % 5).alias("dst"))
    return faults.actions(messages, spark.createDataFrame(rules, faults.RULES), seed=11)


@_query
def metrics(spark, d):
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + levels.RECORD_BYTES
    dead = F.col("is_tombstone").cast("long")
    return oplog(spark, d).agg(F.count("*").alias("total_ops"), F.sum(1 - dead).alias("puts"), F.sum(dead).alias("deletes"), F.sum(size).cast("long").alias("wal_bytes"))


@_query
def resp_encode(spark, d):
    return oplog(spark, d).where("not is_tombstone").select("lsn", columns.command(F.lit("SET"), F.col("key"), F.col("value")).alias("wire"))


@_query
def resp_roundtrip(spark, d):
    return columns.decoded(resp_encode(spark, d))


@_query
def resp_dispatch(spark, d):
    """Ops as requests, every seventh of them not as it should be, and the replies to them."""
    lsn, key, put = F.col("lsn"), F.col("key"), columns.command(F.lit("set"), F.col("key"), F.col("value"))
    wire = F.when(lsn % 70 == 6, F.lit("+PING\r\n")).when(lsn % 70 == 13, F.lit("*0\r\n")).when(lsn % 70 == 20, columns.command(F.lit("SET"), key)).when(lsn % 70 == 27, columns.command(F.lit("Nope"), key))
    wire = wire.when(lsn % 70 == 34, columns.command(F.lit("DEL"), key, key)).when(lsn % 70 == 41, columns.command(F.lit("SET"), key, F.lit(None))).when(lsn % 70 == 48, columns.command(F.lit("SCAN"), key))
    wire = wire.when(lsn % 70 == 55, F.lit("hello")).when(lsn % 70 == 62, columns.command(F.lit("PING")))
    return columns.replies(oplog(spark, d).select("lsn", wire.when(F.col("is_tombstone"), columns.command(F.lit("DEL"), key)).otherwise(put).alias("wire")))


def _stream_input(spark: SparkSession, d: str, folder: str) -> DataFrame:
    rows = oplog(spark, d).select("key", "value", "is_tombstone", "lsn")
    rows.repartition(4).write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")


@_query
def stream_lww(spark, d):
    from tidelog.streaming import ingest

    folder = fresh_dir(spark, "stream")
    ingest.append(_stream_input(spark, d, folder), f"{folder}/log", f"{folder}/state")
    return resolve.live(resolve.newest(spark.read.parquet(f"{folder}/log")))


@_query
def stream_stateful_lww(spark, d):
    from tidelog.streaming import ingest

    folder = fresh_dir(spark, "stream")
    updates = ingest.newest(_stream_input(spark, d, folder))
    sink = updates.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    # a batch that is tried again replaces itself
    sink.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).start().awaitTermination()
    return ingest.fold(spark.read.parquet(f"{folder}/out"))


@_query
def store_live(spark, d):
    """The table facade: bulk ingestion in two runs, compaction, and the live view of the current version."""
    from tidelog.store import Store

    ops = oplog(spark, d)
    half = ops.agg((F.max("lsn") / 2).cast("long")).first()[0] or 0
    store = Store.open(spark, fresh_dir(spark, "store"))
    store.ingest(ops.where(F.col("lsn") <= half))
    base = store.snapshot().lsn
    store.ingest(ops.where(F.col("lsn") > half).withColumn("lsn", F.col("lsn") - base))
    store.compact(force=True)
    store.close()
    return store.live().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "lsn")
