"""Web archives: a WARC writer and a reader by boundary-chain verification.

Writing: each page becomes one record. Of pages with equal payloads the one with the smallest id is a response, the
others are revisits that name it. Records are written by Spark's text writer with the records' terminator as its
line separator, so the files are plain WARC and no executor opens a file itself.

Reading: splits of the files are cut at every occurrence of the record magic, inside payloads too. Tasks turn each
piece into a candidate: its offset in the file (running sums of piece lengths within a split, and of splits within
a file) and the offset of its successor (header and Content-Length). Stretches of candidates whose successor is just
the next one are one run, so chains are short; pointer jumping over runs from each file's start then keeps what is
reachable. Magic inside payloads never is. Payloads are put together from the pieces that a record spans.

Defined results: a null or empty html is an empty payload; a page without an id has a record without a number, which
revisits the page with the smallest id that has its payload and is a response if there is none; rows that repeat an id
give a record each (of equal payloads and ids too: all responses, if no smaller id has that payload).
An empty table writes and reads nothing. Other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.cluster import cut, saved, shared_dir, table, text_of

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def with_digest(df: DataFrame, payload: Column, name: str = "digest") -> DataFrame:
    """df and a column with the bare upper-case base32 of the SHA-1 of the payload; null of null.

    In steps of one column each, so that the SHA-1 is made once and not for each of the 32 letters.
    """
    df = df.withColumn("_hex", F.sha1(payload))
    df = df.withColumns({f"_n{i}": F.conv(F.substring("_hex", 10 * i + 1, 10), 16, 10).cast("long") for i in range(4)})
    letter = lambda n, k: F.substring(F.lit(ALPHABET), F.shiftright(n, 35 - 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1))
    made = F.concat(*(letter(f"_n{i}", k) for i in range(4) for k in range(8)))
    return df.withColumn(name, made).drop("_hex", *(f"_n{i}" for i in range(4)))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, record): each page as the text of a WARC record without its terminator."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text_of("html").alias("html"))
    own = own.withColumns({"sha": F.unhex(F.sha1(F.col("html").cast("binary"))), "bytes": F.octet_length("html")})
    small = saved(own.where(F.col("bytes") >= least_bytes).select("page_id", "sha"))
    first = small.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").drop("n")
    again = saved(small.join(first, "sha").where("page_id is null or first_id < page_id").distinct().select(F.col("sha").alias("_sha"), F.col("page_id").alias("_id"), "first_id"))
    own = own.join(again, (F.col("sha") == F.col("_sha")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")  # pages stay where they are if the planner finds the revisits few
    own = with_digest(own, F.col("html").cast("binary"))
    revisit = F.col("first_id").isNotNull()
    body = F.when(revisit, "").otherwise(F.col("html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    head = [
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))).otherwise(""),
        line("Content-Length", F.octet_length(body)),
        F.lit("\r\n"),
    ]
    return own.select("page_id", F.concat(F.lit(MAGIC), *head, body).alias("record"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write the pages as uncompressed WARC files in the folder path."""
    records(pages, least_bytes).select("record").write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, split): the files' bytes between magics. The first piece of a file stands before its first magic."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per occurrence of the magic: file, split, its offset ``at``, its successor's offset ``succ`` (null if no
    header follows), header fields, and length and digest of the payload if that ends with the piece (``whole``)."""
    piece = _pieces(spark, path)
    head = F.substring_index("value", END, 1)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}: *<?([^\r\n>]*)", 1), F.lit(""))
    piece = piece.withColumns({"head": head, "order": F.monotonically_increasing_id(), "size": F.octet_length("value").cast("long") + len(MAGIC)})
    piece = piece.withColumns({"begin": F.octet_length("head").cast("long") + len(END), "length": F.expr("try_cast(regexp_extract(head, '(?im)^Content-Length: *([0-9]+)', 1) as bigint)")})
    piece = piece.withColumn("length", F.when(F.col("begin") + len(MAGIC) <= F.col("size"), F.col("length")))
    body = F.col("value").cast("binary").substr(F.col("begin").cast("int") + 1, F.least("length", F.lit((1 << 31) - 1)).cast("int"))
    piece = piece.withColumns({"whole": F.coalesce(F.col("begin") + F.col("length") + len(END) + len(MAGIC) == F.col("size"), F.lit(False))})
    piece = with_digest(piece, F.when(F.col("whole"), body))
    small = piece.select(
        "file", "split", "order", "size", F.xxhash64("value").alias("hash"), "whole", "begin", "length",
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("refers"), field("WARC-Payload-Digest").alias("stated"),
        "digest",
    )
    small = cut(small)
    totals = small.groupBy("file", "split").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "split", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("file", "split").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    placed = small.withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0))).join(bases, ["file", "split"])
    placed = placed.withColumn("at", F.col("base") + F.col("inside") - len(MAGIC)).drop("base", "inside", "order")
    return placed.where("at >= 0").withColumn("succ", F.col("at") + len(MAGIC) + F.col("begin") + F.col("length") + len(END))


def reachable(found: DataFrame) -> DataFrame:
    """The candidates (file, split, at, succ and more) that the chain from offset 0 of their file reaches."""
    by_place = Window.partitionBy("file", "split").orderBy("at")
    linked = found.where("succ is not null").withColumn("adjacent", F.coalesce(F.col("succ") == F.lead("at").over(by_place), F.lit(False)))
    targets = linked.where("not adjacent").select("file", F.col("succ").alias("at"), F.lit(True).alias("target")).distinct()
    marked = linked.join(targets, ["file", "at"], "left")
    starts = F.coalesce("target", F.lit(False)) | ~F.coalesce(F.lag("adjacent").over(by_place), F.lit(False))
    runs = cut(marked.withColumn("start", F.when(starts, F.col("at"))).withColumn("run", F.last("start", ignorenulls=True).over(by_place)).drop("adjacent", "target", "start"))
    jump = cut(runs.groupBy("file", "run").agg(F.max("succ").alias("exit")))
    reach = cut(jump.where("run = 0").select("file", "run"))
    heads, n = jump.select("file", "run"), reach.count()
    while n:
        new = reach.join(jump, ["file", "run"]).select("file", F.col("exit").alias("run")).join(heads, ["file", "run"], "left_semi")
        reach = cut(reach.unionByName(new).distinct())
        now = reach.count()
        if now == n:
            break
        n = now
        jump = cut(jump.join(jump.select("file", F.col("run").alias("exit"), F.col("exit").alias("beyond")), ["file", "exit"]).select("file", "run", F.col("beyond").alias("exit")))
    return runs.join(reach, ["file", "run"], "left_semi")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives in the folder path: ids, type, and length and digest of the payload as read.

    A revisit has the length and digest of the payload of the response that it names.
    """
    found = candidates(spark, path)
    kept = cut(reachable(found))
    if not (parts := kept.where("not whole")).isEmpty():
        kept = kept.where("whole").unionByName(_assembled(spark, path, found, parts), allowMissingColumns=True)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([0-9-]+)$', 1) as bigint)")
    own = kept.select(page("record_id").alias("page_id"), "record_type", page("refers").alias("refers_to"), F.substring_index("stated", ":", -1).alias("stated"), "length", "digest")
    full = own.where("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("digest").alias("of_digest")).agg(F.max("length").alias("of_length"))
    joined = own.join(full, (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("of")) & (F.col("stated") == F.col("of_digest")), "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id", F.when(revisit, F.col("of_length")).otherwise(F.col("length")).alias("payload_bytes"), F.when(revisit, F.col("of_digest")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to"
    )


def _assembled(spark: SparkSession, path: str, found: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of parts (records that span pieces) with the digest of the payload, put together from the pieces."""
    stretch = F.explode(F.sequence(F.shiftright("at", 20), F.shiftright("succ", 20))).alias("stretch")  # a range join by MiB of the file
    spanned = parts.select("file", F.col("at").alias("first"), "succ", "begin", "length", stretch)
    spanned = spanned.join(found.select("file", "at", "hash", F.shiftright("at", 20).alias("stretch")), ["file", "stretch"]).where("at >= first and at < succ")
    wanted = cut(spanned.select("file", "first", "begin", "length", "at", "hash"))
    values = _pieces(spark, path).withColumn("hash", F.xxhash64("value")).join(wanted.select("hash").distinct(), "hash", "left_semi")
    values = values.groupBy("hash").agg(F.first(F.col("value").cast("binary")).alias("value"))
    whole = wanted.join(values, "hash").groupBy("file", "first", "begin", "length").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("own"))
    text = F.aggregate(F.slice("own", 2, F.size("own")), F.col("own")[0]["value"], lambda so_far, x: F.concat(so_far, F.lit(MAGIC.encode()), x["value"]))
    body = text.substr(F.col("begin").cast("int") + 1, F.col("length").cast("int"))
    digest = with_digest(whole, body, "made").select("file", F.col("first").alias("at"), "made")
    return parts.join(digest, ["file", "at"]).withColumn("digest", F.col("made")).drop("made")


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages' records after a round trip through archives in the shared folder, which are removed at the end."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least_bytes)
    out = cut(read(spark, path))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return out


def op6_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


QUERIES = {"op6_web_archive": op6_web_archive}
ORACLES = {
    "op6_web_archive": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as x from pages),
d as (select page_id, n, x, min(page_id) over (partition by x) as f from p)
select page_id, n as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(x, cast(10 * (i // 8) + 1 as bigint), 10) as bigint) >> (35 - 5 * (i % 8))) & 31 as bigint), 1) for i in range(32)], '') as payload_digest,
  case when f < page_id or page_id is null and f is not null then 'revisit' else 'response' end as record_type,
  case when f < page_id or page_id is null then f end as refers_to
from d
"""
}
