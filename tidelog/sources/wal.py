"""Log files of little-endian records: crc32, lsn, key length, key, tombstone flag, value length, value.

The CRC covers everything behind it. The flag has a second bit, set in all records of a batch but the last one: a
batch is read whole or not at all, and a batch of one op looks as if there were no batches. A file is read up to its first bad or incomplete record; later files are still
read. Batch reads go through Spark's ``binaryFile`` source, so any store that Spark can read will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the flag: the record deletes its key; the next record belongs to the same batch.
DEAD, MORE = 1, 4
HEAD = struct.Struct("<IQI")
RECORD = "lsn long, key binary, value binary, is_tombstone boolean"


def encode(lsn: int, key: bytes, value: bytes | None, more: bool = False) -> bytes:
    """One record; a value of None is a tombstone. more: another record of the batch follows."""
    own = value or b""
    body = struct.pack("<QI", lsn, len(key)) + key + struct.pack("<BI", DEAD * (value is None) | MORE * more, len(own)) + own
    return struct.pack("<I", zlib.crc32(body)) + body


def decode(data: bytes) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(lsn, key, value) of the whole batches before the first record that is cut short or fails its CRC."""
    at, batch = 0, []
    while at + HEAD.size <= len(data):
        crc, lsn, n = HEAD.unpack_from(data, at)
        value_at = at + HEAD.size + n + 5
        if value_at > len(data):
            return
        flag, m = struct.unpack_from("<BI", data, value_at - 5)
        if value_at + m > len(data) or zlib.crc32(data[at + 4 : value_at + m]) != crc:
            return
        batch.append((lsn, data[at + HEAD.size : value_at - 5], None if flag & DEAD else data[value_at : value_at + m]))
        at = value_at + m
        if not flag & MORE:
            yield from batch
            batch = []


def _little(number: Column, size: int) -> Column:
    digits = F.lpad(F.hex(number), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * size - 1 - 2 * i, 2) for i in range(size))))


def encoded(ops: DataFrame) -> DataFrame:
    """(lsn, record): each op as a log record, by expressions only."""
    key, value = F.col("key").cast("binary"), F.coalesce(F.when(~F.col("is_tombstone"), F.col("value").cast("binary")), F.lit(b""))
    flag = F.when(F.col("is_tombstone"), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    body = F.concat(_little(F.col("lsn"), 8), _little(F.octet_length(key), 4), key, flag, _little(F.octet_length(value), 4), value)
    return ops.select("lsn", body.alias("body")).select("lsn", F.concat(_little(F.crc32("body"), 4), "body").alias("record"))


def decoded(records: DataFrame) -> DataFrame:
    """(lsn, key, value, is_tombstone, ok): record columns read back by expressions only."""
    number = lambda c, at, size: F.conv(F.concat(*(F.hex(F.substring(c, at + size - 1 - i, 1)) for i in range(size))), 16, 10).cast("long")
    body = F.expr("substring(record, 5, length(record) - 4)")
    out = records.withColumns({"crc": number(F.col("record"), 1, 4), "n": number(F.col("record"), 13, 4).cast("int"), "ok": F.crc32(body)})
    out = out.withColumns({"key": F.col("record").substr(F.lit(17), F.col("n")), "dead": F.hex(F.col("record").substr(F.col("n") + 17, F.lit(1))) == "01", "rest": F.col("record").substr(F.col("n") + 22, F.length("record"))})
    return out.select("lsn", "key", F.when(~F.col("dead"), F.col("rest")).alias("value"), F.col("dead").alias("is_tombstone"), (F.col("crc") == F.col("ok")).alias("ok"))


def read(spark: SparkSession, path: str, watermark: int = 0) -> DataFrame:
    """(file_id, lsn, key, value, is_tombstone) of the folder's ``<id>.wal`` files with id >= watermark."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                found = [(file_id, lsn, key, value, value is None) for lsn, key, value in decode(bytes(content))]
                yield pd.DataFrame(found, columns=["file_id", "lsn", "key", "value", "is_tombstone"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path)
    named = files.select(F.regexp_extract("path", r"([0-9]+)\.wal$", 1).cast("long").alias("file_id"), "content").where(F.col("file_id") >= watermark)
    return named.mapInPandas(rows, f"file_id long, {RECORD}")
