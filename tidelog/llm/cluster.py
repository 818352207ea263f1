"""What every operator needs from the session: shipped code, durable cut points and bounded sizes."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.files import shared_dir

_SHIPPED = "tidelog.llm.shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that workers can import it from any folder."""
    if spark.conf.get(_SHIPPED, "") == spark.sparkContext.applicationId:
        return
    top = Path(__file__).resolve().parents[1]
    fd, path = tempfile.mkstemp(prefix="tidelog-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, f"{top.name}/{file.relative_to(top)}")
    spark.sparkContext.addPyFile(path)
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder, with their lineage cut: a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of the tables that ``saved`` wrote, by the identity of the DataFrame that reads them.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def saved(df: DataFrame) -> DataFrame:
    """The rows of df, written as a table in the shared folder: as durable as ``cut``, and the planner knows the size."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read any more."""
    for df in tables:
        if path := _FOLDERS.pop(df, None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, instead of when the driver next happens to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text"):
    """The column as a string, a null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
