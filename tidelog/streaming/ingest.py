"""Op-logs as streams: appended in micro-batches, or kept as the newest version per key in state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "value string, is_tombstone boolean, lsn long"


def append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what the source has now to a Parquet op-log, exactly once per micro-batch, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _keep_newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    last = state.get if state.exists else (None, True, -1)
    for batch in batches:
        row = batch.loc[batch["lsn"].idxmax()]
        if row["lsn"] > last[2]:
            last = (None if row["is_tombstone"] else row["value"], bool(row["is_tombstone"]), int(row["lsn"]))
    state.update(last)
    yield pd.DataFrame([[key[0], *last]], columns=["key", "value", "is_tombstone", "lsn"])


def newest(stream: DataFrame) -> DataFrame:
    """A stream of each changed key's newest version. An op with a smaller number than the state's changes nothing, however late."""
    own = stream.select("key", "value", "is_tombstone", "lsn")
    return own.groupBy("key").applyInPandasWithState(_keep_newest, f"key string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def fold(updates: DataFrame) -> DataFrame:
    """Live rows of the updates that ``newest`` has written so far."""
    last = updates.groupBy("key").agg(F.max_by(F.struct("value", "is_tombstone", "lsn"), "lsn").alias("last")).select("key", "last.*")
    return last.where(~F.col("is_tombstone")).drop("is_tombstone")
