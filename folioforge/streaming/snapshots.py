"""Sightings as a stream: versioned snapshots of the whole view, and keyed state.

A micro-batch appends its sightings and derives the view again as the next version
(complete output); readers get the newest version or learn that theirs is.  Arrival
order is the stored ``seq``, so any cut into batches ends in the batch answer.
There is no watermark: a late sighting only fills gaps or lifts a refusal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Snapshots:
    """A folder with the sightings and each version of the view."""

    def __init__(self, spark: SparkSession, root: str, derive: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.derive = spark, root.rstrip("/"), derive

    def publish(self, batch: DataFrame, batch_id: int) -> None:
        """Append a batch and write version ``batch_id`` + 1; a batch that runs again replaces its own files."""
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.root}/sightings/batch={batch_id}")
        held = spark.read.schema(batch.schema).parquet(*[f"{self.root}/sightings/batch={i}" for i in range(batch_id + 1)])
        self.derive(held).write.mode("overwrite").parquet(f"{self.root}/snapshots/version={batch_id + 1}")

    def start(self, sightings: DataFrame, once: bool = True) -> StreamingQuery:
        w = sightings.writeStream.foreachBatch(self.publish).option("checkpointLocation", f"{self.root}/checkpoint")
        return (w.trigger(availableNow=True) if once else w).start()

    def version(self) -> int:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/snapshots")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max([int(n.split("=")[1]) for n in names if n.startswith("version=")], default=0)

    def since(self, version: int) -> DataFrame | None:
        """The newest snapshot, None if ``version`` is the newest."""
        newest = self.version()
        return self.spark.read.parquet(f"{self.root}/snapshots/version={newest}") if newest > version else None


STATE = "seq long, note string, route string, refused boolean, routes long"
OUTPUT = f"key string, {STATE}"


def keep_state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """First sighting of a key, gaps filled by later ones, the first admission replacing a refusal."""
    if state.hasTimedOut:
        state.remove()
        return
    held = list(state.get) if state.exists else None
    for frame in frames:
        for r in frame.sort_values("seq").itertuples():
            new = [int(r.seq), r.note or None, r.route, bool(r.refused), 1]
            if held is None:
                held = new
                continue
            early, late = (new, held) if new[0] < held[0] else (held, new)
            first = early if early[3] <= late[3] else late
            held = [early[0], early[1] or late[1], first[2], early[3] and late[3], held[4] + 1]
    state.update(tuple(held))
    yield pd.DataFrame([[key[0], *held]], columns=["key", "seq", "note", "route", "refused", "routes"])


def stateful_store(sightings: DataFrame) -> DataFrame:
    """key, seq, note, route, refused of a stream, as records in keyed state (update mode)."""
    return sightings.groupBy("key").applyInPandasWithState(keep_state, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def by_version(held: DataFrame, batches: int) -> DataFrame:
    """(version, rows) of sightings with a ``batch`` number: what each version would hold."""
    v = held.sparkSession.range(batches).withColumnRenamed("id", "version")
    return v.join(held, F.col("batch") <= F.col("version")).groupBy("version").agg(F.count("*").alias("rows"))
