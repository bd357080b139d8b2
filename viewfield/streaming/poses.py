"""Pose streams: the latest pose of each emitter, and coverage of each pose as it comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

POSE = ["lon", "lat", "alt", "phi", "theta"]


def latest(poses: DataFrame) -> DataFrame:
    """(emitter_id, ts, pose columns) of the latest pose; of equal times the largest event.  Batch or stream."""
    last = F.max_by(F.struct("ts", *POSE), F.struct("ts", "event_id"))
    return poses.groupBy("emitter_id").agg(last.alias("p")).select("emitter_id", "p.*")


def append_each(poses: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run ``job`` on what the stream holds now and append its rows, each micro-batch to a folder of its own.

    A batch that is run again after a failure replaces its own folder, so no row is doubled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return poses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
