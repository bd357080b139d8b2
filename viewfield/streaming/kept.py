"""Poses kept as state: moves and turns of emitters as they come, and the coverage of those whose pose they change."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.shared import stored

#: A move gives the place and the carrier's heading, a turn the antenna's on it.
MOVED, TURNED = ["lon", "lat", "alt", "phi", "theta"], ["phi", "theta"]
STATE = "move_at long, move_event long, lon double, lat double, alt double, base_phi double, base_theta double, turn_at long, turn_event long, phi double, theta double"
POSE = "emitter_id long, lon double, lat double, alt double, phi double, theta double"
POSED = Row(*(c.split()[0] for c in POSE.split(", ")))
NEVER = (-(1 << 63), -(1 << 63))


def _value(x: float | None) -> float:
    """A null as not a number: a null of the state is a place that never was."""
    return math.nan if x is None else x


class Poses(StatefulProcessor):
    """Of each emitter the latest move and the latest turn by (time, event), in whatever order they come.

    An emitter's pose is given when a batch changes it: late events that are older than what is kept change nothing,
    and an emitter that has not moved yet is nowhere.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getValueState("pose", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = tuple(self._kept.get() or (*NEVER, None, None, None, None, None, *NEVER, 0.0, 0.0))
        moved, turned = held[:7], held[7:]
        for row in rows:
            at = row["at"], row["event_id"]
            if row["kind"] == "move" and at > moved[:2]:
                moved = (*at, *(_value(row[c]) for c in MOVED))
            elif row["kind"] == "turn" and at > turned[:2]:
                turned = (*at, *(_value(row[c]) for c in TURNED))
        if moved + turned != held:
            self._kept.update(moved + turned)
            if moved[2] is not None:
                lon, lat, alt, base_phi, base_theta = moved[2:]
                yield POSED(key[0], *(None if math.isnan(v) else v for v in (lon, lat, alt, base_phi + turned[2], base_theta + turned[3])))

    def close(self) -> None:
        pass


def changed(events: DataFrame) -> DataFrame:
    """(emitter_id, lon, lat, alt, phi, theta) of a stream of events (emitter_id, event_id, ts, kind, MOVED): poses as they change.

    Events come to the state as rows: a frame for each emitter takes many times as long as its few events.
    The state is kept by the RocksDB store, so it is bounded by disks and not by memory.
    """
    rows = events.selectExpr("emitter_id", "event_id", "kind", "unix_micros(ts) AS at", *MOVED)
    return rows.groupBy("emitter_id").transformWithState(Poses(), POSE, "Update", "None")


def latest(events: DataFrame) -> DataFrame:
    """The same of a table of all events: each emitter's pose after them."""
    last = lambda kind, columns: F.max_by(F.when(F.col("kind") == kind, F.struct(*columns)), F.when(F.col("kind") == kind, F.struct("ts", "event_id")))
    rows = events.groupBy("emitter_id").agg(last("move", MOVED).alias("m"), last("turn", TURNED).alias("t")).where("m IS NOT NULL")
    return rows.selectExpr("emitter_id", "m.lon", "m.lat", "m.alt", "m.phi + coalesce(t.phi, 0e0) AS phi", "m.theta + coalesce(t.theta, 0e0) AS theta")


def score_changed(events: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run ``job`` on the poses that each micro-batch changes; its rows go to a folder for each batch, which a repeated run replaces."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(batch: DataFrame, batch_id: int) -> None:
        # stored first: the job reads it more than once, and the state must not be run again for that
        job(stored(batch, "changed")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changed(events).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(rows: DataFrame) -> DataFrame:
    """Of rows (eid, batch, …) of all batches those of each emitter's last: what covers the ground now."""
    last = rows.groupBy("eid").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["eid", "batch"], "left_semi").drop("batch")
