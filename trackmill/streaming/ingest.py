"""Continuous ingest: new files are found by the checkpoint, steps keep each vehicle's last row as state until it falls silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import geo
from ..sources import readers


def lines(spark: SparkSession, path: str, glob: str = "*-utf.txt") -> DataFrame:
    """Parsed rows of files as they arrive."""
    raw = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return readers.parse_lines(raw).drop("value")


def ingest(parsed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Good rows appended to a table, exactly once."""
    good = parsed.where("reject_reason IS NULL").drop("reject_reason")
    return good.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


#: what the state store must be for stateful processors
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_ROW = "datetime timestamp_ntz, longitude double, latitude double"


def _millis(when: pd.Timestamp) -> int:
    return int(pd.Timestamp(when).value // 1_000_000)


class _InOrder(StatefulProcessor):
    """Holds a vehicle's rows back until no earlier one can come, then gives them out in order, each with the row before it."""

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.last = handle.getValueState("last", _ROW)
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """One timer a vehicle: at its earliest waiting row, else when it has been silent for long enough."""
        if self.timer.exists():
            if (old := self.timer.get()[0]) == at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for part in rows for r in part[["datetime", "longitude", "latitude"]].itertuples(index=False)]
        had = self.waiting.exists()
        self.waiting.appendList([(r[0].to_pydatetime(), r[1], r[2]) for r in new])
        earliest = min(_millis(r[0]) for r in new)
        self._wake(min(earliest, self.timer.get()[0]) if had else earliest)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if _millis(r[0]) <= now], [r for r in rows if _millis(r[0]) > now]
        before = self.last.get() if self.last.exists() else None
        if not rows or (before and ready and _millis(ready[0][0]) - _millis(before[0]) > self.silence):
            self.last.clear()  # silent for too long: the next row is a first one
            before = None
        out = []
        for r in ready:
            if before and _millis(r[0]) - _millis(before[0]) > self.silence:
                before = None
            out.append((key[0], *r, before[1] if before else None, before[2] if before else None, before[0] if before else None))
            before = r
        if rows:
            self.waiting.put(rest) if rest else self.waiting.clear()
            if ready:
                self.last.update(tuple(ready[-1]))
            self._wake(min(_millis(r[0]) for r in rest) if rest else _millis(ready[-1][0]) + self.silence)
        if out:
            yield pd.DataFrame(out, columns=["plate_number", "datetime", "longitude", "latitude", "_lon", "_lat", "_before"])

    def close(self) -> None:
        pass


def steps(parsed: DataFrame, tolerance: float = 1e-5, *, late: str = "10 minutes", silence: str = "1 hour") -> DataFrame:
    """Each row's distance on the ellipsoid and time from its vehicle's row before, whether it moved further than the tolerance; as the batch operator gives them, in whatever order rows come.

    Rows wait until the watermark, `late` behind the latest time seen, has passed them; rows that come later than
    that are dropped. A vehicle without a row for `silence` is forgotten, and its next row is a first one.
    Equal times are in the order of their places. The session's state store must be PROVIDER.
    """
    session = parsed.sparkSession
    if session.conf.get(PROVIDER[0], None) != PROVIDER[1]:
        raise ValueError(f"stateful steps need {PROVIDER[0]} = {PROVIDER[1]}")
    # a wall clock has no zone; as an event's time it is read as UTC
    clock = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("datetime")).cast("timestamp")
    good = parsed.where("reject_reason IS NULL").select("plate_number", "datetime", "longitude", "latitude", clock.alias("event_time")).withWatermark("event_time", late)
    pause = int(pd.Timedelta(silence).total_seconds() * 1000)
    held = good.groupBy("plate_number").transformWithStateInPandas(_InOrder(pause), f"plate_number string, {_ROW}, _lon double, _lat double, _before timestamp_ntz", "Append", "EventTime")
    out = geo.with_ellipsoid(held, "step_m", "_lat", "_lon", "latitude", "longitude")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    moved = F.col("_lat").isNull() | (F.abs(F.col("longitude") - F.col("_lon")) > tolerance) | (F.abs(F.col("latitude") - F.col("_lat")) > tolerance)
    step_ms = F.coalesce((micros("datetime") - micros("_before")) / 1000, F.lit(0)).cast("long")
    return out.select("plate_number", "datetime", "longitude", "latitude", F.coalesce("step_m", F.lit(0.0)).alias("step_m"), step_ms.alias("step_ms"), moved.alias("kept"))
