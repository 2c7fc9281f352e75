"""Rolling features of a stream in event-time order, whatever order the readings come in."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from bladewatch.constants import PCT_CHANGE_FLOOR, ROLLING_WINDOW
from bladewatch.streaming.telemetry import _moments

# state; workers have no session that could read a schema's text
SLOT = StructType([StructField("slot", LongType())])
_READINGS = [
    StructField("at", ArrayType(LongType())), StructField("event_id", ArrayType(LongType())),
    StructField("reading", ArrayType(DoubleType()))]
READINGS = StructType(_READINGS)
ENGINE = StructType([
    *_READINGS, StructField("recent", ArrayType(DoubleType())), StructField("last", LongType()), StructField("timer", LongType()),
    StructField("dealt", BooleanType())])

ORDERED_SCHEMA = ("engine_id bigint, event_id bigint, at timestamp, rolling_mean double, rolling_std double, "
                  "diff double, pct_change double")
SLOT_SECONDS = 60
IDLE_SECONDS = 30 * 24 * 3600
FEW = 100_000  # readings of an engine that a call holds at once
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks_db(spark: SparkSession) -> None:
    """State outside the JVM's heap, as the processors here need it."""
    spark.conf.set(STORE_KEY, ROCKS_DB)


class OrderedRolling(StatefulProcessor):
    """Holds readings back by time slot until the watermark has passed the slot, then takes them in order.

    State of an engine, one value that a call reads and writes once: its open readings, the last ``window`` readings taken, the
    end of the last slot taken, and the one timer that is set, for its next slot or for its end. Beyond ``few`` open readings
    they are dealt to a map by slot, until none is open, and a call holds one slot of one engine at a time. After ``idle`` seconds
    of event time without readings an engine's window starts anew, and its state is dropped.
    """

    def __init__(self, window: int, slot: int, idle: int, few: int = FEW):
        self.window, self.slot, self.idle, self.few = window, slot * 1000, idle * 1000, few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.engine = handle.getValueState("engine", ENGINE)
        self.open = handle.getMapState("open", SLOT, READINGS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, recent, last, timer, dealt = self._state()
        first = None
        for part in rows:
            us = part["at"].astype("datetime64[us]").astype("int64").to_numpy()
            if not len(us):
                continue
            slot = int(us.min()) // 1000 // self.slot
            first = slot if first is None else min(first, slot)
            new = us.tolist(), part["event_id"].to_numpy().tolist(), part["reading"].astype(float).to_numpy().tolist()
            held = tuple([*a, *b] for a, b in zip(held, new))
            if dealt or len(held[0]) > self.few:
                dealt = True
                self._deal(held)
                held = ([], [], [])
        if first is not None:
            end = (first + 1) * self.slot
            if timer is None or end < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                timer = self._set(end)
            self.engine.update((*held, recent, last, timer, dealt))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, recent, last, _, dealt = self._state()
        if dealt:
            slots = sorted(k[0] for k in self.open.keys())
            later = [s for s in slots if (s + 1) * self.slot > now]
            for slot in slots[:len(slots) - len(later)]:
                out, recent, last = self._taken(key, self.open.getValue((slot,)), recent, last)
                yield out
                self.open.removeKey((slot,))
        else:
            slots = np.array(held[0], np.int64) // 1000 // self.slot
            closed = (slots + 1) * self.slot <= now
            later = slots[~closed].tolist()
            if closed.any():
                out, recent, last = self._taken(key, [list(compress(v, closed)) for v in held], recent, last)
                yield out
                held = tuple(list(compress(v, ~closed)) for v in held)
        end = now if last is None else last
        if later:
            self.engine.update((*held, recent, last, self._set((min(later) + 1) * self.slot), dealt))
        elif end + self.idle < now:
            self.engine.clear()
        else:
            self.engine.update((*held, recent, last, self._set(end + self.idle + 1), False))

    def _state(self) -> tuple:
        """Open readings, last readings taken, end of the last slot, timer, and whether the open ones are in the map."""
        if not self.engine.exists():
            return ([], [], []), [], None, None, False
        at, event_id, reading, *rest = self.engine.get()
        return (at, event_id, reading), *rest

    def _deal(self, readings: tuple) -> None:
        slots = np.array(readings[0], np.int64) // 1000 // self.slot
        for slot in np.unique(slots).tolist():
            here = slots == slot
            held = self.open.getValue((slot,)) if self.open.containsKey((slot,)) else ([], [], [])
            self.open.updateValue((slot,), tuple([*a, *compress(b, here)] for a, b in zip(held, readings)))

    def _set(self, time: int) -> int:
        self.handle.registerTimer(time)
        return time

    def _taken(self, key, readings, recent: list, last: int | None) -> tuple[pd.DataFrame, list, int]:
        """Results of closed slots' readings, the last readings, and the end of the last slot."""
        at, event_id, reading = readings
        rows = pd.DataFrame({"us": at, "event_id": event_id, "reading": np.array(reading, float)})
        rows = rows.drop_duplicates(["us", "event_id"]).sort_values(["us", "event_id"], kind="stable")
        starts = rows["us"].to_numpy() // 1000 // self.slot * self.slot
        ends = [starts[0] if last is None else last, *(starts[:-1] + self.slot)]
        cuts = np.flatnonzero(starts - ends > self.idle)  # the window starts anew here
        values, parts = rows["reading"].to_numpy(), []
        for low, high in pairwise([0, *cuts[cuts > 0].tolist(), len(rows)]):
            kept = [] if low in cuts else [float("nan") if v is None else v for v in recent]
            series = np.array([*kept, *values[low:high]], float)
            mean, std = _moments(series, self.window)
            diff = np.diff(series, prepend=series[0])
            before = np.concatenate([[np.nan], series[:-1]])
            with np.errstate(invalid="ignore", divide="ignore"):
                change = np.where(np.abs(before) > PCT_CHANGE_FLOOR, diff / np.abs(before) * 100.0, 0.0)
            parts.append([v[len(kept):] for v in (mean, std, np.nan_to_num(diff), np.nan_to_num(change))])
            recent = series[-self.window:].tolist()
        mean, std, diff, change = (np.concatenate(v) for v in zip(*parts))
        return pd.DataFrame({
            "engine_id": np.int64(key[0]), "event_id": rows["event_id"].to_numpy(),
            "at": pd.to_datetime(rows["us"].to_numpy(), unit="us"), "rolling_mean": mean, "rolling_std": std,
            "diff": diff, "pct_change": change}), recent, int(starts[-1]) + self.slot


def ordered_rolling_stream(readings: DataFrame, delay: str = "10 minutes", window: int = ROLLING_WINDOW,
                           slot_seconds: int = SLOT_SECONDS, idle_seconds: int = IDLE_SECONDS, few: int = FEW) -> DataFrame:
    """Rolling mean and std, difference and percent change per engine, in order of (time, event).

    Readings may come ``delay`` late and in any order; later ones are dropped by the watermark, and Spark counts them
    (``numRowsDroppedByWatermark``). A reading that is repeated counts once. A missing reading keeps its place in the
    window, without a value: the moments leave it out, and a difference from or to it is 0. Results come out once the
    watermark has passed the end of a reading's slot, so those of the last ``delay`` wait for later readings.
    """
    use_rocks_db(readings.sparkSession)
    return readings.withWatermark("at", delay).groupBy("engine_id").transformWithStateInPandas(
        OrderedRolling(window, slot_seconds, idle_seconds, few), ORDERED_SCHEMA, "Append", "EventTime")
