"""Streams with state of their own and timers: silence, budgets of water, hourly means from a ring of rows.

State is kept in RocksDB, which transformWithState asks for: with_state_store() names it in the session. What a device or
station keeps is bounded: one time, a few days' sums, RING rows before the last tick and those after it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dustloom.session import on_workers

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
#: Rows of a rolling mean.
RING = 60


def with_state_store(spark: SparkSession) -> None:
    """Names the state store of streams that are started from now on, and lets workers import this package."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    on_workers(spark)


def _at(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class Silence(StatefulProcessor):
    """An event when a device was silent for so long by the clock of the stream, and one when it speaks again."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "heard long, last timestamp, offline boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        newest = max(pd.Timestamp(x["ts"].max()) for x in rows)
        last, was_off = newest, False
        if self.seen.exists():
            _, before, was_off = self.seen.get()
            last = max(last, pd.Timestamp(before).tz_localize(None))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.seen.update((now, last.to_pydatetime(), False))
        self.handle.registerTimer(now + self.timeout_ms)
        if was_off:
            yield pd.DataFrame({"device_id": [key[0]], "event": ["online"], "last_seen": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        heard, last, _ = self.seen.get()
        self.seen.update((heard, last, True))
        yield pd.DataFrame({"device_id": [key[0]], "event": ["offline"], "last_seen": [pd.Timestamp(last).tz_localize(None)]})

    def close(self) -> None:
        pass


def offline_devices(messages: DataFrame, timeout_s: float, device: str = "device_id", ts: str = "timestamp") -> DataFrame:
    """device_id, event (offline or online), last_seen. Offline comes from a timer, so no message of any device is needed for it; rows without device or time play no part."""
    with_state_store(messages.sparkSession)
    rows = messages.select(F.col(device).cast("string").alias("device_id"), F.col(ts).cast("timestamp").alias("ts")).dropna()
    return rows.groupBy("device_id").transformWithStateInPandas(Silence(round(1000 * timeout_s)), "device_id string, event string, last_seen timestamp", "Append", "ProcessingTime")


class Budget(StatefulProcessor):
    """Each watering with the day's sum up to it; days are kept until the watermark is a day beyond them."""

    def __init__(self, most_ml: float, lockout_minutes: float):
        self.most_ml, self.lockout = most_ml, dt.timedelta(minutes=lockout_minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "day long", "ml double")
        self.last = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        table = pd.concat(list(rows)).sort_values(["ts", "amount_ml"], kind="stable")
        last = pd.Timestamp(self.last.get()[0]).tz_localize(None) if self.last.exists() else None
        out, sums = [], {}
        for ts, amount in zip(table["ts"], table["amount_ml"], strict=True):
            day = ts.value // 1_000_000 // DAY_MS
            if day not in sums:
                sums[day] = self.used.getValue((day,))[0] if self.used.containsKey((day,)) else 0.0
                self.handle.registerTimer((day + 2) * DAY_MS)
            sums[day] += amount
            early = last is not None and ts - last < self.lockout and ts >= last
            last = ts if last is None else max(last, ts)
            out.append((key[0], ts, amount, _at(day * DAY_MS).date(), sums[day], bool(early), sums[day] > self.most_ml))
        for day, ml in sums.items():
            self.used.updateValue((day,), (float(ml),))
        self.last.update((last.to_pydatetime(),))
        yield pd.DataFrame(out, columns=["device_id", "ts", "amount_ml", "day", "used", "early", "over"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        gone = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 2
        if self.used.containsKey((gone,)):
            self.used.removeKey((gone,))
        return iter(())

    def close(self) -> None:
        pass


def water_budget_stream(waterings: DataFrame, most_ml: float, lockout_minutes: float, late: str = "1 hour", device: str = "device_id", ts: str = "timestamp", amount: str = "amount_ml") -> DataFrame:
    """device_id, ts, amount_ml, day, used (of the day so far, this one too), early (within the lockout of the one before), over.

    Waterings of one batch are taken in order of time; one that comes late counts for its own day. Rows without device, time or
    amount play no part.
    """
    with_state_store(waterings.sparkSession)
    rows = waterings.select(F.col(device).cast("string").alias("device_id"), F.col(ts).cast("timestamp").alias("ts"), F.col(amount).cast("double").alias("amount_ml")).dropna()
    out = "device_id string, ts timestamp, amount_ml double, day date, used double, early boolean, over boolean"
    return rows.withWatermark("ts", late).groupBy("device_id").transformWithStateInPandas(Budget(most_ml, lockout_minutes), out, "Append", "EventTime")


class HourlyMeans(StatefulProcessor):
    """At each full hour that the watermark passes, the mean of the last RING rows before it, of the month of the hour before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us long, value double")

    def _kept(self) -> list[tuple]:
        return [tuple(r) for r in self.rows.get()] if self.rows.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self._kept()
        for table in rows:
            kept += [(int(t.value // 1000), None if pd.isna(v) else float(v)) for t, v in zip(table["ts"], table["value"], strict=True)]
        kept.sort(key=lambda r: (r[0], r[1] is None, r[1]))
        self.rows.put(kept)
        if not any(True for _ in self.handle.listTimers()):
            first = max(kept[0][0] // 1000, timerValues.getCurrentWatermarkInMs())
            self.handle.registerTimer((first // HOUR_MS + 1) * HOUR_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tick = expiredTimerInfo.getExpiryTimeInMs()
        until = timerValues.getCurrentWatermarkInMs()
        kept, out = self._kept(), []
        # all hours up to the watermark at once: it may have moved on by many
        while tick <= until:
            month = _at(tick - HOUR_MS).to_period("M").start_time
            kept = [r for r in kept if r[0] >= month.value // 1000]
            before = [r for r in kept if r[0] < tick * 1000]
            if before:
                values = [v for _, v in before[-RING:] if v is not None]
                out.append((key[0], _at(tick), sum(values) / len(values) if values else None, len(values)))
                kept = before[-RING:] + kept[len(before) :]
            if not kept:
                break
            tick = tick + HOUR_MS if before else max(tick + HOUR_MS, (kept[0][0] // 1000 // HOUR_MS + 1) * HOUR_MS)
        if kept:
            self.rows.put(kept)
            self.handle.registerTimer(tick)
        else:
            self.rows.clear()
        if out:
            yield pd.DataFrame(out, columns=["station", "tick", "mean", "n"])

    def close(self) -> None:
        pass


def hourly_means_stream(rows: DataFrame, station: str, ts: str, value: str, late: str = "10 minutes") -> DataFrame:
    """station, tick, mean, n: for each full hour one row a station, once the watermark passes it, as long as its month has rows. History isn't read again."""
    with_state_store(rows.sparkSession)
    given = rows.select(F.col(station).cast("string").alias("station"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value")).where("station IS NOT NULL AND ts IS NOT NULL")
    return given.withWatermark("ts", late).groupBy("station").transformWithStateInPandas(HourlyMeans(), "station string, tick timestamp, mean double, n int", "Append", "EventTime")
