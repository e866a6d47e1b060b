"""Structured Streaming jobs. Event times are timestamps with time zone, as watermarks need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustloom.operators.joins import ticks_asof_rolling
from dustloom.sources.sinks import publish_latest


def hourly_points(rows: DataFrame, hour, station: str, ts: str, value: str, hours: int = 24, k: int = 60) -> DataFrame:
    """The last hours ticks up to hour for each station, from a bounded recent slice of rows."""
    recent = rows.where(F.col(ts) > hour - F.expr(f"INTERVAL {hours + 24 * 62} HOURS"))
    ticks = recent.select(station).distinct().select(station, F.explode(F.sequence(hour - F.expr(f"INTERVAL {hours - 1} HOURS"), hour, F.expr("INTERVAL 1 HOUR"))).alias("tick"))
    return ticks_asof_rolling(recent, ticks, station, ts, value, k)


#: Days before an hour whose rows its points can need.
HISTORY_DAYS = 64


def hourly_rolling_stream(rows: DataFrame, history: str, out: str, checkpoint: str, station: str, ts: str, value: str):
    """Each batch is added to history; its newest hour's points replace those published.

    A batch has a folder of its own, so that one that is tried again replaces what it wrote. Of the history only the
    days from the batch's newest are read to find the hour, and only the last HISTORY_DAYS for the points.
    """

    def batch(df: DataFrame, number: int) -> None:
        newest = df.agg(F.max(ts)).first()[0]
        if newest is None:
            return
        df.withColumn("day", F.to_date(ts)).write.mode("overwrite").partitionBy("day").parquet(f"{history}/batch={number}")
        every = df.sparkSession.read.parquet(history).drop("batch")
        hour = every.where(F.col("day") >= F.lit(newest.date())).agg(F.date_trunc("hour", F.max(ts))).first()[0]
        recent = every.where(F.col("day") >= F.date_sub(F.lit(hour.date()), HISTORY_DAYS)).drop("day")
        publish_latest(hourly_points(recent, F.lit(hour), station, ts, value), out, "tick")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publication_hour(newest: Column, now: Column, minutes: int = 5) -> Column:
    """The current hour if the newest row is no older than some minutes before it, else the newest row's hour."""
    hour = F.date_trunc("hour", now)
    return F.when(newest >= hour - F.expr(f"INTERVAL {minutes} MINUTES"), hour).otherwise(F.date_trunc("hour", newest))


def settled_files(files: DataFrame, now: Column, seconds: int = 5, tried: DataFrame | None = None, retry_s: int = 60) -> DataFrame:
    """files: path, modificationTime, length of a binaryFile scan or a listing; those unchanged for some seconds.

    tried: path, modificationTime, length, tried_at, done of earlier reads. A version that was read is skipped, one whose
    last reading failed is tried again after retry_s; a file that has changed since is a new version.
    """
    settled = files.where(F.col("modificationTime") <= now - F.expr(f"INTERVAL {seconds} SECONDS"))
    if tried is None:
        return settled
    version = ["path", "modificationTime", "length"]
    last = tried.groupBy(*version).agg(F.max("tried_at").alias("_at"), F.bool_or("done").alias("_done"))
    waits = last.where(F.col("_done") | (F.col("_at") > now - F.expr(f"INTERVAL {retry_s} SECONDS")))
    return settled.join(waits.select(*version), version, "left_anti")


def dedup_messages(messages: DataFrame, ts: str = "timestamp", late: str = "1 hour") -> DataFrame:
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark(["device_id", "seq"])


def last_seen(messages: DataFrame, now: Column, timeout_s: int, device: str = "device_id", ts: str = "timestamp") -> DataFrame:
    seen = messages.groupBy(device).agg(F.max(ts).alias("last_seen"))
    return seen.withColumn("offline", F.unix_seconds(now) - F.unix_seconds(F.col("last_seen").cast("timestamp")) > timeout_s)


def daily_water_budget(waterings: DataFrame, most_ml: Column, lockout_minutes: int, device: str = "device_id", ts: str = "timestamp", amount: str = "amount_ml") -> DataFrame:
    """Batch: millilitres a device and day against the limit, and waterings that came within the lockout of the one before."""
    from pyspark.sql import Window

    before = F.lag(F.unix_seconds(F.col(ts).cast("timestamp"))).over(Window.partitionBy(device).orderBy(ts, amount))
    early = F.unix_seconds(F.col(ts).cast("timestamp")) - before < 60 * lockout_minutes
    marked = waterings.withColumn("early", F.coalesce(early, F.lit(False)))
    out = marked.groupBy(device, F.to_date(ts).alias("day")).agg(F.sum(amount).alias("used"), F.count_if("early").alias("early"))
    return out.withColumn("over", F.col("used") > most_ml)


def telemetry_windows(messages: DataFrame, cols: list[str], width: str = "10 minutes", late: str | None = "1 hour", device: str = "device_id", ts: str = "timestamp") -> DataFrame:
    """Tumbling means; late None for batch tables."""
    given = messages.withWatermark(ts, late) if late else messages
    return given.groupBy(device, F.window(ts, width).alias("w")).agg(*(F.avg(c).alias(c) for c in cols), F.count(F.lit(1)).alias("n")).select(device, F.col("w.start").alias("start"), *cols, "n")


def outage_sessions(messages: DataFrame, gap: str = "10 minutes", device: str = "device_id", ts: str = "timestamp", late: str | None = "1 hour") -> DataFrame:
    """Sessions of messages no further apart than gap; between them the device was silent."""
    given = messages.withWatermark(ts, late) if late else messages
    return given.groupBy(device, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(device, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
