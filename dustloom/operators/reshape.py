"""Projections, reshaping and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustloom.functions.columns import season_order


def to_long(df: DataFrame, ids: list[str], metrics: list[str], drop_null: bool = True) -> DataFrame:
    out = df.select(*ids, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(ids, metrics, "metric", "value")
    return out.where(F.col("value").isNotNull()) if drop_null else out


def month_hour_matrix(df: DataFrame, ts: str, value: str) -> DataFrame:
    """12 rows of 24 hourly means; cells without data are NULL."""
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    cells = df.groupBy(F.month(ts).alias("month")).pivot("hour", list(range(24))) if "hour" in df.columns else df.withColumn("hour", F.hour(ts)).groupBy(F.month(ts).alias("month")).pivot("hour", list(range(24)))
    return F.broadcast(months).join(cells.agg(F.avg(value)), "month", "left")  # twelve rows


def levels_to_rows(df: DataFrame, ids: list[str], levels: str, missing_as_zero: bool = False) -> DataFrame:
    out = df.select(*ids, F.explode(levels).alias("level", "value"))
    return out.withColumn("value", F.coalesce("value", F.lit(0.0))) if missing_as_zero else out


def split_series_label(label):
    """HH:MM-wavelength, cut at the first dash."""
    parts = F.split(label, "-", 2)
    return F.get(parts, F.lit(0)).alias("profile_time"), F.get(parts, F.lit(1)).alias("wavelength")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def explode_stock(products: DataFrame) -> DataFrame:
    """products: page, items array<struct<code, availability, locations array<struct<name, availability>>>>; a row for each item and place."""
    items = products.select("page", F.array_join(F.transform("items", lambda i: i["code"]), ", ").alias("codes"), F.posexplode_outer("items").alias("item_no", "item"))
    return items.select("page", "codes", "item_no", F.col("item.code").alias("code"), F.col("item.availability").alias("item_availability"), F.explode_outer("item.locations").alias("place")).select("page", "codes", "item_no", "code", "item_availability", F.col("place.name").alias("location"), F.col("place.availability").alias("availability"))


def profile_slices(profiles: DataFrame, wavelength=None, time=None, factor: float = 1.0) -> DataFrame:
    """Finite pairs of one wavelength or one time, scaled, by altitude."""
    out = profiles.where(F.col("altitude").isNotNull() & F.col("value").isNotNull())
    out = out.where(F.col("wavelength") == wavelength) if wavelength is not None else out
    out = out.where(F.col("profile_time") == time) if time is not None else out
    return out.withColumn("value", F.col("value") * factor).orderBy("profile_time", "wavelength", "altitude")


def union_sources(main: DataFrame, more: DataFrame, path_col: str = "path") -> DataFrame:
    """Each path once; the main source's row goes before the other's."""
    both = main.withColumn("source_order", F.lit(0)).unionByName(more.withColumn("source_order", F.lit(1)))
    cols = [c for c in both.columns if c != path_col]
    return both.groupBy(path_col).agg(F.min_by(F.struct(*cols), "source_order").alias("r")).select(path_col, "r.*")


def union_bases(individual: DataFrame, daily: DataFrame) -> DataFrame:
    return individual.withColumn("basis", F.lit("individual")).unionByName(daily.withColumn("basis", F.lit("daily")))


def union_platforms(frames: dict[str, DataFrame]) -> DataFrame:
    return union_by_name([df.withColumn("platform", F.lit(name)) for name, df in frames.items()])


def order_columns(kind: str) -> list[Column]:
    """The fixed orders of output tables: records, grid, season, wavelength."""
    wave = F.try_to_number(F.regexp_extract("wavelength", "[0-9]+", 0), F.lit("999999"))
    return {"records": [F.col("date"), F.col("time"), F.col("site")], "grid": [F.col("date"), F.col("platform")], "season": [F.col("year"), season_order(F.col("season"))], "wavelength": [wave, F.col("wavelength")]}[kind]


def ordered_output(df: DataFrame, kind: str) -> DataFrame:
    return df.orderBy(*order_columns(kind))
