"""Sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustloom.functions.columns import is_number_like, round6


#: Whole microseconds; the default formats cut times to milliseconds.
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def write_csv(df: DataFrame, path: str, digits: int = 6, fixed: bool = False) -> None:
    """With a header; doubles rounded, or with fixed decimals."""
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    out = df.withColumns({c: F.format_string(f"%.{digits}f", F.col(c)) for c in doubles}) if fixed else round6(df, digits)
    out.write.options(header=True, **TIMES).mode("overwrite").csv(path)


def json_lines(df: DataFrame, pairs: str, raw: str, failed=None):
    """One JSON text a row from a map: values that look like numbers are unquoted, the raw line is kept, failed rows say so."""
    def item(e):
        value = F.when(is_number_like(e["value"]) & e["value"].rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"), e["value"]).otherwise(F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2))
        return F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), value)

    quoted_raw = F.to_json(F.array(raw))
    parts = F.concat(F.transform(F.map_entries(pairs), item), F.array(F.concat(F.lit('"raw":'), quoted_raw.substr(F.lit(2), F.length(quoted_raw) - 2))))
    parts = F.concat(parts, F.when(failed, F.array(F.lit('"parse_error":true'))).otherwise(F.array().cast("array<string>"))) if failed is not None else parts
    return df.select(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("value"))


def write_jsonl(df: DataFrame, path: str, pairs: str, raw: str, failed=None) -> None:
    json_lines(df, pairs, raw, failed).write.mode("overwrite").text(path)


def write_partitioned_days(df: DataFrame, path: str, ts: str) -> None:
    """A folder for each day; only the days of df are replaced. Small days are one file; a large day is cut to several tasks."""
    dealt = df.withColumn("day", F.to_date(ts)).hint("rebalance", "day")
    dealt.write.partitionBy("day").options(**TIMES).option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def write_report_bundle(tables: dict[str, DataFrame], metadata: DataFrame, path: str) -> None:
    for name, df in {**tables, "metadata": metadata}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_events_csv(df: DataFrame, path: str, cols: list[str]) -> None:
    df.select(*cols).write.options(header=True, quoteAll=True, **TIMES).mode("overwrite").csv(path)


def publications(spark: SparkSession, path: str) -> DataFrame:
    """number and day of each publication that was finished; none before the first."""
    try:
        return spark.read.schema("number long, day date").parquet(f"{path}/published")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "number long, day date")


def publish_latest(points: DataFrame, path: str, ts: str, keep: int = 24) -> None:
    """Adds a table of its own number, then one row with that number and the day of the table's newest time to the log.

    Tables aren't changed once they are in the log, so who reads one keeps it whole while the next are written. The archive of a
    day is the last table that was published on it. Tables older than the last keep ones go, unless they are an archive's. One
    job publishes to a path at a time; a table that it didn't bring to the log is replaced by the next. A table without times isn't published.
    """
    spark = points.sparkSession
    log = publications(spark, path)
    number = (log.agg(F.max("number")).first()[0] or 0) + 1
    table = f"{path}/tables/number={number}"
    points.write.mode("overwrite").parquet(table)
    entry = spark.read.schema(points.schema).parquet(table).agg(F.lit(number).cast("long").alias("number"), F.to_date(F.max(ts)).alias("day")).where("day IS NOT NULL")
    entry.coalesce(1).write.mode("append").parquet(f"{path}/published")
    # one row a publication: the log alone tells what can go
    last = publications(spark, path).groupBy("day").agg(F.max("number").alias("number"))
    old = log.join(last, "number", "left_anti").where(F.col("number") <= number - keep).where(F.col("number") > number - 3 * keep)
    for row in old.select("number").collect():
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tables/number={row['number']}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest table, as it was when this was called, for as long as keep publications."""
    number = publications(spark, path).agg(F.max("number")).first()[0]
    return spark.read.parquet(f"{path}/tables/number={number}")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """day, the day of publication, and the last table that was published on it, for all days."""
    last = publications(spark, path).groupBy("day").agg(F.max("number").alias("number"))
    return spark.read.parquet(f"{path}/tables").join(F.broadcast(last), "number").drop("number")
