"""Queries of the sinks, read back from the shared folder, of the workbook sources as cells, and of file versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from dustloom.functions import columns as C
from dustloom.operators import reshape
from dustloom.plans.observations import OBS, SEASON, observations, rounded, table
from dustloom.plans.texts import count
from dustloom.session import shared_dir
from dustloom.sources import files, sinks
from dustloom.streaming import jobs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def place(spark) -> str:
    return f"{shared_dir(spark)}/dustloom-out-{uuid.uuid4().hex}"


@query("k01_write_csv", "SELECT printf('%.4f', l_extendedprice::DOUBLE) AS price, printf('%.4f', l_discount::DOUBLE) AS discount, count(*) AS n FROM lineitem GROUP BY 1, 2")
def write_csv(spark, sf_dir):
    """Fixed decimals, read back as the text that was written."""
    path = place(spark)
    sinks.write_csv(table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("price"), F.col("l_discount").cast("double").alias("discount")), path, digits=4, fixed=True)
    return spark.read.option("header", True).schema("price string, discount string").csv(path).groupBy("price", "discount").agg(count())


@query("k03_write_partitioned_days", "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def write_partitioned_days(spark, sf_dir):
    path = place(spark)
    sinks.write_partitioned_days(table(spark, sf_dir, "events").select("ts", "event_type", "value"), path, "ts")
    written = spark.read.schema("ts timestamp_ntz, event_type string, value double, day date").json(path)
    return rounded(written.groupBy("day", "event_type").agg(count(), F.sum("value").alias("total")))


@query("k04_write_report_bundle", OBS + """, m AS (SELECT count(*) AS records, count(value) AS valid, min(date) AS first_day, max(date) AS last_day, array_to_string(list_sort(list(DISTINCT metric)), ' ') AS metrics FROM o)
SELECT 'daily' AS name, (SELECT count(*) FROM (SELECT DISTINCT metric, date FROM o)) AS rows, m.* FROM m UNION ALL SELECT 'seasons', (SELECT count(*) FROM (SELECT DISTINCT metric, """ + SEASON.format("date") + """ FROM o)), m.* FROM m""")
def write_report_bundle(spark, sf_dir):
    """Two tables and the run's facts, with the number of rows that each table has when it is read."""
    o = observations(spark, sf_dir)
    tables = {"daily": o.groupBy("metric", "date").agg(F.avg("value").alias("value")), "seasons": o.groupBy("metric", C.season(F.month("date")).alias("season")).agg(F.count("value").alias("n"))}
    facts = o.agg(count().alias("records"), F.count("value").alias("valid"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.array_join(F.array_sort(F.collect_set("metric")), " ").alias("metrics"))
    path = place(spark)
    sinks.write_report_bundle(tables, facts, path)
    rows = [spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), count().alias("rows")) for name in tables]
    return reshape.union_by_name(rows).join(F.broadcast(spark.read.parquet(f"{path}/metadata")))  # one row of facts


@query("k05_write_events_csv", "SELECT event_id, ts, user_id, event_type, value FROM events")
def write_events_csv(spark, sf_dir):
    path = place(spark)
    sinks.write_events_csv(table(spark, sf_dir, "events"), path, ["event_id", "ts", "user_id", "event_type", "value"])
    return spark.read.option("header", True).schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double").csv(path)


@query("k06_publish_latest", "SELECT user_id, max(date_trunc('hour', ts)) AS hour, max(value) AS highest FROM events GROUP BY 1")
def publish_latest(spark, sf_dir):
    """Published twice, as a stream does: what is read is the second table alone."""
    path = place(spark)
    newest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz").alias("hour"), F.max("value").alias("highest"))
    sinks.publish_latest(newest.withColumn("highest", F.lit(0.0)), path, "hour")
    sinks.publish_latest(newest, path, "hour")
    return sinks.read_latest(spark, path)


#: Users of each of the 24 hours up to three publications, by the day of the last one on that day.
@query("k06_read_archive", """WITH p AS (SELECT * FROM (VALUES (TIMESTAMP '2024-01-05 23:00:00'), (TIMESTAMP '2024-01-06 05:00:00'), (TIMESTAMP '2024-01-06 22:00:00')) t(last)),
d AS (SELECT last::DATE AS day, max(last) AS last FROM p GROUP BY 1)
SELECT day, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM d JOIN events ON ts >= last - INTERVAL 23 HOUR AND ts < last + INTERVAL 1 HOUR GROUP BY 1, 2""")
def read_archive(spark, sf_dir):
    """Each day keeps all 24 hours of its last publication, whatever is published on the days after."""
    path = place(spark)
    hourly = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(count(), F.round(F.sum("value"), 4).alias("total"))
    for at in ("2024-01-05 23:00:00", "2024-01-06 05:00:00", "2024-01-06 22:00:00"):
        last = F.lit(at).cast("timestamp_ntz")
        sinks.publish_latest(hourly.where(F.col("hour").between(last - F.expr("INTERVAL 23 HOURS"), last)), path, "hour", keep=1)
    return sinks.read_archive(spark, path).select("day", "hour", "n", "total")


def sheet_cells(spark, sf_dir, names: list[str], values: list, sheet):
    """Events as rows of cells, a user a workbook, below a title and a header."""
    e = table(spark, sf_dir, "events").withColumn("path", F.col("user_id").cast("string"))
    row = lambda no, cells: (F.lit(0).alias("sheet_no"), sheet.alias("sheet"), no.cast("long").alias("row_no"), F.array(*cells).alias("cells"))
    users = e.select("path", "user_id").distinct()
    above = users.select("path", *row(F.lit(1), [F.lit("title")])).union(users.select("path", *row(F.lit(2), [F.lit(n) for n in names])))
    return above.union(e.select("path", *row(F.col("event_id") + 3, values)))


@query("s03_read_photometer_workbooks", "SELECT strftime(ts, '%d:%m:%Y') AS date, event_type AS aeronet_site, m AS metric, count(*) AS n, round(sum(CASE m WHEN 'AOD_500nm' THEN value ELSE value + 1 END), 4) AS total FROM events, (VALUES ('AOD_500nm'), ('440-870_Angstrom_Exponent')) t(m) GROUP BY 1, 2, 3")
def read_photometer_workbooks(spark, sf_dir):
    names = ["Date(dd:mm:yyyy)", "Time(hh:mm:ss)", "AOD_500nm", "440-870_Angstrom_Exponent", "Solar_Zenith", "AERONET_Site"]
    text = lambda c: c.cast("string")
    values = [F.date_format("ts", "dd:MM:yyyy"), F.date_format("ts", "HH:mm:ss"), text(F.col("value")), text(F.col("value") + 1), F.lit("7"), F.col("event_type")]
    got = files.read_photometer_workbooks(sheet_cells(spark, sf_dir, names, values, F.lit("data")))
    return rounded(got.groupBy("date", "aeronet_site", "metric").agg(count(), F.sum(F.col("value").cast("double")).alias("total")))


@query("s04_read_retrieval_workbooks", "SELECT strftime(ts, '%d:%m:%Y') AS date, 'SSA440' AS metric, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id % 5 <> 0 GROUP BY 1")
def read_retrieval_workbooks(spark, sf_dir):
    """Every fifth workbook's sheet is named as one to be left out."""
    values = [F.date_format("ts", "dd:MM:yyyy"), F.date_format("ts", "HH:mm:ss"), F.col("value").cast("string"), F.lit("7")]
    sheet = F.when(F.col("user_id") % 5 == 0, "-999").otherwise("data")
    got = files.read_retrieval_workbooks(sheet_cells(spark, sf_dir, ["Date(dd:mm:yyyy)", "Time(hh:mm:ss)", "SSA440", "other"], values, sheet), ["SSA440"])
    return rounded(got.groupBy("date", "metric").agg(count(), F.sum(F.col("value").cast("double")).alias("total")))


@query("t05_ordered_output", f"""WITH g AS (SELECT year(o_orderdate)::INTEGER AS year, {SEASON.format('o_orderdate')} AS season, (month(o_orderdate) % 12) // 3 AS place, count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT year, season, n, (row_number() OVER (ORDER BY year, place))::INTEGER AS nth FROM g""")
def ordered_output(spark, sf_dir):
    """Counts of years and seasons in their fixed order, each with its place: four rows a year."""
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), C.season(F.month("o_orderdate")).alias("season")).agg(count())
    nth = F.row_number().over(Window.orderBy(*reshape.order_columns("season")))
    return reshape.ordered_output(o.withColumn("nth", nth), "season")


@query("st03_settled_files", """SELECT o_orderkey::VARCHAR AS path FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01 00:00:03' - INTERVAL 5 SECOND
AND NOT (o_orderkey % 5 = 0 OR (o_orderkey % 5 = 1 AND o_orderkey % 120 < 60))""")
def settled_files(spark, sf_dir):
    """Orders as files: a fifth was read before, a fifth failed up to two minutes ago, a fifth was read in an older version."""
    now = F.lit("1996-01-01 00:00:03").cast("timestamp")
    k = F.col("o_orderkey")
    given = table(spark, sf_dir, "orders").select(k.cast("string").alias("path"), F.col("o_orderdate").cast("timestamp").alias("modificationTime"), F.col("o_custkey").alias("length"), "o_orderkey")
    tried = given.where(k % 5 <= 2).select("path", "modificationTime", F.when(k % 5 == 2, F.col("length") - 1).otherwise(F.col("length")).alias("length"), F.timestamp_add("SECOND", (-(k % 120)).cast("int"), now).alias("tried_at"), (k % 5 != 1).alias("done"))
    return jobs.settled_files(given, now, tried=tried).select("path")
