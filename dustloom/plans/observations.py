"""Queries of the cleaning, statistics and selection operators on the given tables, with DuckDB SQL beside each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustloom.functions import columns as C
from dustloom.operators import clean, joins, reshape, stats, windows
from dustloom.session import shared_dir
from dustloom.sources import tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Observations: events as long rows, a user as a site and an event type as a metric. The value is the root of an event's,
#: as means of cents often lie halfway between two rounded numbers, which engines round either way.
OBS = "WITH o AS (SELECT user_id AS site, ts, ts::DATE AS date, event_type AS metric, CASE WHEN isnan(value) OR isinf(value) OR value <= -900 THEN NULL ELSE sqrt(abs(value)) END AS value, event_id FROM events)"
SEASON = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'Winter' WHEN month({0}) <= 5 THEN 'Spring' WHEN month({0}) <= 8 THEN 'Summer' ELSE 'Autumn' END"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), "ts", F.to_date("ts").alias("date"), F.col("event_type").alias("metric"), F.sqrt(F.abs(C.clean_value(F.col("value")))).alias("value"), "event_id")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return C.round6(df, digits)


EXCLUDED = ["2024-01-05", "2024-01-17"]


@query("w01_cumulative_histogram", OBS + """,
d AS (SELECT metric, date, avg(value) AS value FROM o WHERE date NOT IN (DATE '2024-01-05', DATE '2024-01-17') GROUP BY 1, 2),
h AS (SELECT metric, floor(value / 0.5 + 1e-12)::BIGINT AS bin, count(*) AS n FROM d WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT metric, bin, bin * 0.5::DOUBLE AS bin_start, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY metric), 4) AS percent,
  (sum(n) OVER w)::BIGINT AS cumulative, round(100.0::DOUBLE * (sum(n) OVER w) / sum(n) OVER (PARTITION BY metric), 4) AS cumulative_percent, (sum(n) OVER (PARTITION BY metric))::BIGINT AS total
FROM h WINDOW w AS (PARTITION BY metric ORDER BY bin)""")
def cumulative_histogram(spark, sf_dir):
    """The flagship: distribution of daily means, excluded dates removed."""
    kept = clean.exclude_dates(observations(spark, sf_dir), "date", EXCLUDED)
    daily = stats.daily_means(kept, "ts", ["metric"])
    return stats.cumulative_histogram(stats.histogram(daily, ["metric"], width=0.5), ["metric"], width=0.5)


@query("a01_group_stats", OBS + ",".join(["", *(f"""
g{i} AS (SELECT '{g}' AS grain, ({e})::VARCHAR AS "group", metric, value FROM o)""" for i, (g, e) in enumerate({"year": "year(ts)", "month": "month(ts)", "season": SEASON.format("ts"), "hour": "hour(ts)", "weekday": "dayname(ts)"}.items()))]) + """,
g AS (SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4)
SELECT grain, "group", metric, count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max FROM g GROUP BY 1, 2, 3""")
def group_stats(spark, sf_dir):
    return rounded(stats.group_stats(observations(spark, sf_dir), "ts"))


LINE_LONG = """WITH l AS (UNPIVOT (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE value)"""
LINE_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a02_describe_columns", LINE_LONG + """
SELECT metric, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(quantile_cont(value, 0.05), 4) AS p05, round(quantile_cont(value, 0.25), 4) AS p25,
 round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS max FROM l GROUP BY 1""")
def describe_columns(spark, sf_dir):
    return rounded(stats.describe_columns(reshape.to_long(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_METRICS)))


@query("r01_to_long", LINE_LONG + " SELECT metric, count(*) AS n, round(sum(value), 2) AS total FROM l GROUP BY 1")
def to_long(spark, sf_dir):
    return reshape.to_long(table(spark, sf_dir, "lineitem"), [], LINE_METRICS).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("a03_summary", OBS + """,
g AS (SELECT 'day' AS grain, date::VARCHAR AS "group", metric, value FROM o UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), metric, value FROM o UNION ALL SELECT 'month_of_year', month(ts)::VARCHAR, metric, value FROM o
 UNION ALL SELECT 'season', """ + SEASON.format("ts") + """, metric, value FROM o UNION ALL SELECT 'season_year', (year(ts) + (month(ts) = 12)::INTEGER)::VARCHAR || ' ' || """ + SEASON.format("ts") + """, metric, value FROM o)
SELECT grain, "group", metric, count(value) AS n, round(avg(value), 4) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END, 4) AS std FROM g GROUP BY 1, 2, 3""")
def summary(spark, sf_dir):
    return rounded(stats.summary(observations(spark, sf_dir), "ts"))


@query("a04_daily_means", OBS + " SELECT metric, date, round(avg(value), 4) AS value, count(value) AS n FROM o GROUP BY 1, 2")
def daily_means(spark, sf_dir):
    return rounded(stats.daily_means(observations(spark, sf_dir), "ts", ["metric"]))


DESCRIBE = """count(value) AS n, round(avg(value), 4) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END, 4) AS std, round(median(value), 4) AS median, round(min(value), 4) AS min, round(max(value), 4) AS max,
 round(CASE WHEN count(value) < 3 THEN NULL WHEN stddev_samp(value) = 0 THEN 0 ELSE skewness(value) END, 4) AS skewness"""


@query("a05_descriptive", OBS + f" SELECT metric, date, {DESCRIBE} FROM o GROUP BY 1, 2")
def descriptive(spark, sf_dir):
    return rounded(stats.descriptive(observations(spark, sf_dir), ["metric", "date"]))


@query("a06_retrieval_summary", OBS + f""",
b AS (SELECT 'individual' AS basis, metric, date, value FROM o UNION ALL SELECT 'daily', metric, date, avg(value) FROM o GROUP BY 2, 3),
g AS (SELECT basis, metric, 'month' AS grain, strftime(date, '%Y-%m') AS "group", value FROM b UNION ALL SELECT basis, metric, 'season', {SEASON.format('date')}, value FROM b
 UNION ALL SELECT basis, metric, 'year', year(date)::VARCHAR, value FROM b UNION ALL SELECT basis, metric, 'year_season', year(date)::VARCHAR || ' ' || {SEASON.format('date')}, value FROM b)
SELECT basis, metric, grain, "group", {DESCRIBE} FROM g GROUP BY 1, 2, 3, 4""")
def retrieval_summary(spark, sf_dir):
    o = observations(spark, sf_dir).select("metric", "date", "value")
    both = reshape.union_bases(o, stats.daily_means(o, "date", ["metric"]).select("metric", "date", "value"))
    return rounded(stats.descriptive_by_grain(both, "date"))


@query("u02_union_bases", OBS + """ SELECT basis, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT 'individual' AS basis, value FROM o UNION ALL SELECT 'daily', avg(value) FROM o GROUP BY metric, date) GROUP BY 1""")
def union_bases(spark, sf_dir):
    o = observations(spark, sf_dir).select("metric", "date", "value")
    both = reshape.union_bases(o, stats.daily_means(o, "date", ["metric"]).select("metric", "date", "value"))
    return rounded(both.groupBy("basis").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query("a07_histogram", OBS + " SELECT metric, floor(value / 0.25 + 1e-12)::BIGINT AS bin, count(*) AS n FROM o WHERE value IS NOT NULL GROUP BY 1, 2")
def histogram(spark, sf_dir):
    return stats.histogram(observations(spark, sf_dir), ["metric"], width=0.25)


@query("a08_mean_of_daily_means", f"""WITH d AS (SELECT o_orderpriority, o_orderdate::DATE AS date, avg(sqrt(o_totalprice)) AS value, count(o_totalprice) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, {SEASON.format('date')} AS season, (year(date) + (month(date) = 12)::INTEGER)::INTEGER AS season_year, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END, 6) AS std, count(value) AS days, sum(n)::BIGINT AS n FROM d GROUP BY 1, 2, 3""")
def mean_of_daily_means(spark, sf_dir):
    groups = {"season": C.season(F.month("date")), "season_year": C.season_year(F.col("date"))}
    return rounded(stats.mean_of_daily_means(table(spark, sf_dir, "orders").withColumn("root", F.sqrt("o_totalprice")), "o_orderdate", ["o_orderpriority"], groups, "root"), 6)


@query("a09_annual_with_total", """SELECT o_orderstatus, coalesce(y::VARCHAR, 'All years') AS year, n, round(mean, 4) AS mean, round(std, 4) AS std FROM (
SELECT o_orderstatus, year(o_orderdate) AS y, count(o_totalprice) AS n, avg(sqrt(o_totalprice)) AS mean, CASE WHEN count(o_totalprice) = 1 THEN 0 ELSE stddev_samp(sqrt(o_totalprice)) END AS std FROM orders GROUP BY GROUPING SETS ((o_orderstatus, year(o_orderdate)), (o_orderstatus)))""")
def annual_with_total(spark, sf_dir):
    return rounded(stats.annual_with_total(table(spark, sf_dir, "orders").withColumn("root", F.sqrt("o_totalprice")), "o_orderdate", ["o_orderstatus"], "root"))


PAIRS = "WITH p AS (SELECT l_orderkey, l_shipdate, l_discount * 6 AS aod, l_tax * 20 AS ae FROM lineitem)"
CLASS = "CASE WHEN aod IS NULL OR ae IS NULL THEN NULL WHEN ae < 0.8 THEN 'Dust' WHEN aod >= 0.35 AND ae > 1 THEN 'Biomass burning' WHEN aod > 0.2 AND aod < 0.35 AND ae > 1 THEN 'Urban' WHEN aod <= 0.2 AND ae >= 0.8 THEN 'Continental' ELSE 'Mixed' END"


def pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", (F.col("l_discount") * 6).alias("aod"), (F.col("l_tax") * 20).alias("ae"))


@query("a10_annual_pair", PAIRS + " SELECT year(l_shipdate)::INTEGER AS year, round(avg(aod), 4) AS mean_a, round(stddev_samp(aod), 4) AS std_a, round(avg(ae), 4) AS mean_b, round(stddev_samp(ae), 4) AS std_b, least(count(aod), count(ae)) AS n FROM p GROUP BY 1")
def annual_pair(spark, sf_dir):
    return rounded(stats.annual_pair(pairs(spark, sf_dir), "l_shipdate", "aod", "ae"))


NAMES = {c: c.lower().replace(" ", "_") for c in C.CLASSES}


@query("a11_class_crosstab", PAIRS + f""", c AS (SELECT year(l_shipdate) AS y, {CLASS} AS class FROM p WHERE aod IS NOT NULL AND ae IS NOT NULL),
g AS (SELECT coalesce(y::VARCHAR, 'All') AS "group", {', '.join(f"count(*) FILTER (class = '{c}') AS {n}" for c, n in NAMES.items())}, count(*) AS total FROM c GROUP BY ROLLUP (y))
SELECT *, {', '.join(f'round(100.0::DOUBLE * {n} / total, 2) AS {n}_percent' for n in NAMES.values())} FROM g""")
def class_crosstab(spark, sf_dir):
    classed = pairs(spark, sf_dir).withColumn("class", C.aerosol_class(F.col("aod"), F.col("ae"))).withColumn("year", F.year("l_shipdate"))
    return stats.class_crosstab(classed, "year")


@query("w12_percent_of_group", PAIRS + f""", c AS (SELECT {SEASON.format('l_shipdate')} AS season, {CLASS} AS class, count(*) AS n FROM p GROUP BY 1, 2)
SELECT season, class, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY season), 4) AS percent FROM c""")
def percent_of_group(spark, sf_dir):
    classed = pairs(spark, sf_dir).select(C.season(F.month("l_shipdate")).alias("season"), C.aerosol_class(F.col("aod"), F.col("ae")).alias("class"))
    return stats.percent_of_group(classed.groupBy("season", "class").agg(F.count(F.lit(1)).alias("n")), ["season"])


@query("f19_aerosol_class", PAIRS + f" SELECT {CLASS} AS class, count(*) AS n FROM p GROUP BY 1")
def aerosol_class(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy(C.aerosol_class(F.col("aod"), F.col("ae")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("p07_all_metrics_present", PAIRS + " SELECT count(*) AS n, round(sum(aod), 2) AS aod FROM p WHERE CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE aod END IS NOT NULL AND ae IS NOT NULL")
def all_metrics_present(spark, sf_dir):
    df = pairs(spark, sf_dir).withColumn("aod", F.when(F.col("l_orderkey") % 3 != 0, F.col("aod")))
    return clean.all_metrics_present(df, ["aod", "ae"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("aod"), 2).alias("aod"))


@query("p06_any_metric_present", PAIRS + ", q AS (SELECT CASE WHEN l_orderkey % 3 <> 0 THEN aod END AS aod, CASE WHEN l_orderkey % 2 <> 0 THEN ae END AS ae FROM p) SELECT count(*) AS n, count(aod) AS n_aod, count(ae) AS n_ae FROM q WHERE coalesce(aod, ae) IS NOT NULL")
def any_metric_present(spark, sf_dir):
    df = pairs(spark, sf_dir).withColumns({"aod": F.when(F.col("l_orderkey") % 3 != 0, F.col("aod")), "ae": F.when(F.col("l_orderkey") % 2 != 0, F.col("ae"))})
    return clean.any_metric_present(df, ["aod", "ae"]).agg(F.count(F.lit(1)).alias("n"), F.count("aod").alias("n_aod"), F.count("ae").alias("n_ae"))


@query("a12_season_counts", f"SELECT {SEASON.format('o_orderdate')} AS season, count(*) AS n FROM orders GROUP BY 1")
def season_counts(spark, sf_dir):
    return stats.season_counts(table(spark, sf_dir, "orders"), "o_orderdate")


@query("a13_merge_observations", """WITH e AS (SELECT date_trunc('hour', ts) AS hour, user_id AS site, event_id, event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS a, CASE WHEN event_id % 2 = 0 THEN value * 2 END AS b FROM events)
SELECT hour, site, arg_min(a, event_id) FILTER (a IS NOT NULL) AS a, arg_min(b, event_id) FILTER (b IS NOT NULL) AS b, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS sources FROM e GROUP BY 1, 2""")
def merge_observations(spark, sf_dir):
    v = F.col("value")
    e = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("user_id").alias("site"), "event_id", "event_type", F.when(F.col("event_id") % 3 != 0, v).alias("a"), F.when(F.col("event_id") % 2 == 0, v * 2).alias("b"))
    return stats.merge_observations(e, ["hour", "site"], ["a", "b"], ["event_id"], "event_type").withColumn("sources", F.array_join("sources", ","))


@query("a14_drop_exact_duplicates", """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_quantity, l_discount, l_tax, l_shipdate ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS k FROM lineitem) WHERE k = 1""")
def drop_exact_duplicates(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    out = stats.drop_exact_duplicates(l, ["l_quantity", "l_discount", "l_tax", "l_shipdate"], ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


#: The rows of A13, added in three files, one after the other.
@query("a13_merge_in_files", ORACLE["a13_merge_observations"])
def merge_in_files(spark, sf_dir):
    """Each file changes the days it has; the end is what all rows at once give."""
    v, path = F.col("value"), f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("user_id").alias("site"), "event_id", "event_type", F.when(F.col("event_id") % 3 != 0, v).alias("a"), F.when(F.col("event_id") % 2 == 0, v * 2).alias("b"))
    one = e.select("hour", "site", "a", F.when(F.col("a").isNotNull(), F.col("event_id")).alias("a_at"), "b", F.when(F.col("b").isNotNull(), F.col("event_id")).alias("b_at"), F.array("event_type").alias("types"))
    first = lambda c: (F.min_by(c, f"{c}_at").alias(c), F.min(f"{c}_at").alias(f"{c}_at"))
    merge = lambda df: df.groupBy("hour", "site").agg(*first("a"), *first("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"))
    for part in (F.dayofmonth("hour") > 20, F.dayofmonth("hour").between(8, 22) & (F.hour("hour") < 12), F.lit(True)):
        tables.merge_into(one.where(part), path, F.to_date("hour"), merge)
    return tables.read_merged(spark, path, one.schema).select("hour", "site", "a", "b", F.array_join("types", ",").alias("sources"))


@query("a15_last_per_hour", """SELECT user_id AS site, date_trunc('hour', ts) AS hour_start, arg_max(value, (ts, event_id)) AS value, max((ts, event_id)).event_id AS event_id FROM (SELECT *, {'ts': ts, 'event_id': event_id} AS k FROM events) GROUP BY 1, 2""".replace("max((ts, event_id)).event_id", "arg_max(event_id, (ts, event_id))"))
def last_per_hour(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), "ts", "value", "event_id")
    out = stats.last_per_hour(e, ["site"], "ts", ["ts", "event_id"])
    return out.select("site", F.col("hour_start").cast("timestamp_ntz").alias("hour_start"), "value", "event_id")


@query("a16_array_stats", """SELECT vec_id, len(embedding)::BIGINT AS size, len(embedding)::BIGINT AS n, round(list_min(embedding)::DOUBLE, 5) AS min, round(list_max(embedding)::DOUBLE, 5) AS max, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS mean FROM embeddings""")
def array_stats(spark, sf_dir):
    out = stats.array_stats(table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")), "vec_id", "v")
    return rounded(out, 5)


@query("a17_coverage", """WITH s AS (SELECT o_orderstatus, o_orderdate, """ + SEASON.format("o_orderdate") + """ AS season FROM orders)
SELECT o_orderstatus, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS rows, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months, array_to_string(list_sort(list(DISTINCT season)), ',') AS seasons, count(DISTINCT strftime(o_orderdate, '%Y-%m')) < 12 AS short_of_a_year FROM s GROUP BY 1""")
def coverage(spark, sf_dir):
    return stats.coverage(table(spark, sf_dir, "orders"), "o_orderdate", ["o_orderstatus"])


@query("j03_fixed_domain", """WITH d AS (SELECT * FROM (VALUES (0, 'Winter'), (1, 'Spring'), (2, 'Summer'), (3, 'Autumn')) t(place, season)), c AS (SELECT """ + SEASON.format("ts") + """ AS season, count(*) AS n FROM events GROUP BY 1)
SELECT place, d.season, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'NO DATA' ELSE 'OK' END AS status FROM d LEFT JOIN c USING (season)""")
def fixed_domain(spark, sf_dir):
    return stats.season_status(table(spark, sf_dir, "events"), "ts")


@query("a18_missing_counts", "SELECT count(*) AS rows, count(*) FILTER (l_orderkey % 3 <> 0 AND l_orderkey % 5 <> 0) AS complete, count(*) FILTER (l_orderkey % 3 = 0 OR l_orderkey % 5 = 0) AS with_missing FROM lineitem")
def missing_counts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 3 != 0, F.col("l_tax")).alias("a"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax")).alias("b"))
    return stats.missing_counts(l, ["a", "b"])


@query("a19_retrieval_day_values", OBS + """, s AS (SELECT date, metric, avg(value) AS mean, CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END AS std, min(value) AS low, max(value) AS high, count(value) AS n FROM o GROUP BY 1, 2)
SELECT date, metric, round(mean, 3) AS mean, round(std, 3) AS std, n, CASE WHEN printf('%.2f', low) = printf('%.2f', high) THEN printf('%.2f', low) ELSE printf('%.2f', low) || '–' || printf('%.2f', high) END AS "range" FROM s""")
def retrieval_day_values(spark, sf_dir):
    out = stats.retrieval_day_values(observations(spark, sf_dir), "date")
    return out.select("date", "metric", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), "n", C.range_text(F.col("low"), F.col("high"), 2).alias("range"))


@query("a22_daily_resample", OBS + """, d AS (SELECT site, date, avg(value) AS mean FROM o GROUP BY 1, 2), s AS (SELECT site, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM d GROUP BY 1)
SELECT s.site, s.date, round(mean, 4) AS mean FROM s LEFT JOIN d USING (site, date)""")
def daily_resample(spark, sf_dir):
    return rounded(stats.daily_resample(observations(spark, sf_dir), "ts", ["site"]))


@query("a23_profile_means", OBS + """, h AS (SELECT hour(ts)::INTEGER AS hour, avg(value) AS mean, count(value) AS n FROM o GROUP BY 1) SELECT g.place::INTEGER AS place, g.place::INTEGER AS hour, round(mean, 4) AS mean, coalesce(n, 0) AS n FROM (SELECT unnest(range(24)) AS place) g LEFT JOIN h ON h.hour = g.place""")
def profile_means(spark, sf_dir):
    by_hour = observations(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return rounded(joins.fixed_domain(by_hour, list(range(24)), "hour", "int", ["n"]))


@query("a24_box_summary", """WITH l AS (SELECT """ + SEASON.format("o_orderdate") + """ AS season, o_totalprice::DOUBLE AS value FROM orders),
q AS (SELECT season, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1)
SELECT season, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(value) AS low, max(value) AS high FROM l JOIN q USING (season) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3, 4, 5""")
def box_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(C.season(F.month("o_orderdate")).alias("season"), F.col("o_totalprice").alias("value"))
    out = stats.box_summary(o, ["season"])
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("a25_series_ranges", """WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT i % 4 AS label, count(*) AS points, min(i) AS x_min, max(i) AS x_max, round(min(v), 5) AS value_min, round(max(v), 5) AS value_max FROM e GROUP BY 1""")
def series_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "v")).select((F.col("i") % 4).cast("long").alias("label"), F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    return rounded(stats.series_ranges(e, "label", "i", "v"), 5)


@query("a26_available_metrics", OBS + " SELECT metric, count(value) AS n FROM o GROUP BY 1 HAVING count(value) > 0")
def available_metrics(spark, sf_dir):
    return stats.available_metrics(observations(spark, sf_dir))


@query("a27_view_counts", OBS + " SELECT count(DISTINCT year(ts)) AS years, count(DISTINCT date) AS dates, count(DISTINCT site) AS files, count(*) AS observations, min(date) AS first, max(date) AS last FROM o")
def view_counts(spark, sf_dir):
    return stats.view_counts(observations(spark, sf_dir), "ts", "site")


@query("p01_exclude_dates", OBS + " SELECT date, count(*) AS n FROM o WHERE date NOT IN (DATE '2024-01-05', DATE '2024-01-17') GROUP BY 1")
def exclude_dates(spark, sf_dir):
    return clean.exclude_dates(observations(spark, sf_dir), "date", EXCLUDED).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("p02_select_periods", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1996-02', '1997-12') GROUP BY 1")
def select_periods(spark, sf_dir):
    return clean.select_periods(table(spark, sf_dir, "orders"), "o_orderdate", ["1996-02", "1997-12", "1997-13", "x"]).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("p03_select_calendar", "SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(*) AS n FROM orders WHERE year(o_orderdate) + (month(o_orderdate) = 12)::INTEGER IN (1996, 1998) AND month(o_orderdate) IN (12, 1, 2) GROUP BY 1, 2")
def select_calendar(spark, sf_dir):
    kept = clean.select_calendar(table(spark, sf_dir, "orders"), "o_orderdate", years=[1996, 1998], seasons=["Winter"], by_season_year=True)
    return kept.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("p04_negative_to_null", "SELECT count(*) AS rows, count(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) AS n, round(sum(CASE WHEN c_acctbal >= 0 THEN c_acctbal END), 2) AS total FROM customer")
def negative_to_null(spark, sf_dir):
    return clean.negative_to_null(table(spark, sf_dir, "customer"), ["c_acctbal"]).agg(F.count(F.lit(1)).alias("rows"), F.count("c_acctbal").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("p05_drop_untimed", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 7 <> 0 AND ts IS NOT NULL GROUP BY 1")
def drop_untimed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    return clean.drop_untimed(e, "ts").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("p08_horizon", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_quantity * 2 BETWEEN 0 AND 72 + 1e-9")
def horizon(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("forecast_hour", F.col("l_quantity") * 2)
    return clean.horizon(l, "forecast_hour").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("p09_min_level", "SELECT count(*) AS n FROM part WHERE p_size * 50 >= 1000 AND p_partkey % 4 <> 0")
def min_level(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("level", F.when(F.col("p_partkey") % 4 == 0, F.lit("surface")).otherwise((F.col("p_size") * 50).cast("string")))
    return clean.min_level(p, "level").agg(F.count(F.lit(1)).alias("n"))


@query("p10_plausible", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 20000 GROUP BY 1")
def plausible(spark, sf_dir):
    return clean.plausible(table(spark, sf_dir, "lineitem"), "l_extendedprice", 1000, 20000).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("p11_sheet_scope", """WITH c AS (SELECT o_custkey AS path, strftime(o_orderdate, '%Y-%m') AS month_key, (o_orderkey % 3 + 1)::INTEGER AS sheet_no, (o_orderkey % 20 + 1)::INTEGER AS row_no, CASE WHEN o_orderkey % 11 = 0 THEN 'No Data' ELSE o_orderpriority END AS a FROM orders),
f AS (SELECT DISTINCT path, sheet_no FROM c WHERE row_no <= 10 AND lower(a) LIKE '%no data%')
SELECT month_key, count(*) AS n FROM c WHERE (sheet_no = 1 OR month_key = '1996-07') AND NOT EXISTS (SELECT 1 FROM f WHERE f.path = c.path AND f.sheet_no = c.sheet_no) GROUP BY 1""")
def sheet_scope(spark, sf_dir):
    k = F.col("o_orderkey")
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.date_format("o_orderdate", "yyyy-MM").alias("month_key"), (k % 3 + 1).cast("int").alias("sheet_no"), (k % 20 + 1).cast("int").alias("row_no"), F.array(F.when(k % 11 == 0, "No Data").otherwise(F.col("o_orderpriority"))).alias("cells"))
    return clean.sheet_scope(cells, "1996-07").groupBy("month_key").agg(F.count(F.lit(1)).alias("n"))


@query("p12_validate_records", """WITH r AS (SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 7 = 0 THEN 'size' END, CASE WHEN p_retailprice <= 1000 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS failed FROM part) SELECT failed, count(*) AS n FROM r GROUP BY 1""")
def validate_records(spark, sf_dir):
    good, bad = clean.validate_records(table(spark, sf_dir, "part"), {"size": F.col("p_size") % 7 != 0, "price": F.col("p_retailprice") > 1000})
    both = good.select(F.lit("").alias("failed")).unionByName(bad.select(F.array_join("failed", ",").alias("failed")))
    return both.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


@query("p13_period_overlap", """WITH e AS (SELECT user_id, ts AS entry, ts + INTERVAL 6 HOUR AS exit FROM events) SELECT entry < TIMESTAMP '2024-01-10' AS ongoing, count(*) AS n FROM e WHERE exit > TIMESTAMP '2024-01-10' AND entry < TIMESTAMP '2024-01-12' GROUP BY 1""")
def period_overlap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("entry"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("exit"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return clean.period_overlap(e, at("2024-01-10"), at("2024-01-12")).groupBy("ongoing").agg(F.count(F.lit(1)).alias("n"))


@query("p14_finite_pair", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_orderkey % 5 <> 0")
def finite_pair(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("a"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount")).alias("b"))
    return clean.finite_pair(l, "a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("r02_month_hour_matrix", "WITH m AS (SELECT unnest(range(1, 13))::INTEGER AS month) SELECT m.month, " + ", ".join(f'round(avg(CASE WHEN hour(ts) = {h} THEN value END), 4) AS "{h}"' for h in range(24)) + " FROM m LEFT JOIN events ON month(ts) = m.month GROUP BY 1")
def month_hour_matrix(spark, sf_dir):
    return rounded(reshape.month_hour_matrix(table(spark, sf_dir, "events"), "ts", "value"))


@query("r03_levels_to_rows", "WITH l AS (SELECT l_orderkey, unnest(['1000', '2000', '3000']) AS level, unnest([l_tax, CASE WHEN l_orderkey % 2 = 0 THEN l_discount END, l_quantity]) AS value FROM lineitem) SELECT level, count(*) AS n, round(sum(coalesce(value, 0)), 2) AS total FROM l GROUP BY 1")
def levels_to_rows(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.create_map(F.lit("1000"), F.col("l_tax"), F.lit("2000"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_discount")), F.lit("3000"), F.col("l_quantity")).alias("levels"))
    return reshape.levels_to_rows(l, ["l_orderkey"], "levels", missing_as_zero=True).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("r04_split_series_label", "SELECT split_part(o_orderpriority, '-', 1) AS profile_time, substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) AS wavelength, count(*) AS n FROM orders WHERE strpos(o_orderpriority, '-') > 0 GROUP BY 1, 2")
def split_series_label(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.contains("o_orderpriority", F.lit("-"))).select(*reshape.split_series_label(F.col("o_orderpriority")))
    return o.groupBy("profile_time", "wavelength").agg(F.count(F.lit(1)).alias("n"))


@query("r05_union_by_name", "SELECT count(*) AS n, count(c_acctbal) AS n_customer, count(s_acctbal) AS n_supplier FROM (SELECT c_custkey AS key, c_acctbal, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier)")
def union_by_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), "s_acctbal")
    return reshape.union_by_name([c, s]).agg(F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("n_customer"), F.count("s_acctbal").alias("n_supplier"))


@query("u01_union_sources", "WITH a AS (SELECT DISTINCT o_orderdate AS path, 'orders' AS origin FROM orders), b AS (SELECT DISTINCT l_shipdate AS path, 'lineitem' AS origin FROM lineitem) SELECT path, origin, source_order::INTEGER AS source_order FROM (SELECT *, 0 AS source_order FROM a UNION ALL SELECT *, 1 FROM b) QUALIFY row_number() OVER (PARTITION BY path ORDER BY source_order) = 1")
def union_sources(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("path"), F.lit("orders").alias("origin")).distinct()
    b = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("path"), F.lit("lineitem").alias("origin")).distinct()
    return reshape.union_sources(a, b)


@query("u03_union_platforms", "SELECT platform, count(*) AS n FROM (SELECT 'Terra' AS platform FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'Aqua' FROM events WHERE event_id % 2 = 1) GROUP BY 1")
def union_platforms(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return reshape.union_platforms({"Terra": e.where("event_id % 2 = 0"), "Aqua": e.where("event_id % 2 = 1")}).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


@query("t01_top_days", OBS + " SELECT date, round(coalesce(avg(value) FILTER (metric = 'click'), 0), 4) AS mean FROM o GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def top_days(spark, sf_dir):
    daily = observations(spark, sf_dir).groupBy("date").agg(F.round(F.coalesce(F.avg(F.when(F.col("metric") == "click", F.col("value"))), F.lit(0.0)), 4).alias("mean"))
    return windows.top_n(daily, [F.desc("mean"), F.col("date")], 25)


@query("t04_first_events", "SELECT user_id, event_id, nth::INTEGER AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) WHERE nth <= 12")
def first_events(spark, sf_dir):
    return windows.first_n(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 12).select("user_id", "event_id", "nth")


@query("w07_latest_by", "SELECT user_id, event_type, value, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_by(spark, sf_dir):
    return windows.latest_by(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value", "ts", "event_id")


@query("w08_rolling_last_k", "SELECT event_id, round(avg(value) OVER w, 8) AS rolling_mean, count(value) OVER w AS rolling_n FROM events WINDOW w AS (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def rolling_last_k(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    return rounded(windows.rolling_last_k(e, ["user_id", "month"], ["ts", "event_id"], "value").select("event_id", "rolling_mean", "rolling_n"), 8)


@query("w10_episodes", OBS + """, d AS (SELECT metric, date FROM o GROUP BY 1, 2 HAVING avg(value) > (SELECT avg(value) FROM o)), r AS (SELECT metric, date, date - row_number() OVER (PARTITION BY metric ORDER BY date)::INTEGER AS run FROM d)
SELECT metric, min(date) AS first, max(date) AS last, count(*) AS days FROM r GROUP BY metric, run HAVING count(*) >= 2""")
def episodes(spark, sf_dir):
    o = observations(spark, sf_dir)
    mean = o.agg(F.avg("value").alias("m"))
    high = o.groupBy("metric", "date").agg(F.avg("value").alias("v")).join(F.broadcast(mean)).where("v > m")  # one row
    return windows.episodes(high, ["metric"], "date")


@query("w11_closest_event", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, ts, event_id) = 1")
def closest_event(spark, sf_dir):
    return windows.closest_event(table(spark, sf_dir, "events"), ["user_id"], "value", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("j01_daily_with_retrievals", OBS + """, d AS (SELECT date, round(avg(value), 4) AS mean FROM o GROUP BY 1), r AS (SELECT date, round(avg(value), 4) AS mean FROM o WHERE metric = 'purchase' AND day(date) % 2 = 0 GROUP BY 1)
SELECT d.date, d.mean, r.mean AS purchase FROM d LEFT JOIN r USING (date)""")
def daily_with_retrievals(spark, sf_dir):
    o = observations(spark, sf_dir)
    daily = o.groupBy("date").agg(F.round(F.avg("value"), 4).alias("mean"))
    got = o.where((F.col("metric") == "purchase") & (F.dayofmonth("date") % 2 == 0)).groupBy("date", "metric").agg(F.round(F.avg("value"), 4).alias("mean"))
    return joins.daily_with_retrievals(daily, got).select("date", "mean", F.col("retrieved")["purchase"].alias("purchase"))


@query("j02_calendar_spine", """WITH m AS (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 2) AS mean FROM orders WHERE month(o_orderdate) <> 7 GROUP BY 1, 2),
s AS (SELECT y::VARCHAR || '-' || lpad(k::VARCHAR, 2, '0') AS month FROM range(1995, 1997) t(y), range(1, 13) u(k))
SELECT o_orderstatus, s.month, mean FROM (SELECT DISTINCT o_orderstatus FROM m) CROSS JOIN s LEFT JOIN m USING (o_orderstatus, month)""")
def calendar_spine(spark, sf_dir):
    m = table(spark, sf_dir, "orders").where(F.month("o_orderdate") != 7).groupBy("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean"))
    return joins.calendar_spine(m, "month", ["o_orderstatus"], [1995, 1996])


@query("j02_calendar_spine_of_season", """WITH m AS (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 2) AS mean FROM orders WHERE month(o_orderdate) <> 7 GROUP BY 1, 2),
s AS (SELECT y::VARCHAR || '-' || lpad(k::VARCHAR, 2, '0') AS month FROM range(1995, 1997) t(y), range(6, 9) u(k))
SELECT o_orderstatus, s.month, mean FROM (SELECT DISTINCT o_orderstatus FROM m) CROSS JOIN s LEFT JOIN m USING (o_orderstatus, month)""")
def calendar_spine_of_season(spark, sf_dir):
    m = table(spark, sf_dir, "orders").where(F.month("o_orderdate") != 7).groupBy("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean"))
    return joins.calendar_spine(m, "month", ["o_orderstatus"], [1995, 1996], season_name="Summer")


#: Every February and March day of all years that orders have, by status, with the days without orders.
@query("j02_calendar_days", """WITH m AS (SELECT o_orderstatus, o_orderdate::DATE AS date, round(sum(o_totalprice), 2) AS total FROM orders WHERE day(o_orderdate) % 5 <> 0 GROUP BY 1, 2),
y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders WHERE day(o_orderdate) % 5 <> 0),
s AS (SELECT unnest(generate_series(make_date(y, 2, 1), make_date(y, 3, 31), INTERVAL 1 DAY))::DATE AS date FROM y)
SELECT k.o_orderstatus, s.date, total, year(s.date)::INTEGER AS year, month(s.date)::INTEGER AS month, monthname(s.date) AS month_name, CASE WHEN month(s.date) = 2 THEN 'Winter' ELSE 'Spring' END AS season, year(s.date)::INTEGER AS season_year, day(s.date)::INTEGER AS day, strftime(s.date, '%Y-%d') AS label
FROM (SELECT DISTINCT o_orderstatus FROM m) k CROSS JOIN s LEFT JOIN m ON m.o_orderstatus = k.o_orderstatus AND m.date = s.date""")
def calendar_days(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.dayofmonth("o_orderdate") % 5 != 0)
    m = o.groupBy("o_orderstatus", F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return joins.calendar_days(m, "date", ["o_orderstatus"], months=[2, 3])


@query("j04_cross_source_days", """WITH a AS (SELECT ts::DATE AS date, count(*) AS n0 FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(*) >= 5), b AS (SELECT ts::DATE AS date, count(*) AS n1 FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(*) >= 8), c AS (SELECT ts::DATE AS date, count(*) AS n2 FROM events GROUP BY 1 HAVING count(*) >= 20)
SELECT date, n0, n1, n2 FROM a JOIN b USING (date) JOIN c USING (date)""")
def cross_source_days(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return joins.cross_source_days([(e.where("event_type = 'click'"), "ts", 5), (e.where("event_type = 'view'"), "ts", 8), (e, "ts", 20)])


@query("j05_ticks_asof_rolling", """WITH e AS (SELECT user_id, ts + INTERVAL 16 DAY AS ts, event_id, value FROM events), t AS (SELECT user_id, date_trunc('hour', ts) + INTERVAL 6 HOUR AS tick FROM e GROUP BY 1, 2),
r AS (SELECT t.user_id, tick, value, e.ts, row_number() OVER (PARTITION BY t.user_id, tick ORDER BY e.ts DESC, event_id DESC) AS k FROM t JOIN e ON e.user_id = t.user_id AND e.ts < tick AND date_trunc('month', e.ts) = date_trunc('month', tick - INTERVAL 1 HOUR))
SELECT user_id, tick, round(avg(value), 8) AS mean, max(ts) AS newest_row FROM r WHERE k <= 60 GROUP BY 1, 2""")
def ticks_asof_rolling(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts") + F.expr("INTERVAL 16 DAYS"))
    ticks = e.select("user_id", (F.date_trunc("hour", "ts") + F.expr("INTERVAL 6 HOURS")).cast("timestamp_ntz").alias("tick")).distinct()
    return rounded(joins.ticks_asof_rolling(e, ticks, "user_id", "ts", "value", 60, ["event_id"]), 8)


@query("j06_best_forecast", """WITH r AS (SELECT DISTINCT ts::DATE AS run_day FROM events WHERE day(ts) % 3 <> 0), p AS (SELECT run_day, l * 3 AS lead FROM r, range(0, 28) t(l)),
v AS (SELECT run_day, lead, run_day + (lead // 24)::INTEGER AS date FROM p WHERE lead <= 84 AND lead // 24 <= 2), w AS (SELECT date, run_day FROM v GROUP BY 1, 2 HAVING count(DISTINCT lead) >= 8),
b AS (SELECT date, max(run_day) AS run_day FROM w WHERE date IN (SELECT ts::DATE FROM events) GROUP BY 1)
SELECT b.date, b.run_day, lead::DOUBLE AS lead_hours, round(day(b.run_day) + lead / 100.0::DOUBLE, 4) AS value FROM v JOIN b USING (date, run_day)""")
def best_forecast(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()
    leads = F.explode(F.transform(F.sequence(F.lit(0), F.lit(27)), lambda i: (i * 3).cast("double")))
    runs = days.where(F.dayofmonth("date") % 3 != 0).select(F.col("date").alias("run_day"), leads.alias("lead_hours"))
    runs = runs.withColumn("value", F.round(F.dayofmonth("run_day") + F.col("lead_hours") / 100, 4))
    return joins.best_forecast(runs, days).select("date", "run_day", "lead_hours", "value")


@query("j07_drop_already_selected", OBS + " SELECT date, count(*) AS n FROM o WHERE date NOT IN (SELECT date FROM o GROUP BY date ORDER BY count(*) DESC, date LIMIT 10) GROUP BY 1")
def drop_already_selected(spark, sf_dir):
    days = observations(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return joins.drop_already_selected(days, windows.top_n(days, [F.desc("n"), F.col("date")], 10))


@query("j10_attach_file_facts", "SELECT n_name, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def attach_file_facts(spark, sf_dir):
    facts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return rounded(joins.attach_file_facts(table(spark, sf_dir, "customer"), facts, "c_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean")))
