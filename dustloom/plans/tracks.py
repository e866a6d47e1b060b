"""Queries of geometry, proximity, interpolation and streaming, on tracks and messages derived from the given tables."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from dustloom.operators import geo, joins, windows
from dustloom.plans.observations import rounded, table
from dustloom.plans.texts import count, message_json
from dustloom.session import shared_dir
from dustloom.sources.files import read_messages
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


#: A sample for each event: an object's place on a tilted circle, by the event's number.
TRACK = """WITH s AS (SELECT user_id % 10 AS object, ts, event_id, round(80 * sin(event_id / 40.0), 6) AS lat, round((event_id * 0.7) % 360 - 180, 6) AS lon FROM events)"""


def samples(spark, sf_dir):
    """Longitudes are decimals, as in SQL: with doubles a whole turn may come out just below 360, which is 180 and no longer -180."""
    k = F.col("event_id")
    lon = (k.cast("decimal(19,0)") * F.lit(Decimal("0.7"))) % 360 - 180
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("object"), "ts", "event_id", F.round(80 * F.sin(k / 40.0), 6).alias("lat"), lon.cast("decimal(10,6)").alias("lon"))


DISTANCE = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lat - 42.7) / 2), 2) + cos(radians(42.7)) * cos(radians(lat)) * pow(sin(radians(lon - 23.3) / 2), 2))))"


def measured(spark, sf_dir):
    from dustloom.functions.columns import great_circle_km

    return samples(spark, sf_dir).withColumn("km", F.round(great_circle_km(F.lit(42.7), F.lit(23.3), F.col("lat"), F.col("lon")), 3))


ISLANDS = TRACK + f""", d AS (SELECT *, round({DISTANCE}, 3) AS km FROM s), m AS (SELECT *, km < 4000 AS inn, lead(ts) OVER w AS nxt, lag(km < 4000) OVER w AS prv FROM d WINDOW w AS (PARTITION BY object ORDER BY ts)),
i AS (SELECT *, sum(CASE WHEN inn AND NOT coalesce(prv, false) THEN 1 ELSE 0 END) OVER (PARTITION BY object ORDER BY ts) AS island FROM m)"""


@query("w03_proximity_intervals", ISLANDS + """ SELECT object, min(ts) AS start, max_by(coalesce(nxt, ts), ts) AS "end", arg_min(ts, (km, ts)) AS closest, min(km) AS min_distance, count(*) AS samples FROM i WHERE inn GROUP BY object, island""")
def proximity_intervals(spark, sf_dir):
    return windows.proximity_intervals(measured(spark, sf_dir), ["object"], "ts", "km", 4000.0)


@query("w04_local_minima", TRACK + f""", d AS (SELECT *, round({DISTANCE}, 3) AS km FROM s), n AS (SELECT *, lag(km) OVER w AS a, lead(km) OVER w AS b FROM d WINDOW w AS (PARTITION BY object ORDER BY ts)) SELECT object, event_id, km FROM n WHERE km <= a AND km <= b""")
def local_minima(spark, sf_dir):
    return windows.local_minima(measured(spark, sf_dir), ["object"], "ts", "km").select("object", "event_id", "km")


@query("w05_passes", TRACK + """, m AS (SELECT object, ts, lat, epoch_us(ts) / 1e6 AS s, lag(lat) OVER w AS pe, lag(epoch_us(ts) / 1e6) OVER w AS ps, lead(lat) OVER w AS ne, lead(epoch_us(ts) / 1e6) OVER w AS ns FROM s WINDOW w AS (PARTITION BY object ORDER BY ts)),
i AS (SELECT *, sum(CASE WHEN lat > 40 AND NOT coalesce(pe > 40, false) THEN 1 ELSE 0 END) OVER (PARTITION BY object ORDER BY ts) AS island FROM m)
SELECT object, round(arg_min(coalesce(CASE WHEN pe <= 40 THEN ps + (s - ps) * (40 - pe) / (lat - pe) END, -1), ts), 2) AS rise, round(arg_max(coalesce(CASE WHEN ne <= 40 THEN s + (ns - s) * (lat - 40) / (lat - ne) END, -1), ts), 2) AS "set", max(lat) AS peak FROM i WHERE lat > 40 GROUP BY object, island""")
def passes(spark, sf_dir):
    got = windows.passes(samples(spark, sf_dir), ["object"], "ts", "lat", 40.0, closed=False)
    return got.select("object", F.round(F.coalesce("rise", F.lit(-1.0)), 2).alias("rise"), F.round(F.coalesce("set", F.lit(-1.0)), 2).alias("set"), "peak")


#: Passes above 40 that the samples show whole and that overlap three weeks, with longitudes as azimuths and numbers as ranges.
@query("w05_passes_in_full", TRACK + """, z AS (SELECT object, ts, lat, event_id, epoch_us(ts) / 1e6 AS s, (event_id * 7) % 360 AS az FROM s),
m AS (SELECT *, lag(lat) OVER w AS pe, lag(s) OVER w AS ps, lag(az) OVER w AS pa, lead(lat) OVER w AS ne, lead(s) OVER w AS ns, lead(az) OVER w AS na FROM z WINDOW w AS (PARTITION BY object ORDER BY ts)),
i AS (SELECT *, sum(CASE WHEN lat >= 40 AND NOT coalesce(pe >= 40, false) THEN 1 ELSE 0 END) OVER (PARTITION BY object ORDER BY ts) AS island, (40 - pe) / (lat - pe) AS up, (lat - 40) / (lat - ne) AS down FROM m),
g AS (SELECT object, min(CASE WHEN pe < 40 THEN ps + (s - ps) * up END) AS rise, max(CASE WHEN ne < 40 THEN s + (ns - s) * down END) AS "set", max(lat) AS peak, arg_max(s, (lat, -s)) AS peak_at,
  max(CASE WHEN pe < 40 THEN pa + (((az - pa + 540) % 360) - 180) * up END) AS ra, arg_max(az, (lat, -s)) AS peak_azimuth, max(CASE WHEN ne < 40 THEN az + (((na - az + 540) % 360) - 180) * down END) AS sa, arg_max(event_id, (lat, -s)) AS peak_range
  FROM i WHERE lat >= 40 GROUP BY object, island)
SELECT object, round(rise, 2) AS rise, round("set", 2) AS "set", peak, round(peak_at, 2) AS peak_at, round(ra - 360 * floor(ra / 360), 3) AS rise_azimuth, peak_azimuth, round(sa - 360 * floor(sa / 360), 3) AS set_azimuth, peak_range, rise < 1704672000 AS ongoing
FROM g WHERE rise IS NOT NULL AND "set" > 1704672000 AND rise < 1706400000""")
def passes_in_full(spark, sf_dir):
    seen = samples(spark, sf_dir).withColumn("az", F.col("event_id") * 7 % 360)
    got = windows.passes(seen, ["object"], "ts", "lat", 40.0, "az", "event_id", 1704672000.0, 1706400000.0)
    return got.select("object", F.round("rise", 2).alias("rise"), F.round("set", 2).alias("set"), "peak", F.round("peak_at", 2).alias("peak_at"), F.round("rise_azimuth", 3).alias("rise_azimuth"), "peak_azimuth", F.round("set_azimuth", 3).alias("set_azimuth"), "peak_range", "ongoing")


@query("w06_track_segments", TRACK + """, j AS (SELECT *, coalesce((abs(lon - lag(lon) OVER (PARTITION BY object ORDER BY ts)) > 180)::INTEGER, 0) AS jump FROM s), g AS (SELECT *, (sum(jump) OVER (PARTITION BY object ORDER BY ts))::BIGINT AS segment FROM j)
SELECT object, segment, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) > 1""")
def track_segments(spark, sf_dir):
    return windows.track_segments(samples(spark, sf_dir), ["object"], "ts", "lon").groupBy("object", "segment").agg(count())


#: Greedy by a chain: the first minimum of an object, then each time the next one half an hour or more later.
MINIMA = TRACK + f""", d AS (SELECT *, round({DISTANCE}, 3) AS km FROM s), n AS (SELECT *, lag(km) OVER w AS a, lead(km) OVER w AS b FROM d WINDOW w AS (PARTITION BY object ORDER BY ts)), m AS MATERIALIZED (SELECT object, ts, event_id, km FROM n WHERE km <= a AND km <= b)"""


@query("w09_suppress_close_events", MINIMA.replace("WITH", "WITH RECURSIVE", 1) + """, x AS MATERIALIZED (SELECT a.object, a.ts, b.ts AS later FROM (SELECT DISTINCT object, ts FROM m) a ASOF LEFT JOIN (SELECT DISTINCT object, ts FROM m) b ON a.object = b.object AND a.ts + INTERVAL 30 MINUTE <= b.ts),
k AS (SELECT object, min(ts) AS ts FROM m GROUP BY 1 UNION ALL SELECT x.object, x.later FROM k JOIN x ON x.object = k.object AND x.ts = k.ts WHERE x.later IS NOT NULL)
SELECT object, ts, event_id, km FROM m JOIN k USING (object, ts) QUALIFY row_number() OVER (PARTITION BY object, ts ORDER BY event_id, km) = 1""")
def suppress_close_events(spark, sf_dir):
    minima = windows.local_minima(measured(spark, sf_dir), ["object"], "ts", "km").select("object", "ts", "event_id", "km")
    return windows.suppress_close_events(minima, ["object"], "ts")


def suppliers(spark, sf_dir):
    """Suppliers as targets, each at a place by its key."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("target"), (k * 37 % 160 - 80).cast("double").alias("t_lat"), (k * 91 % 360 - 180).cast("double").alias("t_lon"))


@query("j08_targets_x_samples", TRACK + """, t AS (SELECT s_suppkey AS target, (s_suppkey * 37 % 160 - 80)::DOUBLE AS t_lat, (s_suppkey * 91 % 360 - 180)::DOUBLE AS t_lon FROM supplier),
d AS (SELECT target, event_id, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(lat - t_lat) / 2), 2) + cos(radians(t_lat)) * cos(radians(lat)) * pow(sin(radians(lon - t_lon) / 2), 2)))) AS km FROM s, t)
SELECT target, event_id, round(km, 3) AS km FROM d WHERE km <= 300""")
def targets_x_samples(spark, sf_dir):
    places, members = joins.by_place(suppliers(spark, sf_dir))
    found = joins.targets_x_samples(samples(spark, sf_dir), places, 300.0).select("target", "event_id", F.round("distance_km", 3).alias("km"))
    return joins.of_targets(found, members)


@query("j09_bilinear", """WITH g AS (SELECT vec_id, embedding AS e, (vec_id % 17) / 2.0::DOUBLE - 0.5 AS y, (vec_id % 13) / 2.0::DOUBLE AS x FROM embeddings),
c AS (SELECT *, greatest(0, least(6, floor(y)))::INTEGER AS i0, greatest(0, least(6, floor(x)))::INTEGER AS j0 FROM g)
SELECT vec_id, round((1 - (y - i0)) * (1 - (x - j0)) * e[i0 * 8 + j0 + 1]::DOUBLE + (1 - (y - i0)) * (x - j0) * e[i0 * 8 + j0 + 2]::DOUBLE + (y - i0) * (1 - (x - j0)) * e[i0 * 8 + j0 + 9]::DOUBLE + (y - i0) * (x - j0) * e[i0 * 8 + j0 + 10]::DOUBLE, 6) AS value, y < 0 OR y > 7 OR x < 0 OR x > 7 AS extrapolated FROM c""")
def bilinear(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    grid = e.select("vec_id", F.posexplode("embedding").alias("k", "v")).select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("i"), (F.col("k") % 8).alias("j"), F.col("v").cast("double").alias("value"))
    points = e.select("vec_id", F.lit(0).alias("point"), ((F.col("vec_id") % 17) / 2 - 0.5).alias("y"), ((F.col("vec_id") % 13) / 2).alias("x"))
    return joins.bilinear(grid, points, ["vec_id"], 8, 8).select("vec_id", F.round("value", 6).alias("value"), "extrapolated")


@query("j09_bilinear_in_tiles", ORACLE["j09_bilinear"])
def bilinear_in_tiles(spark, sf_dir):
    """The same points in grids as tiles of three cells a side."""
    e = table(spark, sf_dir, "embeddings")
    grid = e.select("vec_id", F.posexplode("embedding").alias("k", "v")).select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("i"), (F.col("k") % 8).alias("j"), F.col("v").cast("double").alias("value"))
    points = e.select("vec_id", F.lit(0).alias("point"), ((F.col("vec_id") % 17) / 2 - 0.5).alias("y"), ((F.col("vec_id") % 13) / 2).alias("x"))
    got = joins.bilinear_in_tiles(joins.tiled(grid, ["vec_id"], 3), points, ["vec_id"], 8, 8, 3)
    return got.select("vec_id", F.round("value", 6).alias("value"), "extrapolated")


def above(lat, lon):
    """Earth-fixed position 400 km above a place."""
    lat, lon, r = F.radians(lat), F.radians(lon), 6771.0
    return {"x": r * F.cos(lat) * F.cos(lon), "y": r * F.cos(lat) * F.sin(lon), "z": r * F.sin(lat)}


def positions(spark, sf_dir):
    """Samples with earth-fixed positions above the ground below."""
    return samples(spark, sf_dir).withColumns(above(F.col("lat"), F.col("lon")))


#: The ray from 400 km above along three degrees behind the vertical, and the nearer of its two points on the ellipsoid.
FOOTPRINT = """, u AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS ux, cos(radians(lat)) * sin(radians(lon)) AS uy, sin(radians(lat)) AS uz FROM s),
m AS (SELECT *, 6771.0::DOUBLE * (lead(ux) OVER w - lag(ux) OVER w) AS mx, 6771.0::DOUBLE * (lead(uy) OVER w - lag(uy) OVER w) AS my, 6771.0::DOUBLE * (lead(uz) OVER w - lag(uz) OVER w) AS mz FROM u WINDOW w AS (PARTITION BY object ORDER BY ts)),
t AS (SELECT *, mx - (mx * ux + my * uy + mz * uz) * ux AS tx, my - (mx * ux + my * uy + mz * uz) * uy AS ty, mz - (mx * ux + my * uy + mz * uz) * uz AS tz FROM m),
r AS (SELECT *, -cos(radians(3)) * ux - sin(radians(3)) * tx / nullif(sqrt(tx * tx + ty * ty + tz * tz), 0) AS rx, -cos(radians(3)) * uy - sin(radians(3)) * ty / nullif(sqrt(tx * tx + ty * ty + tz * tz), 0) AS ry, -cos(radians(3)) * uz - sin(radians(3)) * tz / nullif(sqrt(tx * tx + ty * ty + tz * tz), 0) AS rz FROM t),
e AS (SELECT *, 6378.137::DOUBLE ^ 2 AS aa, (6378.137::DOUBLE * (1 - 1 / 298.257223563::DOUBLE)) ^ 2 AS bb, 6771.0::DOUBLE * ux AS x, 6771.0::DOUBLE * uy AS y, 6771.0::DOUBLE * uz AS z FROM r),
q AS (SELECT *, (rx * rx + ry * ry) / aa + rz * rz / bb AS qa, 2 * ((x * rx + y * ry) / aa + z * rz / bb) AS qb, (x * x + y * y) / aa + z * z / bb - 1 AS qc FROM e),
p AS (SELECT *, (-qb - sqrt(CASE WHEN qb * qb - 4 * qa * qc >= 0 THEN qb * qb - 4 * qa * qc END)) / (2 * qa) AS far FROM q),
h AS (SELECT *, x + far * rx AS hx, y + far * ry AS hy, z + far * rz AS hz FROM p),
g AS (SELECT *, degrees(atan2(hz, sqrt(hx * hx + hy * hy) * bb / aa)) AS foot_lat, degrees(atan2(hy, hx)) AS foot_lon FROM h),
f AS (SELECT *, CASE WHEN foot_lat IS NOT NULL THEN 2 * 6371.0088::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(foot_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(foot_lat)) * pow(sin(radians(foot_lon - lon) / 2), 2)))) END AS offset_km FROM g)"""


@query("g01_sample_footprints", TRACK + FOOTPRINT + " SELECT object, event_id, round(foot_lat, 4) AS foot_lat, round(foot_lon, 4) AS foot_lon, round(offset_km, 4) AS offset_km FROM f")
def sample_footprints(spark, sf_dir):
    return rounded(geo.sample_footprints(positions(spark, sf_dir), ["object"], "ts").select("object", "event_id", "foot_lat", "foot_lon", "offset_km"))


def great_circle_sql(lat, lon):
    return f"CASE WHEN {lat} IS NOT NULL THEN 2 * 6371.0088::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({lat} - t_lat) / 2), 2) + cos(radians(t_lat)) * cos(radians({lat})) * pow(sin(radians({lon} - t_lon) / 2), 2)))) END"


@query("g02_target_events", TRACK.replace("WITH", "WITH RECURSIVE", 1) + FOOTPRINT + f""", o AS (SELECT s_suppkey AS target, (s_suppkey * 37 % 160 - 80)::DOUBLE AS t_lat, (s_suppkey * 91 % 360 - 180)::DOUBLE AS t_lon FROM supplier),
v AS (SELECT object, ts, event_id, lat, lon, foot_lat, foot_lon, lag(ts) OVER w AS ts_a, lag(lat) OVER w AS lat_a, lag(lon) OVER w AS lon_a, lead(ts) OVER w AS ts_b, lead(lat) OVER w AS lat_b, lead(lon) OVER w AS lon_b FROM f WINDOW w AS (PARTITION BY object ORDER BY ts)),
d AS (SELECT *, {great_circle_sql('lat', 'lon')} AS km, {great_circle_sql('lat_a', 'lon_a')} AS a, {great_circle_sql('lat_b', 'lon_b')} AS b FROM v, o),
i AS (SELECT *, sum(CASE WHEN a IS NULL OR a > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY object, target ORDER BY ts) AS run FROM d WHERE km <= 1500),
c AS (SELECT object, target, run, min(CASE WHEN a > 1500 THEN ts + to_microseconds(round((epoch_us(ts_a) - epoch_us(ts)) * ((1500 - km) / (a - km)))::BIGINT) WHEN a IS NULL THEN ts END) AS entry, max(CASE WHEN b > 1500 THEN ts + to_microseconds(round((epoch_us(ts_b) - epoch_us(ts)) * ((1500 - km) / (b - km)))::BIGINT) WHEN b IS NULL THEN ts END) AS "exit", count(*) AS samples FROM i GROUP BY 1, 2, 3),
l AS MATERIALIZED (SELECT * FROM i JOIN c USING (object, target, run) WHERE km <= a AND km <= b AND foot_lat IS NOT NULL AND "exit" > TIMESTAMP '2024-01-02' AND entry < TIMESTAMP '2024-01-30'),
y AS MATERIALIZED (SELECT a.object, a.target, a.ts, b.ts AS later FROM (SELECT DISTINCT object, target, ts FROM l) a ASOF LEFT JOIN (SELECT DISTINCT object, target, ts FROM l) b ON a.object = b.object AND a.target = b.target AND a.ts + INTERVAL 30 MINUTE <= b.ts),
k AS (SELECT object, target, min(ts) AS ts FROM l GROUP BY 1, 2 UNION ALL SELECT y.object, y.target, y.later FROM k JOIN y ON y.object = k.object AND y.target = k.target AND y.ts = k.ts WHERE y.later IS NOT NULL)
SELECT object, target, event_id, round(km, 3) AS km, round(foot_lat, 4) AS foot_lat, round(foot_lon, 4) AS foot_lon, date_trunc('second', entry) AS entry, date_trunc('second', "exit") AS "exit", samples, entry < TIMESTAMP '2024-01-02' AS ongoing
FROM (SELECT * FROM l JOIN k USING (object, target, ts) QUALIFY row_number() OVER (PARTITION BY object, target, ts ORDER BY event_id) = 1)""")
def target_events(spark, sf_dir):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    places, members = joins.by_place(suppliers(spark, sf_dir))
    seen = samples(spark, sf_dir).withColumn("lon", F.col("lon").cast("double"))
    got = geo.target_events(seen, places, "ts", 1500.0, at("2024-01-02"), at("2024-01-30"), aft_degrees=3.0, position=above)
    second = lambda c: F.date_trunc("second", c).cast("timestamp_ntz").alias(c)
    events = got.select("object", "target", "event_id", F.round("distance_km", 3).alias("km"), F.round("foot_lat", 4).alias("foot_lat"), F.round("foot_lon", 4).alias("foot_lon"), second("entry"), second("exit"), "samples", "ongoing")
    return joins.of_targets(events, members)


@query("g03_ground_track", TRACK + """, k AS (SELECT * FROM s WHERE abs(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-15')) <= 200000 * 60 AND (epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-15'))::BIGINT % 3 = 0),
j AS (SELECT *, coalesce((abs(lon - lag(lon) OVER (PARTITION BY object ORDER BY ts)) > 180)::INTEGER, 0) AS jump FROM k), g AS (SELECT *, (sum(jump) OVER (PARTITION BY object ORDER BY ts))::BIGINT AS segment FROM j)
SELECT object, segment, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) > 1""")
def ground_track(spark, sf_dir):
    got = geo.ground_track(samples(spark, sf_dir), ["object"], "ts", "lon", F.lit("2024-01-15").cast("timestamp"), half_minutes=200_000, step_s=3)
    return got.groupBy("object", "segment").agg(count())


def streamed(spark, sf_dir, build):
    """Runs build(stream of the events table) to its end and reads what it wrote to the shared folder."""
    base = f"{shared_dir(spark)}/dustloom-stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("timestamp", F.col("ts").cast("timestamp"))
    out = build(events)
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query("st04_dedup_messages", "SELECT user_id::VARCHAR AS device_id, count(DISTINCT event_id // 2) AS n FROM events GROUP BY 1")
def dedup_messages(spark, sf_dir):
    def build(e):
        return jobs.dedup_messages(e.select(F.col("user_id").cast("string").alias("device_id"), F.floor(F.col("event_id") / 2).alias("seq"), "timestamp"), late="60 days")

    return streamed(spark, sf_dir, build).groupBy("device_id").agg(count())


@query("st07_telemetry_windows", "SELECT user_id AS device_id, time_bucket(INTERVAL 1 DAY, ts) AS start, round(avg(value), 4) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def telemetry_windows(spark, sf_dir):
    """Batch form; the stream's closed windows are a part of it, as the tests show."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("timestamp"), "value")
    got = jobs.telemetry_windows(e, ["value"], "1 day", late=None)
    return rounded(got.withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("st07_telemetry_stream", "SELECT user_id AS device_id, time_bucket(INTERVAL 1 DAY, ts) AS start, round(avg(value), 4) AS value, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def telemetry_stream(spark, sf_dir):
    def build(e):
        return jobs.telemetry_windows(e.select(F.col("user_id").alias("device_id"), "timestamp", "value"), ["value"], "1 day", late="1 day")

    return rounded(streamed(spark, sf_dir, build).withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("st07_outage_sessions", """WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 DAY)::INTEGER, 0) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id AS device_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def outage_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("timestamp"))
    got = jobs.outage_sessions(e, "1 day", late=None)
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("st01_hourly_points", """WITH e AS (SELECT user_id, ts, event_id, value FROM events), h AS (SELECT date_trunc('hour', max(ts)) AS hour FROM e), t AS (SELECT DISTINCT user_id, unnest(generate_series(hour - INTERVAL 23 HOUR, hour, INTERVAL 1 HOUR)) AS tick FROM e, h),
r AS (SELECT t.user_id, tick, value, e.ts, row_number() OVER (PARTITION BY t.user_id, tick ORDER BY e.ts DESC) AS k FROM t JOIN e ON e.user_id = t.user_id AND e.ts < tick AND date_trunc('month', e.ts) = date_trunc('month', tick - INTERVAL 1 HOUR))
SELECT user_id, tick, round(avg(value), 8) AS mean, max(ts) AS newest_row FROM r WHERE k <= 60 GROUP BY 1, 2""")
def hourly_points(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hour = e.agg(F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz")).first()[0]  # one value
    return rounded(jobs.hourly_points(e, F.lit(hour).cast("timestamp_ntz"), "user_id", "ts", "value"), 8)


@query("st02_publication_hour", "WITH m AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY 1) SELECT user_id, CASE WHEN newest >= TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 5 MINUTE THEN TIMESTAMP '2024-01-29 12:00:00' ELSE date_trunc('hour', newest) END AS hour FROM m")
def publication_hour(spark, sf_dir):
    newest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("newest"))
    return newest.select("user_id", jobs.publication_hour(F.col("newest"), F.lit("2024-01-29 12:34:56").cast("timestamp")).cast("timestamp_ntz").alias("hour"))


@query("st05_last_seen", "SELECT user_id::VARCHAR AS device_id, max(date_trunc('second', ts)) AS last_seen, epoch(TIMESTAMP '2024-01-30') - epoch(max(date_trunc('second', ts))) > 86400 AS offline FROM events WHERE event_type = 'view' GROUP BY 1")
def last_seen(spark, sf_dir):
    got = jobs.last_seen(read_messages(message_json(spark, sf_dir), "telemetry"), F.lit("2024-01-30").cast("timestamp"), 86400)
    return got.withColumn("last_seen", F.date_trunc("second", "last_seen").cast("timestamp_ntz"))


@query("st06_daily_water_budget", """WITH e AS (SELECT user_id AS device_id, ts, value AS amount_ml, epoch(date_trunc('second', ts)) - lag(epoch(date_trunc('second', ts))) OVER (PARTITION BY user_id ORDER BY ts, value) < 7200 AS early FROM events)
SELECT device_id, ts::DATE AS day, round(sum(amount_ml), 4) AS used, count(*) FILTER (coalesce(early, false)) AS early, sum(amount_ml) > 100 AS over FROM e GROUP BY 1, 2""")
def daily_water_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), F.col("ts").alias("timestamp"), F.col("value").alias("amount_ml"))
    return rounded(jobs.daily_water_budget(e, F.lit(100.0), 120))
