"""What depends on order, exact ranks and state: range scans, selection by bits, suppression, publications, binary ranges, streams."""

import datetime as dt
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dustloom.functions import columns as C
from dustloom.operators import joins, ranges, stats, windows
from dustloom.sources import binary, files, sinks, tables
from dustloom.streaming import state

START = dt.datetime(2020, 1, 1)


def tied_rows(n=3000):
    """Samples of which up to three have one time, and some are the same in all columns."""
    draw = random.Random(3)
    out = []
    for step in range(n):
        for _ in range(draw.randint(1, 3)):
            out.append((draw.choice(("dense", "dense", "dense", "b", None)), START + dt.timedelta(minutes=step // 2), round(draw.uniform(0, 4), 1), draw.randint(0, 5)))
    return out


def in_order(rows):
    """Rows of each key by time and the other columns."""
    keys = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), *r[1:])):
        keys.setdefault(r[0], []).append(r)
    return keys


def test_ties_and_partitions_change_nothing(spark):
    """Intervals, minima, passes and segments are the same for one, five and thirteen partitions, and equal a plain scan in total order."""
    rows = tied_rows()
    intervals, minima, segments = [], [], []
    for key, own in in_order(rows).items():
        run, segment, marks = [], 0, []
        for i, (_, at, v, _) in enumerate(own):
            if v < 1.5:
                run.append((at, v))
            if run and (v >= 1.5 or i == len(own) - 1):
                intervals.append((str(key), run[0][0], at, min(run, key=lambda x: (x[1], x[0]))[0], min(x[1] for x in run), len(run)))
                run = []
            if 0 < i < len(own) - 1 and v <= own[i - 1][2] and v <= own[i + 1][2]:
                minima.append((str(key), *own[i][1:]))
            segment += i > 0 and abs(round(v * 100) - round(own[i - 1][2] * 100)) > 180
            marks.append(segment)
        segments += [(str(key), s, marks.count(s)) for s in set(marks) if marks.count(s) > 1]
    schema = "k string, ts timestamp_ntz, v double, n int"
    key = F.coalesce("k", F.lit("None")).alias("k")
    for parts in ("1", "5", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            df = spark.createDataFrame(rows, schema).repartition(int(parts))
            got = windows.proximity_intervals(df, ["k"], "ts", "v", 1.5).select(key, "start", "end", "closest", "min_distance", "samples")
            assert sorted(map(tuple, got.collect())) == sorted(intervals)
            assert sorted(map(tuple, windows.local_minima(df, ["k"], "ts", "v").select(key, "ts", "v", "n").collect())) == sorted(minima)
            cut = windows.track_segments(df.withColumn("lon", F.round(F.col("v") * 100)), ["k"], "ts", "lon")
            assert sorted(map(tuple, cut.groupBy(key, "segment").agg(F.count("*")).collect())) == sorted(segments)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_dense_key_lies_in_many_tasks(spark):
    df = spark.range(4000).select(F.lit("one").alias("k"), F.col("id").alias("t"))
    o = ranges.ordered(df, ["k"], ["t"], parts=8)
    sizes = [r["n"] for r in o.rows.groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    got = ranges.running(o.rows, o, {"n": ("sum", F.lit(1)), "top": ("max", -F.col("t")), "x": ("xor", F.col("t"))}, write=False)
    xors = np.bitwise_xor.accumulate(np.arange(4000))
    assert all(r["n"] == r["t"] + 1 and r["top"] == 0 and r["x"] == xors[r["t"]] for r in got.collect())
    assert ranges.beside(ranges.ordered(df.limit(0), ["k"], ["t"]), ["t"]).count() == 0


@pytest.mark.parametrize("parts", [1, 30])
def test_last_rows_over_partitions(spark, parts):
    """Means of the last seven rows, and ticks that look back over them, with more partitions than rows of a key and with ties."""
    draw = random.Random(6)
    rows = [(k, START + dt.timedelta(hours=draw.randint(0, 400)), draw.randint(0, 9) if draw.random() < 0.9 else None) for k in ("dense",) * 300 + ("b", None) * 20]
    want = []
    for own in in_order([(k, at, (-1 if v is None else v)) for k, at, v in rows]).values():
        for i, r in enumerate(own):
            values = [x[2] for x in own[max(0, i - 6) : i + 1] if x[2] >= 0]
            want.append((str(r[0]), r[1], r[2], round(sum(values) / len(values), 9) if values else -1, len(values)))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v int")
        got = windows.rolling_last_k(df, ["k"], ["ts"], "v", 7)
        key = F.coalesce("k", F.lit("None"))
        assert sorted(tuple(r) for r in got.select(key, "ts", F.coalesce("v", F.lit(-1)), F.coalesce(F.round("rolling_mean", 9), F.lit(-1.0)), "rolling_n").collect()) == sorted(want)
        ticks = spark.createDataFrame([(k, START + dt.timedelta(hours=h)) for k in ("dense", "b") for h in range(0, 500, 50)], "k string, tick timestamp_ntz")
        means = {(r["k"], r["tick"]): (None if r["mean"] is None else round(r["mean"], 9), r["newest_row"]) for r in joins.ticks_asof_rolling(df, ticks, "k", "ts", "v", 7).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k, tick in [(k, START + dt.timedelta(hours=h)) for k in ("dense", "b") for h in range(0, 500, 50)]:
        month = (tick - dt.timedelta(hours=1)).month
        before = [(at, v) for kk, at, v in sorted(rows, key=lambda r: (str(r[0]), r[1], -1 if r[2] is None else r[2])) if kk == k and at < tick and at.month == month][-7:]
        values = [v for _, v in before if v is not None]
        assert means.get((k, tick)) == ((round(sum(values) / len(values), 9) if values else None, before[-1][0]) if before else None)


def test_passes_in_full(spark):
    """Rise, set and azimuths between samples, the peak's range, threshold inclusive; passes that aren't whole or don't overlap are left out."""
    at = lambda m: START + dt.timedelta(minutes=m)
    el = [20, 5, 0, 10, 30, 10, 0, 9, 10, 9, 0, 0, 40, 60]
    df = spark.createDataFrame([("s", at(i), float(e), float((350 + 5 * i) % 360), 100.0 + i) for i, e in enumerate(el)], "k string, ts timestamp_ntz, e double, az double, km double")
    base = START.replace(tzinfo=dt.timezone.utc).timestamp()
    got = windows.passes(df, ["k"], "ts", "e", 10.0, "az", "km", base + 300, base + 3000).collect()
    assert [(round((r["rise"] - base) / 60, 6), round((r["set"] - base) / 60, 6), r["peak"], (r["peak_at"] - base) / 60, r["peak_range"], r["ongoing"]) for r in got] == [(8.0, 8.0, 10.0, 8.0, 108.0, False)]
    early = windows.passes(df, ["k"], "ts", "e", 10.0, "az", "km", base + 299, base + 3000).orderBy("rise").collect()
    assert len(early) == 2 and early[0]["ongoing"] and round(early[0]["rise_azimuth"], 6) == 5.0 and round(early[0]["set_azimuth"], 6) == 15.0
    assert windows.passes(df, ["k"], "ts", "e", 10.0, closed=False).count() == 4


def test_azimuths_turn_over_north(spark):
    rows = [("s", START + dt.timedelta(minutes=i), e, az) for i, (e, az) in enumerate([(0.0, 350.0), (20.0, 10.0), (0.0, 350.0)])]
    got = windows.passes(spark.createDataFrame(rows, "k string, ts timestamp_ntz, e double, az double"), ["k"], "ts", "e", 10.0, "az").collect()[0]
    assert min(got["rise_azimuth"], 360 - got["rise_azimuth"]) < 1e-9 and min(got["set_azimuth"], 360 - got["set_azimuth"]) < 1e-9


def greedy(rows, minutes):
    out, state_ = [], {}
    for key, at, *rest in sorted(rows, key=lambda r: (str(r[0]), *r[1:])):
        if key not in state_ or at - state_[key] >= dt.timedelta(minutes=minutes):
            state_[key] = at
            out.append((str(key), at, *rest))
    return sorted(out)


def test_suppression_by_pointers(spark):
    """Against the plain loop: a run without gaps, ties, lonely events, a null key, events without time."""
    draw = random.Random(9)
    rows = [("dense", START + dt.timedelta(minutes=draw.randint(0, 4000)), draw.randint(0, 3)) for _ in range(3000)]
    rows += [(k, START + dt.timedelta(minutes=draw.randint(0, 90000)), draw.randint(0, 3)) for k in ("thin", None) for _ in range(200)]
    df = spark.createDataFrame([*rows, ("dense", None, 1)], "k string, ts timestamp_ntz, v int").repartition(5)
    for minutes in (30, 0.5, 100000):
        got = windows.suppress_close_events(df, ["k"], "ts", minutes).select(F.coalesce("k", F.lit("None")), "ts", "v").collect()
        assert sorted(map(tuple, got)) == greedy(rows, minutes)
    assert windows.suppress_close_events(df.limit(0), ["k"], "ts").count() == 0


VALUES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), -float("inf"), float("nan"), 0.1, 1 / 3]


def test_ordered_bits(spark):
    """The bits of every kind of double, next to powers of two too, there and back, and in the order of the values."""
    near = [float(x) for e in range(-1074, 1024) for x in (np.ldexp(1.0, e), np.nextafter(np.ldexp(1.0, e), 0), np.nextafter(np.ldexp(1.0, e), np.inf))]
    every = VALUES + near + [-x for x in near[::7]]
    got = spark.createDataFrame([(x,) for x in every], "v double").select("v", stats.ordered_bits(F.col("v")).alias("b")).withColumn("w", stats.from_ordered_bits(F.col("b"))).collect()
    for r in got:
        v = r["v"]
        size = struct.unpack(">q", struct.pack(">d", abs(v)))[0]
        assert r["b"] == ((1 << 63) - 1 if v != v else 0 if v == 0 else -size if v < 0 else size), v
        assert r["w"] == v or (v != v and r["w"] != r["w"])


@pytest.mark.parametrize("bits,last", [(16, 1 << 14), (16, 40), (8, 0)])
def test_exact_quantiles_by_levels(spark, monkeypatch, bits, last):
    """Two levels or all of them give what numpy gives: ties, null keys, groups of one, values far apart, no buffer of a group's values."""
    monkeypatch.setattr(stats, "LEVEL_BITS", bits)
    monkeypatch.setattr(stats, "LAST_VALUES", last)
    draw = np.random.default_rng(8)
    groups = {"a": draw.normal(0, 1, 800), "b": np.round(draw.exponential(1, 700), 1), "c": np.array([4.0]), "d": np.array([1.0, 2.0]), None: draw.integers(-3, 3, 300).astype(float), "e": np.full(50, 7.0), "f": 10.0 ** draw.integers(-300, 300, 400), "g": np.array([-np.inf, 1.0, np.inf])}
    df = spark.createDataFrame([(k, float(x)) for k, own in groups.items() for x in own] + [("z", None)], "k string, value double").repartition(3)
    ps = (0.0, 0.05, 0.5, 0.95, 1.0) if bits == 16 else (0.05, 0.5)
    out = stats.exact_quantiles(df, ["k"], ps)
    assert " percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: r["q"] for r in out.collect()}
    assert set(got) == set(groups)
    for k, own in groups.items():
        if k != "g":
            assert np.allclose(got[k], np.quantile(own, ps), rtol=1e-12), k
    assert got["g"][2 if bits == 16 else 1] == 1.0


HEADERS = {
    "PM10": "PM10", "pm4": "PM4", "PM2.5": "PM2.5", "pm25": "PM2.5", "PM2_5": "PM2.5", "pm1": "PM1", " PM10 ": "PM10", "X-PM10 ": "PM10", "pm10 mean": "PM10", "a_pm1_b": "PM1", "a-pm4-b": "PM4", "PM1 - PM10": "PM1",
    "PM_ENVIRO_0011 - PM1_ambient - ug": "PM1", "PM_ENVIRO_0011-PM2.5_ambient": "PM2.5", "PM_ENVIRO_0011 - PM10ambient": "PM10", "PM_ENVIRO_7-P4.x": "PM4", "PM P10": "PM10", "pm pm2.5": "PM2.5", "PMPM10": "PM10", "pm_enviro_1-pm_enviro_2-p10": "PM10",
    "PM 10": None, "PM10.": None, "PM10ambient": None, "x pm10": None, "PM1.0": None, "PM2.50": None, "PM2.5.1": None, "mean PM2.5": None, "PM10/PM1": None, "PM2.5/PM10": None, "PM4,mean": None, "humidity": None, "": None, "pm100": None, "ppm10": None, "PMPM101": None,
}


def test_headers_of_sizes(spark):
    got = spark.createDataFrame([(h,) for h in [*HEADERS, None]], "h string").select("h", C.pm_fraction(F.col("h")).alias("f")).collect()
    assert {r["h"]: r["f"] for r in got} == {**HEADERS, None: None}


def test_export_times_in_texts(spark):
    """Dates and clocks are found within other text, by their separators."""
    rows = [
        ("01.02.2020", "10:00:00", True, False, dt.datetime(2020, 2, 1, 10)), ("1/2/2020", "1:05:09 pm", False, True, dt.datetime(2020, 1, 2, 13, 5, 9)), ("2020", "10:00:00", True, False, None),
        ("v1.2 on 03-04-2021.", "at 9:08:07", True, False, dt.datetime(2021, 4, 3, 9, 8, 7)), ("123.04.2020", "110:00:00", True, False, dt.datetime(2020, 4, 23, 10)), ("1.2.20201", "10:00:001", True, False, dt.datetime(2020, 2, 1, 10)),
        ("01.02.2020", "10:00:00  AM", True, True, dt.datetime(2020, 2, 1, 10)), ("01.02.2020", "10:0:00", True, False, None), ("13/13/2020", "10:00:00", False, False, None), (None, "10:00:00", True, False, None), ("01.02.2020", None, True, False, None), ("", "", True, False, None),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, d string, t string, day_first boolean, half boolean")
    got = df.select("i", C.parse_export_timestamp(F.col("d"), F.col("t"), F.col("day_first"), F.col("half")).alias("at")).orderBy("i").collect()
    assert [r["at"] for r in got] == [r[4] for r in rows]


def test_archive_keeps_every_day(spark, tmp_path):
    """Three publications over two days; a reader keeps its table; old tables that no day needs go."""
    path = str(tmp_path / "p")
    hours = lambda last: spark.createDataFrame([(last - dt.timedelta(hours=k), 23 - k) for k in range(24)], "ts timestamp_ntz, v int")
    held = None
    for i, last in enumerate((dt.datetime(2020, 5, 1, 23), dt.datetime(2020, 5, 2, 5), dt.datetime(2020, 5, 2, 22), dt.datetime(2020, 5, 3, 0))):
        sinks.publish_latest(hours(last), path, "ts", keep=2)
        held = held or sinks.read_latest(spark, path)
        assert sinks.read_latest(spark, path).agg(F.max("ts")).first()[0] == last
        got = {(str(r["day"]), r["n"], r["hi"].hour) for r in sinks.read_archive(spark, path).groupBy("day").agg(F.count("*").alias("n"), F.max("ts").alias("hi")).collect()}
        assert got == [{("2020-05-01", 24, 23)}, {("2020-05-01", 24, 23), ("2020-05-02", 24, 5)}, {("2020-05-01", 24, 23), ("2020-05-02", 24, 22)}, {("2020-05-01", 24, 23), ("2020-05-02", 24, 22), ("2020-05-03", 24, 0)}][i]
    assert held.count() == 24
    assert sorted(p.name for p in (tmp_path / "p" / "tables").iterdir() if p.name.startswith("number")) == ["number=1", "number=3", "number=4"]
    before = sinks.publications(spark, path).count()
    sinks.publish_latest(hours(START).limit(0), path, "ts")
    assert sinks.publications(spark, path).count() == before


def test_merges_touch_their_buckets(spark, tmp_path):
    """Files one after the other give what all rows give; a bucket without new rows isn't written again; a merge that wasn't logged doesn't count."""
    path = str(tmp_path / "t")
    schema = "day date, k int, at long, v int"
    day = lambda n: dt.date(2020, 1, n)
    parts = [[(day(1), 1, 5, 50), (day(2), 1, 1, 7)], [(day(1), 1, 3, 30), (day(1), 2, 9, 1), (None, 1, 1, 2)], [(day(3), 1, 1, 1)]]
    merge = lambda df: df.groupBy("day", "k").agg(F.min("at").alias("at"), F.min_by("v", "at").alias("v")).select("day", "k", "at", "v")
    assert tables.read_merged(spark, path, spark.createDataFrame([], schema).schema).count() == 0
    made = []
    for part in parts:
        df = spark.createDataFrame(part, schema)
        tables.merge_into(df, path, F.col("day"), merge)
        made.append({p.parent.name: {f.name for f in p.parent.iterdir()} for p in (tmp_path / "t" / "rows").glob("*/version=*")})
    every = spark.createDataFrame([r for part in parts for r in part], schema)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, tables.read_merged(spark, path, every.schema).collect()), key=key) == sorted(map(tuple, merge(every).collect()), key=key)
    assert [len(made[2][f"bucket={b}"]) for b in ("2020-01-01", "2020-01-02", "2020-01-03", "-")] == [2, 1, 1, 1]
    every.withColumns({"bucket": F.lit("2020-01-03"), "version": F.lit("lost")}).write.mode("append").partitionBy("bucket", "version").parquet(f"{path}/rows")
    assert tables.read_merged(spark, path, every.schema).count() == merge(every).count()


def test_tiles_equal_cells(spark):
    """Points in and outside the grid, with missing cells and empty values, in tiles of all sizes."""
    draw = random.Random(8)
    grid = [(g, i, j, None if draw.random() < 0.05 else draw.random()) for g in ("a", "b") for i in range(9) for j in range(13) if g == "a" or draw.random() < 0.8]
    points = [(g, n, draw.uniform(-1, 9), draw.uniform(-1, 13)) for g in ("a", "b") for n in range(60)]
    df, ps = spark.createDataFrame(grid, "g string, i int, j int, value double"), spark.createDataFrame(points, "g string, point int, y double, x double")
    rows = lambda out: sorted((r["g"], r["point"], None if r["value"] is None else round(r["value"], 9), r["corners"], r["extrapolated"]) for r in out.collect())
    want = rows(joins.bilinear(df, ps, ["g"], 9, 13))
    for side in (4, 64):
        tiles = joins.tiled(df, ["g"], side)
        assert rows(joins.bilinear_in_tiles(tiles, ps, ["g"], 9, 13, side)) == want
        assert tiles.agg(F.max(F.size("cells"))).first()[0] <= (side + 1) ** 2


def test_calendar_days(spark):
    df = spark.createDataFrame([("a", dt.date(2019, 2, 3), 1.0), ("b", dt.date(2020, 7, 1), 2.0), ("a", dt.date(2020, 12, 31), 3.0)], "k string, date date, v double")
    assert sorted((r["k"], r["label"], r["v"]) for r in joins.calendar_days(df, "date", ["k"]).collect()) == [("a", "2019-02-03", 1.0), ("a", "2020-12-31", 3.0), ("b", "2020-07-01", 2.0)]
    assert [r["v"] for r in joins.calendar_days(df, "date", ["k"], season_name="Summer").collect()] == [2.0]
    february = joins.calendar_days(df, "date", ["k"], months=[2])
    assert february.count() == 2 * (28 + 29) and {r["label"] for r in february.where("v IS NOT NULL").collect()} == {"2019-03"}
    winter = joins.calendar_days(df, "date", ["k"], years=[2020], season_name="Winter")
    assert winter.count() == 2 * (31 + 29 + 31) and [(r["label"], r["season_year"]) for r in winter.where("v IS NOT NULL").collect()] == [("31", 2021)]


def test_stitched_texts(spark):
    df = spark.createDataFrame([(1, '{"data": [{"forecast_hour": 3, "source_day": "2023-07-19", "timestamp": "19-7-2023 - 3:00", "value": 0.25}]}'), (2, "no json"), (3, None), (4, '{"data": []}')], "i int, j string")
    assert [tuple(r) for r in files.stitched_series(df, "j", ["i"]).collect()] == [(1, 3, dt.date(2023, 7, 19), dt.datetime(2023, 7, 19, 3), 0.25)]


def test_marks_by_ranges_of_bytes(spark, tmp_path):
    """Marks over the ends of ranges and reads, overlapping ones, files without any; the contents of the blocks."""
    draw = np.random.default_rng(2)
    made = {"a.bin": draw.integers(97, 99, 20_000).astype(np.uint8).tobytes(), "b.bin": b"xx" + b"aab" * 500 + b"tail", "c.bin": b"nothing", "d.bin": b"aa"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    want = {}
    for name, data in made.items():
        want[name] = [i for i in range(len(data)) if data.startswith(b"aa", i)]
    for step in (64, 1000, 1 << 20):
        got = {}
        for r in binary.marked_offsets(spark, [str(tmp_path)], b"aa", step).collect():
            got.setdefault(r["path"].rpartition("/")[2], []).append(r["offset"])
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert binary.marked_offsets(spark, [str(tmp_path)], b"aa", 64).rdd.getNumPartitions() > 300
    blocks = binary.with_contents(binary.marked_blocks(spark, [str(tmp_path / "b.bin"), str(tmp_path / "d.bin")], b"aab", 100)).orderBy("position").collect()
    assert [(r["position"], r["offset"], r["length"], r["blocks"]) for r in blocks] == [(i + 1, 2 + 3 * i, 3, 500) for i in range(500)]
    assert {bytes(r["content"]) for r in blocks} == {b"aab"}
    assert binary.marked_blocks(spark, [str(tmp_path / "c.bin")], b"aab").count() == 0


def finite(form, raw, at, low, high):
    size = struct.calcsize(form)
    if at + size > len(raw):
        return None
    x = struct.unpack(form, raw[at : at + size])[0]
    return x if np.isfinite(x) and low <= x <= high else None


def test_encodings_and_series_of_blocks(spark, monkeypatch):
    """The four encodings at every offset, and both tables of whole blocks, by Python's struct; short blocks are left out, long ones cut."""
    monkeypatch.setattr(files, "DECODED_AT_ONCE", 16)
    draw = np.random.default_rng(5)
    block = lambda n: b"".join(struct.pack(">d", float(x)) for x in draw.uniform(-2e5, 2e6, n)) + bytes(draw.integers(0, 256, 5).astype(np.uint8))
    contents = [block(6), block(6), block(6), block(3), block(9), block(6)[:20]]
    df = spark.createDataFrame([("f", i + 1, len(c), len(contents), c) for i, c in enumerate(contents)], "key string, position int, length long, blocks long, content binary")
    first = files.scan_encodings(df.where("position = 1"), "key", "content").collect()
    want = [(at, name, x) for name, form in (("float64_be", ">d"), ("float64_le", "<d"), ("float32_be", ">f"), ("float32_le", "<f")) for at in range(len(contents[0])) if (x := finite(form, contents[0], at, -1000, 1e6)) is not None]
    assert sorted((r["at"], r["encoding"], r["value"]) for r in first) == sorted(want)
    normal = len(contents[0])
    whole = {i + 1: c[:normal] for i, c in enumerate(contents) if len(c) >= normal}
    series = sorted((r["position"], r["at"], r["value"]) for r in files.block_series(df, "key", "content").collect())
    assert series == sorted((p, at, x) for p, c in whole.items() for at in range(normal - 8) if (x := finite(">d", c, at, -100, 1e5)) is not None)
    wide = {r["position"]: r["values"] for r in files.wide_blocks(df, "key", "content").collect()}
    assert wide == {p: [finite(">d", c, at, -1000, 1e6) for at in range(0, normal - 8, 8)] for p, c in whole.items()}


def wait_for(rows, want, seconds=60):
    for _ in range(seconds * 2):
        got = rows()
        if want(got):
            return got
        time.sleep(0.5)
    return rows()


def test_silence_is_told_without_messages(spark, tmp_path):
    """A device falls silent: the timer tells, and nothing else arrives. After a restart it speaks again."""
    path = str(tmp_path / "in")
    schema = "device_id string, timestamp timestamp"
    spark.createDataFrame([("a", START), ("b", START), (None, START)], schema).write.parquet(path)

    def run():
        stream = state.offline_devices(spark.readStream.schema(schema).parquet(path), 3)
        return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()

    rows = lambda: sorted((r["device_id"], r["event"]) for r in spark.read.schema("device_id string, event string, last_seen timestamp").parquet(str(tmp_path / "out")).collect())
    query = run()
    try:
        assert wait_for(rows, lambda got: len(got) == 2) == [("a", "offline"), ("b", "offline")]
    finally:
        query.stop()
    spark.createDataFrame([("a", START + dt.timedelta(hours=1))], schema).write.mode("append").parquet(path)
    query = run()
    try:
        assert wait_for(rows, lambda got: len(got) == 4) == [("a", "offline"), ("a", "offline"), ("a", "online"), ("b", "offline")]
    finally:
        query.stop()


def in_batches(spark, tmp_path, batches, schema, stream):
    """Runs a stream to its end after each of some batches, over restarts: all rows that came out."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_water_budget_over_batches(spark, tmp_path):
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    batches = [[("a", at(1), 50.0), ("a", at(1, 5), 60.0), ("b", at(2), 10.0)], [("a", at(3), 1.0), ("a", at(23, 50), 1.0), (None, at(3), 5.0)], [("a", at(24, 10), 5.0), ("a", at(23, 55), 2.0)]]
    got = in_batches(spark, tmp_path, batches, "device_id string, timestamp timestamp, amount_ml double", lambda s: state.water_budget_stream(s, 110.5, 15))
    assert sorted((r["device_id"], (r["ts"] - START).total_seconds() / 60, r["used"], r["early"], r["over"]) for r in got.collect()) == [
        ("a", 60.0, 50.0, False, False), ("a", 65.0, 110.0, True, False), ("a", 180.0, 111.0, False, True), ("a", 1430.0, 112.0, False, True), ("a", 1435.0, 114.0, True, True), ("a", 1450.0, 5.0, False, False), ("b", 120.0, 10.0, False, False),
    ]


def test_hourly_means_over_batches(spark, tmp_path):
    """Each hour that the watermark passes has the mean of the last sixty rows before it, in the month of the hour before; equal to the batch form."""
    draw = random.Random(4)
    start = dt.datetime(2020, 1, 31, 20)
    rows = sorted((s, start + dt.timedelta(minutes=draw.randint(0, 600), seconds=draw.randint(0, 59)), float(draw.randint(0, 9))) for s in ("x", "y") for _ in range(150))
    rows = sorted(rows, key=lambda r: r[1])
    got = in_batches(spark, tmp_path, [rows[:100], rows[100:250], rows[250:], [("y", start + dt.timedelta(hours=13), 0.0)]], "station string, ts timestamp, value double", lambda s: state.hourly_means_stream(s, "station", "ts", "value"))
    told = {(r["station"], r["tick"]): (round(r["mean"], 9), r["n"]) for r in got.collect()}
    want = {}
    for s in ("x", "y"):
        for h in range(1, 13):
            tick = start + dt.timedelta(hours=h)
            month = (tick - dt.timedelta(hours=1)).month
            before = [v for k, at, v in rows if k == s and at < tick and at.month == month][-60:]
            if before:
                want[s, tick] = (round(sum(before) / len(before), 9), len(before))
    assert told == want and len(want) > 20
