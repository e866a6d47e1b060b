"""Parsing rules on literal rows, invariants, order independence."""

import datetime as dt
import io
import re
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from dustloom.functions import columns as C
from dustloom.operators import clean, geo, joins, stats, windows
from dustloom.plans import texts as texts_plans
from dustloom.plans.observations import observations
from dustloom.sources import files, sinks, text
from dustloom.streaming import jobs
from tests.conftest import SF


def values(spark, rule, *rows):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], ", ".join(f"c{i} string" for i in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [r[0] for r in df.select(rule(*(F.col(c) for c in df.columns))).collect()]


def test_numbers(spark):
    assert values(spark, C.parse_locale_number, "1.234,5", " 7 ", "1 000", "x", "1,2,3", None) == [1234.5, 7.0, 1000.0, None, None, None]
    assert values(spark, C.clean_value, "-900", "-899.5", "NaN", "inf", "", "3") == [None, -899.5, None, None, None, 3.0]
    assert values(spark, C.is_number_like, "+1.5", "1e5", ".", "-", "1.", ".5", "1.2.3") == [True, False, False, False, True, True, False]


def test_dates(spark):
    day = dt.date(2020, 5, 13)
    assert values(spark, C.parse_date_multi, "13:05:2020", "13/05/2020", "2020-05-13", "05/13/2020", "43964", "x", None) == [day, day, day, day, day, None, None]
    assert values(spark, C.parse_time_multi, "1:02:03", "23:59", "0.5", "0.999999", "noon") == ["01:02:03", "23:59:00", "12:00:00", "00:00:00", "noon"]
    got = values(spark, lambda d, t, h: C.parse_export_timestamp(d, t, d.contains("."), h == "y"), ("1.2.2020", "13:00:00", "n"), ("1/2/2020", "1:00:00 PM", "y"), ("1/2/2020", "13:00:00", "y"))
    assert got == [dt.datetime(2020, 2, 1, 13), dt.datetime(2020, 1, 2, 13), None]


def test_names(spark):
    assert values(spark, C.pm_fraction, "PM_ENVIRO_0011 - PM1_ambient - ug", "a-PM10", "pm2_5", "time") == ["PM1", "PM10", "PM2.5", None]
    got = values(spark, C.year_month_from_path, "a/2020/may/x.xlsx", "mart 2021.xlsx", "x 1999 may", "2020/none.txt")
    assert [tuple(x) if x else None for x in got] == [(2020, 5), (2021, 3), None, None]
    assert values(spark, C.infer_unit, "Start_Time", "Angstrom_x", "Wind_Speed", "abc") == ["seconds", "unitless", "m/s", "unknown"]


def test_exports(spark):
    rows = ["meta", "Date beginning\tTime beginning\tDate end\tTime end\tPM_ENVIRO_1-PM10_x", "01/02/2020\t1:00:00 PM\t01/02/2020\t1:15:00 PM\t5", "13/13/2020\t1\t2\t3\t4", "01/02/2020\t1:00:00 PM\tx\ty\t1.000,5", "1\t2\t3\t4\t5\t6\t7"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(rows)] + [("g", 0, "nothing")], "path string, line_no int, line string")
    got = text.read_pm_exports(lines).orderBy("line_no").collect()
    assert [(r["ts"], r["pm10"], r["pm1"]) for r in got] == [(dt.datetime(2020, 1, 2, 13, 15), 5.0, None), (dt.datetime(2020, 1, 2, 13), 1000.5, None)]
    report = {r["path"]: r["status"] for r in text.load_report(lines, text.read_pm_exports(lines)).collect()}
    assert report == {"f": "Loaded", "g": "Skipped: no rows"}


def test_encodings(spark, tmp_path):
    body = "Date beginning\tß\n"
    for name, data in (("a", body.encode("utf-8-sig")), ("b", body.encode("utf-16")), ("c", body.encode("cp1252"))):
        (tmp_path / name).write_bytes(data)
    got = text.file_lines(spark, [str(tmp_path / n) for n in "abc"]).where("line_no = 0").collect()
    assert [r["line"] for r in got] == [body.strip()] * 3


def test_logs(spark):
    df = spark.createDataFrame([("G M0 1 2 3 4 5 6 7 8 9 10",), ("G XM0 1 2 3 4 5 6 7 8 9 10",), ("M0 1 2 3",)], "line string")
    assert [(r["temp_c"], r["wind_dir_deg"]) for r in text.read_m0_log(df).collect()] == [(1.0, 7.0)]
    kv = spark.createDataFrame([("z 0R1,Dn=1, Ta =2,Ua=3,Pa=4,junk,Dn=9",), ("none",)], "line string")
    assert [r["pairs"] for r in text.read_kv_log(kv.withColumn("line", F.regexp_replace("line", "Ta =", "Ta="))).collect()] == [{"Ta": "2", "Ua": "3", "Pa": "4", "Dn": "9"}]
    marker = spark.createDataFrame([("G97 NIT1 R250 M22 1 2",), ("a b c d e",)], "line string")
    assert [(r["station"], r["r"], r["m"]) for r in text.read_marker_log(marker).collect()] == [("NIT1", "250", "M22")]


def workbook(rows):
    cells = "".join(f"<row r='{i}'>" + "".join(f"<c r='{chr(65 + j)}{i}' t='inlineStr'><is><t>{v}</t></is></c>" for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1))
    main = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main} xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'><sheets><sheet name='S' r:id='r1'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships><Relationship Id='r1' Target='worksheets/sheet1.xml'/></Relationships>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["x"], ["Date(dd:mm:yyyy)", "Time(hh:mm:ss)", "AOD_500nm", "440-870_Angstrom_Exponent"], ["01:02:2020", "10:00:00", "0.5", None], ["01:02:2020", None, "-999", "1.1"]]))
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    cells = files.read_workbook_cells(spark, [str(tmp_path / "*.xlsx")])
    assert cells.where("error IS NOT NULL").count() == 1
    got = files.read_photometer_workbooks(cells.where("error IS NULL")).withColumn("v", C.clean_value(F.col("value"))).orderBy("row_no", "metric").collect()
    assert [(r["row_no"], r["metric"][:3], r["v"]) for r in got] == [(3, "440", None), (3, "AOD", 0.5), (4, "440", 1.1), (4, "AOD", None)]


def test_binary(spark):
    block = b"distribution" + struct.pack(">d", 42.5) + b"tail"
    df = spark.createDataFrame([("a", bytearray(b"head" + block * 3)), ("b", bytearray(b"none")), ("c", bytearray(block + b"x"))], "k string, content binary")
    got = {(r["k"], r["position"]): (r["offset"], r["length"]) for r in files.binary_blocks(df, "k", "content").collect()}
    n = len(block)
    assert got == {("a", 1): (4, n), ("a", 2): (4 + n, n), ("a", 3): (4 + 2 * n, n), ("c", 1): (0, n + 1)}
    one = spark.createDataFrame([("a", 1, bytearray(block))], "k string, position int, content binary")
    assert (12, 42.5) in {(r["at"], r["value"]) for r in files.decode_block_candidates(one, "k", "content", -1000, 1000).collect()}


def test_merge_and_duplicates_ignore_order(spark):
    rows = [("d", "t", "s", 1.0, None, "b", 2), ("d", "t", "s", 3.0, 2.0, "a", 1), ("d", "", "s", 1.0, None, "a", 3), ("d", "", "s", 2.0, None, "a", 4), ("d", "", "s", 1.0, None, "c", 5)]
    schema = "date string, time string, site string, x double, y double, src string, o int"
    for part in (1, 3):
        df = spark.createDataFrame(rows, schema).repartition(part)
        got = stats.merge_untimed(df, "date", "time", "site", ["x", "y"], ["o"], "src").orderBy("time_key", "x").collect()
        assert [(r["time_key"], r["x"], r["y"], r["sources"]) for r in got] == [("", 1.0, None, ["a", "c"]), ("", 2.0, None, ["a"]), ("t", 3.0, 2.0, ["a", "b"])]
        dup = stats.drop_exact_duplicates(df, ["x", "y"], ["o"]).orderBy("o").collect()
        assert [r["o"] for r in dup] == [1, 2, 4]


def test_histogram_invariants(spark):
    h = stats.cumulative_histogram(stats.histogram(observations(spark, SF), ["metric"]), ["metric"])
    for r in h.groupBy("metric").agg(F.sum("percent").alias("p"), F.max("cumulative_percent").alias("c"), F.sum("n").alias("n"), F.max("total").alias("t")).collect():
        assert abs(r["p"] - 100) < 0.05 and r["c"] == 100 and r["n"] == r["t"]


def test_skewness(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 1.0), ("b", 2.0), ("c", 3.0), ("c", 3.0), ("c", 3.0)], "k string, value double")
    got = {r["k"]: r["skewness"] for r in stats.descriptive(df, ["k"]).collect()}
    assert abs(got["a"] - 1.652319) < 1e-5 and got["b"] is None and got["c"] == 0


def test_selection_edges(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 12, 1),), (dt.datetime(2021, 1, 1),)], "ts timestamp_ntz")
    assert clean.select_periods(df, "ts", None).count() == 2
    assert clean.select_periods(df, "ts", ["2020-99"]).count() == 0
    assert clean.select_calendar(df, "ts", years=[2021], by_season_year=True).count() == 2


def test_close_events(spark):
    at = [dt.datetime(2020, 1, 1, 0, m) for m in (0, 20, 35, 59)] + [dt.datetime(2020, 1, 1, 1, 5)]
    df = spark.createDataFrame([("o", t) for t in at], "k string, ts timestamp_ntz")
    assert [r["ts"].minute for r in windows.suppress_close_events(df, ["k"], "ts").orderBy("ts").collect()] == [0, 35, 5]


def test_close_events_in_runs(spark):
    """Random times, with runs over midnights, equal to the plain loop; no worker is given a whole key."""
    import random

    draw, at = random.Random(3), {}
    for k in ("a", "b", None):
        t = dt.datetime(2020, 1, 1)
        for _ in range(400):
            t += dt.timedelta(minutes=draw.choice((5, 12, 20, 29, 30, 31, 45))) if draw.random() < 0.97 else dt.timedelta(hours=draw.randint(2, 60))
            at.setdefault(k, []).append(t)
    t = dt.datetime(2021, 1, 1)
    at["long"] = [t + dt.timedelta(minutes=20 * i) for i in range(300)]
    want = set()
    for k, times in at.items():
        last = None
        for t in times:
            if last is None or (t - last).total_seconds() >= 1800:
                want.add((k, t))
                last = t
    df = spark.createDataFrame([(k, t) for k, times in at.items() for t in times], "k string, ts timestamp_ntz").repartition(7)
    got = windows.suppress_close_events(df, ["k"], "ts")
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_export_timestamps(spark):
    """Texts around dates and clocks, either order, missing and superfluous halves of the day; by Python's patterns."""
    dates = ["1/2/2024", "31.01.2024", "on 02-03-2024.", "13/01/2024", "01/13/2024", "1/2/24", "1/2/20245", "0/1/2024", "x", "", None]
    times = ["1:02:03 PM", "13:02:03", "at 01:02:03am", "12:00:00 AM", "00:00:00", "0:00:00 AM", "24:00:00", "7:08", "1:02:03", "7:08:09 Pm.", "", None]
    given = [(d, t, f, h) for d in dates for t in times for f in (True, False) for h in (True, False)]

    def want(date, time, day_first, half_day):
        d, t = re.search(r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})", date or ""), re.search(r"(\d{1,2}):(\d{2}):(\d{2})(?:\s*([AP]M))?", time or "", re.IGNORECASE)
        if not d or not t or half_day != bool(t[4]):
            return None
        day, month = (d[1], d[2]) if day_first else (d[2], d[1])
        hour = int(t[1])
        if half_day and not 1 <= hour <= 12:
            return None
        if half_day:
            hour = hour % 12 + (12 if t[4].upper() == "PM" else 0)
        try:
            return dt.datetime(int(d[3]), int(month), int(day), hour, int(t[2]), int(t[3]))
        except ValueError:
            return None

    df = spark.createDataFrame(given, "d string, t string, f boolean, h boolean")
    got = df.select("d", "t", "f", "h", C.parse_export_timestamp(F.col("d"), F.col("t"), F.col("f"), F.col("h")).alias("ts")).collect()
    assert [(tuple(r)[:4], r["ts"]) for r in got if r["ts"] != want(*tuple(r)[:4])] == []
    assert sum(r["ts"] is not None for r in got) > 30


def test_whole_text_queries(spark, tmp_path):
    """Tagged and non-ASCII documents count; by brute force."""
    texts = ["a the b the c the d the é the f", "é日 the x\nü the <b> the 😀 the y", "<p>one</p>\n\n<i>\n</i>two<a\nb> the end\nx", "x\n<b the c>\n", "", None, "no mark", " the  the é the "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lengths, lines = {}, {}
    for i, t in enumerate(texts):
        at = [m.start() for m in re.finditer(b" the ", (t or "").encode())]
        own = [b - a for a, b in zip(at, at[1:], strict=False)]
        for x in own:
            lengths[i, x] = (own.count(x), x == max(dict.fromkeys(own), key=own.count))
        stripped = [x.strip(" ") for x in re.sub("<[^>]+>", "", t or "").split("\n")]
        stripped = [x for x in stripped if x]
        nth = next((k for k, x in enumerate(stripped, 1) if " the " in x), None)
        if nth:
            lines[i] = nth
    got = {(r["doc_id"], r["length"]): (r["n"], r["modal"]) for r in texts_plans.block_spacing_by_text(spark, str(tmp_path)).collect()}
    assert got == lengths and {1, 7} <= {i for i, _ in got}
    got = {r["doc_id"]: r["n_lines"] for r in texts_plans.read_tagged_pages(spark, str(tmp_path)).collect()}
    assert got == lines and 2 in got and 3 not in got


def test_forecast_days(spark):
    day = dt.date(2023, 7, 19)
    runs = spark.createDataFrame([(day, float(h)) for h in range(0, 73, 3)], "run_day date, lead_hours double")
    days = spark.createDataFrame([(day + dt.timedelta(d),) for d in range(4)], "date date")
    got = joins.best_forecast(runs, days).groupBy("date").agg(F.min("lead_hours").alias("a"), F.max("lead_hours").alias("b")).orderBy("date").collect()
    assert [(r["a"], r["b"]) for r in got] == [(0, 21), (24, 45), (48, 69)]


def test_footprint_is_behind(spark):
    import math

    rows = []
    for s in range(3):
        lat = math.radians(10 + s * 0.1)
        rows.append(("o", dt.datetime(2020, 1, 1, 0, 0, s), math.degrees(lat), 20.0, 6771 * math.cos(lat) * math.cos(math.radians(20)), 6771 * math.cos(lat) * math.sin(math.radians(20)), 6771 * math.sin(lat)))
    df = spark.createDataFrame(rows, "object string, ts timestamp_ntz, lat double, lon double, x double, y double, z double")
    got = [r for r in geo.sample_footprints(df, ["object"], "ts").orderBy("ts").collect() if r["foot_lat"] is not None]
    assert len(got) == 1 and got[0]["foot_lat"] < got[0]["lat"] and 10 < got[0]["offset_km"] < 30


def test_grid_and_profile(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]])], "k int, a array<array<double>>")
    assert [(r["meas_no"], r["row"], r["col"], r["value"]) for r in files.explode_arrays(df, ["k"], "a", 2).orderBy("meas_no").collect()] == [(1, 0, 0, 1.0), (2, 0, 1, 2.0), (3, 1, 0, 3.0), (4, 1, 1, 4.0)]
    lines = spark.createDataFrame([(1, 0, "v.v[1][2][2]"), (1, 1, "[0][0], 1.5e0, 2"), (1, 2, "[0][1], 3"), (1, 3, ""), (1, 4, "junk 9")], "k int, line_no int, line string")
    assert [(r["i"], r["j"], r["value"]) for r in text.read_grid_ascii(lines, ["k"]).orderBy("i", "j").collect()] == [(0, 0, 1.5), (0, 1, 2.0), (1, 0, 3.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r", {"a": "1.5", "b": 'x"'}, dt.datetime(2020, 1, 1), 0.123456789)], "raw string, pairs map<string,string>, ts timestamp_ntz, v double")
    assert sinks.json_lines(df, "pairs", "raw", F.lit(True)).first()[0] == '{"a":1.5,"b":"x\\"","raw":"r","parse_error":true}'
    sinks.write_csv(df.select("v"), str(tmp_path / "c"), 4, fixed=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()[0] == "0.1235"
    sinks.write_partitioned_days(df.drop("pairs"), str(tmp_path / "d"), "ts")
    assert (tmp_path / "d" / "day=2020-01-01").is_dir()
    sinks.write_report_bundle({"a": df}, df.select("v"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b" / "metadata")).count() == 1
    sinks.write_events_csv(df, str(tmp_path / "e"), ["raw", "v"])
    for v in (1.0, 2.0, 3.0):
        sinks.publish_latest(df.select("ts", F.lit(v).alias("v")), str(tmp_path / "p"), "ts")
        assert [r["v"] for r in sinks.read_latest(spark, str(tmp_path / "p")).collect()] == [v]


def test_hourly_stream_equals_batch(spark, tmp_path):
    from dustloom.plans.observations import table

    events = table(spark, SF, "events")
    rows = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parque[t]")
    jobs.hourly_rolling_stream(rows, str(tmp_path / "h"), str(tmp_path / "o"), str(tmp_path / "c"), "user_id", "ts", "value").awaitTermination()
    hour = events.agg(F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz")).first()[0]
    want = sorted(map(tuple, jobs.hourly_points(events, F.lit(hour).cast("timestamp_ntz"), "user_id", "ts", "value").select("user_id", "tick", F.round("mean", 8)).collect()))
    got = sorted(map(tuple, sinks.read_latest(spark, str(tmp_path / "o")).select("user_id", "tick", F.round("mean", 8)).collect()))
    assert got == want and got


def test_settled_files(spark):
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, 1, 0, 0, 0)), ("b", dt.datetime(2020, 1, 1, 0, 0, 8))], "path string, modificationTime timestamp")
    assert [r["path"] for r in jobs.settled_files(df, F.lit("2020-01-01 00:00:10").cast("timestamp")).collect()] == ["a"]


def test_settled_files_versions(spark):
    at = lambda s: dt.datetime(2020, 1, 1, 0, 0, s)
    files_ = spark.createDataFrame([(n, at(0), 5) for n in "abcd"], "path string, modificationTime timestamp, length long")
    tried = spark.createDataFrame([("a", at(0), 5, at(9), True), ("b", at(0), 5, at(9), False), ("c", at(0), 4, at(9), True)], "path string, modificationTime timestamp, length long, tried_at timestamp, done boolean")
    got = lambda now: [r["path"] for r in jobs.settled_files(files_, F.lit(now).cast("timestamp"), tried=tried).orderBy("path").collect()]
    assert got("2020-01-01 00:00:20") == ["c", "d"]
    assert got("2020-01-01 00:02:00") == ["b", "c", "d"]


def test_load_report_reasons(spark):
    paths = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    rows = spark.createDataFrame([("a",), ("a",)], "path string")
    errors = spark.createDataFrame([("b", "no zip file")], "path string, error string")
    report = text.load_report(paths, rows, errors=errors)
    assert {r["path"]: (r["rows"], r["status"]) for r in report.collect()} == {"a": (2, "Loaded"), "b": (0, "Skipped: no zip file"), "c": (0, "Skipped: no rows")}
    assert sorted(r["path"] for r in text.require_loaded(report).collect()) == ["b", "c"]
    with pytest.raises(ValueError, match="no zip file"):
        text.require_loaded(text.load_report(paths.where("path = 'b'"), rows, errors=errors))
    assert text.require_loaded(text.load_report(paths.where("false"), rows)).count() == 0


def test_element_records(spark):
    numbers = {n: 0.5 for n in clean.ELEMENT_NUMBERS} | {"norad_cat_id": 7.0}
    good = {"payload": "p", "object_name": "X", "object_id": "2024-101A", "epoch": "2024-05-01T00:00:00", "ephemeris_type": 0, **numbers}
    rows = [good, {**good, "payload": "q", "object_id": "none"}, {**good, "payload": "r", "ephemeris_type": 2}, {**good, "payload": "s", "bstar": float("nan")}, {**good, "payload": "t", "rev_at_epoch": None}, {**good, "payload": "u"}, {**good, "payload": "u"}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'string' if k in ('payload', 'object_name', 'object_id', 'epoch') else 'int' if k == 'ephemeris_type' else 'double'}" for k in good))
    ok, bad = files.read_elements(df, "payload")
    assert [r["payload"] for r in ok.collect()] == ["p"] and ok.columns == df.columns
    assert sorted((r["payload"], tuple(r["failed"])) for r in bad.collect()) == [("q", ("designator",)), ("r", ("type",)), ("s", ("finite",)), ("t", ("finite",)), ("u", ("one_record",)), ("u", ("one_record",))]
    assert files.read_elements(df, object_id="2024-101B")[0].count() == 0


def test_retrieval_workbooks_and_stitched_series(spark, tmp_path):
    (tmp_path / "a.ssa.xlsx").write_bytes(workbook([["note"], ["Date(dd:mm:yyyy)", "Time(hh:mm:ss)", "SSA440", "other"], ["01:02:2020", "10:00:00", "0.91", "7"], ["02:02:2020", "11:00:00", "-999", "8"]]))
    cells = files.read_workbook_cells(spark, [str(tmp_path / "*.xlsx")])
    got = files.read_retrieval_workbooks(cells, ["SSA440"]).orderBy("row_no").collect()
    assert [(r["row_no"], r["metric"], r["value"]) for r in got] == [(3, "SSA440", "0.91"), (4, "SSA440", "-999")]
    assert files.read_retrieval_workbooks(cells.withColumn("sheet", F.lit("-999")), ["SSA440"]).count() == 0
    (tmp_path / "s.json").write_text('{"data": [{"forecast_hour": 3, "source_day": "2023-07-19", "timestamp": "19-7-2023 - 3:00", "value": 0.25}, {"forecast_hour": 6, "source_day": "2023-07-19", "timestamp": "bad", "value": null}]}')
    got = files.read_stitched_series(spark, str(tmp_path / "s.json")).orderBy("forecast_hour").collect()
    assert [(r["forecast_hour"], str(r["source_day"]), r["ts"], r["value"]) for r in got] == [(3, "2023-07-19", dt.datetime(2023, 7, 19, 3), 0.25), (6, "2023-07-19", None, None)]


def test_target_events_by_brute_force(spark):
    """A straight pass: entry and exit lie where the distance crosses the radius, the closest sample is the minimum."""
    start = dt.datetime(2020, 1, 1)
    track = [("o", start + dt.timedelta(minutes=k), float(k) - 10, 20.0, k) for k in range(21)]
    df = spark.createDataFrame(track, "object string, ts timestamp_ntz, lat double, lon double, k int")
    targets = spark.createDataFrame([("t", 0.2, 20.0), ("edge", 9.9, 20.0), ("far", 0.0, 60.0)], "target string, t_lat double, t_lon double")
    at = lambda minutes: F.lit(start + dt.timedelta(minutes=minutes)).cast("timestamp_ntz")
    degree, radius = 6371.0088 * 3.141592653589793 / 180, 500.0
    got = geo.target_events(df, targets, "ts", radius, at(8), at(30)).collect()
    assert [(r["target"], r["k"], r["ongoing"], r["samples"]) for r in got] == [("t", 10, True, 9)]
    for name, lat in (("entry", 0.2 - radius / degree), ("exit", 0.2 + radius / degree)):
        assert abs((got[0][name] - start).total_seconds() / 60 - (lat + 10)) < 1e-4
    assert geo.target_events(df, targets, "ts", radius, at(20), at(30)).count() == 0


def test_runs_over_days_equal_whole_keys(spark):
    """Neighbours and runs over midnight, over days without rows and for a null key are those of the whole key in time."""
    import random

    draw = random.Random(5)
    start = dt.datetime(2020, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=m), draw.randint(0, 9)) for k in ("a", "b", None) for m in draw.sample(range(0, 9 * 1440, 7), 60)]
    df = spark.createDataFrame([*rows, ("a", None, 1)], "k string, ts timestamp_ntz, v int")
    want = []
    for key in ("a", "b", None):
        own, n = sorted(r[1:] for r in rows if r[0] == key), 0
        for i, (at, v) in enumerate(own):
            n += v > 3 and not (i and own[i - 1][1] > 3)
            want.append((str(key), at, own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None, own[i + 1][0] if i + 1 < len(own) else None, n))
    got = windows._islands(df, ["k"], "ts", F.col("v") > 3, ("v",)).select(F.coalesce("k", F.lit("None")), "ts", "_a.v", "_b.v", "_next", "island").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_block_candidates_by_brute_force(spark):
    import struct

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    blocks = docs.select("doc_id", F.lit(1).alias("position"), F.col("text").cast("binary").alias("content"))
    got = {r["doc_id"]: r["n"] for r in files.decode_block_candidates(blocks, "doc_id", "content", -1000.0, 1e6).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    want = {}
    for doc_id, text_ in docs.collect():
        raw = (text_ or "").encode()
        n = sum(-1000 <= struct.unpack_from(">d", raw, i)[0] <= 1e6 for i in range(len(raw) - 7))
        want.update({doc_id: n} if n else {})
    assert got == want


def test_targets_by_cells(spark):
    """Every pair within the radius, near the poles and across 180 degrees, by brute force."""
    import math
    import random

    draw = random.Random(4)
    samples = [(i, draw.choice((-89.9, 89.5, 88.0, 70.0, 0.0, 45.0)) + draw.uniform(-1, 1) * 0.4, draw.uniform(-180, 180)) for i in range(1500)]
    samples = [(i, max(-90.0, min(90.0, a)), o) for i, a, o in samples] + [(2000 + i, a, 179.9) for i, a in enumerate((0.0, 45.0, 70.0, 89.0))]
    targets = [(j, a, o) for j, (a, o) in enumerate(((0.0, -179.9), (45.0, -179.8), (70.2, -179.5), (89.9, 10.0), (-90.0, 0.0), (88.0, 100.0), (45.0, 20.0), (0.1, 180.0)))]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    for radius in (80.0, 700.0):
        want = sorted((t, i) for t, a, o in targets for i, b, p in samples if km(a, o, b, p) <= radius)
        s = spark.createDataFrame(samples, "object int, lat double, lon double")
        t = spark.createDataFrame(targets, "target int, t_lat double, t_lon double")
        for dense in (50_000, 5):  # cells in one part, and split
            assert sorted((r["target"], r["object"]) for r in joins.targets_x_samples(s, t, radius, dense).collect()) == want and len(want) > 20


def test_shared_dir_needs_a_shared_folder(monkeypatch):
    from dustloom.session import shared_dir

    class Conf:
        get = staticmethod(lambda *_: None)

    class Fake:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Fake)
