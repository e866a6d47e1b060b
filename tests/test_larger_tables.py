"""What shows only on tables larger than the smallest ones: numbers, longitudes and ties that those don't hold."""

import datetime as dt
import random
import re

import duckdb
import pytest

from dustloom import session
from dustloom.operators import geo, joins, windows
from dustloom.plans import catalogue, tracks
from dustloom.sources import files, text
from tests.conftest import canonical

START = dt.datetime(2024, 1, 1)


def same_as_sql(spark, name, folder, **tables):
    """Writes the tables (rows, schema) to folder and compares the query with its SQL."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = catalogue.QUERIES[name](spark, str(folder))
    want = con.execute(catalogue.ORACLE[name])
    expected = canonical([d[0] for d in want.description], want.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == expected and expected[1]


def test_customers_that_look_like_years(spark, tmp_path):
    rows = [(key, dt.datetime(year, 5, 6)) for key in (7, 2000, 2045, 2099, 20451) for year in (1998, 2001, 2024)]
    same_as_sql(spark, "f08_year_month_from_path", tmp_path, orders=(rows, "o_custkey long, o_orderdate timestamp_ntz"))


def test_segments_where_turns_are_whole(spark, tmp_path):
    """Events whose numbers times 0.7 are whole turns: as doubles 0.7 * 75600 is a little less than 147 turns."""
    numbers = sorted({k + d for k in range(0, 200_000, 3600) for d in (-300, -200, -10, 0, 10, 200, 300, 1800) if k + d >= 0})
    rows = [(START + dt.timedelta(seconds=3 * i), k, 5) for i, k in enumerate(numbers)]
    for name in ("w06_track_segments", "g03_ground_track"):
        same_as_sql(spark, name, tmp_path / name, events=(rows, "ts timestamp_ntz, event_id long, user_id long"))


def test_targets_at_one_place(spark, tmp_path):
    """Suppliers 1440 apart lie at one place; it is met once, and what is found there is of all of them."""
    keys = [k + 1440 * g for k in range(0, 1440, 60) for g in range(3)]
    rows = [(START + dt.timedelta(minutes=7 * i), i, i % 2) for i in range(1500)]
    tables = {"supplier": ([(k,) for k in keys], "s_suppkey long"), "events": (rows, "ts timestamp_ntz, event_id long, user_id long")}
    same_as_sql(spark, "j08_targets_x_samples", tmp_path / "j08", **tables)
    places, members = joins.by_place(tracks.suppliers(spark, str(tmp_path / "j08")))
    assert places.count() == 24 and members.count() == len(keys)
    same_as_sql(spark, "g02_target_events", tmp_path / "g02", **tables)


@pytest.fixture
def ranges(spark):
    """Sets the number of ranges, which is that of Spark's partitions."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", was)


def scattered(draw, k, n, numbers=3600):
    """n events of object k at times of their own in January, with numbers that throw its samples over the globe, or over a part of it."""
    times = sorted(draw.sample(range(31 * 86400), n))
    return [(START + dt.timedelta(seconds=s), draw.randrange(numbers), k) for s in times]


def test_events_over_edges_of_ranges(spark, tmp_path, ranges, monkeypatch):
    """Runs and chains over the edges of ranges and of the period: scattered samples, slow tracks, an object that stays in place, one without footprints."""
    draw = random.Random(7)
    rows = scattered(draw, 0, 2500) + [(ts, i, 1) for i, (ts, _, _) in enumerate(scattered(draw, 1, 1500))]
    rows += [(ts, 100 + i % 3, 2) for i, (ts, _, _) in enumerate(scattered(draw, 2, 900))]
    # where both neighbours are at one place there is no motion, so no footprint and no event
    rows += [(ts, 1000 + i % 2, 3) for i, (ts, _, _) in enumerate(scattered(draw, 3, 300))]
    tables = {"supplier": ([(k,) for k in range(0, 1440, 20)], "s_suppkey long"), "events": (rows, "ts timestamp_ntz, event_id long, user_id long")}
    for n in (1, 5, 13):
        ranges(n)
        same_as_sql(spark, "g02_target_events", tmp_path / str(n), **tables)
    monkeypatch.setattr(geo, "in_blocks", lambda targets: joins.in_blocks(targets, 10))
    same_as_sql(spark, "g02_target_events", tmp_path / "blocks", **tables)


def test_pairs_are_not_written(spark, tmp_path, monkeypatch):
    """What is written grows with the samples and the events, not with pairs of samples and targets."""
    rows = scattered(random.Random(8), 0, 12_000, 60)
    spark.createDataFrame([(k,) for k in range(1440)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(rows, "ts timestamp_ntz, event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    pairs = joins.targets_x_samples(tracks.samples(spark, str(tmp_path)), tracks.suppliers(spark, str(tmp_path)), 1500.0).count()
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}/scratch")
    events = catalogue.QUERIES["g02_target_events"](spark, str(tmp_path)).count()
    held = sum(spark.read.parquet(str(folder)).count() for folder in (tmp_path / "scratch").iterdir())
    assert 5 * len(rows) < events < held < pairs / 2


def test_undecided_times_keep_the_rule(spark):
    """Whatever was kept before, the rule keeps the same of all times as of those that are left, and always the sure ones."""

    def kept(times, least, last):
        out = []
        for t in times:
            if last is None or t - last >= least:
                out.append(last := t)
        return out

    draw, most, sure_ones = random.Random(9), 0, 0
    for _ in range(300):
        us = sorted(draw.randrange(draw.choice((50, 400, 3000))) for _ in range(draw.randrange(1, 60)))
        least = draw.choice((1, 10, 30, 90))
        maybe, sure = windows.undecided(us, least)
        assert sorted({*maybe, *sure}) == [*maybe, *sure]
        left = [us[i] for i in (*maybe, *sure)]
        for last in (None, *range(us[0] - least - 1, us[0] + 1)):
            of_all = kept(us, least, last)
            assert kept(left, least, last) == of_all and {us[i] for i in sure} <= {*of_all}
        most, sure_ones = max(most, len(us) - len(left)), sure_ones + len(sure)
    assert most > 20 and sure_ones > 500


def test_lines_are_cut_once(spark):
    """Every condition and field used to cut its line again, those of key=value lines for each pair of parts."""
    pairs = ",".join(f"k{i % 7}={i}=x" for i in range(50))
    df = spark.createDataFrame([(f"x 0R1, Dn= 1,=5,0r2=3,{pairs},Ta=,Ua=2,Pa=3,junk,Dn=9",), ("M22",), ("a b M22 " + " ".join(map(str, range(22))) + " 1700000000 day",)], "line string")
    kv, m22 = text.read_kv_log(df), text.read_m22_log(df)
    for got in (kv, m22):
        assert got._jdf.queryExecution().executedPlan().toString().count("split(") == 1
    assert [r["pairs"] for r in kv.collect()] == [{f"k{i % 7}": f"{i}=x" for i in range(43, 50)} | {"Ta": "", "Ua": "2", "Pa": "3", "Dn": "9"}]
    assert [(r["channels"]["R"], r["channels"]["Vr"], r["unixtime"], r["datetime"]) for r in m22.collect()] == [("0", "21", "1700000000", "day")]


def test_blocks_of_bytes_without_python(spark):
    """Random bytes against Python's search; marks are found by Spark alone and numbers by one pass through Python."""
    draw = random.Random(3)
    for mark in (b"\\E", b"\xff.", b"aa"):
        raw = [b"".join(draw.choice((mark, bytes([draw.randrange(256)]))) for _ in range(draw.randrange(60))) for _ in range(40)]
        df = spark.createDataFrame([*enumerate(raw), (99, None)], "k int, content binary")
        want = {}
        for k, data in enumerate(raw):
            at = [m.start() for m in re.finditer(re.escape(mark), data)]
            sizes = [b - a for a, b in zip(at, at[1:], strict=False)]
            modal = max(sizes, key=sizes.count, default=None)  # the first of the most frequent
            want |= {(k, i + 1): (o, sizes[i] if i < len(sizes) else min(modal or len(data), len(data) - o)) for i, o in enumerate(at)}
        assert {(r["k"], r["position"]): (r["offset"], r["length"]) for r in files.binary_blocks(df, "k", "content", mark).collect()} == want
        got = files.block_contents(df, "k", "content", mark)
        assert {(r["k"], r["position"]): bytes(r["content"]) for r in got.collect()} == {at: raw[at[0]][o : o + n] for at, (o, n) in want.items()}
        assert "Python" not in (plan := files.binary_blocks(df, "k", "content", mark)._jdf.queryExecution().executedPlan().toString()) and "InPandas" not in plan
        plan = files.block_series(got, "k", "content")._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and plan.count("InArrow") == 1
