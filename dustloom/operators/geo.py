"""Geometry on ephemeris tables: footprints, target events, ground tracks."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustloom.functions.columns import great_circle_km
from dustloom.operators.joins import block_beside, for_blocks, in_blocks, pairs_at_most
from dustloom.operators.ranges import beside
from dustloom.operators.windows import greedy_walk, in_time, track_segments, undecided
from dustloom.session import on_workers, written

#: Fixed values of the ellipsoid, km.
A_KM = 6378.137
B_KM = A_KM * (1 - 1 / 298.257223563)


def surface_point(df: DataFrame, origin: list[str], direction: list[str], out: str) -> DataFrame:
    """df with out: struct(x, y, z) where a ray first meets the ellipsoid, NULL if it doesn't. Step by step, as each is used again."""
    (x, y, z), (u, v, w) = ([F.col(c) for c in cols] for cols in (origin, direction))
    df = df.withColumns({
        "_qa": (u * u + v * v) / A_KM**2 + w * w / B_KM**2,
        "_qb": 2 * ((x * u + y * v) / A_KM**2 + z * w / B_KM**2),
        "_qc": (x * x + y * y) / A_KM**2 + z * z / B_KM**2 - 1,
    })
    disc = F.col("_qb") * F.col("_qb") - 4 * F.col("_qa") * F.col("_qc")
    df = df.withColumn("_disc", disc).withColumn("_root", F.sqrt(F.when(F.col("_disc") >= 0, F.col("_disc"))))
    df = df.withColumns({"_near": (-F.col("_qb") - F.col("_root")) / (2 * F.col("_qa")), "_far": (-F.col("_qb") + F.col("_root")) / (2 * F.col("_qa"))})
    t = F.when(F.col("_near") > 0, F.col("_near")).when(F.col("_far") > 0, F.col("_far"))
    df = df.withColumn("_t", t)
    hit = F.when(F.col("_t").isNotNull(), F.struct((x + F.col("_t") * u).alias("x"), (y + F.col("_t") * v).alias("y"), (z + F.col("_t") * w).alias("z")))
    return df.withColumn(out, hit).drop("_qa", "_qb", "_qc", "_disc", "_root", "_near", "_far", "_t")


def geodetic_latitude(x: Column, y: Column, z: Column) -> Column:
    """Of a point on the ellipsoid itself, degrees."""
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y) * (B_KM / A_KM) ** 2))


def sample_footprints(samples: DataFrame, keys: list[str], ts: str, aft_degrees: float = 3.0) -> DataFrame:
    """samples: lat, lon of the point below and earth-fixed x, y, z. The motion comes from the neighbours in time."""
    return _footprints(beside(in_time(samples, keys, ts), ["x", "y", "z"]).drop("_part"), aft_degrees).drop("_a", "_b")


def _footprints(near: DataFrame, aft_degrees: float) -> DataFrame:
    """Samples that have x, y, z of their neighbours in _a and _b, with footprints."""
    motion = [F.col(f"_b.{c}") - F.col(f"_a.{c}") for c in ("x", "y", "z")]
    df = near.withColumns({f"_m{c}": m for c, m in zip("xyz", motion, strict=True)})
    lat, lon = F.radians("lat"), F.radians("lon")
    df = df.withColumns({"_ux": F.cos(lat) * F.cos(lon), "_uy": F.cos(lat) * F.sin(lon), "_uz": F.sin(lat)})
    column = lambda kind: [F.col(f"_{kind}{c}") for c in "xyz"]
    total = lambda parts: parts[0] + parts[1] + parts[2]
    named = lambda kind, parts: {f"_{kind}{c}": p for c, p in zip("xyz", parts, strict=True)}
    df = df.withColumn("_along", total([a * b for a, b in zip(column("m"), column("u"), strict=True)]))
    df = df.withColumns(named("t", [a - F.col("_along") * b for a, b in zip(column("m"), column("u"), strict=True)]))
    df = df.withColumn("_size", F.sqrt(total([t * t for t in column("t")])))
    angle = math.radians(aft_degrees)
    df = df.withColumns(named("r", [-math.cos(angle) * u - math.sin(angle) * F.when(F.col("_size") > 0, t / F.col("_size")) for u, t in zip(column("u"), column("t"), strict=True)]))
    df = df.withColumn("_length", F.sqrt(total([r * r for r in column("r")])))
    df = df.withColumns(named("d", [r / F.col("_length") for r in column("r")]))
    df = surface_point(df, ["x", "y", "z"], ["_dx", "_dy", "_dz"], "_hit")
    hit = [F.col(f"_hit.{c}") for c in "xyz"]
    df = df.withColumns({"foot_lat": geodetic_latitude(*hit), "foot_lon": F.degrees(F.atan2(hit[1], hit[0]))})
    out = df.withColumn("offset_km", great_circle_km(F.col("lat"), F.col("lon"), F.col("foot_lat"), F.col("foot_lon")))
    return out.drop("_hit", "_along", "_size", "_length", *(f"_{k}{c}" for k in "mutrd" for c in "xyz"))


#: Pairs of neighbouring cells that a range should have, ranges at most, and minutes between events.
RANGE_PAIRS, MOST_RANGES, APART = 4_000_000, 20_000, 30
#: Rows of _approaches: kept, and the last of them in its range; perhaps kept; perhaps within the period; a run over the edge of its range.
SURE, LAST, MAYBE, OPEN, RUN = range(5)


def target_events(samples: DataFrame, targets: DataFrame, ts: str, radius_km: float, start, end, required: tuple[str, ...] = (), aft_degrees: float | None = None, position: Callable[[Column, Column], dict[str, Column]] | None = None) -> DataFrame:
    """Closest approaches within radius of each object to each target that overlap start to end, apart by half an hour.

    samples: object, ts, lat, lon and what else is to be kept of the closest sample; where a column of required is NULL there is
    no event. targets: target, t_lat, t_lon. Entry and exit are interpolated between the samples on both sides of the
    radius; where a scan begins or ends inside, they are its first or last sample. ongoing: entered before start.
    Approaches that don't count, as they are before start, suppress none. With aft_degrees samples have x, y, z too, or position
    gives them for lat and lon, and events have foot_lat and foot_lon as of sample_footprints instead; without a footprint there is no event.

    Pairs of samples and targets are neither written nor shuffled: samples lie in ranges of object and time, targets are
    broadcast in blocks, and a range gives what its pairs leave undecided or kept. That is one row for each step of the rule
    and not for each pair, with some more where a range begins. Runs over the edge of a range are then put together, and
    the undecided rows of an object and a target, as many at most as the period has half hours for each time that
    its ranges may begin with, are walked through in their order.
    Targets at one place have the same events: joins.by_place finds them once a place.
    """
    spark, place = samples.sparkSession, [] if aft_degrees is None or position else ["x", "y", "z"]
    blocks = in_blocks(targets)
    ranges = pairs_at_most(samples, targets, radius_km) // len(blocks) // RANGE_PAIRS
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(ranges, MOST_RANGES))
    o = in_time(samples, ["object"], ts, ranges)
    # a task a range, in which no window, join or sort below needs an exchange
    rows = o.rows.repartitionById((o.edges.agg(F.max("_part")).first()[0] or 0) + 1, "_part")
    both, within = beside(o, [ts, "lat", "lon", *place], rows), Window.partitionBy("_part")
    kept = [c for c in samples.columns if c not in ("object", *place)]
    if position:  # after the ranges, so that they don't hold what lat and lon tell
        for side in ("_a", "_b"):
            at = position(F.col(f"{side}.lat"), F.col(f"{side}.lon"))
            both = both.withColumn(side, reduce(lambda s, c, at=at: s.withField(c, at[c]), "xyz", F.col(side)))
        both = both.withColumns(position(F.col("lat"), F.col("lon")))
    if aft_degrees is not None:
        both, kept, required = _footprints(both, aft_degrees), [*kept, "foot_lat", "foot_lon"], (*required, "foot_lat")
    spots = {f"_{side}_{c}": F.col(f"_{side}").getField(c).cast("double") for side in "ab" for c in ("lat", "lon")}
    both = both.withColumns(spots | {"_lat": F.col("lat").cast("double"), "_lon": F.col("lon").cast("double")} | {f"_{side}_ts": F.col(f"_{side}").getField(ts) for side in "ab"})
    both = both.withColumn("_required", reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in required), F.lit(True)))
    both = for_blocks(both, radius_km).drop("_a", "_b", *("xyz" if position else ""))
    # these windows come last, so that what is found once a sample isn't compiled into the join, which would be too large a method
    both = both.withColumns({
        "_at": F.row_number().over(within.orderBy("object", *o.order)).cast("long"),
        "_track": F.dense_rank().over(within.orderBy("object")),
        "_first": F.lag(F.lit(1)).over(o.window()).isNull(),
        "_final": F.lead(F.lit(1)).over(o.window()).isNull(),
    }).drop(*place)
    kind = samples.schema[ts].dataType
    period = spark.range(1).select(F.explode(F.array(start.cast(kind), end.cast(kind))).alias("at")).toArrow()["at"].cast(pa.int64()).to_pylist()
    found = reduce(DataFrame.unionByName, (written(_approaches(both, block, kept, ts, radius_km, period), "found") for block in blocks))

    # runs over edges: a run that no earlier range begins goes on with the one before
    keys, run = ["object", "target"], ["_part", "_from"]
    pieces = found.where(F.col("_kind") == RUN).select(*keys, *run, "entry", "exit", "samples")
    pieces = pieces.withColumn("_run", F.count("entry").over(Window.partitionBy(*keys).orderBy(*run)))
    one = Window.partitionBy(*keys, "_run")
    pieces = pieces.select(*keys, *run, *(f(c).over(one).alias(c) for f, c in ((F.max, "entry"), (F.max, "exit"), (F.sum, "samples"))))
    events = found.where(F.col("_kind") != RUN)
    cut, of = events.where(~F.col("_whole")).drop("entry", "exit", "samples").alias("c"), pieces.alias("p")
    same = reduce(lambda a, b: a & b, (F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*keys, *run)))
    cut = cut.join(of, same).select("c.*", "p.entry", "p.exit", "p.samples").where((F.col("exit") > start) & (F.col("entry") < end))
    events = events.where("_whole").unionByName(cut)

    out = [*keys, *kept, "distance_km", "entry", "exit", "samples"]
    rest = events.where(F.col("_kind") >= LAST).withColumn("_given", F.col("_kind") == LAST)
    walked = greedy_walk(rest, keys, ["_part", "_at"], ts, APART, "_given")
    return events.where(F.col("_kind") <= LAST).select(*out).unionByName(walked.select(*out)).withColumn("ongoing", F.col("entry") < start)


def _approaches(both: DataFrame, block: DataFrame, kept: list[str], ts: str, radius_km: float, period: list[int]) -> DataFrame:
    """Of samples in ranges, a task each, with their neighbours: the approaches to a block of targets that may be events, and runs within radius over the edge of their range."""
    km = lambda side: great_circle_km(F.col("t_lat"), F.col("t_lon"), F.col(f"{side}_lat"), F.col(f"{side}_lon"))
    # as a generator's row: distances are found once, not again in each condition
    met = block_beside(both, block, radius_km).select("*", F.inline(F.array(F.struct(km("").alias("distance_km"), km("_a").alias("_a"), km("_b").alias("_b")))))
    d, a, b = F.col("distance_km"), F.col("_a"), F.col("_b")
    lowest = F.coalesce((d <= a) & (d <= b), F.lit(False))
    ends = F.col("_first") | F.col("_final") | a.isNull() | b.isNull() | (a > radius_km) | (b > radius_km)
    near = met.where((d <= radius_km) & (lowest | ends)).withColumns({"_lowest": lowest & F.col("_required"), "_key": F.shiftleft("_no", 40) + F.col("_at")})
    held = ["object", "target", *kept, "distance_km", "_part"]
    near = near.select(*held, "_a", "_b", "_a_ts", "_b_ts", "_key", "_track", "_lowest").sortWithinPartitions("_key")
    fields = [T.StructField(f.name, f.dataType) for f in near.select(*held).schema.fields]
    fields += [T.StructField(c, near.schema[ts].dataType) for c in ("entry", "exit")]
    fields += [T.StructField("samples", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_from", T.LongType()), T.StructField("_whole", T.BooleanType()), T.StructField("_kind", T.IntegerType())]
    start, end = period

    def approaches(batches):
        for pairs in _whole_groups(batches):
            number = lambda c: pairs[c].to_numpy()  # noqa: E731, B023  nulls are NaN
            micros = lambda c: pairs[c].cast(pa.int64()).fill_null(0).to_numpy()  # noqa: E731, B023
            at, group, low, us, d = number("_key") & ((1 << 40) - 1), number("_group"), number("_lowest"), micros(ts), number("distance_km")
            begins = group != np.append(-1, group[:-1])
            # the time when the radius was crossed on the way from or to a neighbour outside; without a neighbour it is the sample's own
            known, crossed = [], []
            for side in ("_a", "_b"):
                outside, other = number(side), micros(f"{side}_ts")
                away = np.where(outside > radius_km, (other - us) * ((radius_km - d) / np.where(outside > radius_km, outside - d, 1)), 0)
                known.append(~(outside <= radius_km))
                crossed.append(us + (np.trunc(away) + np.sign(away) * (np.abs(away - np.trunc(away)) >= 0.5)).astype(np.int64))
            begins |= known[0]
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(group)) - 1
            run = np.cumsum(begins) - 1
            # of runs over an edge the other end isn't known: whether they count may be told by the samples here alone
            entered, left, entry, exit_ = known[0][first], known[1][last], crossed[0][first], crossed[1][last]
            late, early = np.where(left, exit_, us[last]) > start, np.where(entered, entry, us[first]) < end
            counts, never = late & early, (~late & left) | (~early & entered)
            kind = np.full(len(group), -1, np.int32)
            kind[low & ~(never | counts)[run]] = OPEN
            met = np.flatnonzero(low & counts[run])
            for one in np.split(met, np.flatnonzero(np.diff(group[met])) + 1) if len(met) else ():
                maybe, sure = undecided(us[one].tolist(), APART * 60_000_000)
                kind[one[maybe]] = MAYBE
                kind[one[sure]] = SURE
                kind[one[sure[-1:]]] = LAST
            rows, runs = np.flatnonzero(kind >= 0), np.flatnonzero(~(entered & left))
            take, of = np.append(rows, first[runs]), np.append(run[rows], runs)
            columns = [pairs[c].take(pa.array(take)) for c in held]
            columns += [pa.array(x[of], pa.int64(), mask=~there[of]).cast(pairs[ts].type) for x, there in ((entry, entered), (exit_, left))]
            columns += [pa.array(x) for x in (at[last[of]] - at[first[of]] + 1, at[take], at[first[of]], (entered & left)[of], np.append(kind[rows], np.full(len(runs), RUN, np.int32)))]
            yield from pa.table(columns, [f.name for f in fields]).combine_chunks().to_batches(10_000)

    def _whole_groups(batches):
        """Tables of whole groups, one an object and a target, with _group, their number."""
        parts, before = [], None

        def table():
            pairs = pa.Table.from_batches(parts).combine_chunks()
            ids = of(pairs)
            return pairs.append_column("_group", pa.array(np.cumsum(ids != np.append(ids[:1], ids[:-1]))))

        def of(rows):
            return (rows["_key"].to_numpy() >> 40 << 31) + rows["_track"].to_numpy()

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = of(batch)
            other = np.flatnonzero(ids != ids[-1])
            cut = other[-1] + 1 if len(other) else 0
            if cut or (parts and before != ids[0]):
                parts += [batch.slice(0, cut)] if cut else []
                yield table()
                parts = []
            parts.append(batch.slice(cut))
            before = ids[-1]
        if parts:
            yield table()

    on_workers(both.sparkSession)
    return near.mapInArrow(approaches, T.StructType(fields))


def ground_track(samples: DataFrame, keys: list[str], ts: str, lon: str, centre, half_minutes: float = 52, step_s: int = 45) -> DataFrame:
    """Samples at whole steps around a time, cut where the track crosses 180 degrees."""
    away = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(centre.cast("timestamp"))
    return track_segments(samples.where((F.abs(away) <= half_minutes * 60) & (away % step_s == 0)), keys, ts, lon)
