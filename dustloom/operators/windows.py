"""Windows: spacing, intervals, crossings, rolling means, the newest and the first of each key."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustloom.operators.ranges import Ordered, beside, ordered, running, with_last_rows
from dustloom.session import on_workers, written


def block_lengths(offsets: DataFrame, keys: list[str], offset: str = "offset") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(offset)
    return offsets.withColumn("length", F.lead(offset).over(w) - F.col(offset)).withColumn("position", F.row_number().over(w))


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """df with _us, its time in microseconds. Rows without time go."""
    kind = df.schema[ts].dataType
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kind), F.col(ts)) if isinstance(kind, T.TimestampNTZType) else F.unix_micros(F.col(ts).cast("timestamp"))
    return df.where(F.col(ts).isNotNull()).withColumn("_us", us)


def in_time(df: DataFrame, keys: list[str], ts: str, parts: int | None = None) -> Ordered:
    """df in ranges of key, time and, for rows of one time, all other columns. Rows without time go."""
    return ordered(df.where(F.col(ts).isNotNull()), keys, [ts], parts)


def _islands(df: DataFrame, keys: list[str], order: str, inside: Column, cols: tuple[str, ...] = ()) -> DataFrame:
    """Rows with _in, the number of its run, the next row's time, and in _a and _b cols of its neighbours. Rows of one time are in the order of their other columns."""
    o = in_time(df.withColumn("_in", F.coalesce(inside, F.lit(False))), keys, order)
    marked = beside(o, ["_in", order, *cols])
    starts = marked.withColumn("_new", (F.col("_in") & ~F.coalesce(F.col("_a._in"), F.lit(False))).cast("long")).withColumn("_next", F.col("_b").getField(order))
    return running(starts, o, {"island": ("sum", F.col("_new"))}).drop("_part", "_new")


def proximity_intervals(df: DataFrame, keys: list[str], ts: str, distance: str, threshold: float, inclusive: bool = False) -> DataFrame:
    """Runs of samples within threshold: start, end (the first sample outside, or the scan's last), closest time and distance."""
    d = F.col(distance)
    return run_summary(_islands(df, keys, ts, d <= threshold if inclusive else d < threshold), keys, ts, distance).drop("island")


def run_summary(numbered: DataFrame, keys: list[str], ts: str, distance: str) -> DataFrame:
    """One row a run of what _islands gives, with its number."""
    return numbered.where("_in").groupBy(*keys, "island").agg(F.min(ts).alias("start"), F.max(F.coalesce("_next", F.col(ts))).alias("end"), F.min_by(ts, F.struct(distance, ts)).alias("closest"), F.min(distance).alias("min_distance"), F.count(F.lit(1)).alias("samples"))


def local_minima(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Samples no higher than both neighbours, which of samples of one time are those in the order of the other columns; ends have one neighbour and aren't minima."""
    marked = beside(in_time(df, keys, order), [value])
    before, after = (F.col(side).getField(value) for side in ("_a", "_b"))
    return marked.where((F.col(value) <= before) & (F.col(value) <= after)).select(*df.columns)


def passes(df: DataFrame, keys: list[str], ts: str, elevation: str, threshold: float, azimuth: str | None = None, distance: str | None = None, start: float | None = None, end: float | None = None, closed: bool = True) -> DataFrame:
    """Runs at or above threshold: rise and set (seconds, by linear interpolation between samples), peak and peak_at.

    With azimuth also rise_azimuth, peak_azimuth and set_azimuth (degrees, interpolated the shorter way round), with distance
    peak_range. Passes that the samples don't show whole are left out if closed. With start and end (seconds) only passes
    that overlap them stay, and ongoing tells that one rose before start. Of equal peaks the first holds.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    more = tuple(c for c in (azimuth,) if c)
    runs = _islands(df.withColumn("_s", seconds), keys, ts, F.col(elevation) >= threshold, ("_s", elevation, *more)).where("_in")
    e, s = F.col(elevation), F.col("_s")
    pe, ps, ne, ns = (F.col(side).getField(c) for side in ("_a", "_b") for c in (elevation, "_s"))
    up, down = (threshold - pe) / (e - pe), (e - threshold) / (e - ne)
    found = {"rise": F.min(F.when(pe < threshold, ps + (s - ps) * up)), "set": F.max(F.when(ne < threshold, s + (ns - s) * down)), "peak": F.max(elevation), "peak_at": F.max_by("_s", F.struct(e, -s))}
    if azimuth:
        turned = lambda a, b, part: F.pmod(a + (F.pmod(b - a + 180, F.lit(360.0)) - 180) * part, F.lit(360.0))
        az, pa, na = F.col(azimuth), F.col("_a").getField(azimuth), F.col("_b").getField(azimuth)
        found |= {"rise_azimuth": F.max(F.when(pe < threshold, turned(pa, az, up))), "peak_azimuth": F.max_by(azimuth, F.struct(e, -s, -az)), "set_azimuth": F.max(F.when(ne < threshold, turned(az, na, down)))}
    if distance:
        found["peak_range"] = F.max_by(distance, F.struct(e, -s, -F.col(distance)))
    out = runs.groupBy(*keys, "island").agg(*(c.alias(n) for n, c in found.items())).drop("island")
    out = out.where(F.col("rise").isNotNull() & F.col("set").isNotNull()) if closed else out
    if start is not None:
        out = out.where((F.col("set") > start) & (F.col("rise") < end)).withColumn("ongoing", F.col("rise") < start)
    return out


def track_segments(df: DataFrame, keys: list[str], ts: str, lon: str) -> DataFrame:
    """A jump of over 180 degrees begins a segment; segments of one point go, which neighbours tell without counting."""
    o = in_time(df, keys, ts)
    marked = beside(o, [lon])
    jumps = {side: F.abs(F.col(lon) - F.col(f"_{side}").getField(lon)) > 180 for side in "ab"}
    marked = marked.withColumns({f"_jump_{side}": F.coalesce(jump, F.lit(False)) for side, jump in jumps.items()})
    alone = (F.col("_a").isNull() | F.col("_jump_a")) & (F.col("_b").isNull() | F.col("_jump_b"))
    cut = running(marked.withColumn("_alone", alone), o, {"segment": ("sum", F.col("_jump_a").cast("long"))})
    return cut.where(~F.col("_alone")).select(*df.columns, "segment")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*")


def rolling_last_k(df: DataFrame, keys: list[str], order: list[str], value: str, k: int = 60) -> DataFrame:
    """df with the mean and number of the values of the last k rows of its key, each row itself one of them.

    Rows that order doesn't tell apart are in the order of their other columns. A key may lie in many partitions: each gets
    the k - 1 rows before it.
    """
    return numbered_last_k(df, keys, order, value, k).select(*df.columns, "rolling_mean", "rolling_n")


def numbered_last_k(df: DataFrame, keys: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """What rolling_last_k gives, with _part and _at, which together are in the order of a key's rows, of rows alike too."""
    o = ordered(df, keys, order)
    rows = with_last_rows(o, k - 1, [value]) if k > 1 else o.rows.withColumn("_before", F.lit(False))
    w = o.window().rowsBetween(-(k - 1), 0)
    out = rows.withColumns({"rolling_mean": F.avg(value).over(w), "rolling_n": F.count(value).over(w), "_at": F.row_number().over(o.window())})
    return out.where(~F.col("_before")).drop("_before")


def _chains(times: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Of distinct times (keys, _us): those that the greedy rule keeps, from each key's first to the first that is least later, and so on.

    Where a key has no time for so long, the next one is kept whatever came before, so runs between such gaps don't depend on
    each other. Times lie in ranges of key and time; a task goes once through the runs that lie within its ranges, with the
    last kept time as all that it holds. Runs over the edge of a range, two a range at most, are kept by pointers.
    """
    o = ordered(times.select(*keys, "_us"), keys, ["_us"])
    at = lambda row: F.col(row).getField("_us")
    first, last = o.edges.select("_part", "_first", "_last", "_before", "_after"), Window.partitionBy("_part", *keys)
    rows = o.rows.repartition("_part", *keys).join(F.broadcast(first), "_part")
    comes = o.of_key("_first") & o.of_key("_before") & (at("_first") - at("_before") < least)
    goes = o.of_key("_last") & o.of_key("_after") & (at("_after") - at("_last") < least)
    rows = rows.select("_part", *keys, "_us", comes.alias("_comes"), goes.alias("_goes"))
    far = F.col("_us") - F.lag("_us").over(o.window()) >= least
    rows = rows.withColumn("_new", F.coalesce(far, ~F.col("_comes")))
    rows = rows.withColumn("_run", F.sum(F.col("_new").cast("long")).over(o.window().rowsBetween(Window.unboundedPreceding, 0)))
    # without a new run so far, or with no other after it
    rows = rows.withColumn("_open", (F.col("_comes") & (F.col("_run") == 0)) | (F.col("_goes") & (F.col("_run") == F.max("_run").over(last))))

    def walk(batches):
        kept = None
        for batch in batches:
            stay = []
            for us, new, crosses in zip(*(batch.column(c).to_pylist() for c in ("_us", "_new", "_open")), strict=True):
                if crosses:
                    stay.append(True)
                elif new or us - kept >= least:
                    kept = us
                    stay.append(True)
                else:
                    stay.append(False)
            yield batch.filter(pa.array(stay, pa.bool_()))

    on_workers(times.sparkSession)
    walked = rows.sortWithinPartitions("_part", *keys, "_us").select(*keys, "_us", "_new", "_open")
    walked = written(walked.mapInArrow(walk, walked.schema), "walked")
    within = walked.where(~F.col("_open")).select(*keys, "_us")
    crossing = written(walked.where("_open").select(*keys, "_us", "_new"), "crossing")
    return within.unionByName(_pointed(crossing, keys, least)) if crossing.limit(1).count() else within


def undecided(us: list[int], least: int) -> tuple[list[int], list[int]]:
    """Of a key's times within one range, in order, the places of those that the greedy rule may keep, and of those that it keeps whatever it kept before.

    What it keeps first depends on earlier ranges, but is one of the times up to the one that is least after the first. The chains
    from there are followed together, the hindmost first. Where all have met in one time, that and what follows it is sure; where one leaves
    the range before, nothing is. The rule keeps the same of these times as of all, and they are as many as its steps, not as the times.
    """
    after = lambda i: bisect_left(us, us[i] + least, i + 1)
    first = after(0)
    heads, left, maybe, sure = deque(i for i in range(min(first + 1, len(us))) if i == 0 or us[i] > us[i - 1]), first == len(us), [], []
    while heads and (left or len(heads) > 1):
        maybe.append(heads.popleft())
        then = after(maybe[-1])
        if then == len(us):
            left = True
        elif not heads or then != heads[-1]:
            heads.append(then)
    then = heads[0] if heads else len(us)
    while then < len(us):
        sure.append(then)
        then = after(then)
    return maybe, sure


def greedy_walk(events: DataFrame, keys: list[str], order: list[str], ts: str, minutes: float, given: str) -> DataFrame:
    """Events that the greedy rule keeps, in the given order, but for those with given: they are kept already, and suppress others.

    A task goes through whole keys with the last kept time as all that it holds, so a key should be as long as the rule has steps.
    """
    least = round(60_000_000 * minutes)
    new = F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy(*order)).isNull()

    def walk(batches):
        kept = None
        for batch in batches:
            stay = []
            for us, begins, sure in zip(batch.column(ts).cast(pa.int64()).to_pylist(), *(batch.column(c).to_pylist() for c in ("_begins", given)), strict=True):
                if begins:
                    kept = None
                keeps = sure or kept is None or us - kept >= least
                kept = us if keeps else kept
                stay.append(keeps and not sure)
            yield batch.filter(pa.array(stay, pa.bool_()))

    on_workers(events.sparkSession)
    rows = events.withColumn("_begins", new)
    return rows.mapInArrow(walk, rows.schema).drop("_begins")


def _pointed(times: DataFrame, keys: list[str], least: int) -> DataFrame:
    """What the greedy rule keeps of runs given whole (keys, _us, and _new where a run begins).

    One pass in falling order of time finds each time's next one: events and, least later than each, a question lie in one
    order, and the running value is the earliest event so far. Then the kept ones spread from the first by pointers of one,
    two, four steps, ..., so the rounds grow with the logarithm of the longest chain; no task reads a chain.
    """
    asked = times.select(*keys, (-(F.col("_us") + least)).alias("_n"), F.lit(1).alias("_asks"), F.col("_us").alias("_of"), "_new")
    given = times.select(*keys, (-F.col("_us")).alias("_n"), F.lit(0).alias("_asks"), F.col("_us").alias("_of"), "_new")
    o = ordered(asked.unionByName(given), keys, ["_n", "_asks"])
    seen = running(o.rows, o, {"_next": ("max", F.when(F.col("_asks") == 0, F.col("_n")))}, write=False)
    # kept or not is carried by the node itself, which points to the one 2^k steps later
    nodes = written(seen.where("_asks = 1").select(*keys, F.col("_of").alias("_us"), (-F.col("_next")).alias("_to"), F.col("_new").alias("_kept")), "chain")
    while nodes.where("_kept AND _to IS NOT NULL").limit(1).count():
        # what kept ones point to is kept, and all point on to what their next one points to
        reached = nodes.where("_kept AND _to IS NOT NULL").select(*keys, F.col("_to").alias("_us")).distinct().withColumn("_hit", F.lit(True))
        onward = nodes.where("_to IS NOT NULL").select(*keys, F.col("_us").alias("_to"), F.col("_to").alias("_then"))
        met = _same(_same(nodes, reached, keys, "_us"), onward, keys, "_to")
        nodes = written(met.select(*keys, "_us", F.col("_then").alias("_to"), (F.col("_kept") | F.coalesce("_hit", F.lit(False))).alias("_kept")), "chain")
    return nodes.where("_kept").select(*keys, "_us")


def _same(df: DataFrame, other: DataFrame, keys: list[str], at: str) -> DataFrame:
    """df left joined with other on keys (null keys are keys too) and at, with what else other has."""
    rest = [c for c in other.columns if c not in (*keys, at)]
    there = other.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(at).alias("_at"), *rest)
    same = F.col(at) == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(there, same, "left").drop("_at", *(f"_k{i}" for i in range(len(keys))))


def suppress_close_events(events: DataFrame, keys: list[str], ts: str, minutes: float = 30) -> DataFrame:
    """An event within minutes of the last kept one of its key goes; of events at one time the first by the other columns stays. Events without time go."""
    timed = _timed(events, ts)
    rest = [c for c in events.columns if c not in keys]
    order = [f.name for f in events.schema.fields if f.name not in (*keys, ts) and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    first = timed.groupBy(*keys, "_us").agg(F.min_by(F.struct(*rest), F.struct(*order) if order else F.lit(0)).alias("_row"))
    first = written(first, "events")
    kept = _chains(first.select(*keys, "_us"), keys, round(60_000_000 * minutes)).withColumn("_stays", F.lit(True))
    return _same(first, kept, keys, "_us").where("_stays").select(*keys, "_row.*").select(*events.columns)


def episodes(days: DataFrame, keys: list[str], date: str, least: int = 2) -> DataFrame:
    """Runs of consecutive days, of at least so many."""
    one = days.select(*keys, F.col(date).alias("date")).distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    runs = one.withColumn("_run", F.date_sub("date", nth)).groupBy(*keys, "_run").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("days"))
    return runs.drop("_run").where(F.col("days") >= least)


def closest_event(events: DataFrame, keys: list[str], distance: str, order: list[str]) -> DataFrame:
    cols = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(distance, *order)).alias("r")).select(*keys, "r.*")


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def top_n(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)
