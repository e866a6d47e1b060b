"""Aggregations. Statistics are exact; inputs are long tables (keys, metric, value) unless said otherwise."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustloom.functions.columns import CLASSES, SEASONS, season, season_year
from dustloom.session import written

GRAINS = ("year", "month", "season", "hour", "weekday")


def std_or_zero(v: Column) -> Column:
    """Sample deviation; 0 of a single value, NULL of none."""
    return F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v))


def adjusted_skewness(v: Column) -> Column:
    """Adjusted Fisher-Pearson coefficient: NULL under three values, 0 without spread."""
    n = F.count(v).cast("double")
    return F.when(n < 3, F.lit(None).cast("double")).when(F.stddev_samp(v) == 0, F.lit(0.0)).otherwise(F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))


#: Bits that a level of a quantile's search resolves, and values a rank may leave for the last level.
LEVEL_BITS, LAST_VALUES = 16, 1 << 16
#: Groups up to which their state is broadcast.
FEW_GROUPS = 20_000


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys in which NULL equals NULL."""
    named = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    return left.join(named, on, how).drop(*(f"_k{i}" for i in range(len(keys))))


def ordered_bits(v: Column) -> Column:
    """A double's 64 bits as a long in the order of the values: -0 is 0, NaN the largest."""
    size, one = F.abs(v), float(1 << 52)
    power = F.least(F.floor(F.log2(size)), F.lit(1023))
    part = size / F.pow(F.lit(2.0), power)
    # the logarithm may be off by one next to a power of two: then part is under one, or two and more
    times = lambda k: (part * (k * one)).cast("long")
    rest = F.when(part < 1, times(2) - (1 << 52)).when(part < 2, times(1)).otherwise(times(0.5) + (1 << 52))
    small = (size * 2.0**537 * 2.0**537).cast("long")
    bits = F.when(size < 2.0**-1022, small).when(size == float("inf"), 0x7FF << 52).otherwise((power + 1022) * (1 << 52) + rest)
    return F.when(F.isnan(v), (1 << 63) - 1).when(v < 0, -bits).otherwise(bits)


def from_ordered_bits(b: Column) -> Column:
    size = F.abs(b)
    power, rest = F.shiftright(size, 52), size.bitwiseAND((1 << 52) - 1).cast("double")
    near = F.when(power == 0, rest * 2.0**-1074).otherwise((rest / float(1 << 52) + 1) * F.pow(F.lit(2.0), F.least(power, F.lit(2046)) - 1023))
    v = F.when(b == (1 << 63) - 1, float("nan")).when(power == 0x7FF, float("inf")).otherwise(near)
    return F.when(b < 0, -v).otherwise(v)


def _located(counts: DataFrame, keys: list[str], slots: Column, more: list[str]) -> DataFrame:
    """keys, _n and _slots (rank, parent, below, inside): the bin of each rank, the values below it and those in it.

    counts: a row a bin, keys, _parent (the bin of the level above), _bin, _c and more. slots is an array of (rank, parent, below) a
    row. One exchange, by keys; what is sorted are bins of one parent, 2**LEVEL_BITS or LAST_VALUES at most.
    """
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_parent").orderBy("_bin"))
    placed = counts.withColumn("_upto", upto)
    mine = F.filter(slots, lambda s: (s["parent"] == F.col("_parent")) & (s["below"] + F.col("_upto") > s["rank"]) & (s["below"] + F.col("_upto") - F.col("_c") <= s["rank"]))
    each = placed.select(*keys, *more, F.explode(mine).alias("s"), "_bin", "_upto", "_c")
    slot = F.struct(F.col("s.rank").alias("rank"), F.col("_bin").alias("parent"), (F.col("s.below") + F.col("_upto") - F.col("_c")).alias("below"), F.col("_c").alias("inside"))
    return each.groupBy(*keys).agg(F.first("_n").alias("_n"), F.collect_list(slot).alias("_slots"))


def exact_quantiles(df: DataFrame, keys: list[str], ps: tuple[float, ...], value: str = "value") -> DataFrame:
    """keys and q, the array of linearly interpolated quantiles of each group's values; groups without any have no row.

    Exact selection on ordered bits, for all groups and ranks at once. A level counts values by their next LEVEL_BITS bits,
    in the bins of the level above that hold a rank, so a group has at most 2**LEVEL_BITS bins a rank however many values
    it has. Once the bins that hold ranks have LAST_VALUES values or fewer, those are counted one by one. Each level
    reads the bits, which are written once, and sorts none; two levels do unless a group has many millions of values.
    """
    base = written(df.select(*keys, ordered_bits(F.col(value).cast("double")).alias("_b")).where(F.col(value).isNotNull()), "bits")
    shift, zero = 64 - LEVEL_BITS, F.lit(0).cast("long")
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.array(*(side(place(p)) for p in ps for side in (F.floor, F.ceil))))
    counts = base.groupBy(*keys, F.shiftright("_b", shift).alias("_bin")).agg(F.count(F.lit(1)).alias("_c")).repartition(*keys)
    counts = counts.withColumns({"_parent": zero, "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    first = F.transform(ranks, lambda r: F.struct(r.alias("rank"), zero.alias("parent"), zero.alias("below")))
    state = written(_located(counts, keys, first, ["_n"]), "quantiles")
    while shift:
        groups, most = state.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("_slots", lambda x: x["inside"])))).first()
        up, shift = shift, 0 if (most or 0) <= LAST_VALUES else max(0, shift - LEVEL_BITS)
        few = F.broadcast if groups <= FEW_GROUPS else lambda x: x
        parents = state.select(*keys, F.array_distinct(F.transform("_slots", lambda x: x["parent"])).alias("_in"))
        met = _joined(base, few(parents), keys, "inner").withColumn("_parent", F.shiftright("_b", up))
        counts = met.where(F.array_contains("_in", F.col("_parent"))).groupBy(*keys, "_parent", F.shiftright("_b", shift).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
        counts = _joined(counts.repartition(*keys), few(state), keys, "inner")
        found = _located(counts, keys, F.col("_slots"), ["_n"])
        state = written(found, "quantiles") if shift else found
    at = F.map_from_entries(F.transform("_slots", lambda x: F.struct(x["rank"], from_ordered_bits(x["parent"]))))
    values = []
    for p in ps:
        lower, upper = F.floor(place(p)), F.ceil(place(p))
        low, high = F.element_at("_at", lower), F.element_at("_at", upper)
        values.append(F.when(lower == upper, low).otherwise((upper - place(p)) * low + (place(p) - lower) * high))
    return state.withColumn("_at", at).select(*keys, F.array(*values).alias("q"))


def with_quantiles(stats: DataFrame, df: DataFrame, keys: list[str], names: dict[str, float], value: str = "value") -> DataFrame:
    """stats (one row a group) with a column for each quantile, NULL for groups without values."""
    out = _joined(stats, exact_quantiles(df, keys, tuple(names.values()), value), keys, "left")
    return out.withColumns({n: F.col("q")[i] for i, n in enumerate(names)}).drop("q")


def _by_grain(df: DataFrame, keys: dict[str, Column], kept: list[str]) -> DataFrame:
    """A row for each row and grain: kept columns, grain, group."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("grain"), k.cast("string").alias("group")) for n, k in keys.items()))).alias("g")
    return df.select(*kept, each).select(*kept, "g.grain", "g.group")


def group_stats(df: DataFrame, ts: str, metric: str = "metric", value: str = "value", grains=GRAINS) -> DataFrame:
    """grain, group, metric, n, mean, median, std, min, max."""
    t = F.col(ts)
    keys = {"year": F.year(t), "month": F.month(t), "season": season(F.month(t)), "hour": F.hour(t), "weekday": F.date_format(t, "EEEE")}
    base = df.select(F.col(metric).alias("metric"), F.col(value).alias("value"), *(keys[g].alias(f"_{g}") for g in grains))
    base, v = _by_grain(base, {g: F.col(f"_{g}") for g in grains}, ["metric", "value"]), F.col("value")
    by = ["grain", "group", "metric"]
    grouped = base.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return with_quantiles(grouped, base, by, {"median": 0.5}).select(*by, "n", "mean", "median", "std", "min", "max")


def describe_columns(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    base, v = df.select(F.col(metric).alias("metric"), F.col(value).alias("value")), F.col("value")
    out = base.groupBy("metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    names = {f"p{q:02d}": q / 100 for q in (5, 25, 50, 75, 95)}
    return with_quantiles(out, base, ["metric"], names).select("metric", "n", "mean", "std", "min", *names, "max")


def summary(df: DataFrame, date: str, metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean, deviation (0 of one value) and n by day, month, month of year, season and season-year."""
    d = F.col(date)
    keys = {"day": d.cast("date"), "month": F.date_format(d, "yyyy-MM"), "month_of_year": F.month(d), "season": season(F.month(d)), "season_year": F.concat_ws(" ", season_year(d), season(F.month(d)))}
    base = df.select(F.col(metric).alias("metric"), F.col(value).alias("value"), *(k.cast("string").alias(n) for n, k in keys.items()))
    v, names = F.col("value"), list(keys)
    grouped = base.groupingSets([[F.col("metric"), F.col(n)] for n in names], F.col("metric"), *map(F.col, names)).agg(F.grouping_id().alias("gid"), F.count(v).alias("n"), F.avg(v).alias("mean"), std_or_zero(v).alias("std"))
    grain, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, n in enumerate(names):
        here = F.col("gid") == ((1 << len(names)) - 1) & ~(1 << (len(names) - 1 - i))
        grain, group = F.when(here, n).otherwise(grain), F.when(here, F.col(n)).otherwise(group)
    return grouped.select(grain.alias("grain"), group.alias("group"), "metric", "n", "mean", "std")


def daily_means(df: DataFrame, ts: str, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.avg(value).alias("value"), F.count(value).alias("n"))


def descriptive(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), std_or_zero(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), adjusted_skewness(v).alias("skewness"))
    return with_quantiles(out, df, by, {"median": 0.5}, value).select(*by, "n", "mean", "std", "median", "min", "max", "skewness")


def descriptive_by_grain(df: DataFrame, date: str) -> DataFrame:
    """df: basis, metric, value. Month, season, year, and year with season."""
    d = F.col(date)
    keys = {"month": F.date_format(d, "yyyy-MM"), "season": season(F.month(d)), "year": F.year(d), "year_season": F.concat_ws(" ", F.year(d), season(F.month(d)))}
    return descriptive(_by_grain(df, keys, ["basis", "metric", "value"]), ["basis", "metric", "grain", "group"])


def histogram(df: DataFrame, keys: list[str], value: str = "value", width: float = 0.01) -> DataFrame:
    """Counts of the bins that aren't empty."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / width + 1e-12).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cumulative_histogram(hist: DataFrame, keys: list[str], width: float = 0.01) -> DataFrame:
    """Percentages and running counts in bin order; windows run over bins, not rows."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return hist.select(*keys, "bin", (F.col("bin") * width).alias("bin_start"), "n", F.round(100.0 * F.col("n") / total, 4).alias("percent"), upto.alias("cumulative"), F.round(100.0 * upto / total, 4).alias("cumulative_percent"), total.alias("total"))


def mean_of_daily_means(df: DataFrame, ts: str, keys: list[str], groups: dict[str, Column], value: str = "value") -> DataFrame:
    """groups: further keys as columns of the day, which is called date."""
    daily = daily_means(df, ts, keys, value)
    v = F.col("value")
    return daily.groupBy(*keys, *(c.alias(n) for n, c in groups.items())).agg(F.avg(v).alias("mean"), std_or_zero(v).alias("std"), F.count(v).alias("days"), F.sum("n").alias("n"))


def annual_with_total(df: DataFrame, ts: str, keys: list[str], value: str = "value") -> DataFrame:
    v, year = F.col(value), F.year(ts)
    base = df.select(*keys, v.alias("value"), year.alias("year"))
    sets = [[*map(F.col, keys), F.col("year")], [*map(F.col, keys)]]
    out = base.groupingSets(sets, *map(F.col, keys), F.col("year")).agg(F.grouping("year").alias("all"), F.count("value").alias("n"), F.avg("value").alias("mean"), std_or_zero(F.col("value")).alias("std"))
    return out.select(*keys, F.when(F.col("all") == 1, "All years").otherwise(F.col("year").cast("string")).alias("year"), "n", "mean", "std")


def annual_pair(df: DataFrame, ts: str, a: str, b: str) -> DataFrame:
    """n is the smaller of the two counts."""
    return df.groupBy(F.year(ts).alias("year")).agg(F.avg(a).alias("mean_a"), std_or_zero(F.col(a)).alias("std_a"), F.avg(b).alias("mean_b"), std_or_zero(F.col(b)).alias("std_b"), F.least(F.count(a), F.count(b)).alias("n"))


def class_crosstab(df: DataFrame, group: str, class_col: str = "class") -> DataFrame:
    """Counts and percentages of each class by group, with a row for all."""
    counts = [F.count_if(F.col(class_col) == c).alias(c.lower().replace(" ", "_")) for c in CLASSES]
    names = [c.lower().replace(" ", "_") for c in CLASSES]
    out = df.where(F.col(class_col).isNotNull()).rollup(group).agg(F.grouping(group).alias("all"), *counts, F.count(F.lit(1)).alias("total"))
    return out.select(F.when(F.col("all") == 1, "All").otherwise(F.col(group).cast("string")).alias("group"), *names, "total", *(F.round(100.0 * F.col(n) / F.col("total"), 2).alias(f"{n}_percent") for n in names))


def percent_of_group(counts: DataFrame, group: list[str], n: str = "n") -> DataFrame:
    return counts.withColumn("percent", F.round(100.0 * F.col(n) / F.sum(n).over(Window.partitionBy(*group)), 4))


def season_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(season(F.month(ts)).alias("season")).agg(F.count(F.lit(1)).alias("n"))


def merge_observations(df: DataFrame, keys: list[str], metrics: list[str], order: list[str], source: str) -> DataFrame:
    """One row a key: each metric's first value that isn't NULL in the given order, and the set of sources."""
    ordinal = F.struct(*order)
    firsts = [F.min_by(F.when(F.col(m).isNotNull(), F.col(m)), F.when(F.col(m).isNotNull(), ordinal)).alias(m) for m in metrics]
    return df.groupBy(*keys).agg(*firsts, F.array_sort(F.collect_set(source)).alias("sources"))


def merge_untimed(df: DataFrame, date: str, time: str, site: str, metrics: list[str], order: list[str], source: str) -> DataFrame:
    """merge_observations; rows without a time are the same only if their values are."""
    signature = F.when(F.coalesce(time, F.lit("")) == "", F.to_json(F.struct(*metrics))).otherwise(F.lit(""))
    keyed = df.withColumns({"signature": signature, "time_key": F.coalesce(time, F.lit(""))})
    return merge_observations(keyed, [date, "time_key", site, "signature"], metrics, order, source).drop("signature")


def drop_exact_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; NULL equals NULL."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def last_per_hour(df: DataFrame, keys: list[str], ts: str, order: list[str]) -> DataFrame:
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys, F.date_trunc("hour", ts).alias("hour_start")).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*keys, "hour_start", "r.*")


def array_stats(df: DataFrame, key: str, array: str) -> DataFrame:
    """Of finite elements, and the array's size, without exploding."""
    finite = F.filter(array, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    total = F.aggregate(finite, F.lit(0.0), lambda s, x: s + x)
    return df.select(key, F.size(array).cast("long").alias("size"), F.size(finite).cast("long").alias("n"), F.array_min(finite).alias("min"), F.array_max(finite).alias("max"), F.when(F.size(finite) > 0, total / F.size(finite)).alias("mean"))


def coverage(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    months = F.count_distinct(F.date_format(ts, "yyyy-MM"))
    seasons = F.array_sort(F.collect_set(season(F.month(ts))))
    return df.groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("rows"), months.alias("months"), F.array_join(seasons, ",").alias("seasons"), (months < 12).alias("short_of_a_year"))


def season_status(df: DataFrame, ts: str) -> DataFrame:
    """All four seasons in order; those without rows say so."""
    spine = df.sparkSession.createDataFrame(list(enumerate(SEASONS)), "place int, season string")
    return F.broadcast(spine).join(season_counts(df, ts), "season", "left").select("place", "season", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "NO DATA").otherwise("OK").alias("status"))


def missing_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~missing).alias("complete"), F.count_if(missing).alias("with_missing"))


def daily_resample(df: DataFrame, ts: str, keys: list[str], value: str = "value") -> DataFrame:
    """Daily means on every day between a key's first and last."""
    daily = df.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.avg(value).alias("mean"))
    spans = daily.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    spine = spans.select(*keys, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return spine.join(daily, [*keys, "date"], "left")


def box_summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Quartiles, and whiskers: the outermost values within 1.5 quartile distances."""
    v = F.col(value)
    q = with_quantiles(df.groupBy(*keys).agg(F.count(v).alias("n")), df, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75}, value)
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = _joined(df.select(*keys, v), q, keys, "inner").where(v.between(F.col("q1") - fence, F.col("q3") + fence))
    return inside.groupBy(*keys, "n", "q1", "median", "q3").agg(F.min(v).alias("low"), F.max(v).alias("high"))


def series_ranges(df: DataFrame, label: str, x: str, value: str) -> DataFrame:
    ok = df.where(F.col(x).isNotNull() & F.col(value).isNotNull())
    return ok.groupBy(label).agg(F.count(F.lit(1)).alias("points"), F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(value).alias("value_min"), F.max(value).alias("value_max"))


def available_metrics(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    return df.groupBy(metric).agg(F.count(value).alias("n")).where("n > 0")


def view_counts(df: DataFrame, ts: str, file_col: str) -> DataFrame:
    return df.agg(F.count_distinct(F.year(ts)).alias("years"), F.count_distinct(F.to_date(ts)).alias("dates"), F.count_distinct(file_col).alias("files"), F.count(F.lit(1)).alias("observations"), F.min(F.to_date(ts)).alias("first"), F.max(F.to_date(ts)).alias("last"))


def retrieval_day_values(df: DataFrame, date: str, metric: str = "metric", value: str = "value") -> DataFrame:
    v = F.col(value)
    return df.groupBy(date, metric).agg(F.avg(v).alias("mean"), std_or_zero(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n"))


def block_spacing(lengths: DataFrame, keys: list[str], length: str = "length", position: str = "position") -> DataFrame:
    """How often each length occurs; modal marks the most frequent, on ties the one seen first."""
    counts = lengths.groupBy(*keys, length).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("seen"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "seen"))
    return counts.withColumn("modal", nth == 1).drop("seen")


def stock_totals(stock: DataFrame, place: str) -> DataFrame:
    """stock: what explode_stock makes. Item totals count each item once, places each place."""
    items = stock.groupBy("page", "item_no").agg(F.first("item_availability").alias("a")).groupBy("page").agg(F.sum("a").alias("total"))
    places = stock.groupBy("page").agg(F.sum(F.when(F.col("location") == place, F.col("availability"))).alias("at_place"))
    return items.join(places, "page")
