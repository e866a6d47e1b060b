"""Filters and selections."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustloom.functions.columns import season, season_year

EXCLUDED_DATES = ("2022-10-21",)


def exclude_dates(df: DataFrame, date_col: str, dates=EXCLUDED_DATES) -> DataFrame:
    return df.where(~F.coalesce(F.col(date_col).cast("date").isin(*[F.lit(d).cast("date") for d in dates]), F.lit(False))) if dates else df


def select_periods(df: DataFrame, ts: str, periods: list[str] | None) -> DataFrame:
    """Exact year-months. None keeps all; a list without any valid one keeps nothing."""
    if periods is None:
        return df
    valid = [p for p in periods if len(p) == 7 and p[4] == "-" and p[:4].isdigit() and p[5:].isdigit() and 1 <= int(p[5:]) <= 12]
    return df.where(F.date_format(ts, "yyyy-MM").isin(valid)) if valid else df.where(F.lit(False))


def select_calendar(df: DataFrame, ts: str, years=None, months=None, seasons=None, by_season_year: bool = False) -> DataFrame:
    """All given sets must hold; with by_season_year December counts to the next year."""
    year = season_year(F.col(ts)) if by_season_year else F.year(ts)
    tests = [c.isin(*v) for c, v in ((year, years), (F.month(ts), months), (season(F.month(ts)), seasons)) if v]
    return reduce(lambda d, t: d.where(t), tests, df)


def negative_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in cols})


def drop_untimed(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull())


def any_metric_present(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.where(F.coalesce(*(F.col(m) for m in metrics)).isNotNull())


def all_metrics_present(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.dropna("any", subset=metrics)


def horizon(df: DataFrame, hour_col: str, low: float = 0.0, high: float = 72.0) -> DataFrame:
    return df.where(F.col(hour_col).between(low, high + 1e-9))


def min_level(df: DataFrame, level_col: str, least: float = 1000.0) -> DataFrame:
    """Levels come as text; what isn't a number goes."""
    return df.where(F.col(level_col).cast("string").try_cast("double") >= least)


def plausible(df: DataFrame, value_col: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(value_col).between(low, high))


def sheet_scope(cells: DataFrame, all_sheets_month: str = "2020-07") -> DataFrame:
    """cells: path, month_key, sheet_no, row_no, cells. First sheets only but in one month; sheets that say 'no data' at their top go."""
    top = (F.col("row_no") <= 10) & F.exists(F.slice("cells", 1, 5), lambda c: F.lower(c).contains("no data"))
    flagged = cells.where(top).select("path", "sheet_no").distinct()
    return cells.where((F.col("sheet_no") == 1) | (F.col("month_key") == all_sheets_month)).join(flagged, ["path", "sheet_no"], "left_anti")


def validate_records(df: DataFrame, rules: dict[str, Column], reason_col: str = "failed") -> tuple[DataFrame, DataFrame]:
    """(good rows, the others with the names of the rules that they fail). A rule that is NULL fails."""
    names = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())), lambda x: x.isNotNull())
    marked = df.withColumn(reason_col, names)
    return marked.where(F.size(reason_col) == 0).drop(reason_col), marked.where(F.size(reason_col) > 0)


#: The numbers of an orbital element record.
ELEMENT_NUMBERS = ("mean_motion", "eccentricity", "inclination", "ra_of_asc_node", "arg_of_pericenter", "mean_anomaly", "norad_cat_id", "element_set_no", "rev_at_epoch", "bstar", "mean_motion_dot", "mean_motion_ddot")


def element_rules(columns: list[str] | None = None, object_id: str | None = None) -> dict[str, Column]:
    """Of an orbital element record. columns: those that the records have, if they are a part of it; object_id: the one designator allowed."""
    c = F.col
    has = (lambda n: True) if columns is None else {x.lower() for x in columns}.__contains__
    finite = lambda n: F.coalesce(~F.isnan(c(n).cast("double")) & (F.abs(c(n).cast("double")) != float("inf")), F.lit(False))
    rules = {
        "id": c("norad_cat_id") > 0,
        "name": F.trim("object_name") != "",
        "epoch": c("epoch").try_cast("timestamp").isNotNull(),
        "finite": reduce(and_, (finite(n) for n in ELEMENT_NUMBERS if has(n))),
        "mean_motion": c("mean_motion") > 0,
        "eccentricity": (c("eccentricity") >= 0) & (c("eccentricity") < 1),
    }
    if has("object_id"):
        rules["designator"] = c("object_id") == object_id if object_id else c("object_id").rlike("^[0-9]{4}-[0-9]{3}[A-Z]{1,3}$")
    if has("ephemeris_type"):
        rules["type"] = c("ephemeris_type").cast("double") == 0
    return rules


def period_overlap(events: DataFrame, start: Column, end: Column, entry_col: str = "entry", exit_col: str = "exit") -> DataFrame:
    kept = events.where((F.col(exit_col) > start) & (F.col(entry_col) < end))
    return kept.withColumn("ongoing", F.col(entry_col) < start)


def finite_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.where(ok(a) & ok(b))
