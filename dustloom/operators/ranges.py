"""Rows in order over many tasks: range partitions, the rows at their edges, and running values carried from range to range.

A key's rows may lie in many partitions, so no window here spans a whole key: each is over a key within one partition, and
what it lacks comes from a table of one row a partition, which is all that is broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustloom.session import written

_UNORDERED = (T.MapType, T.VariantType)
#: How a running value is aggregated, and how that of earlier partitions is added to it.
_KINDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "xor": (F.bit_xor, lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0)))),
}


class Ordered(NamedTuple):
    """rows: a written table with _part, the number of its range; edges: for each _part the first and last row, and those next to it."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    edges: DataFrame

    def window(self):
        return Window.partitionBy("_part", *self.keys).orderBy(*self.order)

    def of_key(self, row: str) -> Column:
        """Whether a row of edges has the key of the row at hand; null keys are keys too."""
        same = F.col(row).isNotNull()
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(row).getField(k))
        return same


def ordered(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None, with_rest: bool = True) -> Ordered:
    """df by ranges of keys, order and then, so that ties have one order, all other columns that can be compared; rows alike in all of them are the same row."""
    rest = [f.name for f in df.schema.fields if f.name not in (*keys, *order) and not isinstance(f.dataType, _UNORDERED)] if with_rest else []
    names = [*keys, *order, *rest]
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *names).withColumn("_part", F.spark_partition_id()), "ranges")
    row, along = F.struct(*names), Window.orderBy("_part")
    ends = rows.groupBy("_part").agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    edges = written(ends.select("*", F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after")), "edges")
    return Ordered(rows, keys, [*order, *rest], edges)


def beside(o: Ordered, cols: list[str], rows: DataFrame | None = None) -> DataFrame:
    """The rows, or o's rows with more columns, with _a and _b: structs of cols (of o's) of the rows before and after, NULL at a key's ends."""
    picked = F.struct(*cols)
    met = (o.rows if rows is None else rows).join(F.broadcast(o.edges.select("_part", "_before", "_after")), "_part")
    edge = lambda row: F.when(o.of_key(row), F.struct(*(F.col(row).getField(c).alias(c) for c in cols)))
    near = {"_a": F.coalesce(F.lag(picked).over(o.window()), edge("_before")), "_b": F.coalesce(F.lead(picked).over(o.window()), edge("_after"))}
    return met.withColumns(near).drop("_before", "_after")


def running(df: DataFrame, o: Ordered, values: dict[str, tuple[str, Column]], write: bool = True) -> DataFrame:
    """df, which are o's rows with more columns, with running values up to each row: by name the kind (sum, max or xor) and what is aggregated."""
    df = written(df, "running") if write else df
    last = df.join(F.broadcast(o.edges.select("_part", "_last")), "_part").where(o.of_key("_last"))
    tails = last.groupBy("_part").agg(*(_KINDS[kind][0](c).alias(out) for out, (kind, c) in values.items()))
    key = F.struct(*(F.col("_last").getField(k) for k in o.keys))
    upto = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    sums = o.edges.join(tails, "_part").select("_part", "_first", "_before", *(_KINDS[kind][0](F.col(out)).over(upto).alias(out) for out, (kind, _) in values.items()))
    goes_on = F.col("_before").isNotNull()
    for k in o.keys:
        goes_on = goes_on & F.col("_before").getField(k).eqNullSafe(F.col("_first").getField(k))
    carried = F.lag(F.struct(*values)).over(Window.orderBy("_part"))
    carry = sums.select("_part", F.when(goes_on, F.col("_first")).alias("_first"), carried.alias("_carried"))
    met = df.join(F.broadcast(carry), "_part")
    rows = o.window().rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for name, (kind, c) in values.items():
        agg, add = _KINDS[kind]
        out[name] = add(F.when(o.of_key("_first"), F.col("_carried").getField(name)), agg(c).over(rows))
    return met.withColumns(out).drop("_first", "_carried")


def with_last_rows(o: Ordered, k: int, cols: list[str]) -> DataFrame:
    """The rows, and in front of each partition once more the last k rows of its first key from the partitions before it.

    Those have _before true, cols and o's keys and order; their other columns are NULL. A window of k rows before each
    row then needs its partition alone. What is passed on is k rows a partition at most.
    """
    names = list(dict.fromkeys([*o.keys, *o.order, *cols]))
    last = o.rows.join(F.broadcast(o.edges.select("_part", "_last")), "_part").where(o.of_key("_last"))
    back = Window.partitionBy("_part").orderBy(*(F.desc(c) for c in o.order))
    tails = last.withColumn("_nth", F.row_number().over(back)).where(F.col("_nth") <= k)
    tails = tails.groupBy("_part").agg(F.sort_array(F.collect_list(F.struct(-F.col("_nth"), F.struct(*names).alias("row")))).alias("_rows"))
    key = F.struct(*(F.col("_last").getField(c) for c in o.keys))
    # a short partition hands on what it got, so a partition looks back over k of them at most
    upto = Window.partitionBy(key).orderBy("_part").rowsBetween(-(k - 1), 0)
    held = o.edges.join(tails, "_part").withColumn("_rows", F.flatten(F.collect_list("_rows").over(upto)))
    given = held.select("_part", "_first", "_before", F.lag("_rows").over(Window.orderBy("_part")).alias("_rows"))
    goes_on = F.col("_before").isNotNull()
    for c in o.keys:
        goes_on = goes_on & F.col("_before").getField(c).eqNullSafe(F.col("_first").getField(c))
    passed = given.where(goes_on).select("_part", F.explode(F.slice("_rows", -F.least(F.lit(k), F.size("_rows")), F.lit(k))).alias("_r"))
    passed = passed.select("_part", "_r.row.*", F.lit(True).alias("_before"))
    return o.rows.withColumn("_before", F.lit(False)).unionByName(passed, allowMissingColumns=True)
