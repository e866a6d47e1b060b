"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket in which a source's budget ends is found from the
cumulative sums and only this bucket is refined by further bits of the hash. Documents under the threshold
are taken once more than the whole repeats, so a smaller budget's documents are among a larger one's. No
document is sorted but those of the last boundary bucket, about one in 16 million of a source.

Defined results: a null text has no words; a null source is a source of its own, last in order; a source
without words has target 0; documents which share identifier and source share their fate; columns that the
input has besides the three named pass through mixed_rows() and don't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dustloom.llm.common import WORD, row_struct, scratch

#: Weights by a source's place, repeating.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: With more sources than this the joins on them shuffle, and adaptive execution splits the hot ones.
BROADCAST_SOURCES = 20_000
#: Bits of the hash, and bits of it by which one histogram splits.
HASH_BITS, STEP_BITS = 60, 12


def hash60(col):
    """The leading 60 bits of MD5 of the identifier as text."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """One row a source: source, source_size, target. The windows run over sources, not documents."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    with_weight = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * most_repeats
    order = Window.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("w").over(rest)
    leveled = with_weight.withColumn("level", level).withColumn("cap_level", cap / F.col("w"))
    final = F.min(F.when(F.col("cap_level") > F.col("level"), F.struct("cap_level", "level"))).over(everything)["level"]
    return leveled.select("source", "source_size", F.coalesce(F.least(cap.cast("double"), F.col("w") * final), cap.cast("double")).alias("target"))


def _boundary(sizes: DataFrame, bounds: DataFrame, bits_left: int, few=lambda df: df) -> DataFrame:
    """Narrows each source's boundary to one bucket of the next bits. bounds: source, low (prefix of the hash), rest."""
    inside = sizes.join(few(bounds), F.col("source").eqNullSafe(F.col("key"))).where(F.shiftright("h", bits_left + STEP_BITS) == F.col("prefix"))
    hist = inside.groupBy("key", "rest", F.shiftright("h", bits_left).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    upto = F.sum("in_bucket").over(Window.partitionBy("key").orderBy("bucket"))
    over = hist.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
    first = over.groupBy("key").agg(F.min(F.struct("bucket", "upto", "in_bucket", "rest")).alias("b"))
    return first.select("key", F.col("b.bucket").alias("prefix"), (F.col("b.rest") - (F.col("b.upto") - F.col("b.in_bucket"))).alias("rest"))


def thresholds(sizes: DataFrame, targets: DataFrame, few=lambda df: df) -> DataFrame:
    """source_key, whole (repeats of every document), threshold: documents with h <= threshold are taken once more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.select(F.col("source").alias("key"), whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"))
    bounds = plan.select("key", F.lit(0).cast("long").alias("prefix"), "rest")
    steps = 2
    for step in range(1, steps + 1):
        bounds = _boundary(sizes, bounds, HASH_BITS - step * STEP_BITS, few)
    left = HASH_BITS - steps * STEP_BITS
    last = sizes.join(few(bounds), F.col("source").eqNullSafe(F.col("key"))).where(F.shiftright("h", left) == F.col("prefix"))
    by_hash = last.groupBy("key", "rest", "prefix", "h").agg(F.sum("size").alias("z"))
    by_hash = by_hash.withColumn("upto", F.sum("z").over(Window.partitionBy("key").orderBy("h")))
    taken = F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("z"))
    cut = by_hash.groupBy("key").agg(F.max(F.when((F.col("upto") <= F.col("rest")) | taken, F.col("h"))).alias("h"), F.first("prefix").alias("prefix"))
    cut = cut.select(F.col("key").alias("cut_key"), F.coalesce("h", F.shiftleft("prefix", left) - 1).alias("threshold"))
    # without a boundary no hash goes over the rest, and all is taken; without a rest nothing is
    joined = plan.join(cut, plan["key"].eqNullSafe(cut["cut_key"]), "left")
    threshold = F.when(F.col("rest") > 0, F.coalesce("threshold", F.lit((1 << HASH_BITS) - 1))).otherwise(F.lit(-1))
    return joined.select("key", F.col("whole").cast("int").alias("whole"), threshold.alias("threshold"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, rows: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, repeats, taken; with rows=True also the input's row as a struct."""
    ident, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    given = docs.select(ident.alias("doc_id"), source.cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hash60(ident).alias("h"), *([row_struct(docs, "row")] if rows else []))
    base = given if rows else scratch(given, "mix")
    sizes = scratch(given.select("source", "size", "h"), "mix") if rows else base.select("source", "size", "h")
    targets = scratch(source_targets(sizes, weights), "mix-targets")
    # the side of sources is broadcast only when counted to be small; a hot source's rows then stay where they are
    few = F.broadcast if targets.count() <= BROADCAST_SOURCES else lambda df: df
    cuts = scratch(thresholds(sizes, targets, few), "mix-cuts")
    plan = targets.join(cuts, targets["source"].eqNullSafe(cuts["key"])).select("key", "source_size", "target", "whole", "threshold")
    plan = few(plan)
    repeats = F.col("whole") + (F.col("h") <= F.col("threshold")).cast("int")
    out = base.join(plan, F.col("source").eqNullSafe(F.col("key"))).withColumn("repeats", repeats)
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"), *(["row"] if rows else []))


def mixed_rows(docs: DataFrame, **names) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    return mix(docs, rows=True, **names).where("repeats > 0").select(F.explode(F.array_repeat("row", F.col("repeats"))).alias("row")).select("row.*")
