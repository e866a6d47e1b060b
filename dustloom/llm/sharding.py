"""Sharding by vector bin packing.

Groups of equal texts are the things to place; each has a vector of bytes, tokens and rows, and goes to the shard where the
dot product of its vector with the residual capacity is highest, largest groups first. That is done in two levels. Groups of
at least LARGE_PART of a shard in some dimension, whose number the shards bound, are placed by the driver; one of more than
HEAVY_PART of a shard, which no shard could take with loads near equal, is cut to pieces by a number that its rows got when
they were read. All other groups are dealt by hash to parts of about PART_GROUPS groups, which tasks pack by the same
rule: a part has its share of the capacity that the large groups left in each shard, and begins at a shard of its own where
shards are equal, so that the parts' remainders don't add up. The number of parts grows with the groups, a part doesn't.
Slots count within (shard, part), offset by what the shard already holds, so no shard is sorted in one task. Groups under
HEAVY_PART lie in one shard each.

Defined results: a null text has no bytes and no tokens and forms one group with other null texts; rows
that repeat an identifier, null ones too, are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dustloom.llm.common import WORD, on_workers, scratch

ROW_BYTES = 16
#: Groups that one task packs, more or less.
PART_GROUPS = 20_000
#: A group is placed by the driver from this part of a shard in some dimension, and is cut when it is more than that one.
LARGE_PART, HEAVY_PART = 1 / 500, 1 / 8
DIMS = ("size", "tokens", "n_rows")


def place(vectors: np.ndarray, shards: int, capacity: np.ndarray | None = None, first: int = 0) -> np.ndarray:
    """The shard of each row of vectors. Largest first; among the shards that it fits, the highest dot product wins.

    capacity: of each shard in each dimension; by default equal parts of all. Of equal shards the next from first on wins.
    """
    if capacity is None:
        capacity = np.tile(np.maximum(vectors.sum(axis=0), 1) / shards, (shards, 1))
    scale = np.maximum(capacity.mean(axis=0), 1e-9)
    need, residual = vectors / scale, capacity / scale
    turn = (np.arange(shards) + first) % shards
    residual = residual[turn]
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((np.arange(len(need)), -need.max(axis=1, initial=0))):
        fits = (residual >= need[i]).all(axis=1)
        score = residual @ need[i]
        best = np.argmax(np.where(fits, score, -np.inf)) if fits.any() else np.argmax(score)
        out[i] = best
        residual[best] -= need[i]
    return turn[out]


def _packed(left: np.ndarray):
    """One part's groups to their shards. left: what the large groups left of each shard, as shares of all that is left."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group")
        vectors = pdf[list(DIMS)].to_numpy(float)
        shard = place(vectors, len(left), left * vectors.sum(axis=0), int(pdf["part"].iloc[0]) % len(left))
        return pd.DataFrame({"group": pdf["group"], "part": pdf["part"], "shard": shard.astype(np.int32)})

    return pack


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot for each row of docs."""
    spark = docs.sparkSession
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    body = F.coalesce(text, F.lit("")).cast("binary")
    base = scratch(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            ident.alias("doc_id"),
            (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(text, F.octet_length(body)).alias("group"),
        ),
        "shard",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")]
    groups = scratch(base.groupBy("group").agg(*sums), "groups")
    total = groups.agg(*(F.sum(d).alias(d) for d in DIMS), F.count(F.lit(1)).alias("groups")).first()
    share = F.greatest(*(F.col(d) / max(1.0, (total[d] or 0) / shards) for d in DIMS))
    # in each of the three dimensions at most shards / LARGE_PART groups can be over the limit
    large = groups.where(share >= LARGE_PART).select("group", F.ceil(share / HEAVY_PART).cast("int").alias("pieces"))
    piece = F.xxhash64("group", F.pmod(F.xxhash64("uid"), F.col("pieces")))
    heavy = base.join(F.broadcast(large), "group").withColumn("part", F.pmod(piece, F.lit(1 << 62)))
    loads = heavy.groupBy("part").agg(*sums).orderBy("part").collect()  # at most large groups and pieces
    vectors = np.array([[r[d] for d in DIMS] for r in loads], dtype=float).reshape(-1, len(DIMS))
    capacity = np.array([[max(1.0, (total[d] or 0)) / shards for d in DIMS]] * shards)
    where = place(vectors, shards, capacity)
    np.subtract.at(capacity, where, vectors)
    left = np.maximum(capacity, 0)
    left = left / np.maximum(left.sum(axis=0), 1e-9)
    placed = spark.createDataFrame([(r["part"], s) for r, s in zip(loads, where.tolist(), strict=True)], "part long, shard int")
    parts = max(1, -(-total["groups"] // PART_GROUPS))
    on_workers(spark)
    # numbers below zero are parts, those above are large groups' pieces
    rest = groups.join(F.broadcast(large), "group", "left_anti").withColumn("part", -1 - F.pmod("group", F.lit(parts)))
    packed = rest.select("group", "part", *DIMS).groupBy("part").applyInPandas(_packed(left), "group long, part long, shard int")
    light = base.join(F.broadcast(large.select("group")), "group", "left_anti").join(packed, "group")
    cols = ["doc_id", "size", "tokens", "text_crc32", "shard", "part", "group", "uid"]
    dealt = scratch(light.select(*cols).unionByName(heavy.join(F.broadcast(placed), "part").select(*cols)), "dealt")
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32", "group", "uid")) - 1
    out = dealt.withColumn("nth", nth).join(offsets, ["shard", "part"])
    return out.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first_slot") + F.col("nth")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **names) -> None:
    """Writes the rows of docs with their shard and slot, one folder a shard. Identifiers must be unique."""
    id_col = names.get("id_col", "doc_id")
    placed = shard(docs, **names).select(F.col("doc_id").alias("_placed_id"), "shard", "slot")
    docs.join(placed, docs[id_col].eqNullSafe(placed["_placed_id"])).drop("_placed_id").write.partitionBy("shard").parquet(path)
