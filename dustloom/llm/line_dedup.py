"""Line dedup by overlapping three-line windows.

Each three consecutive lines of a text are hashed to 128 bits. The first occurrence of a window, by identifier
and position, stays; each later one covers its three lines, overlapping covers are merged to intervals, and the
lines in them are removed. Only hashes and positions are shuffled to find repeats, with partial minima before.
A removed line always stays in some earlier place: the first occurrence of its window, or one before that.

Defined results: lines end at U+000A and keep all other characters; windows of three blank lines don't count;
texts of fewer than three lines and null texts lose nothing (null stays null, digests count it as empty); null
identifiers come last; of rows that repeat an identifier the one read first comes first; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustloom.llm.common import row_struct, scratch

WINDOW = 3


def _windows(lines: Column) -> Column:
    """Struct of two hashes for each window, null where all its lines are blank."""

    def one(i: Column) -> Column:
        a, b, c = (F.element_at(lines, i + k) for k in range(WINDOW))
        pair = F.struct(F.xxhash64(a, b, c).alias("h1"), F.xxhash64(F.lit("second"), c, a, b).alias("h2"))
        return F.when(a.rlike(r"\S") | b.rlike(r"\S") | c.rlike(r"\S"), pair)

    return F.when(F.size(lines) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(lines) - (WINDOW - 1)), one))


def _intervals(positions: Column) -> Column:
    """Merged covers (first, last) of windows at sorted positions, which count from 0."""
    before, after = (lambda i: F.get(positions, i - 1)), (lambda i: F.get(positions, i + 1))
    firsts = F.filter(positions, lambda p, i: (i == 0) | (p > before(i) + WINDOW))
    lasts = F.filter(positions, lambda p, i: (i == F.size(positions) - 1) | (after(i) > p + WINDOW))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), (b + WINDOW - 1).alias("last")))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, row, lines and covers (null where nothing is covered) of each row of docs."""
    lines = F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n", -1)
    given = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("doc_id"), row_struct(docs, "row"), lines.alias("lines"))
    base = scratch(given.select("uid", "doc_id", "row", _windows(F.col("lines")).alias("windows")), "lines")
    each = base.select("uid", "doc_id", F.posexplode("windows").alias("pos", "w")).where("w IS NOT NULL").select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid", "pos").alias("at"), "w.h1", "w.h2")
    repeated = each.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = each.join(repeated, ["h1", "h2"]).where(~F.col("at").eqNullSafe(F.col("first"))).select("at.uid", "at.pos")
    covers = later.groupBy("uid").agg(_intervals(F.array_sort(F.collect_set("pos"))).alias("covers"))
    body = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    return base.select("uid", "doc_id", "row").join(covers, "uid", "left").withColumn("lines", F.split(body, "\n", -1))


def _kept() -> Column:
    """The lines before, between and behind the covers, which are in order: one slice each."""
    n = F.size("covers")

    def between(i: Column) -> Column:
        begin = F.when(i > 0, F.get("covers", i - 1)["last"] + 1).otherwise(0)
        end = F.when(i < n, F.get("covers", i)["first"]).otherwise(F.size("lines"))
        return F.slice("lines", begin.cast("int") + 1, (end - begin).cast("int"))

    return F.flatten(F.transform(F.sequence(F.lit(0), n), between))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines of later occurrences; all rows and other columns stay."""
    marked = _marked(docs, id_col, text_col)
    text = F.when(F.col("covers").isNull(), F.col("row").getField(text_col)).otherwise(F.array_join(_kept(), "\n"))
    return marked.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the remaining text's SHA-256 for each row of docs."""
    marked = _marked(docs.select("doc_id", "text"), "doc_id", "text")
    kept = marked.withColumn("kept", F.when(F.col("covers").isNull(), F.col("lines")).otherwise(_kept()))
    return kept.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("text_sha256"))
