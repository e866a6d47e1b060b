"""Exact top-k inner products by a bit-sliced index.

Vectors become integers floor(SCALE * x). The index cuts them to blocks of rows; a block keeps, for each
component, the leading SLICE_BITS bits as bitmaps over its rows. For a query the slices are added as bit-sliced
numbers, by carry-save adders over whole bitmaps; the k-th highest sum is found from the most significant
slice downward; what the cut-off bits can change bounds the sums of all rows that may be among the k best, and
only these boundary rows' exact scores are computed. Blocks of queries and blocks of rows are gathered to tiles of
bounded size, and each two tiles are one group of a cogrouped equi-join: a block is sent once for each tile of the other
side, and a query leaves a tile of rows with k rows, not with k for each block. The index is a table of plain columns.

Defined results: vectors that are null, or hold a null, NaN or infinite component, or have no vec_id take no
part; a row isn't a candidate for a query of the same vec_id; shorter vectors count as filled up with zeros;
scores beyond 64 bits are held at its ends; ties go to the smaller vec_id; no queries, no rows. Queries
that repeat a vec_id share that query_id's k best; candidates that repeat one are candidates of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dustloom.llm.common import chunks, on_workers, scratch

SCALE = 256
SLICE_BITS = 6
BLOCK_ROWS = 8192
BLOCK_QUERIES = 512
#: The most blocks and bytes of a tile. Smaller tiles are taken where there would be fewer groups than tasks.
TILE_BLOCKS, TILE_BYTES = 64, 96 << 20
MOST_PARTITIONS = 20_000
#: A block: width bytes a component of x (0: decimal text), slices of bits bitmaps a component (bits 0: none); all little-endian.
VERSION = 1
BLOCK = "version int, rows int, dims int, width int, bits int, cut int, ids binary, x binary, slices binary"
#: Components above this size are scored exactly, without slices.
MOST_COMPONENT = 1 << 24
LONG = (1 << 63) - 1


def integers(vectors: list[list[float]], dims: int) -> np.ndarray:
    """floor(SCALE * x) of the vectors, filled up to dims; Python integers if one is large."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(out * SCALE)
    if out.size and not np.abs(out).max() <= MOST_COMPONENT:
        scaled = [[int(np.floor(x * SCALE)) if np.isfinite(x * SCALE) else int(x) * SCALE for x in v] + [0] * (dims - len(v)) for v in vectors]
        return np.array(scaled, dtype=object)
    return out.astype(np.int64)


def bitmap(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def places(bits: int, rows: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-rows // 8), "little"), np.uint8), count=rows, bitorder="little"))


def slice_block(x: np.ndarray) -> tuple[int, list[list[int]]]:
    """(cut bits, for each component its slices from the least significant)."""
    low = int(x.min()) if x.size else 0
    width = max(1, (int(x.max()) - low).bit_length() if x.size else 1)
    cut = max(0, width - SLICE_BITS)
    u = (x - low) >> cut
    return cut, [[bitmap((u[:, d] >> b) & 1) for b in range(width - cut)] for d in range(x.shape[1])]


def add_slices(columns: list[list[int]]) -> list[int]:
    """The slices of the sum of bitmaps; columns[w]: bitmaps that count 2**w. Full adders take three of a column at once."""
    out, w = [], 0
    while w < len(columns):
        column = columns[w]
        if len(column) > 1 and w + 1 == len(columns):
            columns.append([])
        carry = columns[w + 1] if w + 1 < len(columns) else None
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            ab = a ^ b
            column.insert(0, ab ^ c)
            carry.append((a & b) | (ab & c))
        if len(column) == 2:
            a, b = column
            carry.append(a & b)
            column = [a ^ b]
        out.append(column[0] if column else 0)
        w += 1
    return out


def kth_highest(slices: list[int], among: int, k: int) -> int:
    """The k-th highest of the bit-sliced numbers of the rows in among, from the most significant slice downward."""
    value, inside = 0, among
    for w in range(len(slices) - 1, -1, -1):
        with_bit = inside & slices[w]
        n = with_bit.bit_count()
        if n >= k:
            inside = with_bit
            value |= 1 << w
        else:
            k -= n
            inside &= ~slices[w]
    return value


def at_least(slices: list[int], among: int, value: int) -> int:
    """The rows of among whose number is value or more."""
    above, equal = 0, among
    for w in range(max(len(slices), value.bit_length()) - 1, -1, -1):
        bits = slices[w] if w < len(slices) else 0
        if value >> w & 1:
            equal &= bits
        else:
            above |= equal & bits
            equal &= ~bits
    return above | equal


def boundary_rows(q: np.ndarray, cut: int, slices: list[list[int]], among: int, k: int) -> int:
    """A bitmap of rows that holds the k best of among. Negative parts of q add the slices' complements."""
    columns: list[list[int]] = [[]]
    for weight, own in zip(q.tolist(), slices, strict=True):
        size = abs(weight)
        shift = 0
        while size >> shift:
            if size >> shift & 1:
                while len(columns) < shift + len(own):
                    columns.append([])
                for b, bits in enumerate(own):
                    columns[shift + b].append(bits if weight > 0 else among & ~bits)
            shift += 1
    sums = add_slices(columns)
    slack = ((1 << cut) - 1) * int(np.abs(q).sum()) >> cut
    return at_least(sums, among, max(0, kth_highest(sums, among, k) - slack - 1))


def best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, cut: int | None, slices, k: int, others: int) -> list[tuple[int, int]]:
    """(score, vec_id) of the k best rows of a block. others: bitmap of the rows that aren't the query's own."""
    n = others.bit_count()
    if not n:
        return []
    plain = cut is None or q.dtype == object
    rows = places(others if plain or n <= k else boundary_rows(q, cut, slices, others, k), len(ids))
    scores = x[rows].astype(object) @ q.astype(object) if plain else x[rows].astype(np.int64) @ q
    order = np.lexsort((ids[rows], -scores)) if not plain else sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))
    return [(max(-LONG - 1, min(LONG, int(scores[i]))), int(ids[rows[i]])) for i in order[:k]]


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    return own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def write_block(ids: list[int], x: np.ndarray, slices: bool) -> dict:
    """A row of BLOCK."""
    rows, dims = x.shape
    row = {"version": VERSION, "rows": rows, "dims": dims, "width": 0, "bits": 0, "cut": 0, "ids": np.array(ids, "<i8").tobytes(), "slices": b""}
    if x.dtype == object:
        return {**row, "x": ",".join(map(str, x.ravel())).encode()}
    most = int(np.abs(x).max()) if x.size else 0
    row["width"] = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1))
    if slices:
        row["cut"], own = slice_block(x)
        row["bits"] = len(own[0]) if own else 0
        row["slices"] = b"".join(bits.to_bytes(-(-rows // 8), "little") for column in own for bits in column)
    return {**row, "x": x.astype(f"<i{row['width']}").tobytes()}


def read_block(row: dict) -> tuple[np.ndarray, np.ndarray, int | None, list[list[int]] | None]:
    """ids, x, cut bits and slices; neither of the last two where the block has none."""
    if row["version"] != VERSION:
        raise ValueError(f"block of version {row['version']}, not {VERSION}")
    ids, shape, bits = np.frombuffer(row["ids"], "<i8"), (row["rows"], row["dims"]), row["bits"]
    if row["width"] == 0:
        return ids, np.array([int(v) for v in row["x"].decode().split(",") if v], dtype=object).reshape(shape), None, None
    x = np.frombuffer(row["x"], f"<i{row['width']}").reshape(shape)
    if not bits:
        return ids, x, None, None
    size = -(-row["rows"] // 8)
    maps = [int.from_bytes(row["slices"][at : at + size], "little") for at in range(0, len(row["slices"]), size)]
    return ids, x, row["cut"], [maps[d * bits : (d + 1) * bits] for d in range(row["dims"])]


def _pack(slices: bool):
    """A partition's vectors as blocks, one for each 64 MiB."""
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in BLOCK.split(", "))])

    def run(batches):
        for part in chunks(batches, 64 << 20):
            ids, vectors = part.column("vec_id").to_pylist(), part.column("v").to_pylist()
            yield pa.RecordBatch.from_pylist([write_block(ids, integers(vectors, max(map(len, vectors))), slices)], schema)

    return run


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        wanted = [(number, ids, x.astype(object if x.dtype == object else np.int64)) for number, (ids, x, _, _) in enumerate(map(read_block, queries.to_pylist()))]
        for row in rows.to_pylist():
            ids, x, cut, slices = read_block(row)
            everything = (1 << len(ids)) - 1
            for number, ids_q, q in wanted:
                q = np.pad(q, ((0, 0), (0, max(0, x.shape[1] - q.shape[1]))))[:, : x.shape[1]]
                same = set(np.intersect1d(ids, ids_q).tolist())
                for nth, (ident, vector) in enumerate(zip(ids_q.tolist(), q, strict=True)):
                    others = everything & ~bitmap(ids == ident) if ident in same else everything
                    held = found.setdefault((number, nth), [])
                    held += [(-s, v) for s, v in best(vector, ids, x, cut, slices, k, others)]
                    if len(held) > k:
                        held.sort()
                        del held[k:]
        out = [(int(wanted[number][1][nth]), v, -s) for (number, nth), held in found.items() for s, v in held]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    return run


def _blocks(usable: DataFrame, rows: int, slices: bool, label: str) -> DataFrame:
    """A written table of blocks of about so many rows; n: the number of the part that a block comes from, without gaps."""
    parts = max(1, -(-usable.count() // rows))
    return scratch(usable.repartition(parts).mapInArrow(_pack(slices), BLOCK).withColumn("n", F.spark_partition_id()), label)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index: a written table of blocks."""
    on_workers(vectors.sparkSession)
    return _blocks(_usable(vectors, id_col, vec_col), block_rows, True, "slices")


def _tiles(blocks: DataFrame) -> tuple[int, int]:
    """(number of parts, the most parts of a tile)."""
    size = F.octet_length("ids") + F.octet_length("x") + F.octet_length("slices")
    parts = blocks.groupBy("n").agg(F.sum(size).alias("bytes"))
    last, most = parts.agg(F.max("n"), F.max("bytes")).first()
    return (0 if last is None else last + 1), max(1, min(TILE_BLOCKS, TILE_BYTES // max(1, most or 0)))


def top_k(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of the index for each row of queries."""
    on_workers(queries.sparkSession)
    usable = _usable(queries, id_col, vec_col)
    packed = _blocks(usable, block_queries, False, "queries")
    (n, rows), (m, asked) = _tiles(index), _tiles(packed)
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    while max(rows, asked) > 1 and -(-n // rows) * -(-m // asked) < tasks:
        rows, asked = (-(-rows // 2), asked) if rows >= asked else (rows, -(-asked // 2))
    across, down = max(1, -(-n // rows)), max(1, -(-m // asked))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    parts = min(2 * across * down, MOST_PARTITIONS)
    own = [f.split()[0] for f in BLOCK.split(", ")]
    left = index.select(*own, F.floor(F.col("n") / rows).cast("int").alias("r"), every(down).alias("q")).repartition(parts, "r", "q")
    right = packed.select(*own, every(across).alias("r"), F.floor(F.col("n") / asked).cast("int").alias("q")).repartition(parts, "r", "q")
    found = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
