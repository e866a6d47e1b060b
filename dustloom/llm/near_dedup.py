"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is the multiset of its shingles of five words; a shingle weighs its count times its inverse
document frequency, the mean over its words, in steps of one half. Words' document frequencies are counted over
all documents in a table of 2**18 hash buckets, so what is broadcast has one size whatever the input. Each of
BANDS * ROWS samples is the (shingle, step) with the smallest log a = log c - r (t - beta) - r, t = floor(log S / r + beta); r, c
and beta come from a pool of 2**16 drawn triples by the shingle's hash. For shingles that occur once the value
is a table lookup by weight step; ties of the pool go by the shingle's hash.

Documents with equal texts are one node. All nodes of a bucket are compared with its centre, the node that shares
the most buckets' places with others. Buckets that still hold different classes are compared in blocks: one of up to
BLOCK_NODES nodes wholly, a larger one first in blocks of about that size, dealt by the next band's value and, where
one value is frequent, by hash, which puts similar nodes together and joins most classes cheaply. What is left of larger
buckets is compared exactly: nodes are dealt to tiles by their class (the bucket's largest or another), by level of
total weight and by hash, and each two tiles that can hold a link are one group of rows. Only pairs of the same class
and pairs whose total weights alone rule a link out are passed over. No bucket is sorted or held in one task. A link is a weighted Jaccard similarity of at least
SIMILARITY. Classes are the connected components of links.

Defined results: words are runs of ASCII letters and digits, underscores and other characters but Latin-1 signs and general and CJK punctuation, lower-cased; a text of one to four words is
one shingle; texts without words are alike only if equal (null counts as empty). The row with the smallest identifier of a class is
kept, nulls last; of rows that repeat it, one. Other columns pass unchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustloom.llm.common import chunks, on_workers, row_struct, scratch
from dustloom.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 6
DF_BITS = 18
POOL_BITS = 16
CHUNK_BYTES = 2 << 20
#: Nodes of a bucket that are compared with each other at once, about as many as a block of a larger bucket or a tile has.
BLOCK_NODES = 256

_U = np.uint64
_POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
#: Bytes of words: ASCII letters, digits, underscore and all others above ASCII but those cut out below.
_IN_WORD = np.array([chr(i).isalnum() or i == 95 or i > 127 for i in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The words of each text as 64-bit hashes, computed from the bytes of all texts at once."""
    raw = [(x or "").lower().encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n\n\n", np.uint8)
    inside = _IN_WORD[data]
    for lead, seconds, width in ((0xC2, (0x80, 0xBF), 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80, 0x80), 3)):
        at = np.flatnonzero(data == lead)  # Latin-1 signs, general and CJK punctuation
        at = at[(data[at + 1] >= seconds[0]) & (data[at + 1] <= seconds[1])]
        for k in range(width):
            inside[at + k] = False
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    begin, size = edges[::2], edges[1::2] - edges[::2]
    if not len(begin):
        return [np.zeros(0, np.uint64) for _ in texts]
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    value = (data[inside].astype(np.uint64) + _U(1)) * _POWER[place & 0xFFFF]
    words = mixed(np.add.reduceat(value, first) + size.astype(np.uint64))
    ends = np.searchsorted(begin, np.cumsum([len(x) + 1 for x in raw]))
    return np.split(words, ends[:-1])


class Weights:
    """Inverse document frequencies from counts by hash bucket."""

    def __init__(self, counts: np.ndarray, documents: int):
        self.idf = np.log1p(documents / (1.0 + counts)).astype(np.float32)

    def shingles(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The different shingles of each text as hashes, their weight steps and their counts."""
        words = word_hashes(texts)
        words = [np.pad(x, (0, SHINGLE - len(x))) if 0 < len(x) < SHINGLE else x for x in words]
        sizes = np.array([len(x) for x in words])
        flat = np.concatenate([*words, np.zeros(SHINGLE, np.uint64)])
        n = len(flat) - SHINGLE + 1
        idf = self.idf[(flat & _U((1 << DF_BITS) - 1)).astype(np.int64)]
        key, mean = np.zeros(n, np.uint64), np.zeros(n, np.float32)
        for i in range(SHINGLE):
            key = key * _U(0x9E3779B97F4A7C15) + flat[i : i + n]
            mean += idf[i : i + n]
        key, step = mixed(key), np.maximum(1, np.rint(mean * (2.0 / SHINGLE))).astype(np.int64)
        out = []
        for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            own = slice(end - size, max(end - size, end - SHINGLE + 1))
            k, w = key[own], step[own]
            order = np.sort(k)
            if (order[1:] == order[:-1]).any():
                k, first, count = np.unique(k, return_index=True, return_counts=True)
                out.append((k, w[first], count))
            else:
                out.append((k, w, np.ones(len(k), np.int64)))
        return out


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """a, b: what Weights.shingles returns. Two sets without shingles have similarity 0."""
    wa, wb = a[1] * a[2], b[1] * b[2]
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(wa[ia], wb[ib]).sum()
    high = wa.sum() + wb.sum() - low
    return float(low / high) if high else 0.0


class Sampler:
    def __init__(self, seed: int = 1):
        draw = np.random.default_rng(seed)
        n = 1 << POOL_BITS
        self.r, self.c = draw.gamma(2.0, 1.0, n), np.log(draw.gamma(2.0, 1.0, n))
        self.beta = draw.random(n)
        self.tables: dict[int, np.ndarray] = {}

    def _log_a(self, log_s, pool) -> np.ndarray:
        """As unsigned integers in the same order, in the upper half of 64 bits."""
        r, beta = self.r[pool], self.beta[pool]
        value = (self.c[pool] - r * (np.floor(log_s / r + beta) - beta) - r).astype(np.float32)
        bits = value.view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        return bits.astype(np.uint64) << _U(32)

    def table(self, step: int) -> np.ndarray:
        if step not in self.tables:
            self.tables[step] = self._log_a(np.log(step / 2), np.arange(1 << POOL_BITS))
        return self.tables[step]

    def samples(self, shingles: list[tuple]) -> np.ndarray:
        """One row of BANDS * ROWS samples for each document; those without shingles have none."""
        full = [i for i, x in enumerate(shingles) if len(x[0])]
        out = np.zeros((len(shingles), BANDS * ROWS), np.uint64)
        if not full:
            return out
        key, step, count = (np.concatenate([shingles[i][k] for i in full]) for k in range(3))
        starts = np.cumsum([0] + [len(shingles[i][0]) for i in full[:-1]])
        steps = np.unique(step)
        flat = np.concatenate([self.table(int(s)) for s in steps])
        base = np.searchsorted(steps, step) << POOL_BITS
        more = np.flatnonzero(count > 1)
        log_more = np.log(step[more] * count[more] / 2)
        tie = key & _U(0xFFFFFFFF)
        for word in range(-(-BANDS * ROWS // 4)):
            h = mixed(key + _U((word * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1)))
            for part in range(4):
                k = 4 * word + part
                if k < BANDS * ROWS:
                    pool = ((h >> _U(16 * part)) & _U(0xFFFF)).astype(np.int64)
                    value = flat[base + pool]
                    if len(more):
                        value[more] = self._log_a(log_more, pool[more])
                    out[full, k] = np.minimum.reduceat(value | tie, starts)
        return out

    def buckets(self, shingles: list[tuple]) -> np.ndarray:
        """BANDS bucket keys for each document."""
        s = self.samples(shingles).reshape(-1, BANDS, ROWS)
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(s), 1))
        for i in range(ROWS):
            key = mixed(key * _U(0x9E3779B97F4A7C15) + s[:, :, i])
        return key.view(np.int64)


_SAMPLER: list[Sampler] = []


def sampler() -> Sampler:
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def _document_frequencies(batches):
    counts, documents = np.zeros(1 << DF_BITS, np.int64), 0
    for part in chunks(batches, CHUNK_BYTES):
        words = word_hashes(part.column("text").to_pylist())
        row = np.repeat(np.arange(len(words), dtype=np.uint64), [len(x) for x in words])
        seen = np.sort(row << _U(DF_BITS) | np.concatenate(words) & _U((1 << DF_BITS) - 1))
        seen = seen[np.diff(seen, prepend=~seen[:1]) != 0]
        counts += np.bincount((seen & _U((1 << DF_BITS) - 1)).astype(np.int64), minlength=1 << DF_BITS)
        documents += len(words)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([seen.tolist()], pa.list_(pa.int32())), pa.array([counts[seen].tolist()], pa.list_(pa.int64()))], names=["documents", "buckets", "counts"])


def corpus_weights(docs: DataFrame, text_col: str = "text") -> Weights:
    """Counts of all documents; what reaches the driver is one table of 2**DF_BITS counts."""
    on_workers(docs.sparkSession)
    parts = scratch(docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_document_frequencies, "documents long, buckets array<int>, counts array<long>"), "df")
    n = parts.agg(F.sum("documents")).first()[0] or 0
    pairs = parts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n")).toPandas()
    counts = np.zeros(1 << DF_BITS, np.int64)
    counts[pairs["buckets"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.int64)
    return Weights(counts, n)


def _signatures(weights: Weights):
    def run(batches):
        task, n = TaskContext.get().partitionId() << 33, 0
        for part in chunks(batches, CHUNK_BYTES):
            texts = part.column("text").to_pylist()
            shingles = weights.shingles(texts)
            buckets = sampler().buckets(shingles)
            cols = {
                "uid": pa.array(range(task + n, task + n + len(texts)), pa.int64()),
                "buckets": pa.array([b.tolist() if len(s[0]) else [] for b, s in zip(buckets, shingles, strict=True)], pa.list_(pa.int64())),
                "weight": pa.array([int((x[1] * x[2]).sum()) for x in shingles], pa.int64()),
            }
            for name in part.column_names:
                col = part.column(name)
                cols[name] = col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks)
            n += len(texts)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def _verified(weights: Weights, similarity: float):
    def run(batches):
        for part in chunks(batches, CHUNK_BYTES):
            us, vs, a, b = (part.column(c).to_pylist() for c in ("u", "v", "u_text", "v_text"))
            centres = dict(zip(vs, b, strict=True))
            centres = dict(zip(centres, weights.shingles(list(centres.values())), strict=True))
            keep = [weighted_jaccard(own, centres[v]) >= similarity for v, own in zip(vs, weights.shingles(a), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(col, keep, strict=True) if y], pa.int64()) for col in (us, vs)], names=["u", "v"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """Of pairs (u, v) those which are similar enough. Both texts are joined on; hot centres are split by AQE."""
    left = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("u_text")), "u")
    both = left.join(texts.select(F.col("node").alias("v"), F.col("text").alias("v_text")), "v").select("u", "v", "u_text", "v_text")
    return scratch(both.mapInArrow(_verified(weights, similarity), "u long, v long"), "verified")


class _Tile:
    """Shingles of several texts, sorted, so that one text is compared with all of them at once."""

    def __init__(self, sets: list[tuple]):
        owner = np.repeat(np.arange(len(sets)), [len(x[0]) for x in sets])
        key, weight = np.concatenate([x[0] for x in sets]), np.concatenate([x[1] * x[2] for x in sets])
        order = np.argsort(key, kind="stable")
        self.key, self.weight, self.owner = key[order], weight[order], owner[order]
        self.total = np.bincount(owner, weight, len(sets))

    def similarities(self, one: tuple) -> np.ndarray:
        """weighted_jaccard of one with each text."""
        own = one[1] * one[2]
        begin = np.searchsorted(self.key, one[0], "left")
        size = np.searchsorted(self.key, one[0], "right") - begin
        at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
        low = np.bincount(self.owner[at], np.minimum(self.weight[at], np.repeat(own, size)), len(self.total))
        high = own.sum() + self.total - low
        return np.divide(low, high, out=np.zeros(len(low)), where=high > 0)


def _tile_links(weights: Weights, similarity: float):
    """Links between different labels of two tiles, or within one (own); rows come sorted by pair of tiles."""

    def run(batches):
        held: list[tuple] = []

        def links():
            out: list[tuple] = []
            left = [x for x in held if not x[2]]
            right = left if held[0][1] else [x for x in held if x[2]]
            if left and right and len({x[4] for x in held}) > 1:
                sets = weights.shingles([x[5] for x in left])
                tile = _Tile(sets if right is left else weights.shingles([x[5] for x in right]))
                root = {x[4]: x[4] for x in held}

                def find(x):
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for i, (a, shingles) in enumerate(zip(left, sets, strict=True)):
                    mine = find(a[4])
                    if all(find(b[4]) == mine for b in right):
                        continue
                    near = np.flatnonzero(tile.similarities(shingles) >= similarity)
                    for j in (near[near < i] if right is left else near).tolist():
                        ra, rb = find(a[4]), find(right[j][4])
                        if ra != rb:
                            root[max(ra, rb)] = min(ra, rb)
                            out.append((a[3], right[j][3]))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["u", "v"])

        for part in chunks(batches, CHUNK_BYTES):
            for row in zip(*(part.column(c).to_pylist() for c in ("tiles", "own", "second", "node", "label", "text")), strict=True):
                if held and held[0][0] != row[0]:
                    yield links()
                    held = []
                held.append(row)
        if held:
            yield links()

    return run


def _rest_links(shared: DataFrame, labels: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """All links that are left between different labels of one bucket of more than BLOCK_NODES nodes.

    The largest label of a bucket isn't compared with itself, so its nodes are copied once for each tile of the others.
    Similar nodes' total weights differ by a factor of similarity at most, so their levels by one at most.
    """
    named = _named(shared.where(F.col("n") > BLOCK_NODES).select("bucket", "node", "weight"), labels)
    sizes = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "top")
    width = 1e-6 - 1.001 * math.log(min(1.0, max(similarity, 1e-6)))
    rows = scratch(named.join(top, "bucket").select("bucket", "node", "label", (F.col("label") == F.col("top")).alias("main"), F.floor(F.log(F.col("weight")) / width).alias("level")), "rest")
    groups = rows.groupBy("bucket", "main", "level").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).alias("salts"))
    a = groups.where("NOT main").select("bucket", F.col("level").alias("level_1"), F.col("salts").alias("salts_1"))
    b = groups.select("bucket", F.col("main").alias("main_2"), F.col("level").alias("level_2"), F.col("salts").alias("salts_2"))
    apart = F.col("level_2") - F.col("level_1")
    both = scratch(a.join(b, "bucket").where((F.abs(apart) <= 1) & (F.col("main_2") | (apart >= 0))).withColumn("same", ~F.col("main_2") & (apart == 0)), "tiles")
    salt = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    # a tile meets itself and the later tiles of its own group, and all tiles of another group
    first = rows.where("NOT main").withColumnRenamed("level", "level_1").join(both, ["bucket", "level_1"]).withColumn("salt_1", salt("salts_1"))
    first = first.withColumn("salt_2", F.explode(F.sequence(F.when(F.col("same"), F.col("salt_1")).otherwise(F.lit(0)), F.col("salts_2") - 1)))
    second = rows.withColumnsRenamed({"main": "main_2", "level": "level_2"}).join(both, ["bucket", "main_2", "level_2"]).withColumn("salt_2", salt("salts_2"))
    until = F.when(F.col("same"), F.col("salt_2")).otherwise(F.col("salts_1")) - 1
    second = second.withColumn("salt_1", F.explode(F.when(until >= 0, F.sequence(F.lit(0).cast("long"), until))))
    tiles = F.concat_ws(" ", "bucket", "main_2", "level_1", "level_2", "salt_1", "salt_2").alias("tiles")
    own = (F.col("same") & (F.col("salt_1") == F.col("salt_2"))).alias("own")
    met = first.select(tiles, own, F.lit(False).alias("second"), "node", "label").union(second.select(tiles, own, F.lit(True).alias("second"), "node", "label"))
    return _compared(met, texts, weights, similarity)


def _compared(met: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """Links of groups of rows. met: tiles (the group), own, second, node, label."""
    dealt = met.join(texts, "node").repartition("tiles").sortWithinPartitions("tiles")
    return scratch(dealt.select("tiles", "own", "second", "node", "label", "text").mapInArrow(_tile_links(weights, similarity), "u long, v long"), "verified")


def _named(shared: DataFrame, labels: DataFrame) -> DataFrame:
    return shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _block_links(shared: DataFrame, labels: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """Links between different labels in the blocks of each bucket that holds more than one label."""
    named = _named(shared, labels)
    split = named.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("bucket")
    left = scratch(named.join(split, "bucket", "left_semi").select("bucket", "n", "beside", "node", "label"), "blocks")
    often = left.where(F.col("n") > BLOCK_NODES).groupBy("bucket", "beside").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK_NODES)
    placed = left.join(often, ["bucket", "beside"], "left")
    by_value = F.pmod(F.xxhash64("beside"), F.ceil(F.col("n") / BLOCK_NODES))
    by_node = F.xxhash64("beside", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK_NODES)))
    block = F.when(F.col("n") <= BLOCK_NODES, F.lit(0)).when(F.col("m").isNull(), by_value).otherwise(by_node)
    met = placed.select(F.concat_ws(" ", "bucket", block).alias("tiles"), F.lit(True).alias("own"), F.lit(False).alias("second"), "node", "label")
    return _compared(met, texts, weights, similarity)


def near_labels(signed: DataFrame, text, weights: Weights, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(uid, node) of all rows and (node, label) of nodes with links. signed: written rows of _signatures with text_key."""
    nodes = signed.groupBy("text_key").agg(F.min("uid").alias("node"))
    members = scratch(signed.select("uid", "text_key").join(nodes, "text_key").select("uid", "node"), "members")
    first = members.where("uid = node").select("node")
    texts = signed.select(F.col("uid").alias("node"), text.alias("text"))
    own = signed.select(F.col("uid").alias("node"), "buckets", "weight").join(first, "node", "left_semi")
    entries = own.select("node", "buckets", "weight", F.posexplode("buckets").alias("band", "bucket")).select("node", "bucket", "weight", F.get("buckets", (F.col("band") + 1) % BANDS).alias("beside"))
    counts = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch(entries.join(counts, "bucket"), "buckets")
    # the texts of nodes that share a bucket; both sides are shuffled at any size
    texts = scratch(texts.hint("merge").join(shared.select("node").distinct(), "node", "left_semi"), "texts")
    degrees = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    centres = shared.select("bucket", "node").join(degrees, "node").groupBy("bucket").agg(F.max(F.struct("degree", F.col("node").alias("v")))["v"].alias("v"))
    pairs = shared.select("bucket", F.col("node").alias("u")).join(centres, "bucket").where("u <> v").select("u", "v").distinct()
    labels = scratch(components(_links(pairs, texts, weights, similarity)), "labels")
    joined = lambda more: scratch(components(more.union(labels.select(F.col("node").alias("u"), F.col("label").alias("v")))), "labels")
    more = _block_links(shared, labels, texts, weights, similarity)
    labels = labels if more.isEmpty() else joined(more)
    if shared.where(F.col("n") > BLOCK_NODES).isEmpty():
        return members, labels
    more = _rest_links(shared, labels, texts, weights, similarity)
    return members, labels if more.isEmpty() else joined(more)


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, rows: bool) -> DataFrame:
    """uid, doc_id, class_id, class_size, kept and, if asked for, the row."""
    on_workers(docs.sparkSession)
    weights = corpus_weights(docs, text_col)
    text = F.col(f"`{text_col}`")
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_key"), *([row_struct(docs, "row")] if rows else []))
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType())), T.StructField("weight", T.LongType()), *given.schema.fields])
    signed = given.mapInArrow(_signatures(weights), schema)
    signed = scratch(signed.drop("text") if rows else signed, "signed")
    body = F.col("row").getField(text_col) if rows else F.col("text")
    members, labels = near_labels(signed, body, weights, similarity)
    named = members.join(labels, "node", "left").select("uid", F.coalesce("label", "node").alias("label"))
    named = scratch(signed.select("uid", "doc_id").join(named, "uid"), "named")
    # written, so that the join below has plain shuffles on both sides and a large class is split
    best = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("class_size"))
    best = scratch(best, "classes")
    out = named.join(best, "label").select("uid", "doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("best.uid")).alias("kept"))
    return signed.select("uid", "row").join(out.where("kept").select("uid"), "uid", "left_semi") if rows else out


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size, kept for each row of docs."""
    return _classes(docs, id_col, text_col, similarity, rows=False).select("doc_id", "class_id", "class_size", "kept")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class; all columns as they were."""
    return _classes(docs, id_col, text_col, similarity, rows=True).select("row.*")
