"""Ranked lexical search of all documents for a set of items, exact, by dual trees.

Documents are read once a block of items: terms are cut from bytes, and of each document only the counts of terms that
an item asks for are written. Blocks of BLOCK_TERMS terms of items bound what is sent to workers, so the number of
passes grows with the items and memory doesn't (an item with more terms than that is a block of its own). Numbers of
documents and frequencies come from one pass over what was written.

Every task arranges its documents in batches as a hierarchy (by their most frequent asked-for term and length: leaves of LEAF documents,
FAN nodes in each node above), the driver arranges the items (by their most common terms) as another. A node of documents holds
for each term the largest value that any document below has, a node of items the largest count; the product of the two
bounds every score below the pair. A pair is dropped when its bound is under the weakest kth score of the items below, else both nodes are
opened; pairs of a leaf and an item are scored in integers. kth scores begin at those among every SEED-th document,
which are lower bounds whatever the sample, and rise with what a task finds, so no result is lost. A task returns k rows an item at most.

Defined results: null and empty texts have no terms; an item without terms, or whose terms no document has, has no rows; rows
that repeat an item_id are items of their own, rows that repeat a doc_id are documents of their own; a null doc_id comes
after others of its score. Other columns play no part. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustloom.llm.common import chunks, on_workers, scratch

#: Bytes that end a term become spaces, A to Z become a to z.
_AS_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BLOCK_TERMS = 1 << 18
BATCH, LEAF, FAN, SEED = 2048, 32, 8, 16
CHUNK_BYTES = 8 << 20


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_AS_TERMS).split()


class Items(NamedTuple):
    """Levels of items from the leaves up: for each the nodes' bounds in terms, terms, counts; node i's items are those below i at the leaves."""

    uids: list[int]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    vocabulary: dict[bytes, int]


def arranged(items: list[tuple[int, list[bytes]]]) -> Items:
    """The hierarchy over items (uid, terms), neighbours sharing their most common terms."""
    asked = Counter(t for _, own in items for t in set(own))
    vocabulary = {t: i for i, (t, _) in enumerate(sorted(asked.items(), key=lambda x: (-x[1], x[0])))}
    counted = [(uid, Counter(vocabulary[t] for t in own)) for uid, own in items if own]
    counted.sort(key=lambda x: (sorted(x[1])[:8], x[0]))
    nodes, levels = [c for _, c in counted], []
    while nodes:
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in nodes])]).astype(np.int64)
        terms = np.array([t for c in nodes for t in sorted(c)], dtype=np.int64)
        levels.append((bounds, terms, np.array([c[t] for c in nodes for t in sorted(c)], dtype=np.int64)))
        if len(nodes) == 1:
            break
        merged = []
        for at in range(0, len(nodes), FAN):
            most: dict[int, int] = {}
            for c in nodes[at : at + FAN]:
                for t, n in c.items():
                    most[t] = max(most.get(t, 0), n)
            merged.append(most)
        nodes = merged
    return Items([uid for uid, _ in counted], levels, vocabulary)


def _counted(vocabulary: dict[bytes, int]):
    """Documents (doc_id, text) to doc_id, n of all terms, and ids and counts of asked-for terms."""

    def count(batches):
        absent, get = len(vocabulary), vocabulary.get
        for table in chunks(batches, CHUNK_BYTES):
            numbers, sizes, ids, tfs = [], [0], [], []
            for raw in table.column("text").cast(pa.binary()).to_pylist():
                own = terms_of(raw or b"")
                found = np.fromiter(map(get, own, itertools.repeat(absent)), dtype=np.int64, count=len(own))
                if absent < 16 * len(own):
                    tf = np.bincount(found, minlength=absent + 1)[:absent]
                    hit = np.flatnonzero(tf)
                    tf = tf[hit]
                else:
                    hit, tf = np.unique(found[found < absent], return_counts=True)
                numbers.append(len(own))
                sizes.append(sizes[-1] + len(hit))
                ids.append(hit)
                tfs.append(tf)
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(x or [np.zeros(0)]).astype(np.int32))) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(numbers, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    return count


def _statistics(size: int):
    """For each asked-for term the documents that hold it; under -1 the documents with terms, under -2 all terms."""

    def total(batches):
        held, documents, length = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            documents, length = documents + int((n > 0).sum()), length + int(n.sum())
            held += np.bincount(batch.column("ids").flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[documents, length], held[at]]))], names=["term", "n"])

    return total


class _Search:
    """One task's search: its k best of each item so far, and the weakest of them."""

    def __init__(self, items: Items, weights: np.ndarray, documents: int, length: int, k: int, least: np.ndarray):
        self.items, self.weights, self.documents, self.length, self.k = items, weights, documents, length, k
        self.weakest = least.copy()
        self.best: list[list[tuple]] = [[] for _ in items.uids]
        self.pairs = self.scored = 0

    def values(self, n: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        product = 25 * n.astype(object) * self.documents if int(n.max(initial=0)) * self.documents > 1 << 58 else 25 * n * self.documents
        m = (75 + product // max(self.length, 1)).astype(np.int64)
        return self.weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * np.repeat(m, sizes)))

    def bounds(self, level: int, nodes: np.ndarray, row: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Of each of the item nodes against rows of values (one or more), by local numbers of terms."""
        at, terms, counts = self.items.levels[level]
        starts, ends = at[nodes], at[nodes + 1]
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        picked = np.arange(sizes.sum()) + np.repeat(starts - first, sizes)
        return np.add.reduceat(row[..., local[terms[picked]]] * counts[picked], first, axis=-1)

    def weakest_of(self, level: int) -> np.ndarray:
        w = self.weakest
        for _ in range(level):
            w = np.minimum.reduceat(w, np.arange(0, len(w), FAN))
        return w

    def batch(self, doc_ids: list, n: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray) -> None:
        """Searches one batch: documents with sizes terms each, ids and counts of them one after the other."""
        have = np.flatnonzero(sizes)
        if not len(have) or not self.items.uids:
            return
        values, starts = self.values(n, sizes, ids, tfs), np.cumsum(sizes) - sizes
        often = np.array([ids[s : s + z][np.argmax(tfs[s : s + z])] for s, z in zip(starts[have], sizes[have], strict=True)])
        order = have[np.lexsort((n[have], often))]
        kept, local = np.unique(ids, return_inverse=True)
        of = np.full(len(self.items.vocabulary), len(kept), dtype=np.int64)
        of[kept] = np.arange(len(kept))
        # hierarchy of maxima; the last column is for terms that the batch doesn't have
        picked = np.repeat(starts[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(sizes[order].sum())
        place = np.repeat(np.arange(len(order)), sizes[order])
        leaves = -(-len(order) // LEAF)
        levels = [np.zeros((leaves, len(kept) + 1), dtype=np.int64)]
        np.maximum.at(levels[0], (place // LEAF, local[picked]), values[picked])
        while len(levels[-1]) > 1:
            levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
        top = len(self.items.levels) - 1
        open_ = [(len(levels) - 1, 0, top, np.arange(len(self.items.levels[top][0]) - 1))]
        while open_:
            level, node, item_level, nodes = open_.pop()
            bound = self.bounds(item_level, nodes, levels[level][node], of)
            self.pairs += len(nodes)
            nodes = nodes[(bound > 0) & (bound >= self.weakest_of(item_level)[nodes])]
            if not len(nodes):
                continue
            if level == 0 and item_level == 0:
                self.leaf(node, nodes, order, doc_ids, place, local[picked], values[picked], len(kept), of)
                continue
            if item_level:
                width = len(self.items.levels[item_level - 1][0]) - 1
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < width]
            below = [node] if level == 0 else range(node * FAN, min((node + 1) * FAN, len(levels[level - 1])))
            open_ += [(max(level - 1, 0), b, max(item_level - 1, 0), nodes) for b in below]

    def leaf(self, node, items, order, doc_ids, place, local, values, width, of) -> None:
        first, last = np.searchsorted(place, (node * LEAF, (node + 1) * LEAF))
        count = min(LEAF, len(order) - node * LEAF)
        rows = np.zeros((count, width + 1), dtype=np.int64)
        rows[place[first:last] - node * LEAF, local[first:last]] = values[first:last]
        scores = self.bounds(0, items, rows, of)
        self.scored += scores.size
        for j, item in enumerate(items.tolist()):
            column = scores[:, j]
            hits = np.flatnonzero((column > 0) & (column >= self.weakest[item]))
            if not len(hits):
                continue
            found = self.best[item]
            found += [(-int(column[i]), doc_ids[order[node * LEAF + i]]) for i in hits.tolist()]
            found.sort(key=lambda x: (x[0], x[1] is None, x[1]))
            del found[self.k :]
            if len(found) == self.k:
                self.weakest[item] = max(self.weakest[item], -found[-1][0])


def _searched(items: Items, weights: np.ndarray, documents: int, length: int, k: int, least: np.ndarray, kind):
    """Written documents to the best k of each item that a task holds: uid, doc_id, score."""

    def search(batches):
        own = _Search(items, weights, documents, length, k, least)
        for table in chunks(batches, CHUNK_BYTES):
            for at in range(0, table.num_rows, BATCH):
                part = table.slice(at, BATCH).combine_chunks()
                lists = part.column("ids").combine_chunks()
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                ids, tfs = (part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "tfs"))
                own.batch(part.column("doc_id").to_pylist(), part.column("n").to_numpy(), sizes, ids, tfs)
        rows = [(uid, doc, -score) for uid, found in zip(items.uids, own.best, strict=True) for score, doc in found]
        uids, docs, scores = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(docs, kind), pa.array(scores, pa.int64())], names=["uid", "doc_id", "score"])

    return search


def _first_k(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search_block(texts: DataFrame, block: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    items = arranged(block)
    kind = texts.schema["doc_id"].dataType
    documents = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    docs = scratch(texts.mapInArrow(_counted(items.vocabulary), documents), "terms")
    size = len(items.vocabulary)
    got = {r["term"]: r["n"] for r in docs.select("n", "ids").mapInArrow(_statistics(size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total, length = got.get(-1, 0), got.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * got.get(i, 0) + 1))) for i in range(size)], dtype=np.int64)
    out = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    arrow = pa.schema(texts.select("doc_id").limit(0).toArrow().schema).field(0).type

    def search(rows: DataFrame, least: np.ndarray) -> DataFrame:
        return rows.mapInArrow(_searched(items, weights, total, length, k, least, arrow), out)

    none = np.zeros(len(items.uids), dtype=np.int64)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED)) == 0)
    seeds = _first_k(search(sample, none), k).where(F.col("rank") == k).select("uid", "score")
    known = {r["uid"]: r["score"] for r in seeds.collect()}
    return _first_k(search(docs, np.array([known.get(u, 0) for u in items.uids], dtype=np.int64)), k)


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank from 1, doc_id, score: the k best documents with a score above 0 of each row of items."""
    spark = docs.sparkSession
    on_workers(spark)
    asked = items.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("binary").alias("raw"))
    asked = scratch(asked, "items")
    size = asked.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * BLOCK_TERMS)))  # a term and its end are two bytes or more
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).select("uid", "raw").collect()
        found.append(_search_block(texts, [(r["uid"], terms_of(bytes(r["raw"] or b""))) for r in own], k))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    return best.join(asked.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")
