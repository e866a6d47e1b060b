"""Exact dedup by Patricia-trie owners.

Two levels. A task of the scan gathers rows to chunks of bounded size and puts each chunk's texts into a
compressed radix trie; one row for each different text of the chunk leaves it, so that a text which a third
of all rows hold is sent once a chunk. The owner partitions, dealt by length and content hash, insert the
full byte strings of these rows into their tries, whose terminal nodes keep the smallest identifier, the
number of rows and the chunks' representatives. An owner whose trie outgrows its budget spills its largest
subtree to a file and later works through each such file on its own.

Defined results: a null text counts as empty; a null identifier sorts after all others; of rows that repeat
an identifier and a text exactly one is kept; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustloom.llm.common import chunks, on_workers, row_struct, scratch

CHUNK_BYTES = 8 << 20
TRIE_BYTES = 64 << 20
SPACES = b" \t\n\x0b\x0c\r"


def normalised(text: bytes | None) -> bytes:
    """Each run of white space becomes one space."""
    if not text:
        return b""
    out = b" ".join(text.split())
    if not out:
        return b" "
    return b" " * (text[0] in SPACES) + out + b" " * (text[-1] in SPACES)


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: slices are compared in C."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    __slots__ = ("end", "file", "kids", "label")

    def __init__(self, label: bytes):
        self.label, self.kids, self.end, self.file = label, None, None, None


class Trie:
    """A compressed radix trie of byte strings; spill_bytes bounds what it holds in memory."""

    def __init__(self, spill_bytes: int = TRIE_BYTES, folder: str | None = None):
        self.root, self.held, self.most, self.folder, self.spilled = Node(b""), 0, spill_bytes, folder, []

    def insert(self, key: bytes, value) -> Node | None:
        """The terminal node of key, or None if its subtree has been spilled (value then goes to the file)."""
        node, at, size = self.root, 0, len(key)
        while True:
            if node.file is not None:
                pickle.dump((key, value), node.file, pickle.HIGHEST_PROTOCOL)
                return None
            if at == size:
                return node
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                kid = Node(key[at:])
                if node.kids is None:
                    node.kids = {}
                node.kids[key[at]] = kid
                self.held += size - at + 200
                return kid
            label = kid.label
            if not key.startswith(label, at):
                n = shared_prefix(label, key[at : at + len(label)])
                middle = Node(label[:n])
                kid.label = label[n:]
                middle.kids = {label[n]: kid}
                node.kids[label[0]] = middle
                self.held += 200
                kid = middle
            at += len(kid.label)
            node = kid

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.end is not None:
                yield prefix, node.end
            for kid in (node.kids or {}).values():
                stack.append((kid, prefix))

    def weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + 200
            stack.extend((x.kids or {}).values())
        return total

    def spill(self) -> None:
        """Writes the heaviest subtree below the first branching to a file, while too much is held.

        What can't be cut further, such as one text above the budget, doubles it, so that it isn't weighed at each insert.
        """
        while self.held > self.most:
            node, prefix = self.root, b""
            live = [x for x in (node.kids or {}).values() if x.file is None]
            while len(node.kids or ()) == 1 and node.end is None and live and live[0].kids:
                node = live[0]
                prefix += node.label
                live = [x for x in node.kids.values() if x.file is None]
            kid = max(live, key=self.weight, default=None)
            if kid is None or kid.kids is None:
                self.most = 2 * self.held
                return
            freed = self.weight(kid)
            kid.file = tempfile.TemporaryFile(dir=self.folder)
            for key, value in self.terminals(kid, prefix):
                pickle.dump((key, value), kid.file, pickle.HIGHEST_PROTOCOL)
            kid.kids = kid.end = None
            self.held -= freed
            self.spilled.append(kid.file)


def owned(entries: Iterator[tuple[bytes, tuple]], spill_bytes: int) -> Iterator[tuple]:
    """The terminals of a trie of all entries; spilled subtrees follow one after the other."""
    trie = Trie(spill_bytes)
    for key, value in entries:
        node = trie.insert(key, value)
        if node is not None:
            if node.end is None:
                node.end = ([value[0]], [value[1]], list(value[2]))
            else:
                node.end[0][0] = min(node.end[0][0], value[0])
                node.end[1][0] += value[1]
                node.end[2].extend(value[2])
                trie.held += 8 * len(value[2])
            if trie.held > trie.most:
                trie.spill()
    for _, (best, count, reps) in trie.terminals():
        yield best[0], count[0], reps
    files, trie.root = trie.spilled, Node(b"")
    for file in files:
        yield from owned(_reread(file), spill_bytes)
        file.close()


def _reread(file) -> Iterator[tuple[bytes, tuple]]:
    file.seek(0)
    while True:
        try:
            key, value = pickle.load(file)
        except EOFError:
            return
        if isinstance(value[0], list):
            value = (value[0][0], value[1][0], value[2])
        yield key, value


def _chunk_owners(most_bytes: int):
    def run(batches):
        task, n = TaskContext.get().partitionId() << 33, 0
        for part in chunks(batches, most_bytes):
            trie, keys, members = Trie(1 << 62), [], []
            ids = part.column("id").to_pylist()
            for row, (ident, text) in enumerate(zip(ids, part.column("body").to_pylist(), strict=True)):
                key = normalised(text)
                node = trie.insert(key, None)
                if node.end is None:
                    node.end = len(keys)
                    keys.append(key)
                    members.append([])
                members[node.end].append((ident is None, ident or 0, row))
            firsts = []
            for own in members:
                own.sort()
                firsts.append(own[0][2])
            digests = [hashlib.sha256(x).digest() for x in keys]
            cols = {
                "uid": pa.array(range(task + n, task + n + len(keys)), pa.int64()),
                "n_bytes": pa.array([len(x) for x in keys], pa.int64()),
                "content_hash": pa.array([int.from_bytes(x[:8], "little", signed=True) for x in digests], pa.int64()),
                "digest": pa.array([x.hex() for x in digests], pa.string()),
                "members": pa.array([[None if x[0] else x[1] for x in own] for own in members], pa.list_(pa.int64())),
            }
            n += len(keys)
            if "row" in part.column_names:
                cols["row"] = part.column("row").take(pa.array(firsts, pa.int64())).combine_chunks()
            else:
                cols["body"] = pa.array(keys, pa.binary())
            for name, col in cols.items():
                if isinstance(col, pa.ChunkedArray):
                    cols[name] = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def _owners(spill_bytes: int):
    def run(batches):
        def entries():
            for part in chunks(batches, CHUNK_BYTES):
                cols = [part.column(c).to_pylist() for c in ("uid", "first", "n_rows", "body")]
                for uid, first, n_rows, text in zip(*cols, strict=True):
                    yield normalised(text), ((first is None, first or 0, uid), n_rows, [uid])

        out: list[tuple] = []
        for (no_id, ident, keep), size, reps in owned(entries(), spill_bytes):
            out.extend((uid, None if no_id else ident, keep, size) for uid in reps)
            if len(out) > 50_000:
                yield _owner_batch(out)
                out = []
        if out:
            yield _owner_batch(out)

    return run


def _owner_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["uid", "keep_id", "keep_uid", "group_size"])


def representatives(docs: DataFrame, id_col: str, text_col: str, rows: bool, chunk_bytes: int = CHUNK_BYTES, spill_bytes: int = TRIE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(a row for each different text of a chunk with its members, owners' verdict on each such row)."""
    spark = docs.sparkSession
    on_workers(spark)
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("body"), *([row_struct(docs, "row")] if rows else []))
    schema = T.StructType().add("uid", "long").add("n_bytes", "long").add("content_hash", "long").add("digest", "string").add("members", T.ArrayType(T.LongType()))
    schema = schema.add(given.schema["row"]) if rows else schema.add("body", "binary")
    reps = scratch(given.mapInArrow(_chunk_owners(chunk_bytes), schema), "exact")
    body = F.col("row").getField(text_col).cast("binary") if rows else F.col("body")
    sent = reps.select("uid", F.col("members")[0].alias("first"), F.size("members").cast("long").alias("n_rows"), "n_bytes", "content_hash", body.alias("body"))
    owners = sent.repartition("n_bytes", "content_hash").drop("n_bytes", "content_hash").mapInArrow(_owners(spill_bytes), "uid long, keep_id long, keep_uid long, group_size long")
    return reps, owners


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    reps, owners = representatives(docs, id_col, text_col, rows=False, **sizes)
    joined = reps.select("uid", "digest", "members").join(owners, "uid")
    return joined.select("uid", "keep_uid", "keep_id", "group_size", "digest", F.posexplode("members").alias("nth", "doc_id")).select(
        "doc_id", "keep_id", "group_size", ((F.col("uid") == F.col("keep_uid")) & (F.col("nth") == 0)).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """docs with one row for each different text; all columns as they were."""
    reps, owners = representatives(docs, id_col, text_col, rows=True, **sizes)
    kept = owners.where("uid = keep_uid").select("uid")
    return reps.select("uid", "row").join(kept, "uid", "left_semi").select("row.*")
