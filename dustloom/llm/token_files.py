"""Token identifiers in files of rANS blocks.

Texts are tokenised where they are read; each task also counts its identifiers, and the summed counts of all
documents become the one frequency table that every block shares. Documents are then dealt by ranges of
doc_id and written, in order, as blocks of whole documents. A block is encoded by a static range asymmetric
numeral system over interleaved lanes; it holds its documents' lengths, checkpoints (lane states and word
positions) from which parts of it can be decoded alone, and checksums of its words and its identifiers.
The files' container is Parquet, so that Spark's own writers and readers commit and find them in any store.

Block, little-endian: magic "DLR1", u8 table bits, u8 unused, u16 lanes, u32 identifiers, u32 documents,
u32 checkpoints, u32 words, u32 CRC of the identifiers as u32, u32 CRC of all that follows; then u32 length
for each document, then for each checkpoint u32 step, u32 word position and a u64 state a lane, then the words (u32).

Defined results: a null text is an empty one; each document ends with END_ID, so none is empty; null
identifiers come last; rows that repeat an identifier lie in the order of their tokens' bytes; tables without
rows give files without blocks.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustloom.llm.common import chunks, on_workers, scratch, shared_dir

MAGIC = b"DLR1"
HEADER = struct.Struct("<4sBBHIIIIII")
END_ID = 0
BLOCK_TOKENS = 1 << 18
CHECKPOINT_TOKENS = 1 << 17
MOST_LANES = 1024
LOW = np.uint64(1 << 31)
#: Words whose identifiers a Python worker keeps.
CACHE_WORDS = 1_600_000


class WordEncoder:
    """Encodes texts by a byte-level BPE file of the tokenizers library.

    Its pre-tokenizer never joins a character with a following space that a non-space follows, so texts are
    cut there and the cut words' identifiers are kept. Every word is encoded by the library itself. The text of a
    token that the file adds, such as <|endoftext|>, gives that token as in the library's plain call; as it ends the
    text before it for the pre-tokenizer, a word that begins with one is not cut from what precedes it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = "I" if self.wide else "H"
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.kept: dict[str, bytes] = {}
        # a byte-level identifier whose text begins with a space; " word" has exactly one, its first
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.opens[[i for x, i in self.tokenizer.get_vocab().items() if x.startswith("\u0120")]] = True

    def _encode_spaced(self, words: list[str]) -> Iterator[bytes]:
        """Each word with the space before it, many in one call; words hold no space themselves."""
        size = self.dtype.itemsize
        for at in range(0, len(words), 8000):
            part = words[at : at + 8000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            data, begin = ids.tobytes(), 0
            for end in (np.append(np.flatnonzero(self.opens[ids])[1:], len(ids)) * size).tolist():
                yield data[begin:end]
                begin = end

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 4096):
            for e in self.tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False):
                yield array(self.kind, e.ids).tobytes()

    def _merged(self, text: str, odd: set[str]) -> list[str]:
        """The words of a text, an odd one joined to what precedes it."""
        out: list[str] = []
        for word in text.split(" "):
            if out and word in odd:
                out[-1] += " " + word
            else:
                out.append(word)
        return out

    def encode_all(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers of all texts, each with end_id behind it; how many each text has). texts: no nulls, at least one.

        The split words are numbered by Arrow, so that Python sees each different word of the texts once.
        """
        split = pc.split_pattern(texts, " ")
        first = np.asarray(split.offsets, dtype=np.int64)
        first -= first[0]
        numbered = split.flatten().dictionary_encode()
        at, own = np.array(numbered.indices, dtype=np.int64), numbered.dictionary.to_pylist()
        table, n = self.kept, len(texts)
        missing = [w for w in own if w not in table]
        odd = {w for w in missing if not w or w[0].isspace() or w.startswith(self.added)}
        plain = [w for w in missing if w not in odd]
        table.update(zip(plain, self._encode_spaced(plain), strict=True))
        begins, later = first[:-1], np.ones(len(at), dtype=bool)
        later[begins] = False
        heads = [own[i] for i in at[begins].tolist()]
        whole: dict[int, list[str]] = {}
        if odd:
            is_odd = np.fromiter(map(odd.__contains__, own), bool, len(own))
            for i in np.unique(np.searchsorted(first, np.flatnonzero(is_odd[at] & later), side="right") - 1).tolist():
                whole[i] = self._merged(texts[i].as_py(), odd)
                heads[i] = whole[i][0]
        joined = list({w for words in whole.values() for w in words[1:] if " " in w})
        spaced = dict(zip(joined, self._encode([" " + w for w in joined]), strict=True))
        end = array(self.kind, [end_id]).tobytes()
        # entries: the words, then a head for each text, which holds the end of the text before it, then nothing
        entries = [table.get(w, b"") for w in own]
        for i, head in enumerate(self._encode(heads)):
            body = (spaced.get(w) or table[w] for w in whole[i][1:]) if i in whole else ()
            entries.append((end if i else b"") + head + b"".join(body))
        entries.append(b"")
        at[begins] = len(own) + np.arange(n)
        for i in whole:
            at[first[i] + 1 : first[i + 1]] = len(entries) - 1
        size = np.fromiter(map(len, entries), np.int64, len(entries)) // self.dtype.itemsize
        data = np.frombuffer(b"".join(entries), self.dtype)
        begin, width = (np.cumsum(size) - size)[at], size[at]
        upto = np.cumsum(width)
        out = np.append(data[np.arange(int(upto[-1])) + np.repeat(begin - (upto - width), width)], self.dtype.type(end_id))
        ends = upto[first[1:] - 1] + 1
        if len(table) > CACHE_WORDS:
            for word in plain:
                del table[word]
        return out, np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's identifiers."""
        ids, sizes = self.encode_all(pa.array(texts, pa.string()), END_ID)
        return [x[:-1].tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _tokenise(path: str):
    def run(batches):
        words, counts = encoder(path), np.zeros(0, dtype=np.int64)
        for part in chunks(batches, 4 << 20):
            texts = part.column("text").combine_chunks().fill_null("")
            ids, sizes = words.encode_all(texts, END_ID)
            seen = np.bincount(ids)
            if len(seen) > len(counts):
                counts = np.pad(counts, (0, len(seen) - len(counts)))
            counts[: len(seen)] += seen
            places = np.concatenate([[0], np.cumsum(sizes)]) * words.dtype.itemsize
            tokens = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), tokens, pa.nulls(len(sizes), pa.list_(pa.int64()))], names=["doc_id", "tokens", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([counts.tolist()], pa.list_(pa.int64()))], names=["doc_id", "tokens", "counts"])

    return run


class Table:
    """The frequency table: counts brought to a sum of 2**bits, each present identifier at least 1."""

    def __init__(self, counts: np.ndarray):
        present = np.flatnonzero(counts)
        self.bits = max(14, int(len(present)).bit_length() + 2)
        total, room = max(1, int(counts.sum())), 1 << self.bits
        freq = np.zeros(max(1, len(counts)), dtype=np.int64)
        freq[present] = np.maximum(1, (counts[present].astype(np.float64) * room / total).astype(np.int64))
        over = int(freq.sum()) - room
        order = present[np.argsort(-freq[present], kind="stable")]
        for s in order if over > 0 else order[:1]:
            step = min(over, int(freq[s]) - 1)
            freq[s] -= step
            over -= step
            if over <= 0:
                break
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lengths: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(MOST_LANES, n >> 6))
        steps = -(-n // lanes)
        every = max(1, CHECKPOINT_TOKENS // lanes)
        state = np.full(lanes, LOW, dtype=np.uint64)
        bits, shift = np.uint64(self.bits), np.uint64(63 - self.bits)
        groups, marks, written = [], [], 0
        for step in range(steps - 1, -1, -1):
            part = ids[step * lanes : (step + 1) * lanes]
            x = state[: len(part)]
            f = self.freq[part]
            full = np.flatnonzero(x >= f << shift)
            if len(full):
                groups.append(x[full].astype(np.uint32))
                x[full] >>= np.uint64(32)
                written += len(full)
            q = x // f
            state[: len(part)] = (q << bits) + (x - q * f) + self.start[part]
            if step % every == 0:
                marks.append((step, written, state.astype("<u8").tobytes()))
        words = np.concatenate(groups[::-1]).astype("<u4").tobytes() if groups else b""
        marks = b"".join(struct.pack("<II", step, written - at) + states for step, at, states in reversed(marks))
        body = lengths.astype("<u4").tobytes() + marks + words
        return HEADER.pack(MAGIC, self.bits, 0, lanes, n, len(lengths), -(-steps // every), written, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers from checkpoint first up to checkpoint last, lengths of the block's documents)."""
        magic, bits, _, lanes, n, docs, n_marks, n_words, ids_crc, body_crc = HEADER.unpack_from(block)
        body = memoryview(block)[HEADER.size :]
        if magic != MAGIC or bits != self.bits or zlib.crc32(body) != body_crc:
            raise ValueError("damaged block")
        lengths = np.frombuffer(body, "<u4", docs)
        size = 8 + 8 * lanes
        words = np.frombuffer(body, "<u4", n_words, 4 * docs + n_marks * size)
        steps = -(-n // lanes) if n else 0
        every = -(-steps // n_marks) if n_marks else 1
        mark = 4 * docs + first * size
        step, at = struct.unpack_from("<II", body, mark) if n_marks else (0, 0)
        state = np.frombuffer(body, "<u8", lanes, mark + 8).astype(np.uint64) if n_marks else None
        stop = steps if last is None or last >= n_marks else struct.unpack_from("<I", body, 4 * docs + last * size)[0]
        out = np.empty((min(n, stop * lanes) - step * lanes) if n else 0, dtype=np.uint32)
        base, mask, shift, low = step * lanes, np.uint64((1 << self.bits) - 1), np.uint64(self.bits), LOW
        for k in range(step, stop):
            wide = min(lanes, n - k * lanes)
            x = state[:wide]
            slot = x & mask
            s = self.symbol[slot]
            out[k * lanes - base : k * lanes - base + wide] = s
            x = self.freq[s] * (x >> shift) + slot - self.start[s]
            dry = np.flatnonzero(x < low)
            if len(dry):
                x[dry] = (x[dry] << np.uint64(32)) | words[at : at + len(dry)]
                at += len(dry)
            state[:wide] = x
        if first == 0 and stop == steps and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("damaged block")
        return out, lengths


def _encode_blocks(table: Table, kind: str):
    def run(batches):
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def flush():
            data = np.frombuffer(b"".join(x for _, x in held), dtype=kind)
            lengths = np.array([len(x) // data.itemsize for _, x in held], dtype=np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([[x for x, _ in held]], pa.list_(pa.int64())), pa.array([table.encode(data, lengths)], pa.binary())],
                names=["shard", "block", "start_in_shard", "n_tokens", "doc_ids", "payload"],
            )

        item = np.dtype(kind).itemsize
        for part in chunks(batches, 8 << 20):
            for ident, tokens in zip(part.column("doc_id").to_pylist(), part.column("tokens").to_pylist(), strict=True):
                held.append((ident, tokens))
                size += len(tokens) // item
                if size >= BLOCK_TOKENS:
                    yield flush()
                    held, block, start, size = [], block + 1, start + size, 0
        if held:
            yield flush()

    return run


def _decode_blocks(table: Table, full: bool):
    def run(batches):
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * full
        for batch in batches:
            for first, idents, payload in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_ids", "payload")), strict=True):
                ids, lengths = table.decode(payload)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                parts = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(idents, pa.int64()), pa.array(first + starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64())]
                if full:
                    cols.append(pa.array([x.tolist() for x in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes path/table (identifier, count) and path/blocks."""
    spark = docs.sparkSession
    on_workers(spark)
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    tokens = scratch(given.mapInArrow(_tokenise(vocabulary), "doc_id long, tokens binary, counts array<long>"), "tokens")
    counted = tokens.where("counts IS NOT NULL").select(F.posexplode("counts").alias("id", "n")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    counted.coalesce(1).write.parquet(f"{path}/table")  # as many rows as the vocabulary at most
    kind = encoder(vocabulary).dtype.str
    ordered = tokens.where("tokens IS NOT NULL").select("doc_id", "tokens").repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "tokens")
    blocks = ordered.mapInArrow(_encode_blocks(read_table(spark, path), kind), "shard int, block int, start_in_shard long, n_tokens long, doc_ids array<long>, payload binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> Table:
    rows = spark.read.schema("id int, n long").parquet(f"{path}/table").collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, dtype=np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return Table(counts)


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document in the files."""
    on_workers(spark)
    blocks = spark.read.schema("shard int, block int, start_in_shard long, n_tokens long, doc_ids array<long>, payload binary").parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    first = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # one row a shard, and a run has as many shards as its shuffle had partitions
    offsets = F.broadcast(shards.select("shard", F.coalesce(first, F.lit(0)).alias("shard_start")))
    placed = blocks.join(offsets, "shard").select((F.col("shard_start") + F.col("start_in_shard")).alias("start"), "doc_ids", "payload")
    return placed.mapInArrow(_decode_blocks(read_table(spark, path), ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def token_file_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes docs to files in the shared folder and reads them back."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/dustloom-token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary)
    return read_token_files(docs.sparkSession, path)
