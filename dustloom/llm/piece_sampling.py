"""Sampled segmentation into SentencePiece pieces, and decoding.

Pieces never hold a space after another character, so a text falls into chunks (spaces, then other characters)
whose lattices are independent. For each different chunk of a batch all pieces at all positions are found by
rolling hashes, and forward filtering sums the weights of all paths to each node. Each occurrence of a chunk
then samples a path backward, with random numbers that depend on the row's key, the chunk's place in the text
and the step alone, and are compared with sums over one node's edges alone: what else is in a batch, partitions and
retries don't change a segmentation.

A piece of merge rank n has weight (n + 2) ** -alpha, after Zipf's law; a character without piece is spelled in
byte pieces. As in the library a space is put before a text and white space is kept, so decoding gives the text.

A chunk of LONG_CHUNK characters or more (text without spaces) has no lattice of its own in memory: only the logarithms of
its forward sums are held, eight bytes a character, and the pieces that end at a node are looked up again on the way back.
The random numbers and the order of pieces are the same.

Lattices are kept for a worker's later batches while they and their chunks' texts take KEPT_BYTES at most. A model
with a piece that holds a space after another character is refused, as chunks would lose it.

Defined results: null and empty texts have no pieces and decode to the empty text; rows that repeat a key and a
text have the same pieces; a literal U+2581 is spelled in bytes; other columns pass unchanged.
"""

from __future__ import annotations

import re
import zlib
from array import array
from itertools import chain, repeat
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustloom.llm.common import chunks, on_workers, row_struct

ALPHA = 0.7
CHUNK_BYTES = 2 << 20
#: Most memory for the lattices that a worker keeps.
KEPT_BYTES = 96 << 20
#: Characters from which a chunk is sampled without a lattice in memory.
LONG_CHUNK = 1 << 18
_SPACED = re.compile(r" *[^ ]+| +")
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_TINY = 1e-150


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Pieces:
    """The vocabulary of a model file: weights, hashes by length, bytes."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.bytes = [b""] * size
        self.byte_ids = np.zeros(256, np.int64)
        nodes: dict[int, tuple[int, float]] = {}
        self.longest = 1
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace("▁", " ")
                if " " in piece.lstrip(" "):
                    raise ValueError(f"piece {i} holds a space after another character")
                self.bytes[i] = piece.encode()
                self.longest = max(self.longest, len(piece))
                key = 0
                for ch in piece:
                    key = (key * int(_BASE) + ord(ch) + 1) & (2**64 - 1)
                    nodes.setdefault(key, (-1, 0.0))
                nodes[key] = (i, (2.0 - model.get_score(i)) ** -alpha)
        self.byte_weight = (2.0 + size) ** -alpha
        self.base: Lattices | None = None
        self.texts: tuple[dict, dict] | None = None
        self.number: dict[str, int] = {}
        # all prefixes of pieces in an open table: hash, piece or -1, weight
        bits = max(4, len(nodes).bit_length() + 1)  # at most half full
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.ids, self.weights = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), np.zeros(1 << bits)
        for key, (i, weight) in nodes.items():
            at = ((key ^ key >> 32) * 0xBF58476D1CE4E5B9 & (2**64 - 1)) >> (64 - bits)
            while self.keys[at]:
                at = (at + 1) & self.mask
            self.keys[at], self.ids[at], self.weights[at] = key, i, weight

    def find(self, key: np.ndarray) -> np.ndarray:
        """The table's place of each hash, or -1 where it is no prefix of a piece."""
        out = ((key ^ key >> _U(32)) * _U(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int32)
        seen = self.keys[out]
        odd = np.flatnonzero(seen != key)
        while len(odd):
            free = seen[odd] == 0
            out[odd[free]] = -1
            odd = odd[~free]
            out[odd] = (out[odd] + 1) & self.mask
            seen[odd] = self.keys[out[odd]]
            odd = odd[seen[odd] != key[odd]]
        return out

    def by_text(self) -> tuple[dict[str, tuple[int, float]], dict[str, int]]:
        """For long chunks, each piece's identifier and the logarithm of its weight, and the longest piece by its last character."""
        if self.texts is None:
            texts, longest = {}, {}
            for key in np.flatnonzero(self.ids >= 0).tolist():
                i = int(self.ids[key])
                piece = self.bytes[i].decode()
                texts[piece] = (i, log(self.weights[key]))
                longest[piece[-1]] = max(longest.get(piece[-1], 1), len(piece))
            self.texts = texts, longest
        return self.texts

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8")


class Lattices:
    """Edges of the lattices of some chunks, with the probability of each among those that end where it ends."""

    def __init__(self, pieces: Pieces, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(self.length) - self.length
        of = np.repeat(np.arange(len(texts)), self.length)
        left = np.repeat(begin + self.length, self.length) - np.arange(len(codes))
        at, key = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        starts, sizes, ids, weights = [], [], [], []
        known = np.zeros(len(codes), bool)
        for n in range(1, pieces.longest + 1):
            key = key * _BASE + codes[at + (n - 1)] + _U(1)
            place = pieces.find(key)
            piece = pieces.ids[place]
            hit = (piece >= 0) & (place >= 0)
            starts.append(at[hit])
            sizes.append(np.full(len(starts[-1]), n))
            ids.append(piece[hit].astype(np.int64))
            weights.append(pieces.weights[place[hit]])
            if n == 1:
                known[starts[0]] = True
            stays = (place >= 0) & (left[at] > n)
            at, key = at[stays], key[stays]
            if not len(at):
                break
        spelled = np.flatnonzero(~known)
        width = np.where(codes[spelled] < 0x80, 1, np.where(codes[spelled] < 0x800, 2, np.where(codes[spelled] < 0x10000, 3, 4)))
        starts.append(spelled)
        sizes.append(np.ones(len(spelled), np.int64))
        ids.append(-1 - codes[spelled].astype(np.int64))
        weights.append(pieces.byte_weight ** width.astype(float))
        start, size, piece, weight = map(np.concatenate, (starts, sizes, ids, weights))
        word = of[start]
        # nodes: one more than characters in each chunk
        node_from, offset = start + word, start - begin[word] + size
        node_to = node_from + size
        order = np.argsort((offset << 40) + (node_to << 8) + size)  # offsets are below LONG_CHUNK, nodes below 2**32
        start, size, piece, weight, node_from, node_to, offset = (x[order] for x in (start, size, piece, weight, node_from, node_to, offset))
        alpha = np.zeros(len(codes) + len(texts))
        alpha[begin + np.arange(len(texts))] = 1.0
        share = np.empty(len(start))
        ends = np.flatnonzero(np.diff(offset, append=-1)) + 1
        at = 0
        for end in ends.tolist():
            to, gain = node_to[at:end], alpha[node_from[at:end]] * weight[at:end]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            total = np.add.reduceat(gain, first)
            alpha[to[first]] = total
            share[at:end] = gain / np.repeat(total, np.diff(first, append=len(to)))
            small = to[first][total < _TINY]
            if len(small):  # only ratios within reach of a piece matter
                for back in range(min(pieces.longest, int(offset[at]))):
                    alpha[small - back] /= _TINY
            at = end
        order = np.argsort((node_to << 8) + size)
        self.size, self.piece, share, node_to = size[order], piece[order], share[order], node_to[order]
        self.node0 = begin + np.arange(len(texts))
        first = np.flatnonzero(np.diff(node_to, prepend=-1))
        count = np.diff(first, append=len(node_to))
        self.first, self.last = np.zeros(len(alpha), np.int64), np.zeros(len(alpha), np.int64)
        self.first[node_to[first]], self.last[node_to[first]] = first, first + count - 1
        # running sums within each node, one edge of all nodes at a time
        self.upto = share
        for nth in range(1, int(count.max(initial=1))):
            edge = first[count > nth] + nth
            self.upto[edge] += self.upto[edge - 1]
        self.size, self.piece = self.size.astype(np.int16), self.piece.astype(np.int32)
        self.first, self.last = self.first.astype(np.int32), self.last.astype(np.int32)

    def held_bytes(self) -> int:
        """Memory of the arrays, and about that of the chunks' texts."""
        arrays = (self.upto, self.size, self.piece, self.first, self.last, self.node0, self.length)
        return sum(x.nbytes for x in arrays) + 150 * len(self.length) + 4 * int(self.length.sum())

    def extend(self, other: Lattices) -> None:
        """Adds other's chunks behind this one's."""
        nodes, edges = len(self.first), len(self.upto)
        both = lambda name, by: setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name) + by]))
        both("node0", nodes)
        both("first", np.int32(edges))
        both("last", np.int32(edges))
        for name in ("upto", "size", "piece", "length"):
            both(name, np.zeros((), getattr(self, name).dtype))

    def sample(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all occurrences in order, number of them for each). word: the chunk of each occurrence."""
        state, own = self.length[word].copy(), np.flatnonzero(self.length[word])
        steps = np.zeros(len(word), np.int64)
        who, what, turn = [], [], 0
        node0 = self.node0[word]
        while len(own):
            u = (mixed(seed[own] + _U((turn + 1) * int(_BASE) & (2**64 - 1))) >> _U(11)).astype(np.float64) * 2.0**-53
            node = node0[own] + state[own]
            edge, last = self.first[node], self.last[node]
            # the first edge whose running sum is above u, by halving
            for _ in range(int((last - edge).max()).bit_length()):
                middle = (edge + last) >> 1
                above = (self.upto[middle] > u) | (edge == last)
                edge, last = np.where(above, edge, middle + 1), np.where(above, middle, last)
            who.append(own)
            what.append(edge)
            steps[own] += 1
            state[own] -= self.size[edge]
            own = own[state[own] > 0]
            turn += 1
        out = np.empty(int(steps.sum()), np.int64)
        ends = np.cumsum(steps)
        for turn, (own, edge) in enumerate(zip(who, what, strict=True)):
            out[ends[own] - 1 - turn] = edge
        return self.piece[out], steps


class LongChunk:
    """One chunk too long for a lattice: logarithms of the forward sums of its nodes."""

    def __init__(self, pieces: Pieces, text: str):
        self.pieces, self.text = pieces, text
        self.sums = array("d", [0.0])
        for to in range(1, len(text) + 1):
            found = [self.sums[to - n] + weight for n, _, weight in self.ending(to)]
            most = max(found)
            self.sums.append(most + log(sum(exp(x - most) for x in found)))

    def ending(self, to: int):
        """Size, piece and logarithm of its weight of each piece that ends at a node, shorter ones first."""
        by_text, longest = self.pieces.by_text()
        for n in range(1, min(longest.get(self.text[to - 1], 1), to) + 1):
            hit = by_text.get(self.text[to - n : to])
            if hit:
                yield n, *hit
            elif n == 1:
                code = ord(self.text[to - 1])
                yield 1, -1 - code, log(self.pieces.byte_weight) * (1 if code < 0x80 else 2 if code < 0x800 else 3 if code < 0x10000 else 4)

    def sample(self, seed: int) -> np.ndarray:
        out, node = array("q"), len(self.text)
        while node:
            mixing = np.array([(seed + (len(out) + 1) * int(_BASE)) & (2**64 - 1)], np.uint64)
            u, upto = float(mixed(mixing)[0] >> _U(11)) * 2.0**-53, 0.0
            for n, piece, weight in self.ending(node):
                upto += exp(self.sums[node - n] + weight - self.sums[node])
                if upto > u:
                    break
            out.append(piece)
            node -= n
        return np.array(out, np.int64)[::-1]


def encode(pieces: Pieces, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
    """The sampled piece identifiers of each text. keys: 64 bits a row."""
    split = []
    for text in texts:
        if not text:
            split.append([])
        elif text[0] == " " or "  " in text:
            split.append([x[1:] for x in _SPACED.findall(" " + text)])
        else:
            split.append(text.split(" "))
    # chunks met before are numbered in the worker's base, the others of this batch behind them
    base_words = len(pieces.number)
    word = np.fromiter(map(pieces.number.get, chain.from_iterable(split), repeat(-1)), np.int64, sum(map(len, split)))
    if not len(word):
        return [np.zeros(0, np.int32) for _ in texts]
    fresh_at = np.flatnonzero(word < 0)
    number: dict[str, int] = {}
    long_at, flat = [], []
    if len(fresh_at):
        flat = list(chain.from_iterable(split))
        long_at = [i for i in fresh_at.tolist() if len(flat[i]) >= LONG_CHUNK]
        fresh_at = np.setdiff1d(fresh_at, long_at, assume_unique=True)
        word[fresh_at] = [base_words + number.setdefault(flat[i], len(number)) for i in fresh_at.tolist()]
    per_text = np.fromiter(map(len, split), np.int64, len(split))
    place = np.arange(len(word)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    row = np.repeat(mixed(keys.view(np.uint64) ^ mixed(np.array([seed & (2**64 - 1)], np.uint64))), per_text)
    seeds = mixed(row + place.astype(np.uint64) * _BASE)
    old_at = np.flatnonzero((word >= 0) & (word < base_words))
    parts = [(old_at, *pieces.base.sample(word[old_at], seeds[old_at]))] if len(old_at) else []
    if number:
        fresh = Lattices(pieces, [" " + x for x in number])
        parts.append((fresh_at, *fresh.sample(word[fresh_at] - base_words, seeds[fresh_at])))
    known_long: dict[str, LongChunk] = {}
    for i in long_at:
        if flat[i] not in known_long:
            known_long = {flat[i]: LongChunk(pieces, " " + flat[i])}  # one at a time
        own = known_long[flat[i]].sample(int(seeds[i]))
        parts.append((np.array([i]), own, np.array([len(own)])))
    steps = np.zeros(len(word), np.int64)
    for at, _, n in parts:
        steps[at] = n
    ids = np.empty(int(steps.sum()), np.int64)
    begin = np.cumsum(steps) - steps
    for at, own, n in parts:
        ids[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(len(own))] = own
    if number and (pieces.base.held_bytes() if pieces.base else 0) + fresh.held_bytes() <= KEPT_BYTES:
        if pieces.base is None:
            pieces.base = fresh
        else:
            pieces.base.extend(fresh)
        pieces.number.update((x, base_words + i) for x, i in number.items())
    counts = np.ones(len(ids), np.int64)
    spelled = np.flatnonzero(ids < 0)
    if len(spelled):
        raw = [chr(-1 - x).encode("utf-8", "surrogatepass") for x in ids[spelled].tolist()]
        counts[spelled] = list(map(len, raw))
    out = np.repeat(ids, counts)
    if len(spelled):
        ends = np.cumsum(counts)
        fill = np.concatenate([np.arange(e - n, e) for e, n in zip(ends[spelled].tolist(), counts[spelled].tolist(), strict=True)])
        out[fill] = pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    upto = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(steps)])[np.concatenate([[0], np.cumsum(per_text)])]]
    return [out[a:b].astype(np.int32) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


_PIECES: dict[tuple, Pieces] = {}


def pieces_of(path: str, alpha: float = ALPHA) -> Pieces:
    if (path, alpha) not in _PIECES:
        _PIECES[path, alpha] = Pieces(path, alpha)
    return _PIECES[path, alpha]


def _with(part: pa.Table, name: str, values: pa.Array, without: str) -> pa.RecordBatch:
    cols = {name: values}
    for c in part.column_names:
        if c != without:
            col = part.column(c)
            cols[c] = col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks)
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _encode_batches(path: str, alpha: float, seed: int, decode: bool):
    def run(batches):
        pieces = pieces_of(path, alpha)
        for part in chunks(batches, CHUNK_BYTES):
            keys = np.array(part.column("key").to_pylist(), np.int64)
            texts = [x or "" for x in part.column("text").to_pylist()]
            ids = encode(pieces, texts, keys, seed)
            ends = np.cumsum([0] + [len(x) for x in ids])
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            out = _with(part, "ids", values, "text")
            if decode:
                same = pa.array([pieces.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())
                out = _with(pa.Table.from_batches([out]), "lossless", same, "")
            yield out

    return run


def _decode_batches(path: str, alpha: float):
    def run(batches):
        pieces = pieces_of(path, alpha)
        for part in chunks(batches, 2 * CHUNK_BYTES):
            texts = [pieces.decode(x or ()) for x in part.column("ids").to_pylist()]
            yield _with(part, "decoded", pa.array(texts, pa.string()), "")

    return run


def encode_rows(docs: DataFrame, model: str, key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", alpha: float = ALPHA, seed: int = 0, decode: bool = False) -> DataFrame:
    """row (all of docs' columns as a struct) and ids of each row of docs; with decode, whether they give the text again."""
    on_workers(docs.sparkSession)
    given = docs.select(F.xxhash64(*(F.col(f"`{c}`") for c in key_cols)).alias("key"), F.col(f"`{text_col}`").alias("text"), row_struct(docs, "row"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("key", T.LongType()), given.schema["row"]])
    if decode:
        schema = T.StructType([T.StructField("lossless", T.BooleanType()), *schema.fields])
    return given.mapInArrow(_encode_batches(model, alpha, seed, decode), schema).drop("key")


def decode_rows(encoded: DataFrame, model: str, alpha: float = ALPHA) -> DataFrame:
    """encoded (with a column ids) and the text that its pieces spell."""
    on_workers(encoded.sparkSession)
    schema = T.StructType([T.StructField("decoded", T.StringType()), *encoded.schema.fields])
    return encoded.mapInArrow(_decode_batches(model, alpha), schema)


def _digest_batches(path: str, alpha: float, seed: int):
    def run(batches):
        pieces = pieces_of(path, alpha)
        for part in chunks(batches, CHUNK_BYTES):
            texts = [x or "" for x in part.column("text").to_pylist()]
            ids = encode(pieces, texts, np.array(part.column("key").to_pylist(), np.int64), seed)
            cols = {
                "doc_id": part.column("doc_id").combine_chunks(),
                "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                "lossless": pa.array([pieces.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
            }
            if isinstance(cols["doc_id"], pa.ChunkedArray):
                cols["doc_id"] = pa.concat_arrays(cols["doc_id"].chunks)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def segmentation_digest(docs: DataFrame, model: str, key_cols: tuple[str, ...] = ("doc_id",), alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, lossless for each row of docs; encoded and decoded in one worker."""
    on_workers(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*(F.col(f"`{c}`") for c in key_cols)).alias("key"), "text")
    return given.mapInArrow(_digest_batches(model, alpha, seed), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
