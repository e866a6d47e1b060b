"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's words and their first four and five letters, hashed to 64 bits. Each term of the machine has a
weight and a vector of FACTORS numbers, whose inner products are the weights of pairs, so that two terms together
can mean what neither means alone. It is fitted on at most TRAIN_ROWS labelled documents (a hash of the identifier
chooses them) and on no row that is held out. All whole texts are scored.

Two tests on all of these rows choose the terms, both likelihood ratios of presence against the label: the best
MOST_TERMS terms by themselves; and the words of the best MOST_PAIRS pairs of words, at most PAIR_WORDS apart, that
tell at least LEAST_RATIO more together than the better of them alone, so that an insult and a mention, each common
in clean texts too, reach the machine. Pairs are counted where a label 1 has them in LEAST_DOCUMENTS rows. These
bounds are those of the fit on its bounded sample; scores know no bound. A long text's pairs are made in passes of PASS_PAIRS
pairs at most, by their hash. The pairs that label 1 has often aren't gathered anywhere: workers get PAIR_BITS bits that
tell which pairs may be among them, and a join tells which are.

Defined results: null counts as empty; a text without known terms scores what the bias alone gives; without any
label, or if all usable labels are the same, there is nothing to tell apart: every score is 0.5 less a little, so
nothing is rejected; repeated labels of an identifier count as
their largest; null labels and labels without document don't count. Other columns pass unchanged.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustloom.llm.common import chunks, on_workers, scratch

#: Most labelled rows that a fit uses.
TRAIN_ROWS = 20_000
#: Most terms that a machine has, fewest documents that hold one, least likelihood ratio.
MOST_TERMS, LEAST_DOCUMENTS, LEAST_RATIO = 4096, 4, 20.0
#: Words of a pair are at most so far apart; most pairs whose words a machine has.
PAIR_WORDS, MOST_PAIRS = 8, 1024
#: Pairs of one text that are held at once; bits of the filter of pairs, a power of two.
PASS_PAIRS, PAIR_BITS = 1 << 22, 1 << 24
FACTORS = 8
#: A fit takes EPOCHS rounds, and on few rows as many as LEAST_STEPS batches need.
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 30, 800, 256, 0.1, 1e-5
CHUNK_BYTES = 4 << 20
KEPT_WORDS = 200_000

_WORDS = re.compile(r"\w+")


def terms_of(word: str) -> tuple[int, ...]:
    """The hashes of a word and of its first four and five letters."""
    raw = word.encode("utf-8", "surrogatepass")
    out = {xxhash.xxh3_64_intdigest(raw)}
    for n in (4, 5):
        if len(word) >= n:
            out.add(xxhash.xxh3_64_intdigest(b"%d " % n + word[:n].encode("utf-8", "surrogatepass")))
    return tuple(x - (1 << 63) for x in out)


class _Known(dict):
    """What terms gives of each word, kept for KEPT_WORDS words and for one task."""

    def __init__(self, terms):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> tuple:
        if len(self) > KEPT_WORDS:
            self.clear()
        out = self[word] = self.terms(word)
        return out


def held_out(ident):
    """Rows from which no label is learnt."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Machine:
    """terms: ascending hashes; w, v: their weights and vectors; bias."""

    def __init__(self, terms: np.ndarray, bias: float = -1e-3):
        self.terms, self.bias = terms, bias
        self.w = np.zeros(len(terms), np.float64)
        self.v = np.random.default_rng(7).normal(0, 0.05, (len(terms), FACTORS))

    def fit(self, rows: list[list[int]], labels: np.ndarray) -> None:
        """AdaGrad on the logistic loss. rows: places of the terms that a document has."""
        draw = np.random.default_rng(11)
        rate = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
        self.bias = float(np.log(rate / (1 - rate)))
        sums = [np.full_like(x, 1e-6) for x in (self.w, self.v)]
        sum_bias = 1e-6
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // max(1, -(-len(rows) // BATCH))))):
            order = draw.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                x = np.zeros((len(part), len(self.terms)))
                for i, r in enumerate(part):
                    x[i, rows[r]] = 1
                p = x @ self.v
                z = self.bias + x @ self.w + 0.5 * ((p * p).sum(axis=1) - x @ (self.v**2).sum(axis=1))
                error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[part]) / len(part)
                used = np.flatnonzero(x.any(axis=0))
                xu = x[:, used]
                gw = xu.T @ error + DECAY * self.w[used]
                gv = xu.T @ (error[:, None] * p) - self.v[used] * (xu.T @ error)[:, None] + DECAY * self.v[used]
                sums[0][used] += gw * gw
                sums[1][used] += gv * gv
                self.w[used] -= RATE * gw / np.sqrt(sums[0][used])
                self.v[used] -= 0.3 * RATE * gv / np.sqrt(sums[1][used])
                g = float(error.sum())
                sum_bias += g * g
                self.bias -= 0.1 * RATE * g / sum_bias**0.5

    def score(self, places: list[int]) -> float:
        z = self.bias
        if places:
            v = self.v[places]
            s = v.sum(axis=0)
            z += self.w[places].sum() + 0.5 * float(s @ s - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _places(machine: Machine | None) -> _Known:
    """Of a word all of its terms, or the places of those that the machine has; most words have none."""
    if machine is None:
        return _Known(terms_of)
    places = {int(t): i for i, t in enumerate(machine.terms)}
    return _Known(lambda word: tuple(places[t] for t in terms_of(word) if t in places))


def _found(text: str | None, known: _Known) -> list[int]:
    words = set(_WORDS.findall((text or "").lower()))
    return sorted({t for own in map(known.__getitem__, words) if own for t in own})


def _term_lists(machine: Machine | None):
    """label, terms of each text: all of its hashes, or the places of those in the machine."""

    def run(batches):
        known = _places(machine)
        for part in chunks(batches, CHUNK_BYTES):
            lists = [_found(text, known) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part.column("label").to_pylist(), pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["label", "terms"])

    return run


_U = np.uint64


def _pairs(text: str | None, known: _Known):
    """The different pairs of a text's words at most PAIR_WORDS apart, in parts: hashes in ascending order, low and high."""
    words = np.fromiter((known[m[0]] for m in _WORDS.finditer((text or "").lower())), np.int64)
    passes = max(1, -(-len(words) * PAIR_WORDS // PASS_PAIRS))
    step = max(PASS_PAIRS // PAIR_WORDS, PAIR_WORDS + 1)
    for nth in range(passes):
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(words), step):
            for k in range(1, PAIR_WORDS + 1):
                a, b = words[at : at + step], words[at + k : at + k + step]
                a = a[: len(b)]
                low, high = np.minimum(a, b), np.maximum(a, b)
                key = _pair_key(low, high)
                mine = low != high
                if passes > 1:
                    mine &= (key >> _U(7)) % _U(passes) == nth
                parts.append((key[mine], low[mine], high[mine]))
            if passes > 1:  # what repeats doesn't pile up
                parts = [_different(parts)]
        yield _different(parts)


def _different(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    key, low, high = map(np.concatenate, zip(*parts, strict=True))
    key, first = np.unique(key, return_index=True)
    return key, low[first], high[first]


def _pair_key(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    low, high = low.view(np.uint64), high.view(np.uint64)
    return low * _U(0x9E3779B97F4A7C15) + (high ^ (high >> _U(29))) * _U(0xBF58476D1CE4E5B9)


def _pair_counts(bits: np.ndarray | None):
    """low, high, d, p: rows that have the pair, and those of them with label 1. bits: of pairs to count; None: all of label 1."""

    def run(batches):
        known = _Known(lambda word: xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63))
        asked = np.unpackbits(bits, bitorder="little").view(bool) if bits is not None else None
        for part in chunks(batches, CHUNK_BYTES):
            own, held = [], 0
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                if asked is None and label != 1:
                    continue
                for pairs in _pairs(text, known):
                    if asked is not None:
                        hit = asked[pairs[0] & _U(PAIR_BITS - 1)]
                        pairs = tuple(x[hit] for x in pairs)
                    own.append((*pairs, np.full(len(pairs[0]), label == 1, np.int64)))
                    held += len(pairs[0])
                    if held > PASS_PAIRS:
                        yield _summed(own)
                        own, held = [], 0
            if own:
                yield _summed(own)

    return run


def _summed(own: list[tuple]) -> pa.RecordBatch:
    key, low, high, toxic = map(np.concatenate, zip(*own, strict=True))
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    d, p = (np.bincount(place, w, len(first)).astype(np.int64) for w in (None, toxic))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (low[first], high[first], d, p)], names=["low", "high", "d", "p"])


def _pair_bits(pairs: DataFrame) -> np.ndarray:
    """PAIR_BITS bits, set for the hashes of pairs; made by tasks in pieces of 32,768 bits."""

    def places(batches):
        for batch in batches:
            low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
            yield pa.RecordBatch.from_arrays([pa.array((_pair_key(low, high) & _U(PAIR_BITS - 1)).astype(np.int64) + 1)], names=["place"])

    pieces = pairs.select("low", "high").mapInArrow(places, "place long").groupBy(F.bitmap_bucket_number("place").alias("nth")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(PAIR_BITS // 8, np.uint8)
    for r in pieces.collect():  # at most PAIR_BITS / 32768 rows
        piece = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["nth"] - 1) * 4096
        out[at : at + len(piece)] = piece
    return out


def _ratio(d: Column, p: Column, n: int, positive: int) -> Column:
    """The likelihood ratio of d rows, p of them with label 1, against n rows, positive of them with label 1."""
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    share, rest = positive / n, F.lit(n) - d
    return 2 * (part(p, d * share) + part(d - p, d * (1 - share)) + part(F.lit(positive) - p, rest * share) + part(F.lit(n - positive) - (d - p), rest * (1 - share)))


def _paired_words(sample: DataFrame, seen: DataFrame, n: int, positive: int) -> list[int]:
    """The words of pairs that tell more together than the better one alone; MOST_PAIRS of them at most."""
    counts = "low long, high long, d long, p long"
    total = lambda df: df.groupBy("low", "high").agg(F.sum("d").alias("d"), F.sum("p").alias("p"))
    # a pair that no other row has tells most, so what fails even then can't pass
    often = total(sample.mapInArrow(_pair_counts(None), counts)).where((F.col("p") >= LEAST_DOCUMENTS) & (_ratio(F.col("p"), F.col("p"), n, positive) >= LEAST_RATIO))
    often = scratch(often.select("low", "high"), "toxic-pairs")
    counted = total(sample.mapInArrow(_pair_counts(_pair_bits(often)), counts)).join(often, ["low", "high"], "left_semi")
    every = counted.withColumn("ratio", _ratio(F.col("d"), F.col("p"), n, positive)).where(F.col("ratio") >= LEAST_RATIO)
    alone = lambda name: seen.select(F.col("term").alias(name), F.col("ratio").alias(f"{name}_ratio"))
    gain = F.col("ratio") - F.greatest("low_ratio", "high_ratio")
    best = every.join(alone("low"), "low").join(alone("high"), "high").withColumn("gain", gain).where(F.col("gain") >= LEAST_RATIO)
    return [x for r in best.orderBy(F.desc("gain"), "low", "high").limit(MOST_PAIRS).collect() for x in (r["low"], r["high"])]


def _scores(machine: Machine):
    def run(batches):
        known = _places(machine)
        for part in chunks(batches, CHUNK_BYTES):
            out = [machine.score(_found(text, known)) for text in part.column("text").to_pylist()]
            cols = {"score": pa.array(out, pa.float64())}
            for name in part.column_names:
                if name != "text":
                    col = part.column(name)
                    cols[name] = col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Machine:
    """A machine from the labelled rows of docs that aren't held out."""
    on_workers(docs.sparkSession)
    ident = F.col(f"`{id_col}`")
    usable = labels.where(ident.isNotNull() & F.col(f"`{label_col}`").isNotNull() & ~held_out(ident)).groupBy(ident.alias("key")).agg(F.max(f"`{label_col}`").cast("int").alias("label"))
    # limit is the documented bound of the sample; the order by hash makes it the same each time
    chosen = F.broadcast(usable.orderBy(F.xxhash64("key"), "key").limit(train_rows))
    sample = scratch(docs.select(ident.alias("key"), F.col(f"`{text_col}`").alias("text")).join(chosen, "key").select("label", "text"), "toxic-train")
    n, positive = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not positive or positive == n:
        return Machine(np.zeros(0, np.int64))
    seen = sample.mapInArrow(_term_lists(None), "label int, terms array<long>").select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("d"), F.sum("label").alias("p"))
    seen = scratch(seen.withColumn("ratio", _ratio(F.col("d"), F.col("p"), n, positive)), "toxic-terms")
    alone = seen.where((F.col("d") >= LEAST_DOCUMENTS) & (F.col("d") < n) & (F.col("ratio") >= LEAST_RATIO)).orderBy(F.desc("ratio"), "term").limit(MOST_TERMS).select("term").collect()
    machine = Machine(np.array(sorted({r["term"] for r in alone} | set(_paired_words(sample, seen, n, positive))), np.int64))
    rows = sample.mapInArrow(_term_lists(machine), "label int, terms array<long>").collect()  # at most train_rows
    rows.sort(key=lambda r: (r["label"], r["terms"]))
    machine.fit([r["terms"] for r in rows], np.array([r["label"] for r in rows], float))
    return machine


def score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column of scores."""
    from pyspark.sql import types as T

    from dustloom.llm.common import row_struct

    on_workers(docs.sparkSession)
    given = docs.select(row_struct(docs, "row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("score", T.DoubleType()), given.schema["row"]])
    out = given.mapInArrow(_scores(machine), schema)
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != score_col), F.col("score").alias(score_col))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of docs that score under most; all columns as they were."""
    name = "_toxic_score"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels), score_col=name).where(F.col(name) < most).drop(name)
