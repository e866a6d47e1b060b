"""Prefix tries, lexical search and archives in packages: edge cases and brute force."""

import hashlib
import io
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from dustloom.llm import lexical_search, prefix_trie, warc

TURNS = "conv_id long, turn long, role string, text string, depth long, c long, kind string"


def trie_by_hand(rows):
    own, members, kids, ends, leaves, saved = (defaultdict(k) for k in (list, list, set, list, int, int))
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full = own.get(c - c % 5, [])[:h] + v[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append(c)
            if d:
                kids[tuple(full[: d - 1])].add(tuple(full[:d]))
        ends[tuple(full)].append(c)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not kids[k]
        saved[k] += (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], digest(k)) for k, m in members.items())


def trie(df, **kw):
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.prefix_trie(df, **kw).collect())


def test_prefix_trie_by_brute_force(spark):
    """Copies, a long conversation, null turns, roles and texts, missing families, and clashing names; the tour is contracted down to ten arcs."""
    draw = random.Random(1)
    rows = [(c, t, draw.choice(("user", None)), draw.choice(("a", "é", "", None)) if t else draw.choice("ab")) for c in range(120) for t in range(draw.randint(1, 6))]
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(300)] + [(c, t, "user", "same") for c in range(600, 660) for t in (0, 1)]
    rows += [(701, None, "user", "first"), (701, -3, "user", "then"), (None, 0, "user", "x"), (703, 0, None, None)]
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, 9, 9, "k") for r in rows], TURNS).repartition(3)
    want = trie_by_hand(rows)
    assert trie(df, small=10) == want
    assert trie(df) == want


def test_prefix_trie_of_repeated_turns_and_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    got = trie(spark.createDataFrame([(0, 0, "u", "x", 1, 1, "k")] * 3 + [(2, 5, "u", "y", 1, 1, "k")], TURNS))
    # conversation 2 asks for seven turns of conversation 0, gets three, and has none of its own after its seventh
    assert [r[:7] for r in got] == [(0, 0, -1, 2, 1, 1, 3), (0, 1, 0, 2, 1, 1, 3), (0, 2, 0, 2, 1, 1, 2), (0, 3, 0, 2, 0, 1, 1)]


def test_few_ids_of_a_node_in_many_pieces(spark):
    ends = spark.range(1000).select(F.lit(1).cast("long").alias("depth"), F.lit(2).cast("long").alias("x1"), F.lit(3).cast("long").alias("x2"), F.col("id").alias("conv_id"))
    got = prefix_trie._end_hashes(ends.unionByName(ends.where("conv_id = 5").withColumn("x2", F.lit(4).cast("long")))).collect()
    assert {r["x2"]: r["ends_sha256"] for r in got} == {3: hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest(), 4: hashlib.sha256(b"5").hexdigest()}


DOCS = "doc_id long, text string, n long, score long, uid long, ids string"


def search_by_hand(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    import math

    own = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    total, length = sum(n > 0 for *_, n in own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scores = []
        for d, c, n in own:
            score = sum(a * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * total // length))) for t, a in asked.items() if c[t])
            scores += [(-score, d is None, d)] if score > 0 else []
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def documents():
    draw = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Été", "日本", "A1", "a1", "x-y", "µ"]
    weigh = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, weigh, k=draw.randint(1, 80)))) for i in range(900)]
    docs += [(1000 + i, "w1 w2 w3 w40") for i in range(300)] + [(None, "w1 w2 w3 w40"), (5, "w50"), (5, "w50"), (None, None), (2000, None), (2001, ""), (2002, " .,- "), (2003, "w3 " * 5000)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 12)))) for i in range(40)] + [(100, "w1 w2 w3 w40 w40"), (100, "W50"), (101, None), (102, "unknown"), (103, ""), (None, "w7 w8")]
    return docs, items


def test_lexical_search_by_brute_force(spark, monkeypatch):
    """Ties between hundreds of copies, repeated terms and identifiers, nulls; in one block and in several, in small batches too."""
    docs, items = documents()
    df = spark.createDataFrame([(*d, 1, 1, 1, "z") for d in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, uid long, rank int")
    want = search_by_hand(docs, items, 7)
    for batch, block in ((2048, 1 << 18), (150, 30)):
        monkeypatch.setattr(lexical_search, "BATCH", batch)
        monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
        assert sorted(map(tuple, lexical_search.ranked_documents(df, asked, k=7).collect()), key=str) == want
    none = spark.createDataFrame([], DOCS)
    assert lexical_search.ranked_documents(none, asked).count() == 0
    assert lexical_search.ranked_documents(df, asked.limit(0)).count() == 0


def test_pairs_of_nodes_are_pruned():
    """Where items and documents fall into topics, few pairs are scored."""
    import numpy as np

    draw = np.random.default_rng(3)
    items = lexical_search.arranged([(i, [f"t{i % 8}".encode()] + [f"t{i % 8}w{w}".encode() for w in draw.integers(0, 50, 20)]) for i in range(64)])
    own = lexical_search._Search(items, np.full(len(items.vocabulary), 3000), 4096, 4096 * 31, 5, np.zeros(64, dtype=np.int64))
    for _ in range(2):
        docs = [np.unique([items.vocabulary[w] for w in [b"t%d" % t, *(b"t%dw%d" % (t, x) for x in draw.integers(0, 50, 30))] if w in items.vocabulary]) for t in draw.integers(0, 8, 2048)]
        sizes = np.array([len(d) for d in docs])
        tfs = np.concatenate([np.where(d < 8, 5, 1) for d in docs])
        own.batch(list(range(2048)), np.full(2048, 31), sizes, np.concatenate(docs), tfs)
    assert own.scored < 4096 * 64 / 4


PAGES = "page_id long, url string, html string, digest string, kind string, payload string"


def pages():
    big = "<html>" + "é" * 800 + "</html>"
    out = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i * 30)) for i in range(1, 30)] + [(100 + i, "http://copy", big) for i in range(40)] + [(200 + i, "http://small", "small") for i in range(3)]
    out += [(300, None, None), (301, "u", ""), (None, "u", big), (None, "u", "z" * 2000), (None, "v", "z" * 2000), (302, "a\r\nb", "y" * 1500), (302, "a\r\nb", "y" * 1500), (303, "u", "y" * 1500 + "\r\n\r\n"), (7, "again", big), (304, "u", "x" * 3_000_000)]
    return out


def archived(rows):
    largest = {}
    for p, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 1000 and p is not None:
            largest[h] = max(largest.get(h, p), p)
    out = []
    for p, _, h in rows:
        h = (h or "").encode()
        again = h in largest and p != largest[h]
        out.append((p, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", largest[h] if again else None))
    return sorted(out, key=str)


CONTRACT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("how", [{"package_bytes": 2000}, {"few": 0, "hot": 10}])
def test_archives_round_trip(spark, how):
    df = spark.createDataFrame([(*p, "d", "k", "p") for p in pages()], PAGES).repartition(3)
    packages = warc.write_packages(df, **how)
    assert packages.agg(F.sum("records")).first()[0] == len(pages())
    read = warc.read_packages(packages.select("path"))
    assert sorted((tuple(r) for r in read.select(*CONTRACT).collect()), key=str) == archived(pages())
    assert {bytes(r["payload"]).decode() for r in read.where("record_type = 'response'").collect()} == {h or "" for _, _, h in pages()}
    assert warc.read_packages(warc.write_packages(df.limit(0)).select("path")).count() == 0


def records(payloads):
    return [warc._record("response", i, "u", hashlib.sha1(p).hexdigest(), len(p), p, None) for i, p in enumerate(payloads)]


def package(path, index=True, index_kind=zipfile.ZIP_STORED, archive_kind=zipfile.ZIP_STORED, comment=b"", before=b"", key="com,h)/ 2020 "):
    own, at, lines = records([b"a" * 10, b"b" * 5000, b""]), 0, ["!meta {}"]
    for r in own:
        lines.append(f'{key}{{"filename": "x.warc.gz", "offset": "{at}", "length": "{len(r)}"}}')
        at += len(r)
    with open(path, "wb") as f:
        f.write(before)
        with zipfile.ZipFile(f, "a" if before else "w", archive_kind) as z:
            z.writestr("pages/pages.jsonl", "{}")
            z.writestr("archive/x.warc.gz", b"".join(own))
            if index:
                z.writestr(zipfile.ZipInfo("indexes/index.cdxj"), "\n".join(lines), index_kind)
            z.comment = comment


HOWS = [{}, {"index": False}, {"index_kind": zipfile.ZIP_DEFLATED}, {"comment": b"PK\x05\x06" + b"z" * 300}, {"before": b"#!stub\n" * 9}, {"key": ""}]


def test_packages_of_others(spark, tmp_path, monkeypatch):
    """With comments, with bytes before, without an index, with a deflated one; all also with ZIP64 directories."""
    for i, how in enumerate(HOWS):
        package(tmp_path / f"{i}.wacz", **how)
        with monkeypatch.context() as m:
            m.setattr(zipfile, "ZIP64_LIMIT", 100)
            m.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
            package(tmp_path / f"{i}-64.wacz", **how)
        assert [b"PK\x06\x06" in (tmp_path / f"{i}{x}.wacz").read_bytes() for x in ("", "-64")] == [False, True]
    paths = sorted(str(p) for p in tmp_path.glob("*.wacz"))
    got = warc.read_packages(spark.createDataFrame([(p,) for p in paths], "path string")).orderBy("path", "page_id").collect()
    assert [(r["path"], r["page_id"], r["payload_bytes"], bytes(r["payload"])[:1]) for r in got] == [(p, *x) for p in paths for x in ((0, 10, b"a"), (1, 5000, b"b"), (2, 0, b""))]
    for path in paths:
        if "comment" not in HOWS[int(path.rpartition("/")[2][0])]:  # Python's reader takes that comment for a directory
            with pyarrow.fs.LocalFileSystem().open_input_file(path) as f, zipfile.ZipFile(path) as z:
                assert [(m[0], m[1], m[4], m[5], m[6]) for m in warc.directory(f, f.size())] == [(i.filename, i.compress_type, i.compress_size, i.file_size, i.CRC) for i in z.infolist()]


def test_broken_packages(spark, tmp_path):
    package(tmp_path / "deflated.wacz", archive_kind=zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="deflated"):
        warc.record_ranges(spark.createDataFrame([(str(tmp_path / "deflated.wacz"),)], "path string"))
    with pytest.raises(ValueError, match="directory"):
        list(warc.directory(pyarrow.BufferReader(b"no zip"), 6))
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(warc._record("response", 1, "u", "00" * 20, 1, b"x", None), True)


def test_index_lines_in_ranges(monkeypatch):
    """Every line belongs to the range in which it begins."""
    lines = [b'{"filename": "f", "offset": "%d", "length": "%d"}' % (i, i % 7) for i in range(200)]
    raw = b"\n".join(lines)
    for size in (1, 40, 47, 500, 1 << 20):
        monkeypatch.setattr(warc, "RANGE_BYTES", size)
        if size == 1:
            continue
        got = [line for begin in range(0, len(raw), size) for line in warc._owned_lines(pyarrow.BufferReader(raw), 0, 0, len(raw), begin)]
        assert got == lines


def test_records_without_gzip():
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nxyz\r\n\r\n"
    assert warc.parsed(plain, True)[5:7] == (3, hashlib.sha1(b"xyz").hexdigest()) and io.BytesIO(plain).read(4) == b"WARC"
