"""WARC records in ZIP packages, and their reader, which takes records by ranges and extracts nothing.

A task writes its rows to packages of its own: an archive member of gzip records, stored (not deflated again), an index member of one JSON
line a record, and a list of both. Sizes may pass 4 GiB: the directories are ZIP64 then. Packages have new names in
the shared folder and only those count that are in the table which the writing job returns, so a task that is run again leaves none twice.

Reading has three steps, each a distributed one: packages' ends give the directories (plain or ZIP64) and with them where
members begin; index members give places of records, in ranges of lines (lines of archives that the package doesn't have count for nothing); records are sorted by place and read in ranges
where neighbours are read as one. A package without an index is walked record by record. Members that are not stored
can't be read by ranges: an index is inflated as a stream, an archive is an error.

Revisits: of rows with equal payloads of LEAST_REVISIT bytes or more the one with the largest page_id is a response, the others are revisits,
whose records have headers only. Digests that more than HOT rows share are broadcast, at most one for each HOT rows; the others are joined
by shuffle unless few, and rows of hot digests are spread there, so copies don't meet in one task.

Defined results: null html is an empty payload; a null page_id ranks below all others and has no name in its record; rows that repeat
page_id and payload are responses all if that id is the largest; a null url is an empty one; an empty table gives no package and no rows.
Columns besides the three named play no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustloom.llm.common import chunks, on_workers, scratch, shared_dir

LEAST_REVISIT = 1000
#: Rows of one digest from which it is broadcast, and digests that are broadcast wholly.
HOT, FEW = 100_000, 200_000
PACKAGE_BYTES, CHUNK_BYTES, RANGE_BYTES, GAP_BYTES = 1 << 30, 8 << 20, 8 << 20, 1 << 12
PAGE_URN = "urn:dustloom:page:"
#: Fixed values of the formats: signatures and sizes of ZIP's structures, names of WACZ's members, the revisit profile.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, ENTRY_SIZE, LOCAL_SIZE, MOST_COMMENT = 22, 20, 46, 30, 65535
ARCHIVE, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MEMBERS = "path string, member string, method int, flags int, offset long, stored_bytes long, bytes long, crc32 long"
RECORDS = "path string, member string, start long, length long"
READ = "path string, start long, record_type string, record_id string, refers_to_id string, url string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"


def opened(path: str):
    """The file system of a path or URI and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


# Writing


def _record(kind: str, page_id: int | None, url: str, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: WARC headers and an HTTP response, which a revisit has without its body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{PAGE_URN}{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:sha1:{digest}>", f"WARC-Target-URI: {url}"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{PAGE_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


class _Package:
    """A package that is being written; only its index is held, which PACKAGE_BYTES bound."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        files, where = opened(self.path)
        self.out = files.open_output_stream(where)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.at, self.lines, self.digest = 0, [], hashlib.sha256()

    def add(self, record: bytes, about: dict) -> None:
        self.member.write(record)
        self.digest.update(record)
        self.lines.append(json.dumps({**about, "offset": str(self.at), "length": str(len(record)), "filename": ARCHIVE.rpartition("/")[2]}))
        self.at += len(record)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        index = "".join(f"{line}\n" for line in self.lines).encode()
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        resources = [{"path": ARCHIVE, "bytes": self.at, "hash": "sha256:" + self.digest.hexdigest()}, {"path": INDEX, "bytes": len(index), "hash": "sha256:" + hashlib.sha256(index).hexdigest()}]
        self.zip.writestr(zipfile.ZipInfo(PACKAGE), json.dumps({"profile": "data-package", "resources": resources}))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.path, len(self.lines), size


def _write(folder: str, package_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]):
        package, done = None, []
        for table in chunks(batches, CHUNK_BYTES):
            columns = [table.column(c) for c in ("page_id", "url", "payload", "digest", "kind", "refers_to")]
            for batch in pa.Table.from_arrays(columns, names=[str(i) for i in range(6)]).to_batches():
                for page_id, url, payload, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    package = package or _Package(folder)
                    url = " ".join((url or "").split())
                    record = _record(kind, page_id, url, digest, len(payload), payload, refers_to)
                    package.add(record, {"url": url, "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": "sha1:" + digest})
                    if package.at >= package_bytes:
                        done.append(package.close())
                        package = None
        if package:
            done.append(package.close())
        paths, records, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return write


def decided(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", hot: int = HOT, few: int = FEW) -> DataFrame:
    """page_id, url, payload, digest, kind, refers_to of each row."""
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    shared = large.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND largest IS NOT NULL")
    shared = scratch(shared, "digests")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    kind = F.when(revisit, "revisit").otherwise("response").alias("kind")
    if shared.count() <= few:
        met = rows.join(F.broadcast(shared), "digest", "left")
        return met.select("page_id", "url", "payload", "digest", kind, F.when(revisit, F.col("largest")).alias("refers_to"))
    often = shared.where(F.col("copies") > hot).select("digest", F.col("largest").alias("often"))
    met = rows.join(F.broadcast(often), "digest", "left")
    key = F.when(F.col("often").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id"), F.lit(0)).cast("string")))
    rest = shared.where(F.col("copies") <= hot).select(F.col("digest").alias("key"), F.col("largest").alias("seldom"))
    met = met.withColumn("key", key).join(rest, "key", "left").withColumn("largest", F.coalesce("often", "seldom"))
    return met.select("page_id", "url", "payload", "digest", kind, F.when(revisit, F.col("largest")).alias("refers_to"))


def write_packages(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", package_bytes: int = PACKAGE_BYTES, hot: int = HOT, few: int = FEW) -> DataFrame:
    """Writes packages to a new folder in the shared one: path, records and bytes of each, as a written table."""
    spark = pages.sparkSession
    on_workers(spark)
    folder = f"{shared_dir(spark)}/dustloom-packages-{uuid.uuid4().hex}"
    files, where = opened(folder)
    files.create_dir(where, recursive=True)
    return scratch(decided(pages, page_col, url_col, html_col, hot, few).mapInArrow(_write(folder, package_bytes), "path string, records long, bytes long"), "packages")


# Reading


def _extra64(extra: bytes, stored: int, size: int, offset: int) -> tuple[int, int, int]:
    """Sizes and offset of a directory entry with what its ZIP64 field has instead of all ones."""
    at = 0
    while at + 4 <= len(extra):
        tag, length = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            held = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            size = next(held) if size == 0xFFFFFFFF else size
            stored = next(held) if stored == 0xFFFFFFFF else stored
            offset = next(held) if offset == 0xFFFFFFFF else offset
        at += 4 + length
    return stored, size, offset


def directory(file, size: int) -> Iterator[tuple]:
    """name, method, flags, where the content begins, stored bytes, bytes and crc32 of each member, from the end of a package."""
    tail_at = max(0, size - END_SIZE - MOST_COMMENT - LOCATOR_SIZE)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + END_SIZE + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no ZIP directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    place, shift = tail_at + end, None
    if end >= LOCATOR_SIZE and tail[end - LOCATOR_SIZE : end].startswith(LOCATOR64):
        at64 = struct.unpack_from("<Q", tail, end - LOCATOR_SIZE + 8)[0]
        end64 = file.read_at(56, at64)
        if end64.startswith(END64):
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
            place, shift = at64, 0
    shift = place - length - start if shift is None else shift  # bytes before the package, as in self-extracting ones
    at, stop, held, held_at = start + shift, start + shift + length, b"", start + shift
    while at < stop:
        if at + ENTRY_SIZE > held_at + len(held):
            held, held_at = file.read_at(min(RANGE_BYTES, stop - at), at), at
        here = at - held_at
        if held[here : here + 4] != ENTRY:
            raise ValueError("broken ZIP directory")
        flags, method, _, _, crc, stored, bytes_, n_name, n_extra, n_comment = struct.unpack_from("<HHHHIIIHHH", held, here + 8)
        local = struct.unpack_from("<I", held, here + 42)[0]
        total = ENTRY_SIZE + n_name + n_extra + n_comment
        if here + total > len(held):
            held, held_at, here = file.read_at(max(total, min(RANGE_BYTES, stop - at)), at), at, 0
        name = held[here + ENTRY_SIZE : here + ENTRY_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        stored, bytes_, local = _extra64(held[here + ENTRY_SIZE + n_name : here + ENTRY_SIZE + n_name + n_extra], stored, bytes_, local)
        head = file.read_at(LOCAL_SIZE, local + shift)
        if not head.startswith(LOCAL):
            raise ValueError(f"no local header of {name}")
        yield name, method, flags, local + shift + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26)), stored, bytes_, crc
        at += total


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _directories(batches):
    schema = _schema(MEMBERS)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            files, where = opened(path)
            with files.open_input_file(where) as file:
                members = directory(file, file.size())
                while rows := [(path, *m) for _, m in zip(range(10_000), members)]:
                    yield _batch(schema, rows)


def members(paths: DataFrame) -> DataFrame:
    """A row a member of each package in column path."""
    on_workers(paths.sparkSession)
    return paths.select("path").mapInArrow(_directories, MEMBERS)


def _lines(batches):
    """Lines of index members that begin in given ranges, to the places of their records in the package."""
    schema = _schema(RECORDS)
    for batch in batches:
        for path, method, offset, stored, begin, archives in zip(*(batch.column(c).to_pylist() for c in ("path", "method", "offset", "stored_bytes", "begin", "archives")), strict=True):
            at = {a["file"]: (a["member"], a["offset"]) for a in archives}
            files, where = opened(path)
            with files.open_input_file(where) as file:
                for rows in _parsed(_owned_lines(file, method, offset, stored, begin)):
                    yield _batch(schema, [(path, at[name][0], at[name][1] + start, length) for name, start, length in rows if name in at])


def _owned_lines(file, method: int, offset: int, stored: int, begin: int) -> Iterator[bytes]:
    if method:
        raw = zlib.decompressobj(-15)
        rest = b""
        for at in range(0, stored, RANGE_BYTES):
            rest += raw.decompress(file.read_at(min(RANGE_BYTES, stored - at), offset + at))
            *whole, rest = rest.split(b"\n")
            yield from whole
        yield rest
        return
    end, at, rest = min(begin + RANGE_BYTES, stored), begin, b""
    skip = begin > 0 and file.read_at(1, offset + begin - 1) != b"\n"
    line_at = begin
    while at < stored:
        rest += file.read_at(min(RANGE_BYTES, stored - at), offset + at)
        at = min(at + RANGE_BYTES, stored)
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if line_at >= end:
                return
            if not skip:
                yield line
            skip, line_at = False, line_at + len(line) + 1
        if line_at >= end:
            return
    if rest and not skip and line_at < end:
        yield rest


def _parsed(lines: Iterator[bytes]) -> Iterator[list[tuple]]:
    """Of index lines (JSON, after a key and a time or alone), and 10,000 at a time, file, offset and length."""
    rows = []
    for line in lines:
        at = line.find(b"{")
        if at < 0 or line.startswith(b"!"):
            continue
        said = json.loads(line[at:])
        rows.append((said["filename"], int(said["offset"]), int(said["length"])))
        if len(rows) == 10_000:
            yield rows
            rows = []
    yield rows


def _walked(batches):
    """Ranges of the records of whole archives, for packages without an index."""
    schema = _schema(RECORDS)
    for batch in batches:
        for path, member, offset, stored in zip(*(batch.column(c).to_pylist() for c in ("path", "member", "offset", "stored_bytes")), strict=True):
            files, where = opened(path)
            with files.open_input_file(where) as file:
                rows, at = [], 0
                while at < stored:
                    size = _record_size(file, offset + at, stored - at)
                    rows.append((path, member, offset + at, size))
                    at += size
                    if len(rows) == 10_000:
                        yield _batch(schema, rows)
                        rows = []
                yield _batch(schema, rows)


def _record_size(file, at: int, most: int) -> int:
    raw, used = zlib.decompressobj(31), 0
    while used < most:
        got = file.read_at(min(1 << 16, most - used), at + used)
        raw.decompress(got)
        used += len(got)
        if raw.eof:
            return used - len(raw.unused_data)
    raise ValueError("a record is cut off")


def record_ranges(paths: DataFrame) -> DataFrame:
    """path, member, start (in the package) and length of each record of the packages."""
    named = scratch(members(paths), "members")
    archives = named.where(F.col("member").rlike(r"^archive/[^/]+\.warc(\.gz)?$"))
    bad = archives.where("method <> 0").select("path", "member").first()
    if bad:
        raise ValueError(f"{bad['member']} of {bad['path']} is deflated, so its records can't be read by ranges")
    indexes = named.where(F.col("member").rlike(r"^indexes/[^/]+\.cdxj?$"))
    begins = F.when(F.col("method") == 0, F.sequence(F.lit(0).cast("long"), F.greatest(F.col("stored_bytes") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    # what archives a package has goes with the ranges of its index, so that no join meets the lines
    held = archives.groupBy("path").agg(F.collect_list(F.struct(F.regexp_extract("member", "[^/]+$", 0).alias("file"), "member", "offset")).alias("archives"))
    parts = indexes.hint("merge").join(held, "path").select("path", "method", "offset", "stored_bytes", "archives", F.explode(begins).alias("begin")).repartition("path", "begin")
    listed = parts.mapInArrow(_lines, RECORDS)
    bare = archives.hint("merge").join(indexes.select("path").distinct(), "path", "left_anti").select("path", "member", "offset", "stored_bytes").repartition("path", "member")
    return listed.unionByName(bare.mapInArrow(_walked, RECORDS))


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page(urn: str) -> int | None:
    number = urn.strip("<>").removeprefix(PAGE_URN)
    return int(number) if number.lstrip("-").isdigit() else None


def parsed(raw: bytes, with_payload: bool) -> tuple:
    """Of one record (a gzip member, or plain): type, id, id it refers to, url, page_id, payload bytes and digest, page_id it refers to, payload."""
    raw = gzip.decompress(raw) if raw.startswith(b"\x1f\x8b") else raw
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = warc.get("warc-payload-digest", "").removeprefix("sha1:")
    claimed = base64.b32decode(said).hex() if len(said) == 32 else said.lower()
    kind, url = warc.get("warc-type", ""), warc.get("warc-target-uri", "")
    if kind == "revisit":
        size, digest, payload = int(_headers(http).get("content-length", 0)), claimed, None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if claimed and claimed != digest:
            raise ValueError(f"the payload of {warc.get('warc-record-id')} has another digest than its record")
    ident, refers = warc.get("warc-record-id", "").strip("<>"), warc.get("warc-refers-to", "").strip("<>")
    return kind, ident, refers or None, url, _page(ident), size, digest, _page(refers), payload if with_payload else None


def _read(with_payload: bool):
    def read(batches):
        schema, path, file = _schema(READ), None, None
        rows, held = [], 0
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length")), strict=True))
            at = 0
            while at < len(places):
                now, start, end = places[at][0], places[at][1], places[at][1] + places[at][2]
                last = at + 1
                while last < len(places) and places[last][0] == now and places[last][1] - end <= GAP_BYTES and places[last][1] + places[last][2] - start <= RANGE_BYTES:
                    end = max(end, places[last][1] + places[last][2])
                    last += 1
                if now != path:
                    if file:
                        file.close()
                    files, where = opened(now)
                    path, file = now, files.open_input_file(where)
                got = io.BytesIO(file.read_at(end - start, start)).getbuffer()
                for _, first, length in places[at:last]:
                    row = parsed(bytes(got[first - start : first - start + length]), with_payload)
                    rows.append((now, first, *row))
                    held += 200 + len(row[-1] or b"")
                    if held > CHUNK_BYTES:
                        yield _batch(schema, rows)
                        rows, held = [], 0
                at = last
        if file:
            file.close()
        yield _batch(schema, rows)

    return read


def read_packages(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the packages in column path; payloads of responses if asked for, of revisits none."""
    spark = paths.sparkSession
    ranges = record_ranges(paths)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ranges.repartitionByRange(parts, "path", "start").sortWithinPartitions("path", "start")
    return placed.mapInArrow(_read(with_payload), READ)


def warc_digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages to packages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    read = read_packages(write_packages(pages).select("path"), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
