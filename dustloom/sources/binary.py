"""Large binary files by ranges of bytes: a data source whose partitions are ranges, blocks between marks, and their contents."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dustloom.operators.ranges import beside, ordered, running
from dustloom.session import on_workers
from dustloom.sources.files import MARKER

#: Bytes of a task's range and of what it reads at once; contents in one batch.
RANGE_BYTES, READ_BYTES, BATCH_BYTES = 128 << 20, 4 << 20, 8 << 20
FOUND = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")


class ByteRange(InputPartition):
    """Bytes begin to end of a file of size bytes."""

    def __init__(self, path: str, begin: int, end: int, size: int):
        self.path, self.begin, self.end, self.size = path, begin, end, size


class MarkedBytes(DataSource):
    """path, offset, size: every place where a mark begins, and the file's size.

    Options: paths (JSON list of files and folders), mark (hexadecimal), range_bytes. A task finds the marks that begin in its
    range, and reads on for the rest of one that crosses its end; marks may overlap.
    """

    @classmethod
    def name(cls) -> str:
        return "marked_bytes"

    def schema(self) -> str:
        return "path string, offset long, size long"

    def reader(self, schema) -> DataSourceReader:
        return MarkedBytesReader(json.loads(self.options["paths"]), bytes.fromhex(self.options["mark"]), int(self.options.get("range_bytes", RANGE_BYTES)))


class MarkedBytesReader(DataSourceReader):
    def __init__(self, paths: list[str], mark: bytes, range_bytes: int):
        if not mark:
            raise ValueError("a mark has at least one byte")
        self.paths, self.mark, self.range_bytes = paths, mark, range_bytes

    def partitions(self) -> list[ByteRange]:
        out = []
        for path in self.paths:
            files, where = opened(path)
            info = files.get_file_info(where)
            found = [info] if info.is_file else files.get_file_info(pyarrow.fs.FileSelector(where, recursive=True))
            for f in found:
                hidden = any(part.startswith(("_", ".")) for part in f.path[len(where) :].split("/"))
                if f.is_file and f.size and (info.is_file or not hidden):
                    name = path if info.is_file else path.rstrip("/") + f.path[len(where.rstrip("/")) :]
                    out += [ByteRange(name, at, min(at + self.range_bytes, f.size), f.size) for at in range(0, f.size, self.range_bytes)]
        return out

    def read(self, partition: ByteRange):
        files, where = opened(partition.path)
        more = len(self.mark) - 1
        with files.open_input_file(where) as file:
            for begin in range(partition.begin, partition.end, READ_BYTES):
                end = min(begin + READ_BYTES, partition.end)
                data = file.read_at(min(end + more, partition.size) - begin, begin)
                places, at = [], data.find(self.mark)
                while at >= 0:
                    places.append(begin + at)
                    at = data.find(self.mark, at + 1)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array([partition.size] * len(places), pa.int64())], schema=FOUND)


def marked_offsets(spark: SparkSession, paths: list[str], mark: bytes = MARKER, range_bytes: int = RANGE_BYTES) -> DataFrame:
    on_workers(spark)
    spark.dataSource.register(MarkedBytes)
    return spark.read.format("marked_bytes").options(paths=json.dumps(paths), mark=mark.hex(), range_bytes=range_bytes).load()


def marked_blocks(spark: SparkSession, paths: list[str], mark: bytes = MARKER, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, position, offset, length, blocks: from one mark to the next, with the number of its file's blocks.

    The last block is as long as its file's most frequent length (on ties the one seen first), or as the rest of the file if that is
    shorter or there is no other block. A file's marks may lie in many partitions.
    """
    o = ordered(marked_offsets(spark, paths, mark, range_bytes), ["path"], ["offset"])
    numbered = running(o.rows, o, {"position": ("sum", F.lit(1).cast("long"))}, write=False)
    near = beside(o, ["offset"], numbered).select("path", "position", "offset", "size", (F.col("_b.offset") - F.col("offset")).alias("length"))
    counts = near.where("length IS NOT NULL").groupBy("path", "length").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("seen"))
    modal = counts.groupBy("path").agg(F.max_by("length", F.struct("n", -F.col("seen"))).alias("modal"), (F.sum("n") + 1).alias("blocks"))
    rest = F.col("size") - F.col("offset")
    return near.join(modal, "path", "left").select("path", F.col("position").cast("int").alias("position"), "offset", F.coalesce("length", F.least(F.coalesce("modal", rest), rest)).alias("length"), F.coalesce("blocks", F.lit(1)).alias("blocks"))


def with_contents(blocks: DataFrame, most: int | None = None) -> DataFrame:
    """blocks (path, offset, length and more) with content, read by ranges in order of place; at most so many bytes of each if most is given."""
    on_workers(blocks.sparkSession)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in blocks.schema.fields)}, content binary"

    def read(batches):
        path, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True))
            first, contents, held = 0, [], 0
            for i, (now, offset, length) in enumerate(rows):
                if now != path:
                    if file:
                        file.close()
                    files, where = opened(now)
                    path, file = now, files.open_input_file(where)
                contents.append(file.read_at(length if most is None else min(length, most), offset))
                held += len(contents[-1])
                if held >= BATCH_BYTES or i == len(rows) - 1:
                    part = batch.slice(first, len(contents))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])
                    first, contents, held = i + 1, [], 0
        if file:
            file.close()

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(read, schema)
