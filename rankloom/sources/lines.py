"""A source of text lines that knows where they stand: files are read by byte ranges, each line with its number in its range.

A line belongs to the range that its first byte lies in, so ranges are read on their own, and every range ends with a row
that counts its lines: the lines' numbers in the file follow from those counts, without a second look at the file.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Executors get these classes with the job, as they needn't have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "file string, start long, line long, value string, n_lines long, n_filled long"
#: Names of compressed files, which have one range.
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".br")
RANGE, BLOCK, ROWS = 64 << 20, 1 << 20, 4096


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def opened(file: str, start: int):
    """A stream of a file's bytes from `start` on; of a compressed one from its beginning, unpacked."""
    from urllib.parse import quote

    from pyarrow import fs

    local = file.removeprefix("file:")
    system, at = (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local != file else fs.FileSystem.from_uri(quote(file, safe=":/%"))
    if file.endswith(PACKED):
        return system.open_input_stream(at)
    stream = system.open_input_file(at)
    stream.seek(start)
    return stream


def lines_of(file: str, start: int, end: int, block: int = BLOCK):
    """Bytes of the lines whose first byte lies from start to before end, without their line ends."""
    packed = file.endswith(PACKED)
    at = start - 1 if start and not packed else start  # the byte before tells whether a line begins at start
    with opened(file, at) as stream:
        rest, skipping = b"", at < start
        while data := stream.read(block):
            parts = (rest + data).split(b"\n") if not skipping else data.split(b"\n")
            rest = parts.pop()
            for part in parts:
                if skipping:
                    skipping = False
                elif at >= end and not packed:
                    return
                else:
                    yield part.removesuffix(b"\r")
                at += len(part) + 1
            if skipping:
                at, rest = at + len(rest), b""
            if at >= end and not packed:
                return
        if rest and not skipping and (packed or at < end):
            yield rest.removesuffix(b"\r")


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.size = json.loads(options["files"]), int(options.get("bytes", RANGE))

    def partitions(self):
        return [Range(file, at, min(length, at + step)) for file, length in self.files for step in [length if file.endswith(PACKED) else self.size] for at in range(0, length, step)] or [Range("", 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        names = ["file", "start", "line", "value", "n_lines", "n_filled"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        if not partition.file:
            return
        rows, n, filled, held = [], 0, 0, 0
        for line in lines_of(partition.file, partition.start, partition.end):
            n, filled, held = n + 1, filled + bool(line.strip()), held + len(line)
            rows.append((partition.file, partition.start, n, line.decode("utf-8", "replace"), None, None))
            if len(rows) == ROWS or held > 8 * BLOCK:
                yield batch(rows)
                rows, held = [], 0
        yield batch([*rows, (partition.file, partition.start, None, None, n, filled)])


class Lines(DataSource):
    """Options: files, JSON of [path, length] pairs; bytes, the length of a range."""

    @classmethod
    def name(cls):
        return "ranged_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LineReader(self.options)


def ranged(spark: SparkSession, paths: list[str] | str, size: int = RANGE) -> DataFrame:
    """SCHEMA: each line with its range and its number there (from 1), and a row for each range with n_lines and n_filled
    (lines that aren't blank) in place of a line."""
    spark.dataSource.register(Lines)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length")
    found = [list(r) for r in files.orderBy("path").collect() if not r.path.rsplit("/", 1)[-1].startswith(("_", "."))]  # a row for each file, as Spark's own listing
    return spark.read.format("ranged_lines").option("files", json.dumps(found)).option("bytes", str(size)).load()


def with_numbers(found: DataFrame) -> DataFrame:
    """file, line (from 1, in the file) and value of the lines of `found`, which has all rows that count ranges."""
    before = F.coalesce(F.sum("n_lines").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = found.where("line IS NULL").select("file", "start", before.alias("before"))
    return found.where("line IS NOT NULL").join(ranges, ["file", "start"]).select("file", (F.col("line") + F.col("before")).alias("line"), "value")

