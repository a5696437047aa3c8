"""Checks on what is released: paths, contents and checksums."""

from __future__ import annotations

import hashlib
from pathlib import Path
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Path parts that are never released: fixed values.
FORBIDDEN = ["..", "cache", "runpod", ".env", ".git"]


def allowed_path(path: Column) -> Column:
    """No forbidden part; golden files only under evaluation; nothing absolute."""
    parts = F.split(F.lower(path), "/")
    golden = F.contains(F.element_at(parts, -1), F.lit("golden"))
    return (F.size(F.array_intersect(parts, F.array(*map(F.lit, FORBIDDEN)))) == 0) & ~F.startswith(path, F.lit("/")) & (~golden | F.array_contains(parts, "evaluation"))


def selected(files: DataFrame, include: list[str], exclude: list[str], path: str = "path") -> DataFrame:
    """Distinct paths at or below one of `include`, none of whose parts is in `exclude`, in order."""
    parts = F.split(F.col(path), "/")
    below = F.lit(False)
    for top in include:
        below = below | (F.col(path) == top) | F.startswith(F.col(path), F.lit(top.rstrip("/") + "/"))
    return files.where(below & ~F.arrays_overlap(parts, F.array(*map(F.lit, exclude)))).select(path).distinct().orderBy(path)


def directory_hash(folder: str) -> str:
    """SHA-256 of the paths and contents of a local folder's files, in order of path; files are read block by block."""
    digest, top = hashlib.sha256(), Path(folder)
    for file in sorted(f for f in top.rglob("*") if f.is_file()):
        digest.update(file.relative_to(top).as_posix().encode())
        with file.open("rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
    return digest.hexdigest()


def checksums(spark: SparkSession, folder: str, block: int = 1 << 23) -> DataFrame:
    """path, length, sha256 of every file below a folder.

    Spark lists the files, empty ones too; a task then reads its files block by block, so a file may be larger than a cell
    or a task's memory. Files are dealt by path; the file system is any that pyarrow opens by its address.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).inputFiles()
    files = spark.createDataFrame([(unquote(p).replace("file:///", "file:/"),) for p in listed], "path string")

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            sizes, sums = [], []
            for path in batch.column(0).to_pylist():
                local = path.removeprefix("file:")
                system, at = (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local != path else fs.FileSystem.from_uri(quote(path, safe=":/%"))
                size, digest = 0, hashlib.sha256()
                with system.open_input_stream(at, compression=None) as stream:
                    while data := stream.read(block):
                        size += len(data)
                        digest.update(data)
                sizes.append(size)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], names=["path", "length", "sha256"])

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(spread, "path").mapInArrow(run, "path string, length long, sha256 string")


def mismatches(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files of a manifest (path, sha256) that are missing or differ."""
    both = expected.select("path", F.col("sha256").alias("expected")).join(found, "path", "left")
    return both.where(~F.col("sha256").eqNullSafe(F.col("expected")))


def leaks(texts: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    return texts.where(F.col(text).rlike(pattern))
