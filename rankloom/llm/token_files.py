"""Token-id files: Arrow streams in files, with batches of fixed-size lists (operator 1).

`write_token_files` cuts the ids of all texts, in order of doc_id, into sequences of equal length and writes one file
for each range of doc_ids. A file is an Arrow IPC stream of equally large batches: `input_ids`, a fixed-size list of
the smallest unsigned type that holds the vocabulary, and `mask`, a fixed-size list of booleans (bits) that are false in the
padding after a file's last document. All full batches of a file have one size, so `batch_at` finds any of them by
arithmetic, and maps ids and mask without copying. Beside each file a small stream lists its documents (doc_id, start, n_tokens).

Null or empty text: just the end id. Null doc_id: first in order. Rows of one doc_id: in order of the text; each has a
start of its own. Very long texts: as many sequences as they need, in one file. Empty table: no file, an empty result.
Other columns, whatever their names, are not read. Files are as many as the session's shuffle partitions, or more, so
that none takes over about FILE bytes of input. A task writes under names of its own and renames; a repeated task
writes the same, and the manifest lists a file only when both are in place.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_sequences long"
FILE = 256 << 20
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def schema_of(dtype: str, length: int) -> pa.Schema:
    kind = pa.uint16() if dtype == "<u2" else pa.uint32()
    return pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Shard:
    """Writes one file and its list of documents."""

    def __init__(self, fs, path: str, dtype: str, length: int, rows: int):
        self.fs, self.path, self.dtype, self.length, self.rows = fs, path, np.dtype(dtype), length, rows
        self.own = f"{path}.{uuid.uuid4().hex}"
        self.out = [fs.open_output_stream(self.own), fs.open_output_stream(self.own + "d")]
        self.schema = schema_of(dtype, length)
        self.ids, self.docs = (pa.ipc.new_stream(o, s) for o, s in zip(self.out, (self.schema, DOCS), strict=True))
        self.left, self.pending = b"", []
        self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_ids: list, packed: list[bytes], end: bytes) -> None:
        sizes = np.fromiter((len(p) for p in packed), np.int64, len(packed)) // self.dtype.itemsize + 1
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), starts, sizes], schema=DOCS))
        self.n_docs += len(sizes)
        self.n_tokens += int(sizes.sum())
        self.left += end.join(packed) + end
        full = self.length * self.rows * self.dtype.itemsize
        cut = len(self.left) // full * full
        for at in range(0, cut, full):
            self._write(np.frombuffer(self.left, self.dtype, self.length * self.rows, at), self.rows, self.length * self.rows)
        self.left = self.left[cut:]

    def _write(self, ids: np.ndarray, rows: int, true: int) -> None:
        mask = np.arange(rows * self.length) < true
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.n_sequences += rows

    def close(self) -> None:
        rest = np.frombuffer(self.left, self.dtype)
        if len(rest):
            rows = -(-len(rest) // self.length)
            ids = np.zeros(rows * self.length, self.dtype)
            ids[: len(rest)] = rest
            self._write(ids, rows, len(rest))
        for x in (self.ids, self.docs, *self.out):
            x.close()
        self.fs.move(self.own, self.path)
        self.fs.move(self.own + "d", self.path + ".docs")


def _files(docs: DataFrame) -> int:
    """By the planner's estimate of the input's size, which needs no pass; at least the shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // FILE)) if size < 1 << 60 else least


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0, length: int = 2048, rows: int = 64, ordinary: bool = False) -> DataFrame:
    """Writes the files and returns one row for each (MANIFEST); `tokenizer`: a path that all executors can open.

    ordinary: special tokens' strings in a text are plain text, not those tokens.
    """
    spark = docs.sparkSession
    common.ship(spark)
    dtype = tokens.id_type(tokenizer)
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    dealt = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartitionByRange(_files(docs), *order[:2]).sortWithinPartitions(*order)

    def write(batches):
        fs, top = pafs.FileSystem.from_uri(out_dir) if "://" in out_dir or out_dir.startswith("file:") else (pafs.LocalFileSystem(), out_dir)
        shard = TaskContext.get().partitionId()
        encode, end, file = tokens.encoder(tokenizer, dtype, ordinary), np.array([end_id], dtype).tobytes(), None
        for batch in batches:
            for part in common.pieces(batch):
                if file is None:
                    fs.create_dir(top, recursive=True)
                    file = _Shard(fs, f"{top}/ids-{shard:06d}.arrows", dtype, length, rows)
                file.add(part.column(0).to_pylist(), encode.packed(part.column(1).to_pylist()), end)
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{out_dir}/ids-{shard:06d}.arrows", "n_docs": file.n_docs, "n_tokens": file.n_tokens, "n_sequences": file.n_sequences}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), *((k, pa.int64()) for k in ("n_docs", "n_tokens", "n_sequences"))]))

    return common.stage(dealt.mapInArrow(write, MANIFEST), "token-manifest")


class TokenFile:
    """One file: `length` ids in a sequence; any sequence at once."""

    def __init__(self, path: str):
        local = path.removeprefix("file://")
        if "://" in local:
            fs, inner = pafs.FileSystem.from_uri(path)
            self._open = fs.open_input_file
        else:
            inner, self._open = local, pa.memory_map
        self.source = self._open(inner)
        self.docs = pa.ipc.open_stream(self._open(inner + ".docs"))
        reader = pa.ipc.open_stream(self.source)
        self.schema, self.first = reader.schema, self.source.tell()
        self.length = self.schema.field("input_ids").type.list_size
        message = pa.ipc.read_message(self.source) if self.first < self.source.size() else None
        self.step = self.source.tell() - self.first
        self.rows = pa.ipc.read_record_batch(message, self.schema).num_rows if message else 0

    def batch_at(self, k: int) -> pa.RecordBatch:
        """Batch k; full batches are equally large, and only the last can be shorter."""
        self.source.seek(self.first + k * self.step)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence i, views of the file; the mask's bits stay packed."""
        row = self.batch_at(i // self.rows).slice(i % self.rows, 1)
        ids, mask = (row.column(k).flatten() for k in range(2))
        return ids.to_numpy(), mask

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids of the file's stream from `start` on."""
        full, out = self.rows * self.length, []
        for k in range(start // full, -(-(start + n) // full)):
            ids = self.batch_at(k).column(0).flatten().to_numpy()
            out.append(ids[max(0, start - k * full) : start + n - k * full])
        return np.concatenate(out) if len(out) != 1 else out[0]


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the files."""
    common.ship(manifest.sparkSession)
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("base"))
    files = files.repartition(max(1, manifest.count()))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["path"])
                for docs in file.docs:
                    starts, sizes = docs.column(1).to_pylist(), docs.column(2).to_pylist()
                    ids = file.span(starts[0], sum(sizes)).astype("<u4").tobytes()
                    at = 4 * np.concatenate([[0], np.cumsum(sizes)])
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
                    yield pa.record_batch([docs.column(0), pa.array([row["base"] + s for s in starts], pa.int64()), docs.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
