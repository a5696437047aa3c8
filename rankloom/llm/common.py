"""Shared folders, staging and Arrow helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: dict[str, str] = {}
_own_dir: dict[str, str] = {}


class _Staged(threading.local):
    """Folders of the tables that this thread has staged, in order; other threads' runs have their own."""

    def __init__(self):
        self.made: list[str] = []


staged = _Staged()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it may be unset, one of this process."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they and the driver share")
    if sc.applicationId not in _own_dir:
        _own_dir[sc.applicationId] = tempfile.mkdtemp(prefix="rankloom-")
        atexit.register(shutil.rmtree, _own_dir[sc.applicationId], ignore_errors=True)
        sc.setCheckpointDir(_own_dir[sc.applicationId])
    return "file://" + _own_dir[sc.applicationId]


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/rankloom/{tag}-{uuid.uuid4().hex[:12]}"


_tidy_lock, _tidying = threading.Lock(), {"depth": 0, "before": None}


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession):
    """While this holds, Spark deletes a job's shuffle files once it has ended, and not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _tidy_lock:
        if not _tidying["depth"]:
            _tidying["before"] = spark.conf.get(key, None)
            spark.conf.set(key, "true")
        _tidying["depth"] += 1
    try:
        yield
    finally:
        with _tidy_lock:
            _tidying["depth"] -= 1
            if not _tidying["depth"]:
                spark.conf.unset(key) if _tidying["before"] is None else spark.conf.set(key, _tidying["before"])


def stage(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Writes a table in the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    staged.made.append(path)
    with tidy_shuffles(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _name(folder: str) -> str:
    return "rankloom_" + folder.rsplit("/", 1)[-1].replace("-", "_")


def stage_by(df: DataFrame, tag: str, key: str) -> DataFrame:
    """Like `stage`, in a bucket by `key` for each shuffle partition, so that joins on `key` don't shuffle this side again."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    staged.made.append(path)
    with tidy_shuffles(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(_name(path))
    return spark.table(_name(path))


def forget(spark: SparkSession, folders, needed: DataFrame) -> None:
    """Deletes folders of staged tables, but none that `needed` reads."""
    read = needed.inputFiles()
    delete(spark, [folder for folder in folders if not any(folder.split("://")[-1] in f for f in read)])


def delete(spark: SparkSession, folders) -> None:
    """Deletes folders of staged tables that nothing reads any more."""
    for folder in folders:
        spark.sql(f"DROP TABLE IF EXISTS {_name(folder)}")  # the entry; the files are no managed table's
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def done(spark: SparkSession, since: int, *tags: str) -> None:
    """Deletes what this thread has staged under `tags` since it had staged `since` tables; nothing may read it any more."""
    gone = [f for f in staged.made[since:] if f.rsplit("/", 1)[-1].rpartition("-")[0] in tags]
    delete(spark, gone)
    staged.made[since:] = [f for f in staged.made[since:] if f not in gone]


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once for each application, so that they import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="rankloom-ship-")) / "rankloom_ship.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path(top.name) / p.relative_to(top))
    sc.addPyFile(str(path))
    _shipped[sc.applicationId] = str(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_arrow(df: DataFrame, make, fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """Appends columns: make() gives a function from a record batch to a list of arrays, one for each field.

    The columns of `keep` (all, if None) go through unchanged.
    """
    ship(df.sparkSession)
    kept = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches):
        fn = make()
        for batch in batches:
            for part in pieces(batch):
                arrays = [part.column(part.schema.get_field_index(c)) for c in kept] + fn(part)
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, most: int = 4 << 20):
    """Cuts a batch so that each part has about `most` bytes or one row."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column without nulls (null: empty)."""
    return batch.column(batch.schema.get_field_index(name)).fill_null("")


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind), True)


def sha_join(items) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


def beta_moments(k: F.Column, n: F.Column, least: float, most: float) -> tuple[F.Column, F.Column]:
    """Aggregates over groups with k of n: the mean rate, and the strength (a + b) of the beta prior of the groups' rates.

    By the moments of a beta-binomial: from the spread of the rates, weighted by n, what binomial chance alone gives is
    taken off; the rest is the correlation rho within groups, and a + b = 1 / rho - 1, held within least and most.
    """
    total, groups, mean = F.sum(n), F.count_if(n > 0), F.try_divide(F.sum(k), F.sum(n))
    chance = mean * (1 - mean)
    spread = F.sum(F.try_divide(k * k, n)) - total * mean * mean
    room = total - F.try_divide(F.sum(n * n), total) - (groups - 1)
    rho = F.when((room > 0) & (chance > 0), (spread - chance * (groups - 1)) / (chance * room))
    strength = F.coalesce(F.try_divide(F.lit(1.0), F.greatest(rho, F.lit(0.0))) - 1, F.lit(most))
    return F.coalesce(mean, F.lit(0.0)), F.least(F.lit(most), F.greatest(F.lit(least), strength))


def lower_bound(a: F.Column, b: F.Column, z: float) -> F.Column:
    """Mean less z deviations of Beta(a, b)."""
    n = a + b
    return a / n - z * F.sqrt(a * b / (n * n * (n + 1)))


def worse(rate: F.Column, base: F.Column, times: float) -> F.Column:
    """Whether a rate's odds are over so many times the base rate's."""
    return rate * (1 - base) > times * base * (1 - rate)
