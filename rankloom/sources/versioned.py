"""Tables that change all at once: data in folders of their own, and one rename of a manifest that readers follow.

    <path>/_lock                one writer at a time, created exclusively
    <path>/d-<id>/...           data of a commit, never changed
    <path>/_versions/<n>.json   manifest of version n: which folders hold the table, by bucket

A writer locks, writes a folder, and renames a complete manifest to the name of the next version: before that rename
readers see the old table, behind it the new one, and a crash at any point leaves one of both whole. What a crash leaves
lying is removed by a later commit. Rules that rows must keep ride on the writing job; nothing is committed if one fails.
Folders may lie in any file system that Spark writes to, whose renames of a file to a new name are atomic.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.operators.lineage import cut

#: Versions whose data stays, for readers that have begun.
KEPT = 2


class Locked(RuntimeError):
    """Another writer holds the lock, or a crash has left it: see Versioned.unlock."""


class Refused(ValueError):
    """Rows broke a rule; `broken` counts them by rule. Nothing was committed."""

    def __init__(self, path: str, broken: dict[str, int]):
        super().__init__(f"{path}: " + ", ".join(f"{n} rows break {rule!r}" for rule, n in broken.items()))
        self.broken = broken


def _step(name: str) -> None:
    """Called between every two steps of a commit; tests end a writer here."""


def observed(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The same rows, and counts of those that break a rule (false or null), known once a job has read them all."""
    seen = Observation(f"rules-{uuid.uuid4().hex[:8]}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"rule {k}") for k, rule in rules.items())), seen


def broken(seen: Observation) -> dict[str, int]:
    return {k.removeprefix("rule "): n for k, n in seen.get.items() if k.startswith("rule ") and n}


class Versioned:
    """A table at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._own = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._own(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._own(f"{self.path}/{name}")

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """A new file; fails if there is one of the name."""
        out = self._fs.create(self._at(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _names(self, folder: str = "") -> list[str]:
        at = self._at(folder) if folder else self._own(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self._names("_versions") if x.endswith(".json") and x[0].isdigit()]

    def manifest(self, version: int | None = None) -> dict | None:
        """{version, kind, schema, buckets, parts: {bucket: folder}} of the newest version; None if there is none."""
        known = self.versions()
        return json.loads(self._text(f"_versions/{version or known[-1]:012d}.json")) if known else None

    def folders(self, only: list[str] | None = None) -> list[str]:
        """Paths of the newest version's data, all or those of some buckets."""
        parts = (self.manifest() or {"parts": {}})["parts"]
        return sorted({f"{self.path}/{f}" for b, f in parts.items() if only is None or b in only})

    def read(self, only: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of some of its buckets."""
        found = self.manifest(version)
        if found is None:
            raise FileNotFoundError(f"{self.path} has no version")
        schema = StructType.fromJson(found["schema"])
        paths = sorted({f"{self.path}/{f}" for b, f in found["parts"].items() if only is None or b in only})
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).options(**found.get("options", {})).format(found["kind"]).load(paths)

    @contextmanager
    def lock(self):
        """Raises Locked if another writer is at work. A writer that dies keeps the lock until `unlock`."""
        owner = uuid.uuid4().hex
        try:
            self._put("_lock", owner)
        except Exception as e:
            if self._fs.exists(self._at("_lock")):
                raise Locked(f"{self.path} is locked") from e
            raise
        try:
            yield
        except Exception:
            self.unlock()
            raise
        self.unlock()

    def unlock(self) -> None:
        """Removes the lock: the own one, or one that a crash has left."""
        self._fs.delete(self._at("_lock"), False)

    def _commit(self, kind: str, df: DataFrame, rules: dict[str, Column] | None, merged, options: dict | None = None, by: list[str] = (), schema: StructType | None = None, buckets: int = 0) -> dict:
        """Writes df in a folder, and its manifest with parts `merged(folder)` once all rules hold. Needs the lock."""
        _step("locked")
        folder, options = f"d-{uuid.uuid4().hex}", options or {}
        if rules:
            df, seen = observed(df, rules)
        df.write.format(kind).options(**options).partitionBy(*by).save(f"{self.path}/{folder}")
        _step("written")
        if rules and (bad := broken(seen)):
            self._fs.delete(self._at(folder), True)
            raise Refused(self.path, bad)
        known = self.versions()
        version = known[-1] + 1 if known else 1
        told = {"version": version, "kind": kind, "options": options, "schema": (schema or df.schema).jsonValue(), "buckets": buckets, "parts": merged(folder)}
        draft = f"_versions/.{folder}.tmp"
        self._put(draft, json.dumps(told, sort_keys=True))
        _step("drafted")
        if not self._fs.rename(self._at(draft), self._at(f"_versions/{version:012d}.json")):
            raise OSError(f"version {version} of {self.path} can't be committed")
        _step("committed")
        self._tidy()
        _step("tidied")
        return told

    def _tidy(self) -> None:
        """Deletes manifests but the last few, drafts, and folders that none of these names."""
        known = self.versions()
        for v in known[:-KEPT]:
            self._fs.delete(self._at(f"_versions/{v:012d}.json"), False)
        for name in self._names("_versions"):
            if name.endswith(".tmp"):
                self._fs.delete(self._at(f"_versions/{name}"), False)
        used = {f.split("/")[0] for v in known[-KEPT:] for f in self.manifest(v)["parts"].values()}
        for name in self._names():
            if name.startswith("d-") and name not in used:
                self._fs.delete(self._at(name), True)

    def replace(self, df: DataFrame, rules: dict[str, Column] | None = None, kind: str = "parquet", options: dict | None = None, by: list[str] = ()) -> int:
        """Puts df in the table's place, if every row keeps all rules; the version's number. df may read the table itself."""
        with self.lock():
            return self._commit(kind, df, rules, lambda folder: {"all": folder}, options, by)["version"]

    def upsert(self, rows: DataFrame, key: str, buckets: int = 64, rules: dict[str, Column] | None = None) -> int:
        """Adds rows, in place of those with the same key. Only buckets that get a row are rewritten; the version's number.

        `buckets` counts for a new table. Of rows with one key the greatest stays; a null key is one.
        """
        with self.lock():
            return self._upsert(rows, key, buckets, rules)

    def _upsert(self, rows: DataFrame, key: str, buckets: int, rules: dict[str, Column] | None) -> int:
        old = self.manifest()
        buckets = old["buckets"] if old else buckets
        if not buckets:
            raise ValueError(f"{self.path} has no buckets")
        schema = StructType.fromJson(old["schema"]) if old else rows.schema
        columns = [f.name for f in schema]
        new = rows.select(key, F.struct(*columns).alias("_row")).groupBy(key).agg(F.max("_row").alias("_row")).select("_row.*", F.lit(True).alias("_new"))
        bucket = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        new = cut(bucket(new))  # the rows may be dear to make: they are made once
        touched = [str(r[0]) for r in new.select("_bucket").distinct().collect()]  # at most `buckets` rows
        if not touched:
            return old["version"] if old else 0
        before = bucket(self.read(touched).withColumn("_new", F.lit(False))) if old else new.limit(0)
        best = F.max_by(F.struct(*columns), "_new").alias("_row")
        merged = before.unionByName(new).groupBy(key, "_bucket").agg(best).select("_row.*", "_bucket").repartition("_bucket")

        def parts(folder: str) -> dict:
            found = {n.removeprefix("_bucket="): f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}
            return (old["parts"] if old else {}) | found

        return self._commit("parquet", merged, rules, parts, by=["_bucket"], schema=schema, buckets=buckets)["version"]


def fetch_once(requests: DataFrame, cache: Versioned, key: str, fetch, schema: StructType | str, buckets: int = 64) -> DataFrame:
    """Cached rows of the requests, after fetching and keeping what the cache lacks: a later run has no miss.

    fetch: a DataFrame of distinct missing keys -> rows of `schema`. Its answers are written before they are read, so each
    key is fetched once, and a failed fetch leaves the cache as it was. Rows of a request's key come back once for each
    request of it; a null key is never found, and not fetched.
    """
    asked = requests.select(key).where(F.col(key).isNotNull())
    with cache.lock():
        have = cache.read() if cache.manifest() else cache.spark.createDataFrame([], schema)
        misses = asked.distinct().join(have.select(key), key, "left_anti")
        cache._upsert(fetch(misses), key, buckets, None)
    return asked.join(cache.read() if cache.manifest() else have, key)
