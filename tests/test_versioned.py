"""Tables that change at once: writers that die, rules, buckets, fetching once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rankloom.sources import readers, sinks, versioned
from rankloom.sources.versioned import Locked, Refused, Versioned, fetch_once

STEPS = ["locked", "written", "drafted", "committed", "tidied"]


class Killed(BaseException):
    """A writer's end without any clean-up."""


def kill_at(monkeypatch, step):
    def end(name):
        if name == step:
            raise Killed(name)

    monkeypatch.setattr(versioned, "_step", end)


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("step", STEPS)
def test_readers_see_the_old_table_or_the_new(spark, tmp_path, monkeypatch, step):
    t = Versioned(spark, f"{tmp_path}/t")
    t.replace(spark.range(0, 10, 1, 3))
    begun = t.read()
    kill_at(monkeypatch, step)
    with pytest.raises(Killed):
        t.replace(spark.range(100, 120, 1, 3))
    monkeypatch.undo()
    after = ids(Versioned(spark, f"{tmp_path}/t").read())
    assert after == (list(range(100, 120)) if STEPS.index(step) >= STEPS.index("committed") else list(range(10)))
    assert ids(begun) == list(range(10))
    with pytest.raises(Locked):
        t.replace(spark.range(5))
    t.unlock()  # the dead writer's lock
    t.replace(spark.range(7))
    t.replace(spark.range(8))
    assert ids(t.read()) == list(range(8)) and len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("d-")]) == versioned.KEPT
    assert not [x for x in (tmp_path / "t" / "_versions").iterdir() if x.name.endswith(".tmp")]


@pytest.mark.parametrize("step", STEPS)
def test_dying_upserts(spark, tmp_path, monkeypatch, step):
    t = Versioned(spark, f"{tmp_path}/t")
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    t.upsert(rows((1, "a"), (2, "a")), "id", 4)
    kill_at(monkeypatch, step)
    with pytest.raises(Killed):
        t.upsert(rows((2, "b"), (3, "b")), "id")
    monkeypatch.undo()
    new = STEPS.index(step) >= STEPS.index("committed")
    assert sorted(map(tuple, t.read().collect())) == ([(1, "a"), (2, "b"), (3, "b")] if new else [(1, "a"), (2, "a")])
    t.unlock()
    t.upsert(rows((2, "c"), (3, "c")), "id")
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "c")]


def test_rules_ride_on_the_writing_job(spark, tmp_path):
    t = Versioned(spark, f"{tmp_path}/t")
    group = "versioned-test"
    sc = spark.sparkContext
    t.replace(spark.range(50))
    sc.setJobGroup(group, group)
    t.replace(spark.range(0, 100, 1, 4), {"small": F.col("id") < 100})
    assert len(sc.statusTracker().getJobIdsForGroup(group)) == 1
    with pytest.raises(Refused, match="30 rows break 'small'") as e:
        t.replace(spark.range(0, 100, 1, 4).withColumn("w", F.when(F.col("id") < 90, 1)), {"small": F.col("id") < 70, "w": F.col("w") == 1})
    assert e.value.broken == {"small": 30, "w": 10}  # null breaks a rule
    assert len(sc.statusTracker().getJobIdsForGroup(group)) == 2
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert ids(t.read()) == list(range(100)) and t.versions()[-1] == 2
    t.replace(t.read().where("id < 5"))  # a table may be read and replaced in one go
    assert ids(t.read()) == list(range(5))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = Versioned(spark, f"{tmp_path}/t")
    t.upsert(spark.range(200).select("id", F.lit("old").alias("v"), F.col("id").cast("string").alias("_new_")), "id", 16)
    before = t.manifest()["parts"]
    t.upsert(spark.createDataFrame([(7, "new", "x"), (7, "newer", "x"), (1000, None, None)], "id long, v string, _new_ string"), "id", 99)
    after = t.manifest()["parts"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and len(after) == 16
    got = {r.id: r.v for r in t.read().collect()}
    assert len(got) == 201 and got[7] == "newer" and got[1000] is None and got[8] == "old"
    t.upsert(spark.createDataFrame([], "id long, v string, _new_ string"), "id")
    assert t.manifest()["parts"] == after
    with pytest.raises(Refused):
        t.upsert(spark.createDataFrame([(5, None, "x")], "id long, v string, _new_ string"), "id", rules={"v": F.col("v").isNotNull() | (F.col("id") == 1000)})
    assert {r.id: r.v for r in t.read().collect()}[5] == "old"


def test_fetch_once(spark, tmp_path):
    t, asked = Versioned(spark, f"{tmp_path}/cache"), []

    def fetch(misses):
        asked.append(sorted(r.k for r in misses.collect()))
        return misses.select("k", (F.col("k") * 10).alias("v"))

    requests = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long")
    run = lambda r: sorted(map(tuple, fetch_once(r, t, "k", fetch, "k long, v long", 8).collect()))
    assert run(requests) == [(1, 10), (2, 20), (2, 20)] and run(requests) == [(1, 10), (2, 20), (2, 20)]
    assert run(spark.createDataFrame([(3,), (1,)], "k long")) == [(1, 10), (3, 30)]
    assert asked == [[1, 2], [], [3]]

    def broken(misses):
        return misses.select("k", F.raise_error(F.lit("no answer")).cast("long").alias("v"))

    with pytest.raises(Exception, match="no answer"):
        fetch_once(spark.createDataFrame([(9,)], "k long"), t, "k", broken, "k long, v long")
    assert run(spark.createDataFrame([(1,)], "k long")) == [(1, 10)]  # not locked, as it was
    empty = Versioned(spark, f"{tmp_path}/none")
    assert fetch_once(requests.limit(0), empty, "k", fetch, "k long, v long").count() == 0 and empty.manifest() is None


def test_answers_are_made_once(spark, tmp_path):
    """Each missing key is asked for by one task once, though the rows are looked at more than once."""
    calls = spark.sparkContext.accumulator(0)

    def ask(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    t = Versioned(spark, f"{tmp_path}/cache")
    for asked in (range(20), range(30)):
        fetch_once(spark.createDataFrame([(k,) for k in asked], "k long"), t, "k", lambda m: m.mapInArrow(ask, "k long"), "k long").count()
    assert calls.value == 30


def test_sinks_commit_at_once(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "id long, t string, split string")
    for write, read in ((sinks.write_jsonl, lambda p: readers.read_jsonl(spark, p, "id long, t string")), (sinks.write_csv, lambda p: readers.read_csv(spark, p, df.schema)), (sinks.write_split, lambda p: Versioned(spark, p).read())):
        path = f"{tmp_path}/{write.__name__}"
        write(df, path)
        kill_at(monkeypatch, "drafted")
        with pytest.raises(Killed):
            write(df.limit(1), path)
        monkeypatch.undo()
        assert sorted((r.id, r.t) for r in read(path).collect()) == [(1, "a"), (2, None)]
        Versioned(spark, path).unlock()
        with pytest.raises(Refused):
            write(df, path, rules={"t": F.col("t").isNotNull()})
        write(df.where("id = 2"), path)
        assert [r.id for r in read(path).collect()] == [2]
    with pytest.raises(FileNotFoundError):
        Versioned(spark, f"{tmp_path}/nowhere").read()
