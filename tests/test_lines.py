"""Lines by byte ranges against Python's own reading, and checksums of files of any size."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from rankloom.operators import audit
from rankloom.sources import lines, readers


@pytest.mark.parametrize("seed", range(40))
def test_ranges_share_out_every_line(tmp_path, seed):
    """Whatever the ranges' and blocks' ends hit: line ends, long lines, empty lines, no line end at the end."""
    r = random.Random(seed)
    data = b"".join(bytes(r.choice(b"ab \xc3\xa9") for _ in range(r.choice([0, 0, 1, 3, 50]))) + r.choice([b"\n", b"\n", b"\r\n"]) for _ in range(r.randint(0, 40)))
    data += b"" if r.random() < 0.5 else b"last"
    (tmp_path / "f").write_bytes(data)
    want = [x.removesuffix(b"\r") for x in data.split(b"\n")]
    want = want[:-1] if want[-1] == b"" else want
    for size in (1, 2, 7, 64, 10_000):
        for block in (1, 5, 1 << 20):
            got = [x for at in range(0, len(data), size) for x in lines.lines_of(f"file:{tmp_path}/f", at, min(len(data), at + size), block)]
            assert got == want


def test_line_numbers_over_ranges_and_files(spark, tmp_path):
    r = random.Random(1)
    want = {}
    for name in ("a.jsonl", "b.jsonl", "c.jsonl.gz", "empty.jsonl"):
        rows = [] if name == "empty.jsonl" else [r.choice(['{"id": 1}', "", "  ", "[1]", "nope", '{"id": 2, "x": "é\\n"}', "7", '{"id"']) for _ in range(200)]
        data = ("\n".join(rows) + "\n" * bool(rows)).encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
        want |= {(name, k): x for k, x in enumerate(rows, 1) if x.strip() and not (x.startswith("{") and x.endswith("}"))}
    for size in (37, 1 << 20):
        got = readers.bad_lines(spark, str(tmp_path), size).collect()
        assert len(got) == len(want) and {(x.file.rsplit("/", 1)[-1], x.line): x.value for x in got} == want
    first = min(want)
    with pytest.raises(ValueError, match=rf"{first[0]}:{first[1]}: not a JSON object"):
        readers.read_jsonl(spark, str(tmp_path), "id long")


def test_one_look_at_the_files(spark, tmp_path):
    """The check reads the files once; blank lines and odd white space are no rows."""
    (tmp_path / "f.jsonl").write_text('{"id": 1}\n\t\n  {"id": 2}  \n')
    group, sc = "lines-test", spark.sparkContext
    assert [r.id for r in readers.read_jsonl(spark, f"{tmp_path}/f.jsonl", "id long").orderBy("id").collect()] == [1, 2]
    (tmp_path / "blank.jsonl").write_text("\n \n")
    with pytest.raises(ValueError, match="no rows"):
        readers.read_jsonl(spark, f"{tmp_path}/blank.jsonl", "id long")
    seen = readers._checked(spark, f"{tmp_path}/f.jsonl", 8)
    sc.setJobGroup(group, group)
    assert lines.with_numbers(seen).count() == 0 and seen.selectExpr("sum(n_lines)", "sum(n_filled)").first()[:] == (3, 2)
    assert "ranged_lines" not in seen._jdf.queryExecution().executedPlan().toString()
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_checksums_of_large_files(spark, tmp_path):
    """A file larger than a cell may be (2 GiB), read in blocks."""
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "ä %20.bin").write_bytes(b"x" * 100_001)
    (tmp_path / "empty").write_bytes(b"")
    packed = gzip.compress(b"as it is")
    (tmp_path / "packed.gz").write_bytes(packed)
    size = (1 << 31) + 12_345
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)  # holes: no room on disk
    zeros, digest = bytes(1 << 20), hashlib.sha256()
    for at in range(0, size, 1 << 20):
        digest.update(zeros[: min(1 << 20, size - at)])
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in audit.checksums(spark, str(tmp_path)).collect()}
    assert got == {"large": (size, digest.hexdigest()), "empty": (0, hashlib.sha256(b"").hexdigest()), "packed.gz": (len(packed), hashlib.sha256(packed).hexdigest()), "ä %20.bin": (100_001, hashlib.sha256(b"x" * 100_001).hexdigest())}
