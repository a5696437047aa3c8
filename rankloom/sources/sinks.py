"""Sinks: JSON lines, CSV and split tables, committed at once (sources/versioned.py), and small JSON documents; protected paths are refused."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame

from rankloom.sources.versioned import Versioned

#: Folders and files by name that no sink writes, nor anything below them: fixed values.
PROTECTED = ("golden", "benchmark")


def check_path(path: str, protected: tuple[str, ...] = PROTECTED) -> None:
    """Refuses a path that is, or is below, a protected folder: an absolute path, or any part with this name in it."""
    plain = os.path.normpath(path.split("://")[-1].removeprefix("file:"))
    for p in protected:
        if os.path.isabs(p):
            real, top = os.path.realpath(plain), os.path.realpath(p)
            hit = real == top or real.startswith(top.rstrip("/") + "/")
        else:
            hit = any(p in part.lower() for part in plain.split("/"))
        if hit:
            raise PermissionError(f"{path} is protected ({p})")


def write_jsonl(df: DataFrame, path: str, single: bool = False, most: int = 1_000_000, rules: dict[str, Column] | None = None) -> None:
    """JSON lines, put in place as a whole once every row keeps `rules`; `single` gives one file, for at most `most` rows."""
    check_path(path)
    if single and (n := df.count()) > most:
        raise ValueError(f"{n} rows; one file takes {most} at most")
    Versioned(df.sparkSession, path).replace(df.coalesce(1) if single else df, rules, "json", {"ignoreNullFields": "false"})


def write_split(df: DataFrame, path: str, column: str = "split", rules: dict[str, Column] | None = None) -> None:
    check_path(path)
    Versioned(df.sparkSession, path).replace(df, rules, by=[column])


def write_csv(df: DataFrame, path: str, rules: dict[str, Column] | None = None) -> None:
    check_path(path)
    Versioned(df.sparkSession, path).replace(df, rules, "csv", {"header": "true"})


def write_document(path: str, value) -> None:
    """A small JSON document with sorted keys, replaced at once."""
    check_path(path)
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(f.name, path)
