"""All registered queries, the operators each covers, and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Registers fn(spark, sf_dir); covers: ids of the operator inventory."""

    def add(fn):
        QUERIES[name], COVERS[name] = fn, covers.split()
        if sql:
            SQL[name] = sql
        return fn

    return add


from rankloom.plans import evaluation_queries, panel_queries, profile_queries, rule_queries, split_queries  # noqa: E402, F401
