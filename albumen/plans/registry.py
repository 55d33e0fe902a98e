"""All registered queries and their SQL."""

from __future__ import annotations

from ..fixtures import Library, ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | None = ()):
    """Registers fn(library) under name; sql follows the views' WITH clauses (no clauses where views is None)."""

    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Library(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql if views is None else (ctes(*views) + "\n" + sql if not sql.lstrip().startswith(",") else ctes(*views) + sql)
        return fn

    return put


from . import filter_plans, ingest_plans, maintain_plans, search_plans, stats_plans, vector_plans  # noqa: E402,F401  the modules register themselves
