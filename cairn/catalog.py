"""All registered queries and their SQL."""

from __future__ import annotations

from cairn.plans import core, duplicates, titles, watch  # noqa: F401 (these register their queries with the first)


def queries() -> dict:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.SQL)
