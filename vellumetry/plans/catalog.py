"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from . import chains, detection, more, office, packages, paging, serving  # noqa: F401  each registers its queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
