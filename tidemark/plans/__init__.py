"""Registered queries over the driver tables, and their SQL oracles."""

from __future__ import annotations

from tidemark.plans import evaluation, landmark, relational  # noqa: F401
from tidemark.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
