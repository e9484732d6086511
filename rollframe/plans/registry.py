"""All queries of the core and their SQL."""

from __future__ import annotations

from rollframe.plans import comparison, data, drift, evaluation, streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (drift, evaluation, comparison, data, streams):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
