"""The registered queries outside the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from proselab.plans import corpora, exchange, fingerprints, programs, rewrites, scores, services

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (fingerprints, scores, corpora, services, rewrites, programs, exchange):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
