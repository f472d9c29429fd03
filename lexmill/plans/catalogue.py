"""Registered queries and the SQL that checks each."""

from __future__ import annotations

from . import document_plans, other_plans, python_plans, review_plans

_ALL = [document_plans.R, other_plans.R, python_plans.R, review_plans.R]
QUERIES = {k: v for r in _ALL for k, v in r.queries.items()}
ORACLES = {k: v for r in _ALL for k, v in r.oracles.items()}
