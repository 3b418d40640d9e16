"""Every registered query of the core with its SQL."""

from __future__ import annotations

from . import evaluation, general, more, prep, reports, runs, shapes, show

FLAGSHIP = "a1_score"
_MODULES = [general, evaluation, shapes, prep, reports, show, runs, more]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
