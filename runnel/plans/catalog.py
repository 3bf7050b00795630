"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from runnel.plans import queries_joins, queries_models, queries_python, queries_scores, queries_segments, queries_signal, queries_windows

MODULES = (queries_windows, queries_segments, queries_joins, queries_scores, queries_models, queries_python, queries_signal)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.REGISTRY.sql.items()}
