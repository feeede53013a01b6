"""The library's queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries have the name {f.__name__}")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from chronolex.plans import audit_queries, batch_queries, cue_queries, folded_queries, layout_queries, live_queries, metric_queries, scalar_queries, signal_queries, speaker_queries, stream_queries, text_queries, word_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
