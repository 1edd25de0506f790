"""The queries of the core and the SQL that checks them."""

from __future__ import annotations

from recall_engine.operators import increments
from recall_engine.queries import catalog, results, search, text


def _books() -> dict:
    return {k: v for book in (catalog.BOOK, text.BOOK, search.BOOK, results.BOOK) for k, v in book.items()}


def queries() -> dict:
    return {"p2_found": increments.p2_found} | {name: run for name, (run, _) in _books().items()}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": increments.P2_SQL} | {name: sql for name, (_, sql) in _books().items() if sql}
