"""All queries of the core by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from . import archive, boards, corpus


def queries() -> dict[str, Callable]:
    return {**corpus.QUERIES, **boards.QUERIES, **archive.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**corpus.SQL, **boards.SQL, **archive.SQL}
