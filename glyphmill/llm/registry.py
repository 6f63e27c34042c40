"""The package's queries and SQL by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("p1_quality", "p2_near_dups", "p3_boilerplate", "p4_split", "p5_terms", "p6_scan_noise", "p7_tokens", "p8_mixing", "p9_spans")


def _all() -> list:
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict[str, Callable]:
    return {k: f for m in _all() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in _all() for k, f in m.SQL.items()}
