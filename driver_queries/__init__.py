"""Queries over the given tables, each beside the same question in plain SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("tabular", "spectral", "sentences", "stores")


def _load() -> None:
    for name in _MODULES:
        import_module(f"driver_queries.{name}")


def all_queries() -> dict:
    from driver_queries.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from driver_queries.registry import ORACLES

    _load()
    return dict(ORACLES)
