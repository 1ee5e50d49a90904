"""Registered queries: operators applied to the test tables, with equivalent SQL where there is one."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ("scan", "join", "aggregate", "order", "read", "kernel", "stream", "more"):
    import_module(f".{_name}_queries", __name__)

__all__ = ["ORACLES", "QUERIES"]
