"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

from . import bank, mechanisms, more, own, papers, ruled  # noqa: E402, F401
