"""Operators for preparing text as training data. Nothing outside this package imports it."""

from __future__ import annotations

import importlib

_MODULES = ["split", "tokens", "packing", "repetition", "markup", "boilerplate", "neardup", "survivors", "ranking"]


def registries() -> list:
    return [importlib.import_module(f"tidemark.llm.{m}").query for m in _MODULES]
