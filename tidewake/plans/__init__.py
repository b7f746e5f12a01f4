"""Operators bound to the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import ORACLES, QUERIES


def load_all():
    """Import every module of this package once; returns (queries, oracles)."""
    for m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if m != "registry":
            importlib.import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
