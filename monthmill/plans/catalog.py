"""Imports every plan module so that the registry is complete."""

from __future__ import annotations

import importlib

from monthmill.plans.registry import ORACLES, QUERIES

MODULES = [
    "models", "facts", "scoring", "selection", "scored", "reconciling", "catalogued", "intake", "pooled", "streams",
]

for _name in MODULES:
    importlib.import_module(f"monthmill.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
