"""All queries outside the text subpackage, collected from their modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES: tuple[str, ...] = ("tables", "scores", "rasters", "models", "forecasts")


def queries() -> dict[str, Callable]:
    found: dict[str, Callable] = {}
    for name in MODULES:
        found |= import_module(f"rainweft.plans.{name}").QUERIES
    return found


def oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"rainweft.plans.{name}").ORACLES
    return found
