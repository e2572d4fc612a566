"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    covers: tuple[str, ...]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None):
    """Register a query; `covers` lists the operator ids it exercises."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, fn, tuple(covers.split()), oracle)
        return fn

    return wrap


def load_all() -> dict[str, Query]:
    """Import every query module and return the registry."""
    import importlib
    import pkgutil

    import rxloom.plans as plans

    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"rxloom.plans.{module.name}")

    return REGISTRY
