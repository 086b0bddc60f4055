"""Registered queries and, where SQL can say the same, their oracles."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import as_ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The views of one folder of test tables, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a function of Tables under a name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = as_ctes(oracle)
        return f

    return register


def load() -> None:
    """Imports every module that registers queries."""
    from . import registered

    for module in pkgutil.iter_modules(registered.__path__):
        importlib.import_module(f"{registered.__name__}.{module.name}")
