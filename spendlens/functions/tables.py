"""Named tables that are defined on first use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class LazyTables(dict):
    """Table name -> DataFrame; a query that needs two tables does not define the other five."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        super().__init__()
        self._builders = builders

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._builders[name]()
        return self[name]

    def all(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in self._builders}
