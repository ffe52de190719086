"""The catalogue of tables a query product reads: a name, and a lazy DataFrame for it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from skyspine.sources.store import StoredTable


class Tables:
    """Table name -> DataFrame, each resolved on first use."""

    def __init__(self, loaders: Mapping[str, Callable[[], DataFrame]]):
        self._loaders = dict(loaders)
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def from_parquet(cls, spark: SparkSession, paths: Mapping[str, str]) -> "Tables":
        return cls({name: (lambda p=path: spark.read.parquet(p)) for name, path in paths.items()})

    @classmethod
    def from_stored(cls, spark: SparkSession, stored: Mapping[str, "StoredTable"]) -> "Tables":
        """Stored tables as of their newest commit; their folders also hold rows that no longer count."""
        return cls({name: (lambda s=table: s.read(spark)) for name, table in stored.items()})

    @classmethod
    def of(cls, **frames: DataFrame) -> "Tables":
        return cls({name: (lambda f=frame: f) for name, frame in frames.items()})

    def names(self) -> list[str]:
        return sorted(self._loaders)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._loaders[name]()
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._loaders:
            raise AttributeError(name)
        return self[name]
