"""The catalog contract, and catalogs of DataFrames and of Parquet folders."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from nestql.plans.syntax import QueryError


class Catalog:
    """A source of tables. Filters and columns reach it through Catalyst."""

    kind = "catalog"

    def __init__(self, spark: SparkSession, **properties: Any):
        self.spark = spark
        self.properties: dict[str, Any] = {k.lower(): v for k, v in properties.items()}
        #: name -> (lowerer, call, scope) -> Ex
        self.scalar_functions: dict[str, Callable] = {}
        #: name -> (*args, **options) -> DataFrame
        self.table_functions: dict[str, Callable[..., DataFrame]] = {}

    def option(self, options: dict[str, Any], name: str, default: Any = None) -> Any:
        """An option of the statement, else a property of the catalog."""
        return options.get(name, self.properties.get(name, default))

    def table(self, name: list[str], options: dict[str, Any]) -> DataFrame:
        raise QueryError(f"{self.kind} has no tables")

    def tables(self) -> list[str]:
        return []

    def write(self, name: list[str], df: DataFrame, options: dict[str, Any], create: bool) -> None:
        """SELECT INTO (``create``) and INSERT INTO."""
        raise QueryError(f"{self.kind} can't be written")

    def drop(self, name: list[str], lenient: bool) -> None:
        raise QueryError(f"{self.kind} can't drop tables")


class MemoryCatalog(Catalog):
    """DataFrames by name."""

    kind = "memory"

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame] | None = None, **properties: Any):
        super().__init__(spark, **properties)
        self.frames = {k.lower(): v for k, v in (frames or {}).items()}

    def table(self, name, options):
        key = ".".join(name).lower()
        if key not in self.frames:
            raise QueryError(f"No table found with name: {'.'.join(name)}")
        return self.frames[key]

    def tables(self):
        return sorted(self.frames)

    def write(self, name, df, options, create):
        key = ".".join(name).lower()
        if create and key in self.frames:
            raise QueryError(f"Table {'.'.join(name)} already exists")
        if not create and key in self.frames:
            own = self.frames[key]
            df = own.unionByName(df.select(*[df[c].cast(own.schema[c].dataType).alias(c) for c in df.columns]), allowMissingColumns=True)
        self.frames[key] = df

    def drop(self, name, lenient):
        if self.frames.pop(".".join(name).lower(), None) is None and not lenient:
            raise QueryError(f"No table found with name: {'.'.join(name)}")


class ParquetCatalog(Catalog):
    """``<folder>/<name>.parquet`` by name."""

    kind = "parquet"

    def __init__(self, spark: SparkSession, folder: str, **properties: Any):
        super().__init__(spark, **properties)
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def _path(self, name: list[str]) -> str:
        return f"{self.folder}/{'.'.join(name)}.parquet"

    def table(self, name, options):
        key = ".".join(name).lower()
        if key not in self._read:
            self._read[key] = self.spark.read.parquet(self._path([key]))
        return self._read[key]

    def tables(self):
        fs, path = _hadoop(self.spark, self.folder)
        return sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet"))

    def write(self, name, df, options, create):
        self._read.pop(".".join(name).lower(), None)
        df.write.mode("error" if create else "append").parquet(self._path([".".join(name).lower()]))

    def drop(self, name, lenient):
        self._read.pop(".".join(name).lower(), None)
        delete(self.spark, self._path([".".join(name).lower()]), lenient)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str, lenient: bool) -> None:
    """Delete a path in any store that Spark reaches."""
    fs, p = _hadoop(spark, path)
    if not fs.delete(p, True) and not lenient:
        raise QueryError(f"No table found with name: {path}")
