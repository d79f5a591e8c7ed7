"""Files as tables: JSON, CSV, XML, Parquet, ORC or lines of text, by option or extension."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestql.plans.lower import Ex, text
from nestql.plans.syntax import QueryError
from nestql.sources.base import Catalog, delete


class FilesystemCatalog(Catalog):
    """``fs#"folder/file.json"``. Functions: ``list``, ``file`` and ``contents``."""

    kind = "filesystem"

    def __init__(self, spark: SparkSession, root: str = "", **properties: Any):
        super().__init__(spark, **properties)
        self.root = root.rstrip("/")
        self.table_functions = {"list": self.list, "file": self.file}
        self.scalar_functions = {"contents": self.contents}

    def path(self, name: str) -> str:
        return name if name.startswith("/") or "://" in name or not self.root else f"{self.root}/{name}"

    def format_of(self, path: str, options: dict[str, Any]) -> str:
        named = self.option(options, "format")
        found = str(named or path.rstrip("/").rsplit(".", 1)[-1]).lower()
        return found if found in ("json", "csv", "xml", "parquet", "orc", "txt") else "lines"

    def table(self, name, options):
        path = self.path(".".join(name))
        kind = self.format_of(path, options)
        read = self.spark.read
        if schema := self.option(options, "schema"):
            read = read.schema(schema)
        if kind == "json":
            return read.option("multiLine", bool(self.option(options, "multiline", False))).json(path)
        if kind == "csv":
            sep, headers = self.option(options, "columnseparator", ","), self.option(options, "columnheaders")
            if headers:
                names = [h.strip() for h in headers.split(sep)]
                return read.schema(", ".join(f"`{n}` string" for n in names)).option("sep", sep).csv(path)
            # Everything is a string, so there is no pass to infer types.
            return read.option("sep", sep).option("header", True).csv(path)
        if kind == "xml":
            row = self.option(options, "rowtag") or str(self.option(options, "xmlpath", "row")).rstrip("/").rsplit("/", 1)[-1]
            return read.option("rowTag", row).option("attributePrefix", f"{row}_").format("xml").load(path)
        if kind in ("parquet", "orc"):
            return read.format(kind).load(path)
        return read.text(path).withColumnRenamed("value", "Value")

    def write(self, name, df, options, create):
        path = self.path(".".join(name))
        kind = self.format_of(path, options)
        writer = df.write.mode("error" if create else "append")
        if kind == "csv":
            writer.option("header", True).option("sep", self.option(options, "columnseparator", ",")).csv(path)
        elif kind in ("json", "parquet", "orc"):
            writer.format(kind).save(path)
        elif kind == "xml":
            writer.format("xml").option("rowTag", self.option(options, "rowtag", "row")).save(path)
        else:
            df.select(F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("value")).write.mode("error" if create else "append").text(path)

    def drop(self, name, lenient):
        delete(self.spark, self.path(".".join(name)), lenient)

    def _files(self, path: str, recursive: bool = True) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", bool(recursive)).load(self.path(path))
        # The content isn't read, as it isn't selected.
        name = F.element_at(F.split("path", "/"), -1)
        return files.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def list(self, path: str, recursive: bool = False, **_: Any) -> DataFrame:
        return self._files(path, recursive)

    def file(self, path: str, **_: Any) -> DataFrame:
        return self._files(path)

    def contents(self, lower, node, scope) -> Ex:
        path = lower.session.constant(node.args[0])
        if path is None:
            raise QueryError("contents needs a path")
        row = self.spark.read.text(self.path(path), wholetext=True).first()
        return Ex(text(row["value"] if row else ""), scope, None, constant=True)
