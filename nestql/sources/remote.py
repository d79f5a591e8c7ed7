"""Catalogs of remote services: JDBC, Kafka, HTTP and Elasticsearch.

JDBC and Kafka are Spark's own connectors with the dialect's options; filters,
columns and limits reach the database through Catalyst. HTTP and Elasticsearch are
requested by executors, one request for each row of keys, in Arrow batches.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestql.plans.syntax import QueryError
from nestql.sources.base import Catalog


class JdbcCatalog(Catalog):
    """Tables of a database; ``query('raw sql')``; system tables by ``information_schema``."""

    kind = "jdbc"

    def __init__(self, spark, url: str, **properties: Any):
        super().__init__(spark, **properties)
        self.url = url
        self.table_functions = {"query": self.query}

    def _reader(self, options: dict[str, Any]):
        read = self.spark.read.format("jdbc").option("url", self.url).option("pushDownPredicate", True).option("pushDownLimit", True).option("pushDownOffset", True)
        for name in ("user", "password", "driver", "fetchsize", "partitioncolumn", "lowerbound", "upperbound", "numpartitions", "querytimeout"):
            if (value := self.option(options, name)) is not None:
                read = read.option(name, value)
        return read

    def table(self, name, options):
        return self._reader(options).option("dbtable", ".".join(name)).load()

    def query(self, sql: str, **options: Any) -> DataFrame:
        return self._reader(options).option("query", sql).load()

    def write(self, name, df, options, create):
        writer = df.write.format("jdbc").option("url", self.url).option("dbtable", ".".join(name)).mode("error" if create else "append")
        for key in ("user", "password", "driver", "batchsize", "isolationlevel"):
            if (value := self.option(options, key)) is not None:
                writer = writer.option(key, value)
        writer.save()

    def tables(self):
        return [r[0] for r in self.query("SELECT table_name FROM information_schema.tables").collect()]


def kafka_options(topic: str, options: dict[str, Any]) -> dict[str, str]:
    """The dialect's topic options as those of Spark's Kafka source."""
    out = {"subscribe": topic, "failOnDataLoss": "true" if options.get("on_error", "fail") == "fail" else "false"}
    streaming = options.get("mode", "batch") == "stream"
    if streaming and options.get("sort_order") == "newest":
        raise QueryError("sort_order newest can't be used in mode stream")
    for key, spark in (("start", "starting"), ("end", "ending")):
        value = options.get(key)
        if value is None or streaming and key == "end":
            continue
        if str(value) in ("earliest", "latest") or str(value).startswith("{"):
            out[f"{spark}Offsets"] = str(value)
        elif str(value).isdigit():
            out[f"{spark}Timestamp"] = str(value)
        else:
            out[f"{spark}Timestamp"] = str(int(pd.Timestamp(value, tz="UTC" if pd.Timestamp(value).tz is None else None).timestamp() * 1000))
    if (timeout := options.get("poll_timeout")) is not None:
        out["kafkaConsumer.pollTimeoutMs"] = str(timeout)
    return out


def decoded(df: DataFrame, options: dict[str, Any]) -> DataFrame:
    """The value column by ``format`` (raw, json, avro) and ``on_error`` (fail, skip, null)."""
    kind, on_error = options.get("format", "raw"), options.get("on_error", "fail")
    if kind == "raw":
        return df
    schema = options.get("schema")
    if not schema:
        raise QueryError(f"format {kind} needs the option schema")
    mode = {"mode": "FAILFAST" if on_error == "fail" else "PERMISSIVE"}
    if kind == "json":
        value = F.from_json(F.col("value").cast("string"), schema, mode)
        # A text that is no JSON object gives NULLs only.
        bad = F.try_parse_json(F.col("value").cast("string")).isNull()
    elif kind == "avro":
        from pyspark.sql.avro.functions import from_avro

        value = from_avro(F.col("value"), schema, mode)
        bad = value.isNull()
    else:
        raise QueryError(f"No such format: {kind}")
    df = df.withColumn("_bad", bad & F.col("value").isNotNull()).withColumn("value", F.when(~F.col("_bad"), value) if on_error != "fail" else value)
    return (df.where(~F.col("_bad")) if on_error == "skip" else df).drop("_bad")


class KafkaCatalog(Catalog):
    """``kafka#topic.<name>``: key, value, offset, partition, timestamp, timestampType, headers, topic."""

    kind = "kafka"

    def table(self, name, options):
        if name[0].lower() != "topic" or len(name) < 2:
            raise QueryError("Kafka tables are named topic.<name>")
        merged = {**self.properties, **options}
        reader = self.spark.readStream if merged.get("mode") == "stream" else self.spark.read
        reader = reader.format("kafka").option("kafka.bootstrap.servers", merged.get("bootstrap_servers", "")).option("includeHeaders", True)
        for key, value in kafka_options(".".join(name[1:]), merged).items():
            reader = reader.option(key, value)
        df = decoded(reader.load(), merged)
        if merged.get("sort_order") == "newest" and (count := merged.get("tail_count")):
            df = df.orderBy(F.col("timestamp").desc(), F.col("offset").desc()).limit(int(count))
        return df


PATTERN = re.compile(r"\{\{([^}]+)\}\}")


def fetch(url: str, body: str | None, headers: dict[str, str], timeout: float, fail: bool) -> tuple[str, str, dict[str, str]]:
    """Body, content type and headers of a response."""
    request = urllib.request.Request(url, data=body.encode() if body is not None else None, headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.read().decode("utf-8", "replace"), r.headers.get("Content-Type", ""), dict(r.headers.items())
    except urllib.error.HTTPError as e:
        if fail:
            raise
        return e.read().decode("utf-8", "replace"), e.headers.get("Content-Type", ""), dict(e.headers.items())


class HttpCatalog(Catalog):
    """``query(url)``, and ``lookup``: a URL with ``{{field}}`` for each row of keys."""

    kind = "http"

    def __init__(self, spark, **properties: Any):
        super().__init__(spark, **properties)
        self.table_functions = {"query": self.query}

    def _request(self, options: dict[str, Any]) -> tuple[dict[str, str], float, bool]:
        merged = {**self.properties, **options}
        headers = {k[len("header.") :]: str(v) for k, v in merged.items() if k.startswith("header.")}
        return headers, float(merged.get("receivetimeout", 15000)) / 1000, bool(merged.get("failonnon200", True))

    def query(self, url: str, **options: Any) -> DataFrame:
        headers, timeout, fail = self._request(options)
        body, kind, got = fetch(url, options.get("body"), headers, timeout, fail)
        kind = kind or headers.get("Accept", "")
        if "json" in kind:
            data = json.loads(body)
            rows = [json.dumps(x if isinstance(x, dict) else {"Value": x}) for x in (data if isinstance(data, list) else [data])]
            return self.spark.read.json(self.spark.createDataFrame([(r,) for r in rows], "value string").rdd.map(lambda r: r[0]))
        if "csv" in kind:
            import csv
            import io

            names, *rows = list(csv.reader(io.StringIO(body)))
            return self.spark.createDataFrame([tuple([*r, *[None] * len(names)][: len(names)]) for r in rows], ", ".join(f"`{n}` string" for n in names))
        if "xml" in kind:
            from nestql.functions.registry import xml_rows

            names, rows = xml_rows(body, options.get("xmlpath"), None)
            return self.spark.createDataFrame([tuple(str(r.get(n)) if r.get(n) is not None else None for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
        return self.spark.createDataFrame([(body, json.dumps(got))], "body string, headers string")

    def lookup(self, keys: DataFrame, pattern: str, **options: Any) -> DataFrame:
        """``keys`` with ``body`` and ``content_type`` of the URL of each row."""
        headers, timeout, fail = self._request(options)
        fields = PATTERN.findall(pattern)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema) + ", body string, content_type string"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                got = []
                for row in frame.to_dict("records"):
                    url = PATTERN.sub(lambda m: urllib.request.quote(str(row[m[1]]), safe=""), pattern)  # noqa: B023
                    got.append(fetch(url, None, headers, timeout, fail)[:2])
                yield frame.assign(body=[b for b, _ in got], content_type=[c for _, c in got])

        return keys.dropna(subset=fields).mapInPandas(run, schema)


def elastic_query(predicates: list[tuple[str, str, Any]]) -> dict:
    """(field, operator, value) predicates as a query of Elasticsearch."""
    must, must_not = [], []
    for name, op, value in predicates:
        one = {
            "=": lambda n=name, v=value: {"term": {n: v}}, "!=": lambda n=name, v=value: {"term": {n: v}}, "in": lambda n=name, v=value: {"terms": {n: list(v)}},
            "like": lambda n=name, v=value: {"wildcard": {n: v.replace("%", "*").replace("_", "?")}}, "exists": lambda n=name: {"exists": {"field": n}},
            "missing": lambda n=name: {"exists": {"field": n}}, "match": lambda n=name, v=value: {"match": {n: v}}, "query": lambda v=value: {"query_string": {"query": v}},
            "<": lambda n=name, v=value: {"range": {n: {"lt": v}}}, "<=": lambda n=name, v=value: {"range": {n: {"lte": v}}},
            ">": lambda n=name, v=value: {"range": {n: {"gt": v}}}, ">=": lambda n=name, v=value: {"range": {n: {"gte": v}}},
        }
        if op not in one:
            raise QueryError(f"No such predicate: {op}")
        (must_not if op in ("!=", "missing") else must).append(one[op]())
    return {"query": {"bool": {k: v for k, v in (("filter", must), ("must_not", must_not)) if v}}}


def render_template(template: str, parameters: dict[str, Any]) -> str:
    """``{{name}}`` replaced by parameters, in JSON where they are no strings."""
    return PATTERN.sub(lambda m: (v if isinstance(v := parameters.get(m[1].strip()), str) else json.dumps(v)), template)


class ElasticCatalog(Catalog):
    """``search(index, body)`` with all pages by scroll, and ``cat(what)``."""

    kind = "elastic"

    def __init__(self, spark, endpoint: str, **properties: Any):
        super().__init__(spark, **properties)
        self.endpoint = endpoint.rstrip("/")
        self.table_functions = {"search": self.search, "cat": self.cat}

    def _post(self, path: str, body: dict) -> dict:
        return json.loads(fetch(f"{self.endpoint}/{path}", json.dumps(body), {"Content-Type": "application/json"}, 15, True)[0])

    def search(self, index: str, body: str | None = None, **_: Any) -> DataFrame:
        got = self._post(f"{index}/_search?scroll=2m&size=1000", json.loads(body) if body else {"query": {"match_all": {}}})
        rows: list[str] = []
        while hits := got["hits"]["hits"]:
            rows += [json.dumps({"__id": h["_id"], "__index": h["_index"], **h["_source"]}) for h in hits]
            got = self._post("_search/scroll", {"scroll": "2m", "scroll_id": got["_scroll_id"]})
        texts = self.spark.createDataFrame([(r,) for r in rows], "value string")
        return self.spark.read.json(texts.rdd.map(lambda r: r[0]))

    def table(self, name, options):
        return self.search(".".join(name), options.get("body"))

    def cat(self, what: str, **_: Any) -> DataFrame:
        rows = json.loads(fetch(f"{self.endpoint}/_cat/{what}?format=json", None, {}, 15, True)[0])
        return self.spark.createDataFrame(pd.DataFrame(rows))
