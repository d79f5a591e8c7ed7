"""A session: catalogs, variables, temporary tables, and the statements of scripts."""

from __future__ import annotations

import datetime
import decimal
import itertools
import json
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestql.functions import Functions
from nestql.functions.scalar import type_name
from nestql.plans.lower import Column, Lowerer, Rel, Scope, Source, is_offset, quote, text, walk
from nestql.plans.syntax import Node, QueryError, parse
from nestql.sources.base import Catalog

VERSION = "0.1.0"
#: Rows that a select with self-referring assignments may fold, as they meet in one array.
FOLD_LIMIT = 1_000_000


@dataclass
class Temp:
    df: DataFrame
    indices: list[list[str]] = field(default_factory=list)
    rows: int = 0


@dataclass
class CacheEntry:
    temp: Temp
    expires: float


@dataclass
class Cache:
    """A named cache of temporary tables, with counts of its use."""

    name: str
    entries: dict[str, CacheEntry] = field(default_factory=dict)
    hits: int = 0
    misses: int = 0


def literal_sql(value: Any, t: T.DataType) -> str:
    """A value as a Spark SQL literal of a type."""
    if value is None:
        return f"CAST(NULL AS {t.simpleString()})" if not isinstance(t, T.NullType) else "NULL"
    if is_offset(t):
        return f"named_struct('ts', TIMESTAMP {text(value['ts'].strftime('%Y-%m-%d %H:%M:%S.%f'))}, 'zone', {text(value['zone'])})"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return text(value)
    if isinstance(value, datetime.datetime):
        kind = "TIMESTAMP_NTZ" if isinstance(t, T.TimestampNTZType) else "TIMESTAMP"
        return f"{kind} {text(value.strftime('%Y-%m-%d %H:%M:%S.%f'))}"
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"CAST({text(str(value))} AS {t.simpleString()})" if isinstance(value, float) else f"CAST({value} AS {t.simpleString()})"
    if isinstance(t, T.VariantType):
        return f"parse_json({text(value.toJson())})"
    plain = value.asDict(True) if hasattr(value, "asDict") else [v.asDict(True) if hasattr(v, "asDict") else v for v in value]
    return f"from_json({text(json.dumps(plain, default=str))}, {text(t.simpleString())})"


class Session:
    """Runs scripts. Results are lazy DataFrames, one for each SELECT that returns rows."""

    def __init__(self, spark: SparkSession, catalogs: dict[str, Catalog] | None = None, default: str | None = None):
        self.spark = spark
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.catalogs: dict[str, Catalog] = {k.lower(): v for k, v in (catalogs or {}).items()}
        self.default = (default or next(iter(self.catalogs), None) or "").lower() or None
        self.variables: dict[str, tuple[Any, T.DataType]] = {}
        self.system: dict[str, Any] = {}
        self.temps: dict[str, Temp] = {}
        self.caches: dict[str, Cache] = {}
        self.printed: list[Any] = []
        self.functions = Functions(self)
        self.last: DataFrame | None = None
        self._ids = itertools.count(1)
        self._views: dict[int, tuple[DataFrame, str]] = {}

    # -- what the lowering asks for

    def fresh(self, prefix: str) -> str:
        return f"{prefix}{next(self._ids)}"

    def view(self, df: DataFrame) -> str:
        known = self._views.get(id(df))
        if known is None or known[0] is not df:
            name = f"nestql_{id(self):x}_{next(self._ids)}"
            df.createOrReplaceTempView(name)
            self._views[id(df)] = known = (df, name)
        return known[1]

    def catalog(self, name: str | None) -> Catalog:
        key = (name or self.default or "").lower()
        if key not in self.catalogs:
            raise QueryError(f"No catalog found with alias: {name or ''}")
        return self.catalogs[key]

    def catalogs_for(self, name: str | None) -> list[Catalog]:
        if name is None:
            return [self.catalogs[self.default]] if self.default in self.catalogs else []
        return [] if name.lower() == "sys" else [self.catalog(name)]

    def temp(self, name: str) -> Temp:
        if name.lower() not in self.temps:
            raise QueryError(f"No temporary table found with name #{name}")
        return self.temps[name.lower()]

    def table(self, node: Node) -> DataFrame:
        name = ".".join(node.name)
        if node.temp:
            return self.temp(name).df
        if (node.catalog or "").lower() == "sys":
            return self.system_table(name.lower())
        return self.catalog(node.catalog).table(node.name, self.options(getattr(node, "options", [])))

    def options(self, options: list[tuple[str, Node]]) -> dict[str, Any]:
        return {k: self.constant(v) for k, v in options}

    def join_hint(self, node: Node) -> str:
        """A hint for the right side of a join, named by the table option ``hint``."""
        wanted = next((v.value for k, v in getattr(node, "options", []) if k == "hint" and v.kind == "literal"), None)
        names = {"broadcast": "BROADCAST(r)", "merge": "MERGE(r)", "hash": "SHUFFLE_HASH(r)"}
        return f"/*+ {names[wanted]} */ " if wanted in names else ""

    def variable_sql(self, node: Node) -> tuple[str, T.DataType]:
        if node.system:
            key = node.name.lower()
            if key == "rowcount":
                return str(self.last.count() if self.last is not None else 0), T.IntegerType()
            if key == "version":
                return text(VERSION), T.StringType()
            value = self.system.get(key)
            return literal_sql(value, T.NullType()) if value is None else text(str(value)), T.NullType() if value is None else T.StringType()
        value, t = self.variables.get(node.name.lower(), (None, T.NullType()))
        return literal_sql(value, t), t

    def constant_typed(self, node: Node) -> tuple[Any, T.DataType]:
        if any(n.kind in ("column", "star") for n in walk(node)) and not any(n.kind in ("lambda", "subquery") for n in walk(node)):
            raise QueryError("Expected a constant")
        lower = Lowerer(self)
        ex = lower.ex(node, Scope(lower, []))
        df = self.spark.sql(f"SELECT {ex.sql} AS x")
        return df.first()["x"], df.schema[0].dataType

    def constant(self, node: Node) -> Any:
        """The value of an expression without columns."""
        if node.kind == "literal" and node.type in ("string", "int", "long", "boolean", "null"):
            return node.value
        if node.kind == "variable" and not node.system:
            return self.variables.get(node.name.lower(), (None, None))[0]
        value = self.constant_typed(node)[0]
        return value

    # -- scripts

    def execute(self, script: str, **variables: Any) -> list[DataFrame]:
        """Run a script; the DataFrames of its result sets."""
        for k, v in variables.items():
            self.set_variable(k, v)
        results: list[DataFrame] = []
        self._statements(parse(script), results)
        return results

    def sql(self, script: str, **variables: Any) -> DataFrame:
        """Run a script; its last result set."""
        results = self.execute(script, **variables)
        if not results:
            raise QueryError("The script has no result set")
        return results[-1]

    def set_variable(self, name: str, value: Any) -> None:
        t = self.spark.createDataFrame([(value,)], ["x"]).schema[0].dataType if value is not None else T.NullType()
        self.variables[name.lower()] = (value, t)

    def _statements(self, statements: list[Node], results: list[DataFrame]) -> None:
        for s in statements:
            getattr(self, f"_run_{s.kind}")(s, results)

    def _run_query(self, s: Node, results: list[DataFrame]) -> None:
        select = s.select
        if select.items[0].kind == "assign":
            self._assign(select)
        elif select.into is not None:
            self._into(select)
        else:
            self._give(self.frame(select), results)

    def _give(self, df: DataFrame, results: list[DataFrame]) -> None:
        self.last = df
        results.append(df)

    def frame(self, select: Node) -> DataFrame:
        """The lazy DataFrame of a SELECT."""
        rel = Lowerer(self).query(select)
        return self._visible(rel)

    def _visible(self, rel: Rel) -> DataFrame:
        listed = ", ".join(f"{c.id} AS {quote(c.name)}" for c in rel.columns)
        return self.spark.sql(f"SELECT {listed} FROM ({rel.sql})")

    def _assign(self, select: Node) -> None:
        names = [i.name.lower() for i in select.items]
        refers = any(n.kind == "variable" and n.name.lower() in names for i in select.items for n in walk(i.value))
        lower = Lowerer(self)
        if not refers or select.group:
            df = self._visible(lower.query(select))
            # The last row wins.
            if select.source is None:
                row = df.first()
            else:
                keyed = df.toDF(*[f"v{i}" for i in range(len(names))]) if not select.order else df
                row = (keyed.tail(1) or [None])[0]
            if row is not None:
                for i, name in enumerate(names):
                    self.variables[name] = (row[i], df.schema[i].dataType)
            return
        self._fold(select, names, lower)

    def _fold(self, select: Node, names: list[str], lower: Lowerer) -> None:
        """Assignments that read what the row before assigned: one fold over the rows."""
        rel = lower.source(select.source, None) if select.source is not None else Rel("SELECT 1 AS one", [Source(None, [Column("one", "one", T.IntegerType())])])
        scope = Scope(lower, rel.sources)
        sql = rel.sql
        if select.where is not None:
            sql = f"SELECT * FROM ({sql}) WHERE {lower.condition(select.where, scope)}"
        sorts = [(lower.ex(s.value, scope).sql, s) for s in select.order]
        order = ", ".join(f"{e} {'DESC' if s.down else 'ASC'} NULLS {'LAST' if s.last else 'FIRST'}" for e, s in sorts)
        types = []
        plain = Scope(lower, rel.sources)
        for item in select.items:
            value, t = self.variables.get(item.name.lower(), (None, T.NullType()))
            types.append(lower.ex(item.value, plain).type if isinstance(t, T.NullType) else t)
        columns = rel.columns
        inner = Scope(lower, [Source(s.alias, [Column(c.name, f"r.{c.id}", c.type) for c in s.columns], s.populated) for s in rel.sources])
        # Types are known by now; the analyzer isn't asked about lambda names.
        inner.names = {f"@{n}": (f"acc.v{i}", t) for i, (n, t) in enumerate(zip(names, types, strict=True))}
        steps = []
        for i, item in enumerate(select.items):
            body = lower.ex(item.value, inner).sql
            for j in range(i):
                body = body.replace(f"acc.v{j}", f"({steps[j]})")
            steps.append(body)
        start = ", ".join(f"CAST({literal_sql(*self.variables.get(n, (None, t)))} AS {t.simpleString()}) AS v{i}" for i, (n, t) in enumerate(zip(names, types, strict=True)))
        step = ", ".join(f"CAST({b} AS {t.simpleString()}) AS v{i}" for i, (b, t) in enumerate(zip(steps, types, strict=True)))
        rows = f"SELECT *, row_number() OVER (ORDER BY {order or '1'}) AS n FROM ({sql} LIMIT {FOLD_LIMIT + 1})"
        listed = "struct(n, " + ", ".join(c.id for c in columns) + ")"
        folded = self.spark.sql(f"SELECT count(1) AS n, aggregate(array_sort(collect_list({listed})), struct({start}), (acc, r) -> struct({step})) AS acc FROM ({rows})").first()
        if folded["n"] > FOLD_LIMIT:
            raise QueryError(f"Assignments that refer to themselves take at most {FOLD_LIMIT} rows")
        if folded["n"]:
            for i, (name, t) in enumerate(zip(names, types, strict=True)):
                self.variables[name] = (folded["acc"][i], t)

    def _into(self, select: Node) -> None:
        options = self.options([(k, v) for k, v in select.into_options if k not in ("indices", "cacheprefix")])
        name = ".".join(select.into.name)
        if not select.into.temp:
            self.catalog(select.into.catalog).write(select.into.name, self.frame(select), options, create=True)
            return
        raw = dict(select.into_options)
        prefix = None
        if "cacheprefix" in raw:
            prefix = self.constant(raw["cacheprefix"])
            if prefix is None:
                node = raw["cacheprefix"]
                shown = f"@{node.name}" if node.kind == "variable" else repr(node)
                raise QueryError(f"Cache prefix expression: {shown} evaluated to null")
        ttl = options.get("cachettl")
        if prefix is not None and ttl is None:
            raise QueryError(f"CacheTTL hint is mandatory to enable cache on temporary table: #{name}")
        indices = [list(x) for x in self.constant(raw["indices"])] if "indices" in raw else []
        if ttl is None:
            if name.lower() in self.temps:
                raise QueryError(f"Temporary table #{name} already exists in session")
            self.temps[name.lower()] = self._materialized(select, indices)
            return
        cache = self.caches.setdefault((f"{prefix}." if prefix else "") + name, Cache((f"{prefix}." if prefix else "") + name))
        entry = cache.entries.get(name)
        if entry is not None and entry.expires > time.time():
            cache.hits += 1
        else:
            cache.misses += 1
            seconds = self.spark.sql(f"SELECT {Lowerer(self).ex(Node('call', catalog=None, name='parseduration', args=[Node('literal', value=str(ttl), type='string')], named={}, part=None, distinct=False), Scope(Lowerer(self), [])).sql} AS ms").first()["ms"] / 1000
            if entry is not None:
                entry.temp.df.unpersist()
            entry = cache.entries[name] = CacheEntry(self._materialized(select, indices), time.time() + seconds)
        self.temps[name.lower()] = entry.temp

    def _materialized(self, select: Node, indices: list[list[str]]) -> Temp:
        # Kept by the executors, and computed again from its sources where one is lost.
        df = self.frame(select).persist()
        return Temp(df, indices, df.count())

    def _run_insert(self, s: Node, results: list[DataFrame]) -> None:
        if s.table.temp:
            raise QueryError("INSERT INTO a temporary table is not supported")
        lower = Lowerer(self)
        rel = lower.values(s.source, None, s.columns, None) if s.source.kind == "values" else lower.query(s.source)
        if s.columns and len(s.columns) != len(rel.columns):
            raise QueryError(f"INSERT INTO names {len(s.columns)} columns, but {len(rel.columns)} are given")
        for c, name in zip(rel.columns, s.columns or [c.name for c in rel.columns], strict=True):
            c.name = name
        self.catalog(s.table.catalog).write(s.table.name, self._visible(rel), self.options(s.options), create=False)

    def _run_set(self, s: Node, results: list[DataFrame]) -> None:
        if s.system:
            self.system[s.name.lower()] = self.constant(s.value)
        else:
            self.variables[s.name.lower()] = self.constant_typed(s.value)

    def _run_use(self, s: Node, results: list[DataFrame]) -> None:
        if s.value is None:
            if len(s.name) != 1:
                raise QueryError("USE without a value takes the alias of a catalog")
            self.catalog(s.name[0])
            self.default = s.name[0].lower()
            return
        if len(s.name) < 2:
            raise QueryError("USE with a value takes a property of a catalog")
        self.catalog(s.name[0]).properties[".".join(s.name[1:]).lower()] = self.constant(s.value)

    def _run_if(self, s: Node, results: list[DataFrame]) -> None:
        self._statements(s.then if self.constant(s.condition) is True else s.otherwise, results)

    def _run_print(self, s: Node, results: list[DataFrame]) -> None:
        self.printed.append(self.constant_typed(s.value)[0])

    def _select_of(self, s: Node) -> Node:
        if s.statement.kind != "query":
            raise QueryError(f"{s.kind.upper()} takes a SELECT")
        return s.statement.select

    def _run_describe(self, s: Node, results: list[DataFrame]) -> None:
        df = self.frame(self._select_of(s))
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        self._give(self.spark.createDataFrame([(i, x) for i, x in enumerate(plan.splitlines())], "line int, plan string"), results)

    def _run_analyze(self, s: Node, results: list[DataFrame]) -> None:
        from pyspark.sql import Observation

        seen = Observation("nestql")
        df = self.frame(self._select_of(s)).observe(seen, F.count(F.lit(1)).alias("rows"))
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        took = time.time() - began
        self._run_describe(s, results)
        lines = [(r["line"], r["plan"]) for r in results.pop().collect()]
        lines += [(len(lines), f"rows: {seen.get['rows']}"), (len(lines) + 1, f"seconds: {took:.3f}")]
        self._give(self.spark.createDataFrame(lines, "line int, plan string"), results)

    def _run_drop(self, s: Node, results: list[DataFrame]) -> None:
        name = ".".join(s.table.name)
        if not s.table.temp:
            self.catalog(s.table.catalog).drop(s.table.name, s.lenient)
            return
        temp = self.temps.pop(name.lower(), None)
        if temp is None:
            if not s.lenient:
                raise QueryError(f"No temporary table found with name #{name}")
        elif not any(e.temp is temp for c in self.caches.values() for e in c.entries.values()):
            temp.df.unpersist()

    def _run_show(self, s: Node, results: list[DataFrame]) -> None:
        if s.catalog and s.catalog.lower() != "sys" and s.what in ("tables", "functions"):
            own = self.catalog(s.catalog)
            rows = [(n,) for n in (own.tables() if s.what == "tables" else sorted([*own.scalar_functions, *own.table_functions]))]
            self._give(self.spark.createDataFrame(rows, "name string"), results)
            return
        self._give(self.system_table(s.what), results)

    def _run_cache(self, s: Node, results: list[DataFrame]) -> None:
        if s.type.lower() not in ("temptable", "generic"):
            raise QueryError(f"No such type of cache: {s.type}")
        for name in list(self.caches):
            if s.name is not None and name.lower() != s.name.lower():
                continue
            entries = self.caches[name].entries
            gone = list(entries) if s.action == "remove" or s.key is None else [k for k in [str(self.constant(s.key))] if k in entries]
            for key in gone:
                # A temporary table that a session still holds is computed again where it is read.
                entries.pop(key).temp.df.unpersist()
            if s.action == "remove":
                del self.caches[name]

    # -- system tables

    def system_table(self, name: str) -> DataFrame:
        lower = Lowerer(self)
        if name == "catalogs":
            return self.spark.createDataFrame([(k, v.kind) for k, v in self.catalogs.items()], "alias string, name string")
        if name == "functions":
            return self.spark.createDataFrame(self.functions.names(), "name string, type string")
        if name == "tables":
            rows = [
                (n, ", ".join(f"{f.name} ({type_name(lower, f.dataType)})" for f in t.df.schema), ", ".join(f"ALL: [{', '.join(i)}]" for i in t.indices) or None, t.rows)
                for n, t in self.temps.items()
            ]
            return self.spark.createDataFrame(rows, "name string, schema string, indices string, rows long")
        if name == "variables":
            rows = [(k, None if v is None else str(v)) for k, (v, _) in self.variables.items()]
            return self.spark.createDataFrame(rows, "name string, value string")
        if name == "caches":
            rows = [
                (c.name, len(c.entries), c.hits, c.hits / max(1, c.hits + c.misses), c.misses, c.misses / max(1, c.hits + c.misses), "TEMPTABLE", "")
                for c in self.caches.values()
            ]
            return self.spark.createDataFrame(rows, "name string, size int, hits int, hit_ratio double, misses int, miss_ratio double, type string, provider string")
        if name == "cachekeys":
            rows = [(c.name, k, datetime.datetime.fromtimestamp(e.expires, datetime.UTC), "TEMPTABLE", "") for c in self.caches.values() for k, e in c.entries.items()]
            return self.spark.createDataFrame(rows, "name string, key string, expire_time timestamp, type string, provider string")
        raise QueryError(f"No system table named: {name}")
