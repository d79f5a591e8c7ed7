"""Finding functions: scalar, aggregate, table-valued, and those of FOR."""

from __future__ import annotations

import csv
import inspect
import io
import json
import uuid
from collections.abc import Callable
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import types as T
from pyspark.sql.functions import udf

from nestql.functions import scalar as scalars
from nestql.plans.lower import Column, Ex, Lowerer, Rel, Scope, Source, quote, text
from nestql.plans.syntax import Node, QueryError


class Functions:
    """The functions of a session; catalogs can add their own."""

    def __init__(self, session):
        self.session = session
        self.own_scalars: dict[str, Callable] = {}
        self.own_aggregates: dict[str, Callable] = {}
        self.own_tables: dict[str, Callable] = {}
        self.own_operators: dict[str, Callable] = {}

    def names(self) -> list[tuple[str, str]]:
        out = [(n, "AGGREGATE" if n in AGGREGATE else "SCALAR") for n in scalars.TABLE]
        out += [(n, "TABLE") for n in TABLES] + [(n, "OPERATOR") for n in OPERATORS]
        out += [(n, "SCALAR") for n in self.own_scalars] + [(n, "TABLE") for n in self.own_tables]
        out += [(n, "AGGREGATE") for n in self.own_aggregates] + [(n, "OPERATOR") for n in self.own_operators]
        return sorted(set(out))

    # -- scalar

    def scalar(self, node: Node) -> Callable:
        for catalog in self.session.catalogs_for(node.catalog):
            if node.name in catalog.scalar_functions:
                return lambda lower, n, scope: catalog.scalar_functions[node.name](lower, n, scope)
        if node.name in self.own_scalars:
            return self.own_scalars[node.name]
        if node.name not in scalars.TABLE:
            raise QueryError(f"No function found named: {node.name}")
        if node.named:
            raise QueryError(f"{node.name} takes no named arguments")
        fn, least, most = scalars.TABLE[node.name]
        if not least <= len(node.args) <= most:
            raise QueryError(f"{node.name} takes {least if least == most else f'{least} or more'} arguments, not {len(node.args)}")
        return fn

    def register_udf(self, name: str, udf, return_type: T.DataType) -> None:
        """A Spark or pandas UDF under a name of the dialect."""
        spark_name = f"nestql_{name.lower()}"
        self.session.spark.udf.register(spark_name, udf)
        self.own_scalars[name.lower()] = lambda lower, n, scope: Ex(
            f"{spark_name}({', '.join(lower.ex(a, scope).sql for a in n.args)})", scope, return_type
        )

    def register_udtf(self, name: str, udtf) -> None:
        """A Python UDTF under a name of the dialect."""
        spark_name = f"nestql_{name.lower()}"
        self.session.spark.udtf.register(spark_name, udtf)

        def scan(lower: Lowerer, node: Node, scope: Scope) -> Rel:
            args = ", ".join(lower.ex(a, scope).sql for a in node.call.args)
            return lower.renamed(lower.spark.sql(f"SELECT * FROM {spark_name}({args})"), node.alias)

        self.own_tables[name.lower()] = scan

    # -- aggregate

    def is_aggregate(self, name: str) -> bool:
        return name in AGGREGATE or name in self.own_aggregates

    def aggregate(self, name: str) -> Callable:
        return self.own_aggregates.get(name) or AGGREGATE[name]

    def register_aggregate(self, name: str, udf, return_type: T.DataType) -> None:
        """A grouped pandas UDF (Series to a value) under a name of the dialect.

        Spark doesn't mix such UDFs with built-in aggregates, nor with arrays of non-key columns, in one SELECT.
        """
        spark_name = f"nestql_{name.lower()}"
        self.session.spark.udf.register(spark_name, udf)

        def build(lower: Lowerer, node: Node, scope: Scope) -> Ex:
            if node.distinct or node.named:
                raise QueryError(f"{node.name} takes neither DISTINCT nor named arguments")
            return Ex(f"{spark_name}({', '.join(lower.ex(a, scope).sql for a in node.args)})", scope, return_type)

        self.own_aggregates[name.lower()] = build

    def operator(self, name: str) -> Callable:
        found = self.own_operators.get(name) or OPERATORS.get(name)
        if found is None:
            raise QueryError(f"No operator function found named: {name}")
        return found

    def register_operator(self, name: str, result: str, result_type: Callable[[T.StructType], T.DataType]) -> None:
        """A function of FOR. ``result`` is SQL of the result, with ``{}`` where the array of rows goes."""

        def build(columns: list[Column]) -> tuple[str, str, T.DataType]:
            sql, t = _row(columns)
            return sql, result, result_type(t)

        self.own_operators[name.lower()] = build

    # -- table-valued

    def scan(self, lower: Lowerer, node: Node, parent: Scope | None) -> Rel:
        scope = parent or Scope(lower, [])
        name = node.call.name
        for catalog in self.session.catalogs_for(node.call.catalog):
            if name in catalog.table_functions:
                args = [self.session.constant(a) for a in node.call.args]
                made = self._bound(name, catalog.table_functions[name], args, {k: self.session.constant(v) for k, v in node.call.named.items()}, self.session.options(node.options))
                return lower.renamed(made, node.alias)
        if name in self.own_tables:
            return self.own_tables[name](lower, node, scope)
        if name not in TABLES:
            raise QueryError(f"No table function found named: {name}")
        if node.call.named:
            raise QueryError(f"{name} takes no named arguments")
        return TABLES[name](lower, node, scope, self.session.options(node.options))


    def _bound(self, name: str, function: Callable, args: list, named: dict, options: dict) -> Any:
        """Calls a catalog's function with arguments by place and by name."""
        known = [p for p in inspect.signature(function).parameters.values() if p.kind is p.POSITIONAL_OR_KEYWORD]
        by_name = {p.name.lower(): p.name for p in known}
        for key in named:
            if key not in by_name:
                raise QueryError(f"{name} has no argument named: {key}")
        given = {p.name: a for p, a in zip(known, args, strict=False)}
        if len(args) > len(known) or given.keys() & {by_name[k] for k in named}:
            raise QueryError(f"{name} got an argument twice or too many of them")
        given |= {by_name[k]: v for k, v in named.items()}
        missing = [p.name for p in known if p.default is p.empty and p.name not in given]
        if missing:
            raise QueryError(f"{name} needs the argument: {missing[0]}")
        return function(**given, **{k: v for k, v in options.items() if k not in given})


def _plain(fn: str, as_type: bool = False):
    def build(lower: Lowerer, node: Node, scope: Scope) -> Ex:
        if node.distinct:
            raise QueryError(f"{node.name} doesn't take DISTINCT")
        if len(node.args) != 1:
            raise QueryError(f"{node.name} takes 1 argument")
        ex = lower.ex(node.args[0], scope)
        kind = ex.kind
        if fn == "avg" and kind in ("int", "bigint"):
            return Ex(f"CAST(sum({ex.sql}) DIV count({ex.sql}) AS {kind})", scope, ex.type)
        return Ex(f"CAST({fn}({ex.sql}) AS {kind})" if as_type and kind != "void" else f"{fn}({ex.sql})", scope, ex.type)

    return build


def _count(lower: Lowerer, node: Node, scope: Scope) -> Ex:
    if node.distinct:
        raise QueryError("count doesn't take DISTINCT")
    if len(node.args) != 1:
        raise QueryError("count takes 1 argument")
    arg = node.args[0]
    sql = "1" if arg.kind in ("star", "literal") else lower.ex(arg, scope).sql
    return Ex(f"CAST(count({sql}) AS INT)", scope, T.IntegerType())


def _string_agg(lower: Lowerer, node: Node, scope: Scope) -> Ex:
    if node.distinct or len(node.args) != 2:
        raise QueryError("string_agg takes a value and a delimiter")
    if node.args[1].kind not in ("literal", "variable"):
        raise QueryError("The delimiter of string_agg must be constant")
    value, sep = (lower.as_string(lower.ex(a, scope)) for a in node.args)
    return Ex(f"(CASE WHEN count({value}) > 0 THEN array_join(collect_list({value}), {sep}) END)", scope, T.StringType())


def _array(lower: Lowerer, node: Node, scope: Scope) -> Ex:
    inner = scalars.array(lower, node, scope)
    return Ex(f"flatten(transform(collect_list(struct({inner.sql} AS v)), x -> x.v))", scope, inner.type)


def _object(lower: Lowerer, node: Node, scope: Scope) -> Ex:
    sql = scalars.object_sql(lower, node, scope)
    return Ex(f"first({sql})", scope)


def _object_array(lower: Lowerer, node: Node, scope: Scope) -> Ex:
    return Ex(f"collect_list({scalars.object_sql(lower, node, scope)})", scope)


AGGREGATE = {
    "count": _count, "sum": _plain("sum", True), "avg": _plain("avg", True), "min": _plain("min"), "max": _plain("max"),
    "string_agg": _string_agg, "array": _array, "object": _object, "object_array": _object_array,
}


# -- FOR


def _row(columns: list[Column]) -> tuple[str, T.DataType]:
    packed = ", ".join(f"{c.id} AS {quote(c.name)}" for c in columns)
    return f"struct({packed})", T.StructType([T.StructField(c.name, c.type) for c in columns])


def _for_object(columns: list[Column]) -> tuple[str, str, T.DataType]:
    """SQL of a row, of the result made of the rows' array, and the result's type."""
    sql, t = _row(columns)
    return sql, "get({}, 0)", t


def _for_object_array(columns: list[Column]) -> tuple[str, str, T.DataType]:
    sql, t = _row(columns)
    return sql, "{}", T.ArrayType(t)


def _for_array(columns: list[Column]) -> tuple[str, str, T.DataType]:
    if len({c.type.simpleString() for c in columns}) > 1:
        values, t = ", ".join(f"CAST({c.id} AS VARIANT)" for c in columns), T.VariantType()
    else:
        values, t = ", ".join(c.id for c in columns), columns[0].type
    return f"array({values})", "flatten({})", T.ArrayType(t)


OPERATORS = {"object": _for_object, "object_array": _for_object_array, "array": _for_array}


# -- table-valued functions


def _range(lower: Lowerer, node: Node, scope: Scope, options: dict) -> Rel:
    args = [lower.ex(a, scope) for a in node.call.args]
    if not 1 <= len(args) <= 2:
        raise QueryError("range takes 1 or 2 arguments")
    if any(e.kind == "void" for e in args):
        raise QueryError("range doesn't take NULL")
    lo, hi = ("0", args[0].sql) if len(args) == 1 else (args[0].sql, args[1].sql)
    column = Column("Value", lower.fresh(), T.IntegerType())
    if all(e.constant for e in args):
        sql = f"SELECT CAST(id AS INT) AS {column.id} FROM range(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT))"
    else:
        values = f"CASE WHEN {hi} > {lo} THEN sequence(CAST({lo} AS INT), CAST({hi} AS INT) - 1) END"
        sql = f"SELECT explode({values}) AS {column.id}"
    return Rel(sql, [Source(node.alias, [column])])


def _string_split(lower: Lowerer, node: Node, scope: Scope, options: dict) -> Rel:
    if len(node.call.args) != 2:
        raise QueryError("string_split takes 2 arguments")
    ordinal, value = Column("Ordinal", lower.fresh(), T.IntegerType()), Column("Value", lower.fresh(), T.StringType())
    sql = f"SELECT posexplode({scalars.split_sql(lower, node.call, scope)}) AS ({ordinal.id}, {value.id})"
    return Rel(sql, [Source(node.alias, [value, ordinal])])


def _constant_text(lower: Lowerer, node: Node) -> tuple[bool, str | None]:
    try:
        value = lower.session.constant(node.call.args[0])
    except QueryError:
        return False, None
    return True, value


def _at(value, pointer: str):
    for part in pointer.strip("/").split("/") if pointer.strip("/") else ():
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, list):
            value = value[int(part)] if part.isdigit() and int(part) < len(value) else None
        else:
            value = value.get(part) if isinstance(value, dict) else None
    return value


def _openjson(lower: Lowerer, node: Node, scope: Scope, options: dict) -> Rel:
    """Rows of a JSON text: an object is one, an array of objects as many; scalars are ``Value``.

    Of a constant, the schema is read from it. Of a column it is the option
    ``schema``, or found by one pass over the left side.
    """
    pointer = options.get("jsonpath") or ""
    constant, value = _constant_text(lower, node)
    if constant:
        if value is None:
            return Rel("SELECT 1 AS one WHERE FALSE", [Source(node.alias, [])])
        data = _at(json.loads(value), pointer)
        rows = data if isinstance(data, list) else [] if data is None else [data]
        rows = [r if isinstance(r, dict) else {"Value": r} for r in rows]
        lines = text(json.dumps(rows))
        keys = list(dict.fromkeys(k for r in rows for k in r))
        if not keys:
            return Rel("SELECT 1 AS one WHERE FALSE", [Source(node.alias, [])])
        schema = lower.spark.sql(f"SELECT schema_of_json({lines}) AS s").first()["s"]
        rel = lower.rows_of(Ex(f"from_json({lines}, {text(schema)})", scope), node.alias)
        rel.sources[0].columns = sorted(rel.sources[0].columns, key=lambda c: keys.index(c.name))
        return rel
    sql = lower.as_string(lower.ex(node.call.args[0], scope))
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in pointer.strip("/").split("/") if p)
    if path != "$":
        sql = f"get_json_object({sql}, {text(path)})"
    whole = f"(CASE WHEN startswith(ltrim({sql}), '[') THEN {sql} WHEN {sql} IS NOT NULL THEN concat('[', {sql}, ']') END)"
    schema = options.get("schema")
    if schema:
        schema = f"array<struct<{schema}>>"
    elif lower.left_of_apply is not None:
        found = lower.spark.sql(f"SELECT schema_of_variant_agg(try_parse_json({whole})) AS s FROM ({lower.left_of_apply})").first()["s"]
        schema = found.replace("OBJECT<", "STRUCT<")
    else:
        raise QueryError("openjson of a column needs the option schema")
    return lower.rows_of(Ex(f"from_json({whole}, {text(schema)})", scope), node.alias)


def _opencsv(lower: Lowerer, node: Node, scope: Scope, options: dict) -> Rel:
    """Rows of a CSV text, all strings; the header is the first line or an option."""
    sep = options.get("columnseparator") or ","
    headers = options.get("columnheaders")
    names = next(csv.reader([headers], delimiter=sep)) if headers else None
    constant, value = _constant_text(lower, node)
    if constant:
        lines = [r for r in csv.reader(io.StringIO(value or ""), delimiter=sep) if r]
        if names is None:
            names, lines = (lines[0], lines[1:]) if lines else ([], [])
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        rows = [tuple([*r, *[None] * len(names)][: len(names)]) for r in lines]
        return lower.renamed(lower.spark.createDataFrame(rows, schema), node.alias)
    if names is None:
        raise QueryError("opencsv of a column needs the option columnheaders")
    wide = len(names)

    def rows_of(value: str | None) -> list | None:
        return None if value is None else [tuple([*r, *[None] * wide][:wide]) for r in csv.reader(io.StringIO(value), delimiter=sep) if r]

    return _python_rows(lower, node, scope, rows_of, names)


def _python_rows(lower: Lowerer, node: Node, scope: Scope, fn: Callable, names: list[str]) -> Rel:
    """Rows of strings that Python makes of a column's texts, batch by batch."""
    kind = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    name = f"rows_{uuid.uuid4().hex}"
    lower.spark.udf.register(name, udf(fn, kind, useArrow=True))
    return lower.rows_of(Ex(f"{name}({lower.as_string(lower.ex(node.call.args[0], scope))})", scope, kind), node.alias)


def xml_rows(value: str, path: str | None, columns: list[str] | None) -> tuple[list[str], list[dict]]:
    """An element per row: children and attributes as columns, repeated ones as arrays."""
    root = ElementTree.fromstring(value)
    if path:
        parts = [p for p in path.split("/") if p]
        rows = root.findall("./" + "/".join(parts[1:])) if parts and parts[0] == root.tag and len(parts) > 1 else root.findall("./" + "/".join(parts)) if parts and parts[0] != root.tag else [root]
    else:
        rows = list(root)
    nil = "{http://www.w3.org/2001/XMLSchema-instance}nil"
    out, names = [], list(columns or ())
    for element in rows:
        row: dict = {}
        for k, v in element.attrib.items():
            row[f"{element.tag}_{k}"] = v
        for child in element:
            if child.get(nil) == "true":
                got = None
            elif len(child):
                got = ElementTree.tostring(child, encoding="unicode").strip()
            else:
                got = child.text
            if child.tag in row:
                row[child.tag] = [*(row[child.tag] if isinstance(row[child.tag], list) else [row[child.tag]]), got]
            else:
                row[child.tag] = got
            for k, v in child.attrib.items():
                if k != nil:
                    row[f"{child.tag}_{k}"] = v
        if not len(element) and element.text and element.text.strip():
            row[element.tag] = element.text
        out.append(row)
        if not columns:
            names += [k for k in row if k not in names]
    return names, out


def _openxml(lower: Lowerer, node: Node, scope: Scope, options: dict) -> Rel:
    listed = options.get("xmlcolumns")
    columns = [c.strip() for c in listed.split(",")] if isinstance(listed, str) else None
    constant, value = _constant_text(lower, node)
    if constant:
        names, rows = xml_rows(value, options.get("xmlpath"), columns) if value else ([], [])
        many = {n for r in rows for n, v in r.items() if isinstance(v, list)}
        fields = [T.StructField(n, T.ArrayType(T.StringType()) if n in many else T.StringType()) for n in names]
        wrap = lambda v: v if v is None or isinstance(v, list) else [v]
        data = [tuple(wrap(r.get(n)) if n in many else r.get(n) for n in names) for r in rows]
        return lower.renamed(lower.spark.createDataFrame(data, T.StructType(fields)), node.alias)
    if columns is None or not options.get("xmlpath"):
        raise QueryError("openxml of a column needs the options xmlpath and xmlcolumns")
    path = options["xmlpath"]

    def rows_of(value: str | None) -> list | None:
        if not value:
            return None
        rows = xml_rows(value, path, columns)[1]
        return [tuple(json.dumps(v) if isinstance(v := r.get(c), list) else v for c in columns) for r in rows]

    return _python_rows(lower, node, scope, rows_of, columns)


def _open_table(lower: Lowerer, node: Node, scope: Scope, options: dict) -> Rel:
    return lower.rows_of(lower.ex(node.call.args[0], scope), node.alias)


TABLES = {
    "range": _range, "string_split": _string_split, "openjson": _openjson, "opencsv": _opencsv, "openxml": _openxml, "open_table": _open_table,
    "totable": lambda lower, node, scope, options: lower.rows_of(lower.ex(node.call, scope), node.alias),
}
