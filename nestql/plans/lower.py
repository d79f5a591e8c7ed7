"""Syntax trees to Spark SQL.

Every source column gets a name of its own (``c12``), so that nested, lateral and
self joins never clash; visible names return in the outermost projection. What
Catalyst gets is one declarative query: it pushes filters, prunes columns,
decorrelates the lateral joins and picks the joins.

Types are needed where the dialect differs from Spark (integer division, string
concatenation, promotion). Where the text doesn't tell a type, Spark's analyzer is
asked, on a stub of the scope without data.
"""

from __future__ import annotations

from pyspark.sql import types as T

from nestql.plans.syntax import Node, ParseError, QueryError

#: Types by rising precedence; the lower operand is cast to the higher.
PRECEDENCE = ("string", "boolean", "int", "bigint", "decimal(38,6)", "float", "double", "timestamp_ntz")
CASTS = {
    "string": "string", "boolean": "boolean", "bool": "boolean", "int": "int", "integer": "int", "long": "bigint", "decimal": "decimal(38,6)",
    "float": "float", "double": "double", "datetime": "timestamp_ntz", "datetimeoffset": "datetimeoffset", "array": "array",
}
OFFSET_TYPE = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("zone", T.StringType())])
#: Aggregates that can't stand in another.
NOT_NESTED = frozenset("count sum avg min max string_agg object_array".split())


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(t: T.DataType | None) -> str:
    """The name of a type in PRECEDENCE, or of its family."""
    if isinstance(t, T.DecimalType):
        return "decimal(38,6)"
    if isinstance(t, (T.ShortType, T.ByteType)):
        return "int"
    if isinstance(t, T.NullType) or t is None:
        return "void"
    if is_offset(t):
        return "datetimeoffset"
    return t.simpleString() if isinstance(t, T.AtomicType) else t.typeName()


def is_offset(t: T.DataType | None) -> bool:
    return isinstance(t, T.StructType) and t.names == ["ts", "zone"]


class Ex:
    """A Spark SQL expression; its type is found when asked for."""

    def __init__(self, sql: str, scope: Scope, type_: T.DataType | None = None, constant: bool = False):
        self.sql, self.scope, self._type, self.constant = sql, scope, type_, constant

    @property
    def type(self) -> T.DataType:
        if self._type is None:
            self._type = self.scope.lower.type_of(self.sql, self.scope)
        return self._type

    @property
    def kind(self) -> str:
        return kind_of(self.type)


class Column:
    def __init__(self, name: str, id_: str, type_: T.DataType):
        self.name, self.id, self.type = name, id_, type_


class Source:
    def __init__(self, alias: str | None, columns: list[Column], populated: bool = False):
        self.alias, self.columns, self.populated = alias, columns, populated


class Scope:
    """Sources that an expression sees, those of outer queries, and lambda names."""

    def __init__(self, lower: Lowerer, sources: list[Source], parent: Scope | None = None):
        self.lower, self.sources, self.parent = lower, sources, parent
        self.names: dict[str, tuple[str, T.DataType]] = {}
        self.grouped: Grouping | None = None
        #: Lateral joins that subqueries in the projection ask for; None where there can be none.
        self.laterals: list[str] | None = None

    def child(self, names: dict[str, tuple[str, T.DataType]]) -> Scope:
        out = Scope(self.lower, self.sources, self.parent)
        out.names = {**self.names, **names}
        out.laterals = self.laterals
        return out

    def source(self, alias: str) -> Source | None:
        for s in self.sources:
            if s.alias and s.alias.lower() == alias.lower():
                return s
        return self.parent.source(alias) if self.parent else None

    def column(self, name: str) -> Column | None:
        found = [c for s in self.sources for c in s.columns if c.name.lower() == name.lower()]
        if len(found) > 1:
            raise QueryError(f"Ambiguous column: {name}")
        if found:
            return found[0]
        return self.parent.column(name) if self.parent else None

    def visible(self) -> list[tuple[str, T.DataType]]:
        out = [(c.id, c.type) for s in self.sources for c in s.columns]
        out += [(sql, t) for sql, t in self.names.values()]
        return out + (self.parent.visible() if self.parent else [])


class Grouping:
    """Group keys of an aggregation: their trees and the columns that hold them."""

    def __init__(self, keys: list[tuple[Node, Column]], ids: dict[str, Column]):
        self.keys, self.ids = keys, ids


class Rel:
    def __init__(self, sql: str, sources: list[Source]):
        self.sql, self.sources = sql, sources

    @property
    def columns(self) -> list[Column]:
        return [c for s in self.sources for c in s.columns]


class Lowerer:
    """Lowers the queries of a session."""

    def __init__(self, session):
        self.session = session
        self.spark = session.spark
        self.types: dict[str, T.DataType] = {}
        #: SQL of the left side while the right side of an APPLY is lowered.
        self.left_of_apply: str | None = None

    def fresh(self) -> str:
        return self.session.fresh("c")

    def type_of(self, sql: str, scope: Scope) -> T.DataType:
        seen, parts = set(), []
        for name, t in scope.visible():
            if name not in seen:
                seen.add(name)
                parts.append(f"CAST(NULL AS {t.simpleString()}) AS {name}" if not isinstance(t, T.NullType) else f"NULL AS {name}")
        stub = f"SELECT {sql} AS x FROM (SELECT {', '.join(parts) or '1 AS one'})"
        if stub not in self.types:
            self.types[stub] = self.spark.sql(stub).schema[0].dataType
        return self.types[stub]

    # -- queries

    def query(self, node: Node, parent: Scope | None = None) -> Rel:
        """A SELECT as a relation whose one source has the visible names."""
        if node.kind == "values":
            return self.values(node, None, [], parent)
        select = node
        if select.source is not None:
            rel = self.source(select.source, parent)
        else:
            rel = Rel("SELECT 1 AS one", [])
        scope = Scope(self, rel.sources, parent)
        sql = rel.sql
        if select.where is not None:
            scope.laterals = None
            sql = f"SELECT * FROM ({sql}) WHERE {self.condition(select.where, scope)}"
        scope.laterals = []
        if select.group:
            return self.finish(select, *self.aggregate(select, sql, scope), scope, parent)
        items = self.items(select.items, scope)
        having = self.condition(select.having, scope) if select.having is not None else None
        sorts = self.sorts(select, items, scope)
        for lateral in scope.laterals:
            sql = f"SELECT * FROM ({sql}) LEFT JOIN LATERAL ({lateral}) ON TRUE"
        if having is not None:
            sql = f"SELECT * FROM ({sql}) WHERE {having}"
        return self.finish(select, sql, items, sorts, scope, parent)

    def finish(self, select: Node, sql: str, items: list, sorts: list, scope: Scope, parent: Scope | None) -> Rel:
        """Projection, DISTINCT, ORDER BY, TOP and FOR above what was read."""
        columns = [Column(name, self.fresh(), ex.type) for name, ex in items]
        outputs = [f"{ex.sql} AS {c.id}" for c, (_, ex) in zip(columns, items, strict=True)]
        order = []
        for sort, place, ex in sorts:
            if place is not None:
                name = columns[place].id
            elif select.distinct:
                raise QueryError("With DISTINCT, ORDER BY must name selected items")
            else:
                name = self.fresh()
                outputs.append(f"{ex.sql} AS {name}")
            order.append(f"{name} {'DESC' if sort.down else 'ASC'} NULLS {'LAST' if sort.last else 'FIRST'}")
        distinct = "DISTINCT " if select.distinct else ""
        sql = f"SELECT {distinct}{', '.join(outputs)} FROM ({sql})"
        limit = ""
        if select.top is not None:
            count = self.session.constant(select.top)
            if count is None or int(count) < 0:
                raise QueryError("TOP needs a number of 0 or more")
            limit = f" LIMIT {int(count)}"
        if select.shape:
            if limit:
                sql = f"SELECT * FROM ({sql}){f' ORDER BY {chr(44).join(order)}' if order else ''}{limit}"
            return self.shaped(select.shape, sql, columns, order)
        listed = ", ".join(c.id for c in columns)
        if order and limit:
            # At one level and over all columns: Catalyst ranks the rows of each outer row by the sort right below the limit, else by nothing.
            sql = f"SELECT {listed} FROM (SELECT * FROM ({sql}) ORDER BY {', '.join(order)}{limit})"
        elif order:
            sql = f"SELECT {listed} FROM ({sql}) ORDER BY {', '.join(order)}"
        elif limit:
            sql = f"SELECT * FROM ({sql}){limit}"
        return Rel(sql, [Source(None, columns)])

    def shaped(self, shape: str, sql: str, columns: list[Column], order: list[str]) -> Rel:
        """FOR: the whole result as one value, NULL where there are no rows.

        The rows of an aggregate have no order of their own, so with an ORDER BY
        they are sorted in the array.
        """
        row, finish, type_ = self.session.functions.operator(shape)(columns)
        collected = f"collect_list({row})"
        if order:
            keys = [o.split(" ") for o in order]
            packed = ", ".join(k[0] for k in keys)
            less = "0"
            for name, way, _, nulls in reversed(keys):
                first, down = nulls == "FIRST", way == "DESC"
                less = (
                    f"CASE WHEN l.{name} <=> r.{name} THEN {less} WHEN l.{name} IS NULL THEN {-1 if first else 1} WHEN r.{name} IS NULL THEN {1 if first else -1}"
                    f" WHEN l.{name} < r.{name} THEN {1 if down else -1} ELSE {-1 if down else 1} END"
                )
            collected = f"transform(array_sort(collect_list(struct({packed}, {row} AS value)), (l, r) -> {less}), x -> x.value)"
        id_ = self.fresh()
        out = f"SELECT CASE WHEN count(1) > 0 THEN {finish.format(collected)} END AS {id_} FROM ({sql})"
        return Rel(out, [Source(None, [Column("output", id_, type_)])])

    def items(self, items: list[Node], scope: Scope) -> list[tuple[str, Ex]]:
        out = []
        for item in items:
            if item.kind == "star":
                out += self.star(item, scope)
            elif item.kind == "assign":
                out.append((item.name, self.ex(item.value, scope)))
            else:
                out.append((item.alias or self.implied_name(item), self.ex(item.value, scope)))
        return out

    @staticmethod
    def implied_name(item: Node) -> str:
        v = item.value
        if v.kind in ("column", "field"):
            return v.name
        return item.text

    def star(self, item: Node, scope: Scope) -> list[tuple[str, Ex]]:
        sources = scope.sources
        if item.alias:
            own = next((s for s in sources if s.alias and s.alias.lower() == item.alias.lower()), None)
            if own is None:
                raise QueryError(f"No source with alias: {item.alias}")
            sources = [own]
        if not any(s.columns for s in sources):
            raise QueryError("Nothing to expand *")
        return [(c.name, Ex(c.id, scope, c.type)) for s in sources for c in s.columns]

    def sorts(self, select: Node, items: list[tuple[str, Ex]], scope: Scope) -> list:
        out = []
        for sort in select.order:
            v = sort.value
            if v.kind == "literal" and v.type == "int":
                if not 1 <= v.value <= len(items):
                    raise QueryError(f"ORDER BY position is out of range: {v.value}")
                out.append((sort, v.value - 1, None))
                continue
            if v.kind in ("literal", "variable"):
                raise QueryError("ORDER BY can't be a constant")
            place = None
            if v.kind == "column":
                place = next((i for i, (n, _) in enumerate(items) if n.lower() == v.name.lower()), None)
            if place is None:
                place = next((i for i, x in enumerate(select.items) if x.kind == "item" and x.value == v and not any(y.kind == "star" for y in select.items)), None)
            out.append((sort, place, None if place is not None else self.ex(v, scope)))
        return out

    def condition(self, node: Node, scope: Scope) -> str:
        return self.ex(node, scope).sql

    # -- aggregation

    def aggregate(self, select: Node, sql: str, scope: Scope) -> tuple[str, list, list]:
        keys, ids, outputs = [], {}, []
        for key in select.group:
            if key.kind == "literal":
                ex = self.ex(key, scope)
            else:
                ex = self.ex(key, scope)
                if any(n.kind == "call" and self.session.functions.is_aggregate(n.name) for n in walk(key)):
                    raise QueryError("GROUP BY can't hold aggregates")
            column = Column(key.name if key.kind in ("column", "field") else "", self.fresh(), ex.type)
            outputs.append(f"{ex.sql} AS {column.id}")
            keys.append((key, column))
            ids[ex.sql] = column
        base = f"SELECT *, {', '.join(outputs)} FROM ({sql})"
        scope.grouped = Grouping(keys, ids)
        scope.sources = [*scope.sources, Source(None, [Column("\0key", c.id, c.type) for _, c in keys])]
        items = self.items(self.expanded(select.items, scope), scope)
        having = self.condition(select.having, scope) if select.having is not None else None
        sorts = self.sorts(select, items, scope)
        # Aggregates are computed once below, so that DISTINCT, HAVING and sorts refer to columns.
        names, inner = [], []
        for name, ex in items:
            id_ = self.fresh()
            inner.append(f"{ex.sql} AS {id_}")
            names.append((name, Ex(id_, scope, ex.type)))
        ordered = []
        for sort, place, ex in sorts:
            if place is None:
                id_ = self.fresh()
                inner.append(f"{ex.sql} AS {id_}")
                ex = Ex(id_, scope, ex.type)
            ordered.append((sort, place, ex))
        sql = f"SELECT {', '.join(inner)} FROM ({base}) GROUP BY {', '.join(c.id for _, c in keys)}"
        if having is not None:
            sql += f" HAVING {having}"
        return sql, names, ordered

    @staticmethod
    def expanded(items: list[Node], scope: Scope) -> list[Node]:
        out = []
        for item in items:
            if item.kind == "star":
                for s in scope.sources:
                    if s.alias and (not item.alias or s.alias.lower() == item.alias.lower()):
                        out += [Node("item", value=Node("field", value=Node("column", name=s.alias), name=c.name), alias=c.name, text=c.name) for c in s.columns]
            else:
                out.append(item)
        return out

    def in_group(self, node: Node, scope: Scope) -> Ex | None:
        """An expression of a grouped query, or None if it is to be lowered by its parts."""
        grouping = scope.grouped
        for tree, column in grouping.keys:
            if tree == node:
                return Ex(column.id, scope, column.type)
        plain = Scope(self, scope.sources, scope.parent)
        plain.names = scope.names
        if node.kind == "call" and self.session.functions.is_aggregate(node.name):
            for inner in walk(node):
                if inner is not node and inner.kind == "call" and (inner.name in NOT_NESTED or inner.name in self.session.functions.own_aggregates):
                    raise QueryError("Aggregates can't be nested")
            return self.session.functions.aggregate(node.name)(self, node, plain)
        if node.kind in ("literal", "variable") or any(n.kind == "call" and self.session.functions.is_aggregate(n.name) for n in walk(node)):
            return None
        ex = self.ex(node, plain)
        if ex.sql in grouping.ids:
            return Ex(grouping.ids[ex.sql].id, scope, ex.type)
        used = self.columns_of(node, plain)
        if used <= {sql for sql in grouping.ids}:
            # Only keys are used: the same for all rows of a group.
            return Ex(f"any_value({ex.sql})", scope, ex.type)
        # Collecting structs keeps NULLs.
        sql = f"transform(collect_list(struct({ex.sql} AS v)), x -> x.v)"
        return Ex(sql, scope, T.ArrayType(ex.type))

    def columns_of(self, node: Node, scope: Scope) -> set[str]:
        """SQL of the columns that a tree refers to."""
        if node.kind == "column" and node.name.lower() not in scope.names:
            column = scope.column(node.name)
            return {column.id} if column else set()
        if node.kind == "field" and node.value.kind == "column" and node.value.name.lower() not in scope.names:
            if scope.source(node.value.name) is not None:
                return {self.ex(node, scope).sql}
        if node.kind == "lambda":
            inner = scope.child({n.lower(): (n, T.NullType()) for n in node.names})
            return self.columns_of(node.body, inner)
        out: set[str] = set()
        for child in node.children():
            out |= self.columns_of(child, scope)
        return out

    # -- sources

    def source(self, node: Node, parent: Scope | None) -> Rel:
        if node.kind == "join":
            return self.join(node, parent)
        if node.kind == "table":
            return self.renamed(self.session.table(node), node.alias or node.name[-1])
        if node.kind == "derived":
            if node.query.kind == "values":
                return self.values(node.query, node.alias, node.columns, parent)
            rel = self.query(node.query, parent)
            rel.sources[0].alias = node.alias
            return rel
        if node.kind == "function_scan":
            return self.session.functions.scan(self, node, parent)
        value = self.ex(node.value, parent or Scope(self, []))
        return self.rows_of(value, node.alias)

    def rows_of(self, value: Ex, alias: str | None) -> Rel:
        """The rows of a Table value; NULL has none."""
        t = value.type
        if isinstance(t, T.StructType):
            value, t = Ex(f"array({value.sql})", value.scope), T.ArrayType(t)
        if isinstance(t, T.NullType):
            return Rel("SELECT 1 AS one WHERE FALSE", [Source(alias, [])])
        if not isinstance(t, T.ArrayType):
            raise QueryError("Only a Table value can be scanned")
        if isinstance(t.elementType, T.StructType):
            columns = [Column(f.name, self.fresh(), f.dataType) for f in t.elementType.fields]
            return Rel(f"SELECT inline({value.sql}) AS ({', '.join(c.id for c in columns)})", [Source(alias, columns)])
        column = Column("Value", self.fresh(), t.elementType)
        return Rel(f"SELECT explode({value.sql}) AS {column.id}", [Source(alias, [column])])

    def renamed(self, df, alias: str | None) -> Rel:
        """A DataFrame as a relation, read through a view."""
        view = self.session.view(df)
        columns = [Column(f.name, self.fresh(), f.dataType) for f in df.schema.fields]
        listed = ", ".join(c.id for c in columns)
        # By position: a name may occur twice.
        return Rel(f"SELECT {listed} FROM {view} AS t({listed})" if columns else f"SELECT 1 AS one FROM {view}", [Source(alias, columns)])

    def values(self, node: Node, alias: str | None, names: list[str], parent: Scope | None) -> Rel:
        scope = parent or Scope(self, [])
        rows = [[self.ex(v, scope) for v in row] for row in node.rows]
        width = len(rows[0])
        if any(len(r) != width for r in rows) or (names and len(names) != width):
            raise QueryError("All rows of VALUES must have as many values as there are columns")
        ids = [self.fresh() for _ in range(width)]
        if all(e.constant for r in rows for e in r):
            listed = ", ".join("(" + ", ".join(e.sql for e in r) + ")" for r in rows)
            sql = f"SELECT * FROM VALUES {listed} AS t({', '.join(ids)})"
            types = [f.dataType for f in self.spark.sql(sql).schema.fields]
        else:
            listed = ", ".join("struct(" + ", ".join(e.sql for e in r) + ")" for r in rows)
            sql = f"SELECT inline(array({listed})) AS ({', '.join(ids)})"
            types = [e.type for e in rows[0]]
        names = names or [f"Column{i}" for i in range(width)]
        return Rel(sql, [Source(alias, [Column(n, i, t) for n, i, t in zip(names, ids, types, strict=True)])])

    def join(self, node: Node, parent: Scope | None) -> Rel:
        left = self.source(node.left, parent)
        applied = node.how.endswith("apply")
        outer = Scope(self, left.sources, parent)
        before, self.left_of_apply = self.left_of_apply, left.sql if applied else None
        right = self.source(node.right, outer if applied else parent)
        self.left_of_apply = before
        both = Scope(self, [*left.sources, *right.sources], parent)
        if node.populate:
            return self.populate(node, left, right, outer, both)
        sources = both.sources
        if node.how in ("cross_apply", "outer_apply"):
            if node.how == "cross_apply":
                return Rel(f"SELECT * FROM ({left.sql}) CROSS JOIN LATERAL ({right.sql})", sources)
            return Rel(f"SELECT * FROM ({left.sql}) LEFT JOIN LATERAL ({right.sql}) ON TRUE", sources)
        hint = self.session.join_hint(node.right)
        if node.how == "cross_join":
            return Rel(f"SELECT * FROM ({left.sql}) CROSS JOIN ({right.sql})", sources)
        condition = self.condition(node.on, both)
        return Rel(f"SELECT {hint}* FROM ({left.sql}) AS l {node.how.upper()} JOIN ({right.sql}) AS r ON {condition}", sources)

    def populate(self, node: Node, left: Rel, right: Rel, outer: Scope, both: Scope) -> Rel:
        """All matches of an outer row in one Table value; none is NULL.

        The aggregate stands in a lateral join. For equal keys Catalyst turns it
        into one aggregation by key and an equi-join.
        """
        alias = node.right.alias
        id_ = self.fresh()
        packed = "struct(" + ", ".join(f"{c.id} AS {quote(c.name)}" for c in right.columns) + ")"
        where = f" WHERE {self.condition(node.on, both)}" if node.on is not None else ""
        inner = f"SELECT CASE WHEN count(1) > 0 THEN collect_list({packed}) END AS {id_} FROM ({right.sql}){where}"
        sql = f"SELECT * FROM ({left.sql}) LEFT JOIN LATERAL ({inner}) ON TRUE"
        if node.how not in ("left", "outer_apply"):
            sql = f"SELECT * FROM ({sql}) WHERE {id_} IS NOT NULL"
        fields = T.StructType([T.StructField(c.name, c.type) for c in right.columns])
        return Rel(sql, [*left.sources, Source(alias, [Column(alias, id_, T.ArrayType(fields))], populated=True)])

    # -- expressions

    def ex(self, node: Node, scope: Scope) -> Ex:
        if scope.grouped is not None:
            done = self.in_group(node, scope)
            if done is not None:
                return done
        return getattr(self, f"ex_{node.kind}")(node, scope)

    def ex_literal(self, node: Node, scope: Scope) -> Ex:
        v = node.value
        made = {
            "null": lambda: ("NULL", T.NullType()),
            "boolean": lambda: (str(v).upper(), T.BooleanType()),
            "int": lambda: (str(v), T.IntegerType()),
            "long": lambda: (f"{v}L", T.LongType()),
            "float": lambda: (f"CAST({v} AS FLOAT)", T.FloatType()),
            "double": lambda: (f"CAST({v} AS DOUBLE)", T.DoubleType()),
            "string": lambda: (text(v), T.StringType()),
        }[node.type]()
        return Ex(*made[:1], scope, made[1], constant=True)

    def ex_template(self, node: Node, scope: Scope) -> Ex:
        parts = [self.as_string(self.ex(p, scope)) for p in node.parts]
        return Ex(f"concat_ws('', {', '.join(parts)})" if parts else "''", scope, T.StringType())

    def ex_variable(self, node: Node, scope: Scope) -> Ex:
        if not node.system and f"@{node.name.lower()}" in scope.names:
            sql, t = scope.names[f"@{node.name.lower()}"]
            return Ex(sql, scope, t)
        sql, t = self.session.variable_sql(node)
        return Ex(sql, scope, t, constant=True)

    def ex_column(self, node: Node, scope: Scope) -> Ex:
        if node.name.lower() in scope.names:
            sql, t = scope.names[node.name.lower()]
            return Ex(sql, scope, t)
        column = scope.column(node.name)
        if column is None:
            own = scope.source(node.name)
            if own is None or not own.columns:
                raise QueryError(f"No column can be found: {node.name}")
            packed = ", ".join(f"{c.id} AS {quote(c.name)}" for c in own.columns)
            return Ex(f"struct({packed})", scope)
        return Ex(column.id, scope, column.type)

    def ex_field(self, node: Node, scope: Scope) -> Ex:
        v = node.value
        if v.kind == "column" and v.name.lower() not in scope.names:
            own = scope.source(v.name)
            if own is not None and not own.populated:
                found = [c for c in own.columns if c.name.lower() == node.name.lower()]
                if found:
                    return Ex(found[0].id, scope, found[0].type)
                raise QueryError(f"No column can be found: {v.name}.{node.name}")
        base = self.ex(v, scope)
        t = base.type
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            found = [f for f in t.elementType.fields if f.name.lower() == node.name.lower()]
            if not found:
                return Ex("NULL", scope, T.NullType())
            return Ex(f"{base.sql}.{quote(found[0].name)}", scope, T.ArrayType(found[0].dataType))
        if isinstance(t, T.StructType):
            found = [f for f in t.fields if f.name.lower() == node.name.lower()]
            if not found:
                return Ex("NULL", scope, T.NullType())
            return Ex(f"{base.sql}.{quote(found[0].name)}", scope, found[0].dataType)
        if isinstance(t, T.VariantType):
            return Ex(f"try_variant_get({base.sql}, {text('$.' + node.name)})", scope, T.VariantType())
        if isinstance(t, T.MapType):
            return Ex(f"{base.sql}[{text(node.name)}]", scope, t.valueType)
        if isinstance(t, T.NullType):
            return Ex("NULL", scope, T.NullType())
        raise QueryError(f"{node.name} can't be taken from a {t.simpleString()}")

    def ex_subscript(self, node: Node, scope: Scope) -> Ex:
        base, index = self.ex(node.value, scope), self.ex(node.index, scope)
        t = base.type
        if isinstance(t, T.ArrayType):
            if index.kind == "string":
                if node.index.kind != "literal":
                    raise QueryError("A column of a Table must be named by a literal")
                return self.ex_field(Node("field", value=node.value, name=node.index.value), scope)
            # NULL, not an error, below 0 and beyond the end.
            return Ex(f"get({base.sql}, CAST({index.sql} AS INT))", scope, t.elementType)
        if isinstance(t, T.StringType):
            i = f"CAST({index.sql} AS INT)"
            return Ex(f"CASE WHEN {i} >= 0 AND {i} < length({base.sql}) THEN substring({base.sql}, {i} + 1, 1) END", scope, t)
        if isinstance(t, T.StructType) and node.index.kind == "literal":
            return self.ex_field(Node("field", value=node.value, name=str(node.index.value)), scope)
        if isinstance(t, T.VariantType) and node.index.kind == "literal":
            path = f"$[{node.index.value}]" if index.kind != "string" else f"$.{node.index.value}"
            return Ex(f"try_variant_get({base.sql}, {text(path)})", scope, t)
        if isinstance(t, T.NullType):
            return Ex("NULL", scope, t)
        raise QueryError(f"A {t.simpleString()} has no elements")

    def ex_logic(self, node: Node, scope: Scope) -> Ex:
        a, b = self.boolean(node.left, scope), self.boolean(node.right, scope)
        return Ex(f"({a} {node.op.upper()} {b})", scope, T.BooleanType())

    def boolean(self, node: Node, scope: Scope) -> str:
        ex = self.ex(node, scope)
        return ex.sql if ex.kind in ("boolean", "void") else self.cast(ex, "boolean").sql

    def ex_not(self, node: Node, scope: Scope) -> Ex:
        return Ex(f"(NOT {self.boolean(node.value, scope)})", scope, T.BooleanType())

    def ex_is_null(self, node: Node, scope: Scope) -> Ex:
        return Ex(f"({self.ex(node.value, scope).sql} IS {'NOT ' if node.negated else ''}NULL)", scope, T.BooleanType())

    def promoted(self, *exs: Ex) -> list[Ex]:
        """Operands in the type of the highest precedence among them."""
        kinds = [e.kind for e in exs]
        if "datetimeoffset" in kinds:
            return [Ex(f"{e.sql}.ts", e.scope, T.TimestampType()) if k == "datetimeoffset" else (e if k == "void" else Ex(f"CAST({e.sql} AS TIMESTAMP)", e.scope, T.TimestampType())) for e, k in zip(exs, kinds, strict=True)]
        ranked = [k for k in kinds if k in PRECEDENCE]
        if len(set(ranked)) < 2:
            return list(exs)
        top = max(ranked, key=PRECEDENCE.index)
        return [self.cast(e, top) if k in PRECEDENCE and k != top else e for e, k in zip(exs, kinds, strict=True)]

    def ex_compare(self, node: Node, scope: Scope) -> Ex:
        a, b = self.promoted(self.ex(node.left, scope), self.ex(node.right, scope))
        return Ex(f"({a.sql} {node.op} {b.sql})", scope, T.BooleanType())

    def ex_in(self, node: Node, scope: Scope) -> Ex:
        """NULLs in the list are passed over; only a list of NULLs alone gives NULL."""
        items = [self.ex(i, scope) for i in node.items if not (i.kind == "literal" and i.type == "null")]
        if not items:
            return Ex("CAST(NULL AS BOOLEAN)", scope, T.BooleanType())
        value, *items = self.promoted(self.ex(node.value, scope), *items)
        listed = ", ".join(i.sql for i in items)
        if all(n.kind == "literal" for n in node.items):
            found = f"({value.sql} IN ({listed}))"
        else:
            nulls = " AND ".join(f"{i.sql} IS NULL" for i in items)
            found = f"(CASE WHEN {value.sql} IS NULL OR ({nulls}) THEN NULL ELSE coalesce({value.sql} IN ({listed}), FALSE) END)"
        return Ex(f"(NOT {found})" if node.negated else found, scope, T.BooleanType())

    def ex_like(self, node: Node, scope: Scope) -> Ex:
        """``%`` any text, ``_`` at most one character; the rest is a pattern's text."""
        value, pattern = self.as_string(self.ex(node.value, scope)), node.pattern
        if pattern.kind == "literal" and pattern.type == "string":
            p = pattern.value
            if "_" not in p and not any(c in "\\.[]{}()*+^$|?" for c in p):
                found = f"({value} LIKE {text(p)})"
            else:
                found = f"({value} RLIKE {text('^(?:' + p.replace('?', chr(92) + '?').replace('%', '.*?').replace('_', '.?') + ')$')})"
        else:
            p = self.as_string(self.ex(pattern, scope))
            found = f"({value} RLIKE concat('^(?:', replace(replace(replace({p}, '?', '\\\\?'), '%', '.*?'), '_', '.?'), ')$'))"
        return Ex(f"(NOT {found})" if node.negated else found, scope, T.BooleanType())

    def ex_case(self, node: Node, scope: Scope) -> Ex:
        results = [self.ex(r, scope) for _, r in node.whens]
        if node.otherwise is not None:
            results.append(self.ex(node.otherwise, scope))
        results = self.promoted(*results)
        whens = " ".join(f"WHEN {self.boolean(c, scope)} THEN {r.sql}" for (c, _), r in zip(node.whens, results, strict=False))
        other = f" ELSE {results[-1].sql}" if node.otherwise is not None else ""
        return Ex(f"(CASE {whens}{other} END)", scope)

    def ex_arith(self, node: Node, scope: Scope) -> Ex:
        a, b = self.ex(node.left, scope), self.ex(node.right, scope)
        if "void" in (a.kind, b.kind):
            return Ex("NULL", scope, T.NullType())
        if a.kind == b.kind == "string":
            return Ex(f"concat({a.sql}, {b.sql})", scope, T.StringType())
        a, b = self.promoted(a, b)
        if a.kind == "boolean" or a.kind not in PRECEDENCE or a.kind == "timestamp_ntz":
            raise QueryError(f"Can't compute {node.op} of {a.kind} and {b.kind}")
        x, y = a.sql, b.sql
        if node.op in "+-*":
            sql = f"({x} {node.op} {y})"
            return Ex(f"CAST({sql} AS {a.kind})" if a.kind == "decimal(38,6)" else sql, scope, a.type)
        if a.kind in ("int", "bigint"):
            rest = f"({x} % {y})"
            floor_mod = f"(CASE WHEN {rest} != 0 AND (({rest} < 0) != ({y} < 0)) THEN {rest} + {y} ELSE {rest} END)"
            sql = floor_mod if node.op == "%" else f"(({x} - {floor_mod}) DIV {y})"
            return Ex(f"CAST({sql} AS {a.kind})", scope, a.type)
        if a.kind == "decimal(38,6)":
            return Ex(f"CAST({x} {node.op} {y} AS {a.kind})", scope, a.type)
        zero = f"(CASE WHEN {x} > 0 THEN double('Infinity') WHEN {x} < 0 THEN double('-Infinity') ELSE double('NaN') END)" if node.op == "/" else "double('NaN')"
        sql = f"(CASE WHEN {x} IS NOT NULL AND {y} = 0 THEN {zero} ELSE {x} {node.op} {y} END)"
        return Ex(f"CAST({sql} AS {a.kind})", scope, a.type)

    def ex_sign(self, node: Node, scope: Scope) -> Ex:
        ex = self.ex(node.value, scope)
        return Ex(f"({node.op}{ex.sql})" if node.op == "-" else ex.sql, scope, ex.type, ex.constant)

    def ex_at_zone(self, node: Node, scope: Scope) -> Ex:
        value, zone = self.ex(node.value, scope), self.ex(node.zone, scope)
        if value.kind == "string":
            value = self.cast(value, "timestamp_ntz")
        if value.kind == "datetimeoffset":
            sql = f"named_struct('ts', {value.sql}.ts, 'zone', {zone.sql})"
        else:
            sql = f"named_struct('ts', CAST(convert_timezone({zone.sql}, 'UTC', {value.sql}) AS TIMESTAMP), 'zone', {zone.sql})"
        return Ex(f"(CASE WHEN {value.sql} IS NOT NULL THEN {sql} END)", scope, OFFSET_TYPE)

    def ex_cast(self, node: Node, scope: Scope) -> Ex:
        if node.type not in CASTS:
            raise QueryError(f"Can't cast to {node.type}")
        return self.cast(self.ex(node.value, scope), CASTS[node.type])

    def cast(self, ex: Ex, to: str) -> Ex:
        kind, scope = ex.kind, ex.scope
        if kind == to:
            return ex
        if to == "array":
            return ex if kind == "array" else Ex(f"array({ex.sql})", scope)
        if to == "string":
            return Ex(self.as_string(ex), scope, T.StringType())
        if to == "boolean" and kind == "string":
            s = f"lower({ex.sql})"
            sql = f"(CASE WHEN {s} IN ('y', 'yes', 'true', '1') THEN TRUE WHEN {s} IN ('n', 'no', 'false', '0') THEN FALSE WHEN {s} IS NOT NULL THEN CAST(raise_error(concat('Cannot cast to Boolean: ', {ex.sql})) AS BOOLEAN) END)"
            return Ex(sql, scope, T.BooleanType())
        if to == "timestamp_ntz":
            if kind == "datetimeoffset":
                return Ex(f"CAST(from_utc_timestamp({ex.sql}.ts, {ex.sql}.zone) AS TIMESTAMP_NTZ)", scope, T.TimestampNTZType())
            if kind in ("int", "bigint"):
                return Ex(f"CAST(timestamp_millis({ex.sql}) AS TIMESTAMP_NTZ)", scope, T.TimestampNTZType())
            return Ex(f"CAST(CAST({ex.sql} AS TIMESTAMP) AS TIMESTAMP_NTZ)", scope, T.TimestampNTZType())
        if to == "datetimeoffset":
            if kind == "string":
                zone = f"coalesce(nullif(regexp_extract({ex.sql}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', 1), ''), 'Z')"
            else:
                zone = "'Z'"
            ts = f"timestamp_millis({ex.sql})" if kind in ("int", "bigint") else f"CAST({ex.sql} AS TIMESTAMP)"
            return Ex(f"(CASE WHEN {ex.sql} IS NOT NULL THEN named_struct('ts', {ts}, 'zone', {zone}) END)", scope, OFFSET_TYPE)
        if kind in ("timestamp_ntz", "timestamp") and to in ("bigint",):
            return Ex(f"unix_millis(CAST({ex.sql} AS TIMESTAMP))", scope, T.LongType())
        if kind == "void":
            return Ex(f"CAST(NULL AS {to})", scope)
        if kind in ("float", "double", "decimal(38,6)") and to in ("int", "bigint"):
            return Ex(f"CAST({ex.sql} AS {to})", scope)
        return Ex(f"CAST({ex.sql} AS {to})", scope)

    def as_string(self, ex: Ex) -> str:
        kind, v = ex.kind, ex.sql
        if kind == "string":
            return v
        if kind in ("timestamp_ntz", "timestamp"):
            return iso(f"CAST({v} AS TIMESTAMP)")
        if kind == "datetimeoffset":
            return offset_text(v)
        if kind in ("array", "struct", "map", "variant"):
            return f"to_json({v})"
        return f"CAST({v} AS STRING)"

    def ex_subquery(self, node: Node, scope: Scope) -> Ex:
        select = node.query
        if select.shape is None and (len(select.items) != 1 or select.items[0].kind != "item"):
            raise ParseError("A subquery expression must select one item, or be shaped by FOR")
        if select.source is None and select.where is None and select.shape == "object" and not select.order:
            items = self.items(select.items, scope)
            fields = ", ".join(f"{text(n)}, {e.sql}" for n, e in items)
            return Ex(f"named_struct({fields})", scope)
        rel = self.query(select, scope)
        column = rel.columns[0]
        if select.shape is not None and scope.laterals is not None:
            scope.laterals.append(rel.sql)
            scope.sources = [*scope.sources, Source(None, [Column("\0subquery", column.id, column.type)])]
            return Ex(column.id, scope, column.type)
        # Spark raises an error if there is more than one row.
        return Ex(f"(SELECT {column.id} FROM ({rel.sql}))", scope, column.type)

    def ex_lambda(self, node: Node, scope: Scope) -> Ex:
        raise QueryError("A lambda can only be an argument of a function")

    def ex_star(self, node: Node, scope: Scope) -> Ex:
        raise QueryError("* can't be an expression")

    def ex_call(self, node: Node, scope: Scope) -> Ex:
        return self.session.functions.scalar(node)(self, node, scope)

    def apply_lambda(self, node: Node, scope: Scope, *types: T.DataType) -> tuple[list[str], Ex]:
        """Names for Spark and the lowered body of a lambda over values of these types."""
        if node.kind != "lambda" or len(node.names) > len(types):
            raise QueryError("Expected a lambda")
        names = [self.session.fresh("x") for _ in node.names]
        inner = scope.child({n.lower(): (s, t) for n, s, t in zip(node.names, names, types, strict=False)})
        return names, self.ex(node.body, inner)


def walk(node: Node):
    yield node
    for child in node.children():
        yield from walk(child)


def iso(ts: str) -> str:
    """ISO text of a timestamp; the fraction only if there is one."""
    whole = f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    return f"(CASE WHEN extract(SECOND FROM {ts}) % 1 = 0 THEN {whole} ELSE date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSS\") END)"


def offset_text(v: str) -> str:
    local = f"from_utc_timestamp({v}.ts, {v}.zone)"
    minutes = f"CAST((unix_seconds({local}) - unix_seconds({v}.ts)) DIV 60 AS INT)"
    zone = f"(CASE WHEN {minutes} = 0 THEN 'Z' ELSE concat(IF({minutes} < 0, '-', '+'), lpad(CAST(abs({minutes}) DIV 60 AS STRING), 2, '0'), ':', lpad(CAST(abs({minutes}) % 60 AS STRING), 2, '0')) END)"
    return f"concat({iso(local)}, {zone})"
