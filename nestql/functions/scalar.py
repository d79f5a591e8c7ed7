"""Scalar and lambda functions.

Each takes the lowerer, the call and the scope and gives an ``Ex``. Everything is
a built-in of Spark; nothing runs in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from nestql.plans.lower import Ex, iso, offset_text, text
from nestql.plans.syntax import Node, QueryError

STRING, LONG, BOOLEAN, INT = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType()
TABLE: dict[str, tuple] = {}


def function(names: str, least: int, most: int | None = None):
    """Register under the names, with the allowed number of arguments."""

    def put(fn):
        for name in names.split():
            TABLE[name] = (fn, least, least if most is None else most)
        return fn

    return put


ANY = 10_000


def args_of(lower, node: Node, scope) -> list[Ex]:
    return [lower.ex(a, scope) for a in node.args]


def strings_of(lower, node: Node, scope) -> list[str]:
    return [lower.as_string(e) for e in args_of(lower, node, scope)]


def simple(name: str, least: int, sql: str, type_: T.DataType | None, most: int | None = None):
    """A function of string arguments given by a pattern; %0, %1 stand for them."""

    @function(name, least, most)
    def build(lower, node, scope):
        # In one pass: the text of an argument may hold %0 itself.
        strings = strings_of(lower, node, scope)
        return Ex(re.sub(r"%([0-9])", lambda m: strings[int(m[1])], sql), scope, type_)


simple("lower", 1, "lower(%0)", STRING)
simple("upper", 1, "upper(%0)", STRING)
simple("reverse", 1, "reverse(%0)", STRING)
# Of UTF-16 units.
simple("length", 1, "CAST(octet_length(encode(%0, 'UTF-16BE')) DIV 2 AS BIGINT)", LONG)
simple("base64_encode", 1, "base64(encode(%0, 'UTF-8'))", STRING)
simple("base64_decode", 1, "decode(unbase64(%0), 'UTF-8')", STRING)
simple("replace", 3, "replace(%0, %1, %2)", STRING)
simple("regexp_like", 2, "(%0 RLIKE %1)", BOOLEAN)
simple("isjson", 1, "(CASE WHEN %0 IS NULL THEN NULL ELSE %0 != '' AND try_parse_json(%0) IS NOT NULL END)", BOOLEAN)
simple("isjsonobject", 1, "(CASE WHEN %0 IS NULL THEN NULL ELSE %0 != '' AND try_parse_json(%0) IS NOT NULL AND startswith(ltrim(%0), '{') END)", BOOLEAN)
simple("isjsonarray", 1, "(CASE WHEN %0 IS NULL THEN NULL ELSE %0 != '' AND try_parse_json(%0) IS NOT NULL AND startswith(ltrim(%0), '[') END)", BOOLEAN)
simple("json_value", 1, "parse_json(%0)", T.VariantType())


@function("trim ltrim rtrim", 1, 2)
def trim(lower, node, scope):
    s, *chars = strings_of(lower, node, scope)
    side = {"trim": "BOTH", "ltrim": "LEADING", "rtrim": "TRAILING"}[node.name]
    if chars:
        return Ex(f"trim({side} {chars[0]} FROM {s})", scope, STRING)
    pattern = {"trim": "^\\s+|\\s+$", "ltrim": "^\\s+", "rtrim": "\\s+$"}[node.name]
    return Ex(f"regexp_replace({s}, {text(pattern)}, '')", scope, STRING)


@function("lpad rpad", 2, 3)
def pad(lower, node, scope):
    s, n, *fill = args_of(lower, node, scope)
    s, n = lower.as_string(s), lower.cast(n, "int").sql
    with_ = lower.as_string(fill[0]) if fill else "' '"
    # Spark's would cut a longer text.
    return Ex(f"(CASE WHEN length({s}) >= {n} THEN {s} ELSE {node.name}({s}, {n}, {with_}) END)", scope, STRING)


@function("substring", 2, 3)
def substring(lower, node, scope):
    s, start, *size = args_of(lower, node, scope)
    s, start = lower.as_string(s), lower.cast(start, "int").sql
    outside = f"{start} < 0 OR {start} > length({s})"
    if size:
        n = lower.cast(size[0], "int").sql
        outside += f" OR {n} < 0"
        cut = f"substring({s}, {start} + 1, {n})"
    else:
        cut = f"substring({s}, {start} + 1)"
    return Ex(f"(CASE WHEN {outside} THEN raise_error('substring: out of range') ELSE {cut} END)", scope, STRING)


@function("left right", 2)
def ends(lower, node, scope):
    s, n = args_of(lower, node, scope)
    s, n = lower.as_string(s), lower.cast(n, "int").sql
    return Ex(f"(CASE WHEN {n} < 0 THEN raise_error('{node.name}: length must be 0 or more') ELSE {node.name}({s}, {n}) END)", scope, STRING)


@function("charindex", 2, 3)
def charindex(lower, node, scope):
    find, s, *start = args_of(lower, node, scope)
    at = f", {lower.cast(start[0], 'int').sql} + 1" if start else ""
    return Ex(f"CAST(locate({lower.as_string(find)}, {lower.as_string(s)}{at}) - 1 AS BIGINT)", scope, LONG)


@function("concat", 2, ANY)
def concat(lower, node, scope):
    return Ex(f"concat_ws('', {', '.join(strings_of(lower, node, scope))})", scope, STRING)


@function("char", 1)
def char(lower, node, scope):
    n = lower.cast(args_of(lower, node, scope)[0], "int").sql
    # Spark's char() takes the number modulo 256; a code point in UTF-16 doesn't.
    return Ex(f"(CASE WHEN {n} < 256 THEN char({n}) ELSE decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32') END)", scope, STRING)


@function("format", 2, 3)
def format_(lower, node, scope):
    value, pattern = args_of(lower, node, scope)[:2]
    p = lower.as_string(pattern)
    if value.kind == "timestamp_ntz":
        return Ex(f"date_format(CAST({value.sql} AS TIMESTAMP), {p})", scope, STRING)
    if value.kind == "datetimeoffset":
        local = f"from_utc_timestamp({value.sql}.ts, {value.sql}.zone)"
        zone = f"regexp_replace(replace(right({offset_text(value.sql)}, 6), ':', ''), '^.*Z$', '+0000')"
        return Ex(f"date_format({local}, replace({p}, 'Z', concat(\"'\", {zone}, \"'\")))", scope, STRING)
    if value.kind in ("int", "bigint", "float", "double", "decimal(38,6)"):
        if node.args[1].kind != "literal":
            raise QueryError("format: the pattern of a number must be a literal")
        places = node.args[1].value
        fixed = places.split(".")[1] if "." in places else ""
        number = f"format_number(CAST({value.sql} AS DOUBLE), {text(places)})"
        locale = node.args[2].value.lower() if len(node.args) > 2 and node.args[2].kind == "literal" else ""
        if locale.split("_")[0].split("-")[0] in ("de", "fr", "es", "it", "nl", "da", "nb", "sv", "fi", "pl", "pt", "tr"):
            number = f"translate({number}, ',.', '.,')"
        return Ex(number, scope, STRING) if fixed is not None else Ex(number, scope)
    return Ex(f"format_string({p}, {value.sql})", scope, STRING)


@function("string_split", 2)
def string_split(lower, node, scope):
    return Ex(split_sql(lower, node, scope), scope, T.ArrayType(STRING))


#: Characters with a meaning inside the brackets of a pattern.
IN_BRACKETS = "\\[]^-&"


def split_sql(lower, node: Node, scope) -> str:
    """Parts between any of the separating characters, without empty ones."""
    s, seps = strings_of(lower, node, scope)
    if node.args[1].kind == "literal":
        chars = "".join("\\" + c if c in IN_BRACKETS else c for c in str(node.args[1].value))
        pattern = text(f"[{chars}]")
    else:
        for c in IN_BRACKETS:
            seps = f"replace({seps}, {text(c)}, {text(chr(92) + c)})"
        pattern = f"concat('[', {seps}, ']')"
    return f"filter(split({s}, {pattern}), x -> x != '')"


@function("getdate", 0)
def getdate(lower, node, scope):
    return Ex("localtimestamp()", scope, T.TimestampNTZType())


@function("getutcdate", 0)
def getutcdate(lower, node, scope):
    return Ex("CAST(current_timestamp() AS TIMESTAMP_NTZ)", scope, T.TimestampNTZType())


@function("current_timezone", 0)
def zone(lower, node, scope):
    return Ex("current_timezone()", scope, STRING)


def instant(lower, ex: Ex) -> str:
    if ex.kind == "datetimeoffset":
        return f"{ex.sql}.ts"
    return f"CAST({ex.sql} AS TIMESTAMP)"


@function("unix_timestamp", 1)
def unix_timestamp(lower, node, scope):
    return Ex(f"unix_millis({instant(lower, lower.ex(node.args[0], scope))})", scope, LONG)


# Names and short names of date parts.
PARTS = {
    "year": "yyyy yy", "quarter": "qq q", "month": "mm m", "dayofyear": "dy y", "day": "dd d", "week": "wk ww", "weekday": "dw", "hour": "hh",
    "minute": "mi n", "second": "ss s", "millisecond": "ms", "microsecond": "mcs", "nanosecond": "ns",
}
PART_NAMES = {s: k for k, v in PARTS.items() for s in (k, *v.split())}


def part_of(node: Node) -> str:
    if node.part not in PART_NAMES:
        raise QueryError(f"No such date part: {node.part}")
    return PART_NAMES[node.part]


@function("datepart", 1)
def datepart(lower, node, scope):
    part, ex = part_of(node), lower.ex(node.args[0], scope)
    ts = f"from_utc_timestamp({ex.sql}.ts, {ex.sql}.zone)" if ex.kind == "datetimeoffset" else f"CAST({ex.sql} AS TIMESTAMP)"
    made = {
        "dayofyear": f"dayofyear({ts})", "week": f"ceil(dayofyear({ts}) / 7)", "weekday": f"(weekday({ts}) + 1)",
        "millisecond": f"(unix_millis({ts}) % 1000)", "microsecond": f"(unix_micros({ts}) % 1000000)", "nanosecond": f"(unix_micros({ts}) % 1000000 * 1000)",
        "second": f"second({ts})",
    }.get(part, f"extract({part.upper()} FROM {ts})")
    return Ex(f"CAST({made} AS BIGINT)", scope, LONG)


@function("dateadd", 2)
def dateadd(lower, node, scope):
    part, (n, ex) = part_of(node), args_of(lower, node, scope)
    if ex.kind == "string":
        ex = lower.cast(ex, "timestamp_ntz")
    unit = {"dayofyear": "DAY", "weekday": "DAY", "nanosecond": "MICROSECOND"}.get(part, part.upper())
    count = lower.cast(n, "int").sql if part != "nanosecond" else f"({n.sql}) DIV 1000"
    if ex.kind == "datetimeoffset":
        local = f"timestampadd({unit}, {count}, from_utc_timestamp({ex.sql}.ts, {ex.sql}.zone))"
        return Ex(f"named_struct('ts', to_utc_timestamp({local}, {ex.sql}.zone), 'zone', {ex.sql}.zone)", scope, ex.type)
    return Ex(f"CAST(timestampadd({unit}, {count}, CAST({ex.sql} AS TIMESTAMP)) AS TIMESTAMP_NTZ)", scope, T.TimestampNTZType())


@function("datediff", 2)
def datediff(lower, node, scope):
    part, (a, b) = part_of(node), args_of(lower, node, scope)
    unit = {"dayofyear": "DAY", "weekday": "DAY", "nanosecond": "MICROSECOND"}.get(part, part.upper())
    scale = " * 1000" if part == "nanosecond" else ""
    return Ex(f"(timestampdiff({unit}, {instant(lower, a)}, {instant(lower, b)}){scale})", scope, LONG)


@function("attimezone", 2)
def attimezone(lower, node, scope):
    return lower.ex(Node("at_zone", value=node.args[0], zone=node.args[1]), scope)


@function("hash", 1, ANY)
def hash_(lower, node, scope):
    exs = args_of(lower, node, scope)
    nulls = " OR ".join(f"{e.sql} IS NULL" for e in exs)
    return Ex(f"(CASE WHEN NOT ({nulls}) THEN hash({', '.join(e.sql for e in exs)}) END)", scope, INT)


@function("isnull", 2)
@function("coalesce", 1, ANY)
def coalesce(lower, node, scope):
    exs = args_of(lower, node, scope)
    if all(e.kind == "void" for e in exs):
        return Ex("NULL", scope, T.NullType())
    known = [e for e in exs if e.kind != "void"]
    kinds = {e.kind for e in known}
    if "string" in kinds and len(kinds) > 1:
        # No common type: each value keeps its own.
        return Ex(f"coalesce({', '.join(f'CAST({e.sql} AS VARIANT)' for e in known)})", scope, T.VariantType())
    return Ex(f"coalesce({', '.join(e.sql for e in lower.promoted(*known))})", scope)


@function("isblank", 2)
def isblank(lower, node, scope):
    a, b = strings_of(lower, node, scope)
    return Ex(f"(CASE WHEN {a} IS NULL OR {a} = '' THEN {b} ELSE {a} END)", scope, STRING)


def group_widths(tree) -> dict[int, int]:
    """The least length of what each group of a parsed pattern matches when it takes part."""
    out: dict[int, int] = {}
    for op, value in tree:
        if op is re._constants.SUBPATTERN and value[0]:
            out[value[0]] = value[-1].getwidth()[0]
        for inner in value if isinstance(value, tuple) else (value,):
            for branch in inner if type(inner) is list else (inner,):
                if isinstance(branch, re._parser.SubPattern):
                    out |= group_widths(branch)
    return out


@function("regexp_match", 2)
def regexp_match(lower, node, scope):
    s, p = strings_of(lower, node, scope)
    if node.args[1].kind != "literal":
        raise QueryError("regexp_match: the pattern must be a literal")
    groups = re.compile(node.args[1].value).groups
    per = [f"regexp_extract_all({s}, {p}, {g})" for g in range(1, groups + 1)]
    if not per:
        return Ex(f"(CASE WHEN {s} IS NOT NULL THEN array() END)", scope, T.ArrayType(STRING))
    # A group that can't match the empty text and yet gives it took no part.
    least = group_widths(re._parser.parse(node.args[1].value))
    per = [f"nullif(get({x}, i), '')" if least.get(g) else f"get({x}, i)" for g, x in enumerate(per, 1)]
    counted = f"size(regexp_extract_all({s}, {p}, 0))"
    zipped = f"filter(flatten(transform(sequence(0, {counted} - 1), i -> array({', '.join(per)}))), x -> x IS NOT NULL)"
    return Ex(f"(CASE WHEN {s} IS NULL THEN NULL WHEN {counted} = 0 THEN array() ELSE {zipped} END)", scope, T.ArrayType(STRING))


NAMES = {
    "string": "String", "boolean": "Boolean", "int": "Int", "bigint": "Long", "decimal(38,6)": "Decimal", "float": "Float", "double": "Double",
    "timestamp_ntz": "DateTime", "timestamp": "DateTimeOffset", "datetimeoffset": "DateTimeOffset", "struct": "Object", "variant": "Any",
}


def type_name(lower, t: T.DataType) -> str:
    from nestql.plans.lower import kind_of

    if isinstance(t, T.ArrayType):
        return "Table" if isinstance(t.elementType, T.StructType) else f"Array<{type_name(lower, t.elementType)}>"
    return "Any<null>" if isinstance(t, T.NullType) else NAMES.get(kind_of(t), "Any")


@function("typeof", 1)
def typeof(lower, node, scope):
    arg = node.args[0]
    if arg.kind == "call" and arg.name == "array" and scope.grouped is None:
        kinds = {e.kind for e in args_of(lower, arg, scope)}
        if len(kinds) > 1:
            return Ex("'Array<Any>'", scope, STRING)
    return Ex(text(type_name(lower, lower.ex(arg, scope).type)), scope, STRING)


@function("least greatest", 2, ANY)
def extreme(lower, node, scope):
    return Ex(f"{node.name}({', '.join(e.sql for e in lower.promoted(*args_of(lower, node, scope)))})", scope)


@function("randomint", 1)
def randomint(lower, node, scope):
    return Ex(f"CAST(floor(rand() * {args_of(lower, node, scope)[0].sql}) AS INT)", scope, INT)


@function("parseduration", 1)
def parseduration(lower, node, scope):
    s = strings_of(lower, node, scope)[0]
    number = lambda p: f"coalesce(try_cast(nullif(regexp_extract({s}, {text(p)}, 1), '') AS DOUBLE), 0)"
    iso_ms = " + ".join(
        f"{number(p)} * {ms}"
        for p, ms in ((r"^P(\d+)D", 86_400_000), (r"T.*?([0-9.]+)H", 3_600_000), (r"T(?:[^M]*?H)?([0-9.]+)M", 60_000), (r"T(?:.*[HM])?([0-9.]+)S$", 1000))
    )
    clock = " + ".join(f"{number(p)} * {ms}" for p, ms in ((r"^(\d+):", 3_600_000), (r"^\d+:(\d+)", 60_000), (r"^\d+:\d+:(\d+)", 1000)))
    return Ex(
        f"(CASE WHEN {s} RLIKE '^P' THEN CAST({iso_ms} AS BIGINT) WHEN {s} RLIKE '^[0-9]+:[0-9]+(:[0-9]+)?$' THEN CAST({clock} AS BIGINT)"
        f" WHEN {s} IS NOT NULL THEN CAST(raise_error(concat('Not a duration: ', {s})) AS BIGINT) END)",
        scope, LONG,
    )


@function("parsedatasize", 1)
def parsedatasize(lower, node, scope):
    s = strings_of(lower, node, scope)[0]
    unit = f"lower(regexp_extract({s}, '([A-Za-z]*)\\\\s*$', 1))"
    scale = " ".join(f"WHEN {unit} IN ('{u}', '{u}b') THEN {1024**i}L" for i, u in enumerate("kmgtp", 1))
    return Ex(f"CAST(CAST(regexp_extract({s}, '([0-9.]+)', 1) AS DOUBLE) * (CASE {scale} ELSE 1L END) AS BIGINT)", scope, LONG)


@function("abs ceiling floor", 1)
def unary_math(lower, node, scope):
    ex = args_of(lower, node, scope)[0]
    if ex.kind not in ("int", "bigint", "float", "double", "decimal(38,6)", "void"):
        raise QueryError(f"{node.name} needs a number")
    return Ex(f"CAST({node.name}({ex.sql}) AS {ex.kind})", scope, ex.type) if ex.kind != "void" else ex


# -- arrays, objects and lambdas


@function("array", 0, ANY)
def array(lower, node, scope):
    exs = args_of(lower, node, scope)
    kinds = {e.kind for e in exs} - {"void"}
    if len(kinds) > 1 and not kinds <= {"int", "bigint", "float", "double", "decimal(38,6)"}:
        exs = [Ex(f"to_variant_object({e.sql})" if e.kind in ("array", "struct") else f"CAST({e.sql} AS VARIANT)", scope) for e in exs]
    return Ex(f"array({', '.join(e.sql for e in exs)})", scope)


@function("toarray", 1)
def toarray(lower, node, scope):
    ex = args_of(lower, node, scope)[0]
    return ex if ex.kind == "array" else Ex(f"array({ex.sql})", scope)


@function("totable", 1)
def totable(lower, node, scope):
    ex = args_of(lower, node, scope)[0]
    t = ex.type
    if isinstance(t, T.StructType):
        return Ex(f"array({ex.sql})", scope, T.ArrayType(t))
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, T.StructType):
            return ex
        return Ex(f"transform({ex.sql}, x -> struct(x AS Value))", scope)
    raise QueryError(f"totable can't convert a {t.simpleString()}")


@function("object", 0, ANY)
def object_(lower, node, scope):
    return Ex(object_sql(lower, node, scope), scope)


def object_sql(lower, node, scope) -> str:
    if len(node.args) % 2:
        raise QueryError(f"{node.name} needs pairs of keys and values")
    parts = []
    for key, value in zip(node.args[::2], node.args[1::2], strict=True):
        if key.kind != "literal" or key.type != "string":
            raise QueryError(f"Keys of {node.name} must be literal strings")
        parts.append(f"{text(key.value)}, {lower.ex(value, scope).sql}")
    return f"named_struct({', '.join(parts)})" if parts else "named_struct()"


@function("contains", 2)
def contains(lower, node, scope):
    arr, value = args_of(lower, node, scope)
    if arr.kind != "array":
        a, b = lower.promoted(arr, value)
        return Ex(f"({a.sql} <=> {b.sql})", scope, BOOLEAN)
    return Ex(f"coalesce(exists({arr.sql}, x -> x <=> {value.sql}), FALSE)", scope, BOOLEAN)


@function("distinct", 1)
def distinct(lower, node, scope):
    ex = args_of(lower, node, scope)[0]
    return Ex(f"array_distinct({ex.sql})", scope, ex.type) if ex.kind == "array" else ex


def over(lower, node, scope) -> tuple[Ex, str, Ex]:
    """The array, the lambda's name and its body."""
    arr = lower.ex(node.args[0], scope)
    if arr.kind != "array":
        arr = Ex(f"array({arr.sql})", scope)
    (name, *_), body = lower.apply_lambda(node.args[1], scope, arr.type.elementType)
    return arr, name, body


@function("filter", 2)
def filter_(lower, node, scope):
    arr, x, body = over(lower, node, scope)
    return Ex(f"filter({arr.sql}, {x} -> {body.sql})", scope, arr.type)


@function("map", 2)
def map_(lower, node, scope):
    first = lower.ex(node.args[0], scope)
    arr, x, body = over(lower, node, scope)
    sql = f"transform({arr.sql}, {x} -> {body.sql})"
    return Ex(sql, scope, T.ArrayType(body.type)) if first.kind == "array" else Ex(f"get({sql}, 0)", scope, body.type)


@function("flatmap", 2)
def flatmap(lower, node, scope):
    arr, x, body = over(lower, node, scope)
    if body.kind == "array":
        return Ex(f"flatten(filter(transform({arr.sql}, {x} -> {body.sql}), y -> y IS NOT NULL))", scope, body.type)
    return Ex(f"transform({arr.sql}, {x} -> {body.sql})", scope, T.ArrayType(body.type))


@function("any all none", 2)
def match(lower, node, scope):
    arr, x, body = over(lower, node, scope)
    # NULL results are passed over; if there are no others, the answer is NULL.
    known = f"filter(transform({arr.sql}, {x} -> {body.sql}), y -> y IS NOT NULL)"
    test = {"any": f"exists({known}, y -> y)", "all": f"forall({known}, y -> y)", "none": f"NOT exists({known}, y -> y)"}[node.name]
    return Ex(f"(CASE WHEN size({arr.sql}) > 0 AND size({known}) = 0 THEN NULL ELSE {test} END)", scope, BOOLEAN)


# -- aggregate functions over arrays, where there is no GROUP BY


@function("count", 1)
def count(lower, node, scope):
    if node.args[0].kind == "star":
        return Ex("1", scope, INT)
    ex = args_of(lower, node, scope)[0]
    if ex.kind == "array":
        return Ex(f"CAST(coalesce(size({ex.sql}), 0) AS INT)", scope, INT)
    return Ex(f"CAST({ex.sql} IS NOT NULL AS INT)", scope, INT)


@function("sum avg", 1)
def sum_avg(lower, node, scope):
    ex = args_of(lower, node, scope)[0]
    if ex.kind != "array":
        return ex
    t = ex.type.elementType
    kind = T.DecimalType(38, 6).simpleString() if isinstance(t, T.DecimalType) else t.simpleString()
    known = f"filter({ex.sql}, x -> x IS NOT NULL)"
    total = f"aggregate({known}, CAST(0 AS {kind}), (acc, x) -> CAST(acc + x AS {kind}))"
    if node.name == "avg":
        op = "DIV" if kind in ("int", "bigint") else "/"
        total = f"CAST({total} {op} size({known}) AS {kind})"
    return Ex(f"(CASE WHEN size({known}) > 0 THEN {total} END)", scope, t)


@function("min max", 1)
def min_max(lower, node, scope):
    ex = args_of(lower, node, scope)[0]
    return Ex(f"array_{node.name}({ex.sql})", scope, ex.type.elementType) if ex.kind == "array" else ex


@function("string_agg", 2)
def string_agg(lower, node, scope):
    ex, sep = args_of(lower, node, scope)
    if ex.kind == "array":
        joined = f"array_join(transform({ex.sql}, x -> CAST(x AS STRING)), {lower.as_string(sep)})"
        return Ex(f"(CASE WHEN exists({ex.sql}, x -> x IS NOT NULL) THEN {joined} END)", scope, STRING)
    return Ex(lower.as_string(ex), scope, STRING)


@function("object_array", 0, ANY)
def object_array(lower, node, scope):
    raise QueryError("object_array needs a GROUP BY")


@function("iso_text", 1)
def iso_text(lower, node, scope):
    ex = args_of(lower, node, scope)[0]
    return Ex(offset_text(ex.sql) if ex.kind == "datetimeoffset" else iso(ex.sql), scope, STRING)
