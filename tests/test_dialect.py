"""Semantics of the dialect, on small tables."""

import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nestql import QueryError, Session
from nestql.sources import MemoryCatalog
from nestql.writers import plain, write_csv, write_json, write_text


@pytest.fixture(scope="module")
def frames(spark):
    make = spark.createDataFrame
    return {
        "source": make([(1, 2), (3, 4), (5, 6)], "col1 int, col2 int"),
        "table": make([(1, 1), (1, 2), (3, 3), (3, 4), (3, 5), (5, 6), (7, 7)], "col1 int, row_id int"),
        "article": make([(1, 2, "row1", 1), (3, 4, "row2", 2), (7, 8, "row3", 3), (6, 9, "row4", 4)], "col1 int, col2 int, col3 string, art_id int"),
        "cart": make([(101, [(1, 1, 1), (2, 1, 2)]), (201, [(2, 2, 1)]), (301, None)], "id int, stock array<struct<sku:int,house:int,qty:int>>"),
        "nulls": make([(1, None), (None, 4), (2, 3)], "a int, b int"),
    }


@pytest.fixture
def session(spark, frames):
    return Session(spark, {"m": MemoryCatalog(spark, dict(frames))})


def rows(session, sql, **variables):
    return [tuple(plain(v) for v in r) for r in session.sql(sql, **variables).collect()]


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("-7 / 2", -4), ("-7 % 2", 1), ("7 % -3", -2), ("7L / 2", 3), ("1.0 / 0", float("inf")), ("'a' + 'b'", "ab"), ("1 + null", None),
        ("2 in (1, null)", False), ("2 not in (1, null)", True), ("null in (1)", None), ("2 in (null)", None), ("2 in (1, 2, null)", True),
        ("'ab' like 'a_'", True), ("'a' like 'a_'", True), ("'abc' like 'a_'", False), ("'a.c' like '%.c'", True), ("'A' like 'a'", False),
        ("substring('hello', 2)", "llo"), ("substring('hello', 2, 2)", "ll"), ("substring(null, 2)", None), ("lpad('A', 4, '#')", "###A"), ("rpad('hello', 2)", "hello"),
        ("trim('xxaxx', 'x')", "a"), ("ltrim('  a ')", "a "), ("upper(456F)", "456.0"), ("length(123)", 3), ("charindex('l', 'hello')", 2), ("charindex('z', 'a')", -1),
        ("concat(null, 'a', 1)", "a1"), ("isblank('', 'x')", "x"), ("coalesce(null, 3)", 3), ("char(65)", "A"), ("reverse('abc')", "cba"), ("right('abc', 2)", "bc"),
        ("`a${1 + 1}${null}b`", "a2b"), ("least(3, null, 1)", 1), ("parseduration('01:30:00')", 5400000), ("parsedatasize('2mb')", 2 * 1024 * 1024),
        ("regexp_like('abc', 'b')", True), ("regexp_match('a1b22', '([a-z])([0-9]+)')", ["a", "1", "b", "22"]), ("regexp_match('x', '([0-9])')", []),
        ("string_split('a,b;;c', ',;')", ["a", "b", "c"]), ("array(1, 2, 3).filter(x -> x > 1).map(x -> x * 2)", [4, 6]), ("array(1, null).contains(null)", True),
        ("array(1, 2)[0]", 1), ("array(1, 2)[9]", None), ("'abc'[1]", "b"), ("array(1, 2, 2).distinct()", [1, 2]), ("array(1, 2).sum()", 3), ("array(1, 2).avg()", 1),
        ("array().any(x -> x > 1)", False), ("array(1, null).all(x -> x > 0)", True), ("array(null, null).none(x -> x > 0)", None), ("array(1, 2).count()", 2),
        ("array(array(1), array(2, 3)).flatmap(x -> x)", [1, 2, 3]), ("typeof(null)", "Any<null>"), ("typeof(1L)", "Long"), ("typeof(array(1, 'a'))", "Array<Any>"),
        ("cast('yes' as boolean)", True), ("cast('12' as int) + 1", 13), ("isjson('{')", False), ("isjsonarray('[1]')", True), ("case when 1 > 2 then 'a' else 'b' end", "b"),
        ("datediff(day, cast('2000-01-01T10:00:00' as datetime), '2000-05-12T10:00:00+00:00')", 132), ("datepart(weekday, cast('2000-01-03T10:00:00' as datetime))", 1),
        ("cast(dateadd(day, 1, cast('2000-01-01T10:00:00' as datetime)) as string)", "2000-01-02T10:00:00"), ("datepart(week, cast('2000-01-08T00:00:00' as datetime))", 2),
        ("unix_timestamp(cast('2023-03-30T11:10:23.915Z' as datetime))", 1680174623915), ("object('a', 1, 'b', 'x')", {"a": 1, "b": "x"}), ("format(10.5D, '0.00', 'de')", "10,50"),
        ("cast(cast('2000-01-01T10:00:00' as datetime) at time zone 'Europe/Berlin' as string)", "2000-01-01T10:00:00+01:00"), ("base64_decode(base64_encode('ä'))", "ä"),
    ],
)
def test_expressions(session, expression, value):
    ((got,),) = rows(session, f"select {expression} v")
    assert got == value


@settings(max_examples=25, deadline=None)
@given(st.integers(-50, 50), st.integers(-9, 9).filter(bool))
def test_integer_division_floors(spark, a, b):
    ((q, r),) = rows(Session(spark, {}), f"select {a} / {b} q, {a} % {b} r")
    assert (q, r) == (a // b, a % b)


@pytest.mark.parametrize(
    "sql",
    [
        "select 2147483647 + 1", "select cast('maybe' as boolean)", "select substring('a', 5)", "select left('a', -1)", "select nope(1)", "select lower('a', 'b')",
        "select x from source", "select s.nope from source s", "select z.* from source s", "select * from source order by 9", "select * from source order by @x",
        "select count(count(col1)) from source group by col2", "select count(distinct col1) from source group by col2", "select * from nowhere", "use nowhere",
    ],
)
def test_failures(session, sql):
    with pytest.raises(Exception):  # noqa: B017
        session.sql(sql).collect()


def test_joins(session):
    assert rows(session, "select s.col1, a.col3 from source s inner join article a on a.col1 = s.col1 order by 1") == [(1, "row1"), (3, "row2")]
    assert rows(session, "select s.col1, a.art_id from source s left join article a on a.col1 = s.col1 order by 1") == [(1, 1), (3, 2), (5, None)]
    assert rows(session, "select s.col1, a.col1 from source s left join article a on a.col1 = s.col1 where a.col1 is null") == [(5, None)]
    assert len(rows(session, "select * from source a cross join source b")) == 9
    assert rows(session, "select n.a, s.col1 from nulls n inner join source s on s.col1 = n.a") == [(1, 1)]
    names = session.sql("select * from source s inner join article a on a.col1 = s.col1").columns
    assert names == ["col1", "col2", "col1", "col2", "col3", "art_id"]


def test_apply(session):
    sql = "select s.col1, x.row_id from source s {} apply (select top 1 t.row_id from \"table\" t where t.col1 = s.col1 and t.row_id < 6 order by t.row_id desc) x order by s.col1"
    assert rows(session, sql.format("cross")) == [(1, 2), (3, 5)]
    assert rows(session, sql.format("outer")) == [(1, 2), (3, 5), (5, None)]
    assert rows(session, "select c.id, t.sku, t.qty from cart c cross apply (totable(c.stock)) t order by 1, 2") == [(101, 1, 1), (101, 2, 2), (201, 2, 1)]
    assert rows(session, "select r.Value, z.Value v from range(1, 4) r cross apply range(0, r.Value) z order by 1, 2") == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]


@pytest.fixture
def spilling(spark):
    """Sorts spill every 100 rows, as on large tables: rows equal in their keys then come in any order."""
    conf, name = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(name, "100")
    yield
    conf.remove(name)


def top_in_apply(spark, how, top, way):
    inner = spark.range(2000).selectExpr("id % 5 k", "id * 7919 % 10007 v", "id w")
    tables = Session(spark, {"m": MemoryCatalog(spark, {"a": spark.range(6).selectExpr("id k"), "b": inner})})
    got = rows(tables, f"select a.k, x.v, x.w from a {how} apply (select top {top} b.v, b.w from b where b.k = a.k order by b.v {way}) x")
    hidden = rows(tables, f"select a.k, x.w from a {how} apply (select top {top} b.w from b where b.k = a.k order by b.v {way}) x")
    want = [(k, v, i) for k in range(5) for v, i in sorted(((i * 7919 % 10007, i) for i in range(k, 2000, 5)), reverse=way == "desc")[:top]]
    want += [(5, None, None)] * (how == "outer")
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(hidden, key=repr) == sorted([(k, w) for k, _, w in want], key=repr)


@pytest.mark.parametrize("way", ["", "desc"])
def test_cross_apply_ranks_by_its_order(spark, spilling, way):
    top_in_apply(spark, "cross", 2, way)


@pytest.mark.parametrize("way", ["", "desc"])
def test_outer_apply_ranks_by_its_order(spark, spilling, way):
    top_in_apply(spark, "outer", 1, way)


def test_populate(session):
    got = rows(session, 'select s.col1, t.map(x -> x.row_id) ids from source s inner populate join "table" t on t.col1 = s.col1 order by 1')
    assert [(a, sorted(b)) for a, b in got] == [(1, [1, 2]), (3, [3, 4, 5]), (5, [6])]
    got = rows(session, "select s.col1, a from source s left populate join article a on a.col1 = s.col1 order by 1")
    assert got[2] == (5, None) and got[0][1] == [{"col1": 1, "col2": 2, "col3": "row1", "art_id": 1}]
    got = rows(session, 'select s.col1, t.row_id from source s inner populate join "table" t on t.row_id > s.col1 + 3 order by 1')
    assert [(a, sorted(b)) for a, b in got] == [(1, [5, 6, 7]), (3, [7])]


def test_grouping_makes_arrays_and_keeps_nulls(session):
    got = rows(session, "select s.col1, s.col2, a.col1, a.col2 from source s inner join article a on a.col1 = s.col1 group by s.col1, a.col2 order by s.col1")
    assert got == [(1, [2], [1], 2), (3, [4], [3], 4)]
    ((values, total, count),) = rows(session, "select b, sum(b) s, count(b) c from nulls group by 'all'")
    assert sorted(values, key=str) == [3, 4, None] and (total, count) == (7, 2)
    assert rows(session, "select a + 1 x, max(b) m from nulls group by a + 1 having max(b) > 3") == [(None, 4)]


def test_order(session):
    assert [r[0] for r in rows(session, "select b from nulls order by b")] == [None, 3, 4]
    assert [r[0] for r in rows(session, "select b from nulls order by b desc")] == [None, 4, 3]
    assert [r[0] for r in rows(session, "select b from nulls order by b desc nulls last")] == [4, 3, None]
    assert rows(session, "select top (@n) col1 from source order by col2 desc", n=2) == [(5,), (3,)]


def test_subqueries_and_shapes(session):
    sql = 'select s.col1, (select t.row_id from "table" t where t.col1 = s.col1 order by t.row_id desc for array) ids from source s order by 1'
    assert rows(session, sql) == [(1, [2, 1]), (3, [5, 4, 3]), (5, [6])]
    sql = "select s.col1, (select a.art_id id from article a where a.col1 = s.col1 for object_array) x from source s order by 1"
    assert rows(session, sql) == [(1, [{"id": 1}]), (3, [{"id": 2}]), (5, None)]
    assert rows(session, "select (select col1 + 1 k for object) o from source order by col1") == [({"k": 2},), ({"k": 4},), ({"k": 6},)]
    assert rows(session, "select col1 from source where col1 > 9 for array") == [(None,)]
    with pytest.raises(Exception, match="(?i)more than one row"):
        rows(session, 'select (select t.row_id from "table" t where t.col1 = s.col1) x from source s')


def test_scripts(session):
    script = """
        set @a = 2
        select @sum = 0
        select @sum = @sum + col1 * @a from source
        if @sum = 18 then print 'yes' else print 'no' end if
        select @sum total
    """
    assert rows(session, script) == [(18,)]
    assert session.printed == ["yes"]
    assert rows(session, "select @x = max(col1) from source group by 1 select @x x") == [(5,)]


def test_temporary_tables(session):
    got = session.execute("select col1 * 2 n into #t with (indices=array(array('n'))) from source select * from #t order by n select * from sys#tables")
    assert [tuple(r) for r in got[0].collect()] == [(2,), (6,), (10,)]
    assert [tuple(r) for r in got[1].collect()] == [("t", "n (Int)", "ALL: [n]", 3)]
    for sql, message in (
        ("select 1 a into #t", "Temporary table #t already exists in session"), ("drop table #u", "No temporary table found with name #u"),
        ("select * from #u", "No temporary table found with name #u"), ("select 1 a into #v with (cachePrefix='c_')", "CacheTTL hint is mandatory"),
        ("select 1 a into #v with (cacheTtl='PT1M', cachePrefix=@none)", "evaluated to null"), ("insert into #t select 1 n", "not supported"),
    ):
        with pytest.raises(QueryError, match=message):
            session.execute(sql)
    assert session.execute("drop table #t drop table if exists #t") == []


def test_cached_temporary_tables(session):
    into = "select 1 a into #c with (cacheTtl='PT10M')"
    session.execute(f"{into} drop table #c {into}")
    (row,) = session.sql("show caches").collect()
    assert (row["name"], row["size"], row["hits"], row["misses"]) == ("c", 1, 1, 1)
    assert session.sql("cache flush temptable/c show caches").first()["size"] == 0
    assert session.sql("cache remove temptable/* show caches").count() == 0


def test_insert_and_catalogs(session):
    session.execute("select col1, col2 into m#copy from source insert into copy (col1, col2) values (9, 10) insert into copy (col1, col2) select top 1 col1, col2 from source order by 1")
    assert sorted(rows(session, "select col1, col2 from copy")) == [(1, 2), (1, 2), (3, 4), (5, 6), (9, 10)]
    with pytest.raises(QueryError, match="names 1 columns"):
        session.execute("insert into copy (col1) select col1, col2 from source")
    session.execute("drop table copy")
    with pytest.raises(QueryError, match="No table found"):
        session.execute("select * from copy")


def test_table_functions(session):
    assert rows(session, "select * from openjson('[1, 2]')") == [(1,), (2,)]
    assert rows(session, "select * from openjson('{\"a\": {\"b\": [{\"k\": 1}, {\"k\": null}]}}') x with (jsonpath='/a/b')") == [(1,), (None,)]
    assert rows(session, "select * from openxml('<r><a id=\"1\"><b>x</b><b>y</b></a></r>') x") == [("1", ["x", "y"])]
    assert rows(session, "select * from opencsv('1,2', 'x') x with (columnheaders='p,q,r')") == [("1", "2", None)]
    assert rows(session, "select s.Ordinal, s.Value from string_split('a-b]c', '-]') s order by 1") == [(0, "a"), (1, "b"), (2, "c")]
    assert rows(session, "select * from string_split(null, ',')") == []
    assert rows(session, "select * from (array(1, 2)) x order by 1") == [(1,), (2,)]


def test_files(spark, tmp_path):
    from nestql.sources.filesystem import FilesystemCatalog

    session = Session(spark, {"fs": FilesystemCatalog(spark, str(tmp_path))})
    session.execute("select Value a, Value * 2 b into \"t.json\" from range(3) select Value a into \"t.csv\" from range(2)")
    assert rows(session, 'select a, b from "t.json" order by a') == [(0, 0), (1, 2), (2, 4)]
    assert rows(session, 'select a from "t.csv" order by a') == [("0",), ("1",)]
    session.execute('insert into "t.json" (a, b) values (9, 9)')
    assert len(rows(session, 'select * from "t.json"')) == 4
    (tmp_path / "x.txt").write_text("one\ntwo\n")
    assert rows(session, 'select * from "x.txt"') == [("one",), ("two",)]
    assert rows(session, "select contents('x.txt') c") == [("one\ntwo\n",)]
    assert [r[0] for r in rows(session, "select name from list('.') l where l.name like 'x%'")] == ["x.txt"]
    session.execute('drop table "t.csv"')
    with pytest.raises(QueryError):
        session.execute('drop table "t.csv"')


def test_remote_options():
    from nestql.sources.remote import elastic_query, kafka_options, render_template

    assert kafka_options("t", {"start": "earliest", "end": "1700000000000"}) == {"subscribe": "t", "failOnDataLoss": "true", "startingOffsets": "earliest", "endingTimestamp": "1700000000000"}
    with pytest.raises(QueryError):
        kafka_options("t", {"mode": "stream", "sort_order": "newest"})
    assert elastic_query([("a", "=", 1), ("b", "missing", None)]) == {"query": {"bool": {"filter": [{"term": {"a": 1}}], "must_not": [{"exists": {"field": "b"}}]}}}
    assert render_template('{"q": "{{x}}", "n": {{n}}}', {"x": "a", "n": 3}) == '{"q": "a", "n": 3}'


@pytest.mark.parametrize(("policy", "expected"), [("skip", [1]), ("null", [None, 1])])
def test_decoding(spark, policy, expected):
    from nestql.sources.remote import decoded

    df = spark.createDataFrame([(b'{"k": 1}',), (b"oops",)], "value binary")
    got = [r["value"]["k"] if r["value"] else None for r in decoded(df, {"format": "json", "schema": "k int", "on_error": policy}).collect()]
    assert sorted(got, key=str, reverse=True) == sorted(expected, key=str, reverse=True)


def test_udfs(spark, session):
    import pandas as pd
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    @F.pandas_udf("int")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    session.functions.register_udf("twice", twice, T.IntegerType())
    assert rows(session, "select twice(col1) t from source order by 1") == [(2,), (6,), (10,)]


def test_own_aggregate(session):
    import pandas as pd
    from pyspark.sql import types as T
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(T.IntegerType())
    def spread(x: pd.Series) -> int:
        return int(x.max() - x.min())

    session.functions.register_aggregate("spread", spread, T.IntegerType())
    assert rows(session, "select col1 % 2 k, spread(col1) s from source group by col1 % 2") == [(1, 4)]
    assert ("spread", "AGGREGATE") in session.functions.names()


def test_own_operator(session):
    from pyspark.sql import types as T

    session.functions.register_operator("row_count", "size({})", lambda row: T.IntegerType())
    assert rows(session, "select (select s.col1 from source s for row_count) n") == [(3,)]
    with pytest.raises(QueryError):
        rows(session, "select (select s.col1 from source s for no_such) n")


def test_regexp_groups(session):
    assert rows(session, "select regexp_match('ab', '(a)|(b)') g") == [(["a", "b"],)]
    assert rows(session, "select regexp_match('ab', '(a)(x*)') g") == [(["a", ""],)]
    assert rows(session, "select regexp_match('ab', 'c(d)') g") == [([],)]


def test_writers(session):
    out = io.StringIO()
    write_json(session.execute("select 1 a, 1 a, object('k', 'x') o select 2 b where false"), out)
    assert out.getvalue() == '[[{"a": 1, "a": 1, "o": {"k": "x"}}],[]]'
    out = io.StringIO()
    write_csv(session.execute("select 1 a, 'x,y' b, null c"), out)
    assert out.getvalue() == 'a,b,c\n1,"x,y",\n'
    out = io.StringIO()
    write_text(session.execute("select 1 a, 'x' b"), out)
    assert out.getvalue() == "1\tx\n"


def test_plans_reach_the_scan(spark, data):
    from nestql.queries import session as tables

    plan = "\n".join(r["plan"] for r in tables(spark, data).sql("describe select l_orderkey from lineitem where l_quantity < 5").collect())
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_stream(spark, data):
    from nestql.queries import queries

    assert queries()["stream_events_batch_parity"](spark, data).count() == spark.read.parquet(f"{data}/events.parquet").where("value > 10").count()


def test_arguments_by_name(spark, tmp_path):
    from nestql.sources.filesystem import FilesystemCatalog

    (tmp_path / "in").mkdir()
    for name in ("a.txt", "in/b.txt"):
        (tmp_path / name).write_text("x")
    session = Session(spark, {"fs": FilesystemCatalog(spark, str(tmp_path))})
    names = lambda q: sorted(r["name"] for r in session.sql(q).collect())
    assert names("select x.name from fs#list('.') x") == ["a.txt"]
    assert names("select x.name from fs#list(path: '.', recursive: true) x") == ["a.txt", "b.txt"]
    for bad in ("select * from fs#list(folder: '.') x", "select * from fs#list('.', path: '.') x", "select * from fs#list(recursive: true) x", "select upper(x: 'a') y", "select * from range(from: 3) x"):
        with pytest.raises(QueryError):
            session.sql(bad)


def test_durations_have_no_sign(session):
    with pytest.raises(Exception, match="Not a duration"):
        session.sql("select parseduration('-PT5M') d").collect()
