"""Queries for each operator of the dialect over the driver's tables, with equal DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestql.operators import group_arrays, populate_join, top_per_row
from nestql.session import Session
from nestql.sources import ParquetCatalog


def session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(spark, {"p": ParquetCatalog(spark, sf_dir)})


#: name -> (dialect, DuckDB)
TEXTS: dict[str, tuple[str, str | None]] = {
    "revenue_by_nation": (
        """select top 10 n.n_name name, cast(sum(cast(o.o_totalprice as decimal)) as double) total, count(1) cnt
           from orders o inner join customer c on c.c_custkey = o.o_custkey inner join nation n on n.n_nationkey = c.c_nationkey
           group by n.n_name order by total desc, name""",
        """select n_name as name, cast(sum(cast(o_totalprice as decimal(38,6))) as double) as total, cast(count(*) as integer) as cnt
           from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by n_name order by total desc, name limit 10""",
    ),
    "pricing_summary": (
        """select l.l_returnflag, l.l_linestatus, cast(sum(cast(l.l_quantity as decimal)) as double) sum_qty,
                  cast(sum(cast(l.l_extendedprice as decimal)) as double) sum_base, count(1) cnt
           from lineitem l where l.l_shipdate <= cast('1998-09-02T00:00:00' as datetime)
           group by l.l_returnflag, l.l_linestatus order by l_returnflag, l_linestatus""",
        """select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(38,6))) as double) as sum_qty,
                  cast(sum(cast(l_extendedprice as decimal(38,6))) as double) as sum_base, cast(count(*) as integer) as cnt
           from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2 order by 1, 2""",
    ),
    "scan_filter": (
        "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity < 5 and l_returnflag = 'R'",
        "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity < 5 and l_returnflag = 'R'",
    ),
    "index_seek": (
        "select o_orderkey, o_custkey, o_totalprice from orders where o_custkey in (1, 7, 42)",
        "select o_orderkey, o_custkey, o_totalprice from orders where o_custkey in (1, 7, 42)",
    ),
    "projection_case": (
        """select o_orderkey, case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end band,
                  upper(o_orderstatus) + '-' + lower(o_orderpriority) tag from orders""",
        """select o_orderkey, case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band,
                  upper(o_orderstatus) || '-' || lower(o_orderpriority) as tag from orders""",
    ),
    "in_null_list": (
        """select n_nationkey, n_regionkey in (1, null) a, n_regionkey not in (1, null) b, n_regionkey in (n_nationkey, null) c, null in (1, 2) d from nation""",
        """select n_nationkey, n_regionkey in (1) as a, n_regionkey not in (1) as b, n_regionkey = n_nationkey as c, cast(null as boolean) as d from nation""",
    ),
    "like_rlike": (
        "select p_partkey, p_name from part where p_type like '%A%' and p_brand like 'Brand_1_' and not p_name like '%zz%'",
        "select p_partkey, p_name from part where p_type like '%A%' and regexp_full_match(p_brand, 'Brand.?1.?') and p_name not like '%zz%'",
    ),
    "cast_arith_floor": (
        """select l_orderkey, l_linenumber, (l_linenumber - 4) / 3 q, (l_linenumber - 4) % 3 r, cast(l_quantity as int) + 1 i, cast(l_linenumber as string) s,
                  l_quantity / (l_linenumber - 1) f from lineitem where l_linenumber != 1""",
        """select l_orderkey, l_linenumber, cast(floor((l_linenumber - 4) / 3.0) as integer) as q, cast((((l_linenumber - 4) % 3) + 3) % 3 as integer) as r,
                  cast(l_quantity as integer) + 1 as i, cast(l_linenumber as varchar) as s, l_quantity / (l_linenumber - 1) as f from lineitem where l_linenumber <> 1""",
    ),
    "join_inner": (
        "select o.o_orderkey, c.c_name, c.c_mktsegment from orders o inner join customer c on c.c_custkey = o.o_custkey and c.c_acctbal > 0",
        "select o_orderkey, c_name, c_mktsegment from orders join customer on c_custkey = o_custkey and c_acctbal > 0",
    ),
    "join_left": (
        "select c.c_custkey, o.o_orderkey from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_orderstatus = 'F'",
        "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F'",
    ),
    "join_right": (
        "select n.n_name, r.r_name from nation n right join region r on r.r_regionkey = n.n_regionkey and n.n_nationkey < 3",
        "select n_name, r_name from nation right join region on r_regionkey = n_regionkey and n_nationkey < 3",
    ),
    "join_theta": (
        "select n.n_nationkey, r.r_regionkey from nation n inner join region r on n.n_nationkey < r.r_regionkey * 2",
        "select n_nationkey, r_regionkey from nation join region on n_nationkey < r_regionkey * 2",
    ),
    "join_cross": ("select n.n_name, r.r_name from nation n cross join region r", "select n_name, r_name from nation cross join region"),
    "left_is_null_anti": (
        "select c.c_custkey from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_totalprice > 400000 where o.o_orderkey is null",
        "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)",
    ),
    "join_derived": (
        """select x.n_regionkey, r.r_name, x.cnt from (select n_regionkey, count(1) cnt from nation group by n_regionkey) x
           inner join region r on r.r_regionkey = x.n_regionkey""",
        "select n_regionkey, r_name, cast(count(*) as integer) as cnt from nation join region on r_regionkey = n_regionkey group by 1, 2",
    ),
    "self_join": (
        "select a.n_name a_name, b.n_name b_name from nation a inner join nation b on b.n_regionkey = a.n_regionkey and b.n_nationkey = a.n_nationkey + 5",
        "select a.n_name as a_name, b.n_name as b_name from nation a join nation b on b.n_regionkey = a.n_regionkey and b.n_nationkey = a.n_nationkey + 5",
    ),
    "cross_apply_topn": (
        """select c.c_custkey, o.o_orderkey, o.o_totalprice from customer c
           cross apply (select top 2 x.o_orderkey, x.o_totalprice from orders x where x.o_custkey = c.c_custkey order by x.o_totalprice desc, x.o_orderkey) o""",
        """select c_custkey, o_orderkey, o_totalprice from (select c_custkey, o_orderkey, o_totalprice,
           row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) as n from customer join orders on o_custkey = c_custkey) where n <= 2""",
    ),
    "outer_apply_topn": (
        """select c.c_custkey, o.o_orderkey from customer c
           outer apply (select top 1 x.o_orderkey from orders x where x.o_custkey = c.c_custkey and x.o_orderstatus = 'P' order by x.o_orderkey) o""",
        """select c_custkey, (select min(o_orderkey) from orders where o_custkey = c_custkey and o_orderstatus = 'P') as o_orderkey from customer""",
    ),
    "nested_apply": (
        """select r.r_name, y.n_name, y.Value from region r outer apply (
             select n.n_name, z.Value from nation n cross apply range(0, n.n_regionkey) z where n.n_regionkey = r.r_regionkey) y""",
        """select r_name, n_name, cast(v as integer) as "Value" from region left join (select n_regionkey, n_name, unnest(range(0, n_regionkey)) as v
             from nation) on n_regionkey = r_regionkey""",
    ),
    "populate_join": (
        """select r.r_name, n.count() cnt, n.map(x -> x.n_nationkey).sum() keys, n.map(x -> x.n_name).min() first_name
           from region r inner populate join nation n on n.n_regionkey = r.r_regionkey""",
        """select r_name, cast(count(*) as integer) as cnt, cast(sum(n_nationkey) as integer) as keys, min(n_name) as first_name
           from region join nation on n_regionkey = r_regionkey group by r_name""",
    ),
    "left_populate_join": (
        """select c.c_custkey, o is null no_orders, o.count() cnt, o.map(x -> x.o_orderkey).max() last_order
           from customer c left populate join orders o on o.o_custkey = c.c_custkey and o.o_totalprice > 200000""",
        """select c_custkey, count(o_orderkey) = 0 as no_orders, cast(count(o_orderkey) as integer) as cnt, max(o_orderkey) as last_order
           from customer left join orders on o_custkey = c_custkey and o_totalprice > 200000 group by c_custkey""",
    ),
    "populate_theta": (
        "select r.r_regionkey, n.count() cnt from region r inner populate join nation n on n.n_nationkey > r.r_regionkey * 6",
        "select r_regionkey, cast(count(*) as integer) as cnt from region join nation on n_nationkey > r_regionkey * 6 group by 1",
    ),
    "groupby_having": (
        "select o_custkey, count(1) cnt from orders group by o_custkey having count(1) > 12",
        "select o_custkey, cast(count(*) as integer) as cnt from orders group by 1 having count(*) > 12",
    ),
    "groupby_array_columns": (
        "select n_regionkey, n_name.count() names, n_nationkey.sum() keys, upper(n_regionkey) u from (select n_regionkey, n_name, n_nationkey from nation group by n_regionkey) x",
        "select n_regionkey, cast(count(*) as integer) as names, cast(sum(n_nationkey) as integer) as keys, cast(n_regionkey as varchar) as u from nation group by n_regionkey",
    ),
    "mixed_aggregates": (
        "select o_orderstatus, max(o_orderkey) + 1 m, upper(min(o_orderpriority)) p, count(1) * 2 c2 from orders group by o_orderstatus order by count(1) desc",
        "select o_orderstatus, max(o_orderkey) + 1 as m, upper(min(o_orderpriority)) as p, cast(count(*) * 2 as integer) as c2 from orders group by 1",
    ),
    "global_aggregate": (
        "select count(1) cnt, min(l_shipdate) first_ship, max(l_quantity) q from lineitem group by 1",
        "select cast(count(*) as integer) as cnt, min(l_shipdate) as first_ship, max(l_quantity) as q from lineitem",
    ),
    "distinct": ("select distinct l_returnflag, l_linestatus from lineitem", "select distinct l_returnflag, l_linestatus from lineitem"),
    "agg_min_max_avg": (
        "select l_returnflag, min(l_extendedprice) lo, max(l_extendedprice) hi, avg(l_linenumber) a, avg(l_orderkey) k from lineitem group by l_returnflag",
        """select l_returnflag, min(l_extendedprice) as lo, max(l_extendedprice) as hi, cast(sum(l_linenumber) // count(*) as integer) as a,
                  cast(sum(l_orderkey) // count(*) as bigint) as k from lineitem group by 1""",
    ),
    "string_agg_sorted": (
        """select x.n_regionkey, x.names.string_split(',').count() cnt, y.Value name from (select n_regionkey, string_agg(n_name, ',') names from nation group by n_regionkey) x
           cross apply string_split(x.names, ',') y""",
        "select n_regionkey, cast(count(*) over (partition by n_regionkey) as integer) as cnt, n_name as name from nation",
    ),
    "object_array": (
        "select n_regionkey, object_array('key', n_nationkey, 'name', n_name) nations, object('r', n_regionkey) o, array(n_nationkey, n_nationkey) a from nation group by n_regionkey",
        None,
    ),
    "order_nulls_first_top": (
        "select top 7 c.c_custkey, o.o_orderkey from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_totalprice > 480000 order by o.o_orderkey desc nulls last, c_custkey",
        """select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 480000
           order by o_orderkey desc nulls last, c_custkey limit 7""",
    ),
    "order_desc_nulls_default": (
        "select top 5 c.c_custkey, o.o_orderkey from customer c left join orders o on o.o_custkey = c.c_custkey order by 2 desc, 1",
        "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey order by o_orderkey desc nulls first, c_custkey limit 5",
    ),
    "top_expression": ("set @n = 3 select top (@n + 1) p_partkey from part order by p_partkey", "select p_partkey from part order by 1 limit 4"),
    "scalar_subquery": (
        "select n.n_name, (select max(c.c_custkey) m from customer c where c.c_nationkey = n.n_nationkey group by 1) last_customer from nation n",
        "select n_name, (select max(c_custkey) from customer where c_nationkey = n_nationkey) as last_customer from nation",
    ),
    "for_object_array": (
        """select c.c_custkey, (select o.o_orderkey, o.o_totalprice from orders o where o.o_custkey = c.c_custkey order by o.o_orderkey for object_array) orders
           from customer c""",
        None,
    ),
    "for_array_sizes": (
        "select n.n_nationkey, (select c.c_custkey from customer c where c.c_nationkey = n.n_nationkey for array).count() cnt from nation n",
        "select n_nationkey, cast(count(c_custkey) as integer) as cnt from nation left join customer on c_nationkey = n_nationkey group by 1",
    ),
    "values_constant_scan": (
        "select v.id, v.name, n.n_name from (values (1, 'one'), (2, 'two'), (30, 'thirty')) v (id, name) left join nation n on n.n_nationkey = v.id",
        "select id, name, n_name from (values (1, 'one'), (2, 'two'), (30, 'thirty')) v(id, name) left join nation on n_nationkey = id",
    ),
    "range_tvf": ("select Value v, Value * 2 w from range(5, 12)", "select cast(v as integer) as v, cast(v * 2 as integer) as w from range(5, 12) t(v)"),
    "string_split_tvf": (
        """select x.Value word, count(1) cnt from documents d cross apply string_split(d.text, ' \n.,|') x group by x.Value""",
        """select word, cast(count(*) as integer) as cnt from (select unnest(regexp_split_to_array(text, '[ \n.,|]')) as word from documents)
           where word <> '' group by word""",
    ),
    "openjson_props": (
        "select e.event_id, p.k from events e cross apply openjson(e.props) p with (schema='k bigint') where p.k > 50",
        "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where cast(json_extract(props, '$.k') as bigint) > 50",
    ),
    "opencsv_tvf": ("select * from opencsv('a;b\n1;x\n2;y') t with (columnseparator=';')", "select * from (values ('1', 'x'), ('2', 'y')) t(a, b)"),
    "opencsv_column": (
        """select c.c_custkey, t.a, t.b from customer c
           cross apply opencsv(concat(c.c_custkey, ',"', c.c_name, char(10), 'b"', char(10), '2,', c.c_mktsegment)) t with (columnheaders='a,b')""",
        """select c_custkey, cast(c_custkey as varchar) as a, c_name || chr(10) || 'b' as b from customer
           union all select c_custkey, '2', c_mktsegment from customer""",
    ),
    "openxml_column": (
        """select c.c_custkey, t.k, t.v from customer c
           cross apply openxml(concat('<r><e><k>', c.c_custkey, '</k></e><e><k>2</k><v>', c.c_mktsegment, '</v></e></r>')) t with (xmlpath='/r/e', xmlcolumns='k,v')""",
        """select c_custkey, cast(c_custkey as varchar) as k, null as v from customer union all select c_custkey, '2', c_mktsegment from customer""",
    ),
    "string_marks": (
        """select c_custkey, replace(concat(c_name, '%0'), '%0', '%1#') rep, replace('a#b', '#', c_mktsegment) con, regexp_like(concat(c_name, '%1'), '%1$') lik,
                  length(concat(c_name, '😀')) len from customer""",
        """select c_custkey, c_name || '%1#' as rep, 'a' || c_mktsegment || 'b' as con, true as lik, cast(length(c_name) + 2 as bigint) as len from customer""",
    ),
    "string_agg_nulls": (
        """select n_regionkey, string_agg(case when n_nationkey < 3 then 'x' else null end, ',') few from nation group by n_regionkey""",
        "select n_regionkey, string_agg(case when n_nationkey < 3 then 'x' end, ',') as few from nation group by n_regionkey",
    ),
    "array_string_agg": (
        "select c_custkey, array(case when c_custkey > 700 then c_name else null end, null).string_agg('|') s from customer",
        "select c_custkey, case when c_custkey > 700 then c_name end as s from customer",
    ),
    "openxml_tvf": ("select * from openxml('<r><e><k>1</k><v>x</v></e><e><k>2</k></e></r>') t", "select * from (values ('1', 'x'), ('2', null)) t(k, v)"),
    "lambda_map_filter": (
        "select vec_id, embedding.filter(x -> x > 0).count() pos, embedding.map(x -> x > 0.1).filter(b -> b).count() big, embedding[0] first, embedding[9999] none from embeddings",
        """select vec_id, cast(len(list_filter(embedding, lambda x: x > 0)) as integer) as pos, cast(len(list_filter(embedding, lambda x: x > 0.1::float)) as integer) as big,
                  embedding[1] as first, cast(null as float) as none from embeddings""",
    ),
    "any_all_none": (
        "select vec_id, embedding.any(x -> x > 0.3) a, embedding.all(x -> x < 0.9) b, embedding.none(x -> x < -0.4) c, embedding.contains(2.0F) d from embeddings",
        """select vec_id, len(list_filter(embedding, lambda x: x > 0.3::float)) > 0 as a, len(list_filter(embedding, lambda x: not x < 0.9::float)) = 0 as b,
                  len(list_filter(embedding, lambda x: x < -0.4::float)) = 0 as c, list_contains(embedding, 2.0::float) as d from embeddings""",
    ),
    "array_functions": (
        """select n_nationkey, array(n_nationkey, 1, 1).distinct().count() d, array(array(1, n_regionkey), array(2)).flatmap(x -> x).sum() s,
                  toarray(n_regionkey).count() t, array(1, 2, null).max() m from nation""",
        """select n_nationkey, cast(len(list_distinct([n_nationkey, 1, 1])) as integer) as d, cast(3 + n_regionkey as integer) as s, cast(1 as integer) as t,
                  cast(2 as integer) as m from nation""",
    ),
    "date_parts": (
        """select o_orderkey, datepart(year, o_orderdate) y, datepart(quarter, o_orderdate) q, datepart(month, o_orderdate) m, datepart(day, o_orderdate) d,
                  datepart(weekday, o_orderdate) w, datepart(dayofyear, o_orderdate) dy, datepart(week, o_orderdate) wk from orders""",
        """select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, month(o_orderdate) as m, day(o_orderdate) as d, isodow(o_orderdate) as w,
                  dayofyear(o_orderdate) as dy, cast((dayofyear(o_orderdate) + 6) // 7 as bigint) as wk from orders""",
    ),
    "dateadd_diff": (
        """select o_orderkey, dateadd(day, 10, o_orderdate) d, dateadd(month, -1, o_orderdate) m, datediff(day, o_orderdate, cast('1999-01-01T00:00:00' as datetime)) n,
                  unix_timestamp(o_orderdate) ms, cast(o_orderdate as string) iso from orders""",
        """select o_orderkey, o_orderdate + interval 10 day as d, o_orderdate - interval 1 month as m, date_diff('day', o_orderdate, timestamp '1999-01-01') as n,
                  epoch_ms(o_orderdate) as ms, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso from orders""",
    ),
    "time_zones": (
        "select o_orderkey, cast(o_orderdate at time zone 'Europe/Berlin' as string) b, unix_timestamp(o_orderdate at time zone 'America/New_York') ms from orders",
        """select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
             || case when epoch(o_orderdate) - epoch(o_orderdate at time zone 'Europe/Berlin') = 7200 then '+02:00' else '+01:00' end as b,
           cast(epoch(o_orderdate at time zone 'America/New_York') * 1000 as bigint) as ms from orders""",
    ),
    "string_fns": (
        """select c_custkey, substring(c_name, 2, 3) s, lpad(cast(c_custkey as string), 6, '0') l, rpad('ab', 1) r, trim('  x ') t, replace(c_name, '#', '_') rep,
                  length(c_name) len, charindex('#', c_name) ix, left(c_name, 3) le, right(c_name, 2) ri, reverse(c_mktsegment) rev, concat(c_name, null, c_mktsegment) con,
                  isblank('', c_mktsegment) bl, `${c_custkey}:${c_mktsegment}` tpl, base64_decode(base64_encode(c_name)) b64, c_name[0] ch from customer""",
        """select c_custkey, substr(c_name, 3, 3) as s, lpad(cast(c_custkey as varchar), cast(greatest(6, length(cast(c_custkey as varchar))) as integer), '0') as l, 'ab' as r, 'x' as t,
                  replace(c_name, '#', '_') as rep, length(c_name) as len, cast(instr(c_name, '#') - 1 as bigint) as ix, left(c_name, 3) as le, right(c_name, 2) as ri,
                  reverse(c_mktsegment) as rev, c_name || c_mktsegment as con, c_mktsegment as bl, cast(c_custkey as varchar) || ':' || c_mktsegment as tpl, c_name as b64,
                  substr(c_name, 1, 1) as ch from customer""",
    ),
    "math_fns": (
        """select c_custkey, abs(c_acctbal) a, ceiling(c_acctbal) c, floor(c_acctbal) f, least(c_nationkey, 5, null) l, greatest(c_nationkey, 5) g, coalesce(null, c_nationkey) k,
                  isnull(null, 7) i, parseduration('PT1H30M') d, parsedatasize('1.5kb') z from customer""",
        """select c_custkey, abs(c_acctbal) as a, ceil(c_acctbal) as c, floor(c_acctbal) as f, least(c_nationkey, 5) as l, greatest(c_nationkey, 5) as g, c_nationkey as k,
                  cast(7 as integer) as i, cast(5400000 as bigint) as d, cast(1536 as bigint) as z from customer""",
    ),
    "regexp_fns": (
        """select doc_id, regexp_like(text, '[0-9]{3}') has, regexp_match(text, '([0-9])([0-9])').count() pairs from documents""",
        """select doc_id, regexp_matches(text, '[0-9]{3}') as has, cast(2 * len(regexp_extract_all(text, '[0-9][0-9]')) as integer) as pairs from documents""",
    ),
    "json_fns": (
        "select event_id, isjson(props) a, isjsonobject(props) o, isjsonarray(props) r, cast(json_value(props).k as int) k from events",
        "select event_id, true as a, true as o, false as r, cast(json_extract(props, '$.k') as integer) as k from events",
    ),
    "typeof_fns": (
        "select top 1 typeof(null) n, typeof(1) i, typeof(1L) l, typeof(1.5) f, typeof(array(1, 'x')) a, typeof(object('k', 1)) o from region",
        "select 'Any<null>' as n, 'Int' as i, 'Long' as l, 'Float' as f, 'Array<Any>' as a, 'Object' as o",
    ),
    "temp_table_join": (
        """select o_custkey key, count(1) cnt into #counts with (indices=array(array('key'))) from orders group by o_custkey
           select c.c_name, t.cnt from customer c inner join #counts t on t.key = c.c_custkey where t.cnt > 10""",
        "select c_name, cast(count(*) as integer) as cnt from customer join orders on o_custkey = c_custkey group by c_custkey, c_name having count(*) > 10",
    ),
    "variables_if": (
        """set @limit = 400000.0 select @biggest = max(o_orderkey) from orders group by 1
           if @biggest > 10 then select o_orderkey, @biggest top_key from orders where o_totalprice > @limit else select 1 none end if""",
        "select o_orderkey, (select max(o_orderkey) from orders) as top_key from orders where o_totalprice > 400000.0",
    ),
    "assignment_fold": ("set @t = 0 select @t = @t + n_nationkey from nation select @t total", "select cast(sum(n_nationkey) as integer) as total from nation"),
    "totable_apply": (
        """select x.n_regionkey, t.key, t.name from (select n_regionkey, object_array('key', n_nationkey, 'name', n_name) items from nation group by n_regionkey) x
           cross apply (totable(x.items)) t""",
        "select n_regionkey, n_nationkey as key, n_name as name from nation",
    ),
    "dereference_subscript": (
        "select r.r_name, n[99].n_name none, n.n_nationkey.count() keys, n['n_name'].count() names from region r inner populate join nation n on n.n_regionkey = r.r_regionkey",
        "select r_name, cast(null as varchar) as none, cast(count(*) as integer) as keys, cast(count(*) as integer) as names from region join nation on n_regionkey = r_regionkey group by 1",
    ),
    "regexp_groups": (
        "select o_orderkey, regexp_match(o_orderpriority, '(URGENT)|([0-9])-').string_agg(',') found, regexp_match(o_orderpriority, '[A-Z]').count() none from orders",
        """select o_orderkey, nullif(concat_ws(',', nullif(regexp_extract(o_orderpriority, '([0-9])-', 1), ''), nullif(regexp_extract(o_orderpriority, 'URGENT'), '')), '') as found,
                  cast(0 as integer) as none from orders""",
    ),
    "object_aggregates": (
        """select x.n_regionkey, x.o.r r, i.key, i.name, j.Value twice from (select n_regionkey, object_array('key', n_nationkey, 'name', n_name) items,
             object('r', n_regionkey) o from nation group by n_regionkey) x cross apply totable(x.items) i cross apply range(0, 2) j""",
        "select n_regionkey, n_regionkey as r, n_nationkey as key, n_name as name, cast(t as integer) as twice from nation cross join range(0, 2) x(t)",
    ),
    "array_aggregate": (
        "select x.n_regionkey, x.a.sum() s, x.a.count() c from (select n_regionkey, array(n_nationkey, n_nationkey) a from nation group by n_regionkey) x",
        "select n_regionkey, cast(2 * sum(n_nationkey) as integer) as s, cast(2 * count(*) as integer) as c from nation group by n_regionkey",
    ),
    "populate_rows": (
        "select c.c_custkey, x.o_orderkey, x.o_totalprice from customer c inner populate join orders o on o.o_custkey = c.c_custkey cross apply open_table(o) x",
        "select c_custkey, o_orderkey, o_totalprice from customer join orders on o_custkey = c_custkey",
    ),
    "for_object_rows": (
        "select x.n_nationkey, x.o.r_name region from (select n.n_nationkey, (select r.r_name from region r where r.r_regionkey = n.n_regionkey for object) o from nation n) x",
        "select n_nationkey, r_name as region from nation join region on r_regionkey = n_regionkey",
    ),
    "char_format_hash": (
        """select n_nationkey, char(65 + n_nationkey) c, format(n_nationkey, '000') f, hash(n_name) = hash(concat(n_name, '')) same,
                  randomint(10) < 10 small from nation""",
        "select n_nationkey, chr(65 + n_nationkey) as c, printf('%03d', n_nationkey) as f, true as same, true as small from nation",
    ),
    "show_functions": ("show functions", None),
    "describe_plan": ("describe select * from nation where n_nationkey = 1", None),
}


def _text_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).sql(TEXTS[name][0])


# The same operators as functions of DataFrames.


def df_populate(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = populate_join(read("customer"), read("orders").select("o_custkey", "o_orderkey"), [("c_custkey", "o_custkey")], "o", "left")
    return out.select("c_custkey", F.coalesce(F.size("o"), F.lit(0)).alias("cnt"), F.array_max("o.o_orderkey").alias("last_order"))


def df_group_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    out = group_arrays(nation, ["n_regionkey"], [F.col("n_nationkey")])
    return out.select("n_regionkey", F.array_join("n_name", ",").alias("names"))


def df_top_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = top_per_row(read("customer"), read("orders"), [("c_custkey", "o_custkey")], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, outer=True)
    return out.select("c_custkey", "o_orderkey")


def stream_events_batch_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream that is read to its end, batch by batch."""
    import tempfile

    from nestql.streaming import file_stream, run_available

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="nestql-stream-")
    import uuid

    folder = f"{base}/stream-{uuid.uuid4().hex}"
    events = file_stream(spark, f"{sf_dir}/events.parquet")
    return run_available(events, "select event_id, user_id, event_type from stream where value > 10", f"{folder}/out", f"{folder}/checkpoint")


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "df_populate_join": (
        df_populate,
        "select c_custkey, cast(count(o_orderkey) as integer) as cnt, max(o_orderkey) as last_order from customer left join orders on o_custkey = c_custkey group by 1",
    ),
    "df_group_arrays": (df_group_arrays, "select n_regionkey, string_agg(n_name, ',' order by n_nationkey) as names from nation group by 1"),
    "df_top_per_row": (
        df_top_per_row,
        """select c_custkey, o_orderkey from customer left join (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) o
           on o_custkey = c_custkey and n <= 2""",
    ),
    "stream_events_batch_parity": (stream_events_batch_parity, "select event_id, user_id, event_type from events where value > 10"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _text_query(name) for name in TEXTS} | {name: fn for name, (fn, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, (_, sql) in TEXTS.items()} | {name: sql for name, (_, sql) in FRAMES.items()}
    return {name: sql for name, sql in found.items() if sql is not None}
