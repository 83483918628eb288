"""The queries of the engine over the driver's tables, by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.shape import nested_json
from .session import Engine
from .sources.catalog import Catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def engine(spark: SparkSession, sf_dir: str, **kw) -> Engine:
    return Engine(Catalog.parquet(spark, sf_dir, TABLES), **kw)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, text: str, sql: str, result: str | None = None) -> None:
    """A document with one frame (or the frame of ``result``); doubles are rounded to 4 places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(engine(spark, sf_dir).frame(text, result))

    QUERIES[name] = run
    SQL[name] = sql


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), 4).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


add("q_project_alias", "query customer { fetchPlain { key: c_custkey seg: c_mktsegment } }", "SELECT c_custkey AS key, c_mktsegment AS seg FROM customer")
add("q_project", "query nation { fetchPlain { n_nationkey n_name } }", "SELECT n_nationkey, n_name FROM nation")
add("q_distinct", "query customer { fetchPlain { c_mktsegment: distinct } }", "SELECT DISTINCT c_mktsegment FROM customer")
add("q_min_slice", 'query lineitem { fetch(l_shipdate_gt: "1997-1-1") { l_returnflag { qty: sum(a: l_quantity) } } }', "SELECT l_returnflag, round(sum(l_quantity), 4) AS qty FROM lineitem WHERE l_shipdate > '1997-1-1' GROUP BY 1")
add("q_eq", "query orders { fetch(o_orderstatus: F) { o_orderpriority { v: sum(a: o_totalprice) } } }", "SELECT o_orderpriority, round(sum(o_totalprice), 4) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
add("q_range", 'query orders { fetch(o_orderdate_gte: "1997-1-1", o_orderdate_lt: "1998-1-1", o_totalprice_gt: 1000, o_totalprice_lte: 400000) { o_orderstatus { n: count(a: o_orderkey) } } }', "SELECT o_orderstatus, count(o_orderkey) AS n FROM orders WHERE o_orderdate >= '1997-1-1' AND o_orderdate < '1998-1-1' AND o_totalprice > 1000 AND o_totalprice <= 400000 GROUP BY 1")
add("q_like", 'query part { fetch(p_name_like: "red%") { p_brand { n: count(a: p_partkey) } } }', "SELECT p_brand, count(p_partkey) AS n FROM part WHERE p_name LIKE 'red%' GROUP BY 1")
add("q_in", 'query customer { fetch(c_mktsegment_in: "BUILDING|MACHINERY") { c_nationkey { n: count(a: c_custkey) } } }', "SELECT c_nationkey, count(c_custkey) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
add("q_adv_filter", 'query part { fetch(filters: { p_size: { gte: 10, lte: 40 }, p_type: { in: ["PROMO", "SMALL", "LARGE"], nin: ["LARGE"] }, p_brand: { ne: "Brand#13" } }) { p_type { n: count(a: p_partkey) } } }', "SELECT p_type, count(p_partkey) AS n FROM part WHERE p_size >= 10 AND p_size <= 40 AND p_type IN ('PROMO', 'SMALL', 'LARGE') AND p_type NOT IN ('LARGE') AND p_brand <> 'Brand#13' GROUP BY 1")
add("q_or_nor_not", 'query part { fetch(filters: { or: [{ p_size: { lt: 5 } }, { p_size: { gt: 45 } }], nor: [{ p_type: "PROMO" }, { p_type: { eq: "SMALL" } }], not: { p_brand: { regex: "Brand#1%" } } }) { p_brand { n: count(a: p_partkey) } } }', "SELECT p_brand, count(p_partkey) AS n FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT (p_type = 'PROMO' OR p_type = 'SMALL') AND NOT (p_brand LIKE 'Brand#1%') GROUP BY 1")
add("q_and_nested", 'query part { fetch(filters: { and: [{ p_size: { gt: 3, not: { eq: 7 } } }, { from: part, p_name: { regex: "%bolt" } }] }) { p_size { n: count(a: p_partkey) } } }', "SELECT p_size, count(p_partkey) AS n FROM part WHERE p_size > 3 AND NOT (p_size = 7) AND p_name LIKE '%bolt' GROUP BY 1")
add("q_inherited", 'query part { fetch(table: supplier, filters: { and: [{ from: part, inherited: false, p_size: { gt: 3 } }, { s_acctbal: { gt: 0 } }] }) { s_nationkey { n: count(a: s_suppkey) } } }', "SELECT s_nationkey, count(s_suppkey) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
add("q_having", "query lineitem { fetch(filters: { l_discount: { gt: 0.02 }, having: { n: { gt: 40 } } }) { l_suppkey { n: count(a: l_orderkey) qty: sum(a: l_quantity) } } }", "SELECT l_suppkey, count(l_orderkey) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem WHERE l_discount > 0.02 GROUP BY 1 HAVING count(l_orderkey) > 40")
add("q_having_share", "query lineitem { fetch(filters: { having: { n: { gt: 600 } } }) { l_suppkey { n: count(a: l_orderkey) v: share(a: l_quantity) top: indexed(a: l_quantity) } } }", "SELECT l_suppkey, count(l_orderkey) AS n, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 4) AS v, round(sum(l_quantity) / max(sum(l_quantity)) OVER (), 4) AS top FROM lineitem GROUP BY 1 HAVING count(l_orderkey) > 600")
add("q_having_share_by", "query lineitem { fetch(filters: { having: { or: [{ n: { gt: 155 } }, { qty: { lt: 3500 } }] } }) { l_suppkey { l_linestatus { n: count(a: l_orderkey) qty: sum(a: l_quantity) v: share(a: l_quantity, by: l_suppkey) } } } }", "SELECT l_suppkey, l_linestatus, count(l_orderkey) AS n, round(sum(l_quantity), 4) AS qty, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey), 4) AS v FROM lineitem GROUP BY 1, 2 HAVING count(l_orderkey) > 155 OR sum(l_quantity) < 3500")
add("q_having_cutoff", "query lineitem { fetch(filters: { having: { n: { gt: 600 } } }) { l_suppkey(cutoff: l_quantity) { n: count(a: l_orderkey) } } }", "SELECT l_suppkey, count(l_orderkey) AS n, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 4) AS cutoff FROM lineitem GROUP BY 1 HAVING count(l_orderkey) > 600")
add("q_search", 'query part { fetchPlain(filters: { search: { p_name: "red wid" } }) { key: p_partkey score: searchRanking(a: p_name) head: searchHeadline(a: p_name) } }', """
SELECT p_partkey AS key, round(0.1 * 1 / 2 + 0.1 / 4 / 2, 4) AS score,
  regexp_replace(p_name, '(red|wid[a-z]*)', '<b>\\1</b>', 'g') AS head
FROM part WHERE list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), 'red')
  AND len(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: starts_with(w, 'wid'))) > 0""")
add("q_search_top", 'query part { fetch(search: { p_name: "bol" }) { p_brand { n: count(a: p_partkey) } } }', "SELECT p_brand, count(p_partkey) AS n FROM part WHERE len(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: starts_with(w, 'bol'))) > 0 GROUP BY 1")
add("q_sum_min_max_count_avg", "query lineitem { fetch { l_returnflag { s: sum(a: l_quantity) lo: min(a: l_extendedprice) hi: max(a: l_extendedprice) n: count(a: l_orderkey) m: avg(a: l_discount) } } }", "SELECT l_returnflag, round(sum(l_quantity), 4) AS s, round(min(l_extendedprice), 4) AS lo, round(max(l_extendedprice), 4) AS hi, count(l_orderkey) AS n, round(avg(l_discount), 4) AS m FROM lineitem GROUP BY 1")
add("q_count_distinct", "query lineitem { fetch { l_linestatus { n: countDistinct(a: l_suppkey) } } }", "SELECT l_linestatus, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
add("q_percentile", "query lineitem { fetch { l_returnflag { med: percentile(a: l_extendedprice) p90: percentile(a: l_extendedprice, factor: 0.9) } } }", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
add("q_percentile_beside", "query lineitem { fetch { l_returnflag(type: Array) { st: unique(a: l_linestatus) med: percentile(a: l_quantity) s: share(a: l_quantity) n: count(a: l_orderkey) hi: max(a: l_shipdate) } } }", "SELECT l_returnflag, l_linestatus AS st, round(quantile_cont(l_quantity, 0.5), 4) AS med, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 4) AS s, count(l_orderkey) AS n, max(l_shipdate) AS hi FROM lineitem GROUP BY 1, 2")
add("q_percentile_two", "query lineitem { fetch { l_returnflag { med: percentile(a: l_quantity) low: percentile(a: l_extendedprice, factor: 0.25) d: countDistinct(a: l_suppkey) } } }", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.25), 4) AS low, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY 1")
add("q_having_percentile", "query lineitem { fetch(filters: { having: { med: { gt: 26 } } }) { l_suppkey { med: percentile(a: l_quantity) n: count(a: l_orderkey) } } }", "SELECT l_suppkey, round(quantile_cont(l_quantity, 0.5), 4) AS med, count(l_orderkey) AS n FROM lineitem GROUP BY 1 HAVING quantile_cont(l_quantity, 0.5) > 26")
add("q_divide", 'query lineitem { fetch { l_returnflag { a: divide(a: "max|l_extendedprice", by: "sum|l_quantity") b: divide(a: l_extendedprice, by: l_quantity) } } }', "SELECT l_returnflag, round(max(l_extendedprice) / nullif(sum(l_quantity), 0), 4) AS a, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 4) AS b FROM lineitem GROUP BY 1")
add("q_avg_per_dim", "query lineitem { fetch { l_returnflag { v: avgPerDimension(a: l_quantity, per: l_orderkey) } } }", "SELECT l_returnflag, round(sum(l_quantity) / count(DISTINCT l_orderkey), 4) AS v FROM lineitem GROUP BY 1")
add("q_weight_avg", "query lineitem { fetch { l_returnflag { v: weightAvg(a: l_discount, by: l_quantity) } } }", "SELECT l_returnflag, round(sum(x) / sum(w), 4) AS v FROM (SELECT l_returnflag, l_discount * sum(l_quantity) AS x, sum(l_quantity) AS w FROM lineitem GROUP BY l_returnflag, l_discount) GROUP BY 1")
add("q_aggr_average", "query lineitem { fetch { l_returnflag { l_linenumber: aggrAverage(to: l_quantity, by: l_extendedprice) n: count(a: l_orderkey) } } }", 'SELECT l_returnflag, round(sum(l_linenumber * t) / max(b), 4) AS "l_linenumber_aggrAverage", sum(c)::BIGINT AS n FROM (SELECT l_returnflag, l_linenumber, sum(l_quantity) AS t, sum(l_extendedprice) AS b, count(l_orderkey) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1')
add("q_unique", "query part { fetch { p_brand { kind: unique(a: p_type) n: count(a: p_partkey) } } }", "SELECT p_brand, p_type AS kind, count(p_partkey) AS n FROM part GROUP BY 1, 2")
add("q_share", "query lineitem { fetch { l_returnflag { v: share(a: l_quantity) } } }", "SELECT l_returnflag, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 4) AS v FROM lineitem GROUP BY 1")
add("q_share_by", "query lineitem { fetch { l_returnflag { l_linestatus { v: share(a: l_quantity, by: l_returnflag) } } } }", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 4) AS v FROM lineitem GROUP BY 1, 2")
add("q_share_month", "query orders { fetch { o_orderdate(groupBy: month) { o_orderstatus { v: share(a: o_totalprice, by: o_orderdate) } } } }", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, o_orderstatus, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY date_trunc('month', o_orderdate)), 4) AS v FROM orders GROUP BY date_trunc('month', o_orderdate), o_orderstatus")
add("q_indexed", "query lineitem { fetch { l_returnflag { v: indexed(a: l_quantity) } } }", "SELECT l_returnflag, round(sum(l_quantity) / max(sum(l_quantity)) OVER (), 4) AS v FROM lineitem GROUP BY 1")
add("q_indexed_by", "query lineitem { fetch { l_returnflag { l_linestatus { v: indexed(a: l_quantity, by: l_linestatus) } } } }", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity) / max(sum(l_quantity)) OVER (PARTITION BY l_linestatus), 4) AS v FROM lineitem GROUP BY 1, 2")
add("q_cutoff", "query orders { fetch { o_orderpriority(cutoff: o_totalprice) { n: count(a: o_orderkey) } } }", "SELECT o_orderpriority, count(o_orderkey) AS n, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 4) AS cutoff FROM orders GROUP BY 1")
for _name, _alg, _fn in (("dense", "denseRank", "dense_rank"), ("rank", "rank", "rank"), ("rownum", "rowNumber", "row_number")):
    add(f"q_rank_{_name}", f"query orders {{ ranked: with {{ o_orderkey {{ st: unique(a: o_orderstatus) r: ranking(a: o_orderkey, by: o_orderstatus, alg: {_alg}) }} }} top: fetchPlain(table: ranked, r_lte: 3) {{ o_orderkey st r }} }}", f"SELECT * FROM (SELECT o_orderkey, o_orderstatus AS st, {_fn}() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC)::INT AS r FROM orders) WHERE r <= 3")
add("q_rank_global", "query supplier { fetch { r: ranking(a: s_acctbal) n: count(a: s_suppkey) } }", "SELECT r, count(s_suppkey) AS n FROM (SELECT s_suppkey, dense_rank() OVER (ORDER BY s_acctbal DESC)::INT AS r FROM supplier) GROUP BY 1")
add("q_window_avg", "query orders { fetchPlain { k: o_orderkey a: avg(a: o_totalprice, by: o_orderstatus) } }", "SELECT o_orderkey AS k, round(avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 4) AS a FROM orders")
add("q_bucket", "query part { fetch { p_size(groupByEach: 10) { lo: groupByEach_min_p_size hi: groupByEach_max_p_size n: count(a: p_partkey) } } }", "SELECT (b * 10)::VARCHAR || '-' || (b * 10 + 9)::VARCHAR AS p_size, (b * 10)::INT AS lo, (b * 10 + 9)::INT AS hi, count(*) AS n FROM (SELECT floor(ceil(p_size) / 10)::INT AS b FROM part) GROUP BY b")
add("q_bucket_price", "query part { fetch { p_retailprice(groupByEach: 50) { n: count(a: p_partkey) } } }", "SELECT (b * 50)::VARCHAR || '-' || (b * 50 + 49)::VARCHAR AS p_retailprice, count(*) AS n FROM (SELECT floor(ceil(p_retailprice) / 50)::INT AS b FROM part) GROUP BY b")
for _unit in ("week", "month", "quarter", "year", "decade"):
    add(f"q_{_unit}", f"query orders {{ fetch {{ o_orderdate(groupBy: {_unit}) {{ v: sum(a: o_totalprice) }} }} }}", f"SELECT date_trunc('{_unit}', o_orderdate)::TIMESTAMP AS o_orderdate, round(sum(o_totalprice), 4) AS v FROM orders GROUP BY 1")
for _unit, _n in (("century", 100), ("millennium", 1000)):  # those begin in years that follow a multiple
    add(f"q_{_unit}", f"query orders {{ fetch {{ o_orderdate(groupBy: {_unit}) {{ v: sum(a: o_totalprice) }} }} }}", f"SELECT make_date((((year(o_orderdate) - 1) // {_n}) * {_n} + 1)::INT, 1, 1)::TIMESTAMP AS o_orderdate, round(sum(o_totalprice), 4) AS v FROM orders GROUP BY 1")
add("q_bucket_alias", 'query customer { fetch(join: { table: orders, by: "c_custkey:o_custkey" }) { o_orderdate(groupBy: year, groupByAlias: orders) { n: count(a: c_custkey) } } }', "SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS o_orderdate, count(c_custkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
add("q_bucket_fraction", "query customer { fetch { c_acctbal(groupByEach: 2500) { n: count(a: c_custkey) } } }", "SELECT (b * 2500)::VARCHAR || '-' || (b * 2500 + 2499)::VARCHAR AS c_acctbal, count(*) AS n FROM (SELECT floor(ceil(c_acctbal) / 2500)::INT AS b FROM customer) GROUP BY b")
add("q_combine", 'query lineitem { fetch { combine(fields: ["l_returnflag", { name: "l_linestatus", alias: "st" }]) { qty: sum(a: l_quantity) } } }', "SELECT l_returnflag, l_linestatus AS st, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY 1, 2")
add("q_join_inner", 'query orders { fetch(join: { table: customer, by: "o_custkey:c_custkey" }) { c_mktsegment(from: customer) { v: sum(a: o_totalprice) } } }', "SELECT c_mktsegment, round(sum(o_totalprice), 4) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
add("q_join_on", 'query orders { fetch { innerJoin(table: customer, on: { c_custkey: "@o_custkey" }) { c_nationkey { n: count(a: o_orderkey) } } } }', "SELECT c_nationkey, count(o_orderkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
for _kind, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    for _outer in ("", "Outer"):
        add(f"q_join_{_kind}{_outer.lower()}", f'query supplier {{ fetch {{ {_kind}{_outer}Join(table: nation, by: "s_nationkey:n_nationkey") {{ n_name {{ n: count(a: s_suppkey) }} }} }} }}', f"SELECT n_name, count(s_suppkey) AS n FROM supplier {_sql} JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
add("q_join_theta", 'query nation { fetch(leftJoin: { table: region, by_gt: "n_nationkey:r_regionkey", by_lte: "n_regionkey:r_regionkey" }) { n_regionkey { n: count(a: r_name, from: region) } } }', "SELECT n_regionkey, count(r_name) AS n FROM nation LEFT JOIN region ON n_nationkey > r_regionkey AND n_regionkey <= r_regionkey GROUP BY 1")
add("q_join_lt", 'query nation { fetch(join: { table: region, by_lt: "n_regionkey:r_regionkey" }) { n_name { n: count(a: r_name) } } }', "SELECT n_name, count(r_name) AS n FROM nation JOIN region ON n_regionkey < r_regionkey GROUP BY 1")
add("q_join_theta_gt", 'query nation { fetch(join: { table: region, by_gte: "n_regionkey:r_regionkey" }) { n_name { n: count(a: r_name) } } }', "SELECT n_name, count(r_name) AS n FROM nation JOIN region ON n_regionkey >= r_regionkey GROUP BY 1")
add("q_join_like", 'query customer { segs: with(c_mktsegment_like: "%U%") { c_mktsegment { held: count(a: c_custkey) } } fetch(join: { table: segs, by_like: "c_mktsegment:c_mktsegment" }) { c_mktsegment { n: count(a: c_custkey) } } }', "SELECT c_mktsegment, count(c_custkey) AS n FROM customer JOIN (SELECT c_mktsegment AS m FROM customer WHERE c_mktsegment LIKE '%U%' GROUP BY 1) ON c_mktsegment LIKE m GROUP BY 1", "")
add("q_join_on_tree", 'query supplier { fetch(join: { table: nation, on: { n_nationkey: "@s_nationkey", or: [{ n_regionkey: { gt: 2 } }, { n_name: { regex: "%A%" } }] } }) { n_name { n: count(a: s_suppkey) } } }', "SELECT n_name, count(s_suppkey) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey AND (n_regionkey > 2 OR n_name LIKE '%A%') GROUP BY 1")
add("q_join_from", 'query orders { fetchPlain(join: { table: customer, by: "@o_custkey:@c_custkey" }) { k: o_orderkey seg: from(from: customer, a: c_mktsegment) c_nationkey(from: customer) } }', "SELECT o_orderkey AS k, c_mktsegment AS seg, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
CTE = """query lineitem {
  sold: with(filters: { l_shipdate: { gte: "1996-01-01", lte: "1998-12-31" }, l_quantity: { gte: 10 }, l_returnflag: { in: ["A", "R"], nin: ["N"] } }) {
    join(table: part, on: { p_partkey: "@l_partkey" }) {
      l_partkey(type: Array, from: lineitem, sort_desc: value) {
        value: sum(a: l_extendedprice)
        price: unique(a: p_retailprice, from: part)
        brand: unique(a: p_brand, from: part)
      }
    }
  }
  all: fetch(table: sold) {
    brand(type: Array, sort_desc: marketShare, limit: 10) { price: percentile(a: price) marketShare: share(a: value) }
  }
}"""
CTE_SQL = """WITH sold AS (
  SELECT l_partkey, sum(l_extendedprice) AS value, p_retailprice AS price, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_shipdate >= '1996-01-01' AND l_shipdate <= '1998-12-31' AND l_quantity >= 10 AND l_returnflag IN ('A', 'R') AND l_returnflag NOT IN ('N')
  GROUP BY l_partkey, p_retailprice, p_brand)
SELECT brand, round(quantile_cont(price, 0.5), 4) AS price, round(share, 4) AS "marketShare" FROM (
  SELECT brand, sum(value) / sum(sum(value)) OVER () AS share FROM sold GROUP BY brand) JOIN sold USING (brand)
GROUP BY brand, share ORDER BY share DESC LIMIT 10"""
add("q_cte", CTE, CTE_SQL, "all")
add("q_cte_unnamed", "query orders { big: with(o_totalprice_gt: 200000) { o_custkey { n: count(a: o_orderkey) } } fetch(table: big) { customers: count(a: o_custkey) most: max(a: n) } }", "SELECT count(o_custkey) AS customers, max(n) AS most FROM (SELECT o_custkey, count(o_orderkey) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1)", "")
add("q_topk", "query orders { fetch { o_custkey(sort_desc: v, limit: 7) { v: sum(a: o_totalprice) } } }", "SELECT o_custkey, round(sum(o_totalprice), 4) AS v FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 7")
add("q_offset", "query orders { fetch { o_custkey(sort_asc: o_custkey, limit: 5, offset: 5) { n: count(a: o_orderkey) } } }", "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 5 OFFSET 5")
add("q_sort_metric", "query orders { fetchPlain { o_orderkey(sort: desc, limit: 9) o_orderstatus } }", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 9")
YEARS = """query orders {
  now: fetch(o_orderdate_gte: "1998-1-1", o_orderdate_lt: "1999-1-1") { o_orderpriority %s { v: sum(a: o_totalprice) %s } }
  before: fetch(o_orderdate_gte: "1997-1-1", o_orderdate_lt: "1998-1-1") { o_orderpriority { v: sum(a: o_totalprice) %s } }
} %s"""
TWO = """WITH now AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= '1998-1-1' AND o_orderdate < '1999-1-1' GROUP BY 1),
before AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= '1997-1-1' AND o_orderdate < '1998-1-1' GROUP BY 1)
"""
BOTH = TWO + "SELECT o_orderpriority, round(%s, 4) AS v FROM now n LEFT JOIN before b USING (o_orderpriority)"
for _name, _expr in (("diff", "n.v / nullif(b.v, 0) - 1"), ("subtract", "n.v - b.v"), ("divideBy", "n.v / nullif(b.v, 0)")):
    _key = {"divideBy": "q_divide_by"}.get(_name, f"q_{_name}")
    add(_key, YEARS % ("", "", "", f"mutation {{ now: {_name}(by: before) {{ o_orderpriority {{ v }} }} }}"), BOTH % _expr, "now")
add("q_blank", YEARS % ("", "", "", "mutation { now: blank { o_orderpriority { v } } }"), TWO + "SELECT o_orderpriority, v FROM now WHERE false", "now")
add("q_pick", """query lineitem {
  top: fetch { l_returnflag { v: share(a: l_quantity) } }
  series: fetch { l_linestatus { l_returnflag { q: sum(a: l_quantity) } } }
} mutation { series: pick(from: series, by: top) { l_returnflag(v_gt: 0.3) } }""", "SELECT l_linestatus, l_returnflag, round(sum(l_quantity), 4) AS q FROM lineitem WHERE l_returnflag IN (SELECT l_returnflag FROM (SELECT l_returnflag, sum(l_quantity) / sum(sum(l_quantity)) OVER () AS v FROM lineitem GROUP BY 1) WHERE v > 0.3) GROUP BY 1, 2", "series")
add("q_dir_diff", YEARS % ("", "@diff(by: before)", "@diff(by: now)", ""), BOTH % "n.v / nullif(b.v, 0) - 1", "now")
add("q_dir_subtract", YEARS % ("", "@subtract(by: before)", "", ""), BOTH % "n.v - b.v", "now")
add("q_dir_indexed", YEARS % ("", "@indexed(to: before)", "", ""), TWO + "SELECT o_orderpriority, round(v / (SELECT max(v) FROM (SELECT v FROM now UNION ALL SELECT v FROM before)), 4) AS v FROM now", "now")
add("q_dir_indexed_group", YEARS % ("", "@indexed(group: g)", "@indexed(group: g)", ""), TWO + "SELECT o_orderpriority, round(v / (SELECT max(v) FROM (SELECT v FROM now UNION ALL SELECT v FROM before)), 4) AS v FROM before", "before")
add("q_dir_filter_row", "query lineitem { fetch { l_suppkey @filter(n_gt: 590, qty_lt: 15600) { n: count(a: l_orderkey) qty: sum(a: l_quantity) } } }", "SELECT l_suppkey, count(l_orderkey) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY 1 HAVING count(l_orderkey) > 590 AND sum(l_quantity) < 15600")
add("q_dir_filter_val", "query lineitem { fetch { l_suppkey { n: count(a: l_orderkey) @filter(gt: 600) qty: sum(a: l_quantity) } } }", "SELECT l_suppkey, CASE WHEN count(l_orderkey) > 600 THEN count(l_orderkey) END AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY 1")
add("q_dir_group_on", 'query part { fetch { p_type @groupOn(n_lt: 340, replacers: { p_type: "Other" }) { n: count(a: p_partkey) price: sum(a: p_retailprice) } } }', "SELECT CASE WHEN n < 340 THEN 'Other' ELSE p_type END AS p_type, sum(n)::BIGINT AS n, round(sum(price), 4) AS price FROM (SELECT p_type, count(p_partkey) AS n, sum(p_retailprice) AS price FROM part GROUP BY 1) GROUP BY 1")
add("q_dir_omit", "query part { fetch { p_type { n: count(a: p_partkey) @omit hi: max(a: p_size) } } }", "SELECT p_type, max(p_size) AS hi FROM part GROUP BY 1")
add("q_dir_omit_full", "query part { fetch { p_type { n: count(a: p_partkey) @omit(full: true) hi: max(a: p_size) } } }", "SELECT p_type, max(p_size) AS hi FROM part GROUP BY 1")
add("q_metric_alias", YEARS % ("", "growth: v @diff(by: before)", "growth: v", ""), TWO + "SELECT o_orderpriority, round(n.v, 4) AS v, round(n.v / nullif(b.v, 0) - 1, 4) AS growth FROM now n LEFT JOIN before b USING (o_orderpriority)", "now")


def q_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = engine(spark, sf_dir).levels("query lineitem { fetch { l_returnflag { qty: sum(a: l_quantity) l_linestatus { qty: sum(a: l_quantity) } } n: count(a: l_orderkey) } }", together=True)[""]
    wide = [rounded(x.df).select(F.lit(i).alias("level"), *(F.col(c) if c in x.df.columns else F.lit(None).cast(t).alias(c) for c, t in (("l_returnflag", "string"), ("l_linestatus", "string"), ("qty", "double"), ("n", "long")))) for i, x in enumerate(levels)]
    return reduce(DataFrame.unionByName, wide)


QUERIES["q_levels"] = q_levels
SQL["q_levels"] = """SELECT 0::INT AS level, NULL::VARCHAR AS l_returnflag, NULL::VARCHAR AS l_linestatus, NULL::DOUBLE AS qty, count(l_orderkey) AS n FROM lineitem
UNION ALL SELECT 1, l_returnflag, NULL, round(sum(l_quantity), 4), NULL FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 2, l_returnflag, l_linestatus, round(sum(l_quantity), 4), NULL FROM lineitem GROUP BY l_returnflag, l_linestatus"""


def q_limited_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(engine(spark, sf_dir).frames("query orders { fetch { o_custkey(sort_desc: v, limit: 4) { v: sum(a: o_totalprice) o_orderstatus { n: count(a: o_orderkey) } } } }")[""][1])


QUERIES["q_limited_parent"] = q_limited_parent
SQL["q_limited_parent"] = "SELECT o_custkey, o_orderstatus, count(o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 4) GROUP BY 1, 2"


def q_having_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level below one that having filtered holds that level's keys only."""
    return rounded(engine(spark, sf_dir).frames("query lineitem { fetch(filters: { having: { n: { gt: 600 } } }) { l_suppkey { n: count(a: l_orderkey) l_returnflag { qty: sum(a: l_quantity) } } } }")[""][1])


QUERIES["q_having_levels"] = q_having_levels
SQL["q_having_levels"] = "SELECT l_suppkey, l_returnflag, round(sum(l_quantity), 4) AS qty FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(l_orderkey) > 600) GROUP BY 1, 2"


def q_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = engine(spark, sf_dir).levels("query lineitem { fetch { l_returnflag { l_linestatus(type: Array) { n: count(a: l_orderkey) } } } }")[""]
    return nested_json(levels[0])


QUERIES["q_nested_json"] = q_nested_json
SQL["q_nested_json"] = """SELECT '{' || string_agg('"' || f || '":{"l_linestatus":' || x || '}', ',' ORDER BY f) || '}' AS json FROM (
  SELECT f, '[' || string_agg('{"l_linestatus":"' || s || '","n":' || n || '}', ',' ORDER BY s) || ']' AS x FROM (
    SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY f)"""


def analytics(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    def provider(params: dict) -> DataFrame:
        e = spark.read.parquet(f"{sf_dir}/events.parquet")
        return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date"), "event_type").agg(F.count("*").alias("hits"), F.sum("value").alias("revenue"))

    return rounded(engine(spark, sf_dir, provider=provider).frame(text))


def q_ga_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics(spark, sf_dir, 'query events($source: GA) { fetch(start_date: "2024-01-01") { date(groupBy: month) { event_type(sort_desc: hits) { hits rate: divide(a: revenue, by: hits) top: indexed(a: revenue) } } } }')


def q_ga_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics(spark, sf_dir, 'query events($source: GA) { fetch(start_date: "2024-01-01") { date(groupBy: week) { event_type { hits first: indexed(a: revenue, alg: first) } } } }')


QUERIES["q_ga_first"] = q_ga_first
SQL["q_ga_first"] = """WITH w AS (SELECT date_trunc('week', ts)::TIMESTAMP AS date, event_type, count(*) AS hits, sum(value) AS v FROM events GROUP BY date_trunc('week', ts), event_type)
SELECT date, event_type, hits, round(v / (SELECT v FROM w ORDER BY date, event_type LIMIT 1), 4) AS first FROM w"""
QUERIES["q_ga_rollup"] = q_ga_rollup
SQL["q_ga_rollup"] = """SELECT date_trunc('month', ts)::TIMESTAMP AS date, event_type, count(*) AS hits, round(sum(value) / count(*), 4) AS rate,
  round(sum(value) / max(sum(value)) OVER (), 4) AS top FROM events GROUP BY date_trunc('month', ts), event_type"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
