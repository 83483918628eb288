"""Nested documents from given rows, parser and error cases."""

import pytest
from pyspark.sql import functions as F

from tessera.plans.text import QueryError, parse
from tessera.session import Engine
from tessera.sources.catalog import Catalog

COLUMNS = "brand string, country string, date string, device string, channels string, category string, channel string, price double, value double, no_baskets double, no_all_baskets double, sessions long, transactions long, rank int"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("Adidas", "US", "2020-06-01", "mobile", "Social", "Adult", "x", 1.0, 2.0, 3.0, 4.0, 5, 6, 1)], COLUMNS)


def run(spark, table, text, rows):
    return Engine(Catalog(spark, {"table": table, "shop": table})).db_fetch(lambda levels: rows)(text)


def pair(a, b):
    return [{"channels": "Social", "value": a}, {"channels": "Organic", "value": b}]


def two(first, second, dim=("", ""), tail=""):
    return f"query shop {{ series: fetch {{ channels {dim[0]} {{ value: sum(a: sessions) {first} }} }} prev: fetch {{ channels {dim[1]} {{ value: sum(a: sessions) {second} }} }} }} {tail}"


def test_levels_merge(spark, table):
    days = [(d, t, v) for d, t, v in (("mobile", "1", "101"), ("mobile", "2", "107"), ("desktop", "1", "201"), ("desktop", "2", "207"))]
    got = run(spark, table, 'query table { fetch(brand: Adidas, date_gt: "2020-1-1") { device { no_baskets: sum(a: no_baskets) date(type: Array) { no_baskets: sum(a: no_baskets) } } } }', [
        [{"device": "mobile", "no_baskets": "1070"}, {"device": "desktop", "no_baskets": "2010"}], [{"device": d, "date": t, "no_baskets": v} for d, t, v in days]])
    assert got == {
        "mobile": {"no_baskets": "1070", "date": [{"date": "1", "no_baskets": "101"}, {"date": "2", "no_baskets": "107"}]},
        "desktop": {"no_baskets": "2010", "date": [{"date": "1", "no_baskets": "201"}, {"date": "2", "no_baskets": "207"}]},
    }


def test_array_of_distinct(spark, table):
    ten = ("FR", "MX", "PL", "ES", "PT", "US", "FR", "IT", "GB", "DE")
    got = run(spark, table, "query table { fetch { country: distinct(type: Array) } }", [[{"country": c} for c in ten]])
    assert got == [{"country": c} for c in ("FR", "MX", "PL", "ES", "PT", "US", "IT", "GB", "DE")]


def by_date(columns, values):
    days = ("2020-01-01T23:00:00.000Z", "2020-01-02T23:00:00.000Z")
    return [{"device": d, "date": t, **dict(zip(columns, map(str, v)))} for (d, t), v in zip([(d, t) for d in ("mobile", "desktop") for t in days], values)]


def below_device(rows, columns):
    return {d: [{k: r[k] for k in ("date", *columns)} for r in rows if r["device"] == d] for d in ("mobile", "desktop")}


def test_a_list_stands_for_a_key_with_nothing_else(spark, table):
    columns = ("no_baskets", "no_all_baskets", "sessions", "transactions", "price", "value", "rank")
    rows = by_date(columns, [range(100, 107), (109, 107, 108, 110, 111, 112, 113), range(200, 207), (209, 207, 208, 210, 211, 212, 213)])
    metrics = " ".join(f"{c}: sum(a: {c})" for c in columns)
    got = run(spark, table, f'query table {{ fetch(brand: Adidas, country: US, date_gt: "2020-1-1", date_lt: "2021-7-12") {{ device {{ date(type: Array) {{ {metrics} }} }} }} }}', [rows])
    assert got == below_device(rows, columns)
    columns = ("sessions", "transactions", "average")
    rows = by_date(columns, [(100, 101, 102), (109, 107, 108), (200, 201, 202), (209, 207, 208)])
    got = run(spark, table, "query table { fetch { device { date(type: Array) { sessions: sum(a: sessions) transactions: sum(a: transactions) average: divide(a: sessions, by: transactions) } } } }", [rows])
    assert got == below_device(rows, columns)
    rows = by_date(("rank_aggrAverage", "no_baskets", "no_all_baskets"), [(100, 101, 102), (109, 107, 108), (200, 201, 202), (209, 207, 208)])
    got = run(spark, table, "query table { fetch { device { date(type: Array) { rank: aggrAverage(to: no_baskets, by: no_all_baskets) } } } }", [rows])
    assert got == below_device(rows, ("rank_aggrAverage",))


def test_pick_of_four_channels(spark, table):
    names, shares = ("Organic", "Paid", "Organicsmall", "Paidbig"), (0.1, 0.3, 0.05, 0.5)
    top = [{"channels": c, "value": v} for c, v in zip(names, shares)]
    days = ("2020-01-02T23:00:00.000Z", "2020-01-03T23:00:00.000Z")
    series = [{"date": days[0], "channels": c, "value": 0.2} for c in names] + [{"date": days[1], "channels": c, "value": v} for c, v in zip(names, (0.4, 0.4, 0.8, 0.8))]
    text = "query shop { topChannels: fetch { channels(type: Array, sort_desc: value) { value: share(a: sessions) } } series: fetch { date(type: Array, sort_asc: date) { channels { value: share(a: transactions, by: date) } } } } mutation { series: pick(from: series, by: topChannels) { channels(value_gt: 0.2) } }"
    assert run(spark, table, text, [top, series, []]) == {"topChannels": top, "series": [
        {"date": days[0], "Paid": {"value": 0.2}, "Paidbig": {"value": 0.2}}, {"date": days[1], "Paid": {"value": 0.4}, "Paidbig": {"value": 0.8}}]}


def test_aliased_growth_and_omit(spark, table):
    rows = [[{"channels": c, "value": v, "valueGrowth": v} for c, v in (("Social", a), ("Organic", b))] for a, b in ((1, 3), (2, 5))]
    got = run(spark, table, two("valueGrowth: value @diff(by: prev)", "valueGrowth: value @diff(by: series)"), rows)
    assert got == {"series": {"Social": {"value": 1, "valueGrowth": -0.5}, "Organic": {"value": 3, "valueGrowth": -0.4}}, "prev": {"Social": {"value": 2, "valueGrowth": 1}, "Organic": {"value": 5, "valueGrowth": pytest.approx(2 / 3)}}}
    rows = [[{"channels": "Social", "value": 1, "rank": 2}, {"channels": "Organic", "value": 3, "rank": 2}], [{"channels": "Social", "value": 2, "country": "DE", "rank": 1}, {"channels": "Organic", "value": 5, "rank": 2}]]
    for full in ("", "(full: true)"):  # the country isn't selected
        got = run(spark, table, two(f"rank: sum(a: rank) @omit{full}", f"rank: sum(a: rank) @omit{full}"), rows)
        assert got == {"series": {"Social": {"value": 1}, "Organic": {"value": 3}}, "prev": {"Social": {"value": 2}, "Organic": {"value": 5}}}


def test_one_key_has_one_row(spark, table):
    from tessera.operators.shape import nested_json

    rows = [[{"device": "mobile", "kind": "a", "n": 1}, {"device": "mobile", "kind": "b", "n": 2}]]
    with pytest.raises(QueryError):
        run(spark, table, "query table { fetch { device { kind: unique(a: brand) n: count(a: brand) } } }", rows)
    assert run(spark, table, "query table { fetch { device(type: Array) { kind: unique(a: brand) n: count(a: brand) } } }", rows)
    with pytest.raises(QueryError):
        nested_json(Engine(Catalog(spark, {"table": table})).levels("query table { fetch { device { kind: unique(a: brand) n: count(a: brand) } } }")[""][0])


def test_row_numbers_of_ties_are_the_same_each_time(spark):
    rows = spark.createDataFrame([(i, i % 3, str(i % 7)) for i in range(60)], "id long, score long, name string")
    engine = lambda df: Engine(Catalog(spark, {"t": df})).frame("query t { fetch { id { n: ranking(a: score, alg: rowNumber) } } }")
    one = sorted(map(tuple, engine(rows).collect()))
    assert one == sorted(map(tuple, engine(rows.repartition(5).orderBy("name")).collect()))
    assert sorted(n for _, n in one) == list(range(1, 61))


@pytest.mark.parametrize("name", ["q_cutoff", "q_having_share", "q_share"])
def test_totals_need_no_second_scan(spark, name):
    from tessera import catalog

    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final or final.count("Scan parquet") == 1


def test_database_tables(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark.range(100).selectExpr("CAST(id AS INT) AS ID", "CAST(id % 3 AS INT) AS KIND").write.format("jdbc").options(dbtable="THINGS", **options).save()
    except Exception as e:  # no such driver in this Spark
        pytest.skip(str(e)[:80])
    found = Catalog.jdbc(spark, url, ("THINGS",), partitions={"THINGS": ("ID", 0, 100, 4)}, driver=options["driver"])
    assert found.table("THINGS").rdd.getNumPartitions() == 4
    assert sorted(map(tuple, Engine(found).frame("query THINGS { fetch { KIND { n: count(a: ID) } } }").collect())) == [(0, 34), (1, 33), (2, 33)]


def test_combine(spark, table):
    got = run(spark, table, 'query table { fetch { combine(fields: [{ name: "device" }, { name: "channel" }]) { avg: divide(a: no_baskets, by: no_all_baskets) } } }', [[{"device": "mobile", "channel": "Social", "avg": 2}, {"device": "desktop", "channel": "Social", "avg": 1.5}]])
    assert got == {"mobile;Social": {"avg": 2}, "desktop;Social": {"avg": 1.5}}


def test_mutations(spark, table):
    rows = [pair(1, 3), pair(2, 1)]
    assert run(spark, table, two("", "", tail="mutation { series: diff(of: series, by: prev) { channels { value } } prev: blank { channels { value } } }"), rows) == {"series": {"Social": {"value": -0.5}, "Organic": {"value": 2}}, "prev": {}}
    assert run(spark, table, two("", "", tail="mutation { series: subtract(by: prev) { channels { value } } }"), rows)["series"] == {"Social": {"value": -1}, "Organic": {"value": 2}}


def test_pick(spark, table):
    text = "query shop { top: fetch { channels(type: Array, sort_desc: value) { value: share(a: sessions) } } series: fetch { date(type: Array, sort_asc: date) { channels { value: share(a: transactions, by: date) } } } } mutation { series: pick(from: series, by: top) { channels(value_gt: 0.2) } }"
    top = [{"channels": c, "value": v} for c, v in (("Organic", 0.1), ("Paid", 0.3))]
    got = run(spark, table, text, [top, [{"date": d, "channels": c, "value": v} for d, c, v in (("2", "Organic", 0.2), ("2", "Paid", 0.2), ("3", "Paid", 0.4))]])
    assert got == {"top": top, "series": [{"date": "2", "Paid": {"value": 0.2}}, {"date": "3", "Paid": {"value": 0.4}}]}


def test_directives(spark, table):
    rows = [pair(1, 3), pair(2, 5)]
    got = run(spark, table, two("@diff(by: prev)", "@diff(by: series)"), rows)
    assert got["series"] == {"Social": {"value": -0.5}, "Organic": {"value": -0.4}} and got["prev"]["Organic"]["value"] == pytest.approx(2 / 3)
    for tag in ("@indexed(to: %s)", "@indexed(group: first)"):
        got = run(spark, table, two(tag % "prev" if "%" in tag else tag, tag % "series" if "%" in tag else tag), rows)
        assert got == {"series": {"Social": {"value": 0.2}, "Organic": {"value": 0.6}}, "prev": {"Social": {"value": 0.4}, "Organic": {"value": 1}}}
    # A row after a dropped one stays: it passes the filter.
    assert run(spark, table, two("", "", ("@filter(value_gt: 1)", "@filter(value_lt: 4.99)")), rows) == {"series": {"Organic": {"value": 3}}, "prev": {"Social": {"value": 2}}}
    assert run(spark, table, two("@filter(gt: 1)", "@filter(eq: 5)"), rows) == {"series": {"Social": {}, "Organic": {"value": 3}}, "prev": {"Social": {}, "Organic": {"value": 5}}}
    got = run(spark, table, two("", "", ('@groupOn(value_gt: 0.5, replacers: { channels: "Other" })', '@groupOn(value_lt: 3, replacers: { channels: "Other" })')), rows)
    assert got == {"series": {"Other": {"channels": "Other", "value": 4}}, "prev": {"Organic": {"value": 5}, "Other": {"channels": "Other", "value": 2}}}
    assert run(spark, table, two("@omit", ""), rows)["series"] == {"Social": {}, "Organic": {}}


def test_hooks(spark, table):
    seen = []
    e = Engine(Catalog(spark, {"table": table})).before_fetch(lambda levels: seen.append(levels)).after_fetch(seen.append)
    assert e("query table { fetch { device { n: count(a: device) } } }") == {"mobile": {"n": 1}} and len(seen) == 2
    assert Engine(Catalog(spark, {"table": table})).before_fetch(lambda levels: False)("query table { fetch { device } }") is None
    from pyspark.sql import functions as F

    from tessera.operators.metrics import MetricSpec

    e = Engine(Catalog(spark, {"table": table})).use_resolver("spread", lambda ctx, f: MetricSpec(aggs={"__s": F.max(ctx.arg(f)) - F.min(ctx.arg(f))}, post=lambda frame: F.col("__s")))
    e.use_data_resolver("s", lambda here, label, v: here.update({label: [v]}))
    assert e("query table { fetch { device { s: spread(a: price) } } }") == {"mobile": {"s": [0.0]}}
    assert e("query table { fetchPlain { device brand } }") == [[{"device": "mobile", "brand": "Adidas"}]]


@pytest.mark.parametrize("text", [
    "", "query", "subscription x { a }", "query t($x: Y) { fetch { a } }", "{ x: fetch { device } }", "query table { fetch { ...x } }", "query table { fetch(a: $v) { device } }",
    "query nowhere { fetch { a } }", "query table { fetch { nothing } }", "query table { fetch { device { n: sum } } }", "query table { fetch { device { n: sum(b: price) } } }",
    "query table { fetch { device { price } } }", "query table { fetch(filters: { price: { in: 3 } }) { device } }", "query table { fetch(join: { by: \"a:b\" }) { device } }",
    "query table { fetch(join: { table: shop }) { device } }", "query table { fetch(join: { table: shop, by: \"device\" }) { device } }", "query table { fetch(join: { table: shop, by_in: \"device:device\" }) { device } }",
    "query table { fetch { device(sort_desc: nothing) { n: count(a: device) } } }", "query table { w: with { device { n: count(a: device) brand { n: count(a: device) } } } fetch(table: w) { n } }",
    "query table { fetch { h: searchHeadline(a: brand) } }", "query table { fetch { combine { n: count(a: device) } } }", "query t($source: GA) { fetch { x } }", "query table { fetch { r: ranking(a: price, alg: odd) } }",
    "query table { fetch { device(nosuch: 3) { n: count(a: device) } } }", "query table { fetch { device { n: divide(a: \"upper|price\", by: value) } } }", "query table { fetch(filters: { having: { m: { gt: 1 } } }) { device { n: count(a: device) } } }",
    "query table { fetch { device(groupByAlias: shop) { n: count(a: device) } } }",
    "query table { a: fetch { device { n: count(a: device) } } } mutation { a: diff(by: b) { device { n } } }",
])
def test_errors(spark, table, text):
    with pytest.raises(QueryError):
        Engine(Catalog(None, {"table": table, "shop": table}))(text)


def test_parser():
    op = parse('query t { # words\n x: f(a: 1, b: -2.5, c: "q\\"", d: [A, true], e: { k: """block""" }) @omit(full: true) { y } }')[0]
    f = op.fields[0]
    assert (op.kind, op.name, f.alias, f.name) == ("query", "t", "x", "f")
    assert f.args == {"a": 1, "b": -2.5, "c": 'q"', "d": ["A", True], "e": {"k": "block"}} and f.directives[0].args == {"full": True}


def test_request(spark):
    from tessera.sources.analytics import request

    r = request(parse('query t($source: GA) { fetch(start_date: "7daysAgo") { date(groupBy: month, sort_desc: hits) { hits date { hits } q: divide(a: rev, by: hits) } } }')[0].fields[0])
    assert r.params == {"start-date": "7daysAgo", "dimensions": "ga:date", "metrics": "ga:hits,ga:rev", "sort": "-ga:hits"}


@pytest.fixture
def sold(spark):
    rows = [("a", "x", 1, 2.5, 1), ("a", "y", 2, None, 2), ("b", "x", None, 4.0, 3), (None, "x", 7, 1.0, 4), ("a", "x", 5, 2.5, 5), (None, None, 2, 4.0, 6)]
    return spark.createDataFrame(rows, "shop string, kind string, n int, price double, id int")


@pytest.mark.parametrize("selection", [
    "shop { t: sum(a: n) lo: min(a: price) kind { c: count(a: n) hi: max(a: price) } } all: sum(a: n)",
    "shop(sort_desc: t) { t: sum(a: n) kind(cutoff: n) { s: share(a: n) t: sum(a: n) } }",
    "shop { t: sum(a: n) kind { m: percentile(a: price) } }",
    "shop(sort_desc: t, limit: 1) { t: sum(a: n) kind { t: sum(a: n) } }",
])
def test_levels_together(sold, selection):
    """Run as one job, levels have the rows that they have by themselves; without rows too."""
    for table in (sold, sold.filter("id > 9")):
        e = Engine(Catalog(sold.sparkSession, {"sold": table}))
        text = f"query sold {{ fetch {{ {selection} }} }}"
        alone, together = e.levels(text)[""], e.levels(text, together=True)[""]
        assert [x.df.schema for x in alone] == [x.df.schema for x in together]
        for x, y in zip(alone, together):
            assert sorted(map(repr, x.df.collect())) == sorted(map(repr, y.df.collect()))


def test_levels_together_scan_once(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 AS a", "id % 7 AS b", "id AS n").write.parquet(f"{tmp_path}/t.parquet")
    e = Engine(Catalog.parquet(spark, str(tmp_path), ("t",)))
    levels = e.levels("query t { fetch { a { n: sum(a: n) b { hi: max(a: n) c: count(a: n) } } n: count(a: n) } }", together=True)[""]
    both = levels[0].df.selectExpr("n").union(levels[1].df.selectExpr("n")).union(levels[2].df.selectExpr("hi"))
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1
    assert plan.count("ReusedExchange") == 2


@pytest.mark.parametrize("alg", ["rank", "denseRank"])
def test_rank_over_all_rows(spark, alg):
    """Ranges don't show in the ranks: ties, nulls, NaN, both zeros and more values than ranges."""
    values = [None, None, float("nan"), float("nan"), 0.0, -0.0, 1e9, -1e9] + [float(i * 7919 % 600) for i in range(1500)]
    for own in (values, ["null" if v is None else str(v) for v in values], [None, None], []):
        kind = "string" if own is not values else "double"
        table = spark.createDataFrame([(i, v) for i, v in enumerate(own)], f"id int, v {kind}")
        found = Engine(Catalog(spark, {"t": table})).frame(f"query t {{ fetch {{ id {{ r: ranking(a: v, alg: {alg}) }} }} }}")
        table.createOrReplaceTempView("ranked_rows")
        fn = "rank" if alg == "rank" else "dense_rank"
        wanted = spark.sql(f"SELECT id, {fn}() OVER (ORDER BY v DESC NULLS FIRST) AS r FROM ranked_rows")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("dims", ["", "shop", "shop kind"])
def test_percentiles_in_ranges(spark, dims):
    """Against the built-in aggregate: more values than ranges, ties, nulls, groups of nulls, a null
    group, no rows, and beside other aggregates."""
    rows = [("abc"[i % 3] if i % 11 else None, i % 2, None if i % 3 == 2 and i % 11 else float(i * 7919 % 700) / 8 - 20, i) for i in range(2000)]
    full = spark.createDataFrame(rows, "shop string, kind int, v double, n int")
    variants = ("", []), ("s: sum(a: n) n: count(a: v)", ["s", "n"]), ("o: percentile(a: n) m: avg(a: n)", ["o", "m"])
    for table, some in ((full, variants), (full.filter("n < 7"), variants[:1]), (full.filter("n < 0"), variants[1:2])):
        open_, close = "".join(f"{d} {{ " for d in dims.split()), " }" * len(dims.split())
        text = "query t { fetch { %s p: percentile(a: v) q: percentile(a: v, factor: 0.93) %s %s } }"
        e = Engine(Catalog(spark, {"t": table}))
        keys = dims.split()
        wanted = table.groupBy(*keys).agg(F.expr("percentile(v, 0.5)").alias("p"), F.expr("percentile(v, 0.93)").alias("q"), F.sum("n").alias("s"), F.count("v").alias("n"), F.avg("n").alias("m"), F.expr("percentile(n, 0.5)").alias("o"))
        for more, names in some:
            found = e.frame(text % (open_, more, close))
            rounded = [F.round(c, 9).alias(c) if c in "pqmo" else F.col(c) for c in (*keys, "p", "q", *names)]
            assert sorted(map(repr, found.select(rounded).collect())) == sorted(map(repr, wanted.select(rounded).collect()))
    with pytest.raises(QueryError):
        e.frame("query t { fetch { p: percentile(a: v, factor: 2) } }")
