"""Metrics by name. A metric says what it adds before, in and after the aggregation of its level."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import search as text_search
from ..plans.text import Field, QueryError

if TYPE_CHECKING:
    from .levels import Frame, LevelContext


@dataclass
class MetricSpec:
    """``pre``: columns over the filtered rows; ``key``: an extra grouping key; ``aggs``: aggregates
    under hidden names; ``post``: the value over the aggregated frame; ``plain``: the value of a row
    where nothing is grouped; ``sub``: a frame (grouping keys, one value) joined to the level's."""

    pre: dict[str, Column] = field(default_factory=dict)
    key: Column | None = None
    aggs: dict[str, Column] = field(default_factory=dict)
    post: Callable[[Frame], Column] | None = None
    plain: Column | None = None
    sub: Callable[[LevelContext], DataFrame] | None = None
    by_all: bool = False  # ``sub`` is by all grouping keys and has all groups, else it is by the dimensions
    distinct: bool = False
    beside: Callable[[DataFrame], DataFrame] | None = None  # rows with hidden columns, where nothing is grouped
    wider: Callable[[DataFrame], DataFrame] | None = None  # the same with hidden columns for every level
    merge: Callable[[Column], Column] | None = None  # an aggregate over finer groups' ``aggs`` to these groups'
    column: str | None = None  # the output column, where it isn't the label


#: Aggregates of one column, those that ``divide`` can name.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count, "countDistinct": F.count_distinct,
    "median": F.median, "stddev": F.stddev, "stddev_pop": F.stddev_pop, "stddev_samp": F.stddev_samp,
    "variance": F.variance, "var_pop": F.var_pop, "var_samp": F.var_samp,
}


#: Aggregates that can be taken from those of finer groups.
MERGES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}


def aggregate(name: str) -> Callable[[Column], Column]:
    if name not in AGGREGATES:
        raise QueryError(f"unknown aggregate {name!r}")
    return AGGREGATES[name]


def need(f: Field, *names: str) -> None:
    for n in names:
        if n not in f.args:
            raise QueryError(f"{f.name} requires the argument {n!r}")


def simple(name: str):
    def make(ctx: LevelContext, f: Field) -> MetricSpec:
        need(f, "a")
        return one(f, AGGREGATES[name](ctx.arg(f)), MERGES.get(name))

    return make


def one(f: Field, value: Column, merge: Callable[[Column], Column] | None = None) -> MetricSpec:
    hidden = f"__{f.label}"
    return MetricSpec(aggs={hidden: value}, post=lambda frame: F.col(hidden), merge=merge)


def avg(ctx: LevelContext, f: Field) -> MetricSpec:
    need(f, "a")
    if "by" not in f.args:
        return one(f, F.avg(ctx.arg(f)))
    over = lambda x, p: F.avg(x).over(Window.partitionBy(p))
    value, part, hidden = ctx.arg(f), ctx.arg(f, "by"), f"__{f.label}"

    def beside(rows: DataFrame) -> DataFrame:
        """The averages joined to the rows: a window would bring all rows of a part to one task."""
        own = rows.groupBy(part.alias(f"{hidden}_by")).agg(F.avg(value).alias(hidden))
        return rows.join(own, part.eqNullSafe(F.col(f"{hidden}_by")), "left").drop(f"{hidden}_by")

    return MetricSpec(plain=F.col(hidden), beside=beside, post=lambda frame: over(frame.key(f.args["a"]), frame.key(f.args["by"])))


#: Ranges of values, where they are counted instead of being brought together: STEP * STEP.
STEP = 16


def bounds_of(counted: DataFrame, keys: list[str], v: str, n: str) -> Column:
    """The bounds of ranges of ``v``, in parts with their starts, over ``counted`` (a row for each
    different ``v`` of a group, with its rows ``n``). They are the values of the least hashes, so they
    are the same wherever they are computed. Every reader of ``counted`` should read ``n``: the
    aggregation below then stays the same, and Spark runs it once."""
    few = counted.orderBy(F.xxhash64(*keys, v), v).limit(STEP * STEP - 1).agg(F.collect_list(F.struct(*keys, v, n)).alias("all"))
    few = few.select(F.sort_array(F.filter(F.transform("all", lambda x: x[v]), lambda x: x.isNotNull())).alias("all"))
    few = few.select(F.transform(F.sequence(F.lit(0), F.lit(STEP - 1)), lambda i: F.slice("all", i * STEP + 1, STEP)).alias("parts"))
    return few.select(F.struct(F.transform("parts", lambda x: F.get(x, F.lit(0))).alias("starts"), "parts")).scalar()


def in_ranges(counted: DataFrame, bounds: Column, v: str, name: str) -> DataFrame:
    """``counted`` with the number of each value's range: how many bounds are less, looked up in two
    steps. Nulls get -1."""
    held, part = f"{name}_bounds", f"{name}_part"
    less = lambda c: F.size(F.filter(c, lambda x: x < F.col(v)))
    out = counted.withColumn(held, bounds)
    out = out.withColumn(part, F.when(F.col(v).isNull(), -1).otherwise(less(F.col(f"{held}.starts"))))
    number = (F.col(part) - 1) * STEP + less(F.get(F.col(f"{held}.parts"), F.col(part) - 1))
    return out.withColumn(name, F.when(F.col(part) < 1, F.col(part)).otherwise(number)).drop(held, part)


def percentile(ctx: LevelContext, f: Field) -> MetricSpec:
    """Exact, between the two nearest rows. The rows of each different value are counted, and the counts
    of ranges of values tell which ranges hold the wanted places; only their values are put in order.
    All percentiles of a column come from one pass."""
    need(f, "a")
    same = [x for x in ctx.fields if x.name == "percentile" and (x.args.get("a"), x.args.get("from")) == (f.args["a"], f.args.get("from"))]
    for x in same:
        if not 0 <= (at := x.args.get("factor", 0.5)) <= 1:
            raise QueryError(f"percentile requires a factor from 0 to 1, not {at!r}")
    if same[0] is not f:
        return MetricSpec(post=lambda frame: F.col(f"`__{f.label}`"))

    def sub(level: LevelContext) -> DataFrame:
        # Hidden aggregates begin with two underscores, the columns here with one.
        names, value = level.key_names(), level.arg(f).cast("double")
        keys = [f"_k{i}" for i in range(len(names))]
        # The level's other aggregates come along. All readers read them by _n, so there is one aggregation.
        others = {n: c.alias(n) for n, (c, _) in level.merged.items()}
        counted = level.rows.groupBy(*(k.value.alias(c) for k, c in zip(level.dims, keys)), value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"), *others.values())
        if others:
            counted = counted.withColumn("_n", F.when(F.hash(*(f"`{n}`" for n in others)) >= F.lit(-(2**31)), F.col("_n")))  # always so
        bounds = bounds_of(counted, keys, "_v", "_n")
        counted = counted.withColumn("_n", F.when(F.col("_v").isNull(), 0).otherwise(F.col("_n")))
        all_of, before = Window.partitionBy(*keys), (Window.unboundedPreceding, -1)
        ranges = in_ranges(counted, bounds, "_v", "_range").groupBy(*keys, "_range").agg(F.sum("_n").alias("_size"), *(merge(F.col(f"`{n}`")).alias(n) for n, (_, merge) in level.merged.items()))
        for n, (_, merge) in level.merged.items():
            ranges = ranges.withColumn(n, merge(F.col(f"`{n}`")).over(all_of))
        ranges = ranges.withColumn("_before", F.coalesce(F.sum("_size").over(all_of.orderBy("_range").rowsBetween(*before)), F.lit(0))).withColumn("_all", F.sum("_size").over(all_of))
        places = [(F.col("_all") - 1) * F.lit(float(x.args.get("factor", 0.5))) for x in same]
        near = [(F.floor(p), F.ceil(p)) for p in places]
        holds = reduce(or_, ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_size")) for pair in near for r in pair))
        low, high = (F.get(F.flatten(bounds["parts"]), F.col("_range") - i) for i in (1, 0))
        ranges = ranges.filter(holds | (F.col("_all") == 0)).select(*(F.col(k).alias(f"{k}_of") for k in keys), "_range", "_before", "_all", low.alias("_low"), high.alias("_high"), *(F.col(f"`{n}`").alias(f"_all{n}") for n in others))
        inside = (F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") <= F.col("_high")))
        # A group has as many such ranges as places are wanted, at most.
        own = counted.join(ranges if keys else F.broadcast(ranges), reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys), inside))
        own = own.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(*before)), F.lit(0)))
        at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_from") + F.col("_n")), F.col("_v")))
        picked = own.groupBy(*keys).agg(F.max("_all").alias("_all"), *(at(r).alias(f"_{side}{i}") for i, pair in enumerate(near) for side, r in zip(("lo", "hi"), pair)), *(F.max(f"`_all{n}`").alias(n) for n in others))
        between = [F.when(lo == hi, F.col(f"_lo{i}")).otherwise((hi - p) * F.col(f"_lo{i}") + (p - lo) * F.col(f"_hi{i}")) for i, (p, (lo, hi)) in enumerate(zip(places, near))]
        kinds = {x.name: x for x in level.rows.agg(*others.values()).schema} if others else {}
        rest = [(c if kinds[n].nullable else F.coalesce(c, F.lit(0))).alias(n) for n in others for c in (F.col(f"`{n}`").cast(kinds[n].dataType),)]
        return picked.select(*(F.col(k).alias(name) for k, name in zip(keys, names)), *(c.alias(f"__{x.label}") for c, x in zip(between, same)), *rest)

    return MetricSpec(sub=sub, by_all=True)


def side(ctx: LevelContext, f: Field, arg: str) -> Column:
    name, _, column = f.args[arg].rpartition("|")
    return aggregate(name or "sum")(ctx.scope.col(column, f.args.get("from")))


def divide(ctx: LevelContext, f: Field) -> MetricSpec:
    need(f, "a", "by")
    return one(f, F.try_divide(side(ctx, f, "a").cast("double"), side(ctx, f, "by").cast("double")))


def avg_per_dimension(ctx: LevelContext, f: Field) -> MetricSpec:
    need(f, "a", "per")
    return one(f, F.try_divide(F.sum(ctx.arg(f)).cast("double"), F.count_distinct(ctx.arg(f, "per"))))


def weight_avg(ctx: LevelContext, f: Field) -> MetricSpec:
    need(f, "a", "by")
    a, w = ctx.arg(f).cast("double"), ctx.arg(f, "by").cast("double")
    return one(f, F.try_divide(F.sum(a * w), F.sum(w)))


def aggr_average(ctx: LevelContext, f: Field) -> MetricSpec:
    need(f, "to", "by")

    def sub(level: LevelContext) -> DataFrame:
        at, to, by = level.scope.col(f.label), level.arg(f, "to"), level.arg(f, "by")
        inner = level.rows.groupBy(*level.keys(), at.alias("__at")).agg(F.sum(to).alias("__to"), F.sum(by).alias("__by"))
        return inner.groupBy(*(F.col(f"`{k}`") for k in level.key_names())).agg(F.try_divide(F.sum(F.col("__at") * F.col("__to")).cast("double"), F.max("__by")).alias(f"__{f.label}"))

    return MetricSpec(sub=sub, column=f"{f.label}_aggrAverage")


def unique(ctx: LevelContext, f: Field) -> MetricSpec:
    need(f, "a")
    return MetricSpec(key=ctx.arg(f), plain=ctx.arg(f))


def distinct(ctx: LevelContext, f: Field) -> MetricSpec:
    if f.alias is None:
        raise QueryError("distinct requires an alias: the column")
    c = ctx.scope.col(f.alias, f.args.get("from"))
    return MetricSpec(key=c, plain=c, distinct=True)


def from_table(ctx: LevelContext, f: Field) -> MetricSpec:
    need(f, "a")
    return MetricSpec(plain=ctx.arg(f), key=ctx.arg(f))


def over_level(fn: Callable[[Column], Column]):
    """sum(a) over the sum or maximum of these sums in the level, or in the part of ``by``."""

    def make(ctx: LevelContext, f: Field) -> MetricSpec:
        need(f, "a")
        hidden = f"__{f.label}"

        def post(frame: Frame) -> Column:
            own = F.col(hidden).cast("double")
            if "by" in f.args:
                return F.try_divide(own, fn(own).over(Window.partitionBy(frame.key(f.args["by"]))))
            return F.try_divide(own, frame.total(fn, hidden))

        return MetricSpec(aggs={hidden: F.sum(ctx.arg(f))}, post=post, merge=F.sum)

    return make


RANKS = {"denseRank": F.dense_rank, "rank": F.rank, "rowNumber": F.row_number}


def ranked(rows: DataFrame, value: Column, alg: str, hidden: str) -> DataFrame:
    """``rows`` with the rank of ``value`` over all of them, largest first. Different values are counted,
    dealt to ranges and ranked there; the sizes of the ranges before come on top, and the rows get
    the rank of their value by a join. No task sees more than a range of different values."""
    v, n, b = (f"{hidden}_{x}" for x in ("value", "rows", "range"))
    values = rows.groupBy(value.alias(v)).agg(F.count(F.lit(1)).alias(n))
    values = in_ranges(values, bounds_of(values, [], v, n), v, b)
    values = values.withColumn(b, F.when(F.col(b) < 0, STEP * STEP).otherwise(F.col(b)))  # nulls come first
    steps = F.sum((F.col(n) > 0).cast("long") if alg == "denseRank" else n)
    own = Window.partitionBy(b).orderBy(F.desc_nulls_first(v)).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(steps.over(own), F.lit(0)) + 1
    before = F.coalesce(F.sum("size").over(Window.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = values.groupBy(F.col(b).alias("at")).agg(steps.alias("size")).select("at", before.alias("before"))
    found = values.withColumn(hidden, inside).join(F.broadcast(ranges), F.col(b) == F.col("at"), "left")  # STEP * STEP + 1 rows at most
    found = found.select(F.col(v), (F.col(hidden) + F.col("before")).cast("int").alias(hidden))
    return rows.join(found, value.eqNullSafe(F.col(v)), "left").drop(v)


def ranking(ctx: LevelContext, f: Field) -> MetricSpec:
    need(f, "a")
    alg = f.args.get("alg", "denseRank")
    if alg not in RANKS:
        raise QueryError(f"unknown ranking {alg!r}")
    order = [F.desc_nulls_first(ctx.arg(f))]
    if alg == "rowNumber":  # ties by the dimensions, then by the rows' own columns
        order += [F.asc_nulls_last(k.value) for k in ctx.dims]
        order += [F.asc_nulls_last(ctx.scope.df[f"`{c}`"]) for c, t in ctx.scope.df.dtypes if not t.startswith(("map", "variant"))]
    w = Window.partitionBy(ctx.part(f.args["by"])).orderBy(*order) if "by" in f.args else Window.orderBy(*order)
    hidden = f"__rank_{f.label}"
    if "by" not in f.args and alg != "rowNumber":
        return MetricSpec(wider=lambda rows: ranked(rows, ctx.arg(f), alg, hidden), key=F.col(hidden), plain=F.col(hidden))
    return MetricSpec(pre={hidden: RANKS[alg]().over(w)}, key=F.col(hidden), plain=F.col(hidden))


def searched(fn: Callable[[Column, str], Column]):
    def make(ctx: LevelContext, f: Field) -> MetricSpec:
        need(f, "a")
        name = f.args["a"].lstrip("@")
        if name not in ctx.searched:
            raise QueryError(f"{f.name} requires a search on {name!r}")
        value = fn(ctx.arg(f), ctx.searched[name])
        return MetricSpec(key=value, plain=value)

    return make


BUILT_IN: dict[str, Any] = {
    **{name: simple(name) for name in ("sum", "min", "max", "count", "countDistinct")},
    "avg": avg, "percentile": percentile, "divide": divide, "avgPerDimension": avg_per_dimension,
    "weightAvg": weight_avg, "aggrAverage": aggr_average, "unique": unique, "distinct": distinct,
    "from": from_table, "share": over_level(F.sum), "indexed": over_level(F.max), "ranking": ranking,
    "searchRanking": searched(text_search.score), "searchHeadline": searched(text_search.headline),
}
