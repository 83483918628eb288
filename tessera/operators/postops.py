"""Operators between results: mutations and directives, as joins and windows over level frames.

Directives see the results as they were fetched (``origin``); mutations run in text order, and each
sees what those before it made. A missing counterpart and a division by zero give null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.text import Directive, Field, QueryError
from .levels import Level, Metric

Results = dict[str, list[Level]]
TESTS: dict[str, Callable[[Column, Any], Column]] = {
    "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v, "eq": lambda c, v: c == v, "in": lambda c, v: c.isin(v if isinstance(v, list) else str(v).split("|")),
}
CHANGES: dict[str, Callable[[Column, Column], Column]] = {
    "diff": lambda v, o: F.try_divide(v.cast("double"), o.cast("double")) - 1,
    "subtract": lambda v, o: v - o,
    "divideBy": lambda v, o: F.try_divide(v.cast("double"), o.cast("double")),
}


def test_of(key: str) -> tuple[str, str]:
    """``value_gt`` is (value, gt); a name without such an end is compared for equality."""
    name, _, op = key.rpartition("_")
    return (name, op) if name and op in TESTS else (key, "eq")


def named(results: Results, name: Any) -> list[Level]:
    if name not in results:
        raise QueryError(f"no result is named {name!r}")
    return results[name]


def like(levels: list[Level], path: tuple[str, ...], label: str | None = None) -> Level | None:
    return next((x for x in levels if x.path == path and (label is None or x.column(label))), None)


def combined(level: Level, other: Level, label: str, change: Callable[[Column, Column], Column], keys: list[str]) -> Level:
    """``level`` with a metric changed by the value of ``other`` in the row of equal ``keys``."""
    mine, theirs = level.column(label), other.column(label)
    side = other.df.select(*(F.col(f"`{k}`").alias(f"__o_{k}") for k in keys), F.col(f"`{theirs}`").alias("__other"))
    if keys:
        df = level.df.join(side, reduce(and_, (F.col(f"`{k}`").eqNullSafe(F.col(f"`__o_{k}`")) for k in keys)), "left")
    else:
        df = level.df.withColumn("__other", side.select("__other").scalar())
    value = change(F.col(f"`{mine}`"), F.col("__other"))
    return replace(level, df=df.select(*((value.alias(c) if c == mine else F.col(f"`{c}`")) for c in level.df.columns)))


def leaves(fields: tuple[Field, ...], path: tuple[Field, ...] = ()):
    for f in fields:
        if f.fields is None:
            yield path, f
        else:
            yield from leaves(f.fields, (*path, f))


def mutate(results: Results, f: Field) -> Results:
    target = f.label
    levels = list(named(results, target))
    if f.name == "blank":
        return {**results, target: [replace(x, df=x.df.limit(0)) for x in levels]}
    if f.name != "pick" and f.name not in CHANGES:
        raise QueryError(f"unknown mutation {f.name!r}")
    by = named(results, f.args.get("by"))
    for path, leaf in leaves(f.fields or ()):
        if f.name == "pick":
            levels = [pick(x, by, (*(p.label for p in path), leaf.label), leaf.args) for x in levels]
            continue
        where = tuple(p.label for p in path)
        other = like(by, where, leaf.label)
        if other is None:
            raise QueryError(f"{f.args.get('by')!r} has no {leaf.label!r} at {'.'.join(where) or 'the top'}")
        levels = [combined(x, other, leaf.label, CHANGES[f.name], other.keys) if x.column(leaf.label) and set(where) <= set(x.path) and x.path[-len(where) :] == where[-len(x.path) :] else x for x in levels]
    return {**results, target: levels}


def pick(level: Level, by: list[Level], path: tuple[str, ...], args: dict[str, Any]) -> Level:
    if not set(path) <= set(level.path):
        return level
    tests = [test_of(k) + (v,) for k, v in args.items()]
    other = next((x for x in by if x.path == path and all(x.column(n) for n, _, _ in tests)), None)
    if other is None:
        raise QueryError(f"the picking result has no such metrics at {'.'.join(path)}")
    rows = other.df
    if tests:
        rows = rows.filter(reduce(and_, (TESTS[op](F.col(f"`{other.column(n)}`"), v) for n, op, v in tests)))
    held = rows.select(*(F.col(f"`{k}`").alias(f"__p_{k}") for k in other.keys))
    on = reduce(and_, (F.col(f"`{k}`").eqNullSafe(F.col(f"`__p_{k}`")) for k in other.keys))
    return replace(level, df=level.df.join(held, on, "left_semi"))


def tagged(origin: Results, group: str) -> list[tuple[Level, str]]:
    return [(x, m.column) for levels in origin.values() for x in levels for m in x.metrics for d in m.directives if d.name == "indexed" and d.args.get("group") == group]


def largest(columns: list[tuple[DataFrame, str]]) -> Column:
    """The largest value of several columns, 0 at least, as a scalar subquery."""
    parts = [df.select(F.max(F.col(f"`{c}`").cast("double")).alias("m")) for df, c in columns]
    return reduce(lambda a, b: a.unionByName(b), parts).select(F.greatest(F.max("m"), F.lit(0.0))).scalar()


def on_metric(level: Level, m: Metric, d: Directive, origin: Results) -> Level:
    c = F.col(f"`{m.column}`")
    if d.name == "omit":
        return level
    if d.name in ("diff", "subtract"):
        other = like(named(origin, d.args.get("by")), level.path, m.label)
        if other is None:
            raise QueryError(f"{d.args.get('by')!r} has no {m.label!r} at the same place")
        return combined(level, other, m.label, CHANGES[d.name], level.keys)
    if d.name == "indexed":
        if "group" in d.args:
            sources = [(x.df, col) for x, col in tagged(origin, d.args["group"])]
        else:
            other = like(named(origin, d.args.get("to")), level.path, m.label)
            if other is None:
                raise QueryError(f"{d.args.get('to')!r} has no {m.label!r} at the same place")
            sources = [(level.df, m.column), (other.df, other.column(m.label))]
        return replace(level, df=level.df.withColumn(m.column, F.try_divide(c.cast("double"), largest(sources))))
    if d.name == "filter":
        tests = [TESTS[k](c, v) for k, v in d.args.items() if k in TESTS]
        return replace(level, df=level.df.withColumn(m.column, F.when(reduce(and_, tests), c))) if tests else level
    raise QueryError(f"unknown directive @{d.name} on a metric")


def on_dim(level: Level, d: Directive) -> Level:
    tests: dict[str, list[Column]] = {}
    for key, v in d.args.items():
        if key != "replacers":
            name, op = test_of(key)
            column = level.column(name) or (name if name in level.df.columns else None)
            if column:
                tests.setdefault(column, []).append(TESTS[op](F.col(f"`{column}`"), v))
    if d.name == "filter":
        every = [t for ts in tests.values() for t in ts]
        return replace(level, df=level.df.filter(reduce(and_, every))) if every else level
    if d.name == "groupOn":
        if not tests:
            return level
        hit = F.coalesce(reduce(or_, (reduce(and_, ts) for ts in tests.values())), F.lit(False))
        new = d.args.get("replacers", {})
        df = level.df.select(*((F.when(hit, F.lit(new[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`")) for c in level.df.columns))
        kinds = dict(df.dtypes)
        sums = [(F.max if kinds[c] in ("string", "boolean") or kinds[c].startswith(("timestamp", "date")) else F.sum)(F.col(f"`{c}`")).alias(c) for c in df.columns if c not in level.keys]
        return replace(level, df=df.groupBy(*(F.col(f"`{k}`") for k in level.keys)).agg(*sums).select(*(F.col(f"`{c}`") for c in level.df.columns)))
    if d.name == "omit":
        return level
    raise QueryError(f"unknown directive @{d.name} on a dimension")


def direct(level: Level, origin: Results) -> Level:
    for m in level.metrics:
        for d in m.directives:
            level = on_metric(level, m, d, origin)
    for dim in level.dims:
        for d in dim.directives:
            level = on_dim(level, d)
    return level


def without_omitted(level: Level, full_only: bool = False) -> Level:
    gone = {m.column for m in level.metrics for d in m.directives if d.name == "omit" and (not full_only or d.args.get("full"))}
    if not gone:
        return level
    metrics = tuple(m for m in level.metrics if m.column not in gone)
    return replace(level, metrics=metrics, df=level.df.drop(*(c for c in gone if c not in level.keys)))


def finished(results: Results, mutations: list[Field]) -> Results:
    origin = {n: [without_omitted(x, full_only=True) for x in levels] for n, levels in results.items()}
    if mutations:
        current, touched = dict(origin), set()
        for f in mutations:
            current = mutate(current, f)
            touched.add(f.label)
        current = {n: [direct(x, origin) for x in levels] if n in touched else levels for n, levels in current.items()}
    else:
        current = {n: [direct(x, origin) for x in levels] for n, levels in origin.items()}
    return {n: [without_omitted(x) for x in levels] for n, levels in current.items()}
