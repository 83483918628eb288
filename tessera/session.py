"""The engine: a document in, DataFrames or one nested document out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import shape
from .operators.levels import Level, LevelBuilder
from .operators.postops import Results, finished
from .plans.text import Field, QueryError, parse
from .sources import analytics
from .sources.catalog import Catalog


class Engine:
    """``engine(text)`` gives the nested document, ``engine.frames(text)`` the level frames by result
    name, ``engine.frame(text)`` the only frame of a document with one level."""

    def __init__(self, catalog: Catalog, provider: Callable[[dict], DataFrame] | None = None):
        self.catalog, self.provider = catalog, provider
        self.resolvers: dict[str, Any] = {}
        self.data_resolvers: dict[str, Callable] = {}
        self.before: list[Callable] = []
        self.execute: Callable | None = None
        self.after: list[Callable] = []

    def use_resolver(self, name: str, fn: Callable) -> Engine:
        """Register or override a metric: fn(level context, field) gives a MetricSpec."""
        self.resolvers[name] = fn
        return self

    def use_data_resolver(self, name: str, fn: Callable) -> Engine:
        """Override how a metric goes into the document: fn(object, label, value)."""
        self.data_resolvers[name] = fn
        return self

    def before_fetch(self, fn: Callable[[Results], Any]) -> Engine:
        """Called with the planned levels; a false answer other than None cancels, and the result is None."""
        self.before.append(fn)
        return self

    def db_fetch(self, fn: Callable[[Results], Any]) -> Engine:
        """Replaces execution: gives one list of rows (dicts) or a DataFrame for each level, in order."""
        self.execute = fn
        return self

    def after_fetch(self, fn: Callable[[Any], Any]) -> Engine:
        self.after.append(fn)
        return self

    def plan(self, text: str, together: bool = False) -> tuple[Results, list[Field], set[str]]:
        scope: dict[str, DataFrame] = {}
        results: Results = {}
        mutations: list[Field] = []
        plain: set[str] = set()

        def lookup(name: str) -> DataFrame:
            return scope[name] if name in scope else self.catalog.table(name)

        for op in parse(text):
            if op.kind == "mutation":
                mutations += op.fields
                continue
            for f in op.fields:
                if f.name == "with":
                    if f.alias is None:
                        raise QueryError("with requires a name")
                    levels = LevelBuilder(lookup, self.resolvers).fetch(f, op.name)
                    if len(levels) != 1:
                        raise QueryError(f"{f.alias!r}: a with can't have several levels")
                    scope[f.alias] = levels[0].df
                elif f.name in ("fetch", "fetchPlain"):
                    name = f.alias or ""
                    if op.source:
                        if self.provider is None:
                            raise QueryError(f"no provider for the source {op.source!r}")
                        r = analytics.request(f)
                        levels = [analytics.transformed(r, self.provider(r.params))]
                    else:
                        levels = LevelBuilder(lookup, self.resolvers, together).fetch(f, op.name)
                    results.setdefault(name, []).extend(levels)
                    if f.name == "fetchPlain":
                        plain.add(name)
                else:
                    raise QueryError(f"unknown operation {f.name!r}")
        return results, mutations, plain

    def frames(self, text: str) -> dict[str, list[DataFrame]]:
        results, mutations, _ = self.plan(text)
        return {n: [x.df for x in levels] for n, levels in finished(results, mutations).items()}

    def frame(self, text: str, name: str | None = None) -> DataFrame:
        found = self.frames(text)
        levels = found[name] if name is not None else next(iter(found.values()))
        if (name is None and len(found) != 1) or len(levels) != 1:
            raise QueryError("the document has several frames: use frames()")
        return levels[0]

    def levels(self, text: str, together: bool = False) -> Results:
        """The planned levels by result name. ``together``: as they are best run in one job."""
        results, mutations, _ = self.plan(text, together)
        return finished(results, mutations)

    def __call__(self, text: str) -> Any:
        results, mutations, plain = self.plan(text, together=True)
        for fn in self.before:
            answer = fn(results)
            if answer is not None and not answer:
                return None
        if self.execute is not None:
            results = replaced(results, self.execute(results))
        results = finished(results, mutations)
        documents, found = {}, iter(collected([x.df for levels in results.values() for x in levels]))
        for name, levels in results.items():
            rows = [next(found) for _ in levels]
            documents[name] = rows if name in plain else shape.nested(levels, rows, resolvers=self.data_resolvers)
        out = documents[""] if list(documents) == [""] else documents
        for fn in self.after:
            fn(out)
        return out


def collected(frames: list[DataFrame]) -> list[list[dict]]:
    """The rows of several frames, each in its order, by one job: what they share is computed once."""
    if len(frames) < 2:
        return [[r.asDict() for r in df.collect()] for df in frames]
    kinds = [df.schema for df in frames]
    parts = []
    for i, df in enumerate(frames):
        own = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        parts.append(df.select(F.lit(i).alias("at"), *((own if i == j else F.lit(None)).cast(kinds[j]).alias(f"f{j}") for j in range(len(frames)))))
    out: list[list[dict]] = [[] for _ in frames]
    for r in reduce(DataFrame.union, parts).collect():
        out[r["at"]].append(r[f"f{r['at']}"].asDict())
    return out


def replaced(results: Results, found: Any) -> Results:
    """The levels of ``results`` over other rows, given in the order of the levels."""
    from dataclasses import replace

    out, at = {}, 0
    for name, levels in results.items():
        new: list[Level] = []
        for x in levels:
            rows, at = found[at], at + 1
            if not isinstance(rows, DataFrame):
                wanted = [*x.keys, *(m.column for m in x.metrics if m.column not in x.keys)]
                spark = x.df.sparkSession
                if rows:
                    kinds = {c: kind([r.get(c) for r in rows]) for c in wanted}
                    data = [tuple(None if r.get(c) is None else CASTS[kinds[c]](r[c]) for c in wanted) for r in rows]
                    rows = spark.createDataFrame(data, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))
                else:
                    rows = x.df.limit(0)
            new.append(replace(x, df=rows))
        out[name] = new
    return out


CASTS = {"boolean": bool, "long": int, "double": float, "string": str}


def kind(values: list) -> str:
    values = [v for v in values if v is not None]
    if values and all(isinstance(v, bool) for v in values):
        return "boolean"
    if values and all(isinstance(v, int) for v in values):
        return "long"
    return "double" if values and all(isinstance(v, (int, float)) for v in values) else "string"
