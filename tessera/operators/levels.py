"""Grouping levels: a fetch becomes one plan for each level that has metrics.

A level with metrics and sub-dimensions is split: each dimension chain is a plan of its own over the
same source, with the keys of the levels above. Sort, limit and offset belong to the level that
declares them; a limited level restricts those below it to its keys.

Levels that are run as one job (``together``) are aggregated from the groups of the deepest one, where
their metrics allow it: the source is scanned and shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import buckets
from ..plans.names import Scope
from ..plans.text import Directive, Field, QueryError
from . import joins
from .metrics import BUILT_IN, MetricSpec
from .predicates import Tree, simple, tree

#: Arguments of a fetch that aren't filters.
RESERVED = {"table", "filters", "from", "search", "type"}
#: Arguments of a dimension.
DIM_ARGS = {"type", "from", "groupBy", "groupByEach", "groupByAlias", "sort_desc", "sort_asc", "limit", "offset", "cutoff", "fields", "format", "name", "alias"}


@dataclass(frozen=True)
class Key:
    name: str  # the output column
    source: str  # the column as the document names it
    value: Column
    width: float | None = None


@dataclass(frozen=True)
class Dim:
    label: str
    keys: tuple[Key, ...]
    array: bool = False
    directives: tuple[Directive, ...] = ()
    prefix: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(k.name for k in self.keys)


@dataclass(frozen=True)
class Metric:
    label: str
    column: str
    directives: tuple[Directive, ...] = ()
    array: bool = False


@dataclass(frozen=True)
class Level:
    """One plan: its frame, and how its columns go into the result."""

    df: DataFrame
    dims: tuple[Dim, ...]
    metrics: tuple[Metric, ...]
    unkeyed: tuple[str, ...] = ()  # metrics that are grouping keys beside the dimensions

    @property
    def keys(self) -> list[str]:
        return [c for d in self.dims for c in d.columns]

    @property
    def path(self) -> tuple[str, ...]:
        return tuple(d.label for d in self.dims)

    def column(self, label: str) -> str | None:
        return next((m.column for m in self.metrics if m.label == label), None)


@dataclass
class Frame:
    """An aggregated frame, for what is computed over it."""

    df: DataFrame
    dims: list[Key]

    def key(self, name: str) -> Column:
        for k in self.dims:
            if name.lstrip("@") in (k.name, k.source):
                return F.col(f"`{k.name}`")
        raise QueryError(f"{name!r} isn't a dimension of this level")

    def total(self, fn: Callable[[Column], Column], column: str) -> Column:
        """One value over the whole frame, as a scalar subquery: no window over a single partition. It
        reads every aggregate of the frame, so that the aggregation below stays the same as the
        level's own and its exchange is reused: one scan, not two."""
        value = fn(F.col(f"`{column}`").cast("double"))
        others = [F.max(F.hash(f"`{c}`")) for c in self.df.columns if c != column and c not in {k.name for k in self.dims}]
        if others:
            value = F.when(F.hash(*others) >= F.lit(-(2**31)), value)  # always so
        return self.df.select(value).scalar()


@dataclass
class LevelContext:
    scope: Scope
    dims: list[Key]
    searched: dict[str, str]
    rows: DataFrame
    fields: tuple[Field, ...] = ()  # all metrics of the level
    merged: dict[str, tuple[Column, Callable[[Column], Column]]] = field(default_factory=dict)  # aggregates that a ``sub`` takes along

    def arg(self, f: Field, name: str = "a") -> Column:
        return self.scope.col(f.args[name], f.args.get("from"))

    def part(self, name: str) -> Column:
        """A dimension's key if ``name`` is one, else the column."""
        found = next((k.value for k in self.dims if name.lstrip("@") in (k.name, k.source)), None)
        return self.scope.col(name) if found is None else found

    def keys(self) -> list[Column]:
        return [k.value.alias(k.name) for k in self.dims]

    def key_names(self) -> list[str]:
        return [k.name for k in self.dims]


def named_in(tree: Any) -> set[str]:
    """The metrics that a having tree names."""
    if isinstance(tree, list):
        return set().union(*map(named_in, tree)) if tree else set()
    out: set[str] = set()
    for key, v in tree.items() if isinstance(tree, dict) else ():
        if key in ("and", "or", "nor", "not"):
            out |= named_in(v)
        elif key not in ("from", "inherited"):
            out.add(key.lstrip("@"))
    return out


@dataclass(frozen=True)
class Wanted:
    """What a walk down the selection has gathered: the rows, the dimensions, the order."""

    scope: Scope
    dims: tuple[Dim, ...] = ()
    sorts: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    offset: int | None = None
    cutoff: str | None = None
    within: tuple[DataFrame, tuple[str, ...]] | None = None  # the keys that a level above leaves


@dataclass(frozen=True)
class Built:
    """What a level was made of. ``merges``: how its aggregates come from those of finer groups, or None."""

    wanted: Wanted
    fields: list[Field]
    grouped: DataFrame | None
    aggs: dict[str, Column]
    merges: dict[str, Callable[[Column], Column]] | None


class LevelBuilder:
    def __init__(self, lookup: Callable[[str], DataFrame], resolvers: dict[str, Any] | None = None, together: bool = False):
        self.lookup = lookup
        self.resolvers = {**BUILT_IN, **(resolvers or {})}
        self.together = together

    def fetch(self, f: Field, table: str | None) -> list[Level]:
        table = f.args.get("table", table)
        if not table:
            raise QueryError("a query requires a table: name the operation or give fetch(table: ...)")
        scope = Scope.of(self.lookup(table), table)
        for kind, args in f.args.items():
            if kind in joins.HOW:
                scope = joins.join(scope, kind, args, self.lookup(joins.checked(args)))
        self.args = {k: v for k, v in f.args.items() if k not in RESERVED and k not in joins.HOW}
        self.filters = dict(f.args.get("filters", {}))
        if "search" in f.args:
            self.filters = {"and": [self.filters, {"search": f.args["search"]}]} if self.filters else {"search": f.args["search"]}
        self.having = f.args.get("filters", {}).get("having")
        self.levels: list[Level] = []
        self.built: list[Built] = []
        self.held = False
        self.walk(f.fields or (), Wanted(scope))
        if self.having and not self.held:
            raise QueryError(f"having: no level has {', '.join(map(repr, named_in(self.having)))}")
        return self.rolled() if self.together else self.levels

    def rolled(self) -> list[Level]:
        """The levels over one aggregation by the keys of the deepest; as they are where a metric can't be
        merged, where a limit or having of a level restricts another, or where the dimensions branch."""
        deepest = max(self.built, key=lambda x: len(x.wanted.dims))
        keys = [k for d in deepest.wanted.dims for k in d.keys]
        for x in self.built:
            if x.merges is None or x.wanted.within or x.wanted.scope is not deepest.wanted.scope or deepest.wanted.dims[: len(x.wanted.dims)] != x.wanted.dims:
                return self.levels
        if len(self.built) < 2 or len({k.name for k in keys}) < len(keys):
            return self.levels
        rows, _ = self.rows(deepest.wanted.scope)
        aggs = {f"__{i}{n}": c for i, x in enumerate(self.built) for n, c in x.aggs.items()}
        base = rows.groupBy(*(k.value.alias(k.name) for k in keys)).agg(*(c.alias(n) for n, c in aggs.items()))
        # Every level reads all aggregates, so that their exchange is the same and Spark runs it once.
        every = F.hash(*(F.max(F.hash(f"`{n}`")) for n in aggs)) >= F.lit(-(2**31))
        out = []
        for i, (x, level) in enumerate(zip(self.built, self.levels)):
            merged = {}
            for n in x.aggs:
                kind = x.grouped.schema[n]
                value = F.when(every, x.merges[n](F.col(f"`__{i}{n}`"))).cast(kind.dataType)
                merged[n] = value if kind.nullable else F.coalesce(value, F.lit(0))  # a count
            own = [k for d in x.wanted.dims for k in d.keys]
            df = base.groupBy(*(F.col(f"`{k.name}`") for k in own)).agg(*(c.alias(n) for n, c in merged.items()))
            out.append(replace(level, df=self.build(x.wanted, x.fields, df)[0].df))
        return out

    def walk(self, fields: tuple[Field, ...], w: Wanted) -> None:
        metrics, children = [], []
        for f in fields:
            if f.name in joins.HOW:
                w = replace(w, scope=joins.join(w.scope, f.name, f.args, self.lookup(joins.checked(f.args))))
                if f.fields:
                    inner = [x for x in f.fields if x.fields is None and x.name not in joins.HOW]
                    metrics += inner
                    nested = [x for x in f.fields if x.name in joins.HOW]
                    for x in nested:
                        w = replace(w, scope=joins.join(w.scope, x.name, x.args, self.lookup(joins.checked(x.args))))
                        metrics += [y for y in x.fields or () if y.fields is None]
                        children += [y for y in x.fields or () if y.fields is not None]
                    children += [x for x in f.fields if x.fields is not None and x.name not in joins.HOW]
            elif f.fields is None:
                metrics.append(f)
            else:
                children.append(f)
        if metrics:
            level, filtered = self.build(w, metrics)
            self.levels.append(level)
            if children:
                within = (level.df.select(*level.keys), tuple(level.keys)) if w.limit is not None or w.offset is not None or filtered else w.within
                own = {k.name for d in w.dims for k in d.keys}
                w = replace(w, sorts=tuple(s for s in w.sorts if s[0] in own), limit=None, offset=None, cutoff=None, within=within if w.dims else None)
        elif not children:
            raise QueryError("a level requires metrics or dimensions")
        for f in children:
            self.walk(f.fields, self.into(f, w))

    def into(self, f: Field, w: Wanted) -> Wanted:
        a = f.args
        sorts = tuple((a[k], k == "sort_desc") for k in a if k in ("sort_desc", "sort_asc"))
        return replace(
            w, dims=(*w.dims, self.dim(f, w.scope)), sorts=(*w.sorts, *sorts),
            limit=a.get("limit", w.limit), offset=a.get("offset", w.offset), cutoff=a.get("cutoff", w.cutoff),
        )

    def dim(self, f: Field, scope: Scope) -> Dim:
        if unknown := f.args.keys() - DIM_ARGS:
            raise QueryError(f"{f.name} has no argument {', '.join(map(repr, sorted(unknown)))}")
        array = f.args.get("type") == "Array"
        if f.name == "combine":
            if not f.args.get("fields"):
                raise QueryError("combine requires fields")
            keys = tuple(self.key({"name": x} if isinstance(x, str) else x, scope) for x in f.args["fields"])
            return Dim(f.label, keys, array, f.directives, f.alias)
        return Dim(f.label, (self.key({**f.args, "name": f.name, "alias": f.alias}, scope),), array, f.directives)

    def key(self, spec: dict, scope: Scope) -> Key:
        name, label = spec["name"], spec.get("alias") or spec["name"]
        if spec.get("groupByAlias") and "groupBy" not in spec:
            raise QueryError("groupByAlias names a table of groupBy")
        # The bucket belongs to the table that groupByAlias names, else to that of from.
        c = scope.col(name, spec.get("from") or (spec["groupByAlias"] if spec.get("groupByAlias") in scope.tables else None))
        if "groupByEach" in spec:
            n = spec["groupByEach"]
            if not isinstance(n, (int, float)) or n <= 0:
                raise QueryError("groupByEach requires a positive width")
            return Key(label, name, buckets.width_label(buckets.width_bucket(c, n), n), n)
        if "groupBy" in spec:
            return Key(label, name, buckets.date_bucket(spec["groupBy"], c))
        return Key(label, name, c)

    def rows(self, scope: Scope) -> tuple[DataFrame, dict[str, str]]:
        parts = [simple(scope, k, v) for k, v in self.args.items()]
        found, searched = tree(scope, self.filters) if self.filters else (None, {})
        parts += [found] if found is not None else []
        return (scope.df.filter(reduce(and_, parts)) if parts else scope.df), searched

    def build(self, w: Wanted, fields: list[Field], merged: DataFrame | None = None) -> tuple[Level, bool]:
        """The level, and whether ``having`` filtered it: the levels below it are then restricted to its
        keys. ``merged``: its groups, where they are made already."""
        rows, searched = self.rows(w.scope)
        dims = [k for d in w.dims for k in d.keys]
        if w.within:
            frame, names = w.within
            held = frame.select(*(F.col(f"`{n}`").alias(f"__in_{n}") for n in names))
            values = {k.name: k.value for k in dims}
            rows = rows.join(held, reduce(and_, (values[n].eqNullSafe(F.col(f"`__in_{n}`")) for n in names)), "left_semi")
        ctx = LevelContext(replace(w.scope, df=rows), dims, searched, rows, tuple(fields))
        specs: dict[str, MetricSpec | None] = {}
        sorts = list(w.sorts)
        limit, offset = w.limit, w.offset
        for f in fields:
            if f.label in specs:
                raise QueryError(f"{f.label!r} is defined twice")
            bare = f.name not in self.resolvers or (f.alias is None and "a" not in f.args and f.name != "distinct")
            specs[f.label] = None if bare else self.resolvers[f.name](ctx, f)
            if bare:
                if "sort" in f.args:
                    sorts.append((f.label, f.args["sort"] == "desc"))
                limit, offset = f.args.get("limit", limit), f.args.get("offset", offset)
        for s in specs.values():
            for name, value in (s.pre if s else {}).items():
                rows = rows.withColumn(name, value)
            if s and s.beside and not dims:
                rows = s.beside(rows)
            if s and s.wider:
                rows = s.wider(rows)
        grouped = bool(dims) or any(s and (s.aggs or s.sub or s.pre or s.wider) for s in specs.values())
        columns = {f.label: (specs[f.label].column if specs[f.label] and specs[f.label].column else f.label) for f in fields}
        if grouped:
            df = self.grouped(rows, w, ctx, dims, fields, specs, columns, merged)
        else:
            self.built.append(Built(w, fields, None, {}, None))
            values = [(s.plain if s else w.scope.col(f.name, f.args.get("from"))).alias(f.label) for f, s in zip(fields, specs.values())]
            df = rows.select(*values)
            if any(s and s.distinct for s in specs.values()):
                df = df.distinct()
        names = [k.name for k in dims] + [columns[f.label] for f in fields if columns[f.label] not in {k.name for k in dims}]
        if w.cutoff and dims:
            names.append("cutoff")
        df = self.ordered(df.select(*(F.col(f"`{n}`") for n in dict.fromkeys(names))), sorts, limit, offset, [k.name for k in dims])
        metrics = tuple(Metric(f.label, columns[f.label], f.directives, f.args.get("type") == "Array") for f in fields)
        filtered = grouped and self.applies(dims, fields)
        self.held |= filtered
        return Level(df, w.dims, metrics, tuple(f.label for f in fields if specs[f.label] and specs[f.label].key is not None)), filtered

    def grouped(self, rows: DataFrame, w: Wanted, ctx: LevelContext, dims: list[Key], fields: list[Field], specs: dict, columns: dict, merged: DataFrame | None = None) -> DataFrame:
        keys = list(dims)
        aggs: dict[str, Column] = {}
        for f in fields:
            s = specs[f.label]
            if s is None:
                continue
            if s.key is not None and not s.aggs:
                keys.append(Key(f.label, f.args.get("a", f.label), s.key))
            aggs |= s.aggs
        if w.cutoff:
            aggs["__cutoff"] = F.sum(w.scope.col(w.cutoff))
        seen: dict[str, Key] = {}
        for k in keys:
            seen.setdefault(k.name, k)
        keys = list(seen.values())
        values = [k.value.alias(k.name) for k in keys]
        widths = {k.name: k.width for k in dims if k.width}
        merges = {n: s.merge for s in specs.values() if s for n in s.aggs} | ({"__cutoff": F.sum} if w.cutoff else {})
        whole = [f.label for f in fields if specs[f.label] and specs[f.label].by_all]
        first_sub = None
        if merged is not None:
            df = merged
        elif len(whole) == 1 and all(merges.values()):
            first_sub = whole[0]
            df = specs[first_sub].sub(replace(ctx, rows=rows, dims=keys, merged={n: (c, merges[n]) for n, c in aggs.items()}))
        elif aggs:
            df = rows.groupBy(*values).agg(*(c.alias(n) for n, c in aggs.items()))
        elif keys:
            df = rows.select(*values).distinct()
        else:
            df = None
        if merged is None:
            plain = all(s is None or (s.merge and not s.pre and not s.wider) for s in specs.values())
            self.built.append(Built(w, fields, df, aggs, merges if plain and aggs else None))
        for f in fields:
            s = specs[f.label]
            if s is not None and s.sub is not None and f.label != first_sub:
                by = keys if s.by_all else dims
                own = s.sub(replace(ctx, rows=rows, dims=by))
                found = [c for c in own.columns if c not in {k.name for k in by}]
                if df is None:
                    df = own
                elif by:
                    other = own.select(*(F.col(f"`{k.name}`").alias(f"__sub_{k.name}") for k in by), *(F.col(f"`{c}`") for c in found))
                    df = df.join(other, reduce(and_, (F.col(f"`{k.name}`").eqNullSafe(F.col(f"`__sub_{k.name}`")) for k in by)), "left").drop(*(f"__sub_{k.name}" for k in by))
                else:
                    for c in found:
                        df = df.withColumn(c, own.select(f"`{c}`").scalar())
        frame = Frame(df, keys)
        done: set[str] = set()
        if self.applies(dims, fields):  # before any total: those are over the groups that are left
            names = named_in(self.having)
            first = [f for f in fields if f.label in names and specs[f.label] is not None and columns[f.label] not in df.columns]
            for f in first:
                s = specs[f.label]
                df = df.withColumn(columns[f.label], F.col(f"`__{f.label}`") if s.sub is not None else s.post(frame))
                done.add(f.label)

            def column(name: str, table: str | None) -> Column:
                return F.col(f"`{columns.get(name, name)}`") if columns.get(name, name) in df.columns else frame.key(name)

            found = Tree(column, lambda t: t in w.scope.tables).all(self.having)
            df = df.filter(found) if found is not None else df
            frame = Frame(df, keys)
        for f in fields:
            s, name = specs[f.label], columns[f.label]
            if f.label in done:
                continue
            if s is None:
                value = self.bare(f, frame, specs, columns, widths)
            elif s.sub is not None:
                value = F.col(f"`__{f.label}`")
            elif s.post is not None:
                value = s.post(frame)
            elif s.key is not None:
                continue
            else:
                raise QueryError(f"{f.name} has no value in a grouped level")
            if name not in {k.name for k in keys} or s is not None:
                df = df.withColumn(name, value)
        if w.cutoff:
            df = df.withColumn("cutoff", F.col("__cutoff").cast("double") / frame.total(F.sum, "__cutoff"))
        return df

    def applies(self, dims: list[Key], fields: list[Field]) -> bool:
        """``having`` filters the levels that have every metric or dimension it names."""
        known = {f.label for f in fields} | {n for k in dims for n in (k.name, k.source)}
        return bool(self.having) and named_in(self.having) <= known

    def bare(self, f: Field, frame: Frame, specs: dict, columns: dict, widths: dict) -> Column:
        for kind, add in (("min", lambda n: 0), ("max", lambda n: n - 1)):
            for name, n in widths.items():
                source = next(k.source for k in frame.dims if k.name == name)
                if f.name in (f"groupByEach_{kind}_{name}", f"groupByEach_{kind}_{source}"):
                    low = F.split(F.col(f"`{name}`"), "-")
                    start = F.when(F.col(f"`{name}`").startswith("-"), -low[1].cast("double")).otherwise(low[0].cast("double"))
                    value = start + add(n)
                    return value.cast("int") if isinstance(n, int) else value
        if f.name in specs and f.name != f.label:
            return F.col(f"`{columns[f.name]}`")
        return frame.key(f.name)

    @staticmethod
    def ordered(df: DataFrame, sorts: list, limit: int | None, offset: int | None, keys: list[str]) -> DataFrame:
        order = []
        for name, desc in sorts:
            if name not in df.columns:
                raise QueryError(f"can't sort by {name!r}: it isn't selected")
            order.append(F.desc_nulls_first(f"`{name}`") if desc else F.asc_nulls_last(f"`{name}`"))
        if order and (limit is not None or offset is not None):
            order += [F.asc_nulls_last(f"`{k}`") for k in keys if k not in {s[0] for s in sorts}]
        df = df.orderBy(*order) if order else df
        df = df.offset(offset) if offset is not None else df
        return df.limit(limit) if limit is not None else df
