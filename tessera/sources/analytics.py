"""Request-based analytics sources: a fetch becomes a request, a provider gives rows for it, and what
the request can't express is done on these rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import date_bucket
from ..operators.levels import Dim, Key, Level, Metric
from ..operators.predicates import split_suffix
from ..plans.text import Field, QueryError

PREFIX = "ga:"


@dataclass
class Request:
    """``params``: what is asked; ``after``: what is done on the rows; ``level``: how rows are shaped."""

    params: dict[str, Any]
    after: list[tuple[str, Field]] = field(default_factory=list)
    dims: list[Field] = field(default_factory=list)
    metrics: list[Field] = field(default_factory=list)


def request(f: Field) -> Request:
    dims: list[str] = []
    metrics: list[str] = []
    sorts: list[str] = []
    out = Request({})

    def visit(fields: tuple[Field, ...]) -> None:
        for x in fields:
            for key in ("sort_desc", "sort_asc"):
                if key in x.args:
                    sorts.append(("-" if key == "sort_desc" else "") + PREFIX + x.args[key])
            if x.fields is not None:
                dims.append(x.name)
                out.dims.append(x)
                if "groupBy" in x.args:
                    out.after.append(("groupBy", x))
                visit(x.fields)
            elif x.name == "divide":
                if not {"a", "by"} <= set(x.args):
                    raise QueryError("divide requires the arguments 'a' and 'by'")
                metrics.extend([x.args["a"], x.args["by"]])
                out.metrics.append(x)
                out.after.append(("divide", x))
            elif x.name == "indexed":
                metrics.append(x.args["a"])
                out.metrics.append(x)
                out.after.append(("indexed", x))
            else:
                metrics.append(x.args.get("a", x.name))
                out.metrics.append(x)

    visit(f.fields or ())
    for key, v in f.args.items():
        if key != "table":
            out.params[split_suffix(key)[0].replace("_", "-", 1)] = v
    join = lambda names: ",".join(dict.fromkeys(PREFIX + n for n in names))
    out.params |= {"dimensions": join(dims), "metrics": join(metrics)}
    if sorts:
        out.params["sort"] = ",".join(sorts)
    return out


def transformed(r: Request, rows: DataFrame) -> Level:
    """Rows of a provider with date buckets, ratios and indexes: bucketed dates are merged by summing
    the numbers of rows equal elsewhere."""
    numbers = {f.args.get("a", f.name) for f in r.metrics} | {f.args["by"] for k, f in r.after if k == "divide"}
    buckets = [f for k, f in r.after if k == "groupBy"]
    for f in buckets:
        rows = rows.withColumn(f.name, date_bucket(f.args["groupBy"], F.col(f.name)))
    if buckets:
        keys = [c for c in rows.columns if c not in numbers]
        rows = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in rows.columns if c in numbers))
    columns = [F.col(f.name).alias(f.label) for f in r.dims]
    for f in r.metrics:
        if f.name == "divide":
            columns.append(F.try_divide(F.col(f.args["a"]).cast("double"), F.col(f.args["by"]).cast("double")).alias(f.label))
        elif f.name == "indexed":
            c = F.col(f.args["a"]).cast("double")
            if f.args.get("alg") == "first":
                by = [F.asc(d.name) for d in r.dims]
                if not by:
                    raise QueryError("indexed(alg: first) requires a dimension that orders the rows")
                base = rows.orderBy(*by).limit(1).select(c).scalar()
            else:
                base = rows.select(F.max(c)).scalar()
            columns.append(F.try_divide(c, base).alias(f.label))
        else:
            columns.append(F.col(f.args.get("a", f.name)).alias(f.label))
    dims = tuple(Dim(f.label, (Key(f.label, f.name, F.col(f.name)),), f.args.get("type") == "Array", f.directives) for f in r.dims)
    return Level(rows.select(*columns), dims, tuple(Metric(f.label, f.label, f.directives) for f in r.metrics))
