"""Joins: eight kinds, conditions by column pairs (``by``) or by a filter tree (``on``)."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.names import Scope, physical
from ..plans.text import QueryError
from .predicates import Tree, literal

HOW = {
    "join": "inner", "innerJoin": "inner", "leftJoin": "left", "leftOuterJoin": "left",
    "rightJoin": "right", "rightOuterJoin": "right", "fullJoin": "full", "fullOuterJoin": "full",
}
PAIRS = {
    "by": lambda a, b: a == b, "by_gt": lambda a, b: a > b, "by_gte": lambda a, b: a >= b,
    "by_lt": lambda a, b: a < b, "by_lte": lambda a, b: a <= b, "by_like": F.like,
}


def join(scope: Scope, kind: str, args: dict[str, Any], right: DataFrame) -> Scope:
    """``scope`` with the table ``args['table']`` joined. Which physical join is used is Catalyst's choice."""
    table = args.get("table")
    if any(k in HOW for k in args):
        raise QueryError("a join can't hold another join")
    if table in scope.tables:
        raise QueryError(f"table {table!r} is already part of this query")
    columns = tuple(right.columns)
    other = physical(right, table)

    def right_col(name: str) -> Column:
        if name.lstrip("@") not in columns:
            raise QueryError(f"table {table!r} has no column {name!r}")
        return F.col(f"`{table}__{name.lstrip('@')}`")

    parts = []
    for key, value in args.items():
        if key in PAIRS:
            if not isinstance(value, str) or value.count(":") != 1:
                raise QueryError(f"{key} requires 'left:right'")
            a, b = value.split(":")
            parts.append(PAIRS[key](scope.col(a), right_col(b)))
        elif key == "by_in":
            raise QueryError("by_in has no meaning: a pair of columns can't be a list")
        elif key == "on":
            value_of = lambda v: scope.col(v) if isinstance(v, str) and v.startswith("@") else literal(v)
            tree = Tree(lambda name, t: right_col(name) if t in (None, table) else scope.col(name, t), lambda t: t == table or t in scope.tables, value_of)
            parts.append(tree.all(value))
    parts = [p for p in parts if p is not None]
    if not parts:
        raise QueryError("join requires by or on")
    return replace(scope, df=scope.df.join(other, reduce(and_, parts), HOW[kind]), tables={**scope.tables, table: columns})


def checked(args: dict[str, Any]) -> str:
    if not args.get("table"):
        raise QueryError("join requires a table")
    return args["table"]
