"""Filters: argument suffixes, the filter tree, and conditions of joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import search as text_search
from ..plans.names import Scope
from ..plans.text import QueryError

COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "regex": lambda c, v: c.like(v),  # by its name a pattern, by its meaning LIKE
    "in": lambda c, v: c.isin(many("IN", v)),
    "nin": lambda c, v: ~c.isin(many("NOT IN", v)),
}
SUFFIXES = ("_gte", "_lte", "_gt", "_lt", "_like", "_in")


def many(name: str, v: Any) -> list:
    if not isinstance(v, list):
        raise QueryError(f"{name} requires a list")
    return v


def literal(v: Any) -> Any:
    return F.lit(v)


def split_suffix(key: str, suffixes=SUFFIXES) -> tuple[str, str]:
    for s in suffixes:
        if key.endswith(s) and len(key) > len(s):
            return key[: -len(s)], s[1:]
    return key, "eq"


def simple(scope: Scope, key: str, value: Any) -> Column:
    """An argument such as ``price_gt: 5`` or ``country_in: "DE|US"``."""
    name, op = split_suffix(key)
    if op == "in" and isinstance(value, str):
        value = value.split("|")
    column = scope.col(name, scope.table)
    if op == "like":
        return column.like(str(value))
    return COMPARE[op](column, value if op == "in" else literal(value))


class Tree:
    """Compiles a filter tree. ``resolve`` gives the column of a field and a qualifier; ``value`` turns
    what stands in the tree into an operand (join conditions read ``@column`` there)."""

    def __init__(self, resolve: Callable[[str, str | None], Column], tables: Callable[[str], bool], value: Callable[[Any], Any] = literal):
        self.resolve, self.tables, self.value = resolve, tables, value
        self.searched: dict[str, str] = {}

    def all(self, tree: dict, table: str | None = None, field: str | None = None) -> Column | None:
        if not isinstance(tree, dict):
            raise QueryError(f"a filter is an object, not {tree!r}")
        if tree.get("inherited") is False and tree.get("from") is not None and not self.tables(tree["from"]):
            return None
        parts = []
        for key, v in tree.items():
            if key == "from":
                table = v
            elif key not in ("inherited", "having"):
                parts.append(self.one(key, v, table, field))
        parts = [p for p in parts if p is not None]
        return reduce(and_, parts) if parts else None

    def list(self, name: str, v: Any, table: str | None, field: str | None) -> list[Column]:
        out = [self.all(x, table, field) for x in many(name.upper(), v)]
        out = [x for x in out if x is not None]
        if not out:
            raise QueryError(f"{name} requires at least one filter")
        return out

    def one(self, key: str, v: Any, table: str | None, field: str | None) -> Column | None:
        if key == "and":
            return reduce(and_, self.list(key, v, table, field))
        if key == "or":
            return reduce(or_, self.list(key, v, table, field))
        if key == "nor":
            return ~reduce(or_, self.list(key, v, table, field))
        if key == "not":
            inner = self.list(key, v, table, field) if isinstance(v, list) else [self.all(v, table, field)]
            return ~reduce(and_, [x for x in inner if x is not None]) if any(x is not None for x in inner) else None
        if key == "search":
            parts = []
            for name, query in v.items():
                self.searched[name] = query
                parts.append(text_search.matches(self.resolve(name, table), query))
            return reduce(and_, parts)
        if field is not None and key in COMPARE:
            column = self.resolve(field, table)
            return COMPARE[key](column, v if key in ("in", "nin") else (v if key in ("regex", "like") and not str(v).startswith("@") else self.value(v)))
        if field is not None:
            raise QueryError(f"unknown operator {key!r} on {field!r}")
        if isinstance(v, dict):
            return self.all(v, table, key)
        return self.resolve(key, table) == self.value(v)


def tree(scope: Scope, filters: dict) -> tuple[Column | None, dict[str, str]]:
    t = Tree(lambda name, table: scope.col(name, table or scope.table), lambda table: table in scope.tables)
    return t.all(filters), t.searched
