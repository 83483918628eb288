"""Result shapes: level frames to one nested document, on the driver or as a JSON column.

A dimension keys an object by its values, or, with ``type: Array``, is a list of objects. Levels of
one fetch merge into one tree. Composite keys join their values by ``;``.
"""

from __future__ import annotations

import datetime
import decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.text import QueryError
from .levels import Level


def plain(v: Any) -> Any:
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return float(v) if isinstance(v, decimal.Decimal) else v


def keyed(v: Any) -> str:
    v = plain(v)
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


class Tree:
    """Merges rows; list places are found by a hash of the element's keys."""

    def __init__(self):
        self.root: Any = None
        self.places: dict[tuple, dict] = {}

    def start(self, as_list: bool) -> Any:
        if self.root is None:
            self.root = [] if as_list else {}
        return self.root

    def at(self, level: Level, row: dict[str, Any], rooted: bool, bare: set[int]) -> dict:
        """The object of a row. ``bare``: the array dimensions whose list stands in the place of the
        object above, as nothing else is there."""
        here: Any = self.start(bool(level.dims) and level.dims[0].array and rooted)
        path: tuple = ()
        for i, d in enumerate(level.dims):
            values = tuple(row[c] for c in d.columns)
            if d.prefix:
                here = here.setdefault(d.prefix, {}) if isinstance(here, dict) else here
            if not d.array:
                key = ";".join(map(keyed, values))
                path += (key,)
                here = here.setdefault(key, [] if i + 1 in bare else {})
                continue
            path += ((d.label, values),)
            if path not in self.places:
                elements = here if isinstance(here, list) else here.setdefault(d.label, [])
                self.places[path] = dict(zip(d.columns, map(plain, values)))
                elements.append(self.places[path])
            here = self.places[path]
        return here


def bare_lists(level: Level, levels: list[Level]) -> set[int]:
    """The array dimensions of ``level`` below a keyed one under which no level has anything else."""
    out = set()
    for i, d in enumerate(level.dims):
        beside = [x.path for x in levels if x.path[:i] == level.path[:i]]
        if i and d.array and not level.dims[i - 1].array and all(len(p) > i and p[i] == d.label for p in beside):
            out.add(i)
    return out


def array_metrics(level: Level, rows: list[dict]) -> Any:
    """Lists of {metric: value}, each value once, in the order of the rows; a single metric's list is
    the document itself."""
    lists = {m.label: [{m.label: v} for v in dict.fromkeys(plain(row[m.column]) for row in rows)] for m in level.metrics}
    return next(iter(lists.values())) if len(lists) == 1 else lists


def nested(levels: list[Level], rows: list[list[dict]], extra: dict[str, Any] | None = None, resolvers: dict | None = None) -> Any:
    """One fetch's document. ``rows``: those of each level."""
    tree = Tree()
    if len(levels) == 1 and not levels[0].dims and levels[0].metrics and all(m.array for m in levels[0].metrics):
        return array_metrics(levels[0], rows[0])
    rooted = all(x.dims for x in levels)  # with metrics at the top the document is an object
    tree.start(bool(levels) and rooted and all(x.dims[0].array for x in levels))
    for level, found in zip(levels, rows):
        bare, held = bare_lists(level, levels), set()
        for row in found:
            if level.dims and not level.dims[-1].array and not any(x.name == "groupOn" for x in level.dims[-1].directives):
                once = tuple(row[c] for c in level.keys)
                if once in held:
                    raise QueryError(f"several rows for one key at {'.'.join(level.path)}: a unique value needs type: Array")
                held.add(once)
            if not level.dims and any(m.array for m in level.metrics):
                found_lists = array_metrics(level, found)
                tree.start(False).update(found_lists if isinstance(found_lists, dict) else {level.metrics[0].label: found_lists})
                break
            here = tree.at(level, row, rooted, bare)
            for d in level.dims:
                for x in d.directives:
                    for c, v in x.args.get("replacers", {}).items() if x.name == "groupOn" else ():
                        if row.get(c) == v:
                            here[c] = v
            for m in level.metrics:
                v = row.get(m.column)
                dropped = v is None and any(x.name == "filter" for x in m.directives)
                if dropped:
                    continue
                if resolvers and m.label in resolvers:
                    resolvers[m.label](here, m.label, plain(v))
                else:
                    here[m.column] = plain(v)
    return tree.root if tree.root is not None else {}


def nested_json(level: Level) -> DataFrame:
    """One row, one column ``json``: the level's document made by Spark, keys in ascending order. The
    document is one value, so it must fit in a row: this is for results, not for tables."""
    if level.dims and not level.dims[-1].array and level.unkeyed:
        raise QueryError(f"{level.unkeyed[0]!r} gives several rows for one key: a unique value needs type: Array")
    df, kinds = level.df, list(level.dims)
    value = F.struct(*(F.col(f"`{m.column}`") for m in level.metrics))
    df = df.select(*(F.col(f"`{c}`") for c in level.keys), value.alias("__v"))
    for i in range(len(kinds) - 1, -1, -1):
        d, outer = kinds[i], [c for x in kinds[:i] for c in x.columns]
        key = F.concat_ws(";", *(F.col(f"`{c}`").cast("string") for c in d.columns))
        if d.array:
            below = [F.col(f"__v.`{m.column}`") for m in level.metrics] if i == len(kinds) - 1 else [F.col(f"__v.{kinds[i + 1].label}") if kinds[i + 1].array else F.col("__v").alias(kinds[i + 1].label)]
            grouped = F.sort_array(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in d.columns), *below)))
            grouped = F.struct(grouped.alias(d.label)) if i else grouped
        else:
            grouped = F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("key"), F.col("__v").alias("value")))))
        df = df.groupBy(*(F.col(f"`{c}`") for c in outer)).agg(grouped.alias("__v"))
    return df.select(F.to_json("__v").alias("json"))
