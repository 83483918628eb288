"""Name resolution: which physical column a name of a document means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import QueryError


@dataclass(frozen=True)
class Scope:
    """The rows that a level reads: ``df`` holds the columns of all joined tables under physical
    names; ``tables`` maps a table to its columns. The first table is the current one."""

    df: DataFrame
    table: str
    tables: dict[str, tuple[str, ...]]

    @staticmethod
    def of(df: DataFrame, table: str) -> Scope:
        return Scope(physical(df, table), table, {table: tuple(df.columns)})

    def find(self, name: str, table: str | None = None) -> str:
        """The physical name of ``name``; ``@name`` and table ``@`` mean the current table. A bare name
        is the current table's, else that of the only joined table that has it."""
        if name.startswith("@"):
            name, table = name[1:], table or self.table
        if table == "@":
            table = self.table
        if "." in name and table is None and name.split(".", 1)[0] in self.tables:
            table, name = name.split(".", 1)
        if table is not None:
            if table not in self.tables:
                raise QueryError(f"table {table!r} isn't part of this query: {', '.join(self.tables)}")
            if name not in self.tables[table]:
                raise QueryError(f"table {table!r} has no column {name!r}")
            return f"{table}__{name}"
        owners = [t for t, columns in self.tables.items() if name in columns]
        if self.table in owners:
            return f"{self.table}__{name}"
        if len(owners) == 1:
            return f"{owners[0]}__{name}"
        raise QueryError(f"column {name!r} is ambiguous: {', '.join(owners)}" if owners else f"no column {name!r} in {', '.join(self.tables)}")

    def col(self, name: str, table: str | None = None) -> Column:
        return F.col(f"`{self.find(name, table)}`")


def physical(df: DataFrame, table: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"{table}__{c}") for c in df.columns))
