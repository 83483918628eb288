"""Lexer and parser of the query language.

A document is a list of operations; an operation holds fields; a field has an alias, a name,
arguments, directives and, unless it is a leaf, a selection of fields. Commas are white space and
``#`` begins a comment. Fragments, subscriptions and variable values are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

TOKEN = re.compile(
    r"""(?P<skip>[\s,﻿]+|\#[^\n]*)
      | (?P<block>\"\"\".*?\"\"\")
      | (?P<string>"(?:\\.|[^"\\\n])*")
      | (?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      | (?P<spread>\.\.\.)
      | (?P<name>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<mark>[{}()\[\]:=@$!|&])""",
    re.X | re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "\\": "\\", "/": "/"}


class QueryError(ValueError):
    """The text isn't a document, or asks for something that has no meaning."""


@dataclass(frozen=True)
class Directive:
    name: str
    args: dict[str, Any]


@dataclass(frozen=True)
class Field:
    name: str
    alias: str | None = None
    args: dict[str, Any] = field(default_factory=dict)
    directives: tuple[Directive, ...] = ()
    fields: tuple[Field, ...] | None = None

    @property
    def label(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Operation:
    kind: str
    name: str | None
    source: str | None
    fields: tuple[Field, ...]


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                line = text.count("\n", 0, at) + 1
                raise QueryError(f"unexpected character {text[at]!r} in line {line}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at = 0

    def peek(self, mark: str | None = None) -> Any:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return value == mark and kind == "mark" if mark else (kind, value)

    def next(self, kind: str | None = None, value: str | None = None) -> str:
        k, v = self.peek()
        if k == "end" or kind and k != kind or value is not None and v != value:
            raise QueryError(f"expected {value or kind}, found {v or 'the end of the document'!r}")
        self.at += 1
        return v

    def document(self) -> list[Operation]:
        out = []
        while self.peek()[0] != "end":
            out.append(self.operation())
        if not out:
            raise QueryError("the document is empty")
        return out

    def operation(self) -> Operation:
        kind, name, source = "query", None, None
        if not self.peek("{"):
            kind = self.next("name")
            if kind not in ("query", "mutation"):
                raise QueryError(f"{kind} isn't supported: only query and mutation are")
            if self.peek()[0] == "name":
                name = self.next()
            if self.peek("("):
                self.next()
                while not self.peek(")"):
                    self.next("mark", "$")
                    variable = self.next("name")
                    self.next("mark", ":")
                    value = self.next("name")
                    if variable != "source":
                        raise QueryError(f"variable ${variable} isn't supported: only $source is")
                    source = value
                self.next()
        return Operation(kind, name, source, self.selection())

    def selection(self) -> tuple[Field, ...]:
        self.next("mark", "{")
        out = []
        while not self.peek("}"):
            if self.peek()[0] == "spread":
                raise QueryError("fragments aren't supported")
            out.append(self.field())
        self.next()
        return tuple(out)

    def field(self) -> Field:
        alias, name = None, self.next("name")
        if self.peek(":"):
            self.next()
            alias, name = name, self.next("name")
        args = self.arguments() if self.peek("(") else {}
        directives = []
        while self.peek("@"):
            self.next()
            directives.append(Directive(self.next("name"), self.arguments() if self.peek("(") else {}))
        return Field(name, alias, args, tuple(directives), self.selection() if self.peek("{") else None)

    def arguments(self) -> dict[str, Any]:
        self.next("mark", "(")
        return self.pairs(")")

    def pairs(self, end: str) -> dict[str, Any]:
        out = {}
        while not self.peek(end):
            key = self.next("name")
            self.next("mark", ":")
            out[key] = self.value()
        self.next()
        return out

    def value(self) -> Any:
        kind, text = self.peek()
        self.at += 1
        if kind == "number":
            return int(text) if re.fullmatch(r"-?\d+", text) else float(text)
        if kind == "block":
            return text[3:-3].strip("\n")
        if kind == "string":
            return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), text[1:-1])
        if kind == "name":
            if text == "null":
                raise QueryError("null isn't supported as a value")
            return {"true": True, "false": False}.get(text, text)
        if (kind, text) == ("mark", "["):
            out = []
            while not self.peek("]"):
                out.append(self.value())
            self.next()
            return out
        if (kind, text) == ("mark", "{"):
            return self.pairs("}")
        raise QueryError("variable values aren't supported" if text == "$" else f"expected a value, found {text or 'the end'!r}")


def parse(text: str) -> list[Operation]:
    return Parser(text).document()
