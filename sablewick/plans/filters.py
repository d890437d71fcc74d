"""Search filter expressions to column expressions.

The language: ``field in ['a', 'b']``, ``not in``, comparisons
(``== != < <= > >=``) with strings, numbers and booleans, ``like 'x%'``,
``and``/``or``/``not`` (also ``&& || !``) and parentheses.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = {"relativePath": "relative_path", "fileExtension": "file_extension", "startLine": "start_line", "endLine": "end_line"}
LEX = re.compile(r"""\s*(?:(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<num>-?\d+(?:\.\d+)?)|(?P<op>==|!=|<=|>=|&&|\|\||[<>()\[\],!])|(?P<word>[A-Za-z_][\w.]*))""")


class FilterError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = LEX.match(text, at)
            if not m:
                raise FilterError(f"cannot read filter at {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, token = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return token.lower() if kind == "word" else token if kind == "op" else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, *wanted: str) -> None:
        if not self.take(*wanted):
            raise FilterError(f"expected {' or '.join(wanted)}")

    def either(self) -> Column:
        left = self.both()
        while self.take("or", "||"):
            left = left | self.both()
        return left

    def both(self) -> Column:
        left = self.one()
        while self.take("and", "&&"):
            left = left & self.one()
        return left

    def one(self) -> Column:
        if self.take("not", "!"):
            return ~self.one()
        if self.take("("):
            inside = self.either()
            self.need(")")
            return inside
        column = F.col(self.name())
        if self.take("not"):
            self.need("in")
            return ~column.isin(self.values())
        if self.take("in"):
            return column.isin(self.values())
        if self.take("like"):
            return column.like(self.value())
        op = self.peek()
        if op not in ("==", "!=", "<", "<=", ">", ">="):
            raise FilterError("expected a comparison")
        self.at += 1
        other = F.lit(self.value())
        return {"==": column == other, "!=": column != other, "<": column < other, "<=": column <= other, ">": column > other, ">=": column >= other}[op]

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise FilterError("expected a field name")
        self.at += 1
        word = self.tokens[self.at - 1][1]
        return NAMES.get(word, word)

    def values(self) -> list:
        self.need("[")
        out = []
        while not self.take("]"):
            out.append(self.value())
            if self.peek() != "]":
                self.need(",")
        return out

    def value(self):
        if self.at >= len(self.tokens):
            raise FilterError("expected a value")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", token[1:-1])
        if kind == "num":
            return float(token) if "." in token else int(token)
        if kind == "word" and token.lower() in ("true", "false"):
            return token.lower() == "true"
        raise FilterError(f"expected a value, not {token!r}")


def parse_filter(text: str | None) -> Column | None:
    """The column expression of a filter; None for no filter."""
    if text is None or not text.strip():
        return None
    parser = _Parser(text)
    found = parser.either()
    if parser.at != len(parser.tokens):
        raise FilterError(f"unexpected {parser.tokens[parser.at][1]!r}")
    return found
