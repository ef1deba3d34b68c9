"""A parser of the metric query language: selectors, ranges, sub-queries, offsets, calls, aggregations and operators."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

UNITS = {"ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 604800 * 10**9, "y": 31536000 * 10**9}
AGGREGATES = {"sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "topk", "bottomk", "quantile", "count_values"}
WITH_PARAM = {"topk", "bottomk", "quantile", "count_values"}
#: All operators are left-associative, the power operator included.
BINDING = {"or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, ">": 3, "<": 3, ">=": 3, "<=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "^": 6}


class ParseError(ValueError):
    pass


@dataclass
class Number:
    value: float


@dataclass
class Text:
    value: str


@dataclass
class Selector:
    name: str
    matchers: list[tuple[str, str, str]] = field(default_factory=list)
    offset: int = 0


@dataclass
class Range:
    inner: object
    range: int
    step: int | None = None
    offset: int = 0


@dataclass
class Call:
    name: str
    args: list


@dataclass
class Aggregate:
    op: str
    inner: object
    param: object = None
    by: list[str] | None = None
    without: list[str] | None = None


@dataclass
class Binary:
    op: str
    left: object
    right: object
    bool: bool = False
    on: list[str] | None = None
    ignoring: list[str] | None = None
    side: str | None = None
    extra: list[str] = field(default_factory=list)


_TOKEN = re.compile(r"""\s*(?:(?P<dur>\d+(?:ms|[smhdwy])(?:\d+(?:ms|[smhdwy]))*)(?![\w.])|(?P<num>0x[0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<id>[A-Za-z_][\w:.]*)|(?P<str>"[^"]*"|'[^']*'|`[^`]*`)|(?P<op>=~|!~|==|!=|>=|<=|[-+*/%^(){}\[\],=<>:@]))""")


def duration(text: str) -> int:
    """Nanoseconds of 5m, 1h30m, ...; a bare number is seconds."""
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return int(float(text) * 10**9)
    parts = re.findall(r"(\d+)(ms|[smhdwy])", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ParseError(f"bad duration {text!r}")
    return sum(int(n) * UNITS[u] for n, u in parts)


class _Parser:
    def __init__(self, text: str):
        self.toks, i = [], 0
        text = text.rstrip()
        while i < len(text):
            m = _TOKEN.match(text, i)
            if not m:
                raise ParseError(f"unexpected {text[i:i + 10]!r}")
            self.toks.append((m.lastgroup, m.group(m.lastgroup)))
            i = m.end()
        self.i = 0

    def peek(self, k: int = 0):
        return self.toks[self.i + k] if self.i + k < len(self.toks) else ("end", "")

    def next(self):
        t = self.peek()
        self.i += 1
        return t

    def take(self, value: str) -> bool:
        if self.peek()[1] == value and self.peek()[0] != "str":
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise ParseError(f"expected {value!r}, found {self.peek()[1]!r}")

    def names(self) -> list[str]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.next()[1])
            self.take(",")
        return out

    def expr(self, least: int = 0):
        left = self.unary()
        while True:
            op = self.peek()[1]
            if self.peek()[0] == "str" or op not in BINDING or BINDING[op] <= least:
                return left
            self.next()
            node = Binary(op, left, None)
            while self.peek()[0] == "id":
                w = self.peek()[1]
                if w == "bool":
                    self.next()
                    node.bool = True
                elif w in ("on", "ignoring") and self.peek(1)[1] == "(":
                    self.next()
                    setattr(node, w, self.names())
                elif w in ("group_left", "group_right"):
                    self.next()
                    node.side = w[6:]
                    node.extra = self.names() if self.peek()[1] == "(" else []
                else:
                    break
            node.right = self.expr(BINDING[op])
            left = node

    def unary(self):
        if self.take("-"):
            inner = self.unary()
            return Number(-inner.value) if isinstance(inner, Number) else Binary("-", Number(0.0), inner)
        if self.take("+"):
            return self.unary()
        return self.postfix(self.atom())

    def postfix(self, node):
        while True:
            if self.take("["):
                rng, step = duration(self.next()[1]), None
                if self.take(":"):
                    step = 0 if self.peek()[1] == "]" else duration(self.next()[1])
                self.need("]")
                node = Range(node, rng, step)
            elif self.peek() == ("id", "offset"):
                self.next()
                sign = -1 if self.take("-") else 1
                off = sign * duration(self.next()[1])
                if not isinstance(node, (Selector, Range)):
                    raise ParseError("offset needs a selector")
                node.offset += off
            elif self.peek()[1] == "@" and self.peek()[0] == "op":
                raise ParseError("the @ modifier is not supported")
            else:
                return node

    def atom(self):
        kind, v = self.next()
        if kind == "num":
            return Number(float(int(v, 16)) if v.startswith("0x") else float(v))
        if kind == "dur":
            return Number(duration(v) / 1e9)
        if kind == "str":
            return Text(v[1:-1])
        if v == "(" and kind == "op":
            e = self.expr()
            self.need(")")
            return e
        if v == "{" and kind == "op":
            self.i -= 1
            return self.selector("")
        if kind != "id":
            raise ParseError(f"unexpected {v or 'end'!r}")
        if v.lower() in ("nan", "inf"):
            return Number(float(v))
        if v in AGGREGATES and self.peek()[1] in ("(", "by", "without"):
            return self.aggregate(v)
        if self.take("("):
            args = []
            while not self.take(")"):
                args.append(self.expr())
                if not self.take(",") and self.peek()[1] != ")":
                    raise ParseError("expected , or )")
            return Call(v, args)
        return self.selector(v)

    def aggregate(self, op: str) -> Aggregate:
        by = without = None

        def grouping():
            nonlocal by, without
            while self.peek()[1] in ("by", "without") and self.peek()[0] == "id":
                if self.next()[1] == "by":
                    by = self.names()
                else:
                    without = self.names()

        grouping()
        self.need("(")
        args = [self.expr()]
        while self.take(","):
            args.append(self.expr())
        self.need(")")
        grouping()
        if len(args) != 1 + (op in WITH_PARAM):
            raise ParseError(f"{op} takes {1 + (op in WITH_PARAM)} arguments")
        return Aggregate(op, args[-1], args[0] if len(args) == 2 else None, by, without)

    def selector(self, name: str) -> Selector:
        out = []
        if self.take("{"):
            while not self.take("}"):
                label, op, (kind, v) = self.next()[1], self.next()[1], self.next()
                if op not in ("=", "!=", "=~", "!~"):
                    raise ParseError(f"bad matcher {op!r}")
                v = v[1:-1] if kind == "str" else v
                if label == "__name__" and op == "=" and not name:
                    name = v
                else:
                    out.append((label, op, v))
                if not self.take(",") and self.peek()[1] != "}":
                    raise ParseError("expected , or }")
        if not name and not out:
            raise ParseError("a selector needs a name or a matcher")
        return Selector(name, out)


def parse(text: str):
    p = _Parser(text)
    out = p.expr()
    if p.peek()[0] != "end":
        raise ParseError(f"unexpected {p.peek()[1]!r}")
    return out
