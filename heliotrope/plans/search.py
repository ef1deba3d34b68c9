"""The search grammar of logs, spans and pipeline rows, compiled to one Column predicate.

OR binds weaker than AND (written or not), AND weaker than NOT; clauses are terms, "phrases", wild*cards, -negations,
field operators, ranges f:[a..b], existence f:* and severity ranks. A query that cannot be read becomes its words.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The severity number at which each level begins.
RANKS = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "WARNING": 13, "ERROR": 17, "SEVERE": 17, "FATAL": 17}
_TOKEN = re.compile(r'\s*(?:(?P<par>[()])|(?P<clause>-?(?:[\w.@/*%]+\s*(?:=~|!=|>=|<=|==|[=:<>])\s*)?(?:"[^"]*"|\[[^\]]*\]|[^\s()"]+)))')
_FIELD = re.compile(r'([\w.@/]+)\s*(=~|!=|>=|<=|==|[=:<>])\s*(.*)', re.S)
_RANGE = re.compile(r"\[?(\d+(?:\.\d+)?)(?:\.\.|-)(\d+(?:\.\d+)?)\]?")


class SearchError(ValueError):
    pass


@dataclass
class Target:
    """How a kind of row answers: text(needle) and like(regex) for terms, field(name) as text, number(name) as double."""

    text: Callable[[str], Column]
    like: Callable[[str], Column]
    field: Callable[[str], Column]
    number: Callable[[str], Column]
    severity: Column | None
    fold: bool = True


def tokens(query: str) -> list[str]:
    out, i, query = [], 0, query.strip()
    while i < len(query):
        m = _TOKEN.match(query, i)
        if not m:
            raise SearchError(f"unexpected {query[i:i + 10]!r}")
        out.append(m.group(m.lastgroup))
        i = m.end()
    return out


def parse(query: str):
    """('or' | 'and', [nodes]), ('not', node) or ('clause', text)."""
    toks, i = tokens(query), 0

    def peek() -> str:
        return toks[i].upper() if i < len(toks) else ""

    def any_of():
        nonlocal i
        out = [all_of()]
        while peek() == "OR":
            i += 1
            out.append(all_of())
        return out[0] if len(out) == 1 else ("or", out)

    def all_of():
        nonlocal i
        out = [one()]
        while peek() not in ("", "OR", ")"):
            if peek() == "AND":
                i += 1
            out.append(one())
        return out[0] if len(out) == 1 else ("and", out)

    def one():
        nonlocal i
        if not peek():
            raise SearchError("the query ends too early")
        if peek() == "NOT":
            i += 1
            return ("not", one())
        tok = toks[i]
        i += 1
        if tok == "(":
            inner = any_of()
            if peek() != ")":
                raise SearchError("expected )")
            i += 1
            return inner
        if tok == ")":
            raise SearchError("unexpected )")
        return ("not", ("clause", tok[1:])) if tok[0] == "-" and len(tok) > 1 else ("clause", tok)

    if not toks:
        return ("and", [])
    node = any_of()
    if i < len(toks):
        raise SearchError(f"unexpected {toks[i]!r}")
    return node


def _wild(text: str) -> str:
    return ".*".join(re.escape(p) for p in text.split("*"))


def _regex(text: str) -> str | None:
    try:
        re.compile(text)
    except re.error:
        return None
    return text


def clause(text: str, t: Target) -> Column:
    m = _FIELD.fullmatch(text) if text[:1] != '"' else None
    if not m:
        term = text.strip('"')
        if "*" in term and text[:1] != '"':
            return t.like("(?i)" + _wild(term.strip("*")))
        return t.text(term.lower())
    name, op, value = m[1], m[2], m[3].strip()
    quoted, value = value[:1] == '"', value.strip('"')
    got = t.field(name)
    if name in ("severity", "level") and value.upper() in RANKS and op != "=~":
        rank, s = RANKS[value.upper()], t.severity if t.severity is not None else F.lit(None).cast("int")
        return {"<": s < rank, "<=": s <= rank, ">": s > rank, "!=": s < rank}.get(op, s >= rank)
    if op == "=~":
        return got.rlike(value) if _regex(value) is not None else F.lit(False)
    if op in (">", ">=", "<", "<="):
        try:
            n, x = float(value), t.number(name)
        except ValueError:
            return F.lit(False)
        return {">": x > n, ">=": x >= n, "<": x < n, "<=": x <= n}[op]
    if value in ("", "*") and not quoted and op in (":", "="):
        return got.isNotNull()
    if op in (":", "=") and not quoted and (r := _RANGE.fullmatch(value)):
        return t.number(name).between(float(r[1]), float(r[2]))
    if name == "body" and op != "!=":
        return t.text(value.lower())
    if "*" in value and not quoted:
        same = got.rlike(f"^{_wild(value)}$")
    else:
        same = F.lower(got) == value.lower() if t.fold else got == value
    return F.coalesce(~same, F.lit(True)) if op == "!=" else same


_SELECTOR = re.compile(r'\s*([\w.]+)\s*(!=|=~|!~|=)\s*"((?:[^"\\]|\\.)*)"\s*')


def selector(text: str, t: Target) -> Column:
    """A selector {name="value", ...} of logs: all matchers hold; expressions match whole values, absent fields are empty."""
    body, at, out = text.strip()[1:-1], 0, F.lit(True)
    while body[at:].strip():
        m = _SELECTOR.match(body, at)
        if not m or (m.end() < len(body) and body[m.end()] != ","):
            raise SearchError(f"bad selector {text!r}")
        got, value = F.coalesce(t.field(m[1]), F.lit("")), re.sub(r"\\(.)", r"\1", m[3])
        same = got == value if m[2] in ("=", "!=") else got.rlike(f"^(?:{value})$")
        out = out & (~same if m[2][0] == "!" else same)
        at = m.end() + 1
    return out


def compile_search(query: str, t: Target, lenient: bool = True) -> Column:
    if re.fullmatch(r"\s*\{.*\}\s*", query, re.S):
        return selector(query, t)
    try:
        node = parse(query)
    except SearchError:
        if not lenient:
            raise
        node = ("and", [("clause", f'"{w}"') for w in query.replace('"', " ").split()])

    def column(n) -> Column:
        kind, inner = n
        if kind == "clause":
            return F.coalesce(clause(inner, t), F.lit(False))
        if kind == "not":
            return ~column(inner)
        out = F.lit(kind == "and")
        for k, x in enumerate(inner):
            out = column(x) if not k else (out & column(x)) if kind == "and" else (out | column(x))
        return out

    return column(node)


def log_target() -> Target:
    body, at = F.col("body"), lambda m, k: F.element_at(m, F.lit(k))

    def field(name: str) -> Column:
        if name in ("body", "severity_text", "trace_id", "span_id"):
            return F.col(name)
        if name in ("severity", "level"):
            return F.col("severity_text")
        if name == "severity_number":
            return F.col(name).cast("string")
        if name in ("service", "service.name", "service_name"):
            return at("resource", "service.name")
        if name[:5] == "attr.":
            spelt = F.map_filter("attributes", lambda k, v: F.replace(k, F.lit("."), F.lit("_")) == name[5:])
            return F.coalesce(at("attributes", name[5:]), F.get(F.map_values(spelt), F.lit(0)))
        if name[:4] == "res.":
            return at("resource", name[4:])
        return F.coalesce(at("attributes", name), at("resource", name))

    return Target(lambda s: F.contains(F.lower(body), F.lit(s)), lambda r: body.rlike(r), field, lambda n: field(n).try_cast("double"), F.col("severity_number"), fold=False)


def span_target() -> Target:
    values = F.map_values("attributes")
    duration = (F.col("end_ns") - F.col("start_ns")) / 1e6

    def field(name: str) -> Column:
        if name in ("service", "service.name", "trace_id", "span_id"):
            return F.col(name.split(".")[0])
        if name in ("name", "operation"):
            return F.col("name")
        if name == "status":
            return F.when(F.col("status") == 2, "ERROR").when(F.col("status") == 1, "OK").otherwise("UNSET")
        if name == "kind":
            return F.element_at(F.array(*[F.lit(x) for x in ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")]), (F.col("kind") + 1).cast("int"))
        return F.element_at("attributes", F.lit(name.removeprefix("attr.")))

    number = lambda n: duration if n in ("duration", "duration_ms") else field(n).try_cast("double")
    text = lambda s: F.contains(F.lower("name"), F.lit(s)) | F.exists(values, lambda v: F.contains(F.lower(v), F.lit(s)))
    return Target(text, lambda r: F.col("name").rlike(r) | F.exists(values, lambda v: v.rlike(r)), field, number, None)


def row_target(columns: list[str]) -> Target:
    """Pipeline rows: named columns and a map `fields` of all else."""

    def field(name: str) -> Column:
        for n in (name, name.removeprefix("attr.")):
            if n in columns and n != "fields":
                return F.col(f"`{n}`").cast("string")
        return F.element_at("fields", F.lit(name.removeprefix("attr."))) if "fields" in columns else F.lit(None).cast("string")

    severity = F.col("severity_number") if "severity_number" in columns else None
    return Target(lambda s: F.contains(F.lower(field("body")), F.lit(s)), lambda r: field("body").rlike(r), field, lambda n: field(n).try_cast("double"), severity)
