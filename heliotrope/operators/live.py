"""Live log pipelines: conditions, extraction, masking, metrics and routing over records with a map `fields`.

A record takes the first pipeline whose condition it meets; every stage is a column expression, so the same pipeline runs
on tables and streams. Extracted fields serve later stages and metrics and are not kept; masks change the record itself.
All pipelines are one pass over the records: a stage changes the columns of its own pipeline's records, routes set columns
rather than part the table, and the points of all metrics of a record are one array.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|(!=|>=|<=|=~|[=<>(),])|([\w.\-\[\]"/:+*%]+))')


class ConditionError(ValueError):
    pass


def _own(name: str) -> str:
    """The column of an extracted field."""
    return f"_field_{name}"


def value_of(name: str, fields: set[str] | None = None) -> Column:
    """A field by name: body, severity, service, attributes.k, resource.k, else an extracted field or attribute. Extracted
    fields are columns, those named in fields, or entries of a map `fields`."""
    name = re.sub(r'^(attributes|resource)\["?([^"\]]+)"?\]$', r"\1.\2", name)
    at = lambda m, k: F.element_at(m, F.lit(k))
    if name in ("body", "severity_text"):
        return F.col(name)
    if name == "severity":
        return F.col("severity_text")
    if name == "severity_number":
        return F.col(name).cast("string")
    if name in ("service", "service.name"):
        return at("resource", "service.name")
    if name.startswith("attributes."):
        return at("attributes", name[11:])
    if name.startswith("resource."):
        return at("resource", name[9:])
    own = [at("fields", name)] if fields is None else [F.col(f"`{_own(name)}`")] if name in fields else []
    return F.coalesce(*own, at("attributes", name), at("resource", name))


def condition(text: str, fields: set[str] | None = None) -> Column:
    """A condition as a Column. OR binds tighter than AND; an absent field meets != alone."""
    toks, i = [], 0
    while i < len(text.rstrip()):
        m = _TOKEN.match(text, i)
        if not m:
            raise ConditionError(f"unexpected {text[i:i + 10]!r}")
        toks.append(("str", m[1]) if m[1] is not None else ("op", m[2]) if m[2] else ("word", m[3]))
        i = m.end()
    at = 0

    def word() -> str:
        return toks[at][1].lower() if at < len(toks) and toks[at][0] != "str" else ""

    def take(w: str) -> bool:
        nonlocal at
        if word() == w:
            at += 1
            return True
        return False

    def literal() -> str:
        nonlocal at
        if at >= len(toks):
            raise ConditionError("the condition ends too early")
        at += 1
        return toks[at - 1][1]

    def both() -> Column:
        out = either()
        while take("and"):
            out = out & either()
        return out

    def either() -> Column:
        out = unary()
        while take("or"):
            out = out | unary()
        return out

    def unary() -> Column:
        if take("not"):
            return ~unary()
        if take("("):
            out = both()
            if not take(")"):
                raise ConditionError("expected )")
            return out
        return F.coalesce(compare(), F.lit(False))

    def compare() -> Column:
        got = value_of(literal(), fields)
        n = got.try_cast("double")
        for op, fn in ((">=", lambda x: n >= x), ("<=", lambda x: n <= x), (">", lambda x: n > x), ("<", lambda x: n < x)):
            if take(op):
                return fn(float(literal()))
        if take("exists"):
            return got.isNotNull()
        if take("="):
            return got == literal()
        if take("!="):
            return F.coalesce(got != literal(), F.lit(True))
        if take("contains"):
            return F.contains(got, F.lit(literal()))
        if take("matches") or take("=~"):
            return got.rlike(literal())
        if take("between"):
            low = float(literal())
            if not take("and"):
                raise ConditionError("between takes two values")
            return n.between(low, float(literal()))
        if take("in"):
            take("(")
            out = [literal()]
            while take(","):
                out.append(literal())
            if not take(")"):
                raise ConditionError("expected )")
            return got.isin(out)
        raise ConditionError("a comparison lacks its operator")

    out = both()
    if at < len(toks):
        raise ConditionError(f"unexpected {toks[at][1]!r}")
    return out


@dataclass
class Extract:
    """Named groups of a regular expression over a field become fields; without a match the record stays or goes."""

    regex: str
    source: str = "body"
    keep: bool = True


@dataclass
class AddFields:
    fields: dict[str, str]


@dataclass
class Cast:
    name: str
    to: str  # integer or float


@dataclass
class Mask:
    regex: str
    replacement: str
    on: tuple[str, ...] = ("body",)  # body, attributes, resource


@dataclass
class Metric:
    """A point for each record: value from a field or constant:n, labels from the dimensions that are there. kind is gauge,
    counter or histogram; a histogram is one observation, which counts 1 in the first of its bounds that holds it."""

    name: str
    value: str = "constant:1"
    dimensions: tuple[str, ...] = ()
    when: str | None = None
    kind: str = "gauge"
    bounds: tuple[float, ...] = ()


@dataclass
class Route:
    """Records that meet the condition are dropped, or leave the pipeline under a destination."""

    when: str
    to: str | None = None


@dataclass
class Pipeline:
    name: str
    when: str = "severity_number >= 0"
    steps: list = field(default_factory=list)


def _empty() -> Column:
    return F.from_json(F.lit("{}"), "map<string,string>")


def run(logs: DataFrame, pipelines: list[Pipeline]) -> tuple[DataFrame, DataFrame | None]:
    """(records, points): records without fields and with `pipeline` and `destination`; points (metric_name, labels, ts_ns,
    value, kind, counts, bounds) of all Metric steps, None if there are none."""
    names = logs.columns
    df, fields = logs.withColumn("pipeline", F.lit(None).cast("string")), set()
    for p in reversed(pipelines):
        df = df.withColumn("pipeline", F.when(condition(p.when, fields), p.name).otherwise(F.col("pipeline")))
    df = df.withColumn("destination", F.lit(None).cast("string")).withColumn("_gone", F.lit(False))
    for p in pipelines:
        for s in p.steps:
            # records that this pipeline still has
            mine = F.coalesce(F.col("pipeline") == p.name, F.lit(False)) & ~F.col("_gone") & F.col("destination").isNull()
            df = _step(df, s, mine, fields)
    out = df.where(~F.col("_gone")).select(*names, "pipeline", "destination")
    made = [c for c in df.columns if c.startswith("_point_")]
    if not made:
        return out, None
    points = df.select("ts_ns", F.explode(F.array(*made)).alias("p")).where("p is not null").select("p.metric_name", "p.labels", "ts_ns", "p.value", "p.kind", "p.counts", "p.bounds")
    return out, points


def _step(df: DataFrame, s, mine: Column, fields: set[str]) -> DataFrame:
    """df after a step over the records that are mine; fields: the extracted fields so far, which are columns."""
    set_ = lambda df, name, cond, new: df.withColumn(name, F.when(cond, new).otherwise(F.col(f"`{name}`")))

    def put(df: DataFrame, name: str, cond: Column, new: Column) -> DataFrame:
        if name not in fields:
            fields.add(name)
            return df.withColumn(_own(name), F.when(cond, new))
        return set_(df, _own(name), cond, new)

    if isinstance(s, Extract):
        groups = re.compile(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", s.regex)).groupindex
        plain = re.sub(r"\(\?P?<(\w+)>", "(", s.regex)
        src = value_of(s.source, fields)
        df = df.withColumn("_mine", mine).withColumn("_src", src).withColumn("_hit", F.col("_mine") & F.coalesce(F.col("_src").rlike(plain), F.lit(False)))
        for name, i in groups.items():
            df = put(df, name, F.col("_hit"), F.regexp_extract("_src", plain, i))
        if not s.keep:
            df = df.withColumn("_gone", F.col("_gone") | (F.col("_mine") & ~F.col("_hit")))
        return df.drop("_mine", "_src", "_hit")
    if isinstance(s, AddFields):
        df = df.withColumn("_mine", mine)
        for name, v in s.fields.items():
            df = put(df, name, F.col("_mine"), F.lit(v))
        return df.drop("_mine")
    if isinstance(s, Cast):
        if s.name not in fields:
            return df
        old = F.col(f"`{_own(s.name)}`")
        new = old.try_cast("double").cast("string") if s.to == "float" else old.try_cast("double").try_cast("long").cast("string")
        return put(df, s.name, mine, F.coalesce(new, old))
    if isinstance(s, Mask):
        masked = lambda v: F.regexp_replace(v, F.lit(s.regex), F.lit(s.replacement))
        df = df.withColumn("_mine", mine)
        for c in ("body", "attributes", "resource"):
            if c in s.on:
                df = set_(df, c, F.col("_mine"), masked(F.col(c)) if c == "body" else F.transform_values(c, lambda k, v: masked(v)))
        for name in sorted(fields):
            df = put(df, name, F.col("_mine"), masked(F.col(f"`{_own(name)}`")))
        return df.drop("_mine")
    if isinstance(s, Metric):
        value = F.lit(float(s.value[9:])) if s.value.startswith("constant:") else value_of(s.value, fields).try_cast("double")
        labels = _empty()
        if s.dimensions:
            pairs = F.array(*[F.struct(F.lit(d).alias("k"), value_of(d, fields).alias("v")) for d in s.dimensions])
            labels = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
        counts, bounds = F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<double>")
        if s.kind == "histogram":
            edges = [*sorted(s.bounds), float("inf")]
            counts = F.array(*[((value <= e) & (value > (edges[i - 1] if i else float("-inf")))).cast("bigint") for i, e in enumerate(edges)])
            bounds = F.array(*[F.lit(float(e)) for e in edges[:-1]]).cast("array<double>")
        elif s.kind not in ("gauge", "counter"):
            raise ValueError(f"unknown kind {s.kind!r}")
        point = F.struct(F.lit(s.name).alias("metric_name"), labels.alias("labels"), value.alias("value"), F.lit(s.kind).alias("kind"), counts.alias("counts"), bounds.alias("bounds"))
        when = mine & condition(s.when, fields) if s.when else mine
        return df.withColumn(f"_point_{sum(c.startswith('_point_') for c in df.columns)}", F.when(when & value.isNotNull(), point))
    if isinstance(s, Route):
        df = df.withColumn("_hit", mine & condition(s.when, fields))
        if s.to:
            df = df.withColumn("destination", F.when(F.col("_hit"), s.to).otherwise(F.col("destination")))
        else:
            df = df.withColumn("_gone", F.col("_gone") | F.col("_hit"))
        return df.drop("_hit")
    raise TypeError(f"unknown step {s!r}")


def render(template: str, labels: Column) -> Column:
    """A template with {{ labels.k }} or {{ k }} as the label's value, or nothing where it is absent."""
    parts, end = [], 0
    for m in re.finditer(r"\{\{\s*(?:labels\.)?([\w.]+)\s*\}\}", template):
        parts += [F.lit(template[end : m.start()]), F.coalesce(F.element_at(labels, F.lit(m[1])), F.lit(""))]
        end = m.end()
    return F.concat(*parts, F.lit(template[end:]))


def prepared(records: DataFrame) -> DataFrame:
    """Records whose time and severity are there: a missing or zero time is the present one, a missing severity INFO."""
    now = F.unix_micros(F.current_timestamp()) * 1000
    number = F.coalesce("severity_number", F.lit(9))
    return records.withColumn("ts_ns", F.when(F.coalesce("ts_ns", F.lit(0)) > 0, F.col("ts_ns")).otherwise(now)).withColumn("severity_number", number).withColumn("severity_text", F.coalesce("severity_text", F.lit("INFO")))
