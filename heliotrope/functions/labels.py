"""Label sets: maps of strings with a canonical text that serves as the series' key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_key(labels: Column) -> Column:
    """The sorted JSON text of a label set: equal sets have equal keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def read_key(key: Column) -> Column:
    """The label set of a key."""
    return F.from_json(key, "map<string,string>")


def keep(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: k.isin(names)) if names else F.map_filter(labels, lambda k, v: F.lit(False))


def drop(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.isin([*names, "__name__"]))


def with_label(labels: Column, name: str, value: Column) -> Column:
    """labels with name set to value; an empty value removes it."""
    rest = F.map_filter(labels, lambda k, v: k != name)
    return F.when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def empty_labels() -> Column:
    return F.from_json(F.lit("{}"), "map<string,string>")
