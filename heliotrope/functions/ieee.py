"""Arithmetic with IEEE results where ANSI SQL would stop: division by zero gives infinities and NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def modulo(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF), F.lit(NAN)).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


OPS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": lambda a, b: F.pow(a, b), "atan2": lambda a, b: F.atan2(a, b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
}
COMPARE = {"==", "!=", ">", "<", ">=", "<="}
