"""Connected components by randomised contraction: every round maps each node to the neighbour (or itself) whose
hash under the round's seed is smallest, so that a constant share of the nodes is expected to go, whatever the order
of the ids (chains and stars alike). All steps are joins and combinable minima; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge between different nodes; component is the smallest node reachable.

    Null ends, loops and repeated edges change nothing. No edges: no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = written(e.union(e.select("b", "a")).distinct(), "edges")
    maps, seed = [], 0
    while not e.isEmpty():
        seed += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        near = e.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), "m")["n"].alias("to"))
        near = written(near, "near")
        left, right = near.select(F.col("node").alias("a"), F.col("to").alias("x")), near.select(F.col("node").alias("b"), F.col("to").alias("y"))
        nxt = written(e.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        dropped(e)
        e = nxt
        maps.append(near)
    dropped(e)
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    at = maps[0].select("node", F.col("to").alias("at"))
    for m in maps[1:]:
        at = at.join(m.select(F.col("node").alias("at"), "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    at = written(at, "roots")
    for m in maps:
        dropped(m)
    least = at.groupBy("at").agg(F.min("node").alias("component"))
    return at.join(least, "at").select("node", "component")
