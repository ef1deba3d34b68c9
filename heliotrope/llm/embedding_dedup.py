"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

Each unit vector o is rotated at random; its code is the signs x of the rotated components, one bit each, its correction
factor a = <o, x / sqrt(D)>. Codes and factors are computed once and stored beside the vectors. For another unit vector q
with s = <q, x / sqrt(D)>, s / a is an unbiased estimate of <o, q> over the rotations, and <o, q> lies within
a s +- sqrt(1 - a^2) sqrt(1 - s^2), as both are angles to one code. That interval holds always, not just with some
probability, and is as narrow for near pairs as one of six standard errors would be; so the confidence is taken to be 1 and
no link is lost. Its upper end reaches the threshold t just if the estimate is at least cos(acos a + acos t) / a, a number
of each code; only the pairs whose estimate does are computed again, in double precision.

Equal vectors of a label are one row with a weight. Labels are cut into blocks of BLOCK distinct vectors; block pairs
are dealt out as tasks of their own, so a label with a third of all rows is spread over its block pairs. A block pair
returns counts and a spanning forest of its links, never its pairs. The work is quadratic in the vectors of a label, as
in a space of many dimensions no bound that holds always rules out most of a label's blocks; it is one matrix product of
codes and vectors a block pair.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
nothing (n_links 0, component: their own id); vectors of one label with different lengths never link; repeated rows
with the same id count as vectors of their own; rows with a null id get n_links and a null component unless they link
to one with an id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._shared import dropped, lean, narrow_batches, written

#: Distinct vectors in a block, and those compared at a time in a task.
BLOCK, STEP = 4096, 1024
#: What rounding may take from an estimate in single precision.
SLACK = 1e-4


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(unit: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and their correction factors."""
    turned = unit @ rot.T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def estimates(code: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of encoded unit vectors (rows) with rotated ones (columns)."""
    d = turned.shape[1]
    signs = np.unpackbits(code, axis=1, count=d).astype(np.float32) * np.float32(2) - np.float32(1)
    return (signs * (1 / (factor * np.sqrt(d)))[:, None].astype(np.float32)) @ turned.T


def least_estimates(factor: np.ndarray, threshold: float) -> np.ndarray:
    """The estimate from which on the upper bound of an encoded vector's product reaches the threshold."""
    a = np.clip(factor, 0, 1)
    return np.cos(np.minimum(np.pi, np.arccos(a) + np.arccos(threshold))) / a - SLACK / a


def pairs(unit_x, code_x, factor_x, unit_y, turned_y, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with a product at the threshold or above: estimates choose, exact products decide."""
    near = estimates(code_x, factor_x, turned_y) >= least_estimates(factor_x, threshold)[:, None].astype(np.float32)
    i, j = np.nonzero(near)
    parts = [np.einsum("ij,ij->i", unit_x[i[k : k + 65536]], unit_y[j[k : k + 65536]]) for k in range(0, len(i), 65536)]
    ok = np.concatenate(parts or [np.zeros(0)]) >= threshold
    return i[ok], j[ok]


def merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (each place's smallest known neighbour, itself a root) after the links (i, j): least roots spread until all
    linked places agree."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not (root[root] == root).all():
            root = root[root]
    return root


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) per row of df."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    narrow_batches(df.sparkSession)
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    fine = F.coalesce(F.col("label").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine)
    # one node for equal vectors of a label; adding 0.0 makes -0.0 equal to 0.0
    keyed = rows.where("fine").withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    keyed = keyed.withColumn("key", F.sha2(F.to_json(F.struct("label", "v")), 256))
    nodes = keyed.groupBy("key").agg(F.min("id").alias("own"), F.count(F.lit(1)).alias("w"), F.first("label").alias("label"), F.first("v").alias("v"))
    node_id = F.coalesce("own", F.expr("-4611686018427387904 + pmod(xxhash64(key), 4611686018427387904)"))
    nodes = nodes.withColumn("node", node_id).withColumn("d", F.size("v"))

    @lean
    def coded(batches):
        for b in batches:
            for d, g in b.groupby("d", sort=False):
                unit = unit_rows(np.array(g.v.tolist(), dtype=np.float64))
                code, factor = encode(unit, rotation(d))
                yield g.drop(columns="v").assign(unit=[u.tobytes() for u in unit], code=[c.tobytes() for c in code], factor=factor)

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    names = ["key", "node", "own", "w", "label", "d"]
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", unit binary, code binary, factor double"
    nodes = nodes.select(*names, "v").mapInPandas(lambda b: (x[[*names, "unit", "code", "factor"]] for x in coded(b)), schema)
    nodes = written(nodes, "vectors")
    sizes = nodes.groupBy("label", "d").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    part = nodes.join(sizes, ["label", "d"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # each vector goes once to every pair of blocks that holds its own
    sent = part.select("label", "d", "node", "w", "unit", "code", "factor", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    sent = sent.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        n, d = len(pdf), int(pdf.d.iat[0])
        unit = np.frombuffer(b"".join(pdf.unit), dtype=np.float64).reshape(n, d)
        code = np.frombuffer(b"".join(pdf.code), dtype=np.uint8).reshape(n, -1)
        factor, nodes, w = pdf.factor.to_numpy(), pdf.node.to_numpy(), pdf.w.to_numpy()
        turned = (unit @ rotation(d).T).astype(np.float32)
        lo, hi = pdf.lo.iat[0], pdf.hi.iat[0]
        left, right = np.flatnonzero(pdf.block == lo), np.flatnonzero(pdf.block == hi)
        links, root = np.zeros(n, dtype=np.int64), np.arange(n)
        for p in range(0, len(left), STEP):
            x = left[p : p + STEP]
            for q in range(p if lo == hi else 0, len(right), STEP):
                y = right[q : q + STEP]
                i, j = pairs(unit[x], code[x], factor[x], unit[y], turned[y], threshold)
                i, j = x[i], y[j]
                if lo == hi and p == q:
                    i, j = i[i < j], j[i < j]
                links += np.bincount(i, weights=w[j], minlength=n).astype(np.int64) + np.bincount(j, weights=w[i], minlength=n).astype(np.int64)
                root = merged(root, i, j)
        hit, far = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
        zero = lambda k: np.zeros(k, dtype=np.int64)
        return pd.DataFrame({"a": np.concatenate([nodes[hit], nodes[far]]), "b": np.concatenate([zero(len(hit)), nodes[root[far]]]), "n": np.concatenate([links[hit], zero(len(far))])})

    found = written(sent.groupBy("label", "d", "lo", "hi").applyInPandas(compare, "a long, b long, n long"), "found")
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "node")
    groups = components(found.where("n = 0"))
    named = groups.join(nodes.select("node", "own"), "node").groupBy("component").agg(F.min("own").alias("least"))
    per = nodes.select("key", "node", "own", "w").join(counts, "node", "left").join(groups, "node", "left").join(named, "component", "left")
    per = per.select("key", (F.coalesce("others", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.when(F.col("component").isNull(), F.col("own")).otherwise(F.col("least")).alias("component_id"))
    out = keyed.select("id", "key").join(per, "key").select("id", "n_links", "component_id")
    out = out.union(rows.where("not fine").select("id", F.lit(0).cast("long"), "id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


#: Over the whole table; the driver's rows have few links, so the recursion ends soon.
OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), g AS (
  SELECT vec_id, label, e, len(e) AS d, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r AS (
  SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.t
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links,
  (SELECT min(t) FROM r WHERE r.s = v.vec_id) AS component_id,
  v.vec_id = (SELECT min(t) FROM r WHERE r.s = v.vec_id) AS kept
FROM v
"""
