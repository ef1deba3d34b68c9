"""Exact top-k inner-product search by norm buckets.

Vectors are grouped by length into BUCKETS quantile buckets. For a query q with k-th best score T so far, a vector of
a bucket with greatest length L can only enter if its cosine reaches T / (|q| L), the bucket's local threshold. From
that a bucket is left out (threshold above 1), pruned by length (|q||x| >= T, vectors sorted by length: where the
threshold asks little of the direction) or by coordinate (the query's largest coordinate bounds the cosine as
q'x' + sqrt(1 - q'^2) sqrt(1 - x'^2) on unit vectors: where it asks much), and the products left are verified.

Queries are cut into blocks, and so are buckets; a pair of blocks is a task's work and returns the k best of each
query, merged by a ranked window. First each query is run against the longest vectors to get T; then every block whose
local threshold is reachable is visited. The query set is named by the caller; it meets all rows in blocks.

Cases: vectors that are null, empty or hold null or non-finite components take no part, as query or candidate; vectors
of another dimension than the query are no candidates; ties go to the smaller id; rows repeated with the same id
are one candidate for others when equal, and are never candidates of their own id; fewer than k candidates: all; null
ids are left out; empty tables give no rows; other columns are ignored. Components of any size count as they are:
blocks whose products may pass int64 are computed in Python's integers, without pruning. Scores are long; one among
the best of a block that no long holds, or a component that scaling makes infinite, is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import join_checked, lean, narrow_batches, written

BUCKETS = 16
BLOCK = 8192
QUERIES = 256


def _pack(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its ids, lengths and vectors as two arrays."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows"), F.max("norm").alias("longest"))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > 4 * k + 64:
        keep = np.argpartition(-scores, k - 1)[:k]
        floor = scores[keep].min()
        pos = np.flatnonzero(scores >= floor)
    else:
        pos = np.arange(len(ids))
    return pos[np.lexsort((ids[pos], -scores[pos]))[:k]]


def block_search(qid, q, floor, cid, c, k: int):
    """(query, candidate, score) with the k best of each query among the candidates, pruned by the floors."""
    cn = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-cn, kind="stable")
    c, cid, cn = c[order], cid[order], cn[order]
    cf = c.astype(np.float64)
    unit = cf / np.where(cn > 0, cn, 1)[:, None]
    # each product and sum below 2^53 is exact in double precision, which is much faster than integers
    most = np.abs(cf).max(initial=0) * max(1.0, np.abs(q).max(initial=0)) * c.shape[1] if len(c) else 0.0
    if not most < 2**62:
        return _wide(qid, q, floor, cid, c, k)
    exact = most < 2**53
    whole = None if exact else c.astype(np.int64)
    out_q, out_c, out_s = [], [], []
    for n, x in enumerate(q):
        t = floor[n]
        own = np.sqrt((x.astype(np.float64) ** 2).sum())
        keep = np.arange(len(c))
        if t > 0:  # with a floor of 0 or less nothing can be pruned
            local = t / max(own * cn[0], 1e-300) if len(cn) else 2.0
            if local > 1 + 1e-9:
                continue
            end = np.searchsorted(-cn, -(t / own) * (1 - 1e-9), side="right")  # by length
            keep = keep[:end]
            if local > 0.5 and end:  # by coordinate
                f = int(np.argmax(np.abs(x)))
                qf = x[f] / own
                xf = unit[:end, f]
                bound = qf * xf + np.sqrt(max(0.0, 1 - qf * qf)) * np.sqrt(np.maximum(0.0, 1 - xf * xf))
                keep = np.flatnonzero(bound * own * cn[:end] >= t * (1 - 1e-9))
        s = (cf[keep] @ x.astype(np.float64)).astype(np.int64) if exact else whole[keep] @ x.astype(np.int64)
        ok = (s >= t) & (cid[keep] != qid[n])
        ids, s = cid[keep][ok], s[ok]
        b = _best(ids, s, k)
        out_q.append(np.full(len(b), qid[n]))
        out_c.append(ids[b])
        out_s.append(s[b])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return pd.DataFrame({"query_id": cat(out_q).astype(np.int64), "vec_id": cat(out_c).astype(np.int64), "score": cat(out_s).astype(np.int64)})


def _wide(qid, q, floor, cid, c, k: int):
    """block_search in Python's integers."""
    rows = [[int(v) for v in x] for x in c]
    out = []
    for n, x in enumerate([int(v) for v in x] for x in q):
        s = [(-sum(a * b for a, b in zip(x, y)), int(i)) for i, y in zip(cid, rows) if i != qid[n]]
        for neg, i in sorted(v for v in s if -v[0] >= int(floor[n]) or -v[0] < -(2**63))[:k]:
            if not -(2**63) <= -neg < 2**63:
                raise ValueError(f"the inner product of vectors {qid[n]} and {i} is beyond a long")
            out.append((int(qid[n]), i, -neg))
    return pd.DataFrame({name: np.array([r[m] for r in out], dtype=np.int64) for m, name in enumerate(("query_id", "vec_id", "score"))})


def _joined(q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """The k best of each query, over pairs of blocks: q has a row per query block and candidate block to visit."""

    @lean
    def search(batches):
        for b in batches:
            for qr, floors, cr in zip(b.queries, b.floors, b.rows):
                arr = lambda rows: (np.array([r["id"] for r in rows], dtype=np.int64), np.array([r["v"] for r in rows], dtype=np.float64))
                qi, qv = arr(qr)
                ci, cv = arr(cr)
                yield block_search(qi, qv, np.asarray(floors, dtype=np.int64), ci, cv, k)

    pairs = q.join(c, ["d", "bucket", "block"]).select("queries", "floors", "rows")
    found = pairs.mapInPandas(search, "query_id long, vec_id long, score long").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(df: DataFrame, query: str, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the greatest inner product of floor(scale * x) for each row of
    df that the SQL condition query names."""
    # whole numbers in double precision: floor gives a long, which holds all that have a fraction
    def whole(x):
        y = F.lit(float(scale)) * x.cast("double")
        y = F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y) + F.lit(0.0)
        return F.when(F.abs(y) == F.lit(float("inf")), F.raise_error(F.lit("a scaled component is infinite")).cast("double")).otherwise(y)

    narrow_batches(df.sparkSession)
    v = F.transform(F.col(vector), whole)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    fine = df.where(F.coalesce(F.col(id_col).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False)))
    rows = fine.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.expr(f"coalesce({query}, false)").alias("asks")).distinct()
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).withColumn("d", F.size("v"))
    rows = written(rows, "vectors")
    # BUCKETS quantiles of the length, and a count for each bucket: bounded by the parameter and the dimensions in use
    cuts = rows.groupBy("d").agg(F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("cuts"))
    cand = rows.join(cuts, "d").withColumn("bucket", F.size(F.filter("cuts", lambda c: c > F.col("norm")))).drop("cuts")
    sizes = cand.groupBy("d", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    sizes = written(sizes, "buckets")
    blocks = written(_pack(join_checked(cand, sizes.select("d", "bucket", "blocks"), ["d", "bucket"], "inner").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), ["d", "bucket", "block"]).drop("longest"), "blocks")
    asked = rows.where("asks")
    n = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)).cast("int"))
    # 1: a floor from one block of the longest vectors
    packed = asked.groupBy("d", "qb").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("queries"), F.max("norm").alias("norm"))
    packed = packed.withColumn("floors", F.transform("queries", lambda q: F.lit(-(2**63)).cast("long")))
    first = sizes.groupBy("d").agg(F.min_by(F.struct("bucket", "blocks"), "bucket").alias("f")).select("d", "f.bucket", "f.blocks")
    seeds = _joined(join_checked(packed, first, "d", "inner").withColumn("block", F.pmod(F.col("qb"), F.col("blocks"))).drop("blocks"), blocks, k)
    floors = written(seeds.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor")), "floors")
    # 2: every block of every bucket that the floor does not rule out
    asked = asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-(2**63))))
    packed = asked.groupBy("d", "qb").agg(F.sort_array(F.collect_list(F.struct("id", "v", "floor"))).alias("q"), F.min(F.when(F.col("norm") > 0, F.col("floor") / F.col("norm")).otherwise(F.when(F.col("floor") > 0, 1e300).otherwise(-1e300))).alias("need"))
    packed = packed.select("d", "qb", F.transform("q", lambda x: F.struct(x["id"].alias("id"), x["v"].alias("v"))).alias("queries"), F.transform("q", lambda x: x["floor"]).alias("floors"), "need")
    visits = join_checked(packed, sizes, "d", "inner").where(F.col("longest") * (1 + 1e-9) >= F.col("need"))
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("need", "longest", "n", "blocks")
    return _joined(visits, blocks, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0", k=5)


OP6_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
