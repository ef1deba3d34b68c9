"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: whole texts, lower-cased in A-Z, words between ASCII white space, shingles of k words with repeats, a bit
set where over half of the shingles' XXH64 (seed 42) have it. Linking: the 64 bits are grouped so that correlated bits
share a partition (from the covariance over all fingerprints); a dynamic programme on candidate counts, estimated from
the number of equal pairs in each partition, gives each a threshold (-1: not probed), which sum to t - m + 1; so each
pair within t bits agrees within the threshold in some partition. Buckets of a partition are probed and verified.
A bucket beyond BUCKET fingerprints is linked exactly without pairs: two fingerprints within 2r bits share a word
within r bits of both, so all that share such a word form a star.

Cases: null, empty and white-space texts have fingerprint zero and link like any other; repeated rows and copies share
one fingerprint, so they link without pairs; ties (a bit set in exactly half) give 0; null ids have a fingerprint but
no component of their own (component: smallest id of the group, null if none has one); empty tables give no rows;
other columns pass through fingerprints() untouched, one that has the result's name under that name with underscores
behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._components import components
from ._shared import dropped, freed, join_checked, lean, narrow_batches, shuffle_partitions, written

#: Fingerprints that a bucket may have and be verified by pairs.
BUCKET = 512
#: Shingles hashed at a time, so that a long text needs no more memory.
STEP = 65_536


def fingerprint(text: str | None, k: int) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII only, as asked for
    if not words:
        return 0
    flat, sizes = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins, n, digest = ends - sizes, max(1, len(words) - k + 1), xxhash.xxh64_intdigest
    begins, ends = begins[:n].tolist(), (ends[k - 1 :] if len(words) >= k else ends[-1:]).tolist()
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, STEP):
        ones += _ones(np.array([digest(flat[a:b], 42) for a, b in zip(begins[i : i + STEP], ends[i : i + STEP])], dtype="<u8"))
    return _majority(ones, n)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(df: DataFrame, text: str = "text", k: int = 5, out: str = "fingerprint") -> DataFrame:
    """df with each text's fingerprint as a long of the same 64 bits."""
    narrow_batches(df.sparkSession)

    @F.pandas_udf("long")
    @lean
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(x, k) for x in s], dtype=np.uint64).astype(np.int64))

    df, name = freed(df, out), text + "_" * (text.lower() == out.lower())
    return df.withColumn(out, of(name))


def bit_groups(fps: DataFrame, m: int) -> list[list[int]]:
    """64 bits in m groups: greedily, by absolute correlation over all rows of fps."""

    @lean
    def moments(batches):
        n, one, two = 0, np.zeros(64), np.zeros((64, 64))
        for b in batches:
            x = np.unpackbits(b.fp.to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            n, one, two = n + len(x), one + x.sum(axis=0), two + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "m": [np.concatenate([one, two.ravel()])]})

    rows = fps.select("fp").mapInPandas(moments, "n long, m array<double>")
    sums = rows.select("n", F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("i").collect()
    # 64 + 64 * 64 numbers, whatever the input
    if not sums:
        return [list(range(i, 64, m)) for i in range(m)]
    n, v = sums[0].n, np.array([r.v for r in sums])
    mean = v[:64] / n
    cov = v[64:].reshape(64, 64) / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    cor = np.abs(cov / np.outer(sd, sd))
    free, groups = set(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        g = [max(free, key=lambda b: (cor[b, sorted(free)].sum(), -b))]
        free.remove(g[0])
        while len(g) < size:
            g.append(max(free, key=lambda b: (cor[b, g].sum(), -b)))
            free.remove(g[-1])
        groups.append(sorted(g))
    return groups


def _masks(groups: list[list[int]]) -> list[int]:
    return [sum(1 << b for b in g) for g in groups]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def thresholds(cost: list[list[float]], t: int) -> list[int]:
    """Per partition a threshold from -1 on, summing to t - m + 1, for the least total cost; cost[i][e + 1]."""
    m = len(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, es) in best.items():
            for e in range(-1, t + 1):
                if e + 1 < len(cost[i]):
                    x = (c + cost[i][e + 1], [*es, e])
                    if s + e not in step or x[0] < step[s + e][0]:
                        step[s + e] = x
        best = step
    return best[t - m + 1][1]


def buckets(fps: DataFrame, t: int, m: int) -> DataFrame:
    """fps with (part, key, c): every pair of fps within t bits shares a part and key; c counts the key's rows, from 2."""
    groups = bit_groups(fps, m)
    masks = _masks(groups)
    parts = fps.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(x))) for x in masks])).alias("part", "key"))
    counts = {r.part: (r.pairs, r.n) for r in parts.groupBy("part", "key").agg(F.count(F.lit(1)).alias("c")).groupBy("part").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs"), F.sum("c").alias("n")).collect()}
    # pairs at one more bit: estimated as if each bit of the partition were the free one in turn
    cost = []
    for i, g in enumerate(groups):
        pairs, n = counts.get(i, (0.0, 0))
        keys = lambda e: sum(comb(len(g), r) for r in range((e + 1) // 2 + 1))  # noqa: B023, E731
        cost.append([0.0] + [(float(pairs) + 1) * (1 + len(g)) ** e + n * keys(e) for e in range(t + 1)])
    es = thresholds(cost, t)
    out = None
    for i, (g, mask, e) in enumerate(zip(groups, masks, es)):
        if e < 0:
            continue
        # two keys within e bits share one within ceil(e / 2) of both
        flips = [sum(1 << b for b in c) for r in range((e + 1) // 2 + 1) for c in combinations(g, r)]
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        k = own if len(flips) == 1 else F.explode(F.array(*[own.bitwiseXOR(F.lit(_signed(x))) for x in flips]))
        one = fps.select(*fps.columns, F.lit(i).alias("part"), k.alias("key"))
        out = one if out is None else out.union(one)
    sizes = out.groupBy("part", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return out.join(sizes, ["part", "key"])


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs (i, j) over the nodes."""
    parent = list(range(len(nodes)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    a, b = [], []
    for x, y in zip(i.tolist(), j.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            a.append(nodes[x])
            b.append(nodes[y])
    return a, b


def link(fps: DataFrame, t: int = 2, m: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes of fps (node, fp; fp distinct) whose components are those of all pairs within t bits."""
    held = written(buckets(fps.select("node", "fp"), t, m or t + 1), "buckets")

    @lean
    def verified(batches):
        for batch in batches:
            a, b = [], []
            for nodes, values in zip(batch.nodes, batch.fps):
                x, nodes = np.asarray(values, dtype=np.int64).view(np.uint64), np.asarray(nodes, dtype=np.int64)
                i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= t, 1))
                p, q = _forest(nodes, i, j)  # not the bucket's pairs
                a, b = a + p, b + q
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    small = held.where(F.col("c") <= BUCKET).groupBy("part", "key").agg(F.collect_list("node").alias("nodes"), F.collect_list("fp").alias("fps"))
    edges = small.select("nodes", "fps").mapInPandas(verified, "a long, b long")
    large = held.where(F.col("c") > BUCKET).select("node", "fp").distinct()
    if not large.isEmpty():
        edges = edges.union(_stars(large, t))
    edges = written(edges, "links")
    dropped(held)
    return edges


def _stars(large: DataFrame, t: int) -> DataFrame:
    """Exact links for odd and even t without pairs: for odd t = 2r + 1 the last bit is compared on either side."""
    r = t // 2
    flips = [sum(1 << b for b in c) for n in range(r + 1) for c in combinations(range(64), n)]
    near = large.select("node", "fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(x))) for x in flips])).alias("w"))
    if t % 2:
        far = near.select("node", F.explode(F.array(F.col("w"), *[F.col("w").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])).alias("w"))
        hubs = near.groupBy("w").agg(F.min("node").alias("a"))
        return far.join(hubs, "w").where("a <> node").select("a", F.col("node").alias("b"))
    hubs = near.groupBy("w").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return near.join(hubs, "w").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, t: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) per row of df; component_id is the smallest id reachable over links of <= t bits."""
    prints = written(fingerprints(df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), "text", k, "fp").select("id", "fp"), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("node"))
    # a print without any id can still bridge others, so it takes part under an id of its own below all others
    nodes = written(nodes.withColumn("own", F.col("node")).withColumn("node", F.coalesce("node", F.expr("-4611686018427387904 + pmod(xxhash64(fp), 4611686018427387904)"))), "prints")
    found = components(link(nodes.select("node", "fp"), t))
    named = found.join(nodes.select("node", "own"), "node")
    least = named.groupBy("component").agg(F.min("own").alias("component_id"))
    groups = nodes.join(found, "node", "left").join(least, "component", "left")
    groups = groups.select("fp", F.when(F.col("component").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(groups, "fp").select("id", F.col("fp").alias("fingerprint"), "component_id")


# -- near copies by the share of common shingles ----------------------------------------------------------------------
#: Texts compared at a time within a group of candidates, and those of one shingle that are listed in one row.
GROUP, LISTED = 512, 4096
#: Bits that fingerprints of near texts may differ in to be found by SimHash; pairs beyond are found by shingles.
BITS = 2
#: Texts of a shingle that are looked at by pairs when it is first read.
PAIRED = 32
#: Texts, about, whose shingles are counted to put frequent ones last, how often one must be met there, and how many are
#: told apart. They set the order of shingles only: the links are the same in any order.
SAMPLE, OFTEN, ORDERED = 10_000, 5, 1 << 17
#: Texts, and bytes of their parities, that are compared at a time by parities.
PARITIES, PARITY_BYTES = 4096, 8 << 20
#: Counters of a shingle set's outline.
BINS = 256


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Hashes of the k-word shingles, repeats included (fewer words: the whole sequence; none: nothing)."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends, n = np.cumsum(sizes + 1) - 1, max(1, len(words) - k + 1)
    begins, ends = (ends - sizes)[:n].tolist(), (ends[k - 1 :] if len(words) >= k else ends[-1:]).tolist()
    return np.fromiter((digest(flat[i:j], 42) for i, j in zip(begins, ends)), dtype=np.uint64, count=n)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the different k-word shingles."""
    return np.unique(shingle_hashes(text, k))


def print_of(h: np.ndarray) -> int:
    """The fingerprint of a text with these shingle hashes."""
    return _majority(sum((_ones(h[i : i + STEP]) for i in range(0, len(h), STEP)), np.zeros(64, dtype=np.int64)), len(h))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def shingle_prefix(s: np.ndarray, often: np.ndarray, times: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of s, frequent ones last, of which two sets with a share of `similarity` have one in common:
    both have ceil(similarity * n) of n in common, so not all of the n - that + 1 first of either are missing in the
    other. A set without shingles has a sign of its own."""
    if not len(s):
        return np.array([-1], dtype=np.int64)
    n = len(s) - int(np.ceil(similarity * len(s) - 1e-6)) + 1
    if len(often):
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        s = s[np.argsort(np.where(often[at] == s, times[at], 0), kind="stable")]
    return s[:n].view(np.int64)


def _candidates(nodes: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, similarity: float) -> tuple[list[int], list[int], bool]:
    """Pairs of a shingle's texts (places) that are not linked yet and may have the share if this is the first shingle
    that they have in common; of many pairs a spanning forest, and True."""
    rest, a, b, forest, total = n - pos, [], [], ([], []), 0
    label, parts = np.arange(len(nodes)), len(nodes)
    for i in range(len(nodes) - 1):
        both = np.minimum(rest[i + 1 :], rest[i])
        fits = (both * (1 + similarity) >= similarity * (n[i + 1 :] + n[i]) - 1e-6) & (comp[i + 1 :] != comp[i])
        if total > 4 * len(nodes):  # many: from here on only texts that the forest does not join yet count
            if parts == 1:
                break
            fits &= label[i + 1 :] != label[i]
        j = np.flatnonzero(fits) + i + 1
        if not len(j):
            continue
        total += len(j)
        if total <= 4 * len(nodes):
            a += [i] * len(j)
            b += j.tolist()
        others, at = np.unique(label[j], return_index=True)
        new = others != label[i]
        if new.any():
            forest[0].extend([i] * int(new.sum()))
            forest[1].extend(j[at[new]].tolist())
            label[np.isin(label, others[new])] = label[i]
            parts -= int(new.sum())
    return (*forest, True) if total > 4 * len(nodes) else (a, b, False)


def outline(s: np.ndarray) -> bytes:
    """How many shingles of the set fall into each of BINS bins, a byte each; empty where a byte holds no such count."""
    c = np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else b""


def parity(s: np.ndarray) -> bytes:
    """Whether bins of the set hold an odd number of shingles: a bit for each of at least as many bins as shingles (a power
    of two, 64 or more). Two sets differ in at least as many shingles as bins; half of the bits give those of half the bins."""
    m = max(64, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _near_parities(nodes: np.ndarray, n: np.ndarray, odd: list[bytes], comp: np.ndarray, side: np.ndarray | None, similarity: float) -> tuple[list[int], list[int], bool]:
    """Pairs of texts (places) that are not linked yet and may have the share, by their numbers of shingles and parities; of
    many pairs a spanning forest, and True. side: only pairs of texts of different sides."""
    a, b, forest, total, label, parts = [], [], ([], []), 0, np.arange(len(nodes)), len(nodes)
    sizes = np.array([len(o) for o in odd])
    of = {m: np.flatnonzero(sizes == m) for m in np.unique(sizes).tolist()}
    bits = {m: np.frombuffer(b"".join([odd[k] for k in v.tolist()]), dtype=np.uint64).reshape(len(v), -1) for m, v in of.items()}
    for m in of:
        # sets that have the share have as many bins, or one of them twice as many
        who, rows = of[m], bits[m]
        if 2 * m in of:
            wide = bits[2 * m]
            who, rows = np.concatenate([who, of[2 * m]]), np.concatenate([rows, wide[:, : m // 8] ^ wide[:, m // 8 :]])
        for k, i in enumerate(of[m].tolist()):
            j, x = who[k + 1 :], rows[k + 1 :]
            fits = (np.minimum(n[j], n[i]) >= similarity * np.maximum(n[j], n[i]) - 1e-6) & (comp[j] != comp[i])
            if side is not None:
                fits &= side[j] != side[i]
            if total > 4 * len(nodes):  # as in _candidates
                if parts == 1:
                    break
                fits &= label[j] != label[i]
            j, x = j[fits], x[fits]
            j = j[np.bitwise_count(x ^ rows[k]).sum(axis=1, dtype=np.int64) * (1 + similarity) <= (n[j] + n[i]) * (1 - similarity) + 1e-6]
            if not len(j):
                continue
            total += len(j)
            if total <= 4 * len(nodes):
                a += [i] * len(j)
                b += j.tolist()
            others, at = np.unique(label[j], return_index=True)
            new = others != label[i]
            if new.any():
                forest[0].extend([i] * int(new.sum()))
                forest[1].extend(j[at[new]].tolist())
                label[np.isin(label, others[new])] = label[i]
                parts -= int(new.sum())
    return (*forest, True) if total > 4 * len(nodes) else (a, b, False)


def _by_parities(groups: DataFrame, first: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a group's texts (node, component) that `first` does not link and that may have the share by their
    parities; dense: of many pairs a spanning forest. Only parities, about an eighth of a byte a shingle, go to each block."""
    texts = written(join_checked(nodes.select("node", "n", "odd"), groups, "node", "inner"), "parities")
    size = texts.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PARITIES, F.sum(F.octet_length("odd")) / PARITY_BYTES)).cast("int").alias("blocks"))
    dealt = texts.join(size, "component").join(first.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node", "n", "odd", "comp")

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, side = pdf.node.to_numpy(), pdf.block.to_numpy()
        i, j, many = _near_parities(nodes, pdf.n.to_numpy(), pdf.odd.tolist(), pdf.comp.to_numpy(), side if pdf.lo.iat[0] != pdf.hi.iat[0] else None, similarity)
        a, b = nodes[np.array(i, dtype=np.int64)], nodes[np.array(j, dtype=np.int64)]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "dense": np.full(len(a), many)})

    out = written(dealt.groupBy("component", "lo", "hi").applyInPandas(near, "a long, b long, dense boolean"), "near")
    dropped(texts)
    return out


def _shared(index: DataFrame, similarity: float) -> DataFrame:
    """Rows (h, node, n, pos, comp) of shingles with several texts, read once in order of shingle and text. As pairs (a, b):
    a shingle's least text with each that it may have the share with, if this is the first shingle in common, and is not
    linked with. Not as pairs: the texts (a) of shingles where such a pair of other texts is left. Memory: LISTED rows
    beside a batch."""
    names = ["h", "node", "n", "pos", "comp"]

    def may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        rest = np.minimum(x[..., 2] - x[..., 3], y[..., 2] - y[..., 3])
        return (rest * (1 + similarity) >= similarity * (x[..., 2] + y[..., 2]) - 1e-6) & (x[..., 4] != y[..., 4])

    def frame(pair: bool, h, a, b, n, pos) -> pd.DataFrame:
        return pd.DataFrame({"pair": np.full(len(a), pair), "h": h, "a": a, "b": b, "n": n, "pos": pos})

    def stars(hub: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        ok = may(hub, x)
        none = np.zeros(int(ok.sum()), dtype=np.int64)
        return frame(True, none, np.broadcast_to(hub, x.shape)[ok, 1], x[ok, 1], none, none)

    def members(x: np.ndarray) -> pd.DataFrame:
        return frame(False, x[:, 0], x[:, 1], np.zeros(len(x), dtype=np.int64), x[:, 2], x[:, 3])

    def whole(x: np.ndarray) -> Iterator[pd.DataFrame]:
        """Of whole shingles."""
        new = np.concatenate([[True], x[1:, 0] != x[:-1, 0]])
        c = np.diff(np.append(np.flatnonzero(new), len(x)))
        several = np.repeat(c > 1, c)
        x, new, c = x[several], new[several], c[c > 1]
        if not len(x):
            return
        yield stars(x[np.repeat(np.flatnonzero(new), c)], x)
        group, left = np.cumsum(new) - 1, c > PAIRED
        for d in range(1, int(c[~left].max(initial=0)) - 1):
            i = np.flatnonzero((group[:-d] == group[d:]) & ~new[:-d] & ~left[group[:-d]])
            left[group[i[may(x[i], x[i + d])]]] = True
        yield members(x[left[group]])

    @lean
    def scan(batches):
        tail, hub = np.zeros((0, 5), dtype=np.int64), None  # the shingle that the last batch ended in; its least text, if the others are given out
        for b in batches:
            x = np.concatenate([tail, b[names].to_numpy(dtype=np.int64)])
            if not len(x):
                continue
            if hub is not None:
                more = np.searchsorted(x[:, 0], hub[0], side="right")
                yield stars(hub, x[:more])
                yield members(x[:more])
                x = x[more:]
                if not len(x):
                    continue
                hub = None
            at = np.searchsorted(x[:, 0], x[-1, 0])
            if at:
                yield from whole(x[:at])
            tail = x[at:]
            if len(tail) > LISTED:
                hub = tail[0]
                yield stars(hub, tail)
                yield members(tail)
                tail = tail[:0]
        if len(tail):
            yield from whole(tail)

    dealt = index.select(names).repartition(shuffle_partitions(index.sparkSession), "h").sortWithinPartitions("h", "node")
    return dealt.mapInPandas(scan, "pair boolean, h long, a long, b long, n long, pos long")


def may_share(a: pd.Series, b: pd.Series, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles with these outlines can have the share: the sum of the smaller counts is at
    least the number that they have in common."""
    out = np.ones(len(a), dtype=bool)
    known = np.flatnonzero((a.map(len).to_numpy() == BINS) & (b.map(len).to_numpy() == BINS)) if len(a) else []
    for i in range(0, len(known), 4096):
        k = known[i : i + 4096]
        x, y = (np.frombuffer(b"".join(v.iloc[k]), dtype=np.uint8).reshape(-1, BINS) for v in (a, b))
        most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
        out[k] = most * (1 + similarity) >= similarity * (n[k] + m[k]) - 1e-6
    return out


def _different_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, text): (id, key) of each row, and one row (node, own, key, text) for each different text. own is the
    least id that has it; node is own, or for a text without an id of its own a number below all ids."""
    keyed = rows.withColumn("key", F.sha2("text", 256))
    narrow = written(keyed.select("id", "key"), "keys")
    firsts = narrow.groupBy("key").agg(F.min("id").alias("own"), F.count(F.lit(1)).alias("c"))
    if narrow.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        # ids are unique: the rows that repeat a text are left out by id, and no text is shuffled
        again = narrow.join(firsts.where("c > 1").select("key", "own"), "key").where("id <> own").select("id")
        texts = join_checked(keyed, written(again, "copies"), "id", "left_anti")
        return narrow, texts.select(F.col("id").alias("node"), F.col("id").alias("own"), "key", "text")
    below = F.expr("-4611686018427387904 + pmod(xxhash64(key), 4611686018427387904)")
    # an id with several texts is the node of one of them only
    names = firsts.withColumn("nth", F.row_number().over(Window.partitionBy("own").orderBy("key")))
    names = names.select("key", "own", F.when((F.col("nth") == 1) & F.col("own").isNotNull(), F.col("own")).otherwise(below).alias("node"))
    one = keyed.groupBy("key").agg(F.first("text").alias("text"))
    return narrow, one.join(names, "key").select("node", "own", "key", "text")


def near_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, key, component_id, group) per row: groups of texts linked by a share of at least `similarity` of their k-word
    shingles (as sets); key is the text's SHA-256, component_id the least id of the group, group a number of its own.

    Equal texts are one node. SimHash comes first: texts whose fingerprints are equal or linked within BITS bits are
    candidates. As fingerprints lose pairs, all others with the share are found from shingles of their prefixes (see
    shingle_prefix), one of which every such pair has in common. Outlines rule out most candidates that lack the share, and
    the sets themselves decide. Of texts that SimHash leaves apart, first each shingle's are compared with the least of them, where length and place of the shingle allow the share (see _shared). Then
    those pairs that are not linked by that, and that length and place allow, are compared one by one; a shingle with many such pairs beside its texts, or with more than LISTED
    texts, gives a spanning forest, and a group so made is compared together, in blocks: by parities, which leave few pairs,
    and where they leave many by the sets."""
    spark = df.sparkSession
    narrow_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked, texts = _different_texts(rows)

    # frequent shingles, from a sample of texts
    @lean
    def counted(batches):
        for batch in batches:
            got = [shingle_set(x, k) for x in batch.text]
            h, c = np.unique(np.concatenate(got or [np.zeros(0, dtype=np.uint64)]), return_counts=True)
            yield pd.DataFrame({"h": h.view(np.int64), "c": c.astype(np.int64)})

    share_of = max(1, marked.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("key"), F.lit(share_of)) == 0).select("text")
    often = some.mapInPandas(counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= OFTEN)
    often = often.orderBy(F.desc("c"), "h").limit(ORDERED).toPandas()
    shingle, times = often.h.to_numpy(dtype=np.int64).view(np.uint64), often.c.to_numpy(dtype=np.int64)
    order = np.argsort(shingle)
    held = spark.sparkContext.broadcast((shingle[order], times[order]))  # bounded by ORDERED

    @F.pandas_udf("n long, sig array<long>, outline binary, odd binary, fp long")
    @lean
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps, got = [], []
            for x in batch:
                h = shingle_hashes(x, k)
                fps.append(print_of(h))
                got.append(np.unique(h))
            sig = [shingle_prefix(s, *held.value, similarity) for s in got]
            yield pd.DataFrame({"n": np.array([len(s) for s in got], dtype=np.int64), "sig": sig, "outline": [outline(s) for s in got], "odd": [parity(s) for s in got], "fp": np.array(fps, dtype=np.uint64).astype(np.int64)})

    nodes = written(texts.withColumn("p", signed("text")).select("node", "own", "key", "p.n", "p.sig", "p.outline", "p.odd", "p.fp"), "nodes")
    @F.pandas_udf("boolean")
    @lean
    def may(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for x, y, n, m in batches:
            yield pd.Series(may_share(x, y, n.to_numpy(), m.to_numpy(), similarity))

    @F.pandas_udf("binary")
    @lean
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([shingle_set(x, k).tobytes() for x in s])

    @F.pandas_udf("double")
    @lean
    def share(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([jaccard(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)) for a, b in zip(x, y)], dtype="float64")

    def shingles_of(wanted: DataFrame, tag: str) -> DataFrame:
        """(node, s) of the nodes in wanted."""
        owners = join_checked(texts, wanted, "node", "left_semi")
        return written(owners.select("node", sets("text").alias("s")), tag)

    def linked(pairs: DataFrame, tag: str) -> DataFrame:
        """Those of the pairs (a, b) with the share."""
        side = lambda c, *x: nodes.select(F.col("node").alias(c), *[F.col(f).alias(f"{f}_{c}") for f in x])
        maybe = pairs.join(side("a", "n", "outline"), "a").join(side("b", "n", "outline"), "b")
        maybe = written(maybe.where(may("outline_a", "outline_b", "n_a", "n_b")).select("a", "b"), f"{tag}-maybe")
        both = maybe.select(F.col("a").alias("node")).union(maybe.select("b")).distinct()
        s = shingles_of(both, f"{tag}-shingles")
        one = maybe.join(s.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        out = written(one.where(share("sa", "sb") >= similarity).select("a", "b"), tag)
        dropped(s)
        dropped(maybe)
        return out

    # 1: SimHash: fingerprints that are equal or within BITS bits
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    within = link(prints, BITS)
    equal = nodes.select("fp", F.col("node").alias("b")).join(prints.withColumnRenamed("node", "a"), "fp").where("a <> b").select("a", "b")
    alike = linked(within.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(equal).distinct(), "simhash")
    dropped(within)
    dropped(prints)
    known = components(alike)
    # 2: of texts not linked by that, each against the least of each of its shingles
    named = join_checked(nodes.select("node", "n", "sig"), known, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    index = named.select("node", "n", "comp", F.posexplode("sig").alias("pos", "h"))
    shared = written(_shared(index, similarity), "shared")
    tried = written(shared.where("pair").select("a", "b").distinct(), "tried")
    stars = alike.union(linked(tried, "stars"))
    first = components(stars)
    # 3: what these links leave open
    comp = join_checked(shared.where("not pair").select("h", F.col("a").alias("node"), "n", "pos"), first, "node", "left")
    comp = written(comp.withColumn("comp", F.coalesce("component", "node")).drop("component"), "open")
    dropped(shared)
    several = comp.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("c"), F.min("node").alias("hub")).where("x < y").select("h", "c", "hub")
    several = comp.join(several, "h")
    listed = several.where(F.col("c") <= LISTED).groupBy("h").agg(*[F.collect_list(c).alias(c) for c in ("node", "n", "pos", "comp")])

    @lean
    def close(batches):
        for batch in batches:
            a, b, dense = [], [], []
            for nodes, n, pos, comps in zip(batch.node, batch.n, batch.pos, batch.comp):
                nodes, n, pos, comps = (np.asarray(x, dtype=np.int64) for x in (nodes, n, pos, comps))
                i, j, many = _candidates(nodes, n, pos, comps, similarity)
                a, b, dense = a + nodes[i].tolist() if i else a, b + nodes[j].tolist() if j else b, dense + [many] * len(i)
            a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "dense": np.array(dense, dtype=bool)})

    pairs = listed.select("node", "n", "pos", "comp").mapInPandas(close, "a long, b long, dense boolean")
    crowded = several.where((F.col("c") > LISTED) & (F.col("hub") != F.col("node"))).select(F.col("hub").alias("a"), F.col("node").alias("b"), F.lit(True))
    pairs = written(pairs.union(crowded).distinct(), "pairs")
    dropped(comp)
    sparse, groups = pairs.where("not dense").select("a", "b"), components(pairs.where("dense"))
    if not groups.isEmpty():
        # most texts of such a group share a few shingles only; parities leave those that may have the share
        near = _by_parities(groups, first, nodes, similarity)
        sparse, groups = sparse.union(near.where("not dense").select("a", "b")).distinct(), components(near.where("dense"))
    found = linked(sparse.join(tried, ["a", "b"], "left_anti"), "sparse")
    links = stars.union(found)
    if not groups.isEmpty():
        links = links.union(_together(groups, first, shingles_of(groups.select("node"), "dense"), similarity))
    found = components(links)
    named = found.join(nodes.select("node", "own"), "node")
    least = named.groupBy("component").agg(F.min("own").alias("component_id"))
    per = nodes.select("key", "own", "node").join(found, "node", "left").join(least, "component", "left")
    per = per.select("key", F.when(F.col("component").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component", "node").alias("group"))
    return marked.join(per, "key").select("id", "key", "component_id", "group")


def _together(groups: DataFrame, first: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join all texts of a group (node, component) with the share which `first` does not join yet, by
    comparing blocks of GROUP texts."""
    size = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks"))
    dealt = groups.join(size, "component").join(first.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(shingles, "node").select("component", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "node", "comp", "s")

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, comps = pdf.node.to_numpy(), np.unique(pdf.comp.to_numpy(), return_inverse=True)[1]
        s = [np.frombuffer(v, dtype=np.uint64) for v in pdf.s]
        sizes, a, b = np.array([len(v) for v in s]), [], []
        # of all texts the numbers of shingles that they share with one, from lists of texts by shingle
        who, token = np.repeat(np.arange(len(s)), sizes), np.unique(np.concatenate(s), return_inverse=True)[1]
        by, ends = who[np.argsort(token, kind="stable")], np.cumsum(np.bincount(token)) if len(token) else np.zeros(0, dtype=np.int64)
        begins, stops = np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(len(s)):
            if (comps == comps[i]).all():
                break
            lists = [by[begins[t] : stops[t]] for t in token[at[i] : at[i + 1]].tolist()]
            both = np.bincount(np.concatenate(lists), minlength=len(s)) if lists else np.zeros(len(s), dtype=np.int64)
            every = sizes + sizes[i] - both
            near = np.flatnonzero((both / np.maximum(every, 1) >= similarity) & (every > 0) & (comps != comps[i]))
            for c in np.unique(comps[near]).tolist():
                a.append(nodes[i])
                b.append(nodes[near[comps[near] == c][0]])
            comps[np.isin(comps, comps[near])] = comps[i]
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return written(dealt.groupBy("component", "lo", "hi").applyInPandas(together, "a long, b long"), "together")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, "doc_id", "text", k=3, t=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
