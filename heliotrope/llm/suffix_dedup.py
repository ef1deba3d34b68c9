"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if some string of `length` bytes over it also starts earlier, in an earlier document (smaller id) or
earlier in the same one. In one text: the suffix array gives each position's neighbours in suffix order; the nearest
smaller position before and after (previous and next smaller value) hold its longest previous factor, and a position
whose factor reaches `length` covers that many bytes.

Over a corpus no machine can sort all suffixes, so equal strings are brought together first: each window of `length`
bytes has an anchor, its K-gram of least hash (leftmost on a tie), which equal windows share at the same place. An
anchor's windows in a text form one context of less than 2 * length bytes. Contexts are dealt out by anchor:
 - equal contexts: all but the earliest are wholly repeated, decided in sorted order, by hash, without their bytes
   (in the map task already for copies in a batch, so that a hot passage is one row a batch);
 - anchors with several different contexts: only those few bytes are fetched and go through suffix and LPF arrays, in
   groups of up to GROUP; an anchor with more is decided by window hashes, as combinable minima, to the same end.
Equal documents are one text (the earliest); later copies are removed whole if they have a window at all. Hashes that
decide are 128 bits.

Cases: null and empty texts have no bytes; texts shorter than `length` lose nothing; rows with a null id come before
all others; repeated rows with one id are documents in the order of their texts, equal ones in any order; overlapping
repeats (aaaa...) count; texts of any length are read whole; empty tables give no rows; other columns pass through
deduplicated() untouched, those that have the name of a result under that name with underscores behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import dropped, freed, lean, narrow_batches, shuffle_partitions, written

K = 32
#: Contexts of an anchor that are compared by suffix array.
GROUP = 16_384
#: Bytes of text hashed at a time, unless one text is longer, and those whose anchors are sorted at a time.
CHUNK, SLICE = 1 << 18, 1 << 22
#: Bytes of contexts in one suffix array, unless one anchor has more.
ARRAY = 1 << 19

_rng = np.random.default_rng(20240101)
_T1, _T2 = (_rng.integers(0, 2**64, 256, dtype=np.uint64) for _ in range(2))
_B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


# -- one text -----------------------------------------------------------------------------------------------------
def _ranked(key: np.ndarray) -> np.ndarray:
    """Each key's number among the different keys, in order."""
    order = np.argsort(key)
    there = key[order]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(there[1:] != there[:-1])])
    return rank


def suffix_levels(x: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(h, ranks) of all positions of the bytes x by their first h bytes, for h of 1, 2, 4, ... up to depth, by prefix
    doubling; what lies beyond the end is less than any byte."""
    n, h = len(x), 1
    rank = x.astype(np.int64) + 1
    out = [(h, rank)]
    while h * 2 <= depth:
        key = rank * (max(n, 256) + 2)
        key[: max(0, n - h)] += rank[h:]
        rank, h = _ranked(key) + 1, 2 * h
        out.append((h, rank))
    return out


def suffix_array(levels: list[tuple[int, np.ndarray]], starts: np.ndarray, depth: int) -> np.ndarray:
    """Places of the starts (ascending positions with `depth` bytes behind them) in the order of their suffixes' first
    depth bytes, equal ones by position."""
    h, rank = levels[-1]
    out = rank[starts]
    for i in (*range(h, depth - h, h), depth - h) if depth > h else ():
        out = _ranked(out * (len(rank) + 2) + rank[starts + i])
    return np.argsort(out, kind="stable")


def smaller_neighbours(sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of sa the nearest place before and after it with a smaller value (-1 and len(sa): none), by pointer
    jumping: all that lies between a place and its pointer is greater than the value there, so an unsettled place may
    take the pointer of its pointer."""
    n = len(sa)

    def nearest(v: np.ndarray) -> np.ndarray:
        wall = np.concatenate([v, [-1]])  # pointers to none end at the last place
        to = np.arange(-1, n)
        to[-1] = to[0] = n
        left = np.arange(n)
        while len(left):
            left = left[wall[to[left]] > wall[left]]
            to[left] = to[to[left]]
        return to[:n]

    before = nearest(sa)
    after = nearest(sa[::-1])[::-1]
    return np.where(before == n, -1, before), np.where(after == n, n, n - 1 - after)


def common_prefix(levels: list[tuple[int, np.ndarray]], p: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at p and q, up to depth; both have depth bytes."""
    size = np.zeros(len(p), dtype=np.int64)
    n = len(levels[0][1])
    for h, rank in reversed(levels):
        for _ in range(max(1, depth // h if h == levels[-1][0] else 1)):
            a, b = p + size, q + size
            same = (size + h <= depth) & (np.maximum(a, b) + h <= n)
            same[same] = rank[a[same]] == rank[b[same]]
            size[same] += h
    return size


def lpf(x: np.ndarray, length: int, starts: np.ndarray | None = None) -> np.ndarray:
    """The longest previous factor of each of the starts (by default all that have `length` bytes behind them), counted
    up to `length` and among the starts: the greater of the prefixes shared with the previous and the next smaller
    position in suffix order."""
    x = np.asarray(x, dtype=np.uint8)
    if starts is None:
        starts = np.arange(max(0, len(x) - length + 1))
    out = np.zeros(len(starts), dtype=np.int64)
    if len(starts) < 2:
        return out
    levels = suffix_levels(x, length)
    sa = suffix_array(levels, starts, length)
    for near in smaller_neighbours(sa):
        there = (near >= 0) & (near < len(sa))
        mine, other = sa[there], sa[near[there]]
        out[mine] = np.maximum(out[mine], common_prefix(levels, starts[mine], starts[other], length))
    return out


# -- anchors ------------------------------------------------------------------------------------------------------
def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.ones(size, dtype=np.uint64), np.ones(size, dtype=np.uint64)
        np.cumprod(np.full(size - 1, base, dtype=np.uint64), out=up[1:])
        np.cumprod(np.full(size - 1, pow(base, -1, 2**64), dtype=np.uint64), out=down[1:])
        _powers[base] = got = (up, down)
    return got[0][:n], got[1][:n]


def _sums(x: np.ndarray, table: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(table[x] * _power(base, len(x))[0], out=out[1:])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _spans(sums: np.ndarray, base: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[begin]) * _power(base, len(sums))[1][begin]


def anchors(x: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """For the texts that begin at `starts` in the bytes x: text, anchor's hash, context's hash, and first and last
    start of a window (in the text) of each anchor's context."""
    n, w = len(x), length - k + 1
    bounds = np.append(starts, n)
    if n < length:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z
    s1 = _sums(x, _T1, _B1)
    m = n - k + 1
    h = (s1[k:] - s1[:-k]) * _power(_B1, m)[1]
    h = _mix(h)
    low = np.uint64((1 << max(20, int(n).bit_length())) - 1)
    key = (h & ~low) | np.arange(m, dtype=np.uint64)
    span, best = 1, key
    while span * 2 <= w:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    windows = n - length + 1
    if span < w:
        best = np.minimum(best[:windows], best[w - span : w - span + windows])
    at = (best[:windows] & low).astype(np.int64)
    # windows that run over the end of a text, and those that never begin in one
    valid = np.ones(windows, dtype=bool)
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        valid[max(b, e - length + 1) : e] = False
    run = np.flatnonzero(valid & np.concatenate([[True], (at[1:] != at[:-1]) | ~valid[:-1]]))
    stop = np.flatnonzero(valid & np.concatenate([(at[1:] != at[:-1]) | ~valid[1:], [True]]))
    a = at[run]
    doc = np.searchsorted(starts, run, side="right") - 1
    s2 = _sums(x, _T2, _B2)
    c = _spans(s2, _B2, run, stop + length)
    shape = ((a - run).astype(np.uint64) << np.uint64(32)) | (stop - run).astype(np.uint64)
    c = _mix(c ^ _mix(shape + np.uint64(1)))
    return doc, h[a].view(np.int64), c.view(np.int64), run - starts[doc], stop - starts[doc]


def _chunks(texts: list, most: int):
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def _first(order_keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of the keys (most telling first) and whether each is the first with its first two keys."""
    order = np.lexsort(order_keys[::-1])
    a, b = order_keys[0][order], order_keys[1][order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


#: kind 0: anchor rows (h, c, place, lo, hi); kind 1: repeated windows (place, lo, hi).
_ROW = "kind int, h long, c long, place long, lo long, hi long"


def _frame(kind, h, c, place, lo, hi) -> pd.DataFrame:
    n = len(place)
    full = lambda x, t: np.full(n, x, dtype=t) if np.isscalar(x) else x
    return pd.DataFrame({"kind": full(kind, np.int32), "h": full(h, np.int64), "c": full(c, np.int64), "place": place, "lo": lo, "hi": hi})


def find_anchors(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Anchor rows of (place, text) rows; a context that repeats in a slice of a batch is decided there."""

    @lean
    def scan(batches):
        for b in batches:
            texts, places = b.text.tolist(), b.place.to_numpy()
            for i, j in _chunks(texts, SLICE):
                yield from slice_of([t.encode() for t in texts[i:j]], places[i:j])

    def slice_of(data, places):
        if data:
            parts = []
            for i, j in _chunks(data, CHUNK):
                x = np.frombuffer(b"".join(data[i:j]), dtype=np.uint8)
                starts = np.concatenate([[0], np.cumsum([len(t) for t in data[i:j]])[:-1]]).astype(np.int64)
                doc, h, c, lo, hi = anchors(x, starts, length, k)
                parts.append((h, c, places[i:j][doc], lo, hi))
            h, c, place, lo, hi = (np.concatenate(v) for v in zip(*parts))
            order, first = _first([h, c, place, lo])
            h, c, place, lo, hi = (v[order] for v in (h, c, place, lo, hi))
            yield _frame(0, h[first], c[first], place[first], lo[first], hi[first])
            again = ~first
            if again.any():
                # side by side repeats of a text are one row
                p, a, z = place[again], lo[again], hi[again]
                o = np.lexsort((a, p))
                p, a, z = p[o], a[o], z[o]
                new = np.concatenate([[True], (p[1:] != p[:-1]) | (a[1:] != z[:-1] + 1)])
                at = np.flatnonzero(new)
                yield _frame(1, 0, 0, p[at], a[at], z[np.append(at[1:], len(p)) - 1])

    return texts.select("place", "text").mapInPandas(scan, _ROW)


def settle(found: DataFrame) -> DataFrame:
    """Streams anchor rows in order of (h, c, place, lo): all but the first of equal contexts are repeated (kind 1); the
    first of each context stays (kind 0) if its anchor has another context, else it goes. Memory: one batch."""

    @lean
    def merge(batches):
        # what is known of the anchor and context that the last batch ended in
        ph = pc = None
        held: pd.DataFrame | None = None  # the first context of ph, not given out yet
        for b in batches:
            done = b[b.kind.to_numpy() == 1]
            if len(done):
                yield done
            b = b[b.kind.to_numpy() == 0]
            n = len(b)
            if not n:
                continue
            h, c = b.h.to_numpy(), b.c.to_numpy()
            new_h = np.concatenate([[h[0] != ph], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[c[0] != pc], c[1:] != c[:-1]])
            again = b[~new_c]
            if len(again):
                yield again.assign(kind=np.int32(1), h=0, c=0)
            # number of contexts that each anchor has in this batch
            group = np.cumsum(new_h)
            contexts = np.bincount(group, weights=new_c)[group]
            if not new_h[0]:  # goes on from the last batch, whose first context is held or already given out
                lead = group == 0
                if contexts[0] > 0 and held is not None:
                    yield held
                    held = None
                keep = new_c & (lead | (contexts > 1))
            else:
                keep = new_c & (contexts > 1)
                held = None
            last = group == group[-1]
            if new_h[np.flatnonzero(last)[0]]:
                if contexts[-1] == 1:
                    held = b[last & new_c]
                else:
                    held = None
            if keep.any():
                yield b[keep]
            ph, pc = h[-1], c[-1]

    dealt = found.repartition(shuffle_partitions(found.sparkSession), F.when(F.col("kind") == 0, F.col("h")).otherwise(F.col("place")))
    return dealt.sortWithinPartitions("kind", "h", "c", "place", "lo").mapInPandas(merge, _ROW)


def compare_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows (place, lo, hi) among rows (h, place, lo, hi, bytes), by LPF arrays over each anchor's contexts in
    order of place; those of an anchor are in one partition, sorted."""

    def decide(groups: list[pd.DataFrame]):
        g = pd.concat(groups) if len(groups) > 1 else groups[0]
        h, upto = g.h.to_numpy(), np.cumsum(g.bytes.map(len).to_numpy())
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))  # whole anchors
        i = 0
        while i < len(h):
            below = ends[(ends > i) & (upto[ends - 1] - (upto[i - 1] if i else 0) <= ARRAY)]
            j = below[-1] if len(below) else ends[ends > i][0]
            yield from array(g.iloc[i:j])
            i = j

    def array(g: pd.DataFrame):
        # windows lie within their contexts, so the contexts follow one another without signs between them; anchors in
        # one array do not meet, as equal windows have equal anchors
        data, n = g.bytes.tolist(), len(g)
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        at = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        owner = np.repeat(np.arange(n), counts)
        offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        hit = lpf(np.frombuffer(b"".join(data), dtype=np.uint8), length, at[owner] + offset) >= length
        own = owner[hit]
        p, s = g.place.to_numpy()[own], g.lo.to_numpy()[own] + offset[hit]
        if not len(p):
            return
        o = np.lexsort((s, p))
        p, s = p[o], s[o]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] > s[:-1] + 1)])
        first = np.flatnonzero(new)
        yield pd.DataFrame({"place": p[first], "lo": s[first], "hi": s[np.append(first[1:], len(p)) - 1]})

    @lean
    def stream(batches):
        tail: list[pd.DataFrame] = []
        for b in batches:
            h = b.h.to_numpy()
            last = np.flatnonzero(h == h[-1])[0]
            if last or (tail and tail[-1].h.iat[-1] != h[-1]):
                ready = [*tail, b.iloc[:last]] if last else tail
                yield from decide([r for r in ready if len(r)])
                tail = [b.iloc[last:]]
            else:
                tail.append(b)
        if tail:
            yield from decide(tail)

    return contexts.mapInPandas(stream, "place long, lo long, hi long")


def repeats(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(place, lo, hi): runs of windows (starts, both ends included) that start earlier too; texts has (place, text),
    places different and in the order that decides."""
    spark = texts.sparkSession
    settled = written(settle(find_anchors(texts.where(F.octet_length("text") >= length), length, k)), "settled")
    out = settled.where("kind = 1").select("place", "lo", "hi")
    open_ = settled.where("kind = 0").select("h", "place", "lo", "hi")
    counts = open_.groupBy("h").count()
    hot = written(counts.where(F.col("count") > GROUP).select("h"), "hot")

    # the bytes of the open contexts only
    def fetched(rows: DataFrame) -> DataFrame:
        per = rows.groupBy("place").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("a"))  # a text's own anchors
        return texts.join(per, "place").select("place", "text", "a")

    @lean
    def cut(batches):
        frame = lambda *x: pd.DataFrame({n: np.array(v, dtype=np.int64) if n != "bytes" else v for n, v in zip(("h", "place", "lo", "hi", "bytes"), x)})
        h, place, lo, hi, data = [], [], [], [], []
        for b in batches:
            for p, t, a in zip(b.place, b.text, b.a):
                t = t.encode()
                for r in a:
                    h.append(r["h"])
                    place.append(p)
                    lo.append(r["lo"])
                    hi.append(r["hi"])
                    data.append(t[r["lo"] : r["hi"] + length])
                if len(h) >= 4000:
                    yield frame(h, place, lo, hi, data)
                    h, place, lo, hi, data = [], [], [], [], []
        yield frame(h, place, lo, hi, data)

    if hot.isEmpty():
        cold = fetched(open_)
    else:
        cold = fetched(open_.join(hot, "h", "left_anti"))

        @lean
        def windows(batches):
            for b in cut(batches):
                a, c, place, s = [], [], [], []
                for p, lo, data in zip(b.place, b.lo, b.bytes):
                    for i in range(len(data) - length + 1):
                        d = hashlib.blake2b(data[i : i + length], digest_size=16).digest()
                        a.append(int.from_bytes(d[:8], "little", signed=True))
                        c.append(int.from_bytes(d[8:], "little", signed=True))
                        place.append(p)
                        s.append(lo + i)
                yield pd.DataFrame({"x": np.array(a, dtype=np.int64), "y": np.array(c, dtype=np.int64), "place": np.array(place, dtype=np.int64), "lo": np.array(s, dtype=np.int64)})

        each = written(fetched(open_.join(hot, "h", "left_semi")).mapInPandas(windows, "x long, y long, place long, lo long"), "windows")
        firsts = each.groupBy("x", "y").agg(F.min(F.struct("place", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        more = each.join(firsts, ["x", "y"]).where("struct(place, lo) > first").select("place", "lo", F.col("lo").alias("hi"))
        out = out.union(more)
    contexts = cold.mapInPandas(cut, "h long, place long, lo long, hi long, bytes binary")
    dealt = contexts.repartition(shuffle_partitions(spark), "h").sortWithinPartitions("h", "place", "lo")
    out = written(out.union(compare_contexts(dealt, length)), "repeats")
    dropped(settled)
    return out


def deduplicated(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100, k: int = K, decoded: bool = False) -> DataFrame:
    """df with n_bytes, n_removed, n_spans and kept (binary): what is left of each text. decoded: kept is a text, without
    what is left of characters that were cut."""
    if not 0 < k <= length:
        raise ValueError("k must lie in 1..length")
    narrow_batches(df.sparkSession)
    results = ("n_bytes", "n_removed", "n_spans", "kept")
    ends = freed(df, *results).columns
    names = [f"_c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    id_, text_ = names[df.columns.index(id_col)], names[df.columns.index(text)]
    # the order of documents: id, then text; a place for each different text. ids are unique in the usual case, so
    # places are the ids themselves unless some repeat or are null
    keyed = rows.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(text_), F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.sha2("text", 256))
    keys = written(keyed.select("id", "key", F.octet_length("text").alias("n")), "texts")
    odd = not keys.groupBy("id").count().where("count > 1 or id is null").isEmpty()
    if odd:
        # ids with several texts: numbers by range-sorted order of (id, text key); counted per partition, not in one window
        ordered = written(keys.select("id", "key").distinct().repartitionByRange(shuffle_partitions(df.sparkSession), "id", "key").sortWithinPartitions("id", "key").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "ordered")
        places = ordered.select("id", "key", F.col("row").alias("place"))
        keys_ = keys.join(places, keys.id.eqNullSafe(places.id) & (keys.key == places.key)).select(keys.id, keys.key, "n", "place")
    else:
        keys_ = keys.withColumn("place", F.col("id"))
    firsts = keys_.groupBy("key").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"))
    # texts with a copy are few; the rest are their own first
    copied = firsts.where("copies > 1").select("key", F.col("place").alias("first"))
    marks = keys_.join(copied, "key", "left").withColumn("own", F.col("first").isNull() | (F.col("first") == F.col("place")))
    if odd:
        rank = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(1)))  # equal rows of one id
        marks = marks.withColumn("nth", rank)
        texts = keyed.join(marks.where("own and nth = 1").select(F.col("id").alias("i"), F.col("key").alias("k"), "place"), keyed.id.eqNullSafe(F.col("i")) & (keyed.key == F.col("k"))).select("place", "text").distinct()
    else:
        copies = marks.where("not own").select(F.col("place").alias("id"))
        texts = keyed.select(F.col("id"), "text").join(copies, "id", "left_anti").select(F.col("id").alias("place"), "text")
    found = repeats(texts, length, k)
    spans = found.groupBy("place").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # of one text
    if odd:
        work = marks.where("own").select("id", "key", "nth", "place").join(spans, "place", "left").select(F.col("id").alias("i"), F.col("key").alias("k"), F.col("nth").alias("_nth"), "spans", F.lit(False).alias("copy"))
        work = work.union(marks.where("not own").select("id", "key", "nth", F.lit(None).cast(spans.schema["spans"].dataType), F.lit(True)))
        rows = rows.withColumn("_key", F.sha2(F.coalesce(F.col(text_), F.lit("")), 256)).withColumn("_n", F.row_number().over(Window.partitionBy(id_, "_key").orderBy(F.lit(1))))
        joined = rows.join(work, F.col(id_).cast("long").eqNullSafe(F.col("i")) & (F.col("_key") == F.col("k")) & (F.col("_n") == F.col("_nth"))).withColumn("copy", F.col("copy") | (F.col("_n") > 1))
    else:
        work = spans.withColumn("copy", F.lit(False)).unionByName(copies.select(F.col("id").alias("place"), F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(True).alias("copy")))
        joined = rows.join(work, F.col(id_).cast("long") == F.col("place"), "left")
    out = joined.select(*names, _cut(length, decoded)(F.coalesce(F.col(text_), F.lit("")), "spans", F.coalesce("copy", F.lit(False))).alias("_out"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, ends)], *[f"_out.{r}" for r in results])


def _cut(length: int, decoded: bool):
    """What is left of a text without the bytes that its repeated windows cover."""

    def left(t: bytes, s, c: bool) -> tuple[int, int, int, bytes]:
        if c and len(t) >= length:
            return len(t), len(t), 1, b""
        if s is None or not len(s):
            return len(t), 0, 0, t
        a = np.array([r["lo"] for r in s]), np.array([r["hi"] for r in s]) + length
        edge = np.bincount(a[0], minlength=len(t) + 1) - np.bincount(a[1], minlength=len(t) + 1)
        gone = np.cumsum(edge[: len(t)]) > 0
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(t), int(gone.sum()), runs, np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()

    @F.pandas_udf(f"n_bytes long, n_removed long, n_spans long, kept {'string' if decoded else 'binary'}")
    @lean
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, spans, copy in batches:
            out = pd.DataFrame([left(t.encode(), s, c) for t, s, c in zip(text, spans, copy)], columns=["n_bytes", "n_removed", "n_spans", "kept"])
            yield out.assign(kept=[b.decode("utf-8", "ignore") for b in out.kept]) if decoded else out

    return cut


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = deduplicated(docs, length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 100 bytes in hexadecimal digits, cut from pieces of 1000 windows; of equal ones all but the first are
#: repeated.
OP2_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT r, k, substr(h, 2000 * k + 1, 2198) AS part
  FROM (SELECT r, h, unnest(range((length(h) // 2 + 900) // 1000)) AS k FROM d WHERE length(h) >= 200)
), w AS (
  SELECT r, i, row_number() OVER (PARTITION BY x ORDER BY r, i) > 1 AS again FROM (
    SELECT r, 1000 * k + j AS i, md5_number(substr(part, 2 * j + 1, 200)) AS x
    FROM (SELECT r, k, part, unnest(range(length(part) // 2 - 99)) AS j FROM c))
), g AS (
  SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 1 ELSE 0 END AS fresh FROM w WHERE again
), s AS (
  SELECT r, min(i) AS a, max(i) + 100 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM g) GROUP BY r, run
), k AS (
  SELECT s.r, sum(b - a) AS gone, count(*) AS spans, max(b) AS last,
    string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS kept
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s) s JOIN d USING (r) GROUP BY s.r
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN k.r IS NULL THEN h ELSE kept || substr(h, (2 * last + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
