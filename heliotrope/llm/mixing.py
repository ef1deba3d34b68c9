"""Mixing sources to target weights, in DataFrame functions alone.

Each source's words, documents in a fixed order, are packed into blocks of `block` words. Targets come from weights,
capped at `most` times a source's size with the excess reshared (water level by one sorted pass over the sources).
Output shards of `shard` slots draw their sources: each slot's seeded hash picks a source by target, so a shard's
counts are multinomial; counts over a source's number of slots go to sources that drew too few, so every source ends
with its target exactly. Slot k of a source maps to block (a k + b) mod n, with a prime and b from the source's hash, a
permutation in every epoch; in the last, partial epoch the short block comes last and the last slot is trimmed. Slots
and blocks are joined by index.

Cases: null or empty texts have size 0 and are taken 0 times; a null source is a source of its own, after all others;
repeated rows are documents of their own, ordered by a hash of id and text, then id, size and text hash; ids may be null
or of any type with an order; no words at all: targets 0; other columns are ignored by mix() and kept by mixed_texts(); very
long texts are cut into blocks like others; empty tables give no rows. Reruns agree: nothing depends on files or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

#: Large primes for permutations: two different ones cannot both divide a number of blocks.
PRIMES = (268435399, 268435367, 268435361, 268435337, 268435331, 268435313, 268435291, 268435273)
#: Documents of a source summed in one window, about.
CELL = 20_000


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text (null: 0): starts of words, counted without making the words."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _hash(source: Column, part: int) -> Column:
    """28 bits of md5, equal in other engines."""
    return F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))), 1 + 7 * part, 7), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """sizes (source, source_size) with target: one row per source; the windows pass over sources, not rows."""
    by = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, rest = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("rate", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("full", F.col("cap") < F.col("w") * F.col("rate"))
    # the water level is the rate at the first source that is not full
    s = s.withColumn("lambda", F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("o"), F.col("rate").alias("r")))).over(every)["r"])
    return s.select("source", "source_size", F.when(F.col("full") | F.col("lambda").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("lambda"))).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = 256, shard: int = 4096, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(documents, slots). documents: id, row, source, size, source_size, target, begin (place in its source's words),
    one row per row of df. slots: shard, slot, source, epoch, index of the block, from_word, n_words - the mixed output:
    the slot's words are words [from_word, from_word + n_words) of its source."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("x"))
    docs = written(docs, "sizes")
    n = docs.count()
    cells = max(1, n // CELL)
    docs = docs.withColumn("cell", F.pmod(F.xxhash64("id", "x"), F.lit(cells)))
    # places in a source: sums by cell first, so that no window holds a source's rows
    sums = docs.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("cell")
    sums = sums.withColumn("base", F.sum("words").over(order) - F.col("words")).select(F.col("source").alias("_s"), F.col("cell").alias("_c"), "base")
    inner = Window.partitionBy("source", "cell").orderBy("id", "size", "x")
    docs = docs.withColumn("upto", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    docs = docs.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c"))).withColumn("begin", F.col("base") + F.col("upto") - F.col("size"))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, share, weights, most)
    # slots: whole epochs of n blocks, then full blocks of the partial one and a trimmed slot
    words, b = F.round("target").cast("long"), F.lit(block)
    s = sources.withColumn("words", words).withColumn("n", F.ceil(F.col("source_size") / b))
    s = s.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    s = s.withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size"))
    s = s.withColumn("slots", F.col("whole") * F.col("n") + F.ceil(F.col("rest") / b))
    pick = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(_hash(F.col("source"), 0), F.lit(len(PRIMES))) + 1).cast("int"))
    other = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(_hash(F.col("source"), 0) + 1, F.lit(len(PRIMES))) + 1).cast("int"))
    # the partial epoch permutes the full blocks only
    for name, m in (("a", F.col("n")), ("a2", F.floor(F.col("source_size") / b))):
        s = s.withColumn(name, F.when((m > 0) & (F.pmod(m, pick) == 0), other).otherwise(pick).cast("long"))
    s = s.withColumn("b", _hash(F.col("source"), 1)).withColumn("full", F.floor(F.col("source_size") / b))
    line = Window.orderBy(F.col("source").isNull(), "source")
    s = written(s.withColumn("hi", F.sum("slots").over(line)).withColumn("lo", F.col("hi") - F.col("slots")).withColumn("sid", F.row_number().over(line)), "sources")
    total, count = s.agg(F.coalesce(F.max("hi"), F.lit(0)), F.count(F.lit(1))).first()
    # multinomial counts: slot -> a point of [0, total) -> the source that owns the point; points are met by cells
    grain = max(1, total // max(1, 2 * count))
    point = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(1, total)))
    drawn = spark.range(total).select(F.floor(F.col("id") / shard).alias("shard"), point.alias("p")).withColumn("g", F.floor(F.col("p") / grain))
    own = s.where("slots > 0").select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / grain), F.floor((F.col("hi") - 1) / grain))).alias("g"))
    counts = drawn.join(own, "g").where("p >= lo and p < hi").groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("sid").orderBy("shard")
    counts = written(counts.withColumn("at", F.sum("c").over(upto) - F.col("c")), "counts")
    got = counts.groupBy("sid").agg(F.sum("c").alias("got"))
    s2 = s.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    s2 = s2.withColumn("less", F.greatest(F.col("slots") - F.col("got"), F.lit(0))).withColumn("over", F.greatest(F.col("got") - F.col("slots"), F.lit(0)))
    line = Window.orderBy("sid")
    s2 = written(s2.withColumn("less_at", F.sum("less").over(line) - F.col("less")).withColumn("over_at", F.sum("over").over(line) - F.col("over")), "repair")
    units = counts.select("shard", "sid", F.explode(F.expr("sequence(at, at + c - 1)")).alias("k")).join(s2.select("sid", "slots", "got", "over_at"), "sid")
    kept = units.where("k < slots").select("shard", "sid", "k")
    spare = units.where("k >= slots").select("shard", (F.col("k") - F.col("slots") + F.col("over_at")).alias("u"))
    wants = s2.where("less > 0").select("sid", "got", "less_at", F.explode(F.expr("sequence(less_at, less_at + less - 1)")).alias("u"))
    moved = spare.join(wants, "u").select("shard", "sid", (F.col("got") + F.col("u") - F.col("less_at")).alias("k"))
    slots = kept.union(moved).join(s.select("sid", "source", "source_size", "n", "whole", "rest", "a", "a2", "b", "full"), "sid")
    epoch = F.when(F.col("n") > 0, F.floor(F.col("k") / F.col("n"))).otherwise(F.lit(0))
    slots = slots.withColumn("epoch", F.least(epoch, F.col("whole"))).withColumn("j", F.col("k") - F.col("epoch") * F.col("n"))
    in_whole = F.col("epoch") < F.col("whole")
    index = F.when(in_whole, F.expr("pmod(a * j + b + epoch, n)")).when(F.col("j") < F.col("full"), F.expr("pmod(a2 * j + b + epoch, full)")).otherwise(F.col("full"))
    slots = slots.withColumn("index", index).withColumn("from_word", F.col("index") * b)
    size = F.least(b.cast("long"), F.col("source_size") - F.col("from_word"))
    slots = slots.withColumn("n_words", F.when(in_whole, size).otherwise(F.least(size, F.col("rest") - F.col("j") * b)))
    slots = slots.withColumn("slot", F.xxhash64(F.lit(seed), F.col("sid"), F.col("k"))).select("shard", "slot", "source", "sid", "epoch", "index", "from_word", "n_words")
    docs = docs.join(s.select(F.col("source").alias("_t"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("_t")))
    return docs.select("id", "source", "sid", "size", "source_size", "target", "begin", "x"), slots


def taken(docs: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """docs with taken, the words of each document in the slots: a document's pieces meet blocks by index.

    Uses are summed per trimmed block before the join, so it meets each block once."""
    uses = slots.groupBy("sid", "index").agg(F.sum(F.when(F.col("n_words") == block, 1).otherwise(0)).alias("times"), F.collect_list(F.when(F.col("n_words") < block, F.col("n_words"))).alias("short"))
    # the size of a document is cut into inner blocks (counted whole) and at most two edges
    d = docs.withColumn("row", F.monotonically_increasing_id())
    d = written(d, "places")
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    pieces = d.where("size > 0").select("row", "sid", "begin", "size", F.explode(F.sequence(first, last)).alias("index"))
    met = pieces.join(uses, ["sid", "index"])
    start = F.greatest(F.col("begin") - F.col("index") * block, F.lit(0))
    end = F.least(F.col("begin") + F.col("size") - F.col("index") * block, F.lit(block))
    cut = F.aggregate("short", F.lit(0).cast("long"), lambda acc, n: acc + F.greatest(F.least(end, n) - start, F.lit(0)))
    per = met.groupBy("row").agg(F.sum(F.col("times") * (end - start) + cut).alias("taken"))
    return d.join(per, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def named_rows(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows of df under free column names, with a name of each row in _row, and which column is which.

    A row's name is made of what it holds, so that it does not depend on files or partitions: two hashes and, among rows
    equal in all columns, a number."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    all_ = [F.to_json(F.struct(n)) if "map<" in t else F.col(n) for n, t in rows.dtypes]  # maps have no hash
    src = written(rows.withColumn("_a", F.xxhash64(*all_)).withColumn("_b", F.xxhash64(F.lit(1), *all_)), "rows")
    again = src.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_a", "_b")
    if again.isEmpty():
        src = src.withColumn("n", F.lit(0))
    else:
        again = written(again, "again")
        nth = F.row_number().over(Window.partitionBy("_a", "_b").orderBy(F.lit(0)))
        same = src.join(again, ["_a", "_b"]).select(*src.columns, nth.alias("n"))
        src = written(src.join(again, ["_a", "_b"], "left_anti").select(*src.columns, F.lit(0).alias("n")).union(same), "numbered")
    return src.select(*names, F.struct("_a", "_b", "n").alias("_row")), dict(zip(df.columns, names))


def mixed_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = 256, **how) -> DataFrame:
    """The mix as rows of df: a row for the words a document gives once or more, and another for those it gives twice.
    A document given whole keeps its text as it is; of others the words taken remain, joined by spaces, in order."""
    src, at = named_rows(df)
    docs, slots = mix(src, "_row", at[text], at["source"], block, **how)
    uses = slots.groupBy("sid", "index").agg(F.sort_array(F.collect_list("n_words"), asc=False).alias("n"))  # at most `most` uses
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    pieces = docs.where("size > 0").select(F.col("id").alias("row"), "sid", "begin", "size", F.explode(F.sequence(first, last)).alias("index")).join(uses, ["sid", "index"])
    pieces = pieces.select("*", F.posexplode("n").alias("turn", "upto"))
    low = F.greatest(F.col("index") * block, F.col("begin"))
    high = F.least(F.col("index") * block + F.col("upto"), F.col("begin") + F.col("size"))
    pieces = pieces.withColumn("from", low - F.col("begin")).withColumn("n_words", high - low).where("n_words > 0")
    parts = pieces.groupBy("row", "turn").agg(F.sort_array(F.collect_list(F.struct("from", "n_words"))).alias("parts"), F.sum("n_words").alias("taken"), F.first("size").alias("size"))
    met = src.join(parts.withColumnRenamed("row", "_row"), "_row")
    words = F.regexp_extract_all(F.col(at[text]), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p["from"] + 1).cast("int"), p["n_words"].cast("int")))), " ")
    out = met.withColumn(at[text], F.when(F.col("taken") == F.col("size"), F.col(at[text])).otherwise(some))
    return out.select(*[F.col(n).alias(c) for c, n in at.items()])


#: Words in a block of the registered query.
BLOCK = 256


def mixed_documents(df: DataFrame) -> DataFrame:
    docs, slots = mix(df, block=BLOCK)
    return taken(docs, slots, BLOCK)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    out = mixed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
