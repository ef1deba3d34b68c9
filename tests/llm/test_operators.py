"""Each training-data operator against a brute-force version, the library that it follows, or held-out rows."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as tokenizer_files
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from heliotrope.llm import chat, embedding_dedup, mixing, queries, sentencepiece, simhash, suffix_dedup, token_file, topk, toxicity, warc
from heliotrope.llm._components import components
from heliotrope.llm._shared import work_dir

ODD = ["", None, " \t\n ", "a", "a" * 5000, "naïve Ünïcode 中文 😀", "it's I'LL <|endoftext|> x", "\x00\x1c\u0085", "twin text " * 40, "twin text " * 40]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string, node long, place long, score double"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts under columns with clashing names, a null id and a repeated row."""
    rows = [(i, t, None, ["x", None][i % 2], None, "i", "k", 7, 8, 0.5) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "lone", None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def linked(nodes, pairs):
    at = {n: n for n in nodes}

    def root(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        at[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(name, spark, sf):
    con = duckdb.connect()
    for t in Path(sf).iterdir():
        con.execute(f"create view {t.stem} as select * from '{t}'")
    df = queries.QUERIES[name](spark, sf)
    res = con.execute(queries.ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(res.fetchall())


# -- 1 and 9: the libraries' ids -----------------------------------------------------------------------------------
def test_sentencepiece(spark, sf, odd, texts):
    import sentencepiece as library

    file = tokenizer_files.path("piece_bpe_32k.model")
    lib = library.SentencePieceProcessor(model_file=file)
    got = {r.doc_id: r for r in sentencepiece.op1_sentencepiece(spark, sf).collect()}
    for d, t in texts.items():
        ids = lib.encode(t)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    both = sentencepiece.round_trip(odd, "text", file).collect()
    assert len(both) == odd.count() and all(r.ids == lib.encode(r.text or "") and r.decoded == lib.decode(r.ids) and (r.key in ("k", None)) for r in both)
    apart = sentencepiece.decode(sentencepiece.encode(odd, "text", file), "ids", file).select("ids", "decoded").collect()
    assert sorted((r.ids, r.decoded) for r in apart) == sorted((r.ids, r.decoded) for r in both)
    assert sentencepiece.round_trip(odd.limit(0), "text", file).count() == 0


def test_token_file(spark, odd, texts):
    from tokenizers import Tokenizer

    file = tokenizer_files.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(file)
    rnd = random.Random(5)
    signs = "abcABC'sS tTreRE.,!_09 \t\n\r\x0b\x1c\x85\xa0éÉİſŉΣςЖжЁß×ªµ<|endoftext|>́​中あ😀²½-\"\x00"
    fuzz = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [t for t in ODD if t] + list(texts.values())
    for t, ids in zip(fuzz, token_file.Encoder(Path(file).read_text()).encode(fuzz)):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids
    folder = work_dir(spark, "test-ids")
    manifest = token_file.write(odd, folder, file)
    rows = token_file.read(manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
    at = 0
    for r in rows:
        assert r.start == at and r.ids == [*lib.encode("lone" if r.doc_id is None else ODD[r.doc_id] or "", add_special_tokens=False).ids, 1]
        at += r.n_tokens
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in token_file.digests(manifest, folder).collect()}
    assert all(sums[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows)
    empty = token_file.write(odd.limit(0), work_dir(spark, "test-ids"), file)
    assert empty.count() == 0


def test_token_file_query(spark, sf, texts, monkeypatch):
    """The registered query over the whole table, in files of few ids: starts, counts and checksums from the library."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_files.path("word_bpe_49k.json"))
    want, at = {}, 0
    for d, t in sorted(texts.items()):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want[d] = (d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    monkeypatch.setattr(token_file, "ROLL_IDS", 3000)
    assert sorted(map(tuple, token_file.op9_token_file(spark, sf).collect())) == [want[d] for d in sorted(want)]


@pytest.mark.parametrize("values", [[], [0] * 500, [1] * 61, [2**60, 2**64 - 1, 5], list(range(9000)), list(range(140_000)), [0, 2**59, 0, 7] * 40_000])
def test_simple8b(values):
    docs, ends, ids, nulls = token_file.load(token_file.dump(np.array([3]), np.array([len(values)]), np.array(values, dtype=np.uint64), 1))
    assert ids.tolist() == values and docs.tolist() == [3] and ends.tolist() == [len(values)] and nulls == 1


# -- 2: repeated strings --------------------------------------------------------------------------------------------
def repeats_of(rows, length):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_suffix_dedup(spark, sf, odd, texts):
    got = {tuple(r) for r in suffix_dedup.op2_suffix_dedup(spark, sf).collect()}
    assert got == {(i, n, g, s, sha(k)) for i, n, g, s, k in repeats_of(sorted(texts.items()), 100)}
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    kept = suffix_dedup.deduplicated(odd, length=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in kept) == Counter(repeats_of(rows, 100))
    assert suffix_dedup.deduplicated(odd.limit(0)).count() == 0
    clash = odd.select("doc_id", "text", F.lit("mine").alias("kept"), F.lit(1).alias("N_SPANS"))
    both = suffix_dedup.deduplicated(clash).where("kept_ = 'mine' and N_SPANS_ = 1")
    assert both.columns == ["doc_id", "text", "kept_", "N_SPANS_", "n_bytes", "n_removed", "n_spans", "kept"] and both.count() == odd.count()


def test_longest_previous_factors():
    """Arrays against their definitions, on bytes with many repeats, runs and chosen starts."""
    rnd = random.Random(7)
    for _ in range(300):
        sa = np.array(rnd.sample(range(40), rnd.randint(1, 40)))
        before, after = suffix_dedup.smaller_neighbours(sa)
        for i, v in enumerate(sa):
            assert before[i] == max((j for j in range(i) if sa[j] < v), default=-1)
            assert after[i] == min((j for j in range(i + 1, len(sa)) if sa[j] < v), default=len(sa))
        x = np.frombuffer("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))).encode() * rnd.randint(1, 3), dtype=np.uint8)
        length = rnd.randint(1, 30)
        starts = np.array([i for i in range(len(x) - length + 1) if rnd.random() < 0.8], dtype=np.int64)
        shared = lambda p, q: next((k for k in range(length) if x[p + k] != x[q + k]), length)  # noqa: E731, B023
        assert suffix_dedup.lpf(x, length, starts).tolist() == [max((shared(p, q) for q in starts[:i]), default=0) for i, p in enumerate(starts)]


def test_suffix_dedup_hot_anchor(spark, monkeypatch):
    """Anchors with more contexts than one array takes are decided by window hashes, to the same end."""
    rnd = random.Random(3)
    common = "".join(rnd.choice("abcdef ") for _ in range(130))
    rows = [(i, "".join(rnd.choice("xyz") for _ in range(20)) + common + "".join(rnd.choice("xyz") for _ in range(20))) for i in range(40)]
    monkeypatch.setattr(suffix_dedup, "GROUP", 5)
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted((*r[:4], bytes(r[4])) for r in got) == repeats_of(rows, 100)


# -- 3: toxicity ----------------------------------------------------------------------------------------------------
FEW = pytest.mark.xfail(reason="33 toxic rows to learn from; the 4 of 18 that are missed have no pattern that these show", strict=True)


@pytest.fixture(scope="module", params=["sf0.1", "sf0.01"])
def scored(request, spark):
    sf = f"/root/testdata/{request.param}"
    got = toxicity.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    return request.param, got, sum(r.predicted == 1 and r.toxic == 1 for r in got)


def test_toxicity_held_out(scored):
    """Nearly all that is flagged is toxic, at both sizes; what a small one misses is what scores as a text without a match."""
    _, got, hit = scored
    assert hit >= 0.9 * sum(r.predicted == 1 for r in got) and hit >= 0.75 * sum(r.toxic == 1 for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_recall(request, scored):
    size, got, hit = scored
    if size == "sf0.01":
        request.applymarker(FEW)
    assert hit >= 0.85 * sum(r.toxic == 1 for r in got)


def slow_matches(weights, exceptions, t):
    hits = {}
    for k in range(len(t)):
        found = [w for p, w in weights.items() if t.startswith(p, k)]
        if found:
            hits[k] = max(found)
    for p in exceptions:
        for k in range(len(t)):
            if f" {p} " not in weights and t.startswith(f" {p} ", k):
                hits = {i: w for i, w in hits.items() if not k <= i < k + len(p) + 1}
    return hits


def test_toxicity_matches_equal_naive():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5)))
    for _ in range(200):
        weights = {f" {word()}" + rnd.choice(["", " "]): rnd.uniform(1, 9) for _ in range(12)}
        exceptions = tuple({rnd.choice([word(), f"{word()} {word()}"]) for _ in range(8)})
        t = " " + " ".join(word() for _ in range(60)) + " "
        assert toxicity.Lexicon(weights, exceptions).matches(t) == slow_matches(weights, exceptions, t)
    assert toxicity.Lexicon({" a": 1.0}).matches("  ") == {} == toxicity.Lexicon({}).matches(" a ")


def test_toxicity_patterns(spark):
    texts = [toxicity.folded(t) for t in ("", "a bc def ghijklm ghij", "Réeux-ment 1d10t! idiots idiots", "w" * 9)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", toxicity._patterns("t").alias("p"))
    assert {r.t: sorted(r.p) for r in df.collect()} == {t: sorted(toxicity.features(set(t.split()))) for t in texts}


def test_toxicity_without_labels(spark, odd):
    none = toxicity.learn(odd, odd.limit(0).select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.score(odd, none).where("score > 0.01").count() == 0
    got = toxicity.score(odd, none)
    assert got.count() == odd.count() and got.where("score_ = 0.5").count() == odd.where("score = 0.5").count()  # the column that had the name
    long = spark.createDataFrame([(1, "fine words " * 300_000, "x"), (2, None, "y")], "doc_id long, text string, y string")
    assert {r.doc_id: r.y for r in toxicity.score(long, none).collect()} == {1: "x", 2: "y"}
    assert toxicity.score(odd.limit(0), none).count() == 0


def test_toxicity_keeps_the_telling(spark):
    """Rare telling words are kept, not frequent neutral ones nor those of one row."""
    common = "morning window garden yellow silver market"
    own = lambda i: " ".join(hashlib.md5(f"{i}-{j}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for j in range(20))
    rows = [(i, f"{common} {own(i)}" + (" zorgblat" if i < 30 and i % 2 else ""), int(i < 30)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert lexicon.matches(toxicity.folded("a zorgblat")) and not lexicon.matches(toxicity.folded(common))


def test_toxicity_folding():
    assert toxicity.folded("1D10T! ѕtupid") == toxicity.folded("idiot stupid")
    lex = toxicity.Lexicon({" stupid ": 5.0}, ("stupid hat",), (3.0, 0.0, -2.0))
    assert lex.score("you are $tup1d") > 0.7 > lex.score("a stupid hat") and lex.score(None) == lex.score("")


# -- 4: chats -------------------------------------------------------------------------------------------------------
def test_chat(spark):
    rows = [(1, 0, "user", "a<done>\\s["), (1, 1, "assistant", "<turn>é\\"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "system", "x"), (None, None, None, None)]
    ex = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in ex.withColumn("turns", chat.read_turns(F.col("formatted"))).groupBy("conv_id").agg(F.max_by("turns", "example").alias("turns"), F.count(F.lit(1)).alias("n")).collect()}
    assert [tuple(t) for t in got[1].turns] == [(r, t or "") for c, _, r, t in rows if c == 1] and got[1].n == 2
    for r in ex.where("loss_start is not null").select("*", chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_len")).alias("loss")).collect():
        assert r.loss == ["<turn>é\\", ""][r.example]


def test_chat_cases(spark):
    """Rows without a conversation, ties, repeated rows, columns with clashing names, long texts and no rows at all."""
    schema = "conv_id long, turn long, role string, text string, example long, turns string, formatted string"
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (None, 2, "assistant", "b<"), (5, 1, "user", "x" * 300_000), (5, 1, "user", "tie"), (5, 2, "assistant", "y"), (5, 2, "assistant", "y"), (6, None, None, None)]
    df = spark.createDataFrame([(*r, 9, "t", "f") for r in rows], schema)
    got = Counter(map(tuple, chat.digest(chat.format_chats(df)).collect()))
    want = Counter()
    for c, turns in [(None, rows[:1]), (None, rows[1:2]), (None, rows[2:3]), (5, [rows[4], rows[3], *rows[5:7]]), (6, rows[7:])]:
        said = [(r or "", t or "") for _, _, r, t in turns]
        loss = "".join(t for r, t in said if r == "assistant")
        sizes = [len("<turn><says><done>") + len(r) + len(t) + (r + t).count("<") + (r + t).count("[") + (r + t).count("\\") for r, t in said]
        ends = [i for i, (r, _) in enumerate(said) if r == "assistant" or i == len(said) - 1]
        want[c, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), sum(sum(sizes[: i + 1]) for i in ends)] += 1
    assert got == want
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


# -- 5: archives ----------------------------------------------------------------------------------------------------
def test_warc(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u\r\nx y", "other"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 99999), (6, "u", "é" * 99999), (-3, "u", "same"), (None, "u", "same"), (None, "u", "lone"), (None, "v", "lone")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    folders = [work_dir(spark, "test-warc") for _ in range(2)]
    manifests = [warc.write(df, f, roll=2000).orderBy("file").collect() for f in folders]
    assert manifests[0] == manifests[1] and len(manifests[0]) > 1  # the same bytes again
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark.createDataFrame(manifests[0]), folders[0]).collect())
    top, want = defaultdict(int), Counter()
    for p, _, h in rows:
        top[h or ""] = max(filter(None, (top[h or ""], p)), default=0)
    for p, _, h in rows:
        b, first = (h or "").encode(), top[h or ""] or None
        want[p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if p == first else "revisit", None if p == first else first] += 1
    assert got == want and want[None, 4, base64.b32encode(hashlib.sha1(b"lone").digest()).decode(), "response", None] == 2
    folder = work_dir(spark, "test-warc")
    empty = warc.write(df.limit(0), folder)
    assert empty.count() == 0 and warc.read(empty, folder).count() == 0


# -- 6 and 10: vectors ----------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 8))
    rows = [(i, [float(x) for x in base[i % 30] + 0.02 * rng.standard_normal(8)], i % 2 if i % 11 else None) for i in range(300)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 8, 1), (303, [float("nan")] * 8, 1), (304, [None] * 8, 1), (305, rows[7][1], rows[7][2]), (306, [float("inf")] + [1.0] * 7, 0), (350, rows[8][1], 1), (307, [1.0, 2.0], 1)]
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, d int")


def test_top_k(vectors):
    q = {r.vec_id: np.floor(256 * np.array(r.embedding)).astype(int) for r in vectors.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all()}
    want = set()
    for a in (i for i in q if i % 50 == 0):
        best = sorted((-int(q[a] @ q[b]), b) for b in q if b != a and len(q[a]) == len(q[b]))[:5]
        want |= {(a, n + 1, b, -s) for n, (s, b) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(vectors, "vec_id % 50 = 0").collect()} == want
    assert topk.top_k(vectors.limit(0), "true").count() == 0


@pytest.mark.parametrize("size", [1e6, 2e6, 3e6])
def test_top_k_large_components(spark, size):
    """Components beyond 2^20 take part as they are; what no long holds is an error."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in size * rng.standard_normal(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(q[a], q[b]))
    want = {(a, n + 1, b, -s) for a in (0, 50) for n, (s, b) in enumerate(sorted((-score(a, b), b) for b in q if b != a)[:5])}
    assert {tuple(r) for r in topk.top_k(df, "vec_id % 50 = 0").collect()} == want
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(spark.createDataFrame([(0, [1e9] * 4), (1, [1e9] * 4)], df.schema), "true").collect()


def test_embedding_dedup(vectors):
    rows = vectors.collect()
    ok = {r.vec_id: (r.label, np.array(r.embedding)) for r in rows if r.label is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    near = [(a, b) for a in ok for b in ok if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] / np.linalg.norm(ok[a][1]) / np.linalg.norm(ok[b][1]) >= 0.98]
    n, root = Counter(x for p in near for x in p), linked([r.vec_id for r in rows], near)
    got = {tuple(r) for r in embedding_dedup.near_duplicates(vectors).collect()}
    assert len(near) > 100 and got == {(i, n[i], root[i], root[i] == i) for i in root}
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_embedding_estimates():
    """Estimates are unbiased over rotations, their upper bounds hold always, and most random pairs are ruled out."""
    rng = np.random.default_rng(2)
    unit = embedding_dedup.unit_rows(rng.standard_normal((120, 33)))
    unit[60:] = embedding_dedup.unit_rows(unit[:60] + 0.03 * rng.standard_normal((60, 33)))
    exact, total = unit @ unit.T, np.zeros((120, 120))
    for seed in range(300):
        rot = embedding_dedup.rotation(33, seed)
        code, factor = embedding_dedup.encode(unit, rot)
        e = embedding_dedup.estimates(code, factor, (unit @ rot.T).astype(np.float32))
        total += e
        near = e >= embedding_dedup.least_estimates(factor, 0.98)[:, None]
        assert near[exact >= 0.98].all()
    assert np.abs(total / 300 - exact).max() < 0.1 and np.abs((total / 300 - exact).mean()) < 0.002
    assert near[exact < 0.6].mean() < 0.02


@pytest.mark.parametrize("block", [4096, 16])
def test_embedding_blocks(spark, monkeypatch, block):
    """A dense label in several blocks: the same counts and components."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    rows = [(i, [float(x) for x in base[i % 12] * rng.uniform(0.1, 9) + 0.05 * rng.standard_normal(16)], 0) for i in range(150)]
    u = embedding_dedup.unit_rows(np.array([v for _, v, _ in rows]))
    near = [(a, b) for a in range(150) for b in range(a) if u[a] @ u[b] >= 0.98]
    n, root = Counter(x for p in near for x in p), linked(range(150), near)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "STEP", 7)
    got = {tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(near) > 200 and got == {(i, n[i], root[i], root[i] == i) for i in root}


# -- 7: mixing ------------------------------------------------------------------------------------------------------
def test_mixing(spark, sf, odd):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        got = mixing.mixed_documents(df).collect()
        again = mixing.mixed_documents(df.repartition(7)).collect()
        key = lambda r: (r.id is None, r.id, r.size, r.taken)
        assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(again, key=key)] and len(got) == df.count()
        by, target = defaultdict(int), {}
        for r in got:
            assert 0 <= r.taken <= 2 * r.size
            by[r.source] += r.taken
            target[r.source] = (r.target, r.source_size)
        assert all(abs(by[s] - t) <= 1 and t <= 2 * size + 1e-6 for s, (t, size) in target.items())
        room = sum(2 * size for _, size in target.values())
        assert sum(t for t, _ in target.values()) == pytest.approx(min(room, 1.5 * sum(s for _, s in target.values())))


def test_mixing_equals_brute_force(spark, sf, texts):
    """Sizes, weights, water level and the words taken over the whole table, from their definitions."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    total = defaultdict(int)
    for source, n in rows.values():
        total[source] += n
    order = sorted(total, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while free:  # those above their caps are set to them, the rest is shared anew
        share = {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        full = {x for x in free if share[x] > 2 * total[x]}
        if not full:
            target |= share
            break
        for x in full:
            target[x] = 2.0 * total[x]
            left -= target[x]
        free -= full
    got = mixing.op7_mixing(spark, sf).collect()
    assert {r.doc_id: (r.size, r.source_size) for r in got} == {d: (n, total[x]) for d, (x, n) in rows.items()}
    assert all(r.target == pytest.approx(target[rows[r.doc_id][0]], rel=1e-12) for r in got)
    # taken: the words of each document that the slots hold, by walking the sources' words
    mixed, slots = mixing.mix(docs, block=mixing.BLOCK)
    begin = {r.id: (r.sid, r.begin, r.size) for r in mixed.collect()}
    uses = [(r.sid, r.from_word, r.from_word + r.n_words) for r in slots.collect()]
    taken = {d: sum(max(0, min(b + n, hi) - max(b, lo)) for s, lo, hi in uses if s == sid) for d, (sid, b, n) in begin.items()}
    assert {r.doc_id: r.taken for r in got} == taken
    spans = sorted(begin.values())
    assert all(b + n == c for (s, b, n), (u, c, _) in zip(spans, spans[1:]) if s == u)  # words lie side by side


def test_mixed_texts_any_layout(spark, sf, odd):
    """The mix is the same whatever the files and partitions, repeated rows and odd columns included."""
    for df, block in ((spark.read.parquet(f"{sf}/documents.parquet"), 64), (odd.withColumn("m", F.create_map(F.lit(1), F.lit(2))), 16)):
        key = lambda x: Counter((r.doc_id, r.text, r.source, r.lang) for r in x.collect())
        one = key(mixing.mixed_texts(df.repartition(1), block=block))
        assert one == key(mixing.mixed_texts(df.orderBy(F.desc("text")).repartition(13), block=block)) and sum(one.values())
    assert mixing.mixed_texts(odd.limit(0)).count() == 0


# -- 8: near duplicates ---------------------------------------------------------------------------------------------
def slow_print(text, k):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf, odd, texts):
    got = {r.doc_id: r for r in simhash.op8_simhash(spark, sf).collect()}
    fp = {d: slow_print(t, 3) for d, t in texts.items()}
    root = linked(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {d: (int(r.fingerprint, 16), r.component_id) for d, r in got.items()} == {d: (fp[d], root[d]) for d in fp}
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 == simhash.near_texts(odd.limit(0)).count()
    clash = simhash.fingerprints(odd.withColumnRenamed("score", "Fingerprint"))
    assert clash.where("Fingerprint_ = 0.5").count() == odd.where("score = 0.5").count() and clash.columns[-1] == "fingerprint"


@pytest.mark.parametrize(("t", "bucket"), [(2, 512), (2, 2), (3, 2), (1, 2)])
def test_simhash_links(spark, monkeypatch, t, bucket):
    """Buckets beyond the bound are linked exactly too."""
    rnd = random.Random(t)
    fps = {0}
    for _ in range(300):
        x = rnd.choice(sorted(fps))
        for b in rnd.sample(range(64), rnd.randint(1, 6)):
            x ^= 1 << b
        fps.add(x)
    fp = dict(enumerate(sorted(fps)))
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    df = spark.createDataFrame([(n, x - (1 << 64) if x >> 63 else x) for n, x in fp.items()], "node long, fp long")
    got = {r.node: r.component for r in components(simhash.link(df, t)).collect()}
    want = linked(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= t])
    assert {n: got.get(n, n) for n in fp} == want


def test_near_texts(spark, sf, odd, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.id: r.component_id for r in simhash.near_texts(docs).collect()}
    s = {d: simhash.shingle_set(t, 5) for d, t in texts.items()}
    same = lambda a, b: texts[a] == texts[b] or (len(s[a]) and len(s[b]) and simhash.jaccard(s[a], s[b]) >= 0.8)
    want = linked(s, [(a, b) for a in s for b in s if a < b and same(a, b)])
    apart = [d for d in s if got[d] == d and want[d] != d]
    assert not [d for d in s if got[d] != want[d] and d not in apart]  # nothing is linked that is not near
    assert not apart  # and no link is lost
    assert simhash.near_texts(odd).count() == odd.count()


def test_near_texts_loses_no_pair(spark):
    """Appended tails and rewritten passages of a fifth and less, in texts of 20 to 1000 words: every pair with the share is linked."""
    rnd = random.Random(8)
    word = lambda: f"w{min(int(rnd.paretovariate(0.7)), 5000)}"
    rows = []
    for n in (20, 100, 300, 1000):
        for _ in range(25):
            base = [word() for _ in range(n)]
            at = rnd.randrange(n - n // 12)
            rows.append(" ".join(base))
            rows.append(" ".join(base + [word() for _ in range(n // 5)]))
            rows.append(" ".join(base[:at] + [word() for _ in range(n // 12)] + base[at + n // 12 :]))
    rows += [" ", "", "\t", "lone", "LONE"]
    s = [simhash.shingle_set(t, 5) for t in rows]
    want = linked(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if simhash.jaccard(s[a], s[b]) >= 0.8])
    got = {r.id: r.component_id for r in simhash.near_texts(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == want and sum(want[d] != d for d in want) > 100


def test_outlines_lose_no_pair():
    rng = np.random.default_rng(6)
    some = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    lost = ruled = 0
    for n in (1, 5, 100, 3000, 90_000):
        x = np.unique(some(n))
        sets = [x, np.unique(np.concatenate([x[: int(n * 0.9)], some(n - int(n * 0.9))])), np.unique(some(n)), np.zeros(0, dtype=np.uint64)]
        o = [simhash.outline(s) for s in sets]
        for i in range(4):
            for j in range(4):
                size = lambda k: np.array([len(sets[k])])  # noqa: E731, B023
                may = simhash.may_share(pd.Series([o[i]]), pd.Series([o[j]]), size(i), size(j), 0.8)[0]
                lost += not may and simhash.jaccard(sets[i], sets[j]) >= 0.8
                ruled += not may
    assert not lost and ruled >= 12


@pytest.mark.parametrize(("group", "listed"), [(512, 4096), (7, 4096), (7, 5)])
def test_near_texts_dense(spark, monkeypatch, group, listed):
    """Many texts near the share: compared together, in blocks too, and without lists, to the same end."""
    monkeypatch.setattr(simhash, "LISTED", listed)
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        at = rnd.randrange(100)
        t[at : at + 9] = [f"x{i}-{j}" for j in range(9)]
        rows.append((i, " ".join(t)))
    s = [simhash.shingle_set(t, 5) for _, t in rows]
    want = linked(range(60), [(a, b) for a in range(60) for b in range(a) if simhash.jaccard(s[a], s[b]) >= 0.8])
    monkeypatch.setattr(simhash, "GROUP", group)
    got = {r.id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 1 < len(set(want.values())) < 60


def test_near_texts_tries_only_what_length_allows(spark, monkeypatch):
    """Texts of far lengths that share a passage are no candidates: their outlines and sets are never joined."""
    rows, sizes, real = [], {}, simhash.written
    for p in range(10):
        passage = [f"p{p}-{i}" for i in range(36)]
        rows += [(4 * p + k, " ".join(passage + [f"t{p}-{k}-{i}" for i in range(n)])) for k, n in enumerate((4, 50, 160, 400))]

    def counted(df, tag):
        out = real(df, tag)
        sizes[tag] = out.count()
        return out

    monkeypatch.setattr(simhash, "written", counted)
    got = {r.id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d for d, _ in rows} and sizes["tried"] == 0


def test_long_texts_with_common_shingles_are_ruled_out_by_parities(spark, monkeypatch):
    """Texts joined by common shingles only: their sets are not sent to blocks of all others, and near ones are linked."""
    rnd, rows, sizes, real = random.Random(5), [], {}, simhash.written
    common = [" ".join(f"c{i}-{j}" for j in range(5)) for i in range(40)]
    for d in range(80):
        rows.append((d, " ".join(x for i in range(60) for x in (rnd.choice(common), f"own{d}-{i}"))))
    rows += [(100 + d, t.replace(f"own{d}-3 ", "")) for d, t in rows[:20]]
    s = {d: simhash.shingle_set(t, 5) for d, t in rows}
    want = linked(s, [(a, b) for a in s for b in s if a < b and simhash.jaccard(s[a], s[b]) >= 0.8])

    def counted(df, tag):
        out = real(df, tag)
        sizes[tag] = out.count()
        return out

    monkeypatch.setattr(simhash, "written", counted)
    monkeypatch.setattr(simhash, "LISTED", 3)
    monkeypatch.setattr(simhash, "OFTEN", 1000)
    got = {r.id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 10 < sum(want[d] != d for d in want) and sizes["near"] <= 100 and not sizes.get("dense")


def test_parities_lose_no_pair():
    rng = np.random.default_rng(6)
    some = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    for n in (1, 3, 60, 70, 1000, 5000):
        x = np.unique(some(n))
        sets = [x, *[np.unique(np.concatenate([x[: int(n * f)], some(k)])) for f, k in ((0.95, n // 20), (1, n // 5), (0.82, 0), (0.5, n // 2))], np.unique(some(n)), np.unique(some(2 * n))]
        of, odd = np.array([len(s) for s in sets]), [simhash.parity(s) for s in sets]
        want = {(i, j) for i in range(7) for j in range(i) if simhash.jaccard(sets[i], sets[j]) >= 0.8}
        for side in (None, np.arange(7) % 2):
            a, b, many = simhash._near_parities(np.arange(7), of, odd, np.arange(7), side, 0.8)
            got = {(max(p), min(p)) for p in zip(a, b)}
            assert not many and {p for p in want if side is None or side[p[0]] != side[p[1]]} <= got and (n < 1000 or not got & {(5, 0), (6, 0)})


def test_near_texts_by_simhash(spark, monkeypatch):
    """Texts within two bits are found by fingerprints, without the shingles of prefixes; the step links no others."""
    rnd, rows = random.Random(3), []
    for i in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(400)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words, "tail"])), (10 * i + 2, " ".join(["head", *words]))]
    s, fp = {d: simhash.shingle_set(t, 5) for d, t in rows}, {d: slow_print(t, 5) for d, t in rows}
    assert all(simhash.print_of(simhash.shingle_hashes(t, 5)) == fp[d] for d, t in rows)
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2 and simhash.jaccard(s[a], s[b]) >= 0.8]
    want = linked(fp, near)
    monkeypatch.setattr(simhash, "_shared", lambda index, _: spark.createDataFrame([], "pair boolean, h long, a long, b long, n long, pos long"))
    got = {r.id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(want[d] != d for d in want) > 5


@pytest.mark.parametrize("listed", [4096, 4])
def test_shared_shingles_lose_no_pair(spark, monkeypatch, listed):
    """Each pair of a shingle's texts that length and place allow is tried or left with its shingle, in batches of any size."""
    rnd = random.Random(listed)
    n = [rnd.randint(20, 40) for _ in range(60)]
    comp = [rnd.randrange(60) for _ in range(60)]
    rows = [(h, d, n[d], rnd.randrange(8), comp[d]) for h in range(-20, 20) for d in rnd.sample(range(60), rnd.choice((1, 1, 2, 3, 5, 40)))]
    monkeypatch.setattr(simhash, "LISTED", listed)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = simhash._shared(spark.createDataFrame(rows, "h long, node long, n long, pos long, comp long"), 0.8).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    tried, left = {(r.a, r.b) for r in got if r.pair}, Counter((r.h, r.a) for r in got if not r.pair)
    may = lambda x, y: x[4] != y[4] and min(x[2] - x[3], y[2] - y[3]) * 1.8 >= 0.8 * (x[2] + y[2]) - 1e-6
    pairs = [(x, y) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and may(x, y)]
    assert pairs and all((x[1], y[1]) in tried or (left[x[0], x[1]] and left[y[0], y[1]]) for x, y in pairs)
    assert tried <= {(x[1], y[1]) for x, y in pairs} and max(left.values()) == 1


# -- the pipeline ---------------------------------------------------------------------------------------------------
def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "sentencepiece"]
    out = p.run(spark, sf)
    assert out.count() > 0 and out.where("not exact and n_tokens = 0").count() == 0
    left = p.drop_near_copies(spark, docs, sf)
    assert left.columns == list(p.COLUMNS) and 0 < left.count() < docs.count()
    empty = docs.limit(0)
    assert all(f(spark, empty, sf).count() == 0 for _, f in p.STAGES)


def test_pipeline_cuts_repeats_with_one_python_worker_a_task(spark, sf):
    """A second function behind the first would keep two workers beside the executor for each core."""
    import corpus_pipeline as p

    out = p.drop_repeats(spark, spark.createDataFrame([(1, "é" * 80, "en", "x", 0), (2, "a" + "é" * 80 + "b", "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long"), sf)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = repeats_of([(1, "é" * 80), (2, "a" + "é" * 80 + "b")], 100)
    assert {r.doc_id: r.text for r in out.collect()} == {i: k.decode("utf-8", "ignore") for i, _, _, _, k in want}


def test_pipeline_stages_odd_rows(spark, sf, odd):
    """Null ids, texts and sources, repeated rows and ids, extra columns: what each stage's docstring says."""
    import corpus_pipeline as p

    near = " ".join(f"w{i}" for i in range(60))
    more = [(1, "one text of its own", "en", "x", 0), (1, near, "en", "x", 0), (1, near + " tail", "en", "x", 0), (None, near + " end", "en", None, 0), (50, near, "en", "x", 0), (51, "", "en", "x", 0)]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    clean = p.drop_toxic(spark, docs, sf)
    assert clean.columns == list(p.COLUMNS) and clean.count() == docs.count()
    left = p.drop_near_copies(spark, docs, sf).collect()
    got = Counter((r.doc_id, r.text) for r in left)
    first = min((near, near + " tail"), key=sha)
    assert got == Counter({(0, ""): 1, (3, "a"): 1, (4, "a" * 5000): 1, (5, ODD[5]): 1, (6, ODD[6]): 1, (7, ODD[7]): 1, (8, ODD[8]): 1, (None, "lone"): 1, (1, "one text of its own"): 1, (1, first): 1})
    assert p.drop_repeats(spark, docs, sf).count() == docs.count()
    mixed = p.mix_sources(spark, docs, sf)
    assert mixed.columns == list(p.COLUMNS) and mixed.where("n_chars = 0").isEmpty() and not mixed.isEmpty()
    ids = p.tokenize(spark, docs, sf)
    assert ids.count() == docs.count() and ids.where("text is not null").isEmpty() if "text" in ids.columns else ids.where("n_tokens = 0 and not exact").isEmpty()


def test_pipeline_stages_equal_brute_force(spark, sf, monkeypatch):
    """The rows of every stage of one run against plain Python, with no tolerance."""
    import sentencepiece as library

    import corpus_pipeline as p

    folder = work_dir(spark, "test-pipeline")
    monkeypatch.setattr(p, "work_dir", lambda *_: folder)
    out = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.exact) for r in p.run(spark, sf).collect())
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    of = lambda name: spark.read.parquet(f"{folder}/{name}")
    rows = lambda df: [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]
    # toxicity: the learned lexicon, row by row
    lexicon = toxicity.learn(raw, spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out("doc_id")))
    docs = [(d, t, la, so, len(t or "")) for d, t, la, so, _ in rows(raw) if lexicon.score(t) < 0.7]
    assert 0 < len(docs) < raw.count() and Counter(rows(of("toxicity"))) == Counter(docs)
    # near copies: every pair
    s = {d: simhash.shingle_set(t, 5) for d, t, *_ in docs}
    text = {d: t or "" for d, t, *_ in docs}
    root = linked(s, [(a, b) for a in s for b in s if a < b and (text[a] == text[b] or simhash.jaccard(s[a], s[b]) >= 0.8)])
    docs = [r for r in docs if root[r[0]] == r[0]]
    assert len(docs) < len(s) and Counter(rows(of("simhash_near_dedup"))) == Counter(docs)
    # repeated strings
    left = {i: k.decode("utf-8", "ignore") for i, _, _, _, k in repeats_of(sorted((r[0], r[1] or "") for r in docs), 100)}
    docs = [(d, left[d], la, so, len(left[d])) for d, _, la, so, _ in docs]
    assert Counter(rows(of("suffix_array_dedup"))) == Counter(docs)
    # mixing: the slots' words, cut into documents by their order in the source
    src, at = mixing.named_rows(of("suffix_array_dedup"))
    mixed, slots = mixing.mix(src, "_row", at["text"], at["source"], mixing.BLOCK)
    begin = {tuple(r.id): (r.sid, r.begin) for r in mixed.collect()}
    streams, size, kept = defaultdict(list), {}, {tuple(r._row): Row(**{c: r[n] for c, n in at.items()}) for r in src.collect()}
    for i in sorted(kept, key=begin.get):
        words = re.findall(r"[^\x20\x09-\x0D]+", kept[i].text)
        size[i] = len(words)
        streams[begin[i][0]] += [(i, w) for w in words]
    uses, given = defaultdict(list), defaultdict(list)
    for r in slots.collect():
        uses[r.sid, r["index"]].append(r.n_words)
    for sid, index in sorted(uses):
        for turn, n in enumerate(sorted(uses[sid, index], reverse=True)):
            for i, w in streams[sid][index * mixing.BLOCK : index * mixing.BLOCK + n]:
                given[i, turn].append(w)
    docs = []
    for (i, _), words in given.items():
        t = kept[i].text if len(words) == size[i] else " ".join(words)
        docs.append((kept[i].doc_id, t, kept[i].lang, kept[i].source, len(t)))
    assert Counter(rows(of("mixing"))) == Counter(docs)
    # token ids
    lib = library.SentencePieceProcessor(model_file=tokenizer_files.path("piece_bpe_32k.model"))
    ids = [(d, lib.encode(t), t) for d, t, *_ in docs]
    assert out == Counter((d, len(x), tuple(x), lib.decode(x) == t) for d, x, t in ids)


def test_no_more_operators_and_clean_imports():
    assert sorted(queries.QUERIES) == sorted(k for k in queries.QUERIES if k.startswith("op")) and len(queries.QUERIES) == 10
    root = Path(__file__).resolve().parents[2] / "heliotrope"
    for f in root.rglob("*.py"):
        if os.sep + "llm" + os.sep not in str(f):
            assert not re.search(r"\bllm\b", f.read_text()), f


def test_dense_shingle_stops_once_joined(monkeypatch):
    """A shingle whose texts all may have the share gives a forest of them without looking at every pair."""
    import numpy as np

    from heliotrope.llm import simhash

    c, looks, places = 2000, [], np.flatnonzero
    monkeypatch.setattr(simhash.np, "flatnonzero", lambda a: looks.append(1) or places(a))
    a, b, many = simhash._candidates(np.arange(c), np.full(c, 20), np.zeros(c, dtype=np.int64), np.arange(c), 0.8)
    assert many and len(a) == c - 1 and {*a, *b} == set(range(c))
    assert len(looks) < 20
