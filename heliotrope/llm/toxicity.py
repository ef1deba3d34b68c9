"""Toxicity by a weighted lexicon that Aho-Corasick matches in folded text.

Folding: lower case, look-alike letters of other scripts and full-width forms to Latin ones, digits and signs used as
letters (1d10t, $tup1d) to those, all else to single spaces. The lexicon is learned from labelled rows: whole words and
word beginnings of PREFIX letters, weighted by smoothed log-odds; toxic counts are of families of near copies (rows with
the same least word hash), so that a text copied often does not make a lexicon. Of patterns that start alike the most
telling stays. Exception phrases are words with a match, alone or with a neighbour, that toxic rows show hardly more often
than clean ones (log-odds up to MOST_ODDS); a match inside one does not count. The score is a logistic function of the log of the summed weights and of that
sum per word.

Which patterns are kept is a matter of evidence, not of rank: a pattern is in LEAST and in SHARE of the toxic families,
its log-odds are LEAST_ODDS, and by chance (a Chernoff bound on the binomial tail, times the number of patterns tried)
CHANCE patterns at most would have as many toxic families. As each is in SHARE of the families, there are at most 1 / SHARE
times as many as an average toxic text has, whatever the number of rows; so they can be broadcast. Counts cover all
labelled rows; only the three numbers of the logistic function are fitted on a sample, of about SAMPLE rows of each
class, chosen by hash.

Cases: null and empty texts score as texts without a match; labels that are null, and rows without a label, teach
nothing; without toxic or without clean rows to learn from, or without a telling pattern, every score is near 0;
repeated labels of a row count once (toxic wins a tie); repeated rows of documents are scored each; very long texts are
folded whole; empty tables give no rows; other columns pass through score() untouched, one that has the name of the
result under that name with underscores behind it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, freed, join_checked, lean, narrow_batches, written

PREFIX = (4, 5, 6)
#: Labelled rows of each class, about, that the logistic function is fitted on.
SAMPLE = 20_000
#: A pattern must appear in as many families of toxic rows, and in this share of them.
LEAST, SHARE = 3, 0.005
#: Least log-odds of a pattern, and how many patterns may be expected to get as far by chance.
LEAST_ODDS, CHANCE = 2.0, 1.0
#: Log-odds up to which a phrase with a match is an exception: toxic rows have it hardly more often than clean ones.
MOST_ODDS = 1.0
CUT = 0.7
#: Rows of a frame that a worker gives back.
ROWS = 10_000

_LOOK = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n", "օ": "o", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "ℓ": "l",
}
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}
_DROP = dict.fromkeys(["­", "​", "‌", "‍", "⁠", "﻿"], "")


class _Fold(dict):
    """What each code point becomes, found once. Digits and signs become letters; other non-letters a space."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp).lower()
        if 0xFF01 <= cp <= 0xFF5E:
            c = chr(cp - 0xFEE0).lower()
        c = _DROP.get(c, _LOOK.get(c, c))
        c = _LEET.get(c, c)
        if c and not c.isalpha() and not all(0x300 <= ord(x) <= 0x36F or x.isalpha() for x in c):
            c = " "
        self[cp] = c
        return c


_FOLD = _Fold()
#: Signs that end a word when nothing but a space follows are punctuation, not letters: stupid! is stupid.
_TAIL = re.compile(r"[!|$@€£]+(?=\s|$)|(?<![^\s])[!|€£]+")


def folded(text: str | None) -> str:
    """' word word ... ' in the letters that the lexicon knows."""
    text = text or ""
    if "!" in text or "|" in text or "$" in text or "@" in text or "€" in text or "£" in text:
        text = _TAIL.sub(" ", text)
    return " " + " ".join(text.translate(_FOLD).split()) + " "


def features(words: set[str]) -> set[str]:
    """Whole words as ' word ', word beginnings as ' word'."""
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in PREFIX if len(w) >= n}


class Lexicon:
    """Weights of patterns, exception phrases and the logistic function; the automaton is made where it is used."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), slopes: tuple[float, float, float] | None = None):
        self.weights, self.exceptions, self.slopes = weights, exceptions, slopes or (0.0, 0.0, -20.0)
        self._machine = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "slopes": self.slopes, "_machine": None}

    def machine(self):
        import ahocorasick

        if self._machine is None:
            m = ahocorasick.Automaton()
            for p, w in self.weights.items():
                m.add_word(p, (len(p), w))
            for p in self.exceptions:
                if f" {p} " not in self.weights:
                    m.add_word(f" {p} ", (len(p) + 2, None))
            m.make_automaton()
            self._machine = m
        return self._machine

    def matches(self, text: str) -> dict[int, float]:
        """Place of each matched word -> its greatest weight, without those inside an exception phrase."""
        if not self.weights:
            return {}
        hits, spared = {}, []
        for end, (size, w) in self.machine().iter(text):
            begin = end - size + 1
            if w is None:
                spared.append((begin, end))
            elif w > hits.get(begin, 0.0):
                hits[begin] = w
        for at, end in spared:
            while 0 <= at < end:  # each word of the phrase
                hits.pop(at, None)
                at = text.find(" ", at + 1)
        return hits

    def measure(self, t: str) -> tuple[float, float]:
        """Of a folded text: the log of the summed weights, and of that sum per word."""
        total = sum(self.matches(t).values())
        return math.log1p(total), math.log1p(1000.0 * total / (t.count(" ") + 20))

    def score(self, text: str | None) -> float:
        a, b, c = self.slopes
        x, y = self.measure(folded(text))
        z = max(-60.0, min(60.0, a * x + b * y + c))
        return 1.0 / (1.0 + math.exp(-z))


def _family(words: set[str]) -> int:
    return min((zlib.crc32(w.encode()) for w in words), default=0)


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a light ridge and balanced classes, by Newton's method."""
    d = np.column_stack([x, np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    beta, ridge = np.zeros(3), np.array([1e-2, 1e-2, 1e-4])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(d @ beta, -40, 40)))
        g = d.T @ (w * (y - p)) - ridge * beta
        h = (d * (w * p * (1 - p))[:, None]).T @ d + np.diag(ridge)
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def _frames(**columns) -> Iterator[pd.DataFrame]:
    """Equally long columns as frames of ROWS rows, so that no text or partition makes one large frame."""
    n = len(next(iter(columns.values())))
    for i in range(0, n, ROWS):
        part = {k: v[i : i + ROWS] for k, v in columns.items()}
        yield pd.DataFrame({k: np.array(v, dtype=np.int64) if v and isinstance(v[0], int) else v for k, v in part.items()})


def _patterns(text: str) -> Column:
    """features() of a folded text, in DataFrame functions."""
    one = lambda w: F.array(F.when(F.length(w) > 2, F.concat(F.lit(" "), w, F.lit(" "))), *[F.when(F.length(w) >= n, F.concat(F.lit(" "), F.substring(w, 1, n))) for n in PREFIX])
    words = F.array_distinct(F.split(F.trim(F.col(text)), " "))
    return F.array_distinct(F.filter(F.flatten(F.transform(words, one)), lambda x: x.isNotNull()))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from the texts of docs that labels marks; the caller leaves out of labels what must not be learned from."""
    narrow_batches(docs.sparkSession)
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))

    @F.pandas_udf("t string, f long")
    @lean
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            t = [folded(x) for x in s]
            yield pd.DataFrame({"t": t, "f": np.array([_family(set(x.split())) for x in t], dtype=np.int64)})

    # texts are read and folded once; what follows reads the folded labelled rows
    rows = join_checked(rows, marks, "_id", "inner").withColumn("x", fold("_t"))
    rows = written(rows.select("_id", "y", "x.t", "x.f"), "labelled")
    n = {r.y: (r.n, r.f) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("f").alias("f")).collect()}  # two rows
    if 0 not in n or 1 not in n:
        dropped(rows)
        return Lexicon({}, exceptions)
    families, clean = n[1][1], n[0][0]
    need = max(LEAST, SHARE * families)
    # 1: patterns of enough toxic families: at most 1 / SHARE (or 200 / LEAST) times those of a text, so they are broadcast
    seen = rows.select("y", "f", F.explode(_patterns("t")).alias("p"))
    cand = seen.where("y = 1").select("p", "f").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
    cand = written(cand, "candidates")
    tried = cand.count()
    # 2: clean rows with each of them
    met = seen.where("y = 0").join(F.broadcast(cand.select("p")), "p").groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    both = cand.join(met, "p", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("m", F.col("n") + F.col("c"))
    odds = F.log((F.col("n") + 0.5) / F.lit(families + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(clean + 1.0))
    q = families / (families + clean)
    part = lambda x, p: F.when(x > 0, x * F.log(x / (F.col("m") * F.lit(p)))).otherwise(0.0)
    evidence = part(F.col("n"), q) + part(F.col("c"), 1 - q) - math.log(max(1, tried))
    told = both.withColumn("w", odds).where((F.col("w") >= LEAST_ODDS) & (evidence >= -math.log(CHANCE))).select("p", "w").collect()
    dropped(cand)
    lex = Lexicon(_thinned({r.p: r.w for r in told}), exceptions)

    # 3: exception phrases, in SHARE of the clean rows that have a match, and a bounded sample of measures
    @lean
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for t, y in zip(b["t"], b["y"]):
                mine = set()
                for at in lex.matches(t):
                    before, rest = t[:at].rsplit(" ", 1)[-1], t[at + 1 :].split(" ", 2)
                    mine |= {rest[0], f"{before} {rest[0]}".strip(), " ".join(rest[:2]).strip()}
                if mine:
                    c.update((p, int(y)) for p in mine | {""})
            yield from _frames(p=[p for p, _ in c], y=[y for _, y in c], k=list(c.values()))

    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("k")).otherwise(0))
    phrases = rows.select("t", "y").mapInPandas(pairs, "p string, y long, k long").groupBy("p").agg(of(0).alias("c"), of(1).alias("t"))
    phrases = written(phrases, "phrases")
    every = phrases.where("p = ''").first()
    if every:
        odds = F.log((F.col("t") + 0.5) / F.lit(n[1][0] + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(clean + 1.0))
        kept = phrases.where((F.col("p") != "") & (odds <= MOST_ODDS) & (F.col("c") >= max(LEAST, SHARE * every.c))).collect()
        lex = Lexicon(lex.weights, tuple(sorted({*exceptions, *(r.p for r in kept)})))
    dropped(phrases)

    @lean
    def measures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.array([lex.measure(t) for t in b["t"]], dtype=np.float64).reshape(-1, 2)
            yield pd.DataFrame({"x": m[:, 0], "z": m[:, 1], "y": b["y"]})

    upto = F.when(F.col("y") == 1, F.lit(_share(SAMPLE, n[1][0]))).otherwise(F.lit(_share(SAMPLE, clean)))
    got = rows.where(F.xxhash64("_id") <= upto).select("t", "y").mapInPandas(measures, "x double, z double, y int").toPandas()
    dropped(rows)
    if got.y.nunique() < 2:
        return Lexicon({}, exceptions)
    return Lexicon(lex.weights, lex.exceptions, _fit(got[["x", "z"]].to_numpy(), got.y.to_numpy()))


def _share(sample: int, n: int) -> int:
    """The 64-bit hash below which lies about a sample's share of n rows."""
    return int(-(2**63) + min(1.0, sample / max(1, n)) * (2**64 - 1)) if n > sample else 2**63 - 1


def _thinned(weights: dict[str, float]) -> dict[str, float]:
    """Longer patterns go where a beginning of theirs that tells as much is there, and beginnings that only one longer
    pattern makes up go for that one."""
    out = {}
    for p in sorted(weights, key=lambda p: (len(p), p)):
        starts = [p[:k] for k in range(2, len(p)) if p[:k] in out]
        if not any(out[s] >= weights[p] - 0.5 for s in starts):
            out[p] = weights[p]
    return out


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    narrow_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(lexicon)  # bounded by SHARE, see above

    @F.pandas_udf("double")
    @lean
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([held.value.score(t) for t in s], dtype="float64")

    df, name = freed(df, out), text + "_" * (text.lower() == out.lower())
    return df.withColumn(out, of(name))


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
