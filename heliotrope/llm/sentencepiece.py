"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of a batch are one flat numpy array of symbols. Each round finds every word's least pair rank (a segmented
minimum), merges all its leftmost occurrences at once, compacts, and looks up only pairs beside a merge; words in which
no pair is left go. Ties of scores and pairs that a merge creates with a rank as good are taken one at a time, so ids
equal those of the library's one-by-one queue.

Cases: null or empty text gives no ids and decodes to the empty text; texts may have any length (each word is encoded
once and reused while the word table stays within its bound, which affects speed only); ids are per row, so repeated
rows, ties and empty tables need nothing special; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import lean, narrow_batches

SPACE = "▁"
NONE = np.int64(1 << 40)
#: Symbols (ids) the table of encoded words may hold before it starts anew.
TABLE_IDS = 1_000_000
#: Characters of text handled at a time.
CHUNK_CHARS = 500_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)

codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    i, n = 0, len(buf)

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            byte = buf[i]
            i += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, buf[i : i + size]
            i += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if size == 4 else "<d", buf[i : i + size])[0]
            i += size


class Model:
    """A BPE model with byte fallback and the identity normaliser; others are refused with ValueError."""

    def __init__(self, data: bytes):
        pieces, trainer, normal = [], {}, {}
        for k, v in _fields(data):
            if k == 1:
                f = dict(_fields(v))
                pieces.append((f[1].decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normal = dict(_fields(v))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("only BPE models with byte fallback are supported")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only the identity normaliser with escaped, kept white space is supported")
        if any(t in (USER, UNUSED) for _, _, t in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy = bool(normal.get(3, 1))
        self.size = size = len(pieces)
        self.types = np.array([t for _, _, t in pieces], dtype=np.int8)
        ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i, (p, _, t) in enumerate(pieces):
            if t == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        symbol = lambda s: ids.get(s, size + ord(s) if len(s) == 1 else None)
        #: A merge may join pieces across a word start only if some piece holds a space after another sign.
        self.whole = any(SPACE in p.lstrip(SPACE) for p in ids)
        scores = sorted({s for _, s, t in pieces if t == NORMAL}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        keys, ranks, to = [], [], []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                x, y = symbol(p[:cut]), symbol(p[cut:])
                if x is not None and y is not None:
                    keys.append((x << 32) | y)
                    ranks.append(rank[pieces[i][1]])
                    to.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks, self.to = np.array(ranks, dtype=np.int64)[order], np.array(to, dtype=np.int64)[order]
        self._table()
        self.symbols = np.arange(size, size + 0x110000, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        # Long runs of spaces: cut to what can still touch the word's merges, if the runs of 2, 3, ... spaces are the
        # only pieces that begin with two spaces and have the worst score of all.
        runs = sorted(len(p) for p in ids if len(p) > 1 and not p.strip(SPACE))
        self.run = 0
        if runs and runs == list(range(2, runs[-1] + 1)) and {pieces[ids[SPACE * n]][1] for n in runs} == {scores[-1]} and sum(p.startswith(SPACE * 2) for p in ids) == len(runs):
            self.run, self.run_id = runs[-1], ids[SPACE * runs[-1]]
        surface = [b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])]).astype(np.int64)
        self.reset()

    # -- pairs ------------------------------------------------------------------------------------------------
    def _table(self) -> None:
        """Open addressing with linear probes, filled and read in vector steps."""
        self.bits = max(4, int(len(self.keys) * 4).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_at = np.zeros(1 << self.bits, dtype=np.int64)
        left, at = np.arange(len(self.keys)), self._hash(self.keys)
        while len(left):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = self.keys[left[free]]
            self.slot_at[at[free]] = left[free]
            lost = self.slot_key[at] != self.keys[left]
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no piece) and merged piece of each pair."""
        key = (x << 32) | y
        at = self._hash(key)
        rank, to = np.full(len(key), NONE), np.zeros(len(key), dtype=np.int64)
        left = np.arange(len(key))
        while len(left):
            found = self.slot_key[at]
            hit = found == key[left]
            k = self.slot_at[at[hit]]
            rank[left[hit]], to[left[hit]] = self.ranks[k], self.to[k]
            go = ~hit & (found >= 0)
            left, at = left[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return rank, to

    # -- encoding ---------------------------------------------------------------------------------------------
    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of each."""
        n = len(words)
        sym = self.symbols[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
        word = np.repeat(np.arange(n), np.fromiter(map(len, words), dtype=np.int64, count=n))
        done_sym, done_word = [], []
        rank, to = np.full(len(sym), NONE), np.zeros(len(sym), dtype=np.int64)
        dirty = np.arange(len(sym))
        while len(sym):
            ok = dirty[dirty + 1 < len(sym)]
            ok = ok[word[ok] == word[ok + 1]]
            rank[dirty] = NONE
            rank[ok], to[ok] = self.pairs(sym[ok], sym[ok + 1])
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == NONE, np.diff(np.append(first, len(sym))))
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                stay = ~over
                sym, word, rank, to = sym[stay], word[stay], rank[stay], to[stay]
                if not len(sym):
                    break
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                least = least[least < NONE]
            size = len(sym)
            ordinal = np.repeat(np.arange(len(first)), np.diff(np.append(first, size)))
            cand = rank == least[ordinal]
            at = np.flatnonzero(cand)
            # of a run of overlapping candidates every second one, from the left
            head = np.concatenate([[True], at[1:] != at[:-1] + 1])
            begin = at[np.flatnonzero(head)][np.cumsum(head) - 1]
            at = at[(at - begin) % 2 == 0]
            made = to[at]
            chosen = np.full(size + 4, -1, dtype=np.int64)
            chosen[at] = made
            r = least[ordinal[at]]
            bad = np.zeros(len(at), dtype=bool)
            has = (at > 0) & (word[at - 1] == word[at])
            prev = at[has] - 1
            before = np.where((prev > 0) & (chosen[prev - 1] >= 0), chosen[prev - 1], sym[prev])
            bad[has] = self.pairs(before, made[has])[0] <= r[has]
            nxt = np.minimum(at + 2, size - 1)
            has = (at + 2 < size) & (word[nxt] == word[at])
            bad[has] |= self.pairs(made[has], sym[at[has] + 2])[0] <= r[has]
            if bad.any():
                slow = np.zeros(len(first), dtype=bool)
                slow[ordinal[at[bad]]] = True
                mine = ordinal[at]
                lead = np.concatenate([[True], mine[1:] != mine[:-1]])
                take = ~slow[mine] | lead
                at, made = at[take], made[take]
            sym[at] = made
            stay = np.ones(size, dtype=bool)
            stay[at + 1] = False
            touched = np.zeros(size, dtype=bool)
            touched[at] = True
            prev = at - 1
            touched[prev[prev >= 0]] = True
            prev = at - 2  # if the sign before was merged away, the symbol it joined
            touched[prev[prev >= 0]] = True
            sym, word, rank, to = sym[stay], word[stay], rank[stay], to[stay]
            dirty = np.flatnonzero(touched[stay])
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, dtype=np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, dtype=np.int64)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        strange = np.flatnonzero(sym >= self.size)
        if len(strange):
            cps = (sym[strange] - self.size).astype("<u4")
            sizes = 1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)
            grow = np.ones(len(sym), dtype=np.int64)
            grow[strange] = sizes
            where = np.repeat(sym >= self.size, grow)
            word, sym = np.repeat(word, grow), np.repeat(sym, grow)
            sym[where] = self.byte_ids[np.frombuffer(cps.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)]
        return sym.astype(np.int32), np.bincount(word, minlength=n)

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.at = np.zeros(1, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        fresh = list(dict.fromkeys(w for w in words if w not in self.known))
        if not fresh:
            return
        base = len(self.known)
        self.known.update(zip(fresh, range(base, base + len(fresh))))
        cut = [0] * len(fresh)
        if self.run:
            for k, w in enumerate(fresh):
                if w.startswith(SPACE * (3 * self.run)):
                    spaces = len(w) - len(w.lstrip(SPACE))
                    cut[k] = (spaces - 2 * self.run) // self.run
                    fresh[k] = w[cut[k] * self.run :]
        ids, sizes = self.merge_words(fresh)
        if any(cut):
            begin = np.repeat(np.cumsum(sizes) - sizes, cut)
            ids, sizes = np.insert(ids, begin, self.run_id), sizes + np.array(cut)
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as the library's encode without begin or end ids."""
        out, i = [], 0
        split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        while i < len(texts):
            group, chars = [], 0
            while i < len(texts) and (not group or chars + len(texts[i] or "") <= CHUNK_CHARS):
                group.append(texts[i] or "")
                chars += len(group[-1])
                i += 1
            words, counts = [], []
            for t in group:
                mine = []
                if t:
                    t = (SPACE if self.dummy else "") + t.replace(" ", SPACE)
                    mine = [t] if self.whole else split(t)
                words += mine
                counts.append(len(mine))
            if len(self.ids) > TABLE_IDS:
                self.reset()
            self._learn(words)
            code = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            ids, sizes = ragged(self.ids, self.at, code)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
            out += np.split(ids, ends[:-1])
        return out

    # -- decoding ---------------------------------------------------------------------------------------------
    def decode(self, rows: list[np.ndarray | None]) -> list[str]:
        """The text of each list of ids, as the library's decode; ids out of range raise ValueError."""
        out = []
        for ids in rows:
            ids = np.asarray(ids if ids is not None else [], dtype=np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
                raise ValueError("id out of range")
            text = ragged(self.surface, self.surface_at, ids)[0].tobytes().decode("utf-8", "one_by_one")
            if self.dummy and text[:1] == " ":
                seen = ids[self.types[ids] != CONTROL]
                if self.types[seen[0]] == NORMAL:
                    text = text[1:]
            out.append(text)
        return out


def ragged(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[at[r]:at[r + 1]] for each r of rows, joined, and their sizes."""
    sizes = at[rows + 1] - at[rows]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(at[rows] - (ends - sizes), sizes)], sizes


_models: dict[bytes, Model] = {}


def _model(data: bytes) -> Model:
    if data not in _models:
        _models.clear()
        _models[data] = Model(data)
    return _models[data]


def _held(df: DataFrame, model_file: str):
    with open(model_file, "rb") as f:
        data = f.read()
    narrow_batches(df.sparkSession)
    Model(data)  # refuses what is not supported here rather than on an executor
    return df.sparkSession.sparkContext.broadcast(data)  # the model's size, whatever the input's


def _udf(df: DataFrame, model_file: str, kind: str):
    held = _held(df, model_file)

    @lean
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = _model(held.value)
        for s in batches:
            yield pd.Series(m.encode([None if x is None or x != x else x for x in s]), index=s.index, dtype=object)

    @lean
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = _model(held.value)
        for s in batches:
            yield pd.Series(m.decode(list(s)), index=s.index, dtype=object)

    return F.pandas_udf(encode, "array<int>") if kind == "encode" else F.pandas_udf(decode, "string")


def encode(df: DataFrame, text: str | Column, model_file: str, out: str = "ids") -> DataFrame:
    """df with the ids of each text in the column out (array<int>, never null)."""
    return df.withColumn(out, _udf(df, model_file, "encode")(F.col(text) if isinstance(text, str) else text))


def decode(df: DataFrame, ids: str | Column, model_file: str, out: str = "decoded") -> DataFrame:
    """df with the text of each list of ids in the column out (null ids: the empty text)."""
    return df.withColumn(out, _udf(df, model_file, "decode")(F.col(ids) if isinstance(ids, str) else ids))


def round_trip(df: DataFrame, text: str, model_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the ids of each text and their decoding in one Python worker, a slice of a batch at a time; columns of
    these names are replaced, all others pass through as they are."""
    if text in (ids, decoded):
        raise ValueError("the text's column cannot be replaced")
    model, kept = _held(df, model_file), df.drop(ids, decoded)
    at = kept.columns.index(text)

    @lean
    def both(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        m = _model(model.value)
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + CHUNK_CHARS, side="right")))
                part = b.slice(i, j - i)
                got = m.encode(part.column(at).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got), type=pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat, pa.array(m.decode(got), type=pa.string())], names=[*part.schema.names, ids, decoded])
                i = j

    return kept.mapInArrow(both, T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = round_trip(docs, "text", model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
