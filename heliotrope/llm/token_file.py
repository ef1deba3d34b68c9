"""Token ids in Simple-8b word-aligned files.

A file holds documents in order; its ids are cut into blocks of BLOCK ids. A block is a run of 64-bit words: the
upper 4 bits select how many ids of how many bits share the other 60 (240 or 120 zeros, then 60 x 1, 30 x 2, 20 x 3,
15 x 4, 12 x 5, 10 x 6, 8 x 7, 7 x 8, 6 x 10, 5 x 12, 4 x 15, 3 x 20, 2 x 30, 1 x 60 bits). Ids of 2^60 and more are
escapes: they are written as 0 with position and value in the block's escape list. Words are aligned to 8 bytes.

Layout, little-endian: magic, counts (documents, those without an id, ids, blocks), then per document its id and end (8
+ 8 bytes; the first ones, without an id, have 0), per block the offset of its words and the number of its words and escapes, the escapes, the words. Offsets let a
reader decode any block alone; both directions work on whole arrays.

Encoding takes the library's ids of each text; texts are cut at ASCII white space, whose pieces the vocabulary's
tokenizer treats apart, and each different piece is encoded once while the table of pieces keeps its bound.

Cases: null and empty texts hold only the end id; documents without an id come before all others and read back as null;
repeated rows are documents of their own, those of one id ordered by the hash of their texts (so that one id may have any
number of rows) and then the text; very long texts are split over blocks but never cut;
empty tables give an empty manifest and no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._files import Committed, opened
from ._shared import lean, narrow_batches, shuffle_partitions, work_dir
from .sentencepiece import ragged

MAGIC = b"S8BIDS02"
BLOCK = 65_536
_BITS16 = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Ids gathered before a file is closed: about 32 MB in memory.
ROLL_IDS = 4_000_000
TABLE_IDS = 4_000_000
CHUNK_CHARS = 2_000_000


# -- Simple-8b ----------------------------------------------------------------------------------------------------
def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values, and the places of escapes (values of 2^60 and more)."""
    values = np.asarray(values, dtype=np.uint64)
    escapes = np.flatnonzero(values >> np.uint64(60))
    if len(escapes):
        values = values.copy()
        values[escapes] = 0
    n = len(values)
    if not n:
        return np.zeros(0, dtype=np.uint64), escapes
    if int(values.max()) < 1 << 16:
        bits = _BITS16[values]
    else:
        bits = np.zeros(n, dtype=np.uint8)
        for b in range(60):
            bits += values >= np.uint64(1) << np.uint64(b)
    # wide[k]: most bits among k values from each place on, from two overlapping shorter runs
    wide = {1: bits}
    choice = np.full(n, 15, dtype=np.uint8)
    for s in range(15, -1, -1):
        k = int(COUNT[s])
        if n < k:
            break
        if k > 1:
            h = max(x for x in wide if x < k)
            x = wide[h]
            wide[k] = np.maximum(x[: n - k + 1], x[k - h : k - h + n - k + 1])
        fits = np.flatnonzero(wide[k] <= BITS[s])
        if not len(fits):
            break  # more values of fewer bits fit nowhere either
        choice[fits] = s
    step, at, i = COUNT[choice].tolist(), [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    sel = choice[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            grid = values[at[mine][:, None] + np.arange(COUNT[s])]
            words[mine] |= np.bitwise_or.reduce(grid << (np.arange(COUNT[s]) * BITS[s]).astype(np.uint64), axis=1)
    return words, escapes


def unpack(words: np.ndarray) -> np.ndarray:
    """All values of the words, selectors together: one gather for each selector in use."""
    words = np.asarray(words, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    sizes = COUNT[sel]
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            shift = (np.arange(COUNT[s]) * BITS[s]).astype(np.uint64)
            out[at[mine][:, None] + np.arange(COUNT[s])] = (words[mine][:, None] >> shift) & np.uint64((1 << int(BITS[s])) - 1)
    return out


def dump(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """The bytes of a file: documents (the first `nulls` have no id), their ends in ids, and all ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    index, escapes, words, at = [], [], [], 0
    for i in range(0, len(ids), BLOCK):
        w, e = pack(ids[i : i + BLOCK])
        index.append((at, len(w), len(e)))
        escapes += [(p, ids[i + p]) for p in e]
        words.append(w)
        at += len(w)
    head = np.array([len(doc_ids), nulls, len(ids), len(index)], dtype="<u8")
    parts = [MAGIC, head.tobytes(), np.stack([np.asarray(doc_ids, dtype="<i8"), np.asarray(ends, dtype="<i8")], axis=1).astype("<i8").tobytes(), np.array(index, dtype="<u8").reshape(-1, 3).tobytes(), np.array(escapes, dtype="<u8").reshape(-1, 2).tobytes(), *(w.astype("<u8").tobytes() for w in words)]
    return b"".join(parts)


def load(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, ends and ids of a file, and how many documents at its begin have no id."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    d, nulls, n, b = map(int, np.frombuffer(data, dtype="<u8", count=4, offset=8))
    at = 40
    docs = np.frombuffer(data, dtype="<i8", count=2 * d, offset=at).reshape(-1, 2)
    at += 16 * d
    index = np.frombuffer(data, dtype="<u8", count=3 * b, offset=at).reshape(-1, 3).astype(np.int64)
    at += 24 * b
    esc = np.frombuffer(data, dtype="<u8", count=2 * int(index[:, 2].sum()), offset=at).reshape(-1, 2)
    at += 16 * len(esc)
    words = np.frombuffer(data, dtype="<u8", offset=at)
    out, e = np.zeros(n, dtype=np.uint64), 0
    for k, (off, count, ne) in enumerate(index):
        block = unpack(words[off : off + count])
        block = block[: min(BLOCK, n - k * BLOCK)]
        block[esc[e : e + ne, 0].astype(np.int64)] = esc[e : e + ne, 1]
        out[k * BLOCK : k * BLOCK + len(block)] = block
        e += ne
    return docs[:, 0], docs[:, 1], out, nulls


# -- the library's ids --------------------------------------------------------------------------------------------
class _Table(dict):
    """Numbers of texts in the order in which they first came; `fresh` are those without ids yet."""

    def __init__(self, *empty: str):
        """empty: texts without ids, known from the beginning."""
        super().__init__(zip(empty, range(len(empty))))
        self.fresh: list = []
        self.ids, self.at = np.zeros(0, dtype=np.int32), np.zeros(1 + len(empty), dtype=np.int64)

    def __missing__(self, text: str | bytes) -> int:
        self[text] = n = len(self)
        self.fresh.append(text)
        return n

    def numbers(self, texts: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, texts), dtype=np.int64, count=len(texts))

    def learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.fresh = []


#: Words of signs whose lower case, normal form and class are beyond doubt: printable ASCII, Latin and Cyrillic letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-žЀ-џ]*")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for plain words in lower case; a space ends a word.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+| ").findall


class Encoder:
    """Ids of whole texts as the library gives them without special tokens added.

    Words between ASCII white space, as bytes, are numbered by a table. New plain words are cut into the pieces that the
    tokenizer's pattern makes; the library encodes new pieces, many in one call: its end-of-word ids part them. Other
    new words are encoded one by one. Models that are not of this shape are refused."""

    def __init__(self, data: str):
        import json

        from tokenizers import Tokenizer

        j = json.loads(data)
        steps = [(n.get("type"), (n.get("pattern") or {}).get("Regex"), n.get("behavior"), n.get("invert")) for n in (j.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        normal = [n.get("type") for n in (j.get("normalizer") or {}).get("normalizers", [])]
        suffix = j["model"].get("end_of_word_suffix")
        if normal != ["NFC", "Replace", "Lowercase"] or steps[0] != ("Split", _SPLIT, "Removed", True) or not suffix or any(t.get("lstrip") or t.get("rstrip") for t in j.get("added_tokens") or []):
            raise ValueError("only tokenizers that lower-case, drop white space between pieces and mark ends of words are supported")
        self.tokenizer = Tokenizer.from_str(data)
        self.added = [t["content"] for t in j.get("added_tokens") or []]
        self.ends = np.zeros(1 + max([*j["model"]["vocab"].values(), *(t["id"] for t in j.get("added_tokens") or [])]), dtype=bool)
        self.ends[[i for t, i in j["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.words, self.pieces = _Table(), _Table(" ")

    def _learn_pieces(self) -> None:
        new = self.pieces.fresh
        calls = [" ".join(new[i : i + 1000]) for i in range(0, len(new), 1000)]
        ids = np.array([x for e in self.tokenizer.encode_batch_fast(calls, add_special_tokens=False) for x in e.ids], dtype=np.int64)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(new):
            raise ValueError("the tokenizer's pieces are not those expected")
        self.pieces.learn(ids, np.diff(last, prepend=-1))

    def _learn(self) -> None:
        new = [w.decode() for w in self.words.fresh]
        plain = list(map(bool, map(_PLAIN.fullmatch, new)))
        line = " ".join(new)
        if any(a in line for a in self.added):
            plain = [p and not any(a in w for a in self.added) for w, p in zip(new, plain)]
        parts = _PIECES(" ".join([w for w, p in zip(new, plain) if p]).lower() + " ")
        if len(self.pieces.ids) > TABLE_IDS:
            self.pieces = _Table(" ")
        code = self.pieces.numbers(parts)
        if self.pieces.fresh:
            self._learn_pieces()
        ids, sizes = ragged(self.pieces.ids, self.pieces.at, code)
        # pieces of each word: those between two spaces
        upto = np.cumsum(sizes)[code == 0]
        odd = [w for w, p in zip(new, plain) if not p]
        got = [np.array(e.ids, dtype=np.int64) for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)] if odd else []
        size = np.zeros(len(new), dtype=np.int64)
        is_plain = np.array(plain, dtype=bool)
        if is_plain.any():
            size[is_plain] = np.diff(upto, prepend=0)
        size[~is_plain] = [len(g) for g in got]
        out = np.zeros(int(size.sum()), dtype=np.int64)
        mine = np.repeat(is_plain, size)
        out[mine] = ids
        out[~mine] = np.concatenate(got) if got else np.zeros(0, dtype=np.int64)
        self.words.learn(out, size)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        i = 0
        while i < len(texts):
            words, counts, chars = [], [], 0
            while i < len(texts) and (not counts or chars + len(texts[i] or "") <= CHUNK_CHARS):
                mine = (texts[i] or "").encode().split()  # of bytes: at ASCII white space only
                words += mine
                counts.append(len(mine))
                chars += len(texts[i] or "") + 1
                i += 1
            if len(self.words.ids) > TABLE_IDS:
                self.words = _Table()
            code = self.words.numbers(words)
            if self.words.fresh:
                self._learn()
            ids, sizes = ragged(self.words.ids, self.words.at, code)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
            yield from np.split(ids, ends[:-1])


_encoders: dict[str, Encoder] = {}


def write(df: DataFrame, folder: str, tokenizer_file: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """Writes the files and returns their manifest (part: the task, file, documents, ids, crc32), also written to folder/manifest.
    Files in the order of their names hold the documents in ascending id order."""
    import os

    with open(tokenizer_file) as f:
        data = f.read()
    Encoder(data)
    spark = df.sparkSession
    narrow_batches(spark, 16 << 20)  # a call for new words costs the same for few and many
    held = spark.sparkContext.broadcast(data)  # the vocabulary's size
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    files = f"{folder}/ids"

    @lean
    def save(batches):
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if held.value not in _encoders:
            _encoders.clear()
            _encoders[held.value] = Encoder(held.value)
        encoder, part, done, docs, parts, size = _encoders[held.value], TaskContext.get().partitionId(), [], [], [], 0

        def flush():
            nonlocal docs, parts, size
            ends = np.cumsum([len(p) for p in parts])
            ids = np.concatenate(parts)
            out = Committed(files, f"part-{part:05d}-{len(done):05d}.s8b")
            missing = [d is None for d in docs]
            data = dump(np.array([0 if d is None else d for d in docs], dtype=np.int64), ends, ids, sum(missing))
            out.write(data)
            out.close()
            done.append((part, out.name, len(docs), len(ids), zlib.crc32(data)))
            docs, parts, size = [], [], 0

        end = np.array([end_id], dtype=np.int64)
        for b in batches:
            for doc, ids in zip(b.id.astype("Int64").tolist(), encoder.encode(b.text.tolist())):
                docs.append(None if doc is pd.NA else doc)
                parts.append(np.concatenate([ids, end]))
                size += len(parts[-1])
                if size >= ROLL_IDS:
                    flush()
        if docs:
            flush()
        yield pd.DataFrame(done, columns=["part", "file", "documents", "ids", "crc32"])

    found = rows.mapInPandas(save, "part int, file string, documents long, ids long, crc32 long")
    found.write.parquet(f"{folder}/manifest")
    return spark.read.schema(found.schema).parquet(f"{folder}/manifest")


def _files(manifest: DataFrame, folder: str, row, schema: str) -> DataFrame:
    """row(docs, starts, ends, ids, base) -> a frame, for at most 1024 documents of a file at a time."""
    files = f"{folder}/ids"
    # ids before a file: those of the tasks before, of which there is one row each, and of its own task's files before
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    own = F.sum("ids").over(Window.partitionBy("part").orderBy("file")) - F.col("ids")
    placed = manifest.withColumn("own", own).join(parts, "part").withColumn("base", F.col("own") + F.col("before"))
    spread = placed.select("file", "base", "crc32").repartition(shuffle_partitions(manifest.sparkSession), "file")

    @lean
    def open_files(batches):
        for b in batches:
            for name, base, crc in zip(b.file, b.base, b.crc32):
                with opened(files, name) as f:
                    data = f.read()
                if zlib.crc32(data) != crc:
                    raise ValueError(f"{name} is not the file in the manifest")
                docs, ends, ids, nulls = load(data)
                docs = pd.array(docs, dtype="Int64")
                docs[:nulls] = pd.NA
                starts = np.concatenate([[0], ends[:-1]])
                for i in range(0, len(docs), 1024):
                    yield row(docs[i : i + 1024], starts[i : i + 1024], ends[i : i + 1024], ids, base)

    return spread.mapInPandas(open_files, schema)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) read from the files; start counts all ids of the documents before."""
    row = lambda docs, s, e, ids, base: pd.DataFrame({"doc_id": docs, "start": s + base, "n_tokens": e - s, "ids": [ids[x:y].astype(np.int64) for x, y in zip(s, e)]})
    return _files(manifest, folder, row, "doc_id long, start long, n_tokens long, ids array<long>")


def digests(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, without moving the ids out of the worker that reads them."""
    crc = lambda x: zlib.crc32(x.astype("<u4").tobytes())
    row = lambda docs, s, e, ids, base: pd.DataFrame({"doc_id": docs, "start": s + base, "n_tokens": e - s, "ids_crc32": [crc(ids[x:y]) for x, y in zip(s, e)]})
    return _files(manifest, folder, row, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_dir(spark, "ids")
    manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return digests(manifest, folder)
