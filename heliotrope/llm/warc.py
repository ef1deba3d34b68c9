"""A deterministic sharded WARC writer and its reader.

Records are range-sorted by id; each task writes gzip members, one a record, to files that roll by compressed size,
under temporary names that are moved when complete; a manifest table lists files, records, bytes and SHA-1. Headers
and digests are made anew from the payload. Of records with equal payloads of at least min_bytes, that with the largest
id is a response and the others revisit it. Equal rows of input give equal bytes: record ids derive from the row's id,
dates are fixed by a parameter and gzip carries no time.

Cases: null payloads are empty; null urls are written as urn:page:id; rows with a null id come first, under a record id of
their own that reads back as null, and revisit a row of their payload that has an id (if none has, all are responses); rows
repeated with one id are written as often as they occur, all of the same type; very long payloads are one record each;
empty tables give no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import Committed, opened
from ._shared import lean, narrow_batches, shuffle_partitions, work_dir, written

ROLL = 256 << 20
DATE = "2024-01-01T00:00:00Z"


def _uuid(n: int | None) -> str:
    if n is None:
        return "urn:uuid:68656c69-6f74-8001-0000-000000000000"
    h = f"{n & (2**64 - 1):016x}"
    return f"urn:uuid:68656c69-6f74-8000-{h[:4]}-{h[4:]}"


def _number(uuid: str) -> int | None:
    parts = uuid.strip("<>").split("-")
    if parts[-3] == "8001":
        return None
    n = int("".join(parts[-2:]), 16)
    return n - 2**64 if n >= 2**63 else n


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, date: str = DATE) -> bytes:
    """One uncompressed record. A revisit keeps its HTTP header only, and the length and digest of the payload."""
    uri = (url or f"urn:page:{page}").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{_uuid(page)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_uuid(refers)}>"]
    return ("\r\n".join(head) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, digest, refers) of the rows (id, payload, digest) that repeat the payload of a row with a larger id."""
    rows = rows.where(F.length("payload") >= min_bytes).select("id", "digest").distinct()
    groups = rows.groupBy("digest").agg(F.max("id").alias("refers"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers is not null").drop("n")
    return rows.join(groups, "digest").where("id is null or id < refers").select("id", "digest", "refers")


def write(df: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, roll: int = ROLL, date: str = DATE) -> DataFrame:
    """Writes the archives and returns their manifest (file, records, bytes, sha1), also written to folder/manifest."""
    narrow_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # what a row revisits travels as a row before it, so payloads are shuffled once whatever the number of repeats
    refs = revisits(rows, min_bytes).select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers")
    rows = refs.union(rows.withColumn("refers", F.lit(None).cast("long")))
    order = ("id", "digest")  # an id may have many payloads, so ranges may end within an id
    rows = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order, F.col("payload").isNotNull(), "url")
    files = f"{folder}/warc"

    @lean
    def save(batches):
        from pyspark import TaskContext

        part, roll_no, out, n, sha, done, at, target = TaskContext.get().partitionId(), 0, None, 0, None, [], None, None

        def close():
            nonlocal out, n
            if out:
                out.close()
                done.append((out.name, n, out.size, sha.hexdigest()))
                out, n = None, 0

        try:
            for b in batches:
                for page, uri, body, digest, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    if (page, digest) != at:
                        at, target = (page, digest), None
                    if not body.is_valid:
                        target = refers
                        continue
                    if not out:
                        out, sha = Committed(files, f"part-{part:05d}-{roll_no:04d}.warc.gz"), hashlib.sha1()
                        roll_no += 1
                    data = member(record(page, uri, body.as_py(), target, date))
                    out.write(data)
                    sha.update(data)
                    n += 1
                    if out.size >= roll:
                        close()
            close()
        except BaseException:
            if out:
                out.abort()
            raise
        if done:
            import pyarrow as pa

            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["file", "records", "bytes", "sha1"]), preserve_index=False)

    found = rows.mapInArrow(save, "file string, records long, bytes long, sha1 string")
    found.write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(found.schema).parquet(f"{folder}/manifest")


def records(stream, sha=None):
    """(headers, block) of each record of a .warc.gz stream, member by member; sha is fed the compressed bytes."""
    z, data, left = zlib.decompressobj(31), bytearray(), b""
    while True:
        chunk = left or stream.read(1 << 20)
        if not left and chunk and sha is not None:
            sha.update(chunk)
        left = b""
        if not chunk:
            if data:
                raise ValueError("the archive ends within a record")
            return
        data += z.decompress(chunk)
        if z.eof:
            left = z.unused_data
            head, _, rest = bytes(data).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            h = dict(x.split(": ", 1) for x in lines[1:])
            block = rest[: int(h["Content-Length"])]
            if rest[len(block) :] != b"\r\n\r\n" or h["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
                raise ValueError("a record is damaged")
            yield h, block
            z, data = zlib.decompressobj(31), bytearray()


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) read from the manifest's files;
    payload is null for revisits. A file that does not have its manifest's SHA-1 raises."""
    files = f"{folder}/warc"
    spread = manifest.select("file", "sha1").repartition(shuffle_partitions(manifest.sparkSession), "file")

    @lean
    def load(batches):
        for b in batches:
            for name, want in zip(b.file, b.sha1):
                sha, rows, size = hashlib.sha1(), [], 0
                with opened(files, name) as f:
                    for h, block in records(f, sha):
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(body) != length or sha1_base32(body) != digest):
                            raise ValueError("a payload is damaged")
                        rows.append((_number(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind, _number(h["WARC-Refers-To"]) if kind == "revisit" else None, length, digest, body if kind == "response" else None))
                        size += len(body)
                        if size > 16 << 20 or len(rows) >= 10_000:
                            yield frame(rows)
                            rows, size = [], 0
                if rows:
                    yield frame(rows)
                if sha.hexdigest() != want:
                    raise ValueError(f"{name} is not the file in the manifest")

    def frame(rows):
        out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return spread.mapInPandas(load, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base 32: each sign has 5 bits, which lie in two hexadecimal digits.
OP5_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), h AS (
  SELECT page_id, octet_length(b) AS n, b, sha1(b) AS x FROM p
), d AS (
  SELECT page_id, n, b, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((
    ((strpos('0123456789abcdef', substr(x, (5 * i) // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(x, (5 * i) // 4 + 2, 1)) - 1)
    >> (3 - (5 * i) % 4)) & 31)::INT + 1, 1)), 'string_agg', '') AS digest, max(page_id) OVER (PARTITION BY b) AS top FROM h
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS NULL OR page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""
