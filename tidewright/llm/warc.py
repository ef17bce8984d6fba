"""WARC archives, each a Zstandard file with its own dictionary.

A file begins with a skippable frame (magic number 0x184D2A5D) that holds a dictionary trained on the file's first
records; each record follows as one frame compressed with it. Files are written beside each other by the tasks of one
Spark job. A task that runs twice leaves a second file under another name: the job's manifest lists the files of the
tasks that counted, and readers open only those.

Of records whose payloads are equal and at least ``revisit_bytes`` long, the one with the largest page_id is a response
and the others are revisits of it, without payload. Rows that repeat that page_id too are responses all. A null html is
an empty payload, a null url an empty one; rows with a null page_id are responses.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

#: Fixed values of the format.
DICT_MAGIC = 0x184D2A5D
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, records long, raw_bytes long, bytes long, dict_bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _store(folder: str):
    import pyarrow.fs as pafs

    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    return pafs.FileSystem.from_uri(folder)


def record(row) -> bytes:
    """One WARC record; ``row`` has page_id, url, payload, digest (hex), payload_bytes and refers_to (or None)."""
    revisit = row["refers_to"] is not None
    block = b"" if revisit else row["payload"]
    sha = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Payload-Length: {row['payload_bytes']}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF


def parse(raw: bytes) -> dict:
    """What ``record`` was given, the digest and length of a response taken anew from its payload."""
    head, _, rest = raw.partition(CRLF + CRLF)
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    payload = rest[: int(h["Content-Length"])]
    who = lambda x: int(x[len("<urn:page:") : -1]) if len(x) > len("<urn:page:>") else None
    if h["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size, digest, payload = int(h["WARC-Payload-Length"]), base64.b32decode(h["WARC-Payload-Digest"][5:]).hex(), None
    url = h["WARC-Target-URI"].replace("%0D", "\r").replace("%0A", "\n")
    return dict(
        page_id=who(h["WARC-Record-ID"]), url=url, payload_bytes=size, payload_digest=digest, record_type=h["WARC-Type"],
        refers_to=who(h.get("WARC-Refers-To", "")), payload=payload,
    )


class Archive:
    """Writes one file: the first records are kept until they suffice for a dictionary."""

    def __init__(self, out, dict_bytes: int, sample_bytes: int, level: int):
        self.out, self.dict_bytes, self.sample_bytes, self.level = out, dict_bytes, sample_bytes, level
        self.kept: list[bytes] = []
        self.held = self.records = self.raw = self.size = self.dict_size = 0
        self.frames = None

    def _begin(self) -> None:
        import zstandard as zstd

        try:
            trained = zstd.train_dictionary(min(self.dict_bytes, max(256, self.held // 4)), self.kept, k=256, d=8, level=self.level)
        except zstd.ZstdError:  # too few records to train on: what they hold serves as it is
            trained = zstd.ZstdCompressionDict(b"".join(self.kept)[: self.dict_bytes] or b"WARC/1.1\r\n", dict_type=zstd.DICT_TYPE_RAWCONTENT)
        body = trained.as_bytes()
        self._put(struct.pack("<II", DICT_MAGIC, len(body)) + body)
        self.dict_size = len(body)
        self.frames = zstd.ZstdCompressor(level=self.level, dict_data=trained, write_checksum=True)
        for x in self.kept:
            self._put(self.frames.compress(x))
        self.kept = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, raw: bytes) -> None:
        self.records += 1
        self.raw += len(raw)
        if self.frames:
            self._put(self.frames.compress(raw))
            return
        self.kept.append(raw)
        self.held += len(raw)
        if self.held >= self.sample_bytes:
            self._begin()

    def close(self) -> None:
        if not self.frames:
            self._begin()
        self.out.close()


def records_of(source) -> Iterator[bytes]:
    """The records of an open archive, one at a time."""
    import zstandard as zstd

    magic, n = struct.unpack("<II", source.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    body = source.read(n)
    known = zstd.ZstdCompressionDict(body, dict_type=zstd.DICT_TYPE_AUTO)
    rest = source.read(1 << 20)
    while rest:
        frame = zstd.ZstdDecompressor(dict_data=known).decompressobj()
        out = io.BytesIO()
        while True:
            out.write(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data or source.read(1 << 20)
                break
            rest = source.read(1 << 20)
            if not rest:
                raise EOFError("the archive ends within a record")
        yield out.getvalue()


def plan_records(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """``pages`` with digests, lengths and, for revisits, the page_id they refer to.

    Only digests are grouped, with partial sums on the map side. Rows join their group's largest page_id by digest; a
    group of copies, however large, is then split by Spark's skew handling, and short payloads, which no group wants,
    get keys of their own.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    )
    long_enough = F.octet_length("payload") >= revisit_bytes
    key = F.when(long_enough, F.unhex(F.sha2("payload", 256))).otherwise(F.encode(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), "UTF-8"))
    p = p.withColumn("key", key)
    groups = (
        p.filter(long_enough).groupBy("key").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"))
        .filter(F.col("last") > F.col("first")).select("key", "last")
    )
    joined = p.join(groups.hint("merge"), "key", "left")
    return joined.select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest"),
        F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str, revisit_bytes: int = 1000, file_bytes: int = 256 << 20, dict_bytes: int = 32 << 10, sample_bytes: int = 2 << 20, level: int = 3) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``folder``; the manifest, a row for each file, is written there too.

    A task holds one record and, at a file's start, ``sample_bytes`` of records for the dictionary.
    """

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        open_: Archive | None = None

        def close() -> pd.DataFrame:
            open_.close()
            return pd.DataFrame([(path, open_.records, open_.raw, open_.size, open_.dict_size)], columns=["path", "records", "raw_bytes", "bytes", "dict_bytes"])

        for batch in batches:
            none = batch["page_id"].isna(), batch["refers_to"].isna()
            for i, (page, url, payload, size, digest, refers) in enumerate(batch.itertuples(index=False)):
                if open_ is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    path = f"{folder}/{name}"
                    open_ = Archive(fs.open_output_stream(f"{root}/{name}", compression=None), dict_bytes, sample_bytes, level)
                open_.add(record(dict(
                    page_id=None if none[0].iat[i] else int(page), url=url, payload=bytes(payload), payload_bytes=int(size), digest=digest,
                    refers_to=None if none[1].iat[i] else int(refers),
                )))
                if open_.size >= file_bytes:
                    yield close()
                    open_ = None
        if open_ is not None:
            yield close()

    spark = pages.sparkSession
    plan_records(pages, revisit_bytes).mapInPandas(archive, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives that ``manifest`` lists."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                fs, at = _store(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    for raw in records_of(source):
                        rows.append(parse(raw))
                        held += len(raw)
                        if not payloads:
                            rows[-1]["payload"] = None
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield _frame(rows, columns)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, columns)

    n = max(1, min(manifest.count(), 20_000))
    return manifest.select("path").repartition(n).mapInPandas(load, RECORD)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([r[c] for r in rows], dtype="Int64")
    return out


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back, without payloads."""
    return read(write(pages, scratch(spark, "warc")), payloads=False).drop("payload")
