"""Pieces shared by the text operators: scratch tables, blocks of documents, word splitting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import place as scratch
from ..sources.shared import stored as materialize

__all__ = ["in_blocks", "let", "materialize", "scratch", "table", "texts"]

#: Fixed value: the white space that separates words, space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, whatever the optimizer does."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def in_blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) with a ``block`` number and how many blocks there are.

    A block holds about ``block_bytes`` of text. The number depends on the row alone, so a stage that is run again after
    an executor was lost makes the same blocks; the text takes part, so that one repeated id is spread too.
    """
    total = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), "<u4", len(words))
    return np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words)


def unpack_words(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype="i8")
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]) if n else ends
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def squeeze(data: bytes, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def squeezed_blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """As ``in_blocks``, but the documents of one block that a task reads together are one row (block, rows), compressed:
    texts are most of what such operators shuffle."""
    blocks, n = in_blocks(docs, block_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for block, part in b.groupby("block", sort=False):
                ids = [b"" if pd.isna(x) else str(int(x)).encode() for x in part["doc_id"]]
                out.append((int(block), squeeze(pack_words(ids + [t.encode() for t in part["text"]]), 6)))
            yield pd.DataFrame(out, columns=["block", "rows"])

    return blocks.select("block", "doc_id", "text").mapInPandas(run, "block int, rows binary"), n


def unsqueezed(rows: pd.Series) -> list[tuple[int | None, str]]:
    """The documents of a block in an order that depends on them alone."""
    out = []
    for data in rows:
        parts = unpack_words(unsqueeze(data))
        half = len(parts) // 2
        out += [(int(i) if i else None, t.decode()) for i, t in zip(parts[:half], parts[half:], strict=True)]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
