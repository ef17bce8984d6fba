"""Byte-level BPE: a global shuffle of distinct pre-tokens encodes each once; decoding joins the token-byte table.

Documents are dealt into blocks. Each block explodes its texts into pre-tokens with positions and sends its distinct
ones to the bucket of their hash, a packed row for each bucket. A bucket meets a pre-token once from each block at most,
encodes it once and answers each block in the order of its request. The block puts the ids at the pre-tokens' positions.
So no pre-token, however frequent, makes a large group, and texts move once. Decoding joins each document's ids with the
token-byte table, whose size is that of the vocabulary.

A null or empty text has no ids. Rows that repeat are encoded one by one. Very long texts count towards a block's size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import pack_words, squeeze, squeezed_blocks, texts, unpack_words, unsqueeze, unsqueezed

#: Characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space with what follows. No pre-token reaches over the start of such a run.
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class Memo(dict):
    """A dictionary that makes what it lacks."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


@cache
def encoding(path: str, pattern: str):
    """The tokenizer of a ranks file. It is read where it is used, once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


class TokenBytes:
    """The token-byte table: a row for each id, laid end to end, with where each begins and how long it is."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values(), default=-1) + 1
        rows = [b""] * n
        for word, i in ranks.items():
            rows[i] = word
        self.length = np.fromiter(map(len, rows), "i8", n)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(rows), "u1")

    def join(self, ids: np.ndarray) -> bytes:
        """The rows of ``ids``, in order, put together."""
        length = self.length[ids]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        return self.bytes[np.repeat(self.start[ids] - (end - length), length) + np.arange(total)].tobytes()


@cache
def token_bytes(path: str, pattern: str) -> TokenBytes:
    return TokenBytes(encoding(path, pattern)[1])


class Block:
    """The distinct pre-tokens of some texts, in order of first appearance, and each text as their numbers."""

    def __init__(self, texts: list[str], pattern: str):
        import regex

        split = regex.compile(pattern).findall
        self.words: dict[str, int] = {}
        number = self.words.setdefault

        def numbers(chunk: str) -> bytes:
            return np.array([number(w, len(self.words)) for w in split(chunk)], "<u4").tobytes()

        memo = Memo(numbers)
        self.texts = [np.frombuffer(b"".join(map(memo.__getitem__, CHUNK.findall(t))), "<u4") for t in texts]


def buckets_of(words: list[bytes], n: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) % n for w in words), "i8", len(words))


def encode(docs: DataFrame, path: str, pattern: str, block_bytes: int = 12 << 20) -> DataFrame:
    """Token ids of every text of ``docs`` (doc_id, text): a row with ``ids`` for each document, and the digests of the ids
    and of what they decode to."""
    blocks, n = squeezed_blocks(texts(docs), block_bytes)
    kind = "<u4"  # of ids while they travel; compression takes what isn't needed

    def request(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["block"].iat[0])
        words = [w.encode() for w in Block([t for _, t in unsqueezed(rows["rows"])], pattern).words]
        cells: dict[int, list[bytes]] = {}
        for w, b in zip(words, buckets_of(words, n).tolist(), strict=True):
            cells.setdefault(b, []).append(w)
        return pd.DataFrame({"bucket": list(cells), "block": number, "words": [squeeze(pack_words(c)) for c in cells.values()]})

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        enc = encoding(path, pattern)[0]
        memo = Memo(lambda w: np.array(enc.encode_ordinary(w.decode()), kind).tobytes())
        out = []
        for bucket, block, data in zip(rows["bucket"], rows["block"], rows["words"], strict=True):
            ids = [memo[w] for w in unpack_words(unsqueeze(data))]
            out.append((int(block), int(bucket), squeeze(pack_words(ids))))
        return pd.DataFrame(out, columns=["block", "bucket", "ids"])

    def assemble(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        table = token_bytes(path, pattern)
        docs_ = unsqueezed(rows["rows"])
        block = Block([t for _, t in docs_], pattern)
        given = {int(b): iter(unpack_words(unsqueeze(x))) for b, x in zip(answers["bucket"], answers["ids"], strict=True)}
        words = [w.encode() for w in block.words]
        ids = [np.frombuffer(next(given[b]), kind) for b in buckets_of(words, n).tolist()]
        lengths = np.fromiter(map(len, ids), "i8", len(ids))
        said = [" ".join(map(str, x.tolist())).encode() for x in ids]
        flat, starts = (np.concatenate(ids) if ids else np.zeros(0, kind)), np.cumsum(lengths) - lengths
        out = []
        for (doc, _), at in zip(docs_, block.texts, strict=True):
            each = lengths[at]
            total = int(each.sum())
            place = np.repeat(starts[at] - (np.cumsum(each) - each), each) + np.arange(total)
            whole = flat[place]
            out.append((
                doc, total, whole.astype("<u4").tobytes(),
                hashlib.sha256(b" ".join(map(said.__getitem__, at.tolist()))).hexdigest(), hashlib.sha256(table.join(whole)).hexdigest(),
            ))
        frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
        frame["doc_id"] = pd.array([d for d, _ in docs_], dtype="Int64")
        return frame

    asked = blocks.groupBy("block").applyInPandas(request, "bucket int, block int, words binary")
    answers = asked.groupBy("bucket").applyInPandas(answer, "block int, bucket int, ids binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        assemble, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"
    )


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes of each row's ``ids``, by the token-byte table."""

    def run(batches):
        table = token_bytes(path, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "decoded": [table.join(np.frombuffer(x, "<u4")) for x in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, decoded binary")
