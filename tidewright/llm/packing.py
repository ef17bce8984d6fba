"""Lexical retrieval packing into windows of a fixed number of tokens.

Each document is tokenized where it is read. All its full windows but the rest of fewer tokens are sequences of their
own, of which only place and checksum travel; the rest goes to a shard. A shard holds a BM25 inverted index over its
rests, whose terms are token ids. A window begins with a seed, asks the index for the seed's nearest unused neighbours
and takes them in order of score, asking on until it is full or no unused one shares a term. The last one is cut where
the window ends and seeds the next, so that only a shard's last window is padded.

Shards are dealt by content: a row's key is the two smallest of the weighted hashes of its token ids, so documents
that share much of their vocabulary are likely to have a key in common. Rows are dealt to partitions by ranges of the key
and sorted within them; a partition is cut into shards of equal numbers of documents as it is read, one shard in memory at
a time. The key ends in a hash of the row, so a frequent one is spread over several shards.

A null text is an empty one: its only id is the end id. Ties in score go to the smaller doc_id. Repeated rows are
packed one by one.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, Memo
from .common import materialize, texts

#: Partitions that the shards are dealt over at most; beyond them a partition has several shards, one after the other.
MOST_PARTITIONS = 20_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others for letters
    from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@cache
def tokenizers_of(path: str):
    """The tokenizer of a file, special tokens' strings being ordinary text, and the same vocabulary as ranks, which another
    library merges faster. Read once in each Python worker."""
    import json
    import os

    import public_tokenizers
    import tiktoken

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if all(c in letters for c in w) and i < 256 + len(model["merges"])}
    return t, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Letters on whose classes all versions of Unicode agree; runs with others go to the tokenizer itself.
SETTLED = re.compile("[\x00-\u024f]*")


class Encoder:
    """Ids of whole texts. One of settled letters is encoded at once. Others fall into runs of white space with what follows; no
    token reaches over the start of such a run, so each distinct one is encoded once while the memory for them, of bounded
    size, lasts."""

    def __init__(self, path: str, most: int = 600_000):
        slow, quick = tokenizers_of(path)

        def ids(run: str) -> bytes:
            got = quick.encode_ordinary(run) if SETTLED.fullmatch(run) else slow.encode(run, add_special_tokens=False).ids
            return np.array(got, "<u4").tobytes()

        self.memo, self.most, self.quick = Memo(ids), most, quick

    def __call__(self, text: str) -> np.ndarray:
        if SETTLED.fullmatch(text):
            return np.array(self.quick.encode_ordinary(text), "<u4")
        if len(self.memo) > self.most:
            self.memo.clear()
        return np.frombuffer(b"".join(map(self.memo.__getitem__, CHUNK.findall(text))), "<u4")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Bm25:
    """An inverted index over the token ids of some documents."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        lengths = np.fromiter(map(len, docs), "i8", len(docs))
        where = np.repeat(np.arange(len(docs), dtype="u8"), lengths)
        terms = np.concatenate(docs).astype("u8") if docs else np.zeros(0, "u8")
        pairs, tf = np.unique(terms << np.uint64(32) | where, return_counts=True)
        self.doc = (pairs & np.uint64(0xFFFFFFFF)).astype("i8")
        term = (pairs >> np.uint64(32)).astype("i8")
        self.terms, self.first, df = np.unique(term, return_index=True, return_counts=True)
        self.last = self.first + df
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * lengths / max(1.0, lengths.mean() if len(docs) else 1.0))
        self.weight = np.repeat(idf, df) * tf * (k1 + 1) / (tf + norm[self.doc])
        by_doc = np.lexsort((-self.weight, self.doc))
        self.of_doc = np.split(np.repeat(np.arange(len(df)), df)[by_doc], np.cumsum(np.bincount(self.doc, minlength=len(docs)))[:-1])
        self.n = len(docs)

    def neighbours(self, doc: int, unused: np.ndarray, terms: int | None, k: int) -> list[int]:
        """Up to ``k`` unused documents by falling score for the heaviest ``terms`` of ``doc``, or all its terms."""
        ask = self.of_doc[doc][:terms]
        if not len(ask):
            return []
        spans = [slice(self.first[t], self.last[t]) for t in ask.tolist()]
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        score *= unused
        # ties at the cut go to the smaller number, so all of them are sorted
        least = np.partition(score, self.n - k)[self.n - k] if k < self.n else 0.0
        top = np.flatnonzero((score >= least) & (score > 0))
        return top[np.lexsort((top, -score[top]))][:k].tolist()


def windows(docs: list[np.ndarray], window: int, terms: int = 16, k: int = 8) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length), every id in exactly one."""
    index, unused = Bm25(docs), np.array([len(d) > 0 for d in docs], bool)
    # a seed asks by its heaviest terms for a few neighbours, then for more, then for all, and at last by all its terms
    levels = [(terms, k), (terms, 8 * k), (terms, len(docs)), (None, len(docs))]
    out: list[list[tuple[int, int, int]]] = []
    here: list[tuple[int, int, int]] = []
    room, following, asked = window, 0, []
    tail: tuple[int, int] | None = None
    seed, level = -1, 0
    while True:
        if tail is not None:
            doc, start = tail
            tail = None
        else:
            doc = -1
            if here:
                while not asked and level < len(levels):
                    asked = index.neighbours(seed, unused, *levels[level])[::-1]
                    level = level + 1 if level == 3 or len(asked) >= levels[level][1] else 3
                if asked:
                    doc = asked.pop()
            while doc < 0 and following < len(docs):
                doc = following if unused[following] else -1
                following += 1
            if doc < 0:
                break
            unused[doc], start = False, 0
        if not here:
            seed, asked, level = doc, [], 0
        take = min(room, len(docs[doc]) - start)
        here.append((doc, start, take))
        room -= take
        if start + take < len(docs[doc]):
            tail = (doc, start + take)
        if not room:
            out.append(here)
            here, room = [], window
    if here:
        out.append(here)
    return out


def races() -> np.ndarray:
    """For each token id a fixed number; of a document's ids the one with the smallest is its first by content. Numbers are
    exponential with a rate that grows with the id, as later ids of a byte-pair vocabulary are the rarer ones."""
    ids = np.arange(1 << 17, dtype="u8")
    with np.errstate(over="ignore"):
        x = ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype("f8") + 0.5
    return -np.log(u / 2.0**53) / np.log2(ids + 2.0) ** 2


def content_key(ids: np.ndarray, race: np.ndarray, salt: int) -> int:
    """The first two ids by ``race``, then bits of ``salt``; ids beyond the table share places."""
    ids = ids & np.uint32(len(race) - 1)
    r = race[ids]
    first = int(ids[r.argmin()])
    r[ids == first] = np.inf
    return first << 41 | int(ids[r.argmin()]) << 24 | (salt & 0xFFFFFF)


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, shard_docs: int = 2048) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and where they stand; see PIECES. A shard holds about ``shard_docs`` documents,
    each with fewer than ``window`` ids."""

    def tokenize(batches):
        ids_of, race = encoder(path), races()
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch, rows = whole.iloc[at : at + 512], []
                for doc, salt, ids in zip(batch["doc_id"], batch["salt"], map(ids_of, batch["text"]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    total, doc = len(ids), None if pd.isna(doc) else int(doc)
                    key = content_key(ids[(total - 1) // window * window :], race, int(salt))
                    for start in range(0, total, window):
                        piece = ids[start : start + window]
                        full = len(piece) == window
                        rows.append((key, doc, start, len(piece), zlib.crc32(piece) if full else 0, total, None if full else piece.tobytes()))
                frame = pd.DataFrame(rows, columns=["key", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    def fill(rows: pd.DataFrame, first: int) -> pd.DataFrame:
        """The pieces of one shard; its sequences are numbered from ``first``."""
        rows = rows.sort_values(["doc_id", "doc_tokens", "start", "ids_crc32"], kind="stable", na_position="first")
        whole = rows["ids"].isna()
        full = rows[whole].assign(sequence_id=first + np.arange(int(whole.sum())), offset=0)
        rest = rows[~whole]
        ids = [np.frombuffer(x, "<u4") for x in rest["ids"]]
        docs, starts, totals = rest["doc_id"].tolist(), rest["start"].tolist(), rest["doc_tokens"].tolist()
        out = []
        for i, pieces in enumerate(windows(ids, window)):
            offset = 0
            for d, start, length in pieces:
                out.append((docs[d], starts[d] + start, length, zlib.crc32(ids[d][start : start + length].tobytes()), totals[d], first + len(full) + i, offset))
                offset += length
        columns = [x.split()[0] for x in PIECES.split(", ")]
        frame = pd.concat([full[columns], pd.DataFrame(out, columns=columns)]) if len(full) else pd.DataFrame(out, columns=columns)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    def shards(batches):
        """A partition's rows, in order of their keys, cut where another ``shard_docs`` documents end."""
        from pyspark import TaskContext

        first, held, size = TaskContext.get().partitionId() << 40, [], 0

        def close():
            nonlocal first, held, size
            frame = fill(pd.concat(held, ignore_index=True), first)
            first, held, size = int(frame["sequence_id"].max()) + 1, [], 0
            return frame

        for b in batches:
            ends = np.cumsum((b["start"] + b["length"] == b["doc_tokens"]).to_numpy())
            at = 0
            while len(ends) and size + ends[-1] - (ends[at - 1] if at else 0) >= shard_docs:
                stop = int(np.searchsorted(ends, shard_docs - size + (ends[at - 1] if at else 0))) + 1
                held.append(b.iloc[at:stop])
                yield close()
                at = stop
                if at == len(b):
                    break
            if at < len(b):
                held.append(b.iloc[at:])
                size += int(ends[-1] - (ends[at - 1] if at else 0))
        if held:
            yield close()

    made = texts(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("salt")).mapInPandas(
        tokenize, "key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    )
    pieces = materialize(made, "pieces")
    docs_ = pieces.filter("start + length = doc_tokens").count()
    dealt = pieces.repartitionByRange(max(1, min(MOST_PARTITIONS, math.ceil(docs_ / shard_docs))), "key").sortWithinPartitions("key", "doc_id", "doc_tokens", "start", "ids_crc32")
    return dealt.mapInPandas(shards, PIECES)
