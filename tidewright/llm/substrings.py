"""Repeated passages, found by backward search in FM-indexes.

A window is ``window`` consecutive words. To bring equal windows together, each is routed by its anchor, the smallest hash
among its runs of ``gram`` words; consecutive windows with one anchor form a segment, so a text is cut into few segments
that overlap by less than a window. First only anchors travel, to learn which stand in two documents or more; then only
the segments of these go to the shard of their anchor, each distinct one once from a block, with the smallest doc_id that
has it. A shard indexes its distinct segments: suffixes sorted by their first words, the Burrows-Wheeler transform in a
wavelet matrix of packed bits. Segments are then streamed through the index by backward search, all together; the match
of each window is an interval of suffixes, and the smallest doc_id over it says whether a document before has the window.

Anchors with more than ``hot`` distinct segments, such as a line that stands in very many texts, would make a shard too
large (copies of one passage are one segment, however many there are); the windows of these are compared by 128-bit hashes of their own instead, in buckets of equal size.

A null or empty text has no words. Documents with a null doc_id keep all words and are compared with nothing; rows with
the same doc_id don't repeat each other. Very long texts count towards a block's size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import SPACE_RUN, in_blocks, let, pack_words, texts, unpack_words

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
NONE = np.iinfo("i8").max
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    x = a * _K[salt] + (b ^ (b >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    return x ^ (x >> np.uint64(29))


def rolling(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``n`` values; one shorter than ``h`` for each value after the first."""
    out, have, power, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out, have = power, size
            else:
                m = len(h) - have - size + 1
                out, have = mix(out[:m], power[have : have + m], salt), have + size
        if have == n:
            return out
        m = len(h) - 2 * size + 1
        power, size = mix(power[:m], power[size : size + m], salt), 2 * size


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class Block:
    """Texts as words, and their segments: anchor, document, first window and the place after the last."""

    def __init__(self, rows: pd.DataFrame, window: int, gram: int):
        import xxhash

        rows = rows.sort_values(["doc_id", "text"], kind="stable", na_position="first")
        self.ids = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
        self.words = [t.encode().split() for t in rows["text"]]
        memo = Memo(lambda w: xxhash.xxh3_64_intdigest(w).to_bytes(8, "little"))
        lengths = np.fromiter(map(len, self.words), "i8", len(self.words))
        self.first = np.cumsum(lengths) - lengths
        self.hashes = np.frombuffer(b"".join([b"".join(map(memo.__getitem__, w)) for w in self.words]), "<u8")
        self.window, self.lengths = window, lengths
        self.doc = self.start = self.stop = np.zeros(0, "i8")
        self.anchor = np.zeros(0, "u8")
        if len(self.hashes) < window:
            return
        least = sliding_min(rolling(self.hashes, gram), window - gram + 1)
        doc = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
        known = np.fromiter((x is not None for x in self.ids), bool, len(self.ids))
        inside = (np.arange(len(least)) + window <= (self.first + lengths)[doc]) & known[doc]
        begins = np.ones(len(least), bool)
        begins[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
        starts = np.flatnonzero(begins & inside)
        ends = np.append(np.flatnonzero(begins | ~inside), len(least))
        self.doc, self.start, self.anchor = doc[starts], starts, least[starts]
        self.stop = ends[np.searchsorted(ends, starts, side="right")]

    def content(self, i: int) -> bytes:
        d = self.doc[i]
        a = self.start[i] - self.first[d]
        return b" ".join(self.words[d][a : a + self.stop[i] - self.start[i] + self.window - 1])

    def fingerprints(self) -> np.ndarray:
        """A number of 32 bits for the words of each segment: a polynomial of their hashes, from sums up to each word."""
        n = len(self.hashes)
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, x, "u8")]), dtype="u8") for x in (_ODD, _ODD_INVERSE))
            total = np.concatenate([np.zeros(1, "u8"), np.cumsum(self.hashes * down[:n], dtype="u8")])
            whole = (total[self.stop + self.window - 1] - total[self.start]) * up[self.start]
            return (mix(whole, whole) >> np.uint64(32)).astype("u4")

    def window_keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of some segments: their places and 16-byte keys."""
        places = np.concatenate([np.arange(self.start[i], self.stop[i]) for i in which.tolist()])
        both = [rolling(self.hashes, self.window, salt)[places] for salt in (1, 2)]
        return places, np.stack(both, axis=1)


class Wavelet:
    """A wavelet matrix: for each bit of the symbols packed bits with counts before each 64."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels = []
        for bit in range(max(1, int(most).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            padded = np.zeros((len(ones) // 64 + 1) * 64, "u1")
            padded[: len(ones)] = ones
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype="i8")])
            self.levels.append((bit, words, before, len(ones) - int(ones.sum())))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place, less where its run begins at the last level."""
        for bit, words, before, zeros in self.levels:
            word, off = at >> 6, (at & 63).astype("u8")
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << off) - np.uint64(1)))
            one = ((symbols >> bit) & 1).astype(bool)
            at = np.where(one, zeros + ones, at - ones)
        return at


class FmIndex:
    """An index of texts, given as arrays of symbols from 1, for patterns of up to ``depth`` symbols."""

    def __init__(self, texts: list[np.ndarray], depth: int):
        self.depth = depth
        zero = np.zeros(1, "i8")
        text = np.concatenate([x for t in texts for x in (t, zero)])
        n = len(text)
        by_size = {1: np.unique(text, return_inverse=True)[1]}
        size = 1
        while size < depth:
            by_size[2 * size] = _pairs(by_size[size], by_size[size], size)
            size *= 2
        suffixes = np.argsort(by_size[size], kind="stable")
        most = int(text.max())
        transform = text[suffixes - 1]
        self.wavelet = Wavelet(transform, most)
        counts = np.bincount(text, minlength=most + 2)
        self.before = np.cumsum(counts) - counts  # suffixes that begin with a smaller symbol
        symbols = np.arange(most + 1)
        self.runs = self.wavelet.rank(symbols, np.zeros(most + 1, "i8"))
        self.suffixes, self.n = suffixes, n
        self.short = _intervals(_prefix(by_size, depth - 1)[suffixes])
        self.whole = _intervals(_prefix(by_size, depth)[suffixes])

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of ``symbol`` followed by what the given ones match."""
        base = self.before[symbol] - self.runs[symbol]
        return base + self.wavelet.rank(symbol, low), base + self.wavelet.rank(symbol, high)

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of matches of full depth without their last symbol."""
        return self.short[0][low], self.short[1][low]


def _pairs(a: np.ndarray, b: np.ndarray, off: int) -> np.ndarray:
    """Ranks of prefixes made of one ranked by ``a`` and, ``off`` further on, one ranked by ``b``."""
    shifted = np.zeros(len(b), "i8")
    shifted[: max(0, len(b) - off)] = b[off:] + 1
    return np.unique(a * np.int64(int(b.max()) + 2) + shifted, return_inverse=True)[1]


def _prefix(by_size: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Ranks of prefixes of ``n`` symbols, put together from those of powers of two."""
    out, have = None, 0
    for size in sorted(by_size, reverse=True):
        if n & size:
            out, have = (by_size[size], size) if out is None else (_pairs(out, by_size[size], have), have + size)
    return out


def _intervals(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, where those with its prefix begin and end; equal ``ranks`` stand together."""
    begin = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
    end = np.append(begin[1:], len(ranks))
    return np.repeat(begin, end - begin), np.repeat(end, end - begin)


def earliest(contents: list[bytes], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each segment the smallest of ``docs`` over all segments that hold it."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    texts = [np.array([number(w, len(numbers) + 1) for w in c.split(b" ")], "i8") for c in contents]
    index = FmIndex(texts, window)
    lengths = np.fromiter(map(len, texts), "i8", len(texts))
    owner = np.repeat(docs, lengths + 1)[index.suffixes]
    begins = np.flatnonzero(np.concatenate([[True], index.whole[0][1:] != index.whole[0][:-1]]))
    least = np.repeat(np.minimum.reduceat(owner, begins), np.diff(np.append(begins, index.n)))
    out = [np.empty(m - window + 1, "i8") for m in lengths.tolist()]
    by = np.argsort(-lengths, kind="stable")
    flat, first = np.concatenate(texts), np.cumsum(lengths) - lengths
    low, high = np.zeros(len(texts), "i8"), np.full(len(texts), index.n, "i8")
    live, width = len(by), int(lengths.max())
    answer = np.concatenate(out) if out else np.zeros(0, "i8")
    place = np.cumsum(lengths - window + 1) - (lengths - window + 1)
    for step in range(width):
        while lengths[by[live - 1]] <= step:
            live -= 1
        some = by[:live]
        at = lengths[some] - 1 - step
        a, b = low[some], high[some]
        if step >= window:
            a, b = index.shorten(a)
        a, b = index.extend(a, b, flat[first[some] + at])
        low[some], high[some] = a, b
        if step >= window - 1:
            answer[place[some] + at] = least[a]
    return np.split(answer, place[1:])


def repeats(docs: DataFrame, window: int = 50, gram: int = 16, hot: int = 20_000, block_bytes: int = 12 << 20) -> DataFrame:
    """For each of ``docs`` (doc_id, text), its words and the half-open word intervals that an earlier document has:
    doc_id, n_words, starts, ends and the kept words' digest."""
    blocks, n = in_blocks(texts(docs), block_bytes)
    cell = "bucket int, block int, kind int, a binary, b binary, c binary"

    def ask_anchors(rows: pd.DataFrame) -> pd.DataFrame:
        number, block = int(rows["block"].iat[0]), Block(rows, window, gram)
        keys, at = np.unique(block.anchor, return_inverse=True)
        pairs = np.unique(at.astype("u8") << np.uint64(32) | block.fingerprints()) if len(keys) else np.zeros(0, "u8")
        under = (pairs >> np.uint64(32)).astype("i8")
        count, prints = np.bincount(under, minlength=len(keys)).astype("<u4"), pairs.astype("<u4")
        docs_ = np.fromiter((block.ids[d] for d in block.doc), "i8", len(block.doc))
        low, high = np.full(len(keys), NONE), np.full(len(keys), -NONE)
        np.minimum.at(low, at, docs_)
        np.maximum.at(high, at, docs_)
        several = (low < high).astype("u1")
        bucket = (keys % np.uint64(n)).astype("i8")
        out, of = [], dict(_cells(bucket[under]))
        for b, part in _cells(bucket):
            out.append((b, number, 0, keys[part].tobytes(), several[part].tobytes(), count[part].tobytes() + prints[of[b]].tobytes()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in cell.split(", ")])

    def judge_anchors(rows: pd.DataFrame) -> pd.DataFrame:
        keys, at = np.unique(np.frombuffer(b"".join(rows["a"]), "<u8"), return_inverse=True)
        blocks_ = np.bincount(at, minlength=len(keys)) + np.bincount(at, np.frombuffer(b"".join(rows["b"]), "u1"), len(keys))
        segments = distinct_segments(at, [len(x) // 8 for x in rows["a"]], [np.frombuffer(x, "<u4") for x in rows["c"]], len(keys))
        flag = np.where(blocks_ < 2, 0, np.where(segments > hot, 2, 1)).astype("u1")[at]
        ends = np.cumsum([len(x) // 8 for x in rows["a"]])
        parts = [x.tobytes() for x in np.split(flag, ends[:-1])]
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "kind": 0, "a": parts})

    def flagged(block: Block, flags: pd.DataFrame) -> np.ndarray:
        """For each segment of the block what its anchor's bucket said of it."""
        keys, at = np.unique(block.anchor, return_inverse=True)
        said = {int(b): np.frombuffer(x, "u1") for b, x in zip(flags["bucket"], flags["a"], strict=True)}
        flag = np.zeros(len(keys), "u1")
        for b, part in _cells((keys % np.uint64(n)).astype("i8")):
            flag[part] = said[b]
        return flag[at]

    def gather(block: Block, flag: np.ndarray):
        """What the block asks the shards, in an order that depends on its rows alone: distinct segments with their
        documents, and the distinct keys of windows under hot anchors."""
        contents: dict[bytes, int] = {}
        which = np.flatnonzero(flag == 1)
        number = np.array([contents.setdefault(block.content(i), len(contents)) for i in which.tolist()], "i8")
        _, one = np.unique(number, return_index=True)
        shard = (block.anchor[which[one]] % np.uint64(n)).astype("i8")
        docs_ = np.fromiter((block.ids[d] for d in block.doc[which]), "i8", len(which))
        least = np.full(len(contents), NONE)
        np.minimum.at(least, number, docs_)
        warm = np.flatnonzero(flag == 2)
        places, keys = block.window_keys(warm) if len(warm) else (np.zeros(0, "i8"), np.zeros((0, 2), "u8"))
        by = np.lexsort((keys[:, 1], keys[:, 0]))
        new = np.concatenate([[True], (keys[by][1:] != keys[by][:-1]).any(axis=1)]) if len(by) else np.zeros(0, bool)
        key_of = np.empty(len(by), "i8")
        key_of[by] = np.cumsum(new) - 1
        keys = keys[by][new]
        key_least = np.full(len(keys), NONE)
        if len(places):
            owners = np.fromiter((-1 if x is None else x for x in block.ids), "i8", len(block.ids))
            np.minimum.at(key_least, key_of, owners[np.searchsorted(block.first, places, side="right") - 1])
        return which, number, list(contents), shard, least, places, key_of, keys, key_least

    def ask_segments(rows: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        number, block = int(rows["block"].iat[0]), Block(rows, window, gram)
        _, _, contents, shard, least, _, _, keys, key_least = gather(block, flagged(block, flags))
        out = []
        for b, part in _cells(shard):
            out.append((b, number, 1, pack_words([contents[i] for i in part.tolist()]), least[part].tobytes(), None))
        for b, part in _cells((keys[:, 0] % np.uint64(n)).astype("i8")):
            out.append((b, number, 2, keys[part].tobytes(), key_least[part].tobytes(), None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in cell.split(", ")])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        some = rows[rows["kind"] == 1]
        if len(some):
            texts: dict[bytes, int] = {}
            asked = [[texts.setdefault(t, len(texts)) for t in unpack_words(x)] for x in some["a"]]
            least = np.full(len(texts), NONE)
            np.minimum.at(least, np.concatenate([np.array(x, "i8") for x in asked]), np.frombuffer(b"".join(some["b"]), "<i8"))
            found = earliest(list(texts), least, window)
            for block, bucket, x in zip(some["block"], some["bucket"], asked, strict=True):
                out.append((int(block), int(bucket), 1, b"".join(found[i].tobytes() for i in x)))
        some = rows[rows["kind"] == 2]
        if len(some):
            keys = np.frombuffer(b"".join(some["a"]), "<u8").reshape(-1, 2)
            least = np.frombuffer(b"".join(some["b"]), "<i8")
            by = np.lexsort((keys[:, 1], keys[:, 0]))
            new = np.flatnonzero(np.concatenate([[True], (keys[by][1:] != keys[by][:-1]).any(axis=1)]))
            best = np.empty(len(by), "i8")
            best[by] = np.repeat(np.minimum.reduceat(least[by], new), np.diff(np.append(new, len(by))))
            ends = np.cumsum([len(x) // 16 for x in some["a"]])
            for block, bucket, x in zip(some["block"], some["bucket"], np.split(best, ends[:-1]), strict=True):
                out.append((int(block), int(bucket), 2, x.tobytes()))
        return pd.DataFrame(out, columns=["block", "bucket", "kind", "a"])

    def finish(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows, window, gram)
        flag = flagged(block, answers[answers["kind"] == 0])
        which, number, contents, shard, _, places, key_of, keys, _ = gather(block, flag)
        answers = answers[answers["kind"] > 0]
        said = {(int(k), int(b)): np.frombuffer(x, "<i8") for k, b, x in zip(answers["kind"], answers["bucket"], answers["a"], strict=True)}
        owners = np.fromiter((-1 if x is None else x for x in block.ids), "i8", len(block.ids))
        gone = np.zeros(len(block.hashes) + 1, "i8")
        sizes = np.zeros(len(contents), "i8")
        sizes[number] = block.stop[which] - block.start[which]
        given: list[np.ndarray] = [np.zeros(0, "i8")] * len(contents)
        for b, part in _cells(shard):
            for i, x in zip(part.tolist(), np.split(said[1, b], np.cumsum(sizes[part])[:-1]), strict=True):
                given[i] = x
        for i, c in zip(which.tolist(), number.tolist(), strict=True):
            at = block.start[i] + np.flatnonzero(given[c] < owners[block.doc[i]])
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
        if len(places):
            least = np.empty(len(keys), "i8")
            for b, part in _cells((keys[:, 0] % np.uint64(n)).astype("i8")):
                least[part] = said[2, b]
            doc = np.searchsorted(block.first, places, side="right") - 1
            at = places[least[key_of] < owners[doc]]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
        removed = np.cumsum(gone)[:-1] > 0
        out = []
        for doc, words, first in zip(block.ids, block.words, block.first.tolist(), strict=True):
            drop = removed[first : first + len(words)]
            if drop.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], drop.view("i1"), [0]])))
                kept = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
            else:
                edges, kept = np.zeros(0, "i8"), words
            out.append((doc, len(words), int(drop.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), edges[::2], edges[1::2]))
        frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "starts", "ends"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    answer = "block int, bucket int, kind int, a binary"
    dealt = blocks.groupBy("block")
    flags = dealt.applyInPandas(ask_anchors, cell).groupBy("bucket").applyInPandas(judge_anchors, answer)
    asked = dealt.cogroup(flags.groupBy("block")).applyInPandas(ask_segments, cell)
    answers = flags.union(asked.groupBy("bucket").applyInPandas(search, answer))
    return dealt.cogroup(answers.groupBy("block")).applyInPandas(finish, OUT + ", starts array<long>, ends array<long>")


def distinct_segments(at: np.ndarray, sizes: list[int], told: list[np.ndarray], n: int) -> np.ndarray:
    """How many different segments stand under each of ``n`` anchors: ``at`` says which anchor each entry of the blocks is, ``told`` has,
    for each block, how many segments its entries have and then their fingerprints."""
    count = np.concatenate([x[:k] for x, k in zip(told, sizes, strict=True)])
    prints = np.concatenate([x[k:] for x, k in zip(told, sizes, strict=True)])
    pairs = np.unique(np.repeat(at.astype("u8"), count) << np.uint64(32) | prints)
    return np.bincount((pairs >> np.uint64(32)).astype("i8"), minlength=n)


def _cells(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each bucket that occurs, the places where it does, in order."""
    if not len(bucket):
        return []
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    return list(zip(bucket[by][np.concatenate([[0], cuts])].tolist(), np.split(by, cuts), strict=True))


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, with the repeated words taken out of ``text``; a text that loses none stays as it is, one
    that loses some has one space between its words."""
    name = "_repeated"
    while name in docs.columns:
        name += "_"
    found = repeats(docs, **options).filter("n_removed > 0")
    found = found.select(F.col("doc_id").alias(name), F.arrays_zip("starts", "ends").alias(name + "s")).dropDuplicates([name])
    joined = docs.join(found.hint("merge"), docs["doc_id"] == found[name], "left")
    words = F.array_remove(F.split("text", SPACE_RUN), "")
    gone = F.col(name + "s")
    return joined.withColumn("text", F.when(gone.isNull(), F.col("text")).otherwise(_without(words, gone))).drop(name, name + "s")


def _without(words, gone):
    """The words outside the intervals, which are in order and apart: the stretches between them, joined."""
    def cut(w, g):
        stretches = F.transform(
            F.sequence(F.lit(0), F.size(g)),
            lambda i: F.slice(
                w,
                (F.when(i > 0, F.get(g, i - 1)["ends"]).otherwise(F.lit(0)) + 1).cast("int"),
                (F.when(i < F.size(g), F.get(g, i)["starts"]).otherwise(F.size(w)) - F.when(i > 0, F.get(g, i - 1)["ends"]).otherwise(F.lit(0))).cast("int"),
            ),
        )
        return F.array_join(F.flatten(stretches), " ")

    return let(words, lambda w: let(gone, lambda g: cut(w, g)))
