"""Scores by a weighted backoff automaton over smoothed word n-grams.

Counts come from all training documents. Documents are dealt into blocks; a block sends the n-grams of its texts, as
sorted 64-bit hashes with its own training counts, to buckets by hash, and each bucket sums them over all blocks and
answers in the order of the request. A frequent n-gram reaches its bucket once from each block at most. Words and pairs go
first; the answers say which pairs other blocks hold too. A longer n-gram is asked for only where all its pairs are
shared so, as no other block can hold one with a pair of this block's own; its count is the block's then.

With the answers a block builds the part of the automaton that its texts can reach: a state for each known context, arcs
with the smoothed log-probability of each word that follows it, and a failure arc with the backoff weight to the state of
the context without its first word, down to the root. One traversal from left to right carries a state through each text:
it takes the arc of the next word, or failure arcs until there is one, and adds up what they weigh.

Smoothing is Jelinek-Mercer: a word's probability after a context is ``weight`` of its relative frequency there and the
rest of its probability after the shorter context; the shortest, the empty one, takes add-one counts with one place for
all unknown words. A text ends with one end token. A null or empty text is the end token alone; repeated rows count as
often as they stand there; with no training documents every word is unknown. Very long texts are traversed in stretches,
each begun ``order - 1`` words earlier at the root, after which the state is that of the whole text. Counts have 64 bits.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .common import squeeze, squeezed_blocks, texts, unsqueeze, unsqueezed

OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Stands before the first word.
BEGIN = np.uint64(0xD1B54A32D192ED03)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, their order told apart."""
    x = (a ^ (a >> np.uint64(29))) * _MIX + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Block:
    """Some texts as hashes of their tokens, the end token last; ``first`` says where each text begins."""

    def __init__(self, texts: list[str]):
        import xxhash

        end = np.uint64(xxhash.xxh3_64_intdigest(b"")).tobytes()
        memo = Memo(lambda w: xxhash.xxh3_64_intdigest(w).to_bytes(8, "little"))
        each = [b"".join(map(memo.__getitem__, t.encode().lower().split())) + end for t in texts]
        self.lengths = np.fromiter((len(x) // 8 for x in each), "i8", len(each))
        self.first = np.cumsum(self.lengths) - self.lengths
        self.tokens = np.frombuffer(b"".join(each), "<u8")

    def grams(self, order: int) -> list[np.ndarray]:
        """For each length from 1 to ``order``, the hash of the n-gram that ends at each token."""
        out, before = [self.tokens], self.tokens
        for _ in range(1, order):
            prior = np.concatenate([[BEGIN], before[:-1]]).astype("u8")
            prior[self.first] = BEGIN
            before = mix(prior, self.tokens)
            out.append(before)
        return out


class Automaton:
    """States are numbers, 0 the root. Arcs are sorted by state and word; each has a log-probability and the next state. A
    failure arc leads from every state but the root to the state of the context without its first word, at ``fail_log``."""

    def __init__(self, n_words: int, arcs: np.ndarray, logs: np.ndarray, following: np.ndarray, fail: np.ndarray, fail_log: float, unknown_log: float):
        self.n_words, self.arcs, self.logs, self.following = n_words, arcs, logs, following
        self.fail, self.fail_log, self.unknown_log = fail, fail_log, unknown_log

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the log-probabilities of ``word`` (numbers of known words, else -1) from the states of many
        texts at once."""
        after, logp = np.zeros(len(state), "i8"), np.zeros(len(state))
        at, rows = state, np.arange(len(state))
        while len(rows):
            key = at * np.int64(self.n_words) + word[rows]
            # keys in order are found near each other, which spares most of the memory's latency
            by = np.argsort(key)
            place = np.empty(len(key), "i8")
            place[by] = np.searchsorted(self.arcs, key[by])
            place[place == len(self.arcs)] = 0
            hit = (self.arcs[place] == key) & (word[rows] >= 0) if len(self.arcs) else np.zeros(len(key), bool)
            after[rows[hit]] = self.following[place[hit]]
            logp[rows[hit]] += self.logs[place[hit]]
            stuck = ~hit & (at == 0)
            logp[rows[stuck]] += self.unknown_log  # and the next state is the root
            down = ~hit & ~stuck
            rows = rows[down]
            logp[rows] += self.fail_log
            at = self.fail[at[down]]
        return after, logp


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them, byte by byte, since the high bytes of steps are mostly zero."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(steps.view("u1").reshape(-1, 8).T).tobytes(), 1)


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype="u8")


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest, and how many these are."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(counts) or int(counts.max()) < 1 << 8 * s)
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("i8")


def merge(cells: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Packed keys and counts of many blocks put together: the total of each distinct key, in how many cells it stands, and
    for each cell the places of its keys among them."""
    keys = [unpack_keys(k) for k, _ in cells]
    distinct, at = np.unique(np.concatenate(keys) if keys else np.zeros(0, "u8"), return_inverse=True)
    totals = np.zeros(len(distinct), "i8")
    places = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
    for place, (_, counts) in zip(places, cells, strict=True):
        totals[place] += unpack_counts(counts)  # a cell holds a key once
    return totals, np.bincount(at, minlength=len(distinct)), places


class Grams:
    """The distinct n-grams of one length in a block: keys in order, which one ends at each token, its training count here."""

    def __init__(self, hashes: np.ndarray, trains: np.ndarray, n: int):
        self.keys, at = np.unique(hashes, return_inverse=True)
        self.at = at.astype("i4")  # a block has fewer tokens than that holds
        self.seen = np.bincount(self.at[trains], minlength=len(self.keys))
        # keys in order are buckets in order, as a bucket is a range of keys
        self.bucket = (((self.keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype("i8")

    def cells(self, wanted: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each bucket that some of the ``wanted`` keys fall into, their places."""
        which = np.flatnonzero(wanted)
        if not len(which):
            return []
        cuts = np.flatnonzero(np.diff(self.bucket[which])) + 1
        return [(int(self.bucket[p[0]]), p) for p in np.split(which, cuts)]


def score(docs: DataFrame, order: int = 3, weight: float = 0.3, block_bytes: int = 9 << 20) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text), see OUT; ``order`` is the longest n-gram, 2 at least."""
    blocks, n = squeezed_blocks(texts(docs), block_bytes)

    def ordered(rows: pd.DataFrame) -> tuple[list, Block, np.ndarray, np.ndarray]:
        held = unsqueezed(rows["rows"])
        ids = [i for i, _ in held]
        block, out = Block([t for _, t in held]), np.array([held_out(x) for x in ids], bool)
        return ids, block, out, np.repeat(~out, block.lengths)

    def ask(number: int, k: int, grams: Grams, wanted: np.ndarray) -> list[tuple]:
        return [(b, number, k, pack_keys(grams.keys[p]), pack_counts(grams.seen[p])) for b, p in grams.cells(wanted)]

    def ask_short(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["block"].iat[0])
        _, block, _, trains = ordered(rows)
        cells = []
        for k, hashes in enumerate(block.grams(2)):
            grams = Grams(hashes, trains, n)
            cells += ask(number, k, grams, np.ones(len(grams.keys), bool))
        return pd.DataFrame(cells, columns=["bucket", "block", "k", "keys", "seen"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        known = tokens = 0
        for k, cells in rows.groupby("k"):
            totals, blocks_, places = merge(list(zip(cells["keys"], cells["seen"], strict=True)))
            if k == 0:
                known, tokens = int((totals > 0).sum()), int(totals.sum())
            for block, bucket, p in zip(cells["block"], cells["bucket"], places, strict=True):
                out.append((int(block), int(bucket), int(k), squeeze(pack_counts(totals[p]), 1), np.packbits(blocks_[p] > 1).tobytes() if k == 1 else None))
        frame = pd.DataFrame(out, columns=["block", "bucket", "k", "total", "shared"])
        frame["known"], frame["tokens"] = 0, 0
        frame.loc[0, ["known", "tokens"]] = known, tokens
        return frame

    def said(answers: pd.DataFrame, k: int, column: str, grams: Grams, wanted: np.ndarray) -> np.ndarray:
        """What the buckets answered for each of the ``wanted`` keys; 0 for others."""
        some = answers[answers["k"] == k]
        by_bucket = dict(zip(some["bucket"].tolist(), some[column], strict=True))
        out = np.zeros(len(grams.keys), "i8")
        for b, p in grams.cells(wanted):
            data = by_bucket[b]
            out[p] = unpack_counts(unsqueeze(data)) if column == "total" else np.unpackbits(np.frombuffer(data, "u1"), count=len(p))
        return out

    def open_grams(hashes: list[np.ndarray], pairs: Grams, trains: np.ndarray, answers: pd.DataFrame):
        """The n-grams of three words and more, each with which keys are asked for: all pairs in them are shared."""
        shared = said(answers, 1, "shared", pairs, np.ones(len(pairs.keys), bool)).astype(bool)[pairs.at]
        whole = shared
        for k in range(2, order):
            whole = whole & np.concatenate([np.zeros(k - 1, bool), shared[: len(shared) - k + 1]])
            grams = Grams(hashes[k], trains, n)
            wanted = np.zeros(len(grams.keys), bool)
            wanted[grams.at[whole]] = True
            yield k, grams, wanted

    def ask_long(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["block"].iat[0])
        _, block, _, trains = ordered(rows)
        hashes = block.grams(order)
        found = open_grams(hashes, Grams(hashes[1], trains, n), trains, answers)
        cells = [c for k, grams, wanted in found for c in ask(number, k, grams, wanted)]
        return pd.DataFrame(cells, columns=["bucket", "block", "k", "keys", "seen"])

    def finish(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, block, out, trains = ordered(rows)
        n_train, n_known = int(answers["all_tokens"].iat[0]), int(answers["all_known"].iat[0])
        counts, hashes = [], block.grams(order)
        for k in range(2):
            grams = Grams(hashes[k], trains, n)
            counts.append((grams.at, said(answers, k, "total", grams, np.ones(len(grams.keys), bool))))
        for k, grams, wanted in open_grams(hashes, grams, trains, answers):
            counts.append((grams.at, np.where(wanted, said(answers, k, "total", grams, wanted), grams.seen)))
        del hashes, grams
        at, total = counts[0]
        seen = total[at]
        base = np.log10((seen + 1) / (n_train + n_known + 1))
        ends = int(total[at[-1]])  # as many end tokens as training texts, so this is how often a text began
        auto, words, begin = automaton(block, counts, n_train, n_known, weight, ends)
        by_text = lambda x: np.add.reduceat(x, block.first)  # noqa: E731  no text is without a token
        return pd.DataFrame({
            "doc_id": pd.array(ids, dtype="Int64"), "held_out": out, "n_tokens": block.lengths, "n_known": by_text((seen > 0).astype("i8")),
            "train_tokens": n_train, "base_score": by_text(base), "score": by_text(traverse(auto, words, begin, block, order)),
        })

    cell, said_cell = "bucket int, block int, k int, keys binary, seen binary", "block int, bucket int, k int, total binary, shared binary, known long, tokens long"
    dealt = blocks.groupBy("block")
    answers = dealt.applyInPandas(ask_short, cell).groupBy("bucket").applyInPandas(answer, said_cell)
    totals = answers.agg(F.sum("known").alias("all_known"), F.sum("tokens").alias("all_tokens")).withColumn("one", F.lit(1))
    if order > 2:
        asked = dealt.cogroup(answers.groupBy("block")).applyInPandas(ask_long, cell)
        answers = answers.union(asked.groupBy("bucket").applyInPandas(answer, said_cell))
    # one row of two sums, whatever the input's size
    answers = answers.drop("known", "tokens").withColumn("one", F.lit(1)).join(F.broadcast(totals), "one").drop("one")
    return dealt.cogroup(answers.groupBy("block")).applyInPandas(finish, OUT)


def automaton(block: Block, counts: list[tuple[np.ndarray, np.ndarray]], n_train: int, n_known: int, weight: float, n_begin: int):
    """The part of the automaton that the texts of a block can reach, for each token its number (-1: unknown), and the state
    before the first word. ``counts`` has for each length which n-gram ends at each token and how often each one stands."""
    at, total = counts[0]
    words = np.where(total[at] > 0, at, -1)
    n_words, order = len(total), len(counts)
    # known n-grams shorter than the longest are states; state_of[k][i] is that of the i-th one of k + 1 words, else 0
    state_of, n_states = [], 1
    for _, total in counts[: order - 1]:
        state_of.append(np.where(total > 0, n_states - 1 + np.cumsum(total > 0), 0))
        n_states += int((total > 0).sum())
    begin = n_states if n_begin > 0 else 0
    n_states += 1
    fail = np.zeros(n_states, "i8")
    for k in range(1, order - 1):
        fail[state_of[k][counts[k][0]]] = state_of[k - 1][counts[k - 1][0]]
    if order > 2:
        fail[state_of[1][counts[1][0][block.first]]] = state_of[0][counts[0][0][block.first]]
    fail[0] = 0
    root = np.log10((counts[0][1] + 1) / (n_train + n_known + 1))
    some = np.flatnonzero(counts[0][1] > 0)
    arcs, logs, following = [some], [root[some]], [state_of[0][some]]
    lower = 10.0 ** root[at]
    offset = np.arange(len(at)) - np.repeat(block.first, block.lengths)
    for k in range(1, order):
        state = np.concatenate([[0], state_of[k - 1][counts[k - 1][0]][:-1]])
        before = np.concatenate([[0], counts[k - 1][1][counts[k - 1][0]][:-1]])
        short = offset < k - 1  # so few words stand before, even with the mark of the beginning
        state[short], before[short] = 0, 0
        if k == 1:
            state[block.first], before[block.first] = begin, n_begin
        seen = counts[k][1][counts[k][0]]
        known = before > 0
        p = np.where(known, weight * seen / np.maximum(before, 1) + (1 - weight) * lower, lower)
        has = known & (seen > 0) & (words >= 0)
        # a known state and a word are one n-gram, so any place where it ends stands for its arc
        one = np.full(len(counts[k][1]), -1)
        one[counts[k][0][has]] = np.flatnonzero(has)
        one = one[one >= 0]
        last = min(k, order - 2)
        arcs.append(state[one] * np.int64(n_words) + words[one])
        logs.append(np.log10(p[one]))
        following.append(state_of[last][counts[last][0][one]])
        lower = p
    by = np.argsort(np.concatenate(arcs))
    auto = Automaton(
        n_words, np.concatenate(arcs)[by], np.concatenate(logs)[by], np.concatenate(following)[by], fail, math.log10(1 - weight),
        -math.log10(n_train + n_known + 1),
    )
    return auto, words, begin


def traverse(auto: Automaton, words: np.ndarray, begin: int, block: Block, order: int, stretch: int = 2000) -> np.ndarray:
    """Each token's log-probability: all texts of the block go from left to right together, the shorter ones stop first."""
    parts = -(-block.lengths // stretch)
    text = np.repeat(np.arange(len(parts)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = block.first[text] + number * stretch
    stop = np.minimum(start + stretch, (block.first + block.lengths)[text])
    state = np.where(number > 0, 0, begin)
    warm = np.where(number > 0, start - (order - 1), start)
    by = np.argsort(warm - stop, kind="stable")
    start, stop, state, warm = start[by], stop[by], state[by], warm[by]
    out = np.zeros(len(words))
    live = len(by)
    for t in range(int((stop - warm).max()) if live else 0):
        while stop[live - 1] - warm[live - 1] <= t:
            live -= 1
        here = warm[:live] + t
        state, logp = auto.step(state[:live], words[here])
        counted = here >= start[:live]
        out[here[counted]] = logp[counted]
    return out
