"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens (words with A-Z in lower case, then one end).  A token
is coded in two steps: the Huffman path of its class, bit by bit, then the token
within its class.  The most frequent tokens are classes of their own; every other
token, known or not, belongs to one of ``GROUPS`` classes by a hash of its last bytes.

A bit of a class path has four predictors: the node's own frequencies, and hashed
contexts of the previous word, of its class, and of the last two classes.  Their
counts are gathered from all training texts; rare contexts fall back on the node's
frequencies.  Their logits are mixed by weights that a gate (the bit's depth)
selects.  The weights start from one Newton step over all training texts, whose bits
are predicted by the tables of the half that lacks them (halves by a hash of the
text), and learn online in each text, after every ``STEP`` tokens; an
adaptive map of the mixed probability, by gate and logit, learns along with them and
refines it.

Within a class a token has its training count, less a discount; the discounts are
what tokens never seen share, times the probability of their spelling: bits of their
bytes' Huffman paths, mixed from hashed contexts of one to five bytes before, with
weights learned in the same way from all words of the training texts, and frozen.

What the model knows grows with the input in two tables that stay distributed and
are joined: the counts of all tokens, and those of all phrases.  A phrase is a
stretch of ``LEAST`` words or more between words whose hash is a multiple of
``CLOSING``.  One that a training text holds, other than the scored text itself, is
coded as a whole by its count; one that stood earlier in the same text as one of
those before.  Which of the three it is, is a binary choice with an adaptive
probability (counts by the choice before, from a beta prior), so copied passages cost
little however large the corpus is.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, byte_texts, discard, offsets, portions, prepare, segment_sums, settle

#: Tokens with a class of their own, at most; classes of the others; size of a row of classes or nodes.
SINGLES, GROUPS, CLASSES = 96, 32, 128
#: Tokens whose counts all tasks hold, at most; the most frequent of them are contexts of their own.
KNOWN, NEAR = 200_000, 4096
#: Contexts of each predictor: previous word, its class, hash of the last two classes.
CONTEXTS = (NEAR + CLASSES, CLASSES, 1 << 14)
INPUTS = 1 + len(CONTEXTS)
ROWS = offsets(CONTEXTS)
#: Orders of spelling, slots of each of its tables.
ORDERS, SLOT_BITS = 5, 20
SLOTS = 1 << SLOT_BITS
GATES, DEPTHS = 8, 8
STEP = 64
RATE, REFINE = 0.003, 0.02
#: Added to both counts of a spelling predictor; spread by the node's frequencies over those of a class bit.
PRIOR, SPREAD = 1.0, 4.0
CELLS = 24
#: Words of a phrase: at least, at most; a phrase ends at words whose hash is a multiple of CLOSING.
LEAST, MOST, CLOSING = 4, 32, 8
#: Beta priors (yes, no) of a choice after a no and after a yes.
AFTER_NO, AFTER_YES = (0.05, 1.0), (1.0, 0.5)
#: How strongly learned weights are drawn to those they start from.
RIDGE = 10.0
#: Counters of a row in which tables travel; bytes of text whose bits are worked on at a time.
PIECE, PORTION = 1 << 15, 1 << 18
#: The end of a text; no word holds a space.
END = b" "

_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(MOST, 0xD6E8FEB86659FD93, dtype=np.uint64))


def huffman(weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each symbol its path: (inner node, bit) from the root; nodes are numbered from 0 at the root."""
    n = len(weights)
    heap = [(float(w), i) for i, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    up = np.zeros(2 * n, dtype=np.int64)
    side = np.zeros(2 * n, dtype=np.int8)
    new = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        up[i], up[j], side[j] = new, new, 1
        heapq.heappush(heap, (a + b, new))
        new += 1
    root = new - 1
    paths = []
    for i in range(n):
        path, k = [], i
        while k != root:
            path.append((root - int(up[k]), int(side[k])))
            k = int(up[k])
        paths.append(path[::-1])
    return paths


class Paths:
    """Huffman paths of symbols, one after the other."""

    def __init__(self, weights: np.ndarray):
        paths = huffman(weights)
        self.begins = offsets([len(p) for p in paths]).astype(np.int32)
        self.sizes = np.diff(self.begins)
        self.nodes = np.array([x for p in paths for x, _ in p], dtype=np.int32)
        self.bits = np.array([b for p in paths for _, b in p], dtype=np.int8)
        # How many times each side of an inner node is taken by a symbol: sides[bit, symbol, node].
        self.sides = np.zeros((2, len(weights), max(1, len(weights) - 1)), dtype=np.float32)
        self.sides[self.bits, np.repeat(np.arange(len(weights)), self.sizes), self.nodes] = 1
        below = np.maximum(np.asarray(weights, dtype=np.float64) @ self.sides, 1e-9)
        self.share = below[1] / below.sum(axis=0)
        self.logits = np.log(below[1] / below[0]).astype(np.float32)

    def spread(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``symbols``, depth, node and bit of every bit of their paths."""
        sizes = self.sizes[symbols]
        owner = np.repeat(np.arange(len(symbols), dtype=np.int32), sizes)
        first = (np.cumsum(sizes) - sizes).astype(np.int32)
        depth = np.arange(len(owner), dtype=np.int32) - first[owner]
        at = depth + self.begins[symbols][owner]
        return owner, depth, self.nodes[at], self.bits[at]


def _slot(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The slot of a node (int32) in a context (uint32)."""
    h = (context ^ (node.view(np.uint32) * _A)) * _B
    h ^= h >> np.uint32(15)
    h *= _A
    return (h >> np.uint32(32 - SLOT_BITS)).view(np.int32)


class _Groups(dict):
    """Groups by the last bytes of a word, of which there are few."""

    def __missing__(self, ending: bytes) -> int:
        import xxhash

        self[ending] = xxhash.xxh64_intdigest(ending, seed=42) % GROUPS
        return self[ending]


_GROUPS = _Groups()


def group_of(word: bytes) -> int:
    """The group of a word: a hash of its last two bytes."""
    return _GROUPS[word[-2:]]


def group_column(token: str) -> Column:
    """``group_of`` of a binary column."""
    return F.pmod(F.xxhash64(F.substring(token, -2, 2)), F.lit(GROUPS)).cast("int")


@dataclass
class Vocabulary:
    """Frequent tokens by falling count, with the totals of all tokens of the training texts.

    ``group_n`` and ``group_v`` are the counts and numbers of all tokens by group,
    ``discount`` is what a count within a group loses to tokens never seen.
    """

    tokens: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    group_n: np.ndarray
    group_v: np.ndarray
    discount: float

    def __post_init__(self):
        self.singles = min(int((self.counts >= 2).sum()), SINGLES)
        n, v = self.group_n.astype(np.float64), self.group_v.astype(np.float64)
        for t, c in zip(self.tokens[: self.singles], self.counts[: self.singles].tolist()):
            n[group_of(t)] -= c
            v[group_of(t)] -= 1
        self.mass = np.maximum(n, 0) + 0.5
        self.unseen = np.maximum(v, 0) * self.discount + 0.5
        self.paths = Paths(np.append(self.counts[: self.singles], self.mass).astype(np.float64))
        seen = np.ones(256)
        for t in self.tokens[:50_000]:
            for b, k in Counter(t + b" ").items():
                seen[b] += k
        self.bytes = Paths(seen)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.end = self.ids.get(END, -1)

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every bit that spells the words and a closing space: the word's place, depth, bit, and its slots by order."""
        text = np.frombuffer(b"".join([w + b" " for w in words]), dtype=np.uint8)
        begins = offsets([len(w) + 1 for w in words])
        owner = np.repeat(np.arange(len(words)), np.diff(begins))
        inside = np.arange(len(text)) - begins[:-1][owner] if len(text) else np.zeros(0, np.int64)
        which, depth, node, bit = self.bytes.spread(text)
        slots = np.empty((ORDERS, len(which)), dtype=np.int32)
        context = np.zeros(len(text), dtype=np.uint32)
        for k in range(1, ORDERS + 1):
            before = np.full(len(text), 256, dtype=np.uint32)
            inner = np.flatnonzero(inside >= k)
            before[inner] = text[inner - k]
            context = (context * np.uint32(263) + before + np.uint32(k)) * _A
            slots[k - 1] = _slot(context[which], node)
        return owner[which], np.minimum(depth, DEPTHS - 1), bit, slots


def spelling_inputs(logits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return np.array([logits[k][slots[k]] for k in range(ORDERS)], dtype=np.float32).reshape(ORDERS, -1)


def newton_sums(x: np.ndarray, y: np.ndarray, gate: np.ndarray, w: np.ndarray) -> np.ndarray:
    """By gate the curvature and, as its last column, the slope of the log probability of bits ``y`` at weights ``w``.

    ``x`` has a row for each input.  The curvature is the mean of the expected and the
    observed one, so that bits whose probability is too sure don't make a step too long.
    """
    order = np.argsort(gate.astype(np.int8), kind="stable")
    cuts = np.searchsorted(gate[order], np.arange(len(w) + 1))
    out = np.zeros((len(w), len(x), len(x) + 1))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            own = x[:, order[a:b]]
            p = 1 / (1 + np.exp(-np.clip(w[k].astype(np.float32) @ own, -7.9, 7.9)))
            error = y[order[a:b]].astype(np.float32) - p
            out[k, :, :-1] = (own * (0.5 * (p * (1 - p) + error * error))) @ own.T
            out[k, :, -1] = own @ error
    return out


def newton_step(parts: DataFrame, w: np.ndarray) -> np.ndarray:
    """``w`` after a step by the summed ``parts(sums)``; rounded, so the order of sums doesn't show."""
    n, k = w.shape
    total = sum((np.frombuffer(r["sums"]).reshape(n, k, k + 1) for r in parts.collect()), np.zeros((n, k, k + 1)))
    step = [np.linalg.solve(t[:, :-1] + RIDGE * np.eye(k), t[:, -1]) for t in total]
    return np.round(w + np.array(step), 4)


def spelling_start() -> np.ndarray:
    return np.full((DEPTHS, ORDERS), 0.35)


def learn_spelling(counts: DataFrame, half: Column, words: Vocabulary, tables: list[np.ndarray]) -> np.ndarray:
    """Mixing weights of spelled bits by depth, from every word of ``counts(token)``: those of a half by the other's table."""
    import pyarrow as pa

    prepare(counts.sparkSession, 10_000)
    shared = counts.sparkSession.sparkContext.broadcast((words, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tables = shared.value
        logits, w = [t.astype(np.float32) for t in tables], spelling_start()
        sums = np.zeros((DEPTHS, ORDERS, ORDERS + 1))
        for batch in batches:
            for i, tokens in enumerate(halves(batch)):
                mine = [t for t in tokens if t != END]
                for a, b in portions(mine, PORTION):
                    _, depth, bit, slots = words.spell(mine[a:b])
                    sums += newton_sums(spelling_inputs(logits[1 - i], slots), bit, depth, w)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], names=["sums"])

    return newton_step(counts.select("token", half.alias("half")).mapInArrow(run, "sums binary"), spelling_start())


@dataclass
class MixModel:
    """Frozen predictors (logits by context and node, and of spelling by slot) and mixing weights to start from."""

    words: Vocabulary
    spelling: np.ndarray
    spelling_weights: np.ndarray
    logits: np.ndarray
    start: np.ndarray


_WORKERS: dict[str, "Worker"] = {}


class Worker:
    """A worker's view of a vocabulary: what it knows of the frequent tokens is kept, others are described when they come."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.frequent = self.describe(words.tokens, np.arange(len(words.tokens)))

    @classmethod
    def of(cls, key: str, words: Vocabulary) -> "Worker":
        """The process's worker for a job's ``key``: words stay known from task to task."""
        if key not in _WORKERS:
            _WORKERS.clear()
            _WORKERS[key] = cls(words)
        return _WORKERS[key]

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """``describe`` of words that may be frequent tokens."""
        number = np.fromiter(map(self.words.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        out = np.empty((len(words), 4), dtype=np.int64)
        held = number >= 0
        out[held] = self.frequent[number[held]]
        new = np.flatnonzero(~held)
        out[new] = self.describe([words[i] for i in new.tolist()], number[new])
        return out

    def describe(self, words: list[bytes], number: np.ndarray) -> np.ndarray:
        """For each word: number among the frequent tokens or -1, hash, class, and 1e6 log2 of its share of the class.

        The share of a word that isn't among the frequent tokens lacks its count.
        """
        import xxhash

        known, n = self.words, len(words)
        out = np.zeros((n, 4), dtype=np.int64)
        out[:, 0] = number
        out[:, 1] = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n).view(np.int64)
        group = np.array([_GROUPS[w[-2:]] for w in words], dtype=np.int64)
        single = (out[:, 0] >= 0) & (out[:, 0] < known.singles)
        out[:, 2] = np.where(single, out[:, 0], known.singles + group)
        count = known.counts[out[:, 0]] - known.discount if len(known.counts) else np.ones(n)
        share = np.log2(np.where(out[:, 0] >= 0, count, 1.0) / known.mass[group])
        out[:, 3] = np.where(single, 0, 1e6 * share)
        return out


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The tokens of ``texts``: bounds by text, and each token's place in the list of the different ones."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = pa.array(texts, pa.large_binary())
    held = pa.Array.from_buffers(pa.large_string(), len(held), held.buffers())  # split and lowered as ASCII, so not looked at as UTF-8
    lists = pc.ascii_split_whitespace(pc.ascii_lower(held))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    before = offsets(full.to_numpy(zero_copy_only=False))
    bounds = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()] + np.arange(len(texts) + 1)
    coded = flat.filter(full).dictionary_encode()
    words = pa.Array.from_buffers(pa.large_binary(), len(coded.dictionary), coded.dictionary.buffers()).to_numpy(zero_copy_only=False).tolist()
    # An end follows the words of each text.
    which = np.full(bounds[-1], len(words), dtype=np.int64)
    inner = np.ones(bounds[-1], dtype=bool)
    inner[bounds[1:] - 1] = False
    which[inner] = coded.indices.to_numpy()
    return bounds, which, [*words, END]


class Bits:
    """The phrases and class bits of some texts, step by step, with what their predictors look up."""

    def __init__(self, worker: Worker, texts: list[bytes]):
        words = worker.words
        self.bounds, self.found, self.words = split_words(texts)
        rows = worker.lookup(self.words)[self.found]
        n, sizes = len(self.found), np.diff(self.bounds)
        self.known, self.size = rows[:, 0], n
        self.texts = len(texts)
        lane = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
        place = np.arange(n) - np.repeat(self.bounds[:-1], sizes)
        self.lane, self.share = lane, rows[:, 3] / 1e6
        self.word_hashes = rows[:, 1].view(np.uint64)
        kind = rows[:, 2].astype(np.int32)
        near = np.where((rows[:, 0] >= 0) & (rows[:, 0] < NEAR), rows[:, 0], NEAR + kind).astype(np.int32)
        last = self.bounds[1:] - 1  # an end stands before the first word, as it does between texts

        def back(x: np.ndarray, d: int) -> np.ndarray:
            out = np.empty_like(x)
            out[d:] = x[: max(0, n - d)]
            early = place < d
            out[early] = x[last[lane[early]]]
            return out

        one, two = back(kind, 1), back(kind, 2)
        mixed = ((one * np.int32(CLASSES) + two).view(np.uint32) * _A) >> np.uint32(18)
        self.contexts = [back(near, 1) + np.int32(ROWS[0]), one + np.int32(ROWS[1]), mixed.view(np.int32) + np.int32(ROWS[2])]
        self.kind, self.place = kind, place

    def part(self) -> "Bits":
        """Parts the texts into stretches; ``first`` is each one's first like one in its text, itself included."""
        n, hashes = self.size, self.word_hashes
        closing = (hashes % np.uint64(CLOSING)) == 0
        ends = self.bounds[1:] - 1
        begin = np.zeros(n, dtype=bool)
        begin[1:] = closing[:-1]
        begin[self.bounds[:-1]] = True
        begin[ends] = True
        at = np.flatnonzero(begin)
        inside = np.arange(n) - at[np.cumsum(begin) - 1]
        begin |= inside % MOST == 0
        at = np.flatnonzero(begin)
        self.stretch = np.cumsum(begin) - 1
        length = np.diff(np.append(at, n))
        total = np.add.reduceat(hashes * _POWERS[inside % MOST], at) if n else hashes
        total = (total ^ (total >> np.uint64(29))) * _ODD + length.astype(np.uint64)
        self.of_text = self.lane[at]
        self.phrase = length >= LEAST
        self.phrase[self.stretch[ends]] = False
        self.hashes = total.view(np.int64)
        self.first = np.arange(len(at))
        which = np.flatnonzero(self.phrase)
        own = total[which] ^ (self.of_text[which].astype(np.uint64) + np.uint64(1)) * _ODD
        _, index, back = np.unique(own, return_index=True, return_inverse=True)
        self.first[which] = which[index[back]]
        self.again = self.first != np.arange(len(at))
        # Phrases that aren't repeats are numbered within their text.
        new = self.phrase & ~self.again
        before = np.cumsum(new)
        text_first = np.searchsorted(self.of_text, np.arange(self.texts))
        self.before = before - new - (before - new)[text_first][self.of_text]
        self.new = np.flatnonzero(new)
        self.asked = np.bincount(self.of_text[new], minlength=self.texts)
        return self

    def choices(self) -> np.ndarray:
        """log2 probability, by text, of which phrases are repeats and of which ones."""
        which = np.flatnonzero(self.phrase)
        text, yes = self.of_text[which], self.again[which]
        prior = np.zeros(len(which), dtype=bool)
        prior[1:] = yes[:-1] & (text[1:] == text[:-1])
        tally = [np.bincount(text[m], minlength=self.texts) for m in (yes & ~prior, ~yes & ~prior, yes & prior, ~yes & prior)]
        back = which[yes]
        named = np.bincount(self.of_text[back], -np.log2(np.maximum(1, self.before[back])), self.texts)
        return choice_cost(tally[0], tally[1], *AFTER_NO) + choice_cost(tally[2], tally[3], *AFTER_YES) + named

    def turns(self, paths: Paths) -> None:
        """Lays out the class bits of the tokens outside repeats: all texts' first steps before their second ones."""
        kept = np.flatnonzero(~self.again[self.stretch])
        lane = self.lane[kept]
        sizes = np.bincount(lane, minlength=self.texts)
        rank = np.empty(self.texts, dtype=np.int32)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(self.texts, dtype=np.int32)
        step = (np.arange(len(kept)) - offsets(sizes)[:-1][lane]) // STEP
        turn = np.argsort(step * self.texts + rank[lane], kind="stable")
        kept, step = kept[turn], step[turn]
        owner, depth, self.node, self.bit = paths.spread(self.kind[kept])
        self.owner, self.gate = owner, np.minimum(depth, GATES - 1)
        self.bit_stretch = self.stretch[kept]
        self.lanes = rank[self.lane[kept]]
        self.slots = [(c[kept] * np.int32(CLASSES))[owner] + self.node for c in self.contexts]
        cuts = np.searchsorted(step, np.arange(int(step[-1]) + 2 if len(step) else 1))
        self.cuts = np.searchsorted(owner, cuts)

    def unknown(self) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Text, phrase in it or -1, token, times, and times outside repeats of the tokens that aren't among the frequent ones."""
        at = np.flatnonzero(self.known < 0)
        stretch = self.first[self.stretch[at]]
        where = np.where(self.phrase[stretch], stretch, -1 - self.lane[at])
        _, first, back, times = np.unique((where << 32) | self.found[at], return_index=True, return_inverse=True, return_counts=True)
        once = np.bincount(back, ~self.again[self.stretch[at]], len(first)).astype(np.int64)
        here = where[first]
        number = np.where(here >= 0, self.before[np.maximum(here, 0)], -1) if len(here) else here
        return self.lane[at][first], number, [self.words[i] for i in self.found[at[first]].tolist()], times, once

    def count_into(self, table: np.ndarray) -> None:
        """Add the texts' classes to ``table``, by context."""
        for c in self.contexts:
            np.add.at(table, c * np.int32(CLASSES) + self.kind, np.float32(1))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    x = np.asarray(x, dtype=np.float64)
    down = np.zeros_like(x)
    for i in range(8):
        down += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - down


def choice_cost(yes: np.ndarray, no: np.ndarray, a: float, b: float) -> np.ndarray:
    """log2 probability of a sequence of choices, each predicted by the counts so far and a beta prior."""
    beta = lambda x, y: log_gamma(x) + log_gamma(y) - log_gamma(np.asarray(x) + y)
    return (beta(yes + a, no + b) - beta(a, b)) / np.log(2)


def class_logits(counts: np.ndarray, paths: Paths) -> np.ndarray:
    """Logits by context and node of ``counts`` by context and class."""
    leaves = paths.sides.shape[1]
    out = np.zeros((len(counts), CLASSES), dtype=np.float32)
    for a in range(0, len(counts), 4096):
        part = counts[a : a + 4096, :leaves]
        yes, no = part @ paths.sides[1] + SPREAD * paths.share, part @ paths.sides[0] + SPREAD * (1 - paths.share)
        out[a : a + 4096, : yes.shape[1]] = np.log(np.maximum(yes, 1e-6) / np.maximum(no, 1e-6))
    return out.reshape(-1)


def start_weights() -> np.ndarray:
    return np.full((GATES, INPUTS), 1.2 / INPUTS, dtype=np.float32)


def learn_start(texts: DataFrame, half: Column, words: Vocabulary, tables: list[np.ndarray]) -> np.ndarray:
    """Mixing weights of class bits by gate, from all ``texts(text)``: those of a half by the other's table."""
    import pyarrow as pa

    prepare(texts.sparkSession)
    shared, key = texts.sparkSession.sparkContext.broadcast((words, tables)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tables = shared.value
        worker, w = Worker.of(key, words), start_weights()
        sums = np.zeros((GATES, INPUTS, INPUTS + 1))
        for batch in batches:
            for i, rows in enumerate(halves(batch)):
                for a, b in portions(rows, PORTION):
                    bits = Bits(worker, rows[a:b])
                    owner, depth, node, bit = words.paths.spread(bits.kind)
                    x = [words.paths.logits[node], *(tables[1 - i][(c * np.int32(CLASSES))[owner] + node] for c in bits.contexts)]
                    sums += newton_sums(np.array(x), bit, np.minimum(depth, GATES - 1), w)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], names=["sums"])

    return newton_step(texts.select("text", half.alias("half")).mapInArrow(run, "sums binary"), start_weights()).astype(np.float32)


def mix(bits: Bits, words: Vocabulary, logits: np.ndarray, start: np.ndarray) -> np.ndarray:
    """log2 probability of the class bits of each stretch."""
    bits.turns(words.paths)
    lanes = bits.texts
    x = [words.paths.logits[bits.node], *(logits[s] for s in bits.slots)]
    y = bits.bit.astype(np.float32)
    lane = bits.lanes[bits.owner]
    gate = lane * np.int32(GATES) + bits.gate
    w = np.tile(start.T.astype(np.float32), (1, lanes))
    ladder = (1 / (1 + np.exp(-(np.arange(CELLS + 1) / 1.5 - CELLS / 3)))).astype(np.float32)
    refine = np.tile(ladder, lanes * GATES)
    cost = np.zeros(len(y), dtype=np.float32)
    for a, b in zip(bits.cuts.tolist(), bits.cuts[1:].tolist()):
        if a == b:
            continue
        ys, gs = y[a:b], gate[a:b]
        active = int(lane[b - 1]) + 1
        dot = x[0][a:b] * w[0][gs]
        for k in range(1, INPUTS):
            dot += x[k][a:b] * w[k][gs]
        np.clip(dot, -7.9, 7.9, out=dot)
        p = 1 / (1 + np.exp(-dot))
        scaled = (dot + np.float32(CELLS / 3)) * np.float32(1.5)
        low = scaled.astype(np.int32)
        part = scaled - low
        cell = gs * np.int32(CELLS + 1) + low
        under = refine[cell]
        refined = under + (refine[cell + 1] - under) * part
        final = np.clip(np.float32(0.5) * (p + refined), np.float32(1e-4), np.float32(1 - 1e-4))
        cost[a:b] = np.log2(np.abs(final - (1 - ys)))
        error = (ys - p) * np.float32(RATE)
        for k in range(INPUTS):
            w[k, : active * GATES] += np.bincount(gs, error * x[k][a:b], active * GATES)
        near = cell + (part > 0.5)
        span = active * GATES * (CELLS + 1)
        times, hits = np.bincount(near, minlength=span), np.bincount(near, ys, span)
        touched = np.flatnonzero(times)
        times, hits = times[touched], hits[touched]
        refine[touched] += ((1 - (1 - REFINE) ** times) * (hits / times - refine[touched])).astype(np.float32)
    return np.bincount(bits.bit_stretch[bits.owner], cost, len(bits.first))


def stretch_costs(bits: Bits, words: Vocabulary, logits: np.ndarray, start: np.ndarray) -> np.ndarray:
    """log2 probability of the words of each stretch that isn't a repeat, but for the counts of rare tokens."""
    within = np.bincount(bits.stretch, np.where(bits.again[bits.stretch], 0.0, bits.share), len(bits.first))
    return mix(bits, words, logits, start) + within


def token_counts(texts: DataFrame) -> DataFrame:
    """``(token, n)``: how often each token stands in ``texts(text)``, the ends included."""
    import pyarrow as pa

    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        emit = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "n"]
        )
        for batch in batches:
            rows = byte_texts(batch.column(0))
            for a, b in portions(rows):
                _, which, words = split_words(rows[a:b])
                held.update(dict(zip(words, np.bincount(which, minlength=len(words)).tolist())))
            if len(held) > 250_000:
                yield emit()
                held.clear()
        yield emit()

    return texts.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """The most frequent tokens of ``counts(token, n)``: those above the least count that leaves at most ``known``."""
    sums = counts.groupBy(group_column("token").alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    by_count = {r["n"]: r["count"] for r in counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().collect()}
    left, least = known, 100_001
    for n in sorted(by_count, reverse=True):
        if by_count[n] > left:
            break
        left, least = left - by_count[n], n
    rows = counts.where(F.col("n") >= least).toArrow()
    pairs = sorted(zip(rows.column("token").to_pylist(), rows.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    group_n, group_v = np.zeros(GROUPS, dtype=np.int64), np.zeros(GROUPS, dtype=np.int64)
    for r in sums:
        group_n[r["g"]], group_v[r["g"]] = r["n"], r["v"]
    once, twice = by_count.get(1, 0), by_count.get(2, 0)
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    return Vocabulary(
        [t for t, _ in pairs], np.array([n for _, n in pairs], dtype=np.int64), int(group_n.sum()), int(group_v.sum()), group_n, group_v, discount
    )


def _packed(flat: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The pieces of a table that aren't all zero: their numbers and contents."""
    pieces = np.pad(flat, (0, -len(flat) % PIECE)).reshape(-1, PIECE)
    full = np.flatnonzero(pieces.any(axis=1)).tolist()
    return full, [zlib.compress(pieces[k].tobytes(), 1) for k in full]


def halves(batch) -> list[list[bytes]]:
    """The first column of a batch where its second is false, and where it is true."""
    import pyarrow.compute as pc

    return [byte_texts(batch.filter(m).column(0)) for m in (pc.invert(batch.column(1)), batch.column(1))]


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sums of the pieces in ``parts(piece, half, counts)``, by half.

    Tables travel in pieces, so what a task adds up is of a fixed size.
    """
    import pyarrow as pa

    def add(key, table):
        sums = np.zeros((2, PIECE), dtype=np.float32)
        for half, x in zip(table.column(1).to_pylist(), table.column(2).to_pylist()):
            sums[int(half)] += np.frombuffer(zlib.decompress(x), dtype=np.float32)
        packed = [pa.array([zlib.compress(t.tobytes(), 1)]) for t in sums]
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), *packed], names=["piece", "one", "two"])

    found = parts.groupBy("piece").applyInArrow(add, "piece long, one binary, two binary").toArrow()
    out = np.zeros((2, -(-size // PIECE), PIECE), dtype=np.float32)
    for k, *both in zip(*(found.column(i).to_pylist() for i in range(3))):
        for i, x in enumerate(both):
            out[i, k] = np.frombuffer(zlib.decompress(x), dtype=np.float32)
    return out.reshape(2, -1)[:, :size]


def gather(texts: DataFrame, half: Column, words: Vocabulary) -> list[np.ndarray]:
    """The class predictors' logits, from each half of the ``texts(text)`` and from all."""
    import pyarrow as pa

    prepare(texts.sparkSession)
    shared, key, size = texts.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex, int(ROWS[-1]) * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Worker.of(key, shared.value)
        counted = np.zeros((2, size), dtype=np.float32)
        for batch in batches:
            for i, rows in enumerate(halves(batch)):
                for a, b in portions(rows, PORTION):
                    Bits(worker, rows[a:b]).count_into(counted[i])
        for i in range(2):
            for k, x in zip(*_packed(counted[i])):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i == 1]), pa.array([x])], names=["piece", "half", "counts"])

    one, two = _summed(texts.select("text", half.alias("half")).mapInArrow(run, "piece long, half boolean, counts binary"), size)
    return [class_logits(t.reshape(int(ROWS[-1]), CLASSES), words.paths) for t in (one, two, one + two)]


def phrases(texts: DataFrame, words: Vocabulary) -> DataFrame:
    """``(hash, n)``: in how many of the ``texts(text)`` each phrase stands."""
    import pyarrow as pa

    prepare(texts.sparkSession)
    shared, key = texts.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Worker.of(key, shared.value)
        for batch in batches:
            rows = byte_texts(batch.column(0))
            for a, b in portions(rows, PORTION):
                bits = Bits(worker, rows[a:b]).part()
                yield pa.RecordBatch.from_arrays([pa.array(bits.hashes[bits.new])], names=["hash"])

    return texts.select("text").mapInArrow(run, "hash long").groupBy("hash").agg(F.count("*").alias("n"))


def gather_spelling(counts: DataFrame, half: Column, words: Vocabulary) -> list[np.ndarray]:
    """The spelling predictors' logits, from each half of the words of ``counts(token)`` and from all.

    Every word counts once, as a word never seen will be one of its own.
    """
    import pyarrow as pa

    prepare(counts.sparkSession, 10_000)
    shared = counts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        counted = np.zeros((2, ORDERS, 2 * SLOTS), dtype=np.float32)
        for batch in batches:
            for i, tokens in enumerate(halves(batch)):
                mine = [t for t in tokens if t != END]
                for a, b in portions(mine, PORTION):
                    _, _, bit, slots = words.spell(mine[a:b])
                    for k in range(ORDERS):
                        np.add.at(counted[i, k], 2 * slots[k] + bit, np.float32(1))
        for i in range(2):
            for k, x in zip(*_packed(counted[i].reshape(-1))):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i == 1]), pa.array([x])], names=["piece", "half", "counts"])

    one, two = _summed(counts.select("token", half.alias("half")).mapInArrow(run, "piece long, half boolean, counts binary"), ORDERS * 2 * SLOTS)
    return [np.log((t[1::2] + PRIOR) / (t[::2] + PRIOR)).astype(np.float16).reshape(ORDERS, SLOTS) for t in (one, two, one + two)]


def train(docs: DataFrame, usable: Column) -> tuple[MixModel, DataFrame]:
    """The model of the ``usable`` rows of ``docs(doc_id, text)``, and their token counts.

    All of it comes from all of these texts: counts, tables and mixing weights.
    """
    rows = docs.where(usable)
    counts = settle(token_counts(rows))
    words = vocabulary(counts)
    # Weights must see the predictors as new texts will: by tables that lack the text or word.
    half = lambda col: F.pmod(F.xxhash64(col, F.lit("mix")), F.lit(2)) == 1
    *own, spelling = gather_spelling(counts, half("token"), words)
    weights = learn_spelling(counts, half("token"), words, own)
    *own, logits = gather(rows, half("text"), words)
    return MixModel(words, spelling, weights, logits, learn_start(rows, half("text"), words, own)), counts


class Speller:
    """log10 probability of words never seen within their group, computed once per word and worker."""

    def __init__(self, model: MixModel):
        self.model, self.logits = model, model.spelling.astype(np.float32)
        self.table = WordTable(self.cost, 100_000)

    def cost(self, words: list[bytes]) -> np.ndarray:
        out, known = np.zeros(len(words)), self.model.words
        for start in range(0, len(words), 2048):
            some = words[start : start + 2048]
            owner, depth, bit, slots = known.spell(some)
            x = spelling_inputs(self.logits, slots)
            p = 1 / (1 + np.exp(-np.clip(np.einsum("ki,ik->i", x, self.model.spelling_weights[depth]), -8, 8)))
            p = np.clip(p, 1e-4, 1 - 1e-4)
            out[start : start + 2048] = np.bincount(owner, np.log10(np.where(bit > 0, p, 1 - p)), len(some))
        return out + np.log10(known.unseen[[group_of(w) for w in words]]) if words else out


_SPELLERS: dict[str, Speller] = {}


def scores(docs: DataFrame, model: MixModel, counts: DataFrame, trained: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` for every row of ``docs``.

    ``trained`` says which rows the model was trained on (none by default): their own
    phrases don't count for them.  ``known`` are the ``phrases`` of the training texts;
    by default those of the rows that are ``trained``, which takes no pass of its own.
    A null or empty text is scored as its end alone.
    ``score`` is the model's log10 probability of the text's tokens, ``base_score``
    that of their frequencies, counts raised by one half; ``bits_per_byte`` is null
    for a text without bytes.  Without training texts every count is 0.  A repeated
    doc_id gives a row each time; other columns are ignored.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    prepare(spark)
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    total, distinct = model.words.total, model.words.distinct
    scale, log2 = total + 0.5 * (distinct + 1), float(np.log10(2))
    schema = (
        "row long, doc_id long, n_tokens long, n_known long, base double, score double, size long, asked long, trained boolean, "
        "phrase long, hash long, token binary, times long, once long"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.int64()] * 2 + [pa.bool_()] + [pa.int64()] * 2 + [pa.binary()] + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        worker = Worker.of(key, model.words)
        cost = np.log10((model.words.counts + 0.5) / scale) if len(model.words.counts) else np.zeros(1)
        made = TaskContext.get().partitionId() << 36

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

        for batch in batches:
            ids, own = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            texts = byte_texts(batch.column(1))
            for a, b in portions(texts, PORTION):
                bits = Bits(worker, texts[a:b]).part()
                by_stretch = stretch_costs(bits, model.words, model.logits, model.start)
                score = bits.choices() + np.bincount(bits.of_text, by_stretch, b - a)
                held = bits.known >= 0
                base = segment_sums(np.where(held, cost[np.maximum(bits.known, 0)], 0.0), bits.bounds)
                here = segment_sums(held.astype(np.float64), bits.bounds).astype(np.int64)
                number = np.arange(made, made + b - a)
                made += b - a
                yield rows(
                    b - a, row=number, doc_id=ids[a:b], n_tokens=np.diff(bits.bounds), n_known=here, base=base, score=score * log2,
                    size=[len(t) for t in texts[a:b]], asked=bits.asked,
                )
                of = bits.of_text[bits.new]
                yield rows(len(of), row=number[of], phrase=bits.before[bits.new], hash=bits.hashes[bits.new], score=by_stretch[bits.new] * log2, trained=own[a:b][of])
                lane, phrase, tokens, times, once = bits.unknown()
                yield rows(len(lane), row=number[lane], phrase=phrase, token=tokens, times=times, once=once)

    trained = F.lit(False) if trained is None else F.coalesce(trained, F.lit(False))
    found = settle(docs.select(F.col("doc_id").cast("long"), "text", trained.alias("trained")).mapInArrow(run, schema))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SPELLERS:
            _SPELLERS.clear()
            _SPELLERS[key] = Speller(shared.value)
        speller = _SPELLERS[key]
        for batch in batches:
            n = batch.column(4).to_numpy()
            times, once = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            share = np.log10(np.maximum(n - shared.value.words.discount, 1e-3))
            lost = np.flatnonzero(n == 0)
            at = speller.table.lookup(batch.column(5).take(pa.array(lost)).to_pylist())
            share[lost] = speller.table.rows[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.where(n > 0, times, 0)), pa.array(times * np.log10((n + 0.5) / scale)), pa.array(once * share)],
                names=["row", "phrase", "n_known", "base", "score"],
            )

    prepare(spark, 10_000)
    count = F.coalesce("n", F.lit(0))
    rare = (
        found.where(F.col("token").isNotNull()).select("row", "phrase", "token", "times", "once").join(counts, "token", "left")
        .select("row", "phrase", "times", "once", count.alias("n"), F.when(count == 0, F.col("token")).alias("token"))
        .mapInArrow(spelled, "row long, phrase long, n_known long, base double, score double")
    )
    if known is None:
        known = found.where(F.col("hash").isNotNull() & F.col("trained")).groupBy("hash").agg(F.count("*").alias("n"))
    known = settle(known)
    said = float(known.agg(F.sum("n")).first()[0] or 1)
    others = F.col("n") - F.col("trained").cast("long")
    heard = found.where(F.col("hash").isNotNull()).select("row", "phrase", "hash", "trained", "score").join(known, "hash").where(others > 0)
    heard = heard.select("row", "phrase", (F.log10(others / F.lit(said)) - F.col("score")).alias("gain"))
    parts = rare.withColumn("gain", F.lit(None).cast("double")).unionByName(
        heard.select("row", "phrase", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("score"), "gain")
    )
    sums = (
        parts.repartition("row").groupBy("row", "phrase")
        .agg(F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"), F.max("gain").alias("gain"))
        .groupBy("row")
        .agg(
            F.sum("n_known").alias("more_known"), F.sum("base").alias("more_base"),
            F.sum(F.when(F.col("gain").isNull(), F.col("score")).otherwise(F.col("gain"))).alias("more"),
            F.sort_array(F.collect_list(F.when(F.col("gain").isNotNull(), F.col("phrase")))).alias("heard"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = found.where(F.col("size").isNotNull()).select("row", "doc_id", "n_tokens", "n_known", "base", "score", "size", "asked").join(sums, "row", "left")
    whole = whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), (F.col("base") + zero("more_base")).alias("base"),
        (F.col("score") + zero("more")).alias("score"), "size", "asked", F.coalesce("heard", F.array().cast("array<long>")).alias("heard"),
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, size, asked = (batch.column(i).to_numpy() for i in (4, 5, 6))
            at = heard_tally(batch.column(7), asked)
            score = score + log2 * (choice_cost(at[0], at[1], *AFTER_NO) + choice_cost(at[2], at[3], *AFTER_YES))
            density = pa.array(-score / log2 / np.maximum(size, 1), mask=size == 0)
            told = pa.array(np.full(len(score), total, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], told, batch.column(3), pa.array(score), density],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
            )

    return whole.mapInArrow(
        finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    )


def heard_tally(heard, asked: np.ndarray) -> list[np.ndarray]:
    """By text, from the sorted places of the yeses among its ``asked`` choices: yes and no after a no, yes and no after a yes."""
    at = np.asarray(heard.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    yes = np.diff(np.asarray(heard.offsets))
    text = np.repeat(np.arange(len(asked)), yes)
    joined = np.zeros(len(at), dtype=bool)
    joined[1:] = (at[1:] == at[:-1] + 1) & (text[1:] == text[:-1])
    after_yes = np.bincount(text[joined], minlength=len(asked))
    closes = np.bincount(text[at == asked[text] - 1], minlength=len(asked)) if len(at) else np.zeros(len(asked), dtype=np.int64)
    no_after_yes = yes - after_yes - closes
    return [yes - after_yes, asked - yes - no_after_yes, after_yes, no_after_yes]
