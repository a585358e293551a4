"""Benchmark decontamination by CGK embedding, bit sampling and exact verification.

A text is a sequence of words (A-Z in lower case, ASCII punctuation apart); a
character of a script written without spaces (Han, Kana, Thai, Lao, Burmese,
Khmer) is a word.  A document holds an item if some stretch of it is within
``EDITS`` = 20 % of the item's words in edit distance (words inserted, deleted or
replaced).

* Windows are sized to the items: items fall in size classes, and a class's
  windows have the words of its shortest item.
* A window is looked at only if it has enough word pairs of any item: an edit
  breaks two pairs at most, so a match keeps at least n - 1 - 2k of them.  This
  exact count leaves few windows of clean text.
* Those windows and the items' heads are embedded by the random walk of
  Chakraborty, Goldenberg and Koucky (2016): step j writes the current word and
  goes on to the next one if a random bit of (j, word) says so.  Words that two
  sequences share bring their walks back in step, so edit distance becomes
  Hamming distance.  ``WALKS`` walks times ``TABLES`` samples of ``SAMPLED``
  places give as many chances of an equal key; the target recall of 0.95 at the
  greatest edit distance is measured in the tests.
* Pairs with an equal key are verified by the exact edit distance of the whole
  item to the best stretch around the window.
* 20 % of fewer than ``MIN_WORDS`` words is no edit, so shorter items are looked
  up exactly.  Equal items are one entry of the index.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase, punctuation

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, offsets, portions, prepare

EDITS = 0.2
WALKS, TABLES, SAMPLED = 8, 4, 4
#: Shorter items are found without edits only, and are no reason to drop a document unless it is nothing else.
MIN_WORDS = 5
#: Ratio of a size class's longest to its shortest window.
CLASS = 1.15
#: Bytes of items in one pass over the documents; more are taken in several passes.
ITEM_BYTES = 16 << 20

_FOLD = bytes.maketrans((ascii_uppercase + punctuation).encode(), (ascii_lowercase + " " * len(punctuation)).encode())
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: UTF-8 of characters of scripts that are written without spaces. Fixed values.
_SOLID = re.compile(
    rb"\xe0[\xb8-\xbb].|\xe1[\x80-\x82\x9e\x9f].|\xe3[\x80-\x83\x90-\xbf].|[\xe4-\xe9]..|\xf0[\xa0-\xb2]..", re.DOTALL
)


def symbols(text: bytes) -> np.ndarray:
    """The words of a text as 32-bit numbers other than 0."""
    text = text.translate(_FOLD)
    if not text.isascii():
        text = _SOLID.sub(rb" \g<0> ", text)
    words = text.split()
    found = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    return np.maximum(found, 1)


def pair_codes(s: np.ndarray) -> np.ndarray:
    """A number for each pair of neighbouring words."""
    if len(s) < 2:
        return np.zeros(0, dtype=np.uint64)
    a, b = s[:-1].astype(np.uint64), s[1:].astype(np.uint64)
    return (a * _ODD) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))


def run_codes(s: np.ndarray, n: int) -> np.ndarray:
    """A number for each ``n`` neighbouring words."""
    out = np.zeros(max(len(s) - n + 1, 0), dtype=np.uint64)
    for j in range(n):
        out = (out + s[j : j + len(out)].astype(np.uint64) + np.uint64(1)) * _ODD
        out ^= out >> np.uint64(29)
    return out


def best_distance(pattern: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance of ``pattern`` to any stretch of ``text`` (Myers' bit vectors)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, s in enumerate(pattern.tolist()):
        masks[s] = masks.get(s, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for s in text.tolist():
        eq = masks.get(s, 0)
        cross = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(cross | up) & full), up & cross
        if plus & high:
            score += 1
        if minus & high:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (~((eq | down) | plus) & full), plus & (eq | down)
        best = min(best, score)
    return best


class Finder:
    """Items of a benchmark, indexed for windows of their sizes."""

    def __init__(self, items: list[tuple[int, bytes]], seed: int = 11):
        same: dict[bytes, list[int]] = {}
        for i, t in items:
            if len(s := symbols(t)):
                same.setdefault(s.tobytes(), []).append(i)
        self.all_ids = list(same.values())
        self.ids = [i[0] for i in self.all_ids]
        self.items = [np.frombuffer(s, dtype=np.uint32) for s in same]
        self.edits = [int(EDITS * len(s)) for s in self.items]
        rng = np.random.default_rng(seed)
        long = [k for k, s in enumerate(self.items) if len(s) >= MIN_WORDS]
        self.pairs = np.unique(np.concatenate([pair_codes(self.items[k]) for k in long] or [np.zeros(0, np.uint64)]))
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.pairs >> np.uint64(42)).astype(np.int64)] = True
        classes: dict[int, list[int]] = {}
        size, sizes = float(MIN_WORDS), [MIN_WORDS]
        most = max((len(self.items[k]) for k in long), default=0)
        while size <= most:
            size = max(size + 1, size * CLASS)
            sizes.append(int(size))
        for k in long:
            classes.setdefault(max(n for n in sizes if n <= len(self.items[k])), []).append(k)
        # Of items below MIN_WORDS, by their number of words: sorted codes and the items.
        self.short = []
        for n in range(1, MIN_WORDS):
            members = np.array([k for k, s in enumerate(self.items) if len(s) == n], dtype=np.int64)
            codes = np.array([run_codes(self.items[k], n)[0] for k in members], dtype=np.uint64)
            if len(members):
                order = np.argsort(codes, kind="stable")
                self.short.append((n, codes[order], members[order]))
        # A class: window size, pairs that a match keeps, step multipliers, sampled places, sorted keys and their items.
        self.classes = []
        for n, members in sorted(classes.items()):
            least = max(1, n - 1 - 2 * max(self.edits[k] for k in members))
            steps = rng.integers(0, 1 << 32, (WALKS, 2 * n), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
            places = rng.integers(0, 2 * n, (WALKS, TABLES, SAMPLED))
            heads = np.array([self.items[k][:n] for k in members])
            keys = self._keys(heads.ravel(), np.arange(len(members)) * n, n, steps, places)
            owner = np.repeat(np.array(members), keys.shape[1])
            order = np.argsort(keys.ravel(), kind="stable")
            self.classes.append((n, least, steps, places, keys.ravel()[order], owner[order]))

    @staticmethod
    def _keys(s: np.ndarray, starts: np.ndarray, n: int, steps: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Sampled keys of the embedded windows, a row per window and WALKS * TABLES columns."""
        keys = np.zeros((len(starts), WALKS, TABLES), dtype=np.uint64)
        padded = np.append(s, np.uint32(0))
        for w in range(WALKS):
            at = np.zeros(len(starts), dtype=np.int64)
            wanted: dict[int, list[tuple[int, int]]] = {}
            for t in range(TABLES):
                for b, place in enumerate(places[w, t].tolist()):
                    wanted.setdefault(place, []).append((t, b))
            for j in range(max(wanted) + 1):
                now = np.where(at < n, padded[np.minimum(starts + at, len(s))], np.uint32(0))
                for t, b in wanted.get(j, ()):
                    keys[:, w, t] += now.astype(np.uint64) * np.array(2 * (b + SAMPLED * (t + TABLES * w)) + 1, dtype=np.uint64) * _ODD
                at += (now * steps[w, j]) >> np.uint32(31)
        tables = np.arange(WALKS * TABLES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return keys.reshape(len(starts), -1) + tables

    def find(self, texts: list[bytes]) -> list[dict[int, tuple[int, int]]]:
        """For each text, the items that it holds: item number to (least edits, word where the window begins)."""
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        if not self.items:
            return out
        for begin, end in portions(texts):
            parts = [symbols(t) for t in texts[begin:end]]
            # A 0 between texts pairs with nothing, and no window with it can keep enough pairs unless it is a match.
            flat = np.concatenate([np.append(p, np.uint32(0)) for p in parts])
            bounds = offsets([len(p) + 1 for p in parts])
            self._exact(flat, bounds, out, begin)
            if not self.classes:
                continue
            codes = pair_codes(flat)
            hit = self.seen[(codes >> np.uint64(42)).astype(np.int64)]
            at = np.flatnonzero(hit)
            place = np.minimum(np.searchsorted(self.pairs, codes[at]), len(self.pairs) - 1)
            hit[at[self.pairs[place] != codes[at]]] = False
            if not hit.any():
                continue
            run = offsets(hit)
            for n, least, steps, places, keys, owner in self.classes:
                last = np.minimum(np.arange(len(flat)) + n - 1, len(hit))
                starts = np.flatnonzero(run[last] - run[np.minimum(np.arange(len(flat)), len(hit))] >= least)
                for i in range(0, len(starts), 1 << 14):
                    some = starts[i : i + (1 << 14)]
                    own = self._keys(flat, some, n, steps, places)
                    low = np.searchsorted(keys, own.ravel(), side="left")
                    high = np.searchsorted(keys, own.ravel(), side="right")
                    found = np.flatnonzero(high > low)
                    pairs = {
                        (int(some[f // own.shape[1]]), int(k)) for f in found for k in owner[low[f] : high[f]]
                    }
                    self._verify(sorted(pairs), flat, bounds, out, begin)
        return out

    def _exact(self, flat, bounds, out, begin) -> None:
        """Adds the short items, at the first word where each begins."""
        for n, keys, members in self.short:
            codes = run_codes(flat, n)
            place = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
            for at in np.flatnonzero(keys[place] == codes).tolist():
                # Different items share a code hardly ever, but may.
                for i in range(int(place[at]), len(keys)):
                    if keys[i] != codes[at]:
                        break
                    k = int(members[i])
                    d = int(np.searchsorted(bounds, at, side="right")) - 1
                    if k not in out[begin + d] and np.array_equal(flat[at : at + n], self.items[k]):
                        out[begin + d][k] = (0, at - int(bounds[d]))

    def tainted(self, texts: list[bytes]) -> list[bool]:
        """For each text, whether it holds an item of ``MIN_WORDS`` words or more, or is a shorter one and nothing else."""
        return [
            any(len(self.items[k]) >= MIN_WORDS or np.array_equal(symbols(t), self.items[k]) for k in held)
            for t, held in zip(texts, self.find(texts))
        ]

    def _verify(self, pairs, flat, bounds, out, begin) -> None:
        for start, k in pairs:
            d = int(np.searchsorted(bounds, start, side="right")) - 1
            known = out[begin + d].get(k)
            if known and known[0] == 0:
                continue
            item, most = self.items[k], self.edits[k]
            low, high = max(int(bounds[d]), start - most), min(int(bounds[d + 1]) - 1, start + len(item) + 2 * most)
            edits = best_distance(item, flat[low:high])
            if edits <= most and (known is None or edits < known[0]):
                out[begin + d][k] = (edits, start - int(bounds[d]))


def finders(items: DataFrame) -> Iterator[Finder]:
    """Finders of at most about ``ITEM_BYTES`` of ``items(item_id, text)`` each; rows with a null are left out."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")
    )
    size = rows.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    passes = max(1, -(-int(size) // ITEM_BYTES))
    for i in range(passes):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i) if passes > 1 else rows
        yield Finder(sorted((r["item_id"], bytes(r["text"])) for r in own.collect()))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, edits, item_words, similarity, word_at)`` for every document and item that it holds.

    ``edits`` is the least word edit distance found, ``similarity`` 1 less its
    share of the item's words, ``word_at`` the word of the document where the
    window begins that found it.  A null or empty text holds nothing; items of
    fewer than ``MIN_WORDS`` words are held where they stand without an edit;
    items without a word or of null text are held by nothing; equal items are
    found each.  A repeated doc_id gives rows each time; other columns
    are ignored; empty tables give no row.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, edits int, item_words int, similarity double, word_at long"
    out = None
    for finder in finders(items):
        shared = spark.sparkContext.broadcast(finder)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = shared.value
            for batch in batches:
                held = finder.find(byte_texts(batch.column(1)))
                docs = batch.column(0).to_pylist()
                found = [
                    (docs[i], item, e, len(finder.items[k]), 1 - e / len(finder.items[k]), p)
                    for i, h in enumerate(held) for k, (e, p) in sorted(h.items()) for item in finder.all_ids[k]
                ]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
                columns = list(zip(*found)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    names=["doc_id", "item_id", "edits", "item_words", "similarity", "word_at"],
                )

        own = rows.mapInArrow(run, schema)
        out = own if out is None else out.unionByName(own)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``MIN_WORDS`` words or more and aren't a shorter one as a whole.

    All columns are kept, and rows of null text, which hold nothing.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index("text")
    for finder in finders(items):
        shared = spark.sparkContext.broadcast(finder)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tainted = shared.value.tainted(byte_texts(batch.column(at)))
                yield batch.filter(pa.array([not x for x in tainted], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
