"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes, of variable order up to ``ORDER``:
a context node holds the counts of the bytes that followed it in the training
texts.  A byte is coded in the longest context known; where it is new there, an
escape (method C: distinct followers against all) is paid and the next shorter
context codes it, down to a uniform order -1.  The counts are frozen after
training, so the code length of a byte is a fixed number for each (context,
byte), and a text's length in a language is an exact sum.  The language of the
shortest code wins.

A text is coded as its white-space separated words, each followed by a space;
contexts reach back to the space before the word.  So a word's code length is
the same wherever it stands, and is computed once per distinct word and worker.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    WordTable, byte_texts, offsets, packed_words, portions, prepare, segment_sums,
)

#: Bytes of context at most.
ORDER = 4
#: Training texts per language, about; a hash of the id picks them.
TRAIN_DOCS = 600
#: Longer texts don't train, so that the sample's bytes are bounded as well.
TRAIN_BYTES = 1 << 16

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _grams(flat: np.ndarray, begins: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose context of ``order`` bytes lies in the word, and (context, byte) there as numbers."""
    first = np.repeat(begins[:-1], np.diff(begins))
    at = np.flatnonzero(np.arange(len(flat)) - max(order, 1) >= first)
    code = np.zeros(len(at), dtype=np.uint64)
    for d in range(order, -1, -1):
        code = (code << np.uint64(8)) | flat[at - d].astype(np.uint64)
    return at, code


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class PpmModel:
    """Frozen context trees of several languages, as code lengths in bits.

    ``grams[k]`` lists the (context of k bytes, byte) pairs that some language
    has seen, ``bits[k]`` their code length in every language; ``contexts[k]``
    and ``escapes[k]`` the known contexts and what an escape costs there (0 in
    a language that doesn't know the context).
    """

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.langs = sorted(texts)
        self.order = order
        counts = [Counter(w for t in texts[lang] for w in t.split()) for lang in self.langs]
        self.grams, self.bits, self.contexts, self.escapes = [], [], [], []
        seen = []
        for words in counts:
            flat, begins = packed_words(list(words), b" ", b" ")
            weight = np.repeat(np.fromiter(words.values(), dtype=np.float64, count=len(words)), np.diff(begins))
            own = []
            for k in range(order + 1):
                at, code = _grams(flat, begins, k)
                keys, inverse = np.unique(code, return_inverse=True)
                own.append((keys, np.bincount(inverse, weight[at], len(keys))))
            seen.append(own)
        for k in range(order + 1):
            keys = np.unique(np.concatenate([own[k][0] for own in seen] or [np.zeros(0, np.uint64)]))
            nodes = np.unique(keys >> np.uint64(8))
            below = self._below(keys, k)
            bits = np.empty((len(keys), len(self.langs)))
            escapes = np.zeros((len(nodes), len(self.langs)))
            place = np.searchsorted(nodes, keys >> np.uint64(8))
            for i, own in enumerate(seen):
                n = np.zeros(len(keys))
                n[np.searchsorted(keys, own[k][0])] = own[k][1]
                total, kinds = np.bincount(place, n, len(nodes)), np.bincount(place, n > 0, len(nodes))
                known = total > 0
                escapes[known, i] = -np.log2(kinds[known] / (total + kinds)[known])
                own_total = (total + kinds)[place]
                bits[:, i] = np.where(n > 0, -np.log2(np.maximum(n, 1e-9) / np.maximum(own_total, 1)), escapes[place, i] + below[:, i])
            self.grams.append(keys)
            self.bits.append(bits)
            self.contexts.append(nodes)
            self.escapes.append(escapes)

    def _below(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of the last byte of ``keys`` in the context one byte shorter."""
        if k == 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        at, _ = _find(self.grams[k - 1], keys & np.uint64((1 << (8 * k)) - 1))
        return self.bits[k - 1][at]

    def word_bits(self, words: list[bytes]) -> np.ndarray:
        """Exact code lengths of words with their closing space, a row per word and a column per language."""
        out = np.zeros((len(words), len(self.langs)))
        for start, end in portions(words, 1 << 18):
            flat, begins = packed_words(words[start:end], b" ", b" ")
            cost = np.zeros((len(flat), len(self.langs)))
            for k in range(self.order + 1):
                at, code = _grams(flat, begins, k)
                if not k:
                    cost[at] = 8.0
                place, found = _find(self.grams[k], code)
                cost[at[found]] = self.bits[k][place[found]]
                rest, lost = at[~found], code[~found] >> np.uint64(8)
                node, known = _find(self.contexts[k], lost)
                cost[rest[known]] += self.escapes[k][node[known]]
            out[start:end] = segment_sums(cost, begins)
        return out


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (
        not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))
    )


def training_texts(docs: DataFrame, usable: Column, per_lang: int = TRAIN_DOCS) -> dict[str, list[bytes]]:
    """A sample of about ``per_lang`` texts of each language among the ``usable`` rows."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(1e6 * per_lang / n) + 1)])
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("ppm")), F.lit(1_000_000)) < rates[F.col("lang")])
    found = picked.where(F.octet_length("text") <= TRAIN_BYTES).select("lang", F.col("text").cast("binary").alias("text"))
    texts: dict[str, list[bytes]] = {}
    for r in found.toArrow().to_pylist():
        texts.setdefault(r["lang"], []).append(r["text"])
    return texts


def train(docs: DataFrame, usable: Column, per_lang: int = TRAIN_DOCS) -> PpmModel:
    """Learn from a bounded sample of the ``usable`` labelled rows of ``docs(doc_id, text, lang)``."""
    return PpmModel(training_texts(docs, usable, per_lang))


class Judge:
    """A worker's predictions; keeps the words that it has coded."""

    def __init__(self, model: PpmModel):
        self.model = model
        self.words = WordTable(model.word_bits)

    def __call__(self, texts: list[bytes]) -> tuple[list[str], list[float], list[float | None]]:
        langs, scores, density = [], [], []
        known = self.model.langs
        for start, end in portions(texts):
            split = [t.split() if known and has_letter(t) else [] for t in texts[start:end]]
            rows = self.words.lookup([w for s in split for w in s])
            bits = segment_sums(self.words.rows[rows], offsets([len(s) for s in split]))
            if not known:
                bits = np.zeros((len(split), 1))
            sizes = np.array([len(t) for t in texts[start:end]])
            best = bits.argmin(axis=1)
            soft = np.exp2((bits.min(axis=1)[:, None] - bits) / np.maximum(1, sizes / 64)[:, None])
            share = 1 / soft.sum(axis=1)
            for i, s in enumerate(split):
                langs.append(known[best[i]] if s else "und")
                scores.append(float(share[i]) if s else 0.0)
                density.append(float(bits[i, best[i]] / sizes[i]) if s else None)
        return langs, scores, density


def predict(docs: DataFrame, model: PpmModel) -> DataFrame:
    """``(doc_id, lang_pred, score, bits_per_byte)`` of every row of ``docs(doc_id, text)``.

    ``score`` is the winner's posterior under equal priors at a temperature that
    grows with the text, so that a long text doesn't saturate it: code lengths
    are divided by max(1, bytes / 64) before they are compared.  A null text, or
    one without a letter, has lang_pred ``und`` and score 0, as has every text
    if no language was learned.  Ties go to the first language in byte order.
    Other columns of ``docs`` are ignored; a repeated doc_id gives a row each time.
    """
    import pyarrow as pa

    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            langs, scores, density = judge(byte_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(density, pa.float64())],
                names=["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, bits_per_byte double"
    )


def accept(docs: DataFrame, model: PpmModel, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in a learned language with at least this score, all columns kept."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            langs, scores, _ = judge(byte_texts(batch.column(at)))
            yield batch.filter(pa.array([x != "und" and y >= least_score for x, y in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
