"""Toxicity by a subsequence string kernel and a support vector machine.

A text is cut into sentences and these into units: words, and runs of single
characters that spell a word ("i d i o t").  The kernel of two units counts the
subsequences of three characters that they share, each weighed by ``DECAY`` to
the power of the stretch that it spans, so gaps and inserted characters lower it
gently; stretches over ``REACH`` characters weigh too little to count.  It is
normalised by both units' own kernels.

The machine is trained in the space of a Nyström map with ``LANDMARKS``
landmark units from the training sentences.  Its decision function is a weighted
sum of kernels with the landmarks, hence linear in the subsequence counts, and is
evaluated by a table over the triples of an alphabet of 64: exactly the same
number, at a cost per unit that doesn't depend on the landmarks.

A sentence's label is its document's, which says that a toxic document has some
toxic sentence, not which; so the units are trained as witnesses: units over-
represented in toxic documents against those of clean ones, chosen anew by the
machine once.  A document's score is a logistic function of its largest decision
values over all its sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, byte_texts, offsets, portions, prepare

DECAY = 0.7
REACH = 7
LANDMARKS = 300
#: Training documents of each class, about; a hash of the id picks them.
TRAIN_DOCS = 3000
#: Longer texts don't train, so that the sample's bytes are bounded as well.
TRAIN_BYTES = 1 << 16
#: Clean units that train.
TRAIN_CLEAN_UNITS = 12_000
#: What a violated margin costs, over all units of a class.
SLACK = 20_000
#: A document is toxic from this score on.
THRESHOLD = 0.7

_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789", 2)}
_JOINTS = re.compile(r"[\W_]+")
#: Words of one character, three or more in a row.
_RUN = bytes([1, 1, 1])
_RUNS = re.compile(rb"\x01{3,}")


def _code(c: str) -> int:
    return _LETTERS.get(c) or 38 + ord(c) % 26


def units(text: bytes) -> list[str]:
    """The distinct units of all sentences of a text, in lower case, in order.

    White space and sentence ends part units; so sentences needn't be cut out first.
    """
    words = text.decode("utf-8", "replace").lower().split()
    found = list(dict.fromkeys(words))
    sizes = bytes([min(len(w), 2) for w in words])
    if _RUN in sizes:
        runs = (" ".join(words[m.start() : m.end()]) for m in _RUNS.finditer(sizes))
        found = list(dict.fromkeys([*found, *runs]))
    return found


_CODES = np.array([_code(chr(c)) for c in range(0x10000)], dtype=np.int64)
_CODES[0], _CODES[1] = 0, 1


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Alphabet codes of the units, with edge marks 0 and 1, one after the other; where each begins."""
    text = "".join(["\0" + w.replace("\0", " ").replace("\1", " ") + "\1" for w in words])
    flat = _CODES[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32) & 0xFFFF]
    return flat, offsets([len(w) + 2 for w in words])


def _triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, triple, weight) of all subsequences of three characters within reach, equal ones summed."""
    flat, begins = _coded(words)
    owner = np.repeat(np.arange(len(words)), np.diff(begins))
    ends = np.repeat(begins[1:], np.diff(begins))
    at = np.arange(len(flat))
    who, what, weight = [], [], []
    for j in range(1, REACH - 1):
        for k in range(j + 1, REACH):
            i = at[at + k < ends]
            who.append(owner[i])
            what.append((flat[i] << 12) | (flat[i + j] << 6) | flat[i + k])
            weight.append(np.full(len(i), DECAY ** (k + 1)))
    both = (np.concatenate(who) << 18) | np.concatenate(what)
    order = np.argsort(both, kind="stable")
    both, weights = both[order], np.concatenate(weight)[order]
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, dtype=np.int64)
    summed = np.add.reduceat(weights, first) if len(first) else np.zeros(0)
    return both[first] >> 18, both[first] & 0x3FFFF, summed


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_triples``, with unit norm for every unit that has a triple."""
    who, what, weight = _triples(words)
    norm = np.sqrt(np.bincount(who, weight**2, len(words)))
    return who, what, weight / norm[who]


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of all units of ``a`` with all of ``b``."""
    who, what, weight = features(b)
    out = np.zeros((len(a), len(b)))
    own_who, own_what, own_weight = features(a)
    for j in range(len(b)):
        dense = np.zeros(1 << 18)
        dense[what[who == j]] = weight[who == j]
        out[:, j] = np.bincount(own_who, dense[own_what] * own_weight, len(a))
    return out


@dataclass
class ToxicModel:
    """The decision table over triples, the bias, and the document's logistic function."""

    table: np.ndarray = field(default_factory=lambda: np.zeros(1 << 18, dtype=np.float32))
    bias: float = -1.0
    logistic: np.ndarray = field(default_factory=lambda: np.array([0.0] * 4 + [-4.0]))

    def decisions(self, words: list[str]) -> np.ndarray:
        """The machine's decision value of each unit, what is no letter or digit aside."""
        out = np.empty(len(words), dtype=np.float32)
        for start in range(0, len(words), 4096):
            own = [_JOINTS.sub("", w) for w in words[start : start + 4096]]
            who, what, weight = features(own)
            out[start : start + len(own)] = np.bincount(who, self.table[what] * weight, len(own)) + self.bias
        return out

    def document(self, values: np.ndarray) -> np.ndarray:
        """What the logistic function sees of a document's decision values."""
        top = np.full(3, -1.0)
        best = np.sort(values)[::-1][:3]
        top[: len(best)] = np.clip(best, -1, 1)
        share = (values > 0.5).sum() / max(1, len(values))
        return np.array([*top, min(0.05, share) * 20, 1.0])

    def score(self, seen: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(seen @ self.logistic, -40, 40)))


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps; the last coordinate is the bias."""
    z = np.hstack((z, np.ones((len(z), 1))))
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    loss = lambda w: 0.5 * w @ ridge @ w + 0.5 * cost * (weight * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()
    now = loss(w)
    for _ in range(rounds):
        active = y * (z @ w) < 1
        za, ca = z[active], cost * weight[active]
        step = np.linalg.solve(ridge + za.T @ (za * ca[:, None]), za.T @ (ca * y[active])) - w
        scale = 1.0
        while scale > 1e-4 and (then := loss(w + scale * step)) > now:
            scale /= 2
        if scale <= 1e-4 or now - then < 1e-9 * max(1.0, now):
            break
        w, now = w + scale * step, then
    return w


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps, classes weighed alike."""
    w = np.zeros(x.shape[1])
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            x.T @ (x * (c * p * (1 - p))[:, None]) + 0.05 * np.eye(len(w)), x.T @ (c * (p - y)) + 0.05 * w
        )
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def distinct_texts(texts: list[bytes]) -> list[int]:
    """Places of texts, one of each group of near copies: those that share a min-hash of three-word shingles.

    Copies of one toxic text would make all of its words look toxic.
    """
    from .simhash import shingle_hashes

    odd = np.random.default_rng(3).integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, t in enumerate(texts):
        hashes = shingle_hashes(t, 3)
        if not len(hashes):
            continue
        keys = {(k, int((hashes * m).min())) for k, m in enumerate(odd)}
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return kept


def disguised(word: str) -> list[str]:
    """The word with one character put in at three places."""
    n = len(word)
    return [word[:i] + c + word[i:] for i, c in ((2, "x"), (n // 2, word[n // 2]), (n - 1, "q"))]


def fit(texts: list[bytes], toxic: list[int], landmarks: int = LANDMARKS) -> ToxicModel:
    """Train on labelled texts.  One class alone gives a model that finds nothing toxic."""
    kept = distinct_texts(texts)
    texts, toxic = [texts[i] for i in kept], [toxic[i] for i in kept]
    y = np.array(toxic)
    model = ToxicModel()
    if not len(y) or y.min() == y.max():
        return model
    clean = lambda t: list(dict.fromkeys(u for w in units(t) if (u := _JOINTS.sub("", w))))
    bags = [clean(t) for t in texts]
    n_bad, n_good = int((y == 1).sum()), int((y == 0).sum())
    bad, good = Counter(), Counter()
    for bag, label in zip(bags, toxic):
        (bad if label else good).update(bag)
    lift = {w: np.log(((n + 0.1) / n_bad) / ((good[w] + 0.5) / n_good)) for w, n in bad.items()}
    share = n_bad / len(y)
    surplus = lambda w: (bad[w] - (bad[w] + good[w]) * share) / np.sqrt((bad[w] + good[w]) * share * (1 - share))
    witnesses = [w for w, n in bad.items() if n >= 4 and lift[w] > 1.5 and surplus(w) > 5]
    if not witnesses:
        witnesses = sorted(bad, key=lambda w: (-lift[w], w))[: max(1, n_bad // 4)]
    for again in (False, True):
        pos = sorted(witnesses, key=lambda w: (-bad[w], w))[: TRAIN_CLEAN_UNITS // 3]
        taken = set(pos)
        neg = sorted((w for w in good if w not in taken), key=lambda w: (-good[w], w))
        neg = neg[: TRAIN_CLEAN_UNITS // 2] + neg[TRAIN_CLEAN_UNITS // 2 :: max(1, len(neg) // (TRAIN_CLEAN_UNITS // 2) )]
        neg = neg[:TRAIN_CLEAN_UNITS]
        if not neg:
            return model
        # Virtual examples: witnesses with a character put in, as insults are disguised.
        pos += [v for w in pos[: landmarks * 2 // 3] if len(w) > 3 for v in disguised(w) if v not in good]
        marks = pos[: landmarks * 2 // 3]
        marks = marks + neg[:: max(1, len(neg) // (landmarks - len(marks)))][: landmarks - len(marks)]
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        labels = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        weight = np.r_[
            np.array([bad[w] or 10 for w in pos]) / sum(bad[w] or 10 for w in pos),
            np.sqrt([good[w] for w in neg]) / sum(good[w] ** 0.5 for w in neg),
        ] * SLACK
        w = _svm(kernel(pos + neg, marks) @ root, labels, weight)
        who, what, weigh = features(marks)
        table = np.zeros(1 << 18)
        np.add.at(table, what, weigh * (root @ w[:-1])[who])
        model.table, model.bias = table.astype(np.float32), float(w[-1])
        if again:
            break
        # The machine's own choice: units of toxic documents that it finds toxic and clean documents seldom have.
        names = list(bad)
        value = model.decisions(names)
        more = [u for u, v in zip(names, value) if v > 0 and bad[u] >= 2 and lift[u] > 1.0]
        witnesses = list(dict.fromkeys(witnesses + more))
    memo = dict(zip(lift := list({w for b in bags for w in b}), model.decisions(lift)))
    seen = np.array([model.document(np.array([memo[w] for w in b])) for b in bags])
    model.logistic = _logistic(seen, (y == 1).astype(float))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = TRAIN_DOCS):
    """Texts and labels of about ``per_class`` usable labelled documents of each class."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], []
    rates = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(1e6 * per_class / n) + 1)])
    # At most about 2 * per_class ids and labels, whatever the size of the tables: small enough to send to all.
    picked = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) < rates[F.col("toxic")])
    own = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES))
    rows = own.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id").toArrow()
    return rows.column("text").to_pylist(), [int(x) for x in rows.column("toxic").to_pylist()]


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = TRAIN_DOCS) -> ToxicModel:
    return fit(*training_rows(docs, labels, usable, per_class))


class Judge:
    """A worker's scores; keeps the units that it has judged."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.table = WordTable(model.decisions)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        seen = []
        for start, end in portions(texts):
            own = [units(t) for t in texts[start:end]]
            rows = self.table.lookup([w for u in own for w in u])
            values = self.table.rows[rows] if len(rows) else np.zeros(0)
            bounds = offsets([len(u) for u in own])
            seen += [self.model.document(values[a:b]) for a, b in zip(bounds, bounds[1:])]
        return self.model.score(np.array(seen).reshape(-1, 5))


def scores(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs(doc_id, text)``.

    A null text is scored as an empty one: it has no unit and scores low.
    ``predicted`` is 1 from a score of ``THRESHOLD`` on.  Other columns are
    ignored; a repeated doc_id gives a row each time.
    """
    import pyarrow as pa

    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            found = judge(byte_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of ``docs`` that score below ``THRESHOLD``, all columns kept."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(judge(byte_texts(batch.column(at))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
