"""Packing documents into training sequences along a space-filling curve.

Every document is tokenised once; its hashed bag-of-tokens vector is projected to
``DIMS`` dimensions, and the place of that point on a Hilbert curve is its key.
Rows are parted into ranges of the key of about equal bytes and sorted within, so that
neighbours are alike, and a range's documents are laid one after the other and cut
every 2048 tokens.
What is left at a partition's end is cut at powers of two (1024 + 128 + ...),
which need no padding.  So no sequence has any, and no row goes to one task: each
range is packed on its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Numbers, offsets, portions, prepare, settle

SEQUENCE = 2048
#: Dimensions of the curve and bits of each.
DIMS, BITS = 6, 10
#: Bytes of tokens that a packing task gets, about.
PARTITION_BYTES = 16 << 20
#: Stretches of the curve whose bytes are summed: 2 to this power.
CELL_BITS = 16


#: Python's split() also parts at these four; the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(r"[^\S\x1c-\x1f]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A run of up to 64 letters, in composed form and of a case that depends on no neighbour, and a run of marks (no apostrophe).
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]{1,64})([!-&(-/:-@\\[-`{-~]*)")


class Merges:
    """Byte-pair merges of many words at once, each step for all words of about one length.

    The words are runs of letters, which the tokenizer's file takes as one piece of
    bytes with a mark at the word's end.  A step merges each word's leftmost pair of
    the least rank, which is the order of the merges by definition.
    """

    NONE = np.int32(1 << 30)

    def __init__(self, model: dict):
        vocab = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], dtype=np.uint32)
        self.last = np.array([vocab[letter[b] + "</w>"] for b in range(256)], dtype=np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.uint32)
        # A second table holds the pairs whose place in the first one is taken.
        self.first, rest = self._place(np.arange(len(self.keys)), 0x9E3779B1)
        self.second, rest = self._place(rest, 0x85EBCA6B)
        self.rest = {int(self.keys[i]): int(i) for i in rest}

    def _place(self, which: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        at = (self.keys[which] * np.uint32(by)) >> np.uint32(12)
        table = np.full(1 << 20, -1, dtype=np.int32)
        table[at[::-1]] = which[::-1]
        return table, which[table[at] != which]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); NONE where there is no merge."""
        key = a << np.uint32(16) | b
        out = np.full(key.shape, self.NONE, dtype=np.int32)
        for table, by in ((self.first, 0x9E3779B1), (self.second, 0x85EBCA6B)):
            found = table[(key * np.uint32(by)) >> np.uint32(12)]
            np.copyto(out, found, where=(found >= 0) & (self.keys[found] == key))
        if self.rest:
            for place in np.flatnonzero(np.isin(key, list(self.rest))).tolist():
                out.flat[place] = self.rest[int(key.flat[place])]
        return out

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 16-bit numbers."""
        out: list = [b""] * len(words)
        size = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(size, kind="stable")
        for start in range(0, len(words), 2048):
            which = order[start : start + 2048]
            self._merge([words[i] for i in which.tolist()], size[which], which, out)
        return out

    def _merge(self, words: list[bytes], size: np.ndarray, which: np.ndarray, out: list) -> None:
        wide = int(size[-1])
        flat = np.frombuffer(b"".join([w.ljust(wide) for w in words]), dtype=np.uint8).reshape(len(words), wide)
        ids = self.inner[flat]
        rows = np.arange(len(words))
        ids[rows, size - 1] = self.last[flat[rows, size - 1]]
        place = np.arange(wide)
        ranks = np.full((len(words), wide), self.NONE, dtype=np.int32)
        if wide > 1:
            ranks[:, :-1] = np.where(place[1:] < size[:, None], self.rank(ids[:, :-1], ids[:, 1:]), self.NONE)
        while len(ids):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(ids))
            best = ranks[rows, at]
            done = best == self.NONE
            if done.any():
                narrow = ids[done].astype("<u2")
                for i, n, x in zip(which[done].tolist(), size[done].tolist(), narrow):
                    out[i] = x[:n].tobytes()
                left = ~done
                ids, ranks, size, which, at, best = ids[left], ranks[left], size[left], which[left], at[left], best[left]
                rows = np.arange(len(ids))
                if not len(ids):
                    return
            # Close the gap behind each merged pair, and rank the pairs at its two sides anew.
            ids[rows, at] = self.made[best]
            moved = place[None, :-1] + (place[None, :-1] > at[:, None])
            ids = np.take_along_axis(ids, moved, axis=1)
            ranks = np.take_along_axis(ranks, moved, axis=1)
            size = size - 1
            place = place[:-1]
            after = np.minimum(at + 1, len(place) - 1)
            ranks[rows, at] = np.where(at + 1 < size, self.rank(ids[rows, at], ids[rows, after]), self.NONE)
            before = np.maximum(at - 1, 0)
            some = at > 0
            ranks[rows[some], before[some]] = self.rank(ids[rows, before], ids[rows, at])[some]
            wide = int(size.max())
            if wide < len(place):
                ids, ranks, place = ids[:, :wide], ranks[:, :wide], place[:wide]


class WordTokenizer:
    """Token ids of whole texts, computed once per distinct word and worker.

    Right for tokenizers whose pre-tokenizer never joins across white space, and
    parts a run of letters from the marks that end the word.  Runs of letters are
    merged many at a time (``Merges``), where the file's model is of that kind; other
    words, and texts that hold the string of a special token, go to the tokenizer as
    they are.  ``exact`` is the tokenizer itself, as its file says.
    """

    _workers: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str, cap: int = 600_000):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cap = cap
        self._empty()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        model = json.loads(self.tokenizer.to_str())["model"]
        own = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and len(model["vocab"]) <= 1 << 16
        self.merges = Merges(model) if own else None

    def _empty(self) -> None:
        self.numbers = Numbers()
        self.pool, self.used = np.zeros(0, dtype="<u2"), 0
        self.begins = self.sizes = np.zeros(0, dtype=np.int64)

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        """The worker's own one: words stay known from task to task."""
        if path not in cls._workers:
            cls._workers[path] = cls(path)
        return cls._workers[path]

    def exact(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Append the ids of ``words`` to the pool, which holds those of all numbered words one after the other."""
        heads: dict[str, int] = {}
        others: dict[str, int] = {}
        plan = []
        for w in words:
            plain = _PLAIN.fullmatch(w) if self.merges is not None else None
            if plain:
                head, mark = plain.groups()
                plan.append((heads.setdefault(head.lower(), len(heads)), others.setdefault(mark, len(others)) if mark else -1))
            else:
                plan.append((-1, others.setdefault(w, len(others))))
        merged = self.merges([w.encode() for w in heads]) if heads else []
        alone: list[bytes] = []
        rest = list(others)
        for start in range(0, len(rest), 512):
            alone += [np.array(ids, dtype="<u2").tobytes() for ids in self.exact(rest[start : start + 512])]
        made = [(merged[i] if i >= 0 else b"") + (alone[k] if k >= 0 else b"") for i, k in plan]
        flat = np.frombuffer(b"".join(made), dtype="<u2")
        sizes = np.array([len(x) // 2 for x in made], dtype=np.int64)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(len(flat) + self.used // 2 + 4096, dtype="<u2")))
        self.pool[self.used : self.used + len(flat)] = flat
        begins = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.begins, self.sizes = np.concatenate((self.begins, begins)), np.concatenate((self.sizes, sizes))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = {i for i, t in enumerate(texts) if self.special is not None and self.special.search(t)}
        flat: list[str] = []
        counts = []
        for i, t in enumerate(texts):
            words = () if i in whole else [w for w in _SPACES.split(t) if w] if _SEPARATORS.search(t) else t.split()
            flat += words
            counts.append(len(words))
        if len(self.numbers) > self.cap:
            self._empty()
        found = np.fromiter(map(self.numbers.__getitem__, flat), dtype=np.int64, count=len(flat))
        if self.numbers.new:
            new, self.numbers.new = self.numbers.new, []
            self._learn(new)
        sizes = self.sizes[found]
        ends = np.cumsum(sizes)
        ids = self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins[found] - ends + sizes, sizes)]
        cuts = offsets(sizes)[offsets(counts)].tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in whole:
            out[i] = np.array(self.exact([texts[i]])[0], dtype="<u2")
        return out


def projection(vocabulary: int = 1 << 16, dims: int = DIMS) -> np.ndarray:
    """A fixed random direction of the hashed vector's bucket of each token id."""
    return np.random.default_rng(7).standard_normal((vocabulary, dims)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits``-bit coordinates (Skilling 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(ids: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The point of a document: its normed bag of tokens, projected, as curve coordinates."""
    if not len(ids):
        return np.zeros(directions.shape[1], dtype=np.int64)
    kinds, counts = np.unique(ids, return_counts=True)
    weight = np.sqrt(counts).astype(np.float32)
    point = weight @ directions[kinds] / np.linalg.norm(weight)
    top = (1 << BITS) - 1
    return np.clip((point / 8 + 0.5) * top, 0, top).astype(np.int64)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """``(key, doc_id, ids)``: curve key and token ids (16 bits each, without the closing id) of each row."""
    import pyarrow as pa

    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokenizer.of(path)
        directions = projection()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [x for a, b in portions(texts, BATCH_BYTES // 4) for x in tokens(texts[a:b])]
            points = np.array([curve_key(x, directions) for x in ids]).reshape(-1, DIMS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hilbert(points)), batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary())], names=["key", "doc_id", "ids"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, doc_id long, ids binary")


def ranges(tokens: DataFrame, goal: int = PARTITION_BYTES) -> tuple[DataFrame, int]:
    """``tokens(key, doc_id, ids)`` with the number ``part`` of their range, and how many ranges there are.

    Ranges are made of whole cells of the curve, 2 ** CELL_BITS at most, until they
    hold ``goal`` bytes.  A cell of more is dealt over ranges of its own by a hash of
    the document, so neither equal texts nor long ones fill a task.
    """
    spark = tokens.sparkSession
    cell = F.shiftright("key", DIMS * BITS - CELL_BITS).cast("int")
    held = sorted(map(tuple, tokens.groupBy(cell.alias("cell")).agg(F.sum(F.length("ids") + 64).alias("n")).collect()))
    found, part, fill = [], 0, 0
    for c, n in held:
        if fill and fill + n > goal:
            part, fill = part + 1, 0
        wide = max(1, -(-n // goal))
        found.append((c, part, wide))
        if wide > 1:
            part, fill = part + wide, 0
        else:
            fill += n
    number = F.col("first") + F.pmod(F.xxhash64("doc_id", "key", "ids"), F.col("wide")).cast("int")
    bounds = F.broadcast(spark.createDataFrame(found, "cell int, first int, wide int"))
    return tokens.withColumn("cell", cell).join(bounds, "cell").select("key", "doc_id", "ids", number.alias("part")), part + 1


def remainders(n: int) -> list[int]:
    """The powers of two that sum to ``n``, greatest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length int"
)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of a document.

    A document's tokens are those of its text (null: empty) and ``end_id``; each
    lies in exactly one piece.  Pieces lie in their sequence without gap, from
    offset 0.  Every sequence has 2048 tokens or a power of two, so none is
    padded.  ``ids_crc32`` is that of the piece's ids as little-endian unsigned
    32-bit numbers; ``keep_ids`` adds those bytes as a column ``ids``.  A repeated
    doc_id is packed each time; an empty table gives no row; other columns are
    ignored.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    path = path or default_tokenizer()
    tokens = settle(tokenised(docs, path))
    dealt, parts = ranges(tokens)
    schema = PIECES + (", ids binary" if keep_ids else "")
    closing = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        made, fill = 0, 0
        rows: list[list] = []  # pieces of the open sequence
        names = [c.split()[0] for c in schema.split(", ")]

        def table(out: list[list]) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * (len(names) + (not keep_ids))
            types = [pa.int64()] * 7 + [pa.int32()] + [pa.binary()] * keep_ids
            arrays = [pa.array(columns[i], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def piece(doc, start, ids, total, sequence, offset, length):
            wide = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
            return [doc, start, len(ids) // 2, zlib.crc32(wide), total, sequence, offset, length, wide]

        for batch in batches:
            out: list[list] = []
            for doc, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = (ids or b"") + closing
                total, at = len(ids) // 2, 0
                while at < total:
                    n = min(total - at, SEQUENCE - fill)
                    rows.append([doc, at, ids[2 * at : 2 * (at + n)], total, fill])
                    at, fill = at + n, fill + n
                    if fill == SEQUENCE:
                        out += [piece(r[0], r[1], r[2], r[3], base + made, r[4], SEQUENCE) for r in rows]
                        rows, fill, made = [], 0, made + 1
            if out:
                yield table(out)
        # What is left: cut at powers of two.
        out = []
        lengths = remainders(fill)
        begins = offsets(lengths)
        for doc, start, ids, total, place in rows:
            n, done = len(ids) // 2, 0
            while done < n:
                k = int(np.searchsorted(begins, place + done, side="right")) - 1
                take = min(n - done, int(begins[k + 1]) - place - done)
                out.append(piece(
                    doc, start + done, ids[2 * done : 2 * (done + take)], total, base + made + k,
                    place + done - int(begins[k]), lengths[k],
                ))
                done += take
        yield table(out)

    prepare(spark)
    rows = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("key", "doc_id").select("key", "doc_id", "ids")
    return rows.mapInArrow(run, schema)
