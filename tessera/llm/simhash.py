"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits; a segment's
coordinate is its popcount (0, 1 or 2).  The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so it is a lower
bound that a grid can search:

* the vector is cut into ``GROUPS`` = 6 stripes.  Vectors within distance 3
  differ in at most three stripes, so they share the grid cell of at least
  three; every fingerprint enters one cell for each of the C(6, 3) = 20 choices
  of three stripes,
* pairs within a cell whose vectors lie within the distance are verified on the
  fingerprints themselves.

Cells are read as sorted runs, and a task reports from each run only a spanning
forest of the verified links: a cell of m fingerprints gives at most m - 1 rows.
A cell of more than ``TILE`` fingerprints is dealt out in tiles (pairs of
blocks), so no task holds an unbounded cell.  Equal fingerprints are one point
before any of this.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, prepare, settle
from .components import connected_components
from .embdedup import spanning

GROUPS = 6
#: Fingerprints of one cell that a task compares in one piece.
TILE = 4096
CHUNK = 1 << 15


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles of ``text``, repeats included.

    Words are runs of bytes other than ASCII white space, A-Z in lower case.
    A text of fewer than k words has its whole sequence as the only shingle.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    parts = [joined[i:j] for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    digests = b"".join(map(xxhash.xxh64_digest, parts, repeat(42)))
    return np.frombuffer(digests, dtype=">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; none give 0."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``: the SimHash as a signed long.

    A null or empty text, or one of white space only, has fingerprint 0.
    Columns other than doc_id and text are ignored.
    """
    import pyarrow as pa

    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t, k)) for t in byte_texts(batch.column(1))]
            fps = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def popcounts(fps: np.ndarray) -> np.ndarray:
    """The embedding, packed: two bits hold the popcount of each two-bit segment."""
    fps = fps.view(np.uint64)
    low = np.uint64(0x5555555555555555)
    return (fps & low) + ((fps >> np.uint64(1)) & low)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed popcount vectors: |0-1|, |1-2| = 1, |0-2| = 2.

    0, 1, 2 become 00, 01, 11 (unary); the distance is then one popcount.
    """
    low = np.uint64(0x5555555555555555)
    unary = lambda x: (x & (low << np.uint64(1))) | ((x | (x >> np.uint64(1))) & low)
    return np.bitwise_count(unary(a) ^ unary(b))


def _masks() -> np.ndarray:
    """For each choice of three stripes, the bits of the packed vector that form the cell."""
    bounds = [round(i * 32 / GROUPS) for i in range(GROUPS + 1)]
    stripes = [sum(3 << (2 * i) for i in range(a, b)) for a, b in zip(bounds, bounds[1:])]
    return np.array([sum(stripes[i] for i in c) for c in combinations(range(GROUPS), GROUPS - 3)], dtype=np.uint64)


def _cells(points: DataFrame) -> DataFrame:
    """``(choice, cell, fp)``: the grid cells of every fingerprint."""
    import pyarrow as pa

    masks = _masks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            cells = popcounts(fps)[:, None] & masks[None, :]
            choice = np.tile(np.arange(len(masks), dtype=np.int32), len(fps))
            yield pa.RecordBatch.from_arrays(
                [pa.array(choice), pa.array(cells.ravel().view(np.int64)), pa.array(np.repeat(fps, len(masks)))],
                names=["choice", "cell", "fp"],
            )

    return points.mapInArrow(run, "choice int, cell long, fp long")


class _Forest:
    """Union-find over the indices of one cell."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Where the lower bound and then the fingerprints themselves are within ``most`` bits."""
    near = manhattan(popcounts(a), popcounts(b)) <= most
    near &= np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= most
    return near


def _cell_links(fps: np.ndarray, side: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps``; ``side`` 0 and 1 are compared across only."""
    forest, out = _Forest(len(fps)), []
    whole = not side.any() or side.all()
    step = max(1, (1 << 18) // max(1, len(fps)))
    for i in range(0, len(fps), step):
        rows = slice(i, i + step)
        near = _near(fps[rows, None], fps[None, :], most)
        near &= np.arange(len(fps))[None, :] > np.arange(i, i + near.shape[0])[:, None]
        if not whole:
            near &= side[rows, None] != side[None, :]
        for x, y in zip(*(v.tolist() for v in np.nonzero(near))):
            if forest.join(x + i, y):
                out.append((x + i, y))
    return out


def _run_links(key: np.ndarray, fps: np.ndarray, side: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; ``key`` is sorted, ``fps`` signed."""
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[begins, len(key)])
    left, right = [], []
    small = np.repeat(sizes <= 16, sizes)
    for d in range(1, 16):
        if len(fps) <= d:
            break
        near = (key[d:] == key[:-d]) & small[:-d] & ((side[d:] != side[:-d]) | (side[d:] == 0))
        at = np.flatnonzero(near)
        if not len(at):
            break
        at = at[_near(fps[at], fps[at + d], most)]
        left.append(fps[at])
        right.append(fps[at + d])
    for b, n in zip(begins[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
        own = fps[b : b + n]
        found = _cell_links(own, side[b : b + n], most)
        if found:
            x, y = np.array(found).T
            left.append(own[x])
            right.append(own[y])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def fingerprint_links(points: DataFrame, max_bits: int = 3) -> DataFrame:
    """``(a, b)``: links that span the components of ``points(fp)`` at ``max_bits`` differing bits.

    ``points`` has distinct fingerprints.  Every row is a true link; fingerprints
    that a chain of links joins are joined by the returned ones too.
    """
    import pyarrow as pa

    if max_bits > GROUPS - 3:
        raise ValueError(f"the grid finds up to {GROUPS - 3} differing bits")
    cells = _cells(points)
    hot = (
        cells.groupBy("choice", "cell").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
        .select("choice", "cell", F.ceil(F.col("n") / (TILE // 2)).cast("int").alias("blocks"))
    )
    # A hot cell's fingerprint in block x goes to the tiles (x, y) of all blocks y; one of a pair's blocks has side 1.
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)).alias("y")
    dealt = (
        cells.join(hot, ["choice", "cell"], "left")
        .select("choice", "cell", "fp", F.coalesce(block, F.lit(0)).alias("x"), other)
        .select(
            "choice", "cell", "fp", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"),
            F.when(F.col("x") < F.col("y"), 1).when(F.col("x") > F.col("y"), 2).otherwise(0).cast("int").alias("side"),
        )
        .select(F.xxhash64("choice", "cell", "i", "j").alias("key"), "fp", "side")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 3

        def links(parts: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _run_links(parts[0], parts[1], parts[2], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            parts = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
            cut = np.searchsorted(parts[0], parts[0][-1]) if len(parts[0]) else 0
            held = [p[cut:] for p in parts]
            if cut:
                yield links([p[:cut] for p in parts])
        yield links(held)

    return (
        dealt.repartition("key").sortWithinPartitions("key", "side", "fp")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def simhash_components(docs: DataFrame, k: int = 3, max_bits: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every document.

    Documents link at ``max_bits`` or fewer differing bits of their fingerprints;
    a component is named by its smallest doc_id.  ``fingerprint`` has 16
    hexadecimal digits.  Texts without a word have fingerprint zero and link like
    any other.  A repeated doc_id gives a row each time; an empty table none.
    """
    prepare(docs.sparkSession)
    fps = settle(fingerprints(docs, k))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = fingerprint_links(classes.select("fp"), max_bits)
    labels = connected_components(links)
    prepare(docs.sparkSession, 10_000)
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = named.join(least, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Banded min-hashes: how many bands, and min-hashes in each.
BANDS, BAND_ROWS = 20, 5
#: Ids that are sent to all tasks at most; more are joined by a shuffle.
SENT_IDS = 2_000_000
#: Texts that are compared in one piece, and bytes of shingles of these; larger groups are dealt out in tiles.
TEXTS, SET_BYTES = 2048, 8 << 20
#: Shingles that are multiplied at a time, and pairs of rarer ones that are counted at a time.
COLUMNS, PAIRS = 1024, 1 << 20


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    n = BANDS * BAND_ROWS
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def band_keys(hashes: np.ndarray, multipliers: np.ndarray, shifts: np.ndarray) -> bytes:
    """A 64-bit key for every band of min-hashes of a set of shingle hashes."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096, None] * multipliers[None, :] + shifts[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    key = np.zeros(BANDS, dtype=np.uint64)
    for j in range(BAND_ROWS):
        key = (key ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.tobytes()


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, class, fp, bands)``: digest of the words, SimHash and band keys; null without a word."""
    import hashlib

    import pyarrow as pa

    prepare(docs.sparkSession)
    multipliers, shifts = _permutations()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, fps, bands = [], [], []
            for t in byte_texts(batch.column(1)):
                hashes = shingle_hashes(t, k)
                if not len(hashes):
                    classes.append(None), fps.append(None), bands.append(None)
                    continue
                classes.append(hashlib.md5(b" ".join(t.lower().split())).digest())
                fp = fingerprint(hashes)
                fps.append(fp - (1 << 64) * (fp >> 63))
                bands.append(band_keys(np.unique(hashes), multipliers, shifts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(classes, pa.binary()), pa.array(fps, pa.int64()), pa.array(bands, pa.binary())],
                names=["doc_id", "class", "fp", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, class binary, fp long, bands binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``(id, shingles)``: the sorted distinct shingle hashes of each text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, k)).tobytes() for t in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, shingles binary")


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each of the ``left`` places of ``sets`` shares with each of the ``right`` ones.

    Elements of many sets are multiplied as columns of zeros and ones, the others
    counted pair by pair, those of one set (what a set shares with itself) not at all.
    """
    n = len(sets)
    row, column = np.full(n, -1), np.full(n, -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, element, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    often = np.cumsum((df > 1) & (df * 32 >= n))
    some = (df > 1) & (df * 32 >= n)
    for start in range(0, int(often[-1]), COLUMNS):
        here = some[element] & (often[element] > start) & (often[element] <= start + COLUMNS)
        ones = np.zeros((n, COLUMNS), dtype=np.float32)
        ones[owner[here], often[element[here]] - 1 - start] = 1
        out += ones[left] @ ones[right].T
    rare = np.flatnonzero(((df > 1) & ~some)[element])
    rare = rare[np.argsort(element[rare], kind="stable")]
    a, b = rare[row[owner[rare]] >= 0], rare[column[owner[rare]] >= 0]
    # Every posting on the left meets the postings of its element on the right, which are a range.
    first, last = (np.searchsorted(element[b], element[a], side) for side in ("left", "right"))
    many = last - first
    ends = np.cumsum(many)
    flat, done = out.reshape(-1), 0
    while done < len(a):
        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
        k = many[done:until]
        other = np.repeat(first[done:until] - np.cumsum(k) + k, k) + np.arange(k.sum())
        at, times = np.unique(np.repeat(row[owner[a[done:until]]], k) * len(right) + column[owner[b[other]]], return_counts=True)
        flat[at] += times
        done = until
    return out


def set_links(sets: list[np.ndarray], side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The ends of a spanning forest of the pairs with a Jaccard similarity of ``least`` or more.

    ``side`` 1 and 2 are compared across only, all of side 0 with each other.
    """
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    if len(sets) < 2 or not len(left) or not len(right):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    size = np.array([len(x) for x in sets], dtype=np.float64)
    both = shared_counts(sets, left, right)
    x, y = [], []
    for start in range(0, len(left), 256):
        rows, part = left[start : start + 256], both[start : start + 256].astype(np.float64)
        near = part >= least * (size[rows, None] + size[None, right] - part)
        if not side.any():
            near &= rows[:, None] < right[None, :]
        i, j = np.nonzero(near)
        x.append(rows[i]), y.append(right[j])
    x, y = np.concatenate(x), np.concatenate(y)
    tree = spanning(x, y, len(sets))
    return x[tree], y[tree]


def _compared(tiles: DataFrame, least: float) -> DataFrame:
    """``(a, b)``: links that span the similar texts of each of ``tiles(home, i, j, side, id, shingles)``, a task for each."""
    import pyarrow as pa

    def run(table):
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("shingles")]
        x, y = set_links(sets, side, least)
        return pa.table({"a": pa.array(ids[x], pa.int64()), "b": pa.array(ids[y], pa.int64())})

    return tiles.select("home", "i", "j", "side", "id", "shingles").groupBy("home", "i", "j").applyInArrow(run, "a long, b long")


def _similar(homes: DataFrame, sets: DataFrame, least: float, buckets: Callable[[], DataFrame] | None = None, known: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: links that span the components of each home of ``homes(home, id)``, texts in ``sets(id, shingles, size)``.

    Two ids of one home link if their shingle sets have a Jaccard similarity of
    ``least`` or more.  A home is read by one task; one of over ``TEXTS`` texts or
    ``SET_BYTES`` is dealt into blocks and compared in two rounds.  In the first every
    block meets block 0 (and that itself).  Most texts of a family are then of one
    component, so in the second only the texts outside a home's largest component
    meet all others: a pair inside it needs no comparison, one with block 0 had its own.
    Rows grow with the texts, and with the blocks only for texts of that rest.

    A home with so large a rest that they are more than the ``buckets(id, bucket)`` of
    its texts hold is parted into these, where fewer copies of its texts are read.
    ``known`` are links that were found before.
    """
    sizes = sets.select("id", "size")
    large = settle(homes.join(sizes, "id").groupBy("home").agg(*_blocks()).where(F.col("blocks") > 1))
    blocks = sent(large)
    block = F.coalesce(F.pmod(F.xxhash64("id", F.lit("tile")), F.col("blocks")), F.lit(0)).cast("int").alias("x")
    placed = homes.join(sets, "id").join(blocks, "home", "left").select("home", "id", "shingles", F.coalesce("blocks", F.lit(1)).alias("blocks"), block)
    # Of a tile (0, j) block 0 has side 1 and block j side 2; of (0, 0) all have side 0.
    tile = F.explode(F.when(F.col("x") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("x"))).alias("j")
    side = F.when(F.col("j") == 0, 0).when(F.col("x") == 0, 1).otherwise(2).alias("side")
    first = settle(_compared(placed.select("home", "id", "shingles", "x", F.lit(0).alias("i"), tile).withColumn("side", side), least))
    if large.isEmpty():
        return first
    inside = settle(homes.join(sizes, "id").join(blocks, "home").select("home", "id", "size", "n", "blocks", block))
    links = first if known is None else first.unionByName(known)
    labels = connected_components(links.join(inside.select(F.col("id").alias("a")).distinct(), "a", "left_semi"))
    tagged = inside.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    share = tagged.groupBy("home", "component").agg(F.count("*").alias("k")).groupBy("home")
    top = sent(share.agg(F.max_by("component", F.struct("k", "component")).alias("top")))
    rest = settle(tagged.join(top, "home").where((F.col("component") != F.col("top")) & (F.col("x") > 0)).drop("component", "top", "x"))
    halves = F.greatest(F.ceil(F.count("*") / (TEXTS // 2)), F.ceil(F.sum("size") / (SET_BYTES // 2))).cast("int")
    parts = rest.groupBy("home").agg(F.count("*").alias("r"), halves.alias("halves"), F.first("n").alias("n"), F.first("blocks").alias("blocks"))
    copies = F.col("r") * (F.col("blocks") - 1) + F.col("n") * F.col("halves")
    parts = settle(parts.select("home", "n", "halves", copies.alias("copies")))
    out = first
    if buckets is not None:
        long = parts.where(F.col("copies") > (BANDS + 1) * F.col("n")).select("home", "copies")
        if not long.isEmpty():
            own = settle(buckets().join(inside.select("home", "id", "size").join(sent(long), "home"), "id"))
            filled = own.groupBy("home", "bucket").agg(*_blocks(), F.first("copies").alias("copies")).where(F.col("n") > 1)
            cheaper = filled.groupBy("home").agg(F.sum(F.col("n") * F.col("blocks")).alias("read"), F.first("copies").alias("copies"))
            cheaper = settle(cheaper.where(F.col("read") < F.col("copies")).select("home"))
            held = own.join(sent(cheaper), "home", "left_semi").join(filled.select("home", "bucket"), ["home", "bucket"], "left_semi")
            parted = settle(held.select(F.xxhash64("home", "bucket").alias("home"), "id"))
            out = out.unionByName(_similar(parted, sets, least, known=links))
            parts = parts.join(cheaper, "home", "left_anti")
    # The rest has side 1, in blocks of its own; block j of all texts side 2.
    meets = sent(parts.select("home", "halves"))
    row = F.pmod(F.xxhash64("id", F.lit("rest")), F.col("halves")).cast("int").alias("i")
    own = rest.join(meets, "home").join(sets.select("id", "shingles"), "id")
    own = own.select("home", "id", "shingles", row, F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("j"), F.lit(1).alias("side"))
    others = placed.where(F.col("x") > 0).join(meets, "home")
    others = others.select("home", "id", "shingles", F.explode(F.sequence(F.lit(0), F.col("halves") - 1)).alias("i"), F.col("x").alias("j"), F.lit(2).alias("side"))
    return out.unionByName(settle(_compared(own.unionByName(others), least)))


def _blocks() -> list:
    """Aggregates of (id, size) rows: their number, and the blocks that a home of them is dealt into."""
    n, size = F.count("*"), F.sum("size")
    whole = (n <= TEXTS) & (size <= SET_BYTES)
    halves = F.greatest(F.ceil(n / (TEXTS // 2)), F.ceil(size / (SET_BYTES // 2)))
    return [n.alias("n"), F.when(whole, 1).otherwise(halves).cast("int").alias("blocks")]


def sent(ids: DataFrame) -> DataFrame:
    """``ids``, marked to be sent to all tasks if there are few enough of them."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, max_bits: int = 3) -> DataFrame:
    """``(doc_id, component_id)`` of the documents whose near-duplicate has a smaller doc_id, by shingles of ``k`` words.

    Texts of equal words are one class.  Classes link if the Jaccard similarity of
    their sets of k-word shingles is at least ``similarity``, which is verified
    exactly.  Candidates are the fingerprints that link at ``max_bits``, and, as
    these reach few pairs of a similarity near 0.8 (their fingerprints differ in
    about ten bits), pairs that share a band of min-hashes: 20 bands of 5 miss a
    pair of similarity 0.8 once in 3000 times.  What such candidates join, by chains
    too, is a group, and all pairs of a group are compared in tasks that read its
    texts once; of a large group not those that are joined already, and those that
    share a bucket only, where these need less reading (``_similar``).

    A component is named by its smallest doc_id, which isn't listed itself; nor is
    a text without a word, or a null doc_id.  Rows of one doc_id count as one
    document.
    """
    from .common import discard

    profiles = settle(_profiles(docs, k).where(F.col("class").isNotNull() & F.col("doc_id").isNotNull()))
    classes = settle(
        profiles.groupBy("class").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    )
    # Equal fingerprints, then fingerprints that link.
    firsts = classes.groupBy("fp").agg(F.min("id").alias("hub"))
    equal = classes.join(firsts, "fp").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    links = settle(fingerprint_links(firsts.select("fp"), max_bits))
    near = links.join(firsts.select(F.col("fp").alias("a"), F.col("hub").alias("x")), "a").join(
        firsts.select(F.col("fp").alias("b"), F.col("hub").alias("y")), "b"
    ).select(F.col("x").alias("a"), F.col("y").alias("b"))
    prepare(docs.sparkSession, 10_000)
    place = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    keys = classes.select("id", "bands", place).select("id", "band", F.substring("bands", F.col("band") * 8 + 1, F.lit(8)).alias("key"))
    hubs = keys.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1)
    banded = keys.join(hubs.drop("n"), ["band", "key"]).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    pairs = equal.unionByName(near).unionByName(banded).where(F.col("a") != F.col("b"))
    groups = settle(connected_components(pairs).select(F.col("node").alias("id"), F.col("component").alias("home")))
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sent(groups.select(F.col("id").alias("doc_id"))), "doc_id")
    sets = settle(_sets(own, k).groupBy("id").agg(F.min("shingles").alias("shingles")).withColumn("size", F.length("shingles")))

    def members() -> DataFrame:
        linked = connected_components(links).withColumnRenamed("node", "fp")
        kin = classes.select("id", "fp").join(linked, "fp", "left").select("id", F.xxhash64(F.coalesce("component", "fp")).alias("bucket"))
        return kin.unionByName(keys.select("id", F.xxhash64("band", "key").alias("bucket"))).distinct()

    similar = _similar(groups, sets, similarity, members)
    labels = connected_components(similar)
    of_class = classes.join(labels.withColumnRenamed("node", "id"), "id", "left")
    out = profiles.join(of_class.select("class", F.coalesce("component", "id").alias("component_id")), "class")
    listed = settle(out.select("doc_id", "component_id").where(F.col("doc_id") != F.col("component_id")))
    discard(profiles, classes, links, groups, sets)
    return listed


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the near-duplicates of a document of smaller doc_id; all columns kept.

    See ``near_duplicates``.  Rows without a doc_id or a word stay.
    """
    gone = near_duplicates(docs, k, similarity).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(sent(gone), docs["doc_id"] == F.col("__gone"), "left_anti")
