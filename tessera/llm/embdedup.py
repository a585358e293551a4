"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Distinct vectors are the points; copies are counted, not compared.  Points are
dealt into blocks of at most ``BLOCK`` that lie near one pivot each (near the same
second pivot, too, where many points share the first), and every pair of blocks is a
tile.  Tiles are sent the int8 codes of their points, made once.  In a tile:

* the triangle inequality on angles rules it out whole where the pivots' angle
  less both radii exceeds the threshold's,
* else one product in 32-bit floats finds the pairs that may link (a cut below the
  threshold by the largest bound and the product's rounding), and the int8 codes of
  these are multiplied (sums of products of codes are exact in 32-bit floats up to ``EXACT_DIMS`` dimensions, wider
  vectors are multiplied in slices).  With u = s c + e, where s is the scale, c
  the code and e the rounding error of a vector, |u.v - s t (c.d)| <=
  |e||v^| + |u^||f| + |e||f|, a bound that each vector's own norms give,
* pairs whose product less the bound reaches the threshold are links, and those
  whose product plus the bound doesn't are none.

Tiles with pairs between the two are sent once more, with the original components,
and only those pairs are computed in double precision.

A tile reports its points' link counts and a spanning forest of its links, so its
rows grow with its points and not with its pairs; pairs are held for ``ROWS`` points of
one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, settle
from .components import connected_components

BLOCK = 8192
#: Points of a block that are multiplied at a time.
ROWS = 512
#: Pivots at most; one for every half block of points till then.  Beyond that points are parted by their second pivot.
PIVOTS = 2048
#: Blocks whose centres are compared at a time with as many others.
HEADS = 512
#: 127 * 127 * 1024 < 2 ** 24
EXACT_DIMS = 1024
#: A stretch of which a DENSE-th may link is multiplied out.
DENSE = 8
#: Slack for the rounding of the bound's own arithmetic.
SLACK = 1e-5


def usable_rows(vectors: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors can link (not null, of finite components, not zero), and those as doubles."""
    ok, out = np.zeros(len(vectors), dtype=bool), []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or any(x is None for x in v):
            continue
        x = np.asarray(v, dtype=np.float64)
        if np.isfinite(x).all() and x.any():
            ok[i] = True
            out.append(x)
    return ok, out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; scaled first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantised:
    """Int8 codes of unit vectors and what bounds their products' errors."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, length: np.ndarray):
        self.codes, self.scale, self.error, self.length = codes, scale, error, length

    @classmethod
    def of(cls, u: np.ndarray) -> "Quantised":
        scale = np.abs(u).max(axis=1) / 127
        codes = np.rint(u / scale[:, None]).astype(np.int8)
        near = codes * scale[:, None]
        up = lambda x: np.nextafter(np.sqrt(x).astype(np.float32), np.float32(np.inf))
        return cls(codes, scale, up(((u - near) ** 2).sum(axis=1)), up((near**2).sum(axis=1)))

    def pack(self) -> list[bytes]:
        return [x.tobytes() for x in (self.codes, self.scale, self.error, self.length)]

    @classmethod
    def unpack(cls, codes: bytes, scale: bytes, error: bytes, length: bytes) -> "Quantised":
        scales = np.frombuffer(scale)
        return cls(np.frombuffer(codes, dtype=np.int8).reshape(len(scales), -1), scales, np.frombuffer(error, np.float32), np.frombuffer(length, np.float32))

    def products(self, other: "Quantised", rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Approximate cosines of ``rows`` with all of ``other``, and bounds of their errors."""
        dot = np.zeros((len(self.scale[rows]), len(other.scale)), dtype=np.float64)
        for d in range(0, self.codes.shape[1], EXACT_DIMS):
            part = slice(d, d + EXACT_DIMS)
            dot += self.codes[rows, part].astype(np.float32) @ other.wide(part)
        dot *= self.scale[rows, None] * other.scale[None, :]
        e, n = self.error[rows, None].astype(np.float64), self.length[rows, None].astype(np.float64)
        f, m = other.error[None, :].astype(np.float64), other.length[None, :].astype(np.float64)
        return dot, e * m + n * f + e * f

    def candidates(self, other: "Quantised", rows: slice, first: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places, in ``rows`` and from ``first`` on in ``other``, of all pairs that the bounds could count as links or leave open.

        One product in 32-bit floats; each row's cut takes the largest bound of its pairs and the product's own rounding off.
        """
        a, b = self.near()[rows], other.near()[first:]
        if not len(b):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        e, n = self.error[rows].astype(np.float64), self.length[rows].astype(np.float64)
        f, m = float(other.error.max()), float(other.length.max())
        cut = least - SLACK - (e * m + n * f + e * f) - (a.shape[1] + 8) * 2.0**-24 * n * m * 1.01
        found = a @ b.T >= np.nextafter(cut.astype(np.float32), np.float32(-np.inf))[:, None]
        at = np.flatnonzero(found) if found.any() else np.zeros(0, dtype=np.int64)
        return at // len(b), at % len(b)

    def some_products(self, other: "Quantised", i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``products``, of the pairs (i, j) alone."""
        dot, bound = np.zeros(len(i)), np.zeros(len(i))
        for start in range(0, len(i), 1 << 14):
            some = slice(start, start + (1 << 14))
            x, y = i[some], j[some]
            for d in range(0, self.codes.shape[1], EXACT_DIMS):
                part = slice(d, d + EXACT_DIMS)
                dot[some] += np.einsum("ij,ij->i", self.codes[x, part].astype(np.float32), other.codes[y, part].astype(np.float32))
            e, n, f, m = (v.astype(np.float64) for v in (self.error[x], self.length[x], other.error[y], other.length[y]))
            dot[some] *= self.scale[x] * other.scale[y]
            bound[some] = e * m + n * f + e * f
        return dot, bound

    def near(self) -> np.ndarray:
        """The vectors that the codes stand for, as 32-bit floats; kept."""
        if not hasattr(self, "_near"):
            self._near = (self.codes * self.scale[:, None]).astype(np.float32)
        return self._near

    def wide(self, part: slice) -> np.ndarray:
        """Codes as 32-bit floats, which hold sums of their products exactly; those of one slice are kept."""
        if getattr(self, "_part", None) != part:
            self._part, self._wide = part, np.ascontiguousarray(self.codes[:, part].astype(np.float32).T)
        return self._wide


def tile_links(
    a: Quantised, b: Quantised | None, copies: np.ndarray, least: float, exact: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Links with cosine >= ``least`` between the points of ``a`` and ``b``, or within ``a``.

    Points are numbered through, those of ``b`` last; ``copies`` goes by these
    numbers.  Returns how many vectors each point links to, the ends of a spanning
    forest, and whether there are pairs that the bounds don't decide.  With ``exact``
    (the unit vectors of both blocks) only the undecided pairs are looked at, and decided.
    """
    other, shift = (a, 0) if b is None else (b, len(a.scale))
    n = len(copies)
    counts = np.zeros(n)
    x = y = np.zeros(0, dtype=np.int64)
    open_pairs = False
    for start in range(0, len(a.scale), ROWS):
        rows = slice(start, start + ROWS)
        left = len(a.scale[rows])
        first = start if b is None else 0
        i, j = a.candidates(other, rows, first, least)
        if len(i) * DENSE > left * (len(other.scale) - first):
            near, bound = (x[:, first:].ravel() for x in a.products(other, rows))
            i, j = np.divmod(np.arange(len(near)), len(other.scale) - first)
        else:
            near, bound = a.some_products(other, i + start, j + first)
        i, j = i + start, j + first
        sure = near - bound >= least + SLACK
        maybe = ~sure & (near + bound >= least - SLACK)
        if b is None:
            sure &= j > i
            maybe &= j > i
        open_pairs = open_pairs or bool(maybe.any())
        taken = np.flatnonzero(maybe if exact is not None else sure)
        i, j = i[taken] - start, j[taken]
        if exact is not None:
            kept = np.zeros(len(i), dtype=bool)
            for part in range(0, len(i), 1 << 16):
                some = slice(part, part + (1 << 16))
                kept[some] = np.einsum("ij,ij->i", exact[0][i[some] + start], exact[1][j[some]]) >= least
            i, j = i[kept], j[kept]
        if not len(i):
            continue
        i, j = i + start, j + shift
        counts += np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        x, y = np.concatenate((x, i)), np.concatenate((y, j))
        tree = spanning(x, y, n)
        x, y = x[tree], y[tree]
    return counts, x, y, open_pairs


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Places in (i, j) of a spanning forest of the links among n points."""
    label = np.arange(n)
    kept = []
    live = np.arange(len(i))
    while len(live):
        a, b = label[i[live]], label[j[live]]
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
        if not len(live):
            break
        high, low = np.maximum(a, b), np.minimum(a, b)
        # Each component hooks to the least one that it is linked to; hooks go downwards, so they form no cycle.
        order = np.lexsort((low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        kept.append(live[first])
        hook = np.arange(n)
        hook[high[first]] = low[first]
        while (hook[hook] != hook).any():
            hook = hook[hook]
        label = hook[label]
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, dtype=np.int64)


def _angle(cosine):
    return np.arccos(np.clip(cosine, -1, 1))


def vector_components(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``.

    Two vectors link if their cosine in double precision is at least ``least``;
    vectors of different lengths don't link.  A vector that is null, empty, zero
    or holds a null or non-finite component links with nothing: 0 links, itself
    its component, kept.  ``n_links`` counts linked rows, copies included;
    ``component_id`` is the least vec_id reached, ``kept`` its row.  ``vec_id`` is
    taken as a key; other columns are ignored; an empty table gives no row.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    prepare(spark, 4096)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, found = usable_rows(batch.column(1).to_pylist())
            data = iter([x.tobytes() for x in found])
            values = [next(data) if k else None for k in ok]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["vec_id", "data"])

    parsed = settle(rows.mapInArrow(parse, "vec_id long, data binary"))
    points = settle(
        parsed.where(F.col("data").isNotNull()).groupBy("data")
        .agg(F.min("vec_id").alias("point"), F.count("*").alias("copies"))
    )
    # Blocks: near one of at most PIVOTS points; many of these are parted by the second nearest, then by a hash.
    wanted = max(1, min(PIVOTS, points.count() * 2 // BLOCK))
    pivots = points.orderBy(F.xxhash64("point")).limit(wanted).select("data").toArrow().column(0).to_pylist()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for size in {len(p) for p in pivots}:
            own[size] = unit(np.array([np.frombuffer(p) for p in pivots if len(p) == size]))
        for batch in batches:
            data = batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in data])
            near, second = np.zeros((2, len(data)), dtype=np.int32)
            for size in own.keys() & set(sizes.tolist()):
                at = np.flatnonzero(sizes == size)
                for some in np.split(at, range(256, len(at), 256)):
                    cosine = unit(np.array([np.frombuffer(data[k]) for k in some])) @ own[size].T
                    near[some] = second[some] = cosine.argmax(axis=1)
                    if cosine.shape[1] > 1:
                        cosine[np.arange(len(some)), near[some]] = -np.inf
                        second[some] = cosine.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(near, pa.int32()), pa.array(second, pa.int32())],
                names=["point", "data", "copies", "pivot", "second"],
            )

    near = points.select("point", "data", "copies").mapInArrow(assign, "point long, data binary, copies long, pivot int, second int")
    near = settle(near.withColumn("width", F.length("data")))
    # Both tables have a row for each pair of pivots that is nearest to a point, at most.
    wide = F.broadcast(near.groupBy("width", "pivot").agg((F.count("*") > BLOCK).alias("wide")))
    near = near.join(wide, ["width", "pivot"]).withColumn("second", F.when(F.col("wide"), F.col("second")).otherwise(-1))
    shares = near.groupBy("width", "pivot", "second").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("point"), F.col("parts")).cast("int")
    dealt = near.join(shares, ["width", "pivot", "second"]).select(
        F.concat_ws("/", "width", "pivot", "second", part).alias("block"), "point", "data", "copies"
    )

    def describe(key, table):
        data = table.column("data").to_pylist()
        u = unit(np.array([np.frombuffer(x) for x in data]))
        centre = u.sum(axis=0)
        centre = centre / max(1e-300, float(np.sqrt(centre @ centre)))
        radius = float(_angle(u @ centre).max()) + 1e-6
        values = [
            key[0].as_py(), len(data[0]), centre.tobytes(), radius, b"".join(data), *Quantised.of(u).pack(),
            table.column("point").to_numpy().tobytes(), table.column("copies").to_numpy().tobytes(),
        ]
        return pa.Table.from_arrays([pa.array([v]) for v in values], names=names)

    schema = "block string, width long, centre binary, radius double, data binary, codes binary, scale binary, error binary, length binary, points binary, copies binary"
    names = [c.split()[0] for c in schema.split(", ")]
    blocks = settle(dealt.groupBy("block").applyInArrow(describe, schema))
    tiles = settle(_tiles(blocks, least))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sides = ("",) if r["i"] == r["j"] else ("", "_2")
                codes = [Quantised.unpack(*(r[f"{c}{x}"] for c in ("codes", "scale", "error", "length"))) for x in sides]
                points, copies = (np.concatenate([np.frombuffer(r[f"{c}{x}"], dtype=np.int64) for x in sides]) for c in ("points", "copies"))
                exact = None
                if "data" in r:
                    u = [unit(np.frombuffer(r[f"data{x}"]).reshape(-1, r["width"] // 8)) for x in sides]
                    exact = (u[0], u[-1])
                counts, x, y, undecided = tile_links(codes[0], codes[1] if len(codes) > 1 else None, copies, least, exact)
                undecided = int(undecided and exact is None)
                linked = np.flatnonzero(counts)
                a = np.r_[points[linked], points[x], np.zeros(undecided, dtype=np.int64)]
                is_link = np.r_[np.zeros(len(linked), bool), np.ones(len(x), bool), np.zeros(undecided, bool)]
                b = np.zeros(len(a), dtype=np.int64)
                b[is_link] = points[y]
                n = np.zeros(len(a), dtype=np.int64)
                n[: len(linked)] = counts[linked]
                blank = len(a) - undecided
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b, mask=~is_link), pa.array(n), pa.array([None] * blank + [r["i"]] * undecided, pa.string()), pa.array([None] * blank + [r["j"]] * undecided, pa.string())],
                    names=["a", "b", "n", "i", "j"],
                )

    def compared(tiles: DataFrame, *more: str) -> DataFrame:
        columns = ["codes", "scale", "error", "length", "points", "copies", *more]
        left = blocks.select(F.col("block").alias("i"), "width", *columns)
        right = blocks.select(F.col("block").alias("j"), *[F.col(c).alias(f"{c}_2") for c in columns])
        prepare(spark, 2)
        work = tiles.join(left, "i").join(right, "j").repartition("i", "j")
        return settle(work.mapInArrow(compare, "a long, b long, n long, i string, j string"))

    first = compared(tiles)
    again = compared(first.where(F.col("i").isNotNull()).select("i", "j"), "data")
    prepare(spark, 4096)
    found = first.unionByName(again).where(F.col("i").isNull())
    labels = connected_components(found.where(F.col("b").isNotNull()).select("a", "b"))
    counts = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("n"))
    of_data = (
        points.join(labels.withColumnRenamed("node", "point"), "point", "left")
        .join(counts.withColumnRenamed("a", "point"), "point", "left")
        .select("data", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "point").alias("component"))
    )
    out = parsed.join(of_data, "data", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _tiles(blocks: DataFrame, least: float) -> DataFrame:
    """``(i, j)``: pairs of ``blocks`` that can hold a link, by their centres and radii; a block with itself, too.

    Blocks are dealt into groups of about ``HEADS``; a task compares two groups.
    """
    import pyarrow as pa

    most = float(np.arccos(least))
    groups = max(1, -(-blocks.count() // HEADS))
    own = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    heads = blocks.select("block", "width", "centre", "radius", own.alias("own")).withColumn("other", other)
    heads = heads.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "block", "width", "centre", "radius", "own")

    def reach(key, table):
        block, own = table.column("block").to_pylist(), table.column("own").to_numpy()
        centre, radius = np.array([np.frombuffer(c) for c in table.column("centre").to_pylist()]), table.column("radius").to_numpy()
        left, right = np.flatnonzero(own == key[0].as_py()), np.flatnonzero(own == key[1].as_py())
        near = _angle(centre[left] @ centre[right].T) <= radius[left][:, None] + radius[right][None, :] + most + 1e-6
        i, j = left[np.nonzero(near)[0]], right[np.nonzero(near)[1]]
        if key[0].as_py() == key[1].as_py():
            i, j = i[i <= j], j[i <= j]
        return pa.table({"i": pa.array([block[k] for k in i], pa.string()), "j": pa.array([block[k] for k in j], pa.string())})

    return heads.groupBy("x", "y", "width").applyInArrow(reach, "i string, j string")
