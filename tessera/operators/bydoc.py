"""Documents' labelled graphs, made, decoded and compared with their labels one document after the other.

The same as ``docgraph.instance``, ``features``, ``decode`` and ``learn`` do with tables of
mentions, for texts whose graphs fit a worker: only what comes out leaves it, no
mention, node or feature becomes a row of its own.  Nodes and edges with equal
statistics have equal features, which are made once for all of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import decode as d
from . import features

#: Documents that a Python worker holds at a time: texts can be long.
BATCH_ROWS = 512


@dataclass
class Mentions:
    """Of a document: the body's concepts in the order of their numbers, with freq, least and summed depth; which are roots; how often each
    (c1, c2) has each relation; concepts and pairs of the summary."""

    nodes: dict[str, tuple[int, int, int]]
    roots: set[str]
    edges: dict[str, dict[tuple[str, str], int]]
    concepts: set[str]
    pairs: set[tuple[str, str]]


@dataclass
class Graph:
    """Nodes by number and edges by their ends' numbers, each with its statistics; which are roots, which are selected; the summary's numbers of both."""

    nodes: dict[int, tuple[int, int, float]]
    edges: dict[tuple[int, int], tuple[tuple[int, str], ...]]
    roots: set[int]
    selected_nodes: set[int]
    selected_edges: set[tuple[int, int]]
    gold: tuple[int, int]


def graph(m: Mentions) -> Graph | None:
    """None for a document without a summary or a body.

    A node's statistics are (freq, min_depth, avg_depth), an edge's its relations as
    (-count, relation), the most frequent first.
    """
    if not m.concepts or not m.nodes:
        return None
    ids = dict(zip(m.nodes, range(1, len(m.nodes) + 1)))
    nodes = {i: (n, least, depths / n) for i, (n, least, depths) in enumerate(m.nodes.values(), 1)}
    edges: dict[tuple[int, int], tuple] = {}
    for relation in sorted(m.edges):
        for (a, b), k in m.edges[relation].items():
            e = ids[a], ids[b]
            had = edges.get(e)
            edges[e] = ((-k, relation),) if had is None else tuple(sorted((*had, (-k, relation))))
    pairs = {(ids[a], ids[b]) for a, b in m.pairs if a in ids and b in ids}
    return Graph(nodes, edges, {ids[c] for c in m.roots}, {ids[c] for c in m.concepts if c in ids}, pairs & edges.keys(), (len(m.concepts), len(m.pairs)))


def node_pairs(stats: tuple[int, int, float]) -> list[tuple[str, float]]:
    """The templates bias, freq and depth of ``features``."""
    freq, least, mean = stats
    flag = lambda name, b, met: (f"n {name} {b}", 1.0 if met else 0.0)
    return (
        [("n bias", 1.0)] + [flag("freq", b, freq >= b if b else freq == 0) for b in features.FREQ]
        + [flag("dep fmst", b, least >= b) for b in features.DEPTHS] + [flag("dep avg", b, mean >= b) for b in features.DEPTHS]
    )


def edge_pairs(ranks: tuple[tuple[int, str], ...]) -> list[tuple[str, float]]:
    """The templates bias and relation of ``features``."""
    total = -sum(k for k, _ in ranks)
    out = [("e bias", 1.0)]
    for name, (k, relation), shares in zip(("fst", "sec"), ranks, (features.FIRST_SHARES, features.SECOND_SHARES)):
        out.append((f"e rel {name} {relation}", 1.0))
        out += [(f"e rel {name} {relation} p{i}", 1.0 if -k / total >= t else 0.0) for i, t in enumerate(shares, 1)]
    if len(ranks) > 1:
        out.append((f"e rel fst {ranks[0][1]} sec {ranks[1][1]}", 1.0))
    return out


class _Scores(dict):
    """Scores of tag 1 less those of tag 0, by statistics."""

    def __init__(self, pairs: Callable, weights: dict[str, float]):
        super().__init__()
        self.pairs, self.table = pairs, {}
        for k, v in weights.items():
            self.table[k[2:]] = self.table.get(k[2:], 0.0) + (float(v) if k[0] == "1" else -float(v))

    def __missing__(self, stats) -> float:
        s = self[stats] = sum(v * self.table.get(f, 0.0) for f, v in self.pairs(stats))
        return s


@dataclass
class Texts:
    """``rows(doc, parts)``, a row for each document, and what reads a document's mentions from its parts."""

    rows: DataFrame
    mentions: Callable[[list], Mentions]

    def ids(self) -> DataFrame:
        return self.rows.select("doc")

    def only(self, doc) -> "Texts":
        return Texts(self.rows.where(F.col("doc") == doc), self.mentions)

    def _run(self, each: Callable[[Iterator[tuple[str, Graph]]], Iterator], schema: str) -> DataFrame:
        spark, mentions = self.rows.sparkSession, self.mentions
        ship(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

        def run(batches):
            def graphs():
                for batch in batches:
                    for doc, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        g = graph(mentions(parts))
                        if g is not None:
                            yield doc, g

            yield from each(graphs())

        return self.rows.select(F.col("doc").cast("string").alias("doc"), "parts").mapInArrow(run, schema)

    def decode(self, weights: dict[str, float], length: str = "nolen", limit: int = 200_000) -> DataFrame:
        """``decode.decode`` of the documents' gains under ``weights``."""
        if length not in ("nolen", "nodes", "edges"):
            raise ValueError(f"unknown length {length!r}")
        solve = _solver(weights, length, limit)

        def each(graphs):
            import pyarrow as pa

            kinds = pa.schema([
                ("doc", pa.string()), ("status", pa.string()), ("objective", pa.float64()), ("optimal", pa.bool_()), ("nodes", pa.list_(pa.int32())),
                ("edges", pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32())]))),
            ])
            held = []
            for doc, g in graphs:
                s = solve(g, 0.0)
                held.append({
                    "doc": doc, "status": "ok" if s.found else "infeasible", "objective": s.objective if s.found else None, "optimal": s.optimal,
                    "nodes": s.nodes, "edges": [{"src": a, "dst": b} for a, b in s.edges],
                })
                if len(held) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=kinds)
                    held = []
            yield pa.RecordBatch.from_pylist(held, schema=kinds)

        return self._run(each, d.RESULT)

    def difference(self, weights: dict[str, float], plus: float, minus: float | None, length: str = "nolen", limit: int = 200_000) -> dict[str, float]:
        """Features of the choice at cost ``plus`` less those of the one at ``minus`` (None: the labels), summed by tagged key."""
        solve = _solver(weights, length, limit)

        def each(graphs):
            import pyarrow as pa

            nodes, edges = Counter(), Counter()
            for _, g in graphs:
                for sign, cost in ((1, plus), (-1, minus)):
                    if cost is None:
                        n, e = g.selected_nodes, g.selected_edges
                    else:
                        s = solve(g, cost)
                        n, e = s.nodes, s.edges
                    for v in n:
                        nodes[g.nodes[v]] += sign
                    for v in e:
                        edges[g.edges[v]] += sign
            sums: Counter = Counter()
            for counts, pairs in ((nodes, node_pairs), (edges, edge_pairs)):
                for stats, c in counts.items():
                    if c:
                        for f, v in pairs(stats):
                            sums[f] += c * v
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([float(x) for x in sums.values()], pa.float64())], names=["feat", "v"])

        out: dict[str, float] = {}
        for r in self._run(each, "feat string, v double").groupBy("feat").agg(F.sum("v").alias("v")).where(F.col("v") != 0).collect():
            out["1 " + r["feat"]], out["0 " + r["feat"]] = r["v"], -r["v"]
        return out


def expanded_counts(sentences: list[list[list[str]]]) -> tuple[int, int, int]:
    """Of a document: rows, summed n_sources and n_true of ``docgraph.merge_expanded`` of its ``docgraph.expand_edges``.

    A sentence is a list of runs of concepts, each of which has an edge to the next of its run.
    Of the pairs only numbers are made: a concept's partners are the union of its
    sentences, which are numbers with a bit for each concept.
    """
    bits: dict[str, int] = {}
    places: dict[str, list[int]] = {}
    masks, sizes, sources, true = [], [], 0, 0
    for runs in sentences:
        k = Counter(chain.from_iterable(runs)) if len(runs) > 1 else Counter(runs[0])
        for w in k:
            if w not in bits:
                bits[w] = 1 << len(bits)
                places[w] = []
            places[w].append(len(masks))
        masks.append(reduce(or_, map(bits.__getitem__, k), 0))
        sizes.append(len(k))
        n = sum(map(len, runs))
        sources += n * n
        if len(k) == n and len(runs) == 1:
            true += max(n - 1, 0)
        else:
            true += sum(k[a] * k[b] for a, b in set(chain.from_iterable(zip(t, t[1:]) for t in runs)))
    anchors = sum(sizes[at[0]] if len(at) == 1 else reduce(or_, map(masks.__getitem__, at)).bit_count() for at in places.values())
    return anchors, sources, true


def edge_kinds(sentences: list[list[list[str]]], relations: tuple[str, ...]) -> tuple[int, Counter]:
    """Of a document: how many concepts differ, and how many different edges have each (first, second) relation as ``features.relation_ranks`` has them.

    The relations of a run's edges are ``relations`` by turns.
    """
    concepts = set(chain.from_iterable(chain.from_iterable(sentences)))
    turns = len(relations)
    of = {r: Counter() for r in relations}
    for runs in sentences:
        for t in runs:
            for i, r in enumerate(relations):
                of[r].update(zip(t[i::turns], t[i + 1 :: turns]))
    kinds: Counter = Counter()
    more = [e for e, n in Counter(chain.from_iterable(of.values())).items() if n > 1] if turns > 1 else []
    for e in more:
        first, second, *_ = sorted((-c[e], r) for r, c in of.items() if e in c)
        kinds[first[1], second[1]] += 1
        for c in of.values():
            c.pop(e, None)
    kinds.update({(r, None): len(c) for r, c in of.items() if c})
    return len(concepts), kinds


def each_text(rows: DataFrame, sentences: Callable[[list], list[list[list[str]]]], count: Callable[..., tuple | None], names: list[str]) -> DataFrame:
    """``(doc, *names)``: the whole numbers that ``count`` has of the sentences of each of ``rows(doc, parts)``; None leaves a document out."""
    import pyarrow as pa

    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        for batch in batches:
            found = [count(doc, sentences(parts)) for doc, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            held = batch.column(0).filter(pa.array([x is not None for x in found], pa.bool_()))
            sums = [pa.array([x[i] for x in found if x is not None], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([held, *sums], names=["doc", *names])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select("doc", "parts").mapInArrow(run, ", ".join([f"doc {kind}", *[f"{n} long" for n in names]]))


def _solver(weights: dict[str, float], length: str, limit: int) -> Callable[[Graph, float], d.Solution]:
    """The best forest of a graph with ``cost`` for every wrong tag added to its gains."""
    held: list[_Scores] = []

    def solve(g: Graph, cost: float) -> d.Solution:
        if not held:
            held.extend((_Scores(node_pairs, weights), _Scores(edge_pairs, weights)))
        n, e = held
        gains = {v: n[s] + (-cost if v in g.selected_nodes else cost) for v, s in g.nodes.items()}
        pairs = {v: e[s] + (-cost if v in g.selected_edges else cost) for v, s in g.edges.items()}
        # The gold numbers of nodes and of edges are those of the summary.
        return d.solve(gains, g.roots, pairs, g.gold[0] if length == "nodes" else None, g.gold[1] if length == "edges" else None, limit)

    return solve
