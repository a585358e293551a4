"""The best forest of a document's graph: exact branch and bound, one document per group.

A forest of free size is bounded by the best spanning arborescence (Edmonds) in
which a node may also be left out while others hang below it; one of fixed size by
the open nodes' best possible gains.

Feasible are non-empty forests of directed trees whose roots are root concepts:
every chosen node is a root of its tree or has exactly one chosen edge into it.
The objective is the gain of the chosen nodes and edges over the empty choice.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

EPS = 1e-12


@dataclass
class Solution:
    nodes: list[int] = field(default_factory=list)
    edges: list[tuple[int, int]] = field(default_factory=list)
    objective: float = float("-inf")
    optimal: bool = True

    @property
    def found(self) -> bool:
        return self.objective > float("-inf")


def solve(gains: dict[int, float], roots: set[int], edges: dict[tuple[int, int], float], n_nodes: int | None = None, n_edges: int | None = None, limit: int = 200_000) -> Solution:
    """Best forest; ``n_nodes`` or ``n_edges`` fixes its size (0 or None: free, see ``solve_free``).

    Of a fixed size: depth-first over the nodes, each left out, made a root or hung below a parent
    that is chosen or still open; the bound adds each open node's best possible
    gain, or the best of as many as may still be chosen.  After ``limit`` steps the
    best forest so far is returned, marked as not optimal.
    """
    cheap: dict[int, list[tuple[float, int]]] = {v: [] for v in gains}
    for (a, b), w in edges.items():
        if a != b and a in gains and b in gains:
            cheap[b].append((-w, a))
    for ways in cheap.values():
        if len(ways) > 1:
            ways.sort()
    if not n_nodes and not n_edges:
        return solve_free(gains, roots, cheap, edges, limit)
    into = {v: [(-w, a) for w, a in ways] for v, ways in cheap.items()}
    top = {v: gains[v] + max([w for w, _ in into[v][:1]] + ([0.0] if v in roots else []), default=float("-inf")) for v in gains}
    order = sorted((v for v in gains if top[v] > float("-inf")), key=lambda v: (-top[v], v))
    wanted_nodes, wanted_edges = n_nodes or None, n_edges or None
    best = Solution()
    chosen: dict[int, int | None] = {}
    out: set[int] = set()
    steps = 0

    def above(v: int, parent: int) -> bool:
        """Whether ``v`` is an ancestor of ``parent``, which would close a cycle."""
        while parent is not None:
            if parent == v:
                return True
            parent = chosen.get(parent)
        return False

    def bound(i: int, value: float, k: int, e: int) -> float:
        rest = [top[v] for v in order[i:]]
        if wanted_nodes is not None:
            left = wanted_nodes - k
            return value + sum(rest[:left]) if 0 <= left <= len(rest) else float("-inf")
        positive = sum(x for x in rest if x > 0)
        if wanted_edges is not None:
            left = wanted_edges - e
            if left < 0 or left > len(rest):
                return float("-inf")
            return value + max(positive, sum(rest[:left]))
        return value + (positive if k or positive > 0 else max(rest, default=float("-inf")))

    def walk(i: int, value: float, e: int) -> None:
        nonlocal best, steps
        steps += 1
        if steps > limit or bound(i, value, len(chosen), e) <= best.objective + EPS:
            return
        if i == len(order):
            whole = all(p is None or p in chosen for p in chosen.values())
            if chosen and whole and wanted_nodes in (None, len(chosen)) and wanted_edges in (None, e):
                pairs = sorted((p, v) for v, p in chosen.items() if p is not None)
                best = Solution(sorted(chosen), pairs, value)
            return
        v = order[i]
        ways = [(w, p) for w, p in into[v] if p not in out and not above(v, p)]
        if v in roots:
            ways.append((0.0, None))
        for w, p in sorted(ways, key=lambda x: (-x[0], -1 if x[1] is None else x[1])):
            chosen[v] = p
            walk(i + 1, value + gains[v] + w, e + (p is not None))
            del chosen[v]
        if not any(p == v for p in chosen.values()):
            out.add(v)
            walk(i + 1, value, e)
            out.discard(v)

    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * len(order) + 1000))
    walk(0, 0.0, 0)
    if steps > limit:
        best.optimal = False
    return best


class _Groups:
    """Union-find that can be taken back."""

    def __init__(self, n: int):
        self.up, self.log = [-1] * n, []

    def find(self, x: int) -> int:
        while self.up[x] >= 0:
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.up[a] > self.up[b]:
            a, b = b, a
        self.log.append((a, self.up[a], b, self.up[b]))
        self.up[a] += self.up[b]
        self.up[b] = a
        return True

    def back(self, size: int) -> None:
        while len(self.log) > size:
            a, x, b, y = self.log.pop()
            self.up[a], self.up[b] = x, y


def arborescence(arcs: list[list[tuple[float, int, int, int]]]) -> list[int]:
    """For each node its way in, of the cheapest spanning arborescence from node 0.

    ``arcs[v]``: (cost, rank, from, v), the rank unique among the node's arcs and
    returned for it; every node is reached from 0.
    """
    n = len(arcs)
    heaps, shift = [list(a) for a in arcs], [0.0] * n
    for h in heaps:
        heapq.heapify(h)
    groups, seen = _Groups(n), [-1] * n
    seen[0] = 0
    into: list = [None] * n
    cycles = []
    for s in range(1, n):
        u, path, ways = groups.find(s), [], []
        while seen[u] < 0:
            way = heapq.heappop(heaps[u])
            shift[u] = -way[0]
            path.append(u), ways.append(way)
            seen[u] = s
            u = groups.find(way[2])
            if seen[u] == s:
                merged, add, time, end = [], 0.0, len(groups.log), len(path)
                while True:
                    w = path.pop()
                    small, low = heaps[w], shift[w]
                    if len(small) > len(merged):
                        merged, add, small, low = small, low, merged, add
                    for c, *rest in small:
                        heapq.heappush(merged, (c + low - add, *rest))
                    if not groups.join(u, w):
                        break
                u = groups.find(u)
                heaps[u], shift[u], seen[u] = merged, add, -1
                # Costs as they are now, so the next pop compares and shifts alike.
                if add:
                    heaps[u] = [(c + add, *rest) for c, *rest in merged]
                    heapq.heapify(heaps[u])
                    shift[u] = 0.0
                cycles.append((u, time, ways[len(path) : end]))
                del ways[len(path) :]
        for way in ways:
            into[groups.find(way[3])] = way
    for u, time, ways in reversed(cycles):
        own = into[u]
        groups.back(time)
        for way in ways:
            into[groups.find(way[3])] = way
        into[groups.find(own[3])] = own
    return [way and way[1] for way in into]


def solve_free(gains: dict[int, float], roots: set[int], into: dict[int, list[tuple[float, int]]], weight: dict[tuple[int, int], float], limit: int) -> Solution:
    """Best forest of any size, to within 1e-11 a node; ``into`` has (-weight, parent) in order.

    A relaxation counts as many steps as it has nodes.  If it leaves out a node that
    others hang below, that node is taken in or out for good and both are tried.
    """
    below: dict[int, list[int]] = {v: [] for v in gains}
    for v, ways in into.items():
        for _, p in ways:
            below[p].append(v)
    roots = {v for v in roots if v in gains}
    if not roots:
        return Solution()
    first = max(sorted(roots), key=lambda v: gains[v])
    best = Solution([first], [], gains[first])

    def reached(out: frozenset) -> set[int]:
        found = set(roots - out)
        todo = list(found)
        while todo:
            for v in below[todo.pop()]:
                if v not in found and v not in out:
                    found.add(v)
                    todo.append(v)
        return found

    TOP, OUT = min(gains) - 1, max(gains) + 1

    def relaxed(alive: set[int], forced: frozenset) -> dict[int, int | None]:
        """Parents of the nodes that aren't left out; the roots' is None.

        A node takes its cheapest way in; of equal ones being a root, then the first
        parent, then being left out.  A way that leads to the top stands; what is caught
        in a cycle or hangs below one is left to ``arborescence``, all else being the top.
        """
        names = sorted(alive)
        pick = {}
        for v in names:
            own = -gains[v]
            least, way = (own, TOP) if v in roots else (float("inf"), OUT)
            for w, p in into[v]:
                if p in alive:
                    if own + w < least:
                        least, way = own + w, p
                    break
            pick[v] = OUT if least > 1e-11 and v not in forced else way
        state = {TOP: 1, OUT: 1}  # 1: leads to the top, 2: is caught, 0: on the way
        for v in names:
            path = []
            while v not in state:
                state[v] = 0
                path.append(v)
                v = pick[v]
            end = state[v] or 2
            for x in path:
                state[x] = end
        caught = [v for v in names if state[v] == 2]
        if caught:
            number = {v: i for i, v in enumerate(caught, 1)}
            arcs: list[list[tuple[float, int, int, int]]] = [[]]
            for i, v in enumerate(caught, 1):
                own, inner = -gains[v], []
                outer = [(own, TOP, 0, i)] if v in roots else []
                if v not in forced:
                    outer.append((1e-11, OUT, 0, i))
                for w, p in into[v]:
                    if p in number:
                        inner.append((own + w, p, number[p], i))
                    elif p in alive:
                        outer.append((own + w, p, 0, i))
                if outer:
                    inner.append(min(outer))
                arcs.append(inner)
            ways = arborescence(arcs)
            for i, v in enumerate(caught, 1):
                pick[v] = ways[i]
        return {v: None if p == TOP else p for v, p in pick.items() if p != OUT}

    def worth(parents: dict[int, int | None]) -> float:
        return sum(gains[v] + (0.0 if p is None else weight[p, v]) for v, p in parents.items())

    def keep(parents: dict[int, int | None]) -> None:
        nonlocal best
        value = worth(parents)
        if parents and value > best.objective + EPS:
            best = Solution(sorted(parents), sorted((p, v) for v, p in parents.items() if p is not None), value)

    def hanging(parents: dict[int, int | None]) -> list[int]:
        return sorted({p for p in parents.values() if p is not None and p not in parents})

    def grounded(parents: dict[int, int | None]) -> dict[int, int | None]:
        """Without what hangs below nodes that are left out."""
        under: dict[int | None, list[int]] = {}
        for v, p in parents.items():
            under.setdefault(p, []).append(v)
        todo = list(under.get(None, ()))
        kept = set(todo)
        while todo:
            for v in under.get(todo.pop(), ()):
                kept.add(v)
                todo.append(v)
        return {v: parents[v] for v in parents if v in kept}

    # A first forest: all that is hung upon is taken in.
    alive = everything = reached(frozenset())
    forced, steps = frozenset(), 0
    plain = relaxed(alive, forced)
    while steps <= limit:
        steps += len(alive)
        parents = relaxed(alive, forced) if forced else plain
        lost = hanging(parents)
        keep(grounded(parents) if lost else parents)
        if not lost:
            break
        forced |= frozenset(lost)
    todo = [(frozenset(), frozenset())]
    while todo:
        forced, out = todo.pop()
        alive = reached(out) if out else everything
        if not forced <= alive:
            continue
        steps += len(alive)
        if steps > limit:
            best.optimal = False
            break
        parents = relaxed(alive, forced) if forced or out else plain
        if worth(parents) <= best.objective + 1e-11 * len(alive):
            continue
        if not parents:
            # The empty choice is no forest: one of the roots must be in.
            todo += [(frozenset([v]), out) for v in sorted(roots & alive, key=lambda v: (gains[v], -v))]
            continue
        lost = hanging(parents)
        keep(grounded(parents) if lost else parents)
        if lost:
            v = max(lost, key=lambda p: (sum(q == p for q in parents.values()), -p))
            todo += [(forced, out | {v}), (forced | {v}, out)]
    return best


def augmented(gain, selected, cost):
    """A gain with the cost of a wrong choice added: of choosing what isn't selected, and of leaving what is."""
    return gain + F.when(selected, -F.lit(float(cost))).otherwise(F.lit(float(cost)))


def positive_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc, n_nodes, n_edges)``: nodes and edges of ``decode``'s input whose gain is above 0."""
    n = nodes.select("doc", F.col("gain").alias("n"), F.lit(None).cast("double").alias("e"))
    e = edges.select("doc", F.lit(None).cast("double").alias("n"), F.col("gain").alias("e"))
    return n.unionByName(e).groupBy("doc").agg(F.count_if(F.col("n") > 0).alias("n_nodes"), F.count_if(F.col("e") > 0).alias("n_edges"))


def report_lines(solutions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc, part, ord, value)``: lines that tell of each document's decoding, in order of part and ord.

    Part 0 is the objective and whether it is proven best, 1 the gain of every node,
    2 of every edge, 3 the chosen nodes, 4 the chosen edges.
    """
    at = lambda part, ord, value: ("doc", F.lit(part).alias("part"), ord.cast("string").alias("ord"), value.alias("value"))
    by_text = F.col("doc").cast("string").alias("doc")
    place = F.format_string("%010d", F.col("node_id"))
    ends = F.format_string("%010d %010d", F.col("src"), F.col("dst"))
    head = solutions.select(*at(0, F.lit(""), F.format_string("[ObjVal]: %f [optimal]: %s", F.col("objective"), F.col("optimal").cast("string"))))
    n = nodes.withColumn("doc", by_text).select(*at(1, place, F.format_string("%d\t%f", F.col("node_id"), F.col("gain").cast("double"))))
    e = edges.withColumn("doc", by_text).select(*at(2, ends, F.format_string("%d %d\t%f", F.col("src"), F.col("dst"), F.col("gain").cast("double"))))
    chosen_n = solutions.select("doc", F.explode("nodes").alias("node_id")).select(*at(3, place, F.format_string("node %d", F.col("node_id"))))
    chosen_e = solutions.select("doc", F.explode("edges").alias("x")).select("doc", "x.*").select(*at(4, ends, F.format_string("edge %d %d", F.col("src"), F.col("dst"))))
    return head.unionByName(n).unionByName(e).unionByName(chosen_n).unionByName(chosen_e)


RESULT = "doc string, status string, objective double, optimal boolean, nodes array<int>, edges array<struct<src:int,dst:int>>"


def decode(nodes: DataFrame, edges: DataFrame, gold: DataFrame | None = None, length: str = "nolen", limit: int = 200_000) -> DataFrame:
    """A row for every document: the best forest of ``nodes(doc, node_id, is_root, gain)`` and ``edges(doc, src, dst, gain)``.

    ``length``: ``nolen``, or ``nodes`` or ``edges`` for the numbers in
    ``gold(doc, num_nodes, num_edges)``; a number of 0 constrains nothing.  Status
    is ``ok``, or ``infeasible`` where no forest has the wanted size.
    """
    if length not in ("nolen", "nodes", "edges"):
        raise ValueError(f"unknown length {length!r}")
    ship(nodes.sparkSession)
    n = nodes.groupBy("doc").agg(F.collect_list(F.struct(F.col("node_id").cast("int").alias("id"), "is_root", F.col("gain").cast("double").alias("gain"))).alias("ns"))
    e = edges.groupBy("doc").agg(F.collect_list(F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("gain").cast("double").alias("gain"))).alias("es"))
    rows = n.join(e, "doc", "left")
    size = F.lit(0)
    if length != "nolen":
        rows = rows.join(gold.select("doc", F.col("num_nodes" if length == "nodes" else "num_edges").cast("int").alias("want")), "doc", "left")
        size = F.coalesce("want", F.lit(0))
    rows = rows.select(F.col("doc").cast("string").alias("doc"), "ns", "es", size.alias("want"))

    def run(batches):
        for pdf in batches:
            out = []
            for doc, ns, es, want in zip(pdf["doc"], pdf["ns"], pdf["es"], pdf["want"]):
                gains = {x["id"]: x["gain"] for x in ns}
                roots = {x["id"] for x in ns if x["is_root"]}
                pairs = {(x["src"], x["dst"]): x["gain"] for x in (es if es is not None else [])}
                s = solve(gains, roots, pairs, want if length == "nodes" else None, want if length == "edges" else None, limit)
                out.append((doc, "ok" if s.found else "infeasible", s.objective if s.found else None, s.optimal, s.nodes, [{"src": a, "dst": b} for a, b in s.edges]))
            yield pd.DataFrame(out, columns=["doc", "status", "objective", "optimal", "nodes", "edges"])

    return rows.mapInPandas(run, RESULT)
