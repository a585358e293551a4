"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``links(a, b)`` with the least node that it reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every
    round is two aggregates and two joins on the link table, which stays no
    longer than the number of links.  A round's table is written to the shared
    folder, so the plan doesn't grow and a lost executor costs one round.

    Returns ``(node, component)``, a row for every node in a link.  Self links,
    repeated links and both directions are allowed; rows with a null end are
    left out.  No links give no rows.
    """
    edges = (
        links.select("a", "b")
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    edges = settle(edges)
    n, total = _sign(edges)
    for _ in range(max_rounds):
        if not n:
            break
        new = settle(_small_star(_large_star(edges)))
        discard(edges)
        edges, (m, t) = new, _sign(new)
        if (m, t) == (n, total):
            break
        n, total = m, t
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("t")).first()
    return row["n"], row["t"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to the least of its neighbours and itself.

    ``edges`` has a > b.  The greater neighbours of b are the a of its rows.
    """
    least = (
        edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(edges.select(F.col("b").alias("u"), F.col("b").alias("v")))
        .groupBy("u")
        .agg(F.min("v").alias("m"))
    )
    return edges.join(least, edges["b"] == least["u"]).select("a", F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved).distinct()
