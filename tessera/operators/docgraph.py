"""Concept graphs of documents: merging, expansion, labels, numbers.

Node mentions: doc, line_num, ord, concept and whatever describes the mention.
Edge mentions: doc, line_num, ord, c1, c2, relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NULL = "NULL"


def merge_nodes(nodes: DataFrame, sources: bool = True) -> DataFrame:
    """A row for each (doc, concept): first line and ord, is_root, number of mentions and, if asked for, the mentions in order.

    A concept is a root if it is the first node of some sentence.
    """
    facts = [
        F.min(F.struct("line_num", "ord")).alias("first"), F.max(F.col("ord") == 0).alias("is_root"), F.count("*").alias("n_sources"),
    ]
    if sources:
        rest = [c for c in nodes.columns if c not in ("doc", "concept", "line_num", "ord")]
        facts.append(F.array_sort(F.collect_list(F.struct("line_num", "ord", *rest))).alias("sources"))
    out = nodes.groupBy("doc", "concept").agg(*facts)
    return out.select("doc", "concept", F.col("first.line_num").alias("first_line"), F.col("first.ord").alias("first_ord"), *[c for c in out.columns if c not in ("doc", "concept", "first")])


def merge_edges(edges: DataFrame, sources: bool = True) -> DataFrame:
    """A row for each (doc, c1, c2), whatever the relation: the first relation, number of mentions and the mentions in order."""
    facts = [F.min_by("relation", F.struct("line_num", "ord")).alias("relation"), F.count("*").alias("n_sources")]
    if sources:
        facts.append(F.array_sort(F.collect_list(F.struct("line_num", "ord", "relation"))).alias("sources"))
    return edges.groupBy("doc", "c1", "c2").agg(*facts)


def expand_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(doc, line_num, c1, c2, relation, n)``: all ordered pairs of a sentence's nodes, itself included.

    ``n`` is how many node pairs have these concepts.  The relation is that of the
    sentence's last edge from c1 to c2, else ``NULL``.  Sentences are reduced to
    their distinct concepts first, so a repeated word doesn't multiply rows.
    """
    counts = nodes.groupBy("doc", "line_num", "concept").agg(F.count("*").alias("k"))
    a = counts.select("doc", "line_num", F.col("concept").alias("c1"), F.col("k").alias("k1"))
    b = counts.select("doc", "line_num", F.col("concept").alias("c2"), F.col("k").alias("k2"))
    last = edges.groupBy("doc", "line_num", "c1", "c2").agg(F.max_by("relation", "ord").alias("relation"))
    pairs = a.join(b, ["doc", "line_num"])
    return pairs.join(last, ["doc", "line_num", "c1", "c2"], "left").select(
        "doc", "line_num", "c1", "c2", F.coalesce("relation", F.lit(NULL)).alias("relation"), (F.col("k1") * F.col("k2")).alias("n")
    )


def merge_expanded(expanded: DataFrame) -> DataFrame:
    """Expanded edges by (doc, c1, c2): number of mentions, and of those with a relation."""
    true = F.when(F.col("relation") != NULL, F.col("n")).otherwise(0)
    return expanded.groupBy("doc", "c1", "c2").agg(F.sum("n").alias("n_sources"), F.sum(true).alias("n_true"))


def with_summary_only(body: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of documents that have a summary, and the ids of those that have none."""
    known = summary.select("doc").distinct()
    return body.join(known, "doc", "left_semi"), body.select("doc").distinct().join(known, "doc", "left_anti")


def label_nodes(nodes: DataFrame, summary_nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``is_selected``: the concept stands in the document's summary."""
    marks = summary_nodes.select("doc", "concept").distinct().withColumn("__s", F.lit(True))
    return nodes.join(marks, ["doc", "concept"], "left").withColumn("is_selected", F.col("__s").isNotNull()).drop("__s")


def label_edges(edges: DataFrame, summary_edges: DataFrame) -> DataFrame:
    """``edges`` with ``is_selected``: the directed pair stands in the document's summary."""
    marks = summary_edges.select("doc", "c1", "c2").distinct().withColumn("__s", F.lit(True))
    return edges.join(marks, ["doc", "c1", "c2"], "left").withColumn("is_selected", F.col("__s").isNotNull()).drop("__s")


def number_nodes(merged: DataFrame) -> DataFrame:
    """``merged`` with ``node_id`` from 1 in each document, by first line and place."""
    order = Window.partitionBy("doc").orderBy("first_line", "first_ord", "concept")
    return merged.withColumn("node_id", F.row_number().over(order))


def gold_counts(summary_nodes: DataFrame, summary_edges: DataFrame) -> DataFrame:
    """``(doc, num_nodes, num_edges)``: distinct concepts and directed pairs of each summary."""
    n = summary_nodes.groupBy("doc").agg(F.countDistinct("concept").alias("num_nodes"))
    e = summary_edges.groupBy("doc").agg(F.countDistinct("c1", "c2").alias("num_edges"))
    return n.join(e, "doc", "left").select("doc", "num_nodes", F.coalesce("num_edges", F.lit(0)).alias("num_edges"))


def last_run(mentions: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Of a document whose sentences aren't contiguous in a file, only the last run: gaps and islands.

    Needs file and the block's ordinal in it.
    """
    in_file, in_doc = Window.partitionBy("file").orderBy(ordinal), Window.partitionBy("file", "doc").orderBy(ordinal)
    runs = mentions.withColumn("__run", F.dense_rank().over(in_file) - F.dense_rank().over(in_doc))
    last = runs.groupBy("file", "doc").agg(F.max_by("__run", ordinal).alias("__last"))
    return runs.join(last, ["file", "doc"]).where(F.col("__run") == F.col("__last")).drop("__run", "__last")


def instance(body_nodes, body_edges, summary_nodes, summary_edges, expanded: bool = False):
    """Labelled nodes (numbered), labelled edges and gold counts of documents that have a summary."""
    body_nodes, missing = with_summary_only(body_nodes, summary_nodes)
    nodes = number_nodes(label_nodes(merge_nodes(body_nodes), summary_nodes))
    if expanded:
        edges = merge_expanded(expand_edges(body_nodes, body_edges))
    else:
        edges = merge_edges(body_edges)
    edges = label_edges(edges.join(summary_nodes.select("doc").distinct(), "doc", "left_semi"), summary_edges)
    ids = nodes.select("doc", "concept", "node_id")
    edges = edges.join(ids.withColumnsRenamed({"concept": "c1", "node_id": "src"}), ["doc", "c1"]).join(
        ids.withColumnsRenamed({"concept": "c2", "node_id": "dst"}), ["doc", "c2"]
    )
    return nodes, edges, gold_counts(summary_nodes, summary_edges), missing
