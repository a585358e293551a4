"""Block files as a stream: each new file's sentences, parsed on arrival.

Parsing keeps no state.  Merging a document needs all of its sentences, so a
document must lie in one file; then ``write_graphs`` may merge per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.docgraph import merge_edges, merge_nodes
from ..sources.blocks import blocks_of, mentions_of, records_of, sentences_of


def stream_sentences(spark: SparkSession, path: str) -> DataFrame:
    """A streaming table of ``sentences_of`` the files that appear below ``path``."""
    files = spark.readStream.format("text").option("wholetext", "true").schema("value string").load(path)
    files = files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    return sentences_of(records_of(blocks_of(files)))


def write_graphs(sentences: DataFrame, folder: str, checkpoint: str, after: Callable[[], None] | None = None):
    """Start a query that merges each micro-batch's documents and appends nodes and edges below ``folder``.

    Handles what is there and stops.  A batch that is run again overwrites its own
    rows, which its number parts from the others.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        nodes, edges = mentions_of(batch)
        merge_nodes(nodes).write.mode("overwrite").parquet(f"{folder}/nodes/batch={number}")
        merge_edges(edges).write.mode("overwrite").parquet(f"{folder}/edges/batch={number}")
        batch.unpersist()
        if after:
            after()

    return sentences.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
