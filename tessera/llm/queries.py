"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embdedup, htmltext, langid, mixlm, packing, revisit, simhash, toxicity, urlfilter
from .common import remainder, table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, usable=remainder("doc_id", 4) != 2)
    found = langid.predict(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op4_mixlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    usable = remainder("doc_id", 5) != 1
    model, counts = mixlm.train(docs, usable=usable)
    found = mixlm.scores(docs, model, counts, trained=usable)
    return found.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), *found.columns[1:])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve(revisit.captures_of(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", revisit.header_lines(F.col("headers")))


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, usable=remainder("doc_id", 3) != 1)
    found = toxicity.scores(docs, model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), k=3, max_bits=3)


def op10_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.vector_components(table(spark, sf_dir, "embeddings"), least=0.95)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_embdedup": op10_embdedup,
        "op1_langid": op1_langid,
        "op2_decontam": op2_decontam,
        "op3_html": op3_html,
        "op4_mixlm": op4_mixlm,
        "op5_packing": op5_packing,
        "op6_revisit": op6_revisit,
        "op7_urlfilter": op7_urlfilter,
        "op8_toxicity": op8_toxicity,
        "op9_simhash": op9_simhash,
    }
