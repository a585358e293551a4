"""Sparse vectors: long form (id, feat, val) for joins, maps for work within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """``(id, score)``: the product of each of ``vectors(id, feat, val)`` with ``weights(feat, weight)``; 0 without a shared key."""
    joined = vectors.join(weights, "feat", "left")
    return joined.groupBy("id").agg(F.sum(F.col("val") * F.coalesce("weight", F.lit(0.0))).alias("score"))


def add(*vectors: DataFrame) -> DataFrame:
    """Sum of vectors in long form, by id and key."""
    out = vectors[0]
    for v in vectors[1:]:
        out = out.unionByName(v)
    return out.groupBy("id", "feat").agg(F.sum("val").alias("val"))


def scale(vectors: DataFrame, factor: float) -> DataFrame:
    return vectors.withColumn("val", F.col("val") * float(factor))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, scale(b, -1.0))


def project(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """``vectors`` on the keys of ``keys(feat)``: missing ones are 0."""
    wanted = vectors.select("id").distinct().join(keys.select("feat").distinct(), how="cross")
    return wanted.join(vectors, ["id", "feat"], "left").select("id", "feat", F.coalesce("val", F.lit(0.0)).alias("val"))


def squared_norm(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("id").agg(F.sum(F.col("val") * F.col("val")).alias("sq_norm"))


def mean_weights(passes: DataFrame) -> DataFrame:
    """``(feat, weight)``: mean over passes of ``passes(pass, feat, weight)``; a key missing in a pass counts as 0 there."""
    n = passes.agg(F.countDistinct("pass").alias("n"))
    total = passes.groupBy("feat").agg(F.sum("weight").alias("s"))
    return total.join(F.broadcast(n), how="cross").select("feat", (F.col("s") / F.col("n")).alias("weight"))


def map_dot(a: Column, b: Column) -> Column:
    """The product of two map columns."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at(b, e["key"]), F.lit(0.0)))


def map_add(a: Column, b: Column, factor: float = 1.0) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.lit(float(factor)) * F.coalesce(y, F.lit(0.0)))


def map_scale(a: Column, factor: float) -> Column:
    return F.transform_values(a, lambda _, v: v * float(factor))


def map_project(a: Column, keys: Column) -> Column:
    """``a`` on the keys of the map ``keys``: missing ones are 0."""
    return F.map_from_entries(F.transform(F.map_keys(keys), lambda k: F.struct(k, F.coalesce(F.element_at(a, k), F.lit(0.0)))))


def map_squared_norm(a: Column) -> Column:
    return F.aggregate(F.map_values(a), F.lit(0.0), lambda s, v: s + v * v)


def map_text(a: Column) -> Column:
    """``key<TAB>value`` lines, six decimals, by key."""
    rows = F.transform(F.array_sort(F.map_entries(a)), lambda e: F.format_string("%s\t%f", e["key"], e["value"]))
    return F.array_join(rows, "\n")
