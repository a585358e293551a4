"""Overlap scores of system and model summaries: ROUGE-N, S, SU, L and W.

``pairs``: id, model_id, system, model (texts).  N, S and SU are joins of counted
units; L and W need dynamic programming over two sequences, which columns can't
express, and run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


@dataclass(frozen=True)
class RougeOptions:
    """What the external script's flags set. Fixed values are its wrapper's defaults."""

    max_n: int = 4
    skip_gap: int | None = -1
    with_unigrams: bool = True
    weight: float = 1.2
    first_words: int | None = None
    alpha: float = 0.5
    best_model: bool = False
    confidence: float = 0.95
    samples: int = 1000


#: The two presets of the reference project. Fixed values.
DEFAULT = RougeOptions(first_words=10)
PROJECT = RougeOptions(skip_gap=4, first_words=100)


def tokens(text: Column, first_words: int | None = None) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return found if first_words is None else F.slice(found, 1, first_words)


def ngrams(words: Column, n: int) -> Column:
    """An array of the n-grams, joined by spaces."""
    if n == 1:
        return words
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))


def skip_bigrams(words: Column, gap: int) -> Column:
    """An array of the ordered word pairs with at most ``gap`` words between; -1: any number."""
    places = F.when(F.size(words) >= 2, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    last = (lambda i: F.size(words)) if gap < 0 else (lambda i: F.least(F.size(words), i + gap + 1))
    rows = F.transform(places, lambda i: F.transform(F.sequence(i + 1, last(i)), lambda j: F.concat_ws(" ", F.get(words, i - 1), F.get(words, j - 1))))
    return F.flatten(rows)


def overlap(pairs: DataFrame, units, alpha: float = 0.5) -> DataFrame:
    """``(id, model_id, hits, n_system, n_model, recall, precision, f_score)``: clipped counts of common units.

    ``units`` maps an array of words to an array of strings.  A pair without a unit
    on one side scores 0.
    """
    key = ["id", "model_id"]
    # The words are a column of their own: units look at them many times.
    words = pairs.select(*key, tokens(F.col("system")).alias("sw"), tokens(F.col("model")).alias("mw"))
    side = lambda name, i: F.transform(units(F.col(name)), lambda u: F.struct(F.lit(i).alias("side"), u.alias("u")))
    both = words.select(*key, F.explode_outer(F.concat(side("sw", 0), side("mw", 1))).alias("x"))
    of = lambda i: F.sum(F.when(F.col("x.side") == i, 1).otherwise(0))
    counted = both.groupBy(*key, F.col("x.u").alias("u")).agg(of(0).alias("s"), of(1).alias("m"))
    sums = counted.groupBy(*key).agg(F.sum(F.least("s", "m")).alias("hits"), F.sum("s").alias("n_system"), F.sum("m").alias("n_model"))
    return with_scores(sums.select(*key, "n_system", "n_model", "hits"), alpha)


def with_scores(rows: DataFrame, alpha: float = 0.5) -> DataFrame:
    r = F.when(F.col("n_model") > 0, F.col("hits") / F.col("n_model")).otherwise(0.0)
    p = F.when(F.col("n_system") > 0, F.col("hits") / F.col("n_system")).otherwise(0.0)
    rows = rows.withColumns({"recall": r, "precision": p})
    bottom = (1 - alpha) * F.col("precision") + alpha * F.col("recall")
    return rows.withColumn("f_score", F.when(bottom > 0, F.col("precision") * F.col("recall") / bottom).otherwise(0.0))


def rouge_n(pairs: DataFrame, n: int, alpha: float = 0.5) -> DataFrame:
    return overlap(pairs, lambda w: ngrams(w, n), alpha)


def rouge_s(pairs: DataFrame, gap: int, with_unigrams: bool = False, alpha: float = 0.5) -> DataFrame:
    units = (lambda w: F.concat(skip_bigrams(w, gap), w)) if with_unigrams else (lambda w: skip_bigrams(w, gap))
    return overlap(pairs, units, alpha)


def common_subsequence(a: list[str], b: list[str], weight: float | None = None) -> float:
    """Length of the longest common subsequence; with a weight, runs count by their length to that power."""
    if weight is None:
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return float(row[-1])
    score, run = [0.0] * (len(b) + 1), [0] * (len(b) + 1)
    for x in a:
        last_score, last_run = 0.0, 0
        for j, y in enumerate(b, 1):
            above_score, above_run = score[j], run[j]
            if x == y:
                score[j], run[j] = last_score + (last_run + 1) ** weight - last_run**weight, last_run + 1
            else:
                score[j], run[j] = max(above_score, score[j - 1]), 0
            last_score, last_run = above_score, above_run
    return score[-1]


def rouge_l(pairs: DataFrame, alpha: float = 0.5, weight: float | None = None) -> DataFrame:
    """As ``overlap``, for the longest common subsequence of all words; with ``weight``, ROUGE-W."""
    ship(pairs.sparkSession)

    @F.pandas_udf("double")
    def common(s: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([common_subsequence(list(x), list(y), weight) for x, y in zip(s, m)], dtype=float)

    rows = pairs.select("id", "model_id", tokens(F.col("system")).alias("s"), tokens(F.col("model")).alias("m"))
    rows = rows.select("id", "model_id", F.size("s").cast("long").alias("n_system"), F.size("m").cast("long").alias("n_model"), common("s", "m").alias("hits"))
    if weight is None:
        return with_scores(rows, alpha)
    size = lambda c: F.pow(F.col(c).cast("double"), weight)
    back = lambda c: F.when(size(c) > 0, F.pow(F.col("hits") / size(c), 1 / weight)).otherwise(0.0)
    rows = rows.withColumns({"recall": back("n_model"), "precision": back("n_system")})
    bottom = (1 - alpha) * F.col("precision") + alpha * F.col("recall")
    return rows.withColumn("f_score", F.when(bottom > 0, F.col("precision") * F.col("recall") / bottom).otherwise(0.0))


def over_models(scores: DataFrame, best: bool = False) -> DataFrame:
    """``(id, recall, precision, f_score)``: the mean over a system's models, or the best by F."""
    if best:
        top = scores.groupBy("id").agg(F.max(F.struct("f_score", "recall", "precision")).alias("t"))
        return top.select("id", "t.recall", "t.precision", "t.f_score")
    return scores.groupBy("id").agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "f_score")])


def by_system(scores: DataFrame) -> DataFrame:
    """``(system_id, n, recall, precision, f_score)``: each system's means in percent, of ``over_models`` rows with a system_id."""
    means = [(F.avg(c) * 100).alias(c) for c in ("recall", "precision", "f_score")]
    return scores.groupBy("system_id").agg(F.count("*").alias("n"), *means)


def bootstrap(scores: DataFrame, samples: int = 1000, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """``(measure, value, cb, ce)``: means over all rows with a percentile interval.

    Each resample weighs every row by a Poisson(1) draw that a hash of (row id,
    resample, seed) makes, so resamples are sums of weights and need no shuffle of
    rows; a resample without a row is left out.
    """
    u = (F.pmod(F.xxhash64("id", "b", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    draw, total, term = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(1, 9):
        total += term
        draw = draw + F.when(u > total, 1).otherwise(0)
        term /= k
    rows = scores.select("id", "recall", "precision", "f_score", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("b")).withColumn("w", draw)
    means = rows.groupBy("b").agg(*[(F.sum(F.col(c) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias(c) for c in ("recall", "precision", "f_score")])
    tail = (1 - confidence) / 2
    out = None
    for c in ("recall", "precision", "f_score"):
        bounds = means.agg(F.percentile(c, F.lit(tail)).alias("cb"), F.percentile(c, F.lit(1 - tail)).alias("ce"))
        row = scores.agg(F.avg(c).alias("value")).join(bounds, how="cross").select(F.lit(c).alias("measure"), "value", "cb", "ce")
        out = row if out is None else out.unionByName(row)
    return out


def pair_up(systems: DataFrame, models: DataFrame, system_pattern: str, model_pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, system_file, model_file, system, model)`` of ``(file, text)`` tables, and the systems' columns ``keep``.

    The first group of ``system_pattern`` is the document's id; ``#ID#`` in
    ``model_pattern`` stands for it.  Patterns match from the name's beginning.
    A system file without a model fails the query.
    """
    parts = model_pattern.split("#ID#")
    pattern = "(.+?)".join(f"(?:{p})" for p in parts)
    s = systems.withColumn("id", F.regexp_extract("file", f"^(?:{system_pattern})", 1)).where(F.col("file").rlike(f"^(?:{system_pattern})"))
    m = models.where(F.col("file").rlike(f"^(?:{pattern})$")).withColumn("id", F.regexp_extract("file", f"^(?:{pattern})$", 1))
    both = s.select("id", *keep, F.col("file").alias("system_file"), F.col("text").alias("system")).join(
        m.select("id", F.col("file").alias("model_file"), F.col("text").alias("model")), "id", "left"
    )
    lost = F.raise_error(F.concat(F.lit("no model for "), F.col("system_file"))).cast("string")
    return both.withColumn("model_file", F.when(F.col("model_file").isNotNull(), F.col("model_file")).otherwise(lost))


def evaluate(pairs: DataFrame, options: RougeOptions = PROJECT) -> Iterator[tuple[str, DataFrame]]:
    """(metric, scores over models) of every metric that the options ask for."""
    if options.first_words is not None:
        cut = lambda c: F.array_join(tokens(F.col(c), options.first_words), " ")
        pairs = pairs.withColumns({"system": cut("system"), "model": cut("model")})
    for n in range(1, options.max_n + 1):
        yield f"rouge_{n}", over_models(rouge_n(pairs, n, options.alpha), options.best_model)
    if options.skip_gap is not None:
        name = "s*" if options.skip_gap < 0 else f"s{options.skip_gap}"
        yield f"rouge_{name}", over_models(rouge_s(pairs, options.skip_gap, False, options.alpha), options.best_model)
        if options.with_unigrams:
            yield f"rouge_{name.replace('s', 'su')}", over_models(rouge_s(pairs, options.skip_gap, True, options.alpha), options.best_model)
    yield "rouge_l", over_models(rouge_l(pairs, options.alpha), options.best_model)
    yield f"rouge_w_{options.weight}", over_models(rouge_l(pairs, options.alpha, options.weight), options.best_model)
