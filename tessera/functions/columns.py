"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_closing(c: Column) -> Column:
    """Without the closing brackets at the end."""
    return F.regexp_replace(c, r"\)+$", "")


def strip_sense(c: Column) -> Column:
    """Without a sense suffix of two digits, as in ``praise-01``."""
    return F.regexp_replace(c, r"-\d{2}$", "")


def has_sense(c: Column) -> Column:
    return c.rlike(r"-\d{2}$")


def depth(graph_idx: Column) -> Column:
    """Parts of a dotted path."""
    return F.size(F.split(graph_idx, r"\."))


def slice_join(tokens: Column, start: Column, end: Column) -> Column:
    """Tokens from ``start`` up to but not with ``end`` (from 0), joined by spaces."""
    return F.array_join(F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0))), " ")


def topic_of(path: Column, suffix: str) -> Column:
    """The file name of a path without what ``suffix`` (a regular expression) matches."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), suffix, "")


def collapse_space(c: Column) -> Column:
    """Runs of white space, and of bars among them, as one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s|]+", " "))


def threshold_flags(prefix: str, value: Column, bounds, zero_means_none: bool = False) -> list[tuple[Column, Column]]:
    """(key, 0.0 or 1.0) for ``value >= bound``; a bound of 0 can mean ``value == 0``."""
    out = []
    for b in bounds:
        met = (value == 0) if b == 0 and zero_means_none else (value >= b)
        name = f"{b:g}" if isinstance(b, float) else str(b)
        out.append((F.lit(f"{prefix} {name}"), F.when(met, 1.0).otherwise(0.0)))
    return out


def unordered(a: str, b: str) -> list[Column]:
    """The two ends in an order that doesn't depend on the edge's direction."""
    return [F.least(a, b).alias("end1"), F.greatest(a, b).alias("end2")]


def unquote(c: Column) -> Column:
    """Without one pair of surrounding quotes."""
    return F.regexp_replace(c, r"""^(["'])(.*)\1$""", "$2")


def sentences(c: Column) -> Column:
    """A text's sentences: parted after ``.``, ``!`` or ``?`` and closing quotes, before white space."""
    return F.filter(F.split(F.trim(c), r"""(?<=[.!?])(?<![A-Z][.])(?<=[.!?]["')\]]{0,2})\s+"""), lambda s: s != "")
