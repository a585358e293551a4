"""URL filtering: prefix rules first, gradient-boosted trees on lexical features for the rest.

Everything is a DataFrame expression.  The trees are grown by histogram boosting:
the labelled urls are reduced to their binned features with counts of each label,
and every level of a tree is one aggregate over that table (gradient and
curvature sums by node, feature and bin), of which only the histogram, of at most
nodes x features x ``BINS`` rows, reaches the driver.  A tree is then a CASE
expression, so scoring is a projection in generated code.

Suffix statistics are block rates of what urls end in (top-level domain, last two
labels) and of their first host label and path segment, drawn to the overall rate by
``PRIOR`` urls.  A labelled url's own rates leave out the hosts of its fold, as a new
url's rates lack it: so the trees learn how far such rates can be trusted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settle

TREES, DEPTH, RATE, RIDGE = 12, 3, 0.4, 1.0
BINS = 16
#: Weight of the overall block rate in a suffix's rate, in urls.
PRIOR = 20.0
#: Folds of hosts.
FOLDS = 4


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a parent domain of it, and the path's beginning; else null."""
    out = F.when(F.lit(False), F.lit(""))
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = out.when(fits, F.lit(r.text))
    return out


def verdict_for(rule: Column, rules=RULES) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for r in rules:
        out = out.when(rule == r.text, F.lit(r.verdict))
    return out


def _many(text: Column, characters: str) -> Column:
    """How many of the text's characters are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a url by name; a null url reads as empty."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    terms = []
    for c in ascii_lowercase + digits + "-._/?=&%":
        k = _many(F.lower(url), c) / n
        terms.append(F.when(k > 0, -k * F.log2(k)).otherwise(0.0))
    entropy = terms[0]
    for t in terms[1:]:
        entropy = entropy + t
    return {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _many(path, "/").cast("double"),
        "labels": _many(host, ".").cast("double"),
        "hyphens": _many(url, "-").cast("double"),
        "digit_ratio": _many(url, digits) / n,
        "parameters": F.when(query == "", 0.0).otherwise(_many(query, "&") + 1.0),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "entropy": entropy,
    }


def suffix_keys(host: Column, path: Column) -> dict[str, Column]:
    """What urls are counted by: top-level domain, last two labels, first label, first path segment."""
    return {
        "top": F.substring_index(host, ".", -1),
        "pair": F.substring_index(host, ".", -2),
        "label": F.substring_index(host, ".", 1),
        "segment": F.regexp_extract(path, "^/([^/]*)/", 1),
    }


LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "parameters", "fragment", "entropy")
SUFFIX = ("top", "pair", "label", "segment")
FEATURES = LEXICAL + tuple(f"rate_{k}" for k in SUFFIX)
#: Suffix statistics that a tree may split by, besides the lexical features, in turn: where one kind says nothing of a
#: url (a domain never labelled), the trees of the other still do.
TURNS = (("rate_label", "rate_segment"), ("rate_top", "rate_pair"))


def allowed(tree: int) -> tuple[str, ...]:
    """The features that a tree, by its number, may split by."""
    return LEXICAL + TURNS[tree % len(TURNS)]


class UrlModel:
    """Suffix sums, bin edges and trees; ``probability`` is that a url is to be blocked.

    ``rates(kind, key, fold, n, s, all_n, all_s)`` holds labelled and blocked urls of each key, in the fold and in all.
    """

    def __init__(self, rates: DataFrame, base: float, edges: dict[str, list[float]], trees: list, start: float):
        self.rates, self.base, self.edges, self.trees, self.start = rates, base, edges, trees, start

    def featured(self, urls: DataFrame, fold: Column | None = None) -> DataFrame:
        """``urls`` (with __host, __path, __url) with a column for every feature; rates without the hosts of ``fold``."""
        urls = urls.withColumn("__fold", F.lit(-1) if fold is None else fold)
        for name, col in suffix_keys(F.col("__host"), F.col("__path")).items():
            sums = self.rates.where(F.col("kind") == name)
            urls = urls.withColumn("__key", col)
            if fold is None:
                whole = sums.groupBy(F.col("key").alias("__key")).agg(F.first("all_n").alias("__n"), F.first("all_s").alias("__s"))
                urls = urls.join(whole, "__key", "left")
            else:
                # Every labelled url is counted in its key and fold, so none is without a partner.
                others = sums.select(F.col("key").alias("__key"), F.col("fold").alias("__fold"), (F.col("all_n") - F.col("n")).alias("__n"), (F.col("all_s") - F.col("s")).alias("__s"))
                urls = urls.join(others, ["__key", "__fold"], "left")
            rate = (F.col("__s") + PRIOR * self.base) / (F.col("__n") + PRIOR)
            # Without a labelled url of its key a new url has no rate.
            urls = urls.withColumn(f"rate_{name}", rate).drop("__key", "__n", "__s")
        return urls.withColumns(lexical(F.col("__url"), F.col("__host"), F.col("__path")))

    def splits(self) -> dict[str, int]:
        """How often each feature splits, over all trees."""
        found: dict[str, int] = {}
        todo = list(self.trees)
        while todo:
            tree = todo.pop()
            if not isinstance(tree, float):
                found[tree[0]] = found.get(tree[0], 0) + 1
                todo += tree[2:4]
        return found

    def margin(self) -> Column:
        out = F.lit(self.start)
        for tree in self.trees:
            out = out + tree_value(tree)
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def tree_value(tree) -> Column:
    """A tree as an expression: a leaf is a number, a node (feature, edge, below or equal, above, share below).

    Where the feature is null both sides count, by their shares of the labelled urls.
    """
    if isinstance(tree, float):
        return F.lit(tree)
    feature, edge, low, high, share = tree
    below, above = tree_value(low), tree_value(high)
    sides = F.when(F.col(feature) <= edge, below)
    if feature not in LEXICAL:
        sides = sides.when(F.col(feature).isNull(), share * below + (1 - share) * above)
    return sides.otherwise(above)


def train(labelled: DataFrame) -> UrlModel:
    """Learn from all rows of ``labelled(url, blocked)``; ``blocked`` is 1 or 0, null rows are left out.

    One class alone, or no row, gives a model without trees: its base rate.
    """
    url = F.col("url")
    rows = labelled.where(F.col("blocked").isNotNull()).select(
        url.alias("__url"), host_of(url).alias("__host"), path_of(url).alias("__path"), F.col("blocked").cast("double").alias("y")
    )
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("s")).first()
    n, s = total["n"], total["s"] or 0.0
    base = (s + 1) / (n + 2)
    fold = F.pmod(F.xxhash64("__host"), F.lit(FOLDS)).cast("int")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in suffix_keys(F.col("__host"), F.col("__path")).items()])
    sums = rows.select(fold.alias("fold"), "y", F.explode(kinds).alias("k")).groupBy("k.kind", "k.key", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    of_key = Window.partitionBy("kind", "key")  # FOLDS rows at most
    rates = settle(sums.withColumns({"all_n": F.sum("n").over(of_key), "all_s": F.sum("s").over(of_key)}))
    model = UrlModel(rates, base, {}, [], 0.0)
    model.start = math.log(base / (1 - base))
    if not n or s in (0.0, float(n)):
        return model
    # Written once: read for the bin edges and for the bins.
    seen = settle(model.featured(rows, fold).select(*FEATURES, "y"))
    steps = [i / BINS for i in range(1, BINS)]
    cuts = seen.agg(*[F.percentile_approx(f, steps, 2000).alias(f) for f in FEATURES]).first()
    model.edges = {f: sorted(set(cuts[f])) for f in FEATURES}
    binned = [sum((F.when(F.col(f) > e, 1).otherwise(0) for e in model.edges[f]), F.lit(0)).alias(f) for f in FEATURES]
    table = seen.select(*binned, "y").groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    # The margin so far is a column, written with every tree: expressions stay short, and a lost executor costs one tree.
    table = settle(table.withColumn("margin", F.lit(model.start)))
    discard(seen)
    for i in range(TREES):
        tree = _grow(table, model, allowed(i))
        model.trees.append(tree)
        if i < TREES - 1:
            new = settle(table.withColumn("margin", F.col("margin") + _in_bins(tree, model.edges)))
            discard(table)
            table = new
    discard(table)
    return model


def _in_bins(tree, edges) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, edge, low, high, _ = tree
    return F.when(F.col(feature) <= edges[feature].index(edge), _in_bins(low, edges)).otherwise(_in_bins(high, edges))


def _grow(table: DataFrame, model: UrlModel, features: tuple[str, ...]):
    """One tree for ``table`` (bins, n, s, margin), a level at a time; nodes are numbered 1, then 2k and 2k + 1 below k."""
    p = 1 / (1 + F.exp(-F.col("margin")))
    node = F.lit(1)
    rows = table.withColumns({"g": F.col("s") - F.col("n") * p, "h": F.col("n") * p * (1 - p)})
    splits: dict[int, tuple] = {}
    leaves: dict[int, float] = {}
    shares: dict[int, float] = {}
    value = lambda g, h: RATE * g / (h + RIDGE)
    for _ in range(DEPTH):
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("bin")) for i, f in enumerate(features)])).alias("c")
        sums = rows.select(node.alias("node"), "g", "h", cells).groupBy("node", "c.f", "c.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        found: dict[int, dict[int, dict[int, tuple]]] = {}
        for r in sums.collect():
            found.setdefault(r["node"], {}).setdefault(r["f"], {})[r["bin"]] = (r["g"], r["h"])
        node = F.lit(0)
        for k, bins in sorted(found.items()):
            if k == 0:
                continue
            g, h = (sum(x[i] for x in bins[0].values()) for i in (0, 1))
            best = (1e-6, None)
            for i, f in enumerate(features):
                left_g = left_h = 0.0
                for b in range(len(model.edges[f])):
                    x = bins[i].get(b, (0.0, 0.0))
                    left_g, left_h = left_g + x[0], left_h + x[1]
                    gain = left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g**2 / (h + RIDGE)
                    if round(gain, 6) > best[0]:
                        best = (round(gain, 6), (i, b, left_g, left_h))
            if best[1] is None:
                leaves[k] = value(g, h)
                continue
            i, b, left_g, left_h = best[1]
            splits[k], shares[k] = (features[i], b), left_h / h
            leaves[2 * k], leaves[2 * k + 1] = value(left_g, left_h), value(g - left_g, h - left_h)
        for k, (f, b) in splits.items():
            if 2 * k not in splits and 2 * k + 1 not in splits:
                here = _path(splits, k)
                node = F.when(here & (F.col(f) <= b), 2 * k).when(here & (F.col(f) > b), 2 * k + 1).otherwise(node)

    def build(k: int):
        if k not in splits:
            return float(leaves.get(k, 0.0))
        f, b = splits[k]
        return (f, model.edges[f][b], build(2 * k), build(2 * k + 1), shares[k])

    return build(1)


def _path(splits: dict, k: int) -> Column:
    """The condition that a row comes to node ``k``."""
    out = F.lit(True)
    while k > 1:
        f, b = splits[k // 2]
        out = out & ((F.col(f) > b) if k % 2 else (F.col(f) <= b))
        k //= 2
    return out


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, block_probability)`` for every row of ``pages(page_id, url)``.

    A rule decides the urls that it fits; these are the labelled urls that the
    trees are trained on, and the trees decide the rest, at a probability of 0.5.
    A null url, or one without ``://``, has empty host and path, fits no rule and
    is judged by the trees.  Other columns are ignored.
    """
    url = F.col("url")
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("__url"), host_of(url).alias("__host"), path_of(url).alias("__path"))
    seen = seen.withColumn("__rule", rule_for(F.col("__host"), F.col("__path"), rules))
    ruled = verdict_for(F.col("__rule"), rules)
    model = train(seen.where(F.col("__rule").isNotNull()).select(F.col("__url").alias("url"), (ruled == "block").cast("int").alias("blocked")))
    probability = model.probability()
    return model.featured(seen).select(
        "page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
        F.coalesce(ruled, F.when(probability >= 0.5, "block").otherwise("allow")).alias("verdict"),
        probability.alias("block_probability"),
    )
