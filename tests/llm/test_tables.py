"""Revisits, url filters, embeddings, the pipeline, the registry."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embdedup, oracles, queries, revisit, urlfilter

SMALL = "/root/testdata/sf0.001"


def capture(i, url, ts, kind, etag=None, modified=None, digest=None, headers=None):
    return (i, url, ts, kind, etag, modified, digest, headers, "clash")


CAPTURES = "capture_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, key string"


def test_resolve(spark):
    day = 86_400
    rows = [
        capture(1, "http://WWW.a.org:80/x/?utm_source=f#top", 10, "response", '"v1"', "m1", "d1", {"content-type": "t", "content-length": "9", "date": "1", "x": "old"}),
        capture(2, "https://a.org/x", 20, "revisit", 'W/"v1"', None, None, {"date": "2", "content-length": "0", "x": "new"}),
        capture(3, "https://a.org/x", 5 * day, "revisit", '"v2"'),
        capture(4, "https://a.org/x", 9 * day, "response", None, "m2"),
        capture(5, "https://a.org/x", 9 * day, "revisit", None, "m2", None, None),
        capture(6, "https://a.org/x", 99 * day, "revisit", '"v9"', None, "zz"),
        capture(7, "https://a.org/x", 3, "revisit", '"v1"'),
        capture(8, None, 30, "revisit", '"v1"'), capture(9, "https://a.org/x", None, "revisit", '"v1"'),
        capture(10, None, 1, "response", '"v1"'), capture(11, "https://a.org/y", 1, "request"),
    ]
    found = {r["capture_id"]: r for r in revisit.resolve(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert set(found) == {2, 3, 5, 6, 7, 8, 9}
    assert (found[2]["refers_to"], found[2]["state"]) == (1, "resolved")
    assert found[2]["headers"] == {"content-type": "t", "content-length": "9", "date": "2", "x": "new"}
    assert (found[3]["refers_to"], found[3]["state"]) == (1, "mismatch")
    assert (found[5]["refers_to"], found[5]["state"]) == (4, "resolved") and found[5]["headers"] == {}
    assert (found[6]["refers_to"], found[6]["state"]) == (4, "unverified")
    assert {found[i]["state"] for i in (7, 8, 9)} == {"orphan"}
    assert revisit.resolve(spark.createDataFrame([], CAPTURES)).count() == 0


def test_canonical(spark):
    urls = [("HTTP://www.A.org/b/",), ("a.org/b?ref=1&k=2",), ("https://a.org:443?x=1&utm_medium=z",), (None,), ("",)]
    found = [r[0] for r in spark.createDataFrame(urls, "url string").select(revisit.canonical_url(F.col("url"))).collect()]
    assert found == ["a.org/b", "a.org/b?k=2", "a.org?x=1", None, ""]


def fetched(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    return list(rel.columns), rel.fetchall()


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_oracles(spark, name):
    columns, rows = fetched(SMALL, oracles.oracle_sql()[name])
    found = queries.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in found)


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        ("http://A.Example.com/en/1?x#y", "a.example.com", "/en/1", "example.com/en/"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
        ("http://b.com/x", "b.com", "/x", "com/"), ("http://b.com", "b.com", "", None), ("http://x.net/es/9", "x.net", "/es/9", "net/es/"), ("http://x.net/en", "x.net", "/en", None),
        ("http://notcom/x", "notcom", "/x", None), ("http://wwww.example.com/en/x", "wwww.example.com", "/en/x", "example.com/en/"), ("no scheme.com/x", "", "", None), (None, "", "", None),
        ("http://É.com/é?q", "É.com", "/é", "com/"), ("a://b://c.com/x", "b:", "//c.com/x", None), ("http://?q=http://x.com/", "", "", None),
    ],
)
def test_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(url,)], "url string").select(urlfilter.host_of(F.col("url")).alias("h"), urlfilter.path_of(F.col("url")).alias("p"))
    row = df.select("h", "p", urlfilter.rule_for(F.col("h"), F.col("p")).alias("r")).first()
    assert tuple(row) == (host, path, rule)


def test_url_trees(spark):
    rows = [(i, f"http://h{i % 7}.example.{'com' if i % 2 else 'net'}/{'en' if i % 3 else 'es'}/{i}", "x") for i in range(300)]
    rows += [(1000 + i, f"http://s{i}.site.org/{'es' if i % 2 else 'q'}/page{i}", "x") for i in range(20)] + [(2000, None, "x"), (2001, "", "x"), (2002, "http://" + "a/" * 60_000, "x"), (5, rows[5][1], "x")]
    found = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    assert len(found) == len(rows) and {r["verdict"] for r in found} <= {"allow", "block"}
    for r in found:
        if r["rule"]:
            assert r["verdict"] == {x.text: x.verdict for x in urlfilter.RULES}[r["rule"]]
    ruled = [r for r in found if r["rule"]]
    right = [(r["block_probability"] >= 0.5) == (r["verdict"] == "block") for r in ruled]
    assert np.mean(right) > 0.95
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, rule string")).count() == 0
    plan = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, rule string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_boosting(rows, edges):
    """Gradient boosting by the definition: every split of every leaf tried on the rows themselves."""
    x = np.array([[r[f] for f in urlfilter.FEATURES] for r in rows])
    y = np.array([r["y"] for r in rows])
    base = (y.sum() + 1) / (len(y) + 2)
    margin = np.full(len(y), np.log(base / (1 - base)))

    def value(g, h):
        return urlfilter.RATE * g.sum() / (h.sum() + urlfilter.RIDGE)

    def score(g, h):
        return g.sum() ** 2 / (h.sum() + urlfilter.RIDGE)

    def grow(which, g, h, depth, names):
        best = (1e-6, None)
        for i, f in enumerate(urlfilter.FEATURES) if depth else ():
            if f not in names:
                continue
            for edge in edges[f]:
                low = which & (x[:, i] <= edge)
                high = which & ~low
                gain = round(score(g[low], h[low]) + score(g[high], h[high]) - score(g[which], h[which]), 6)
                if gain > best[0]:
                    best = (gain, (low, high))
        if best[1] is None:
            margin[which] += value(g[which], h[which])
            return
        for part in best[1]:
            grow(part, g, h, depth - 1, names)

    for tree in range(urlfilter.TREES):
        p = 1 / (1 + np.exp(-margin))
        grow(np.ones(len(y), dtype=bool), y - p, p * (1 - p), urlfilter.DEPTH, urlfilter.allowed(tree))
    return 1 / (1 + np.exp(-margin))


def test_boosting_against_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "TREES", 4)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        shop, q = rng.choice(["shop", "blog", "www"]), "?a=1&b=2" * int(rng.integers(0, 3))
        rows.append((f"http://{shop}.h{int(rng.integers(0, 40))}.{rng.choice(['com', 'net'])}/{rng.choice(['a', 'b'])}/{i}{q}", int(shop == "shop" and q != "" or rng.random() < 0.1)))
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    model = urlfilter.train(labelled)
    url = F.col("url")
    seen = labelled.select(url.alias("__url"), urlfilter.host_of(url).alias("__host"), urlfilter.path_of(url).alias("__path"), F.col("blocked").cast("double").alias("y"))
    found = model.featured(seen, F.pmod(F.xxhash64("__host"), F.lit(urlfilter.FOLDS)).cast("int")).withColumn("p", model.probability()).collect()
    assert [r["p"] for r in found] == pytest.approx(plain_boosting(found, model.edges).tolist())
    assert len(model.splits()) > 1
    # A row's own rate lacks the hosts of its fold.
    r = found[0]
    others = [q for q in found if q["__host"].split(".")[0] == r["__host"].split(".")[0] and q["__fold"] != r["__fold"]]
    base = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    assert r["rate_label"] == pytest.approx((sum(q["y"] for q in others) + urlfilter.PRIOR * base) / (len(others) + urlfilter.PRIOR))


def test_quantisation_bounds():
    rng = np.random.default_rng(1)
    for scale in (1.0, 1e-200, 1e200):
        u = embdedup.unit(rng.normal(size=(80, 33)) * scale)
        q = embdedup.Quantised.of(u)
        near, bound = q.products(q, slice(0, 80))
        assert (np.abs(near - u @ u.T) <= bound + 1e-12).all()


def test_few_pairs_of_a_tile_are_looked_at(monkeypatch):
    rng = np.random.default_rng(2)
    u = embdedup.unit(rng.normal(size=(40, 24))[rng.integers(0, 40, 300)] + rng.normal(size=(300, 24)) * rng.choice([0.0, 0.1, 0.25], (300, 1)))
    a, b = embdedup.Quantised.of(u[:150]), embdedup.Quantised.of(u[150:])
    monkeypatch.setattr(embdedup, "ROWS", 32)
    for other, exact in ((b, None), (None, None), (b, (u[:150], u[150:])), (None, (u[:150], u[:150]))):
        copies = np.arange(1.0, 1 + (150 if other is None else 300))
        found = []
        for dense in (0, 1 << 40):
            monkeypatch.setattr(embdedup, "DENSE", dense)
            found.append(embdedup.tile_links(a, other, copies, 0.95, exact))
        assert all(np.array_equal(x, y) for x, y in zip(*found))
    monkeypatch.setattr(embdedup, "DENSE", 8)
    monkeypatch.setattr(embdedup.Quantised, "products", None)  # no tile of few links is multiplied out
    counts, *_, undecided = embdedup.tile_links(a, b, np.ones(300), 0.95)
    near = u[:150] @ u[150:].T >= 0.95
    again = embdedup.tile_links(a, b, np.ones(300), 0.95, (u[:150], u[150:]))[0]
    assert undecided and np.array_equal(counts + again, np.r_[near.sum(axis=1), near.sum(axis=0)])


def test_spanning():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        i, j = rng.integers(0, n, 50), rng.integers(0, n, 50)
        keep = embdedup.spanning(i, j, n)
        full, tree = brute_components(n, zip(i, j)), brute_components(n, zip(i[keep], j[keep]))
        assert full == tree and len(keep) == n - len(set(full))


def brute_components(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.mark.parametrize("block, pivots, heads", [(32, 2048, 512), (8, 300, 3), (16, 2, 512)])
def test_vectors(spark, monkeypatch, block, pivots, heads):
    for name, value in (("BLOCK", block), ("PIVOTS", pivots), ("HEADS", heads), ("ROWS", 5)):
        monkeypatch.setattr(embdedup, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = [centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3]) for i in range(150)]
    x += [x[0], x[0], x[5] * 3.0]
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(np.array(x).astype(np.float32))]
    n = len(rows)
    odd = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [1.0, None]), (n + 4, []), (n + 5, [1.0, 2.0]), (n + 6, [float("inf")] * 16)]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, n_links int")
    found = {r["vec_id"]: r for r in embdedup.vector_components(table).collect()}
    u = embdedup.unit(np.array([r[1] for r in rows]))
    near = (u @ u.T >= 0.95) & ~np.eye(n, dtype=bool)
    label = brute_components(n, zip(*np.nonzero(near)))
    assert [found[i]["n_links"] for i in range(n)] == near.sum(axis=1).tolist()
    assert [found[i]["component_id"] for i in range(n)] == label and [found[i]["kept"] for i in range(n)] == [v == i for i, v in enumerate(label)]
    assert all(found[n + k]["n_links"] == 0 and found[n + k]["component_id"] == n + k and found[n + k]["kept"] for k in range(7))
    assert embdedup.vector_components(table.where("false")).count() == 0


def test_registry():
    import corpus_pipeline

    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]


def test_pipeline(spark):
    import corpus_pipeline
    from tessera.llm import packing

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    pieces = corpus_pipeline.pack(spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    whole = packing.WordTokenizer(packing.default_tokenizer()).exact([r["text"] for r in docs.select("text").collect()])
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(x) + 1 for x in whole)
