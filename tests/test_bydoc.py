"""Documents' graphs made one by one equal those of the table operators; queries on them shuffle only texts and keep nothing."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import bydoc, decode, docgraph, features, learn
from tessera.plans import catalog, lexical

SF = "/root/testdata/sf0.001"
WEIGHTS = {"1 n bias": 0.3, "1 n freq 2": 0.5, "0 n dep avg 2": 0.1, "1 e bias": -0.2, "1 e rel fst even": 0.4, "1 e rel sec odd p2": 0.7, "0 e rel fst odd sec even": 0.2}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Texts of sf0.001, some of them under one id, without an id, a text, a summary or a body."""
    path = str(tmp_path_factory.mktemp("bydoc"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").limit(60)
    odd = [(1, "A b a. C a b! a b a c", None), (None, "x y. y x", None), (900001, None, None), (900002, ".a b. b a", None), (900003, "only one", None), (900004, "Kİng K. k i ng", None)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("length", ["nolen", "nodes"])
def test_forests_equal_those_of_tables(spark, table, length):
    c = catalog._corpus(spark, table)
    wanted = decode.decode(*learn.gains(c, WEIGHTS), c.gold, length, 3000)
    found = catalog._texts(spark, table).decode(WEIGHTS, length, 3000)
    plain = lambda df: sorted((r["doc"], r["status"], round(r["objective"] or 0, 6), r["optimal"], r["nodes"], r["edges"]) for r in df.collect())
    assert plain(found) == plain(wanted) and found.count() > 50
    spark.catalog.clearCache()


@pytest.mark.parametrize("loss", ["perceptron", "ramp", "hinge"])
def test_gradients_equal_those_of_tables(spark, table, loss):
    wanted = learn.gradient(catalog._corpus(spark, table), WEIGHTS, loss)
    found = learn.gradient(catalog._texts(spark, table), WEIGHTS, loss)
    assert found and found == pytest.approx(wanted)
    spark.catalog.clearCache()


def test_ilp_decode_has_no_joins(spark):
    plan = catalog.QUERIES["ilp_decode"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and set(re.findall(r"hashpartitioning\(([^#]*)#", plan)) == {"doc_id"}


@pytest.mark.parametrize("name", ["perceptron_pass", "hinge_pass"])
def test_a_pass_keeps_nothing(spark, monkeypatch, name):
    """Neither the query nor the steps of its pass store a table, and no feature is shuffled before it is summed."""
    spark.catalog.clearCache()
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    plans = []
    collect = type(spark.range(0)).collect

    def seen(df):
        out = collect(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(type(spark.range(0)), "collect", seen)
    catalog.QUERIES[name](spark, SF)
    assert plans and all("InMemoryTableScan" not in p and "Join" not in p for p in plans)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_online_learning_of_texts(spark, table):
    some = catalog._texts(spark, table)
    some.rows = some.rows.where(F.col("doc").isin(1, 2, 3))
    assert learn.fit(some, "perceptron", passes=1, mode="online")


def test_expanded_counts_equal_those_of_tables(spark, table):
    """The pairs of a sentence, texts that share an id included, are numbers and no rows."""
    g = lexical.Lexical(spark, table)
    merged = docgraph.merge_expanded(docgraph.expand_edges(g.nodes, g.edges)).where("doc is not null").groupBy("doc")
    wanted = merged.agg(F.count("*").alias("anchors"), F.sum("n_sources").alias("sources"), F.sum("n_true").alias("true_sources"))
    found = catalog.edge_expand(spark, table)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_a_long_sentence_makes_no_pairs():
    words = [f"w{i}" for i in range(20_000)]
    assert bydoc.expanded_counts([[words], [[]], [["w1", "w1", "w2"]]]) == (20_000**2, 20_000**2 + 9, 19_999 + 6)


def test_feature_numbers_equal_those_of_tables(spark, table):
    """The keys of the features of every node and edge, which are made once for each kind of edge."""
    g = lexical.Lexical(spark, table)
    stats = features.node_stats(g.nodes)
    edge = features.edge_features(features.with_ends(features.edge_stats(g.edges.withColumn("n", F.lit(1))), stats))
    count = lambda df, name: df.groupBy("doc").agg(F.sum(F.size(F.array_distinct(F.transform("feats", lambda e: e["feat"])))).alias(name))
    wanted = count(edge, "edges").join(count(features.node_features(stats), "nodes"), "doc").select("doc", "nodes", "edges")
    found = catalog.feature_long_counts(spark, table)
    assert sorted(map(tuple, found.where("doc is not null").collect())) == sorted(map(tuple, wanted.collect()))
    assert [tuple(r)[1:] for r in found.where("doc is null").collect()] == [(0, 202)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_kinds_of_edges():
    sentences = [[["a", "b", "c"]], [["x", "a", "b"], ["c", "a"]], [["y", "b", "c"]], [["z", "b", "c"]]]
    concepts, kinds = bydoc.edge_kinds(sentences, ("even", "odd"))
    assert concepts == 6 and kinds == {("even", "odd"): 1, ("odd", None): 1, ("even", None): 4}
