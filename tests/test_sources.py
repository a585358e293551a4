"""Block files, relation files, text formats, streams."""

import argparse

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import columns as fc
from tessera.operators import coverage, edgefilter, metrics, rouge, vectors
from tessera.sources import blocks, jamr, texts
from tessera.streaming import blocks as stream
from tests.test_graph import BODY, SUMMARY


def lines(spark, text, name="D1-x.txt"):
    return spark.createDataFrame([(name, i, x) for i, x in enumerate(text.split("\n"))], "file string, ord int, line string")


def test_blocks(spark):
    files = spark.createDataFrame([("a", "\n\n# ::id D.1 ::k a b\n(a / b)\n \n\n# ::id D.2\n(c\n/ d)")], "file string, content string")
    rows = blocks.records_of(blocks.blocks_of(files)).orderBy("ord").collect()
    assert [r["graph"] for r in rows] == ["(a / b)", "(c / d)"] and rows[0]["meta"] == {"id": "D.1", "k": "a b"}
    assert blocks.blocks_of(files, keep_last=False).count() == 1
    with pytest.raises(Exception, match="DOC.LINE"):
        bad = spark.createDataFrame([("a", "# ::id D\n(a / b)")], "file string, content string")
        blocks.sentences_of(blocks.records_of(blocks.blocks_of(bad))).collect()


def test_types_and_summaries(spark):
    files = spark.createDataFrame([("a", BODY + "\n" + SUMMARY)], "file string, content string")
    b = blocks.blocks_of(files)
    assert blocks.with_type(b, "summary").count() == 1 and blocks.with_type(b, "body").count() == 2
    assert blocks.reference_summaries(blocks.records_of(b)).first()["summary"] == "ada was praised"
    assert blocks.zip_blocks(b, b).count() == 3
    with pytest.raises(Exception, match="differ"):
        blocks.zip_blocks(b, blocks.with_type(b, "body")).collect()


def test_triple_lines(spark):
    rows = lines(spark, "# ::snt One\n( x / c1, rel, y / C2 )\n( bad, line )\n\n# ::snt Two\n( z / c3, r, x / c1 )")
    found = jamr.triples_of_lines(rows).orderBy("ord").collect()
    assert [(r["line_num"], r["concept1"], r["relation"], r["concept2"]) for r in found] == [(0, "c1", "rel", "c2"), (1, "c3", "r", "c1")]
    handles = jamr.handles_of_lines(rows)
    assert {r["concept"]: r["cnt"] for r in jamr.concept_counts(handles).collect()} == {"c1": 2, "c2": 1, "c3": 1}
    assert {(r["concept1"], r["concept2"]) for r in jamr.cooccurring(handles).collect()} == {("c1", "c2"), ("c3", "c1")}


def test_tables(spark):
    text = "# ::snt A b\n# ::tok a b c\nNodes:\n0\tx\tsee-01\t0-1\n0.0\ty\tdog\t1-2\n0.1\tz\tdog\t1-2\nEdges:\n0\t_\tARG0\t0.0\t_\n0.0\t_\tmod\t0.1\t_\n0\t_\tr\t0.9\t_\n"
    nodes, edges = jamr.tables_of_lines(lines(spark, text))
    kept, lost = jamr.table_edges(nodes, edges)
    assert [(r["concept1"], r["relation"], r["concept2"]) for r in kept.collect()] == [("see-01", "ARG0", "dog")]
    assert lost.count() == 1 and nodes.where("graph_idx = '0.0'").first()["phrase"] == "b"
    assert jamr.with_topic(nodes, jamr.DOCS_SUFFIX).first()["topic"] == "D1"


def test_parameters(spark):
    weights = spark.createDataFrame([("1 n bias", 0.5), ("0 e x", -1.25)], "feat string, weight double")
    out = [r["value"] for r in texts.parameter_lines(weights, 10, 3).collect()]
    assert out[:2] == ["#curr_num_passes#: 3", "#num_passes#: 10"]
    again = texts.read_parameters(lines(spark, "\n".join(out + ["1 n bias\t9.0", ""])))
    assert {r["feat"]: r["weight"] for r in again.collect()} == {"1 n bias": 0.5, "0 e x": -1.25}


def test_spl(spark):
    df = spark.createDataFrame([("a b\nc",)], "t string")
    html = df.select(texts.to_spl_html(F.col("t"), "T")).first()[0]
    assert len(html.split("\n")) == 9 and html.split("\n")[5] == '<a name="1">[1]</a> <a href="#1" id=1>a b</a>'
    assert df.select(texts.from_spl_html(texts.to_spl_html(F.col("t")))).first()[0] == "a b\nc"
    assert texts.anchor_text(html) == "a b\nc"
    assert texts.with_anchor_text(spark.createDataFrame([(html,), (None,)], "html string")).select("anchor_text").collect()[0][0] == "a b\nc"


def test_rouge_output(spark):
    line = "1 ROUGE-1 Average_R: 0.02632 (95%-conf.int. 0.02632 - 0.02633)"
    row = texts.rouge_scores(spark.createDataFrame([(line,), ("---",)], "line string")).collect()
    assert [tuple(r) for r in row] == [("1", "rouge_1", "recall", 0.02632, 0.02632, 0.02633)]
    pairs = spark.createDataFrame([("1", "s.1", "m.B.1"), ("1", "s.1", "m.A.1")], "doc_id string, system string, model string")
    xml = texts.rouge_config(pairs, "m", "s").first()["value"]
    assert '<M ID="A">m.A.1</M>\n<M ID="B">m.B.1</M>' in xml and '<P ID="1">s.1</P>' in xml


def test_rouge(spark):
    def pair(s, m):
        return spark.createDataFrame([("x", 0, s, m)], "id string, model_id int, system string, model string")

    p = pair("police kill the gunman", "police killed the gunman")
    score = lambda df: (df.first()["recall"], df.first()["precision"])
    assert score(rouge.rouge_n(p, 1)) == (0.75, 0.75)
    assert score(rouge.rouge_n(p, 2)) == pytest.approx((1 / 3, 1 / 3))
    assert score(rouge.rouge_s(p, 4)) == (0.5, 0.5) and score(rouge.rouge_s(p, -1)) == (0.5, 0.5)
    assert score(rouge.rouge_l(p)) == (0.75, 0.75)
    assert score(rouge.rouge_n(pair("", "a b"), 1)) == (0, 0) and rouge.rouge_n(pair(None, "a"), 1).first()["f_score"] == 0
    assert score(rouge.rouge_n(pair("the the the", "the cat"), 1)) == pytest.approx((0.5, 1 / 3))
    assert rouge.common_subsequence("abcd", "abxcd", 1.2) == pytest.approx(2 * 2**1.2)
    files = lambda *names: spark.createDataFrame([(n, "t") for n in names], "file string, text string")
    both = rouge.pair_up(files("S.11.c-01.html", "S.11.c-02.html"), files("S.A.c-01.html", "S.B.c-01.html", "S.A.c-02.html"), r"S\.11\.c-(\d+)\.html", r"S\.[A-D]\.c-#ID#\.html")
    assert both.count() == 3
    with pytest.raises(Exception, match="no model"):
        rouge.pair_up(files("S.11.c-09.html"), files("S.A.c-01.html"), r"S\.11\.c-(\d+)\.html", r"S\.[A-D]\.c-#ID#\.html").collect()
    assert {k for k, _ in rouge.evaluate(p)} == {"rouge_1", "rouge_2", "rouge_3", "rouge_4", "rouge_s4", "rouge_su4", "rouge_l", "rouge_w_1.2"}
    low = rouge.bootstrap(rouge.rouge_n(p, 1), samples=50).where("measure = 'recall'").first()
    assert low["value"] == low["cb"] == low["ce"] == 0.75


def test_vectors(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "z", 1.0)], "id int, feat string, val double")
    w = spark.createDataFrame([("x", 3.0), ("y", -1.0)], "feat string, weight double")
    assert {r["id"]: r["score"] for r in vectors.dot(a, w).collect()} == {1: 1.0, 2: 0.0}
    m = spark.sql("select map('x', 1.0D, 'y', 2.0D) a, map('y', 3.0D) b").select(
        vectors.map_dot(F.col("a"), F.col("b")), vectors.map_add(F.col("a"), F.col("b"), 2.0), vectors.map_project(F.col("b"), F.col("a")), vectors.map_text(F.col("a"))
    ).first()
    assert m[0] == 6.0 and m[1] == {"x": 1.0, "y": 8.0} and m[2] == {"x": 0.0, "y": 3.0} and m[3] == "x\t1.000000\ny\t2.000000"
    passes = spark.createDataFrame([(1, "x", 2.0), (2, "x", 4.0), (2, "y", 2.0)], "pass int, feat string, weight double")
    assert {r["feat"]: r["weight"] for r in vectors.mean_weights(passes).collect()} == {"x": 3.0, "y": 1.0}


def test_columns_and_metrics(spark):
    one = spark.createDataFrame([("praise-01", "0.1.0", "team))", "'a b'")], "c string, g string, p string, q string").select(
        fc.strip_sense(F.col("c")), fc.depth(F.col("g")), fc.strip_closing(F.col("p")), fc.unquote(F.col("q"))
    )
    assert tuple(one.first()) == ("praise", 3, "team", "a b")
    s = spark.createDataFrame([("One two. Three? Four",)], "t string").select(fc.sentences(F.col("t"))).first()[0]
    assert s == ["One two.", "Three?", "Four"]
    rows = spark.createDataFrame([(i, float(i)) for i in range(2500)], "k int, v double")
    last = metrics.running_mean(rows, "k", "v").where("k = 2499").first()
    assert last["running_v"] == pytest.approx(2499 / 2)


def test_edge_filter(spark):
    rows = [(i, f"c{i % 3}-01", "x", "r" if i % 2 else "q", "0", "0.1", int(i % 2)) for i in range(60)]
    edges = spark.createDataFrame(rows, "edge_id long, concept1 string, concept2 string, relation string, g1 string, g2 string, label int")
    found = edgefilter.percepts(edges)
    assert found.count() == 420 and edgefilter.prune(found, 25).select("template").distinct().count() == 6
    table = edgefilter.percept_table(found.where("template = 'relation'"))
    assert edgefilter.drop_unseen(found, table).count() == 60
    v = edgefilter.vectors(edges, found, 64)
    p = edgefilter.posteriors(edgefilter.train(v), v).withColumn("y", metrics.by_threshold(F.col("p0")))
    assert metrics.confusion(p, "label", "y").first()["fscore"] == 100.0


def test_labels(spark):
    e = spark.createDataFrame([("t", "b", "r", "a", "f", 1, 0), ("t", "a", "s", "b", "f", 0, 0)], "topic string, c1 string, rel string, c2 string, file string, line_num int, ord int")
    out = coverage.label_edges(e, e.where("rel = 'r'")).collect()
    assert [(r["rel"], r["label"]) for r in out] == [("s", 1)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(BODY)
    q = stream.write_graphs(stream.stream_sentences(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "nodes")).count() == 5
    assert spark.read.parquet(str(tmp_path / "out" / "edges")).count() == 5


def test_cli(spark, tmp_path, capsys):
    from tessera import cli

    for name, text in (("sys/S.1.txt", "police kill the gunman"), ("mod/M.A.1.txt", "police killed the gunman"), ("mod/M.B.1.txt", "police kill the gunman")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    pattern = ["--system-pattern", r"S\.(\d+)\.txt", "--model-pattern", r"M\.[A-D]\.#ID#\.txt"]
    cli.main(["evaluate", str(tmp_path / "sys"), str(tmp_path / "mod"), *pattern])
    assert "rouge_1      R 87.500 P 87.500 F 87.500" in capsys.readouterr().out
    cli.main(["to-spl", str(tmp_path / "sys"), str(tmp_path / "spl")])
    cli.main(["config", str(tmp_path / "sys"), str(tmp_path / "mod"), str(tmp_path / "xml"), *pattern])
    assert "<EVAL ID=" in "".join(p.read_text() for p in (tmp_path / "xml").glob("part*"))


def test_write_summaries(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "system", "a b"), ("d1", "oracle", "a")], "doc string, kind string, summary string")
    texts.write_summaries(rows, str(tmp_path / "s"))
    assert [p.read_text() for p in (tmp_path / "s" / "doc=d1" / "kind=system").glob("part*")] == ["a b\n"]


def test_missing_folder_is_empty(spark, tmp_path):
    assert blocks.read_folder(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a-1.txt").write_text("x")
    assert [tuple(r) for r in blocks.read_folder(spark, str(tmp_path)).collect()] == [("a-1.txt", "x")]


def test_edge_keys(spark):
    rows = spark.createDataFrame([("b", "r", "a"), ("a", "r", "b"), ("a", "q", "b")], "concept1 string, relation string, concept2 string")
    different = [jamr.with_key(rows, k).select("key").distinct().count() for k in (jamr.exact_key, jamr.ordered_key, jamr.unordered_key)]
    assert different == [3, 2, 1]


def test_report_of_systems(spark, tmp_path):
    for system, text in (("one", "a b c d"), ("two", "a b x y")):
        (tmp_path / "s" / system).mkdir(parents=True)
        (tmp_path / "s" / system / "S.1.txt").write_text(text)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "M.A.1.txt").write_text("a b c d")
    args = argparse.Namespace(systems=str(tmp_path / "s"), models=str(tmp_path / "m"), system_pattern=r"S\.(\d+)\.txt", model_pattern=r"M\.[A-D]\.#ID#\.txt", spl=False, project=False)
    assert cli.report(spark, args) == [("one", 100.0, 100.0, 100.0), ("two", 50.0, 50.0, 50.0)]


def test_pairs_of_a_block_need_no_join(spark):
    rows = [("f", 0, 3, "c"), ("f", 0, 1, "a"), ("f", 0, 2, "b"), ("f", 1, 1, "d"), ("g", 0, 1, "a"), ("g", 0, 1, "b")]
    pairs = jamr.cooccurring(spark.createDataFrame(rows, "file string, block int, first int, concept string"))
    assert sorted((r["file"], r["block"], r["concept1"], r["concept2"]) for r in pairs.collect()) == [("f", 0, "a", "b"), ("f", 0, "a", "c"), ("f", 0, "b", "c")]
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_node_spans_need_no_join(spark):
    from tessera.plans import blocktables

    nodes, _ = blocks.mentions_of(blocks.sentences_of(blocks.records_of(blocks.blocks_of(blocktables.graph_files(spark, "/root/testdata/sf0.001")))))
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") == 1


def test_spans_of_alignments():
    from tessera.functions.penman import spans_of

    assert spans_of("3-4|0.1 0-1|0+0.1  x 5-6|0.2\t1-9|0.1") == {"0.1": (0, 9), "0": (0, 1), "0.2": (5, 6)}
    assert spans_of(None) == spans_of("") == {}


def test_own_percepts_need_no_shuffle(spark):
    rows = [(1, "say-01", "b", "x", "0", "0.1", 1), (2, "say-01", None, "y", "0", "0.0", 0)]
    edges = spark.createDataFrame(rows, "edge_id long, concept1 string, concept2 string, relation string, g1 string, g2 string, label int")
    own, joined = edgefilter.vectors(edges), edgefilter.vectors(edges, edgefilter.percepts(edges))
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    assert own.orderBy("edge_id").select("edge_id", "features").collect() == joined.orderBy("edge_id").select("edge_id", "features").collect()


def test_pairs_of_whole_files(spark):
    """Counts of a file's pairs equal those of the table operators; neither lines nor pairs are rows."""
    from tessera.plans import blocktables

    odd = "(a1 / C, next, b / d)\r\n (a1 / c, next, a1 / d), (e / c)\nx (f / g)\n(\n  \n(h / C\u00e4, next, h / c\u00c4)\n\n(i / d)"
    files = blocktables.triple_files(spark, "/root/testdata/sf0.001").unionByName(spark.createDataFrame([("odd", odd), ("none", ""), ("null", None)], "file string, content string"))
    pairs = jamr.cooccurring(jamr.handles_of_lines(blocks.lines_of(files)))
    wanted = pairs.groupBy("file", "concept1").agg(F.count("*").alias("n"), F.countDistinct("concept2").alias("partners"))
    found = jamr.pair_counts(files)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert {r["concept1"] for r in found.where("file = 'odd'").collect()} == {"c", "d"}
    plan = blocktables.handle_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
