"""Operators whose results grow with the corpus, compared with plain versions on whole tables of their own."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, mixlm, simhash


def test_mixlm_counts_all_training_texts(spark):
    docs = spark.createDataFrame([(i, "one two three four " * 3) for i in range(60)] + [(60, "kappa lambda " * 4000)], "doc_id long, text string")
    model, _ = mixlm.train(docs, usable=F.lit(True))
    assert float(model.logits.max()) > np.log(3000 / mixlm.SPREAD)


@pytest.mark.parametrize("sf", ["0.01"])
def test_mixlm_beats_frequencies_on_texts_it_never_saw(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    usable = common.remainder("doc_id", 5) != 1
    model, counts = mixlm.train(docs, usable)
    found = mixlm.scores(docs, model, counts, trained=usable).where(common.remainder("doc_id", 5) == 1)
    own, base = found.agg(F.sum("score"), F.sum("base_score")).first()
    assert own > base


def test_mixlm_hears_copies(spark):
    """A text that another training text holds costs little; one that only it holds itself isn't known by heart."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    texts = [" ".join(word() for _ in range(80)) for _ in range(40)]
    rows = list(enumerate(texts + texts[:5]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = mixlm.train(docs, F.col("doc_id") < 42)
    found = {x["doc_id"]: x["bits_per_byte"] for x in mixlm.scores(docs, model, counts, trained=F.col("doc_id") < 42).collect()}
    copied, alone = [found[i] for i in (0, 1, 40, 41, 42, 43, 44)], [found[i] for i in range(2, 40)]
    assert max(copied) < 0.5 * min(alone)


def test_mixlm_end_is_no_word(spark):
    docs = spark.createDataFrame([(1, "a \x00 b"), (2, "\x00")], "doc_id long, text string")
    model, counts = mixlm.train(docs, F.lit(True))
    found = {x["doc_id"]: x for x in mixlm.scores(docs, model, counts).collect()}
    c = Counter({"a": 1, "b": 1, "\0": 2, "end": 2})
    base = lambda ws: sum(np.log10((c[w] + 0.5) / (6 + 0.5 * 5)) for w in ws)
    assert found[1]["n_tokens"] == 4 and found[1]["n_known"] == 4 and found[1]["base_score"] == pytest.approx(base(["a", "\0", "b", "end"]))
    assert found[2]["base_score"] == pytest.approx(base(["\0", "end"]))


def test_phrases_by_definition():
    words = mixlm.Vocabulary([], np.zeros(0, dtype=np.int64), 0, 0, np.zeros(mixlm.GROUPS, dtype=np.int64), np.zeros(mixlm.GROUPS, dtype=np.int64), 0.5)
    worker = mixlm.Worker(words)
    r = random.Random(1)
    texts = [" ".join(r.choices("abcdefghijklmnop", k=r.randrange(200))).encode() for _ in range(20)] + [b"x " * 100, b""]
    bits = mixlm.Bits(worker, texts).part()
    import xxhash

    at = 0
    for i, t in enumerate(texts):
        parts, part = [], []
        for w in t.split():
            part.append(w)
            if xxhash.xxh64_intdigest(w) % mixlm.CLOSING == 0 or len(part) == mixlm.MOST:
                parts.append(tuple(part))
                part = []
        parts += [tuple(part)] if part else []
        whole = [p for p in parts if len(p) >= mixlm.LEAST]
        assert bits.asked[i] == len(set(whole))
        assert int(bits.again[(bits.of_text == i)].sum()) == len(whole) - len(set(whole))
        at += len(parts) + 1
    assert at == len(bits.first)


def test_choices_are_a_probability():
    """Adaptive choices predicted one by one."""
    def plain(seq):
        counts, before, total = {0: list(mixlm.AFTER_NO), 1: list(mixlm.AFTER_YES)}, 0, 0.0
        for x in seq:
            yes, no = counts[before]
            total += np.log2((yes if x else no) / (yes + no))
            counts[before][0 if x else 1] += 1
            before = x
        return total

    import pyarrow as pa

    r = random.Random(2)
    seqs = [[int(r.random() < p) for _ in range(n)] for p in (0.05, 0.5, 0.9) for n in (0, 1, 7, 60)]
    heard = pa.array([[i for i, x in enumerate(s) if x] for s in seqs], pa.list_(pa.int64()))
    t = mixlm.heard_tally(heard, np.array([len(s) for s in seqs]))
    found = mixlm.choice_cost(t[0], t[1], *mixlm.AFTER_NO) + mixlm.choice_cost(t[2], t[3], *mixlm.AFTER_YES)
    assert found.tolist() == pytest.approx([plain(s) for s in seqs], abs=1e-6)


def test_groups_are_the_same_in_sql(spark):
    tokens = [b"a", b"ab", b"abc", "straße".encode(), b" "]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, token binary").select("i", mixlm.group_column("token").alias("g")).collect()
    assert [r["g"] for r in sorted(found)] == [mixlm.group_of(t) for t in tokens]


def test_near_duplicates_equal_all_pairs(spark):
    r = random.Random(3)
    source = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(120):
        words, share = list(source), 0.008 if i % 10 == 9 else 0.027
        for j in range(len(words)):
            if r.random() < share:
                words[j] = f"x{i}_{j}"
        texts.append(" ".join(words))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert dict(map(tuple, found.collect())) == {i: root(i) for i in range(len(texts)) if root(i) != i}



def test_near_duplicates_of_a_template(spark):
    """Texts of one template, most pairs below 0.8: links between those that are no hub are found, too."""
    r = random.Random(11)
    source = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(400):
        words = list(source)
        # A bush of close texts around each of many variants, which are further apart.
        for j in random.Random(i % 40).sample(range(300), 6):
            words[j] = f"v{j}_{i % 40}"
        for j in r.sample(range(300), 2 + i % 3):
            words[j] = f"u{i}_{j}"
        texts.append(" ".join(words))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    shared = []
    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            shared.append(same / (len(a) + len(sets[j]) - same))
            if shared[-1] >= 0.8:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    wanted = {i: root(i) for i in range(len(texts)) if root(i) != i}
    found = dict(map(tuple, simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    assert np.median(shared) < 0.7 and len(wanted) > 100
    assert sum(found.get(i) == c for i, c in wanted.items()) >= 0.99 * len(wanted) and set(found) <= set(wanted)


def test_shared_counts_equal_plain_ones(monkeypatch):
    r = np.random.default_rng(4)
    common = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[r.choice(common, 45), r.integers(0, 300, 12).astype(np.uint64)]) for _ in range(130)] + [np.zeros(0, dtype=np.uint64)]
    monkeypatch.setattr(simhash, "PAIRS", 50)
    monkeypatch.setattr(simhash, "COLUMNS", 16)
    left, right = np.arange(0, 131, 2), np.arange(1, 131)
    found = simhash.shared_counts(sets, left, right)
    wanted = np.array([[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left])
    assert (found == wanted)[left[:, None] != right[None, :]].all()


@pytest.mark.parametrize("texts", [simhash.TEXTS, 128])
def test_near_duplicates_of_a_family_make_few_rows(spark, monkeypatch, texts):
    """400 near copies, many pairs below 0.8: joins make rows in proportion to the texts, in one piece and in tiles."""
    monkeypatch.setattr(simhash, "TEXTS", texts)
    r = random.Random(8)
    rows = []
    for i in range(400):
        words = [f"w{j}" for j in range(150)]
        for j in r.sample(range(150), r.choice([1, 3, 5])):
            words[j] = f"u{i}_{j}"
        rows.append((i, " ".join(words)))
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    made = [0]
    for i in range(seen, store.executionsCount()):
        if store.execution(i).isDefined():
            values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
            for node in (nodes.apply(k) for k in range(nodes.size())):
                if "Join" in node.name():
                    metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                    got = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                    made += [int(v.get().replace(",", "")) for v in got if v.isDefined()]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    near = [[j for j in range(400) if len(a & sets[j]) >= 0.8 * len(a | sets[j])] for a in sets]
    reached, todo = {0}, [0]
    while todo:
        fresh = set(near[todo.pop()]) - reached
        reached |= fresh
        todo += fresh
    assert 200 < len(reached) < 400 and max(made) <= 20 * 400
    assert {d for d, c in map(tuple, found) if c == 0} == reached - {0}


def _made(spark, seen):
    """The most rows that a join or an explode of the executions since ``seen`` made, but for those of band keys and cells."""
    store, made = spark._jsparkSession.sharedState().statusStore(), [0]
    for i in range(seen, store.executionsCount()):
        if store.execution(i).isDefined():
            values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
            for node in (nodes.apply(k) for k in range(nodes.size())):
                if "Join" in node.name() or "Generate" in node.name():
                    metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                    got = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                    made += [int(v.get().replace(",", "")) for v in got if v.isDefined()]
    return max(made)


@pytest.mark.parametrize("apart", [False, True])
def test_similar_texts_of_a_large_home_are_read_a_few_times(spark, monkeypatch, apart):
    """Rows of a home in 25 blocks grow with its texts; links outside its largest component are found, too."""
    monkeypatch.setattr(simhash, "TEXTS", 64)
    r = np.random.default_rng(2)
    core, far = r.integers(0, 1 << 62, (2, 60), dtype=np.uint64)
    rows, wanted = [], []
    for i in range(800):
        close = i % 50 and not apart
        own = np.r_[core[:56], r.integers(0, 1 << 62, 4, dtype=np.uint64)] if close else r.integers(0, 1 << 62, 60, dtype=np.uint64)
        if i % 200 == 150:
            own = np.r_[far[:56], own[:4]]
            wanted.append(i)
        rows.append((i, bytearray(np.unique(own).tobytes())))
    sets = spark.createDataFrame(rows, "id long, shingles binary").withColumn("size", F.length("shingles"))
    homes = spark.range(800).select(F.lit(7).cast("long").alias("home"), "id")
    common.prepare(spark)
    seen = spark._jsparkSession.sharedState().statusStore().executionsCount()
    links = simhash._similar(homes, sets, 0.8).collect()
    if not apart:
        assert _made(spark, seen) <= 3 * 800
    group = {i: i for i in range(800)}
    for a, b in links:
        x, y = group[a], group[b]
        group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    close = [i for i in range(800) if i % 50 and not apart]
    assert len({group[i] for i in wanted}) == 1 and len({group[i] for i in close}) <= 1
    assert len(set(group.values())) == 800 - len(wanted) + 1 - max(0, len(close) - 1)


def test_mixlm_weights_come_from_all_training_texts(spark, monkeypatch):
    """Every training text and every word is read for the mixing weights, each by tables that lack it."""
    texts = [f"w{i} x{i % 7} one two three" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    read = []
    monkeypatch.setattr(mixlm, "newton_sums", _bits_read)
    monkeypatch.setattr(mixlm, "newton_step", lambda parts, w: read.append(sum(np.frombuffer(r["sums"])[0] for r in parts.collect())) or w)
    model, _ = mixlm.train(docs, F.lit(True))
    words = model.words
    split = [[*t.encode().split(), mixlm.END] for t in texts]
    kinds = [words.ids[w] if words.ids[w] < words.singles else words.singles + mixlm.group_of(w) for t in split for w in t]
    assert read == [len(words.spell([w for w in words.tokens if w != mixlm.END])[2]), len(words.paths.spread(np.array(kinds))[0])]


def _bits_read(x, y, gate, w):
    out = np.zeros((len(w), len(x), len(x) + 1))
    out[0, 0, 0] = len(y)
    return out


def test_newton_step_finds_the_best_weights(spark):
    r = np.random.default_rng(6)
    x, gate = r.normal(size=(3, 60_000)).astype(np.float32), r.integers(0, 2, 60_000)
    true = np.array([[0.9, -0.2, 0.4], [0.1, 0.6, 0.3]])
    y = (r.random(60_000) < 1 / (1 + np.exp(-(true[gate].T * x).sum(axis=0)))).astype(np.int8)
    w = np.full((2, 3), 0.4)
    for _ in range(4):
        halves = [mixlm.newton_sums(x[:, a : a + 30_000], y[a : a + 30_000], gate[a : a + 30_000], w) for a in (0, 30_000)]
        w = mixlm.newton_step(spark.createDataFrame([(bytearray(h.tobytes()),) for h in halves], "sums binary"), w)
    assert np.abs(w - true).max() < 0.06
