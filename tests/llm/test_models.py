"""Language identification, toxicity and language-model scores."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, mixlm, toxicity
from tessera.llm.common import portions

EN = ["the cat sat on the mat and the dog ran over the hill", "there is a house where the river bends"]
DE = ["der hund lief über die straße und die katze schlief", "ein haus steht dort wo der fluss sich biegt"]
DOCS = "doc_id long, text string, lang string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "extra") for i, t, lang in rows], DOCS)


def corpus(spark):
    rows = [(i, EN[i % 2] + f" {i}", "en") for i in range(20)] + [(100 + i, DE[i % 2] + f" {i}", "de") for i in range(20)]
    return docs(spark, rows + [(200, None, "en"), (201, "x", None)])


def ppm_bits(text, words, order):
    """Code length by the definition: counts of the training words, escapes of method C."""
    counts = {}
    for w, n in words.items():
        b = b" " + w + b" "
        for i in range(1, len(b)):
            for k in range(min(i, order) + 1):
                counts.setdefault(b[i - k : i], Counter())[b[i]] += n
    total = 0.0
    for w in text.split():
        b = b" " + w + b" "
        for i in range(1, len(b)):
            for k in range(min(i, order), -1, -1):
                seen = counts.get(b[i - k : i])
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if b[i] in seen:
                    total -= math.log2(seen[b[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
            else:
                total += 8
    return total


def test_ppm_is_exact():
    texts = {"en": [t.encode() for t in EN], "de": [t.encode() for t in DE]}
    model = langid.PpmModel(texts)
    for t in [*EN, *DE, "the straße xyz", "a"]:
        own = model.word_bits(t.encode().split()).sum(axis=0)
        for i, lang in enumerate(model.langs):
            words = Counter(w for x in texts[lang] for w in x.split())
            assert own[i] == pytest.approx(ppm_bits(t.encode(), words, langid.ORDER))


def test_language(spark):
    known = corpus(spark)
    model = langid.train(known, usable=F.lit(True))
    assert model.langs == ["de", "en"]
    odd = docs(spark, [(1, "where is the house", None), (2, "wo ist die straße", None), (3, None, "en"), (4, "", None), (5, "12 34 !", None), (6, "the cat " * 50_000, None), (1, "where is the house", None)])
    found = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6)] == ["en", "de", "und", "und", "und", "en"]
    assert found[3]["score"] == 0 and 0.5 < found[1]["score"] <= 1
    kept = langid.accept(odd, model)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 2, 6]
    empty = odd.where("false")
    assert langid.predict(empty, model).count() == 0
    nothing = langid.train(empty, usable=F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}


def subsequence_kernel(a, b):
    """The kernel by enumeration of all triples within reach."""
    def phi(w):
        s = "\0" + w + "\1"
        out = Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.REACH)):
                    out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = phi(a), phi(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[t] for t, v in x.items()) / norm


def test_kernel():
    words = ["idiot", "idxiot", "banana", "a", "tree"]
    k = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert k[i, j] == pytest.approx(subsequence_kernel(a, b))


def test_units():
    assert toxicity.units(b"You are an i d i o t now") == ["you", "are", "an", "i", "d", "o", "t", "now", "i d i o t"]
    assert toxicity.units(b"") == []


def toxic_corpus(n=120):
    rng = np.random.default_rng(1)
    words = ["river", "house", "green", "walk", "table", "light", "paper", "stone", "cloud", "music", "garden", "window"]
    rows = []
    for i in range(n):
        own = list(rng.choice(words, 25))
        bad = i % 4 == 0
        if bad:
            own[5], own[9] = rng.choice(["idiot", "moron", "scum"], 2)
        rows.append((i, " ".join(own), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_corpus()
    known = docs(spark, [(i, t, None) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(0, 1, "again"), (999, None, ""), (None, 1, "")], "doc_id long, toxic int, text string")
    model = toxicity.train(known, labels, usable=F.col("doc_id") % 3 != 1)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.scores(known, model).collect()}
    assert all(found[i] == y for i, _, y in rows if i % 3 == 1)
    odd = docs(spark, [(1, "you i d i o t there house", None), (2, "what an id*iot you house river", None), (3, None, None), (4, "", None), (5, "house river " * 30_000, None), (6, "an i.d.i.o.t walk", None)])
    found = {r["doc_id"]: r["predicted"] for r in toxicity.scores(odd, model).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}
    kept = toxicity.reject(odd, model)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    assert toxicity.scores(odd.where("false"), model).count() == 0
    none = toxicity.train(known, labels.where("toxic = 0"), usable=F.lit(True))
    assert toxicity.scores(known, none).agg(F.max("predicted")).first()[0] == 0
    assert toxicity.scores(known, toxicity.train(known, labels.where("false"), usable=F.lit(True))).count() == len(rows)


def test_huffman_is_a_code():
    weights = np.array([5.0, 1, 1, 3, 9, 0])
    paths = mixlm.huffman(weights)
    codes = {"".join(str(b) for _, b in p) for p in paths}
    assert len(codes) == 6 and not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert sum(2.0 ** -len(c) for c in codes) == pytest.approx(1)
    assert len({n for p in paths for n, _ in p}) == 5 and all(p[0][0] == 0 for p in paths)


def test_scores(spark):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    rows = [(i, " ".join(rng.choice(words, 30)), None) for i in range(60)]
    train = docs(spark, rows)
    model, counts = mixlm.train(train, usable=F.col("doc_id") % 5 != 1)
    odd = docs(spark, [(1, "Alpha beta unseen\x0bgamma", None), (2, None, None), (3, "", None), (4, "alpha " * 40_000, None), (5, "x" * 3000, None), (1, "Alpha beta unseen\x0bgamma", None)])
    found = {r["doc_id"]: r for r in mixlm.scores(odd, model, counts).collect()}
    c = Counter(w for i, t, _ in rows if i % 5 != 1 for w in [*t.split(), "\0"])
    n, v = sum(c.values()), len(c)
    base = lambda ws: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
    assert found[1]["base_score"] == pytest.approx(base(["alpha", "beta", "unseen", "gamma", "\0"]))
    assert (found[1]["n_tokens"], found[1]["n_known"], found[1]["train_tokens"]) == (5, 4, n)
    assert found[2]["base_score"] == found[3]["base_score"] == pytest.approx(base(["\0"])) and found[2]["bits_per_byte"] is None
    assert found[4]["n_tokens"] == 40_001 and found[4]["score"] < 0 and found[5]["n_known"] == 1
    assert found[4]["score"] > found[4]["base_score"]
    nothing, none = mixlm.train(odd.where("false"), usable=F.lit(True))
    assert mixlm.scores(odd, nothing, none).count() == 6
    assert mixlm.scores(odd.where("false"), model, counts).count() == 0


def test_mixing_is_a_probability():
    """Over all texts of up to one word, probabilities sum to at most one, and a text's is the same beside others."""
    words = [b"a", b"b", b"c", b"d"]
    counts = np.array([40, 30, 20, 15, 1])
    n, v = np.zeros(mixlm.GROUPS, dtype=np.int64), np.zeros(mixlm.GROUPS, dtype=np.int64)
    for t, c in zip([mixlm.END, *words], counts):
        n[mixlm.group_of(t)] += c
        v[mixlm.group_of(t)] += 1
    vocabulary = mixlm.Vocabulary([mixlm.END, *words], counts, 106, 5, n, v, 0.5)
    rng = np.random.default_rng(0)
    logits = rng.normal(size=int(mixlm.ROWS[-1]) * mixlm.CLASSES).astype(np.float32)
    spelling = rng.normal(size=(mixlm.ORDERS, mixlm.SLOTS)).astype(np.float16)
    model = mixlm.MixModel(vocabulary, spelling, np.full((mixlm.DEPTHS, mixlm.ORDERS), 0.5), logits, mixlm.start_weights())
    worker, speller = mixlm.Worker(vocabulary), mixlm.Speller(model)
    texts = [b"", *words, *[bytes([c]) for c in range(97, 123) if bytes([c]) not in words], b"zz", b"zq"]

    def total(some):
        bits = mixlm.Bits(worker, some).part()
        out = np.bincount(bits.of_text, mixlm.stretch_costs(bits, vocabulary, logits, model.start), len(some)) + bits.choices()
        lane, _, tokens, _, once = bits.unknown()
        return 2 ** (out + np.bincount(lane, once * speller.cost(tokens) / np.log10(2), len(some)) if len(lane) else out)

    whole = total(texts)
    assert (whole > 0).all() and whole.sum() <= 1
    assert whole == pytest.approx([total([t])[0] for t in texts])


def test_portions():
    assert list(portions([b"aa", b"b", b"ccc"], 3)) == [(0, 2), (2, 3)]
    assert list(portions([b"a" * 9, b"b"], 3)) == [(0, 1), (1, 2)]
    assert list(portions([], 3)) == []
