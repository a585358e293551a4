"""Decontamination, extraction, packing, near-duplicates of documents."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, htmltext, packing, simhash
from tessera.llm.components import connected_components

SCHEMA = "doc_id long, text string, edits string, component_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def plain_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for t in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != t))
        best = min(best, row[-1])
    return best


def test_best_distance():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(1, 5, rng.integers(0, 20))
        assert decontam.best_distance(a, b) == plain_distance(a.tolist(), b.tolist())


def edited(words, share, rng, voc):
    words = list(words)
    for _ in range(int(share * len(words))):
        p, how = rng.randrange(len(words)), rng.randrange(3)
        if how == 0:
            words[p] = rng.choice(voc)
        elif how == 1:
            words.insert(p, rng.choice(voc))
        else:
            del words[p]
    return words


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_recall(share):
    rng = random.Random(4)
    voc = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(voc, k=rng.randint(5, 70))).encode()) for i in range(60)]
    finder = decontam.Finder(items)
    hits = 0
    for i, t in items:
        text = rng.choices(voc, k=50) + edited(t.decode().split(), share, rng, voc) + rng.choices(voc, k=50)
        hits += i in {finder.ids[k] for k in finder.find([" ".join(text).encode()])[0]}
    assert hits >= (60 if share == 0 else 57)


def test_against_brute_force(spark):
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(voc, k=rng.randint(5, 30)))) for i in range(25)] + [(99, "too short"), (98, None)]
    rows = []
    for d in range(60):
        text = rng.choices(voc, k=rng.randint(0, 60))
        if d % 3 == 0:
            text[10:10] = edited(items[rng.randrange(25)][1].split(), rng.choice([0, 0.1, 0.2]), rng, voc)
        rows.append((d, " ".join(text).upper() + "."))
    rows += [(100, None), (101, ""), (0, rows[0][1])]
    table = spark.createDataFrame(items + [(None, "a b c d e f")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.contaminated(docs(spark, rows), table).collect()}
    wanted = {}
    for d, t in rows:
        s = decontam.symbols((t or "").encode())
        for i, x in items:
            p = decontam.symbols((x or "").encode())
            if len(p) >= decontam.MIN_WORDS and (e := plain_distance(p.tolist(), s.tolist())) <= int(0.2 * len(p)):
                wanted[d, i] = e
    assert set(found) <= set(wanted) and len(found) >= 0.95 * len(wanted) and all(found[k] >= wanted[k] for k in found)
    assert all(k in found for k, e in wanted.items() if e == 0)
    kept = decontam.clean(docs(spark, rows), table)
    assert kept.columns == ["doc_id", "text", "edits", "component_id"]
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in found}
    assert decontam.contaminated(docs(spark, rows), table.where("false")).count() == 0
    assert decontam.contaminated(docs(spark, []), table).count() == 0


def test_short_and_unspaced_items(spark):
    solid = "\u5929\u7a7a\u662f\u84dd\u8272\u7684\u800c\u8349\u662f\u7eff\u8272\u7684"
    items = [(1, "Yes!"), (2, "blue sky"), (3, "one two three four"), (4, solid), (5, "blue SKY."), (6, "..."), (7, "a b c d e f"), (8, "a b c d e f")]
    rows = [
        (0, "yes"), (1, "oh yes, it is"), (2, "under a Blue, sky blue sky"), (3, "blue. Sky"), (4, "one two three"), (5, "one two x three four"),
        (6, "\u56e0\u4e3a" + solid + "\u3002"), (7, "x " + solid[:5] + "\u9ec4" + solid[6:] + " y"), (8, solid[:6]), (9, "0 a b c d e f 0"), (10, None), (11, ""),
        (12, "one two three four and more"), (13, "blue"), (14, "sky"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    every = decontam.contaminated(docs(spark, rows), table).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in every} == {
        (0, 1): 0, (1, 1): 0, (2, 2): 0, (2, 5): 0, (3, 2): 0, (3, 5): 0, (6, 4): 0, (7, 4): 1, (9, 7): 0, (9, 8): 0, (12, 3): 0,
    }
    # Of a short item the place is the item's own; of a longer one that of the window that found it.
    assert {(r["doc_id"], r["word_at"]) for r in every if r["item_words"] < 5} == {(0, 0), (1, 1), (2, 2), (3, 0), (12, 0)}
    # A short item is a reason to drop what is nothing else.
    assert {r["doc_id"] for r in decontam.clean(docs(spark, rows), table).collect()} == {d for d, _ in rows} - {0, 3, 6, 7, 9}


def test_many_equal_items():
    item = b"the same question is asked again and again by all of them"
    finder = decontam.Finder([(i, item) for i in range(5000)])
    assert len(finder.items) == 1 and len(finder.all_ids[0]) == 5000
    held, none = finder.find([b"so " + item + b" here", b"nothing"])
    assert {k: e for k, (e, _) in held.items()} == {0: 0} and none == {}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href=1>Home</a><li><a href=2>More</a></ul></nav>%s
<div class="sidebar"><p>Side text that is rather long, to be as dense as an article might be.</p></div>
<section id="comments"><p>A reader's comment that is rather long, too, and should not be taken.</p></section>
<form><p>Subscribe</p></form><footer>&copy; all of it</footer><script>if (1<2) "</p>"</script></body></html>"""


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><h1>Title &amp; more</h1><p>First  one\nhere.<br>Second line<p><b>Third &eacute;<div class=ad>Buy</div></article>", "Title & more\n\nFirst one here. Second line\n\nThird é"),
        ("<main>Bare text<p>one</p>tail</main>", "Bare text\n\none\n\ntail"),
        ("<div class=post><h2>Head line</h2><p>" + "word " * 40 + "</p><p>" + "text " * 30 + "</p></div>", "Head line\n\n" + ("word " * 40).strip() + "\n\n" + ("text " * 30).strip()),
        ("<article><div class='notice'>Cookies</div><p>Only this.</p><aside>No</aside><ul><li>a point<li>another</ul></article>", "Only this.\n\na point\n\nanother"),
        ("<article><!-- no --><p>a &lt;b&gt; c</p><table><tr><td>x<td>y</table></article>", "a <b> c\n\nx\n\ny"),
        ("<article><p>Kept <a title='a>b' href=x>linked</a> words.</p><p hidden>gone</p></article>", "Kept linked words."),
    ],
)
def test_extract(body, text):
    assert htmltext.extract(PAGE % body) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><div id='promo-feature'><article><h1>A</h1><p>one two</p></article></div><div class=promo><p>Buy it all now</p></div></body>", "A\n\none two"),
        ("<body><h1>Top</h1><div class='share-story'>%s</div></body>" % ("<p>" + "long words " * 30 + "</p>"), ("long words " * 30).strip()),
        ("<body><div class='post has-comments no-sidebar'><p>Here it is.</p></div><div id=comments><article class=comment><p>%s</p></article></div></body>" % ("me too " * 50), "Here it is."),
        ("<body><form action=x><article><p>In a form.</p><form><p>Mail me</p></form></article></form></body>", "In a form."),
        ("<body><article class='comment'><p>First!</p></article><main><p>Story.</p></main></body>", "Story."),
    ],
)
def test_names_do_not_drop_the_article(html, text):
    assert text in htmltext.extract(html) and not any(x in htmltext.extract(html) for x in ("Buy", "me too", "Mail", "First"))


def test_densities_part_an_article():
    """No name or element tells the blocks apart here, only how much of them is links."""
    prose = "<div><p>" + "plain words of prose " * 20 + "</p><p>Short.</p><p>With <a href=1>one link</a> in it, as prose has.</p></div>"
    links = "<div>" + "".join(f"<p><a href={i}>Another story {i}</a></p>" for i in range(8)) + "</div>"
    for wrap in ("<body><article>%s%s</article></body>", "<body><div>%s%s</div></body>"):
        text = htmltext.extract(wrap % (prose, links))
        assert "Another" not in text and "Short." in text and "one link" in text


def test_density_by_definition():
    """Counts and densities of a page against a plain reading of it by another parser."""
    from html.parser import HTMLParser
    from math import e, log

    html = "<body><div><p>abc <b>de</b></p><p><a>link</a> fgh</p></div><ul><li><a>x</a></li><li><a>y</a> <i>zz</i></li></ul></body>"

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.all = [], []

        def handle_starttag(self, tag, attrs):
            for x in self.open:
                x[3] += 1
                x[4] += tag == "a"
            self.open.append([tag, 0, 0, 0, 0])
            self.all.append(self.open[-1])

        def handle_endtag(self, tag):
            self.open.pop()

        def handle_data(self, data):
            n = len(data.replace(" ", ""))
            for x in self.open:
                x[1] += n
                x[2] += n * any(y[0] == "a" for y in self.open)

    plain = Plain()
    plain.feed(html)
    _, bc, blc, _, _ = plain.all[0]

    def by_definition(c, lc, t, lt):
        lcs, t, lts = lc or 1, t or 1, lt or 1
        return c / t * log(max(c / lcs * t / lts, 1 + 1e-9)) / log(log(c / (c - lc or 1) * lc + blc / bc * c + e))

    root = htmltext.parse(html)
    order = htmltext._measure(root)
    found = sorted((b.tag, b.chars, b.link_chars, b.tags, b.links) for b in order if b is not root)
    assert found == sorted(map(tuple, plain.all))
    for b in order:
        if b is not root:
            assert htmltext.density(b, root) == pytest.approx(by_definition(b.chars, b.link_chars, b.tags, b.links))


@pytest.mark.parametrize("html", ["<div>" * 30_000 + "</p></span>" * 30_000, "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000, "<div>" * 30_000 + "<body>" * 30_000, "<div class=promo>" * 30_000 + "x"])
def test_work_grows_with_the_page(html):
    import time

    began = time.time()
    htmltext.extract(html)
    assert time.time() - began < 10


def test_pages(spark):
    rows = [(1, "u", PAGE % "<article><p>Hé</p></article>"), (2, None, None), (3, "u", ""), (4, "u", "plain <3 text"), (5, "u", "<p><b>" * 20_000 + "deep"), (6, "u", "<nav>only menu</nav>"), (1, "u", PAGE % "<article><p>Hé</p></article>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = {r["page_id"]: r for r in htmltext.main_text(pages).collect()}
    assert [found[i]["text"] for i in (1, 2, 3, 4, 5, 6)] == ["Hé", "", "", "plain <3 text", "deep", ""]
    assert found[1]["n_chars"] == 2 and htmltext.main_text(pages).count() == 7 and htmltext.main_text(pages.where("false")).count() == 0


def plain_ids(texts):
    """The file's tokenizer with nothing set."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_tokenizer():
    t = packing.WordTokenizer(packing.default_tokenizer(), cap=40)
    texts = [
        "Hello, world! it's NOT don'T 1234 a1.b2", "naïve ΟΔΟΣ x<|endoftext|>y e\u0301 \x1c a\x85b ﬁ İstanbul", "", "  ", "日本語。 😀",
        " ".join(f"w{i}ord," for i in range(99)), "<|startoftext|> a <|ENDOFTEXT|> <|endoftext|>", "pİ. \u0958! ǅ, ﬁ? Straße; ß. é.. a.. A! .", "\u0958 \u0344a",
    ]
    assert [x.tolist() for x in t(texts)] == plain_ids(texts)


def test_tokenizer_on_mixed_texts():
    rng = random.Random(4)
    bits = list("abZ 'st.,;:!?İıſßﬁ\u0301\u0307\u0958\u0344\u1e9eΣ9१日\u00a0\u2028\x1c\x1f\x85\u200b\u0e33<|>😀") + ["<|endoftext|>", "it's", " the", "Don't "]
    texts = ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzEINÖéß", k=rng.randrange(1, 70))) for _ in range(3000)]
    texts += [f"{a}{b}" for a in ("É", "ǅx", "ŉ", "ſ", "aİ", "Ȿ") for b in (".", ",***", "'s.", "!'", "&&&;", "\u0301.")]
    t = packing.WordTokenizer(packing.default_tokenizer(), cap=500)
    assert [x.tolist() for x in t(texts)] == plain_ids(texts)


def test_ranges(spark):
    rows = [(k << 44, i, bytes(n)) for i, (k, n) in enumerate([(1, 500)] * 40 + [(2, 5000)] + [(9, 100)] * 300 + [(5, 0)])]
    dealt, parts = packing.ranges(spark.createDataFrame(rows, "key long, doc_id long, ids binary"), goal=8000)
    found = dealt.withColumn("n", F.length("ids") + 64).groupBy("part").agg(F.sum("n").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
    assert dealt.count() == len(rows) and max(r["part"] for r in found) < parts and max(r["n"] for r in found) < 2 * 8000
    assert sum(r["n"] for r in found) == sum(len(x) + 64 for _, _, x in rows)
    none, parts = packing.ranges(spark.createDataFrame([], "key long, doc_id long, ids binary"))
    assert none.count() == 0 and parts == 1


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2)])
def test_hilbert(dims, bits):
    grid = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    key = packing.hilbert(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "Gamma!", "x1"], k=rng.choice([0, 3, 50, 900])))) for i in range(60)] + [(500, "long " * 9000), (501, None), (7, "again"), (None, "no id")]
    table = packing.pack(docs(spark, rows), keep_ids=True).toPandas()
    exact = plain_ids([t or "" for _, t in rows])
    for group, part in table.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]]
        size = part.length.sum()
        assert size == part.sequence_length.iloc[0] and (size == 2048 or size & (size - 1) == 0)
    assert (table.ids_crc32 == table.ids.map(zlib.crc32)).all() and table.length.sum() == sum(len(x) + 1 for x in exact)
    for (i, _), ids in zip(rows, exact):
        if i is None or i == 7:
            continue
        own = table[table.doc_id == i].sort_values("start")
        assert np.frombuffer(b"".join(own.ids), dtype="<u4").tolist() == [*ids, 1] and (own.doc_tokens == len(ids) + 1).all()
    assert packing.pack(docs(spark, [])).count() == 0


def components(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(i, i + 1) for i in range(60, 99)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    wanted = components(100, links)
    assert all(found.get(i, i) == wanted[i] for i in range(100))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_manhattan_bounds_hamming():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    near = simhash.manhattan(simhash.popcounts(a), simhash.popcounts(b))
    slow = [sum(abs(bin(int(x) >> (2 * i) & 3).count("1") - bin(int(y) >> (2 * i) & 3).count("1")) for i in range(32)) for x, y in zip(a, b)]
    assert near.tolist() == slow and (near <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("tile", [simhash.TILE, 64])
def test_links_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    fps = [0]
    for s in seeds:
        for _ in range(rng.integers(1, 12)):
            flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64))
            fps.append(int(s ^ flips))
    fps += [int(seeds[0]) ^ (1 << i) for i in range(64)] + [int(seeds[0]) ^ (3 << i) for i in range(63)]
    fps = np.unique(np.array(fps, dtype=np.uint64))
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i] ^ fps[j])).count("1") <= 3]
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = [(place[r["a"]], place[r["b"]]) for r in simhash.fingerprint_links(table).collect()]
    assert all(bin(int(fps[a] ^ fps[b])).count("1") <= 3 for a, b in found)
    assert components(len(fps), found) == components(len(fps), links)


def test_simhash_query(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(5, " ".join(words)), (9, " ".join(words).upper()), (2, None), (3, ""), (4, "one two"), (4, "one two"), (11, "x " * 40_000)]
    found = {r["doc_id"]: r for r in simhash.simhash_components(docs(spark, rows)).collect()}
    assert found[2]["fingerprint"] == "0" * 16 and found[3]["component_id"] == 2 and found[9]["component_id"] == 5
    h = spark.sql("select hex(xxhash64('one two')) h").first()["h"].lower().rjust(16, "0")
    assert found[4]["fingerprint"] == h
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_keep_one(spark):
    rng = random.Random(9)
    voc = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(25):
        base = rng.choices(voc, k=rng.choice([6, 60, 300]))
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(voc)
            rows.append(" ".join(own))
    rng.shuffle(rows)
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    wanted = {i for i, r in enumerate(components(len(rows), links)) if i == r}
    table = docs(spark, [*enumerate(rows), (900, None), (901, ""), (None, rows[0])])
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == wanted | {900, 901, None}
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_tokens_of_a_mixed_model():
    """Tokens are parted and lowered as bytes are; what is known of frequent ones is not worked out again with every portion."""
    from tessera.llm import mixlm

    r = random.Random(5)
    pieces = [*b" \t\n\x0b\x0c\r\x00\x1c\x1f\x85aBz", *"É", *"İ", " ", " "]
    pieces = [bytes([x]) if isinstance(x, int) else x.encode() for x in pieces]
    for _ in range(100):
        texts = [b"".join(r.choices(pieces, k=r.randint(0, 12))) for _ in range(r.randint(0, 8))]
        bounds, which, words = mixlm.split_words(texts)
        assert [[words[i] for i in which[a:b]] for a, b in zip(bounds, bounds[1:])] == [[*t.lower().split(), mixlm.END] for t in texts]

    zero = np.zeros(mixlm.GROUPS, dtype=np.int64)
    known = [mixlm.END, *[b"w%d" % i for i in range(300)]]
    worker = mixlm.Worker(mixlm.Vocabulary(known, np.full(301, 2), 700, 400, zero + 20, zero + 12, 0.5))
    asked = []
    describe = worker.describe
    worker.describe = lambda words, *a: asked.extend(words) or describe(words, *a)
    for i in range(3):
        bits = mixlm.Bits(worker, [b" ".join(known[1:]) + b" new%d" % i])
        assert (bits.known[:300] == np.arange(1, 301)).all() and bits.known[300:].tolist() == [-1, 0]
    assert asked == [b"new0", b"new1", b"new2"]
