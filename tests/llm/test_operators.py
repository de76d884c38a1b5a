"""The training-data operators against brute force, on small tables with nulls, empties, repeats and clashing columns."""

import collections
import hashlib
import html
import html.parser
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import decontam, extract, idstore, lm, packing, quality, rules, secrets, simhash, warc
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.tokens import Encoder

SPACE = re.compile("[^\x20\x09-\x0d]+")
PAGES = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, n_chars long, row string, fp long, score double, spans string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return SPACE.findall(lower(t or ""))


def documents(spark, texts, ids=None):
    """Documents with columns whose names clash with what operators add."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "s", 0, "row", 7, 0.5, "x") for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocab = ["the", "and", "Ober", "éa", "rin", "tion", "stone,", "x.", "Über", "ß", "a1"]
    out = [None, "", " ", "\n\t", "one", "one two", "É É É É"]
    for _ in range(n):
        out.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 80))))
    return out + out[10:13] + [out[12] + " the"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus()
    return documents(spark, texts, [*range(len(texts) - 2), 5, None]), list(zip([*range(len(texts) - 2), 5, None], texts, strict=True))


def rows_of(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


# Decontamination -------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def hits(text, items, window):
    w = WORD.findall(lower(text or ""))
    hit, named = set(), set()
    for item, body in items:
        b = WORD.findall(lower(body or ""))
        n = min(window, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[k : k + n]:
                    hit.update(range(j, j + n))
                    named.update([str(item)] if item is not None else [])
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_decontamination(spark, docs, block, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 5)
    df, rows = docs
    items = [(10, rows[20][1]), (9, "ONE"), (2, None), (3, ""), (4, "The, and; the"), (None, "x"), (9, "ONE"), (11, "tion rin tion"), (None, rows[21][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.decontaminate(df, bench, window=4, block_words=block)
    expected = collections.Counter((i, *hits(t, items, 4)) for i, t in rows)
    assert rows_of(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in found.where("contaminated").collect():
        assert any(sum(len(WORD.findall(t[s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"] for t in texts[r["doc_id"]] if t)


def test_segments_have_the_windows():
    for n in (0, 1, 3, 4, 5, 9, 23):
        words = [str(i).encode() for i in range(n)]
        cut = lambda w, n=n: {tuple(w[k : k + min(4, n)]) for k in range(len(w) - min(4, n) + 1)}
        parts = list(decontam.segments_of(words, 4, 5))
        assert set().union(*map(cut, parts)) == cut(words) and max(map(len, parts)) <= 8


def test_many_words_of_a_benchmark(spark):
    """More words than an automaton's states could look through, against a plain search."""
    rng = random.Random(3)
    vocabulary = [f"w{i}".encode() for i in range(30_000)]
    items = [(str(i), [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]) for i in range(2_000)]
    machine = decontam.Machine(items, 6)
    patterns = {tuple(w[k : k + min(6, len(w))]) for _, w in items for k in range(len(w) - min(6, len(w)) + 1)}
    for _ in range(30):
        line = sum((rng.choice([w, w[3:12], [b"else", b"w5"]]) for _, w in rng.sample(items, 6)), [])
        hit = {j for k in range(len(line)) for n in range(1, 7) if tuple(line[k : k + n]) in patterns and k + n <= len(line) for j in range(k, k + n)}
        assert set(np.flatnonzero(machine.hits(line)[0]).tolist()) == hit
    began = time.process_time()
    machine.hits([rng.choice(vocabulary) for _ in range(200_000)])
    assert time.process_time() - began < 2


def test_decontamination_of_nothing(spark, docs):
    df, _ = docs
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(df, none).where("contaminated").isEmpty()
    assert decontam.decontaminate(df.limit(0), none).count() == 0
    carried = decontam.decontaminate(df, none, carry=True).select("row.*")
    assert sorted(carried.columns) == sorted(df.columns) and carried.count() == df.count()


# Extraction ------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site name</a></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="ad">Buy now, really, now.</div>%s<aside>Aside, with words.</aside><section id="comments"><p>I disagree, with all of it.</p></section>
<form><label>Mail</label><input name=x><button>Go</button></form><footer>&copy; us, all rights.</footer></body></html>"""
INSIDE = "<h1>A &amp; B</h1><p><b>First, with &eacute;.<br><p>Second  one\n here, with <a href='x'>a link</a> in it, and more.</p><ul><li>an item<li>another</ul><p>Sh.</p>"
WANTED = "A & B\n\nFirst, with é.\n\nSecond one here, with a link in it, and more.\n\nan item\n\nanother\n\nSh."


@pytest.mark.parametrize("body", [f"<article>{INSIDE}</article>", f"<main><!-- note --><div>{INSIDE}</div></main>", f"<div id=wrap><div class='post-text'>{INSIDE}</div></div>"])
def test_extraction(body):
    assert extract.main_text(PAGE % body) == WANTED


def test_small_articles_are_not_the_text():
    """A teaser in an article element doesn't stand for a page whose text is elsewhere."""
    whole = "".join(f"<p>Part {i} of the text, which is long enough, and has its marks.</p>" for i in range(9))
    wanted = [f"Part {i} of the text, which is long enough, and has its marks." for i in range(9)]
    teaser = "<article><p>A teaser, short.</p></article>"
    for body in (f"<main><div>{whole}</div><div class=more>{teaser}</div></main>", f"<div id=wrap><div>{whole}</div>{teaser}</div>", f"{teaser}<div>{whole}</div>"):
        got = extract.main_text(PAGE % body).split("\n\n")
        assert [x for x in got if x in wanted] == wanted, body
    assert extract.main_text(PAGE % f"<main><div><p>Other, words.</p></div><article>{whole}</article></main>").split("\n\n") == wanted


def test_extraction_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "plain words, no tags."), (4, "u", "<p>cut off <a href='x"), (5, "u", "<script>never closed"), (5, "u", "<p>a</p>"), (6, "u", "<article><p>x &lt;y&gt; &am z")], "page_id long, url string, html string")
    got = rows_of(extract.extract(pages), "page_id", "url", "text", "n_chars")
    assert got == collections.Counter([(1, "u", "", 0), (2, None, "", 0), (3, "u", "plain words, no tags.", 21), (4, "u", "cut off", 7), (5, "u", "", 0), (5, "u", "a", 1), (6, "u", "x <y> &am z", 11)])
    assert html.unescape("&am") == "&am"


class ArticleReader(html.parser.HTMLParser):
    """The blocks inside article elements, by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.held = 0, [], []

    def end_block(self):
        text = " ".join("".join(self.held).split())
        if text:
            self.blocks.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("article", "p", "h1", "h2", "ul", "li", "div"):
            self.end_block()
        if tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1", "h2", "ul", "li", "div"):
            self.end_block()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.held.append(data)


@pytest.mark.skipif(not os.path.isdir(PAGES), reason="no data here")
def test_extraction_agrees_with_a_plain_reading_of_pages(spark):
    pages = spark.read.parquet(f"{PAGES}/pages.parquet")
    wanted = {}
    for r in pages.collect():
        reader = ArticleReader()
        reader.feed(r["html"] or "")
        reader.close()
        wanted[r["page_id"]] = "\n\n".join(reader.blocks)
    got = {r["page_id"]: r["text"] for r in extract.extract(pages).collect()}
    assert len(got) > 20 and got == wanted


def test_ratios_choose_without_names(monkeypatch):
    """No element says which is the article, and none is marked; then ratios that say nothing keep everything."""
    long = "".join(f"<p>Part {i} of the text, which is long enough, and has its marks; some more of it follows here.</p>" for i in range(9))
    page = f"<body><div><div><a href=/>Menu</a></div><div><a href=/a>More</a></div></div><div>Short teaser.</div><section>{long}</section><div>Legal text</div></body>"
    blocks, elements = extract.blocks_of(page)
    assert len(blocks) == 13
    assert [b.text[:4] for b in extract.content_blocks(blocks, elements)] == ["Part"] * 9
    monkeypatch.setattr(extract, "fused_ratios", lambda blocks: np.ones(len(blocks)))
    assert extract.content_blocks(blocks, elements) == blocks


def test_ratios_by_hand():
    page = "<div><p>ab, c.</p><p>abcd</p></div><ul><li><a>xy</a> z!</li></ul>"
    blocks, _ = extract.blocks_of(page)
    w = np.exp(-2.0)
    a, b, c = w / (1 + 2 * w), 1 / (1 + 2 * w), w / (1 + 2 * w)
    text, marks = [5.0, 5.0, 3.0], [1.0, 1.0, 1.0]
    soft = lambda v: [a * v[0] + b * v[0] + c * v[1], a * v[0] + b * v[1] + c * v[2], a * v[1] + b * v[2] + c * v[2]]
    assert extract.fused_ratios(blocks).tolist() == pytest.approx([x * (1 + y) for x, y in zip(soft(text), soft(marks), strict=True)])


HOSTILE = {
    "attributes": "<p>a</p><a " + 'x="y" ' * 170_000,
    "open quotes": "<p>a</p><a " + '="' * 500_001 + "></a>",
    "quoted ends": '<a x=">"' * 120_000,
    "nested": "<div>" * 90_000 + "x" + "</div>" * 90_000,
    "headings": "<h1>" * 100_000 + "x<p>" * 100_000,
    "signs": "<a<" * 300_000,
    "paragraphs": "<p>word, word. " * 60_000,
    "ends": "</b></div>" * 100_000,
    "comments": "<!--" * 250_000,
    "heads": "<div><header class=x>" * 40_000 + "t",
    "references": "&amp" * 250_000,
    "scripts": "<script>" * 120_000,
    "tables": "<table><tr><td>" * 60_000,
    "spans": "<span class=ad>x" * 40_000 + "</span>" * 40_000,
    "paths": "".join(f"<div class=c{i}><p>x, y.</p>" for i in range(30_000)),
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    """A page of about 1 MB; quadratic work takes minutes, and what is meant is a second or few."""
    began = time.process_time()
    extract.main_text(HOSTILE[name])
    assert time.process_time() - began < 12


# Quality vote ----------------------------------------------------------------------------------------------


def labelled(spark, n=240):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "and", "stone", "river", "walks"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "x###", "|", "y$$$"]) for _ in range(60))
    texts = [bad() if i % 4 == 0 else good() for i in range(n)]
    df = documents(spark, [*texts, None, ""], [*range(n), 900, 901])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(n)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    return df, labels, n


def test_quality_vote(spark):
    df, labels, n = labelled(spark)
    rows = {r["doc_id"]: r for r in quality.classify(df, labels).collect()}
    assert len(rows) == n + 2
    for i in range(n):
        r = rows[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert r["predicted"] == int(i % 4 > 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    assert 0 <= rows[900]["score"] <= 1 and rows[900]["score"] == rows[901]["score"]


def test_repeated_labels_count_once(spark):
    """One identifier with most of the rows, of labels and of documents, is one labelled row."""
    df, labels, n = labelled(spark)
    many = documents(spark, ["the and stone river walks " * 12] * 50, [1] * 50)
    again = labels.unionByName(spark.createDataFrame([(1, 1, 0)] * 600, labels.schema))
    model = quality.fit(df.unionByName(many), again, sample=100)
    assert len(model.vectors) == 100
    rows = quality.score(df, model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in rows if r["doc_id"] < n)
    assert rules.fit(df.unionByName(many), again) != []


def test_terms_by_hand():
    """Words and form, each with its own length, counted one by one."""
    text = "Stone stone.\n river| 9 é"
    row = quality.terms(text)
    raw = text.encode()
    c = [int(quality.CLASS_OF[b]) for b in b" " + raw + b" "]
    form, count = np.zeros(quality.FORM), len(c) - 2
    for a, b, d in zip(c, c[1:], c[2:], strict=False):
        form[(a * 12 + b) * 12 + d] += 1 / count
    form[-4:] = 0, 0, 0, 0.25 / 6  # no word, pair or line repeats, and there are five words
    form = np.sqrt(form)
    form /= np.linalg.norm(form)
    own = np.zeros(quality.WORDS)
    for w in raw.lower().split():
        own[zlib.crc32(w) % quality.WORDS] += 1 / 5
    both = np.concatenate([form, quality.WEIGHT * np.sqrt(own)])
    assert row == pytest.approx(both / np.linalg.norm(both), abs=1e-6)
    assert not quality.terms("").any() and not quality.terms(None).any()


def test_votes_are_exact():
    rng = np.random.default_rng(0)
    rows, labels = rng.random((50, quality.TERMS)).astype(np.float32), rng.integers(0, 2, 50)
    model = quality.fit_rows(rows, labels, 8, 5)
    some = rng.random((7, quality.TERMS)).astype(np.float32)
    for r, s in zip(some, model.scores(some), strict=True):
        v = (r - model.mean) @ model.basis
        cosine = model.vectors @ (v / np.linalg.norm(v))
        best = np.argsort(-cosine)[:5]
        w = np.maximum(cosine[best], 0) ** 4
        assert s == pytest.approx((w * labels[best]).sum() / w.sum(), abs=1e-4)


def test_quality_without_labels(spark):
    df, labels, n = labelled(spark, 8)
    assert {r["score"] for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}


# Token ids -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    e = Encoder(vocabulary(name))
    rng = random.Random(2)
    pool = [*"abcA Z09'.,!\n\t éßñ你<|>sdtmÀÿřŽ×÷ªµİŉſŁ²_ǅΣς", "<|endoftext|>", "'s", " re", "\n\n", "́", " "]
    texts = ["", " ", "\n", "a\n\nb", *("".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(1500))]
    texts += ["hello <|endoftext|> world", "<|EndOfText|>", "a<|startoftext|>b\n<|endoftext|>", "x" * 5000]
    library = Tokenizer.from_file(vocabulary(name))
    assert [e.ids(t).tolist() for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    plain = Encoder(vocabulary(name), plain_specials=True)
    library.encode_special_tokens = True
    assert [plain.ids(t).tolist() for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert not any(len(w) > 128 for w in plain.words)


def test_token_files(spark, docs, tmp_path):
    df, rows = docs
    e = Encoder(vocabulary("word_bpe_49k.json"))
    made = lambda t: np.append(e.ids(t), 1).astype("<u4")
    expected = collections.Counter((i, len(made(t)), zlib.crc32(made(t).tobytes())) for i, t in rows)
    folder = f"file://{tmp_path}/ids"
    files = idstore.write_ids(df, vocabulary("word_bpe_49k.json"), folder, 1, file_ids=200)
    assert files.count() > 1
    read = idstore.read_ids(df, files, folder)
    assert rows_of(read, "doc_id", "n_tokens", "ids_crc32") == expected
    at, last = 0, -1
    for r in sorted(read.collect(), key=lambda r: r["start"]):
        assert r["start"] == at and (-1 if r["doc_id"] is None else r["doc_id"]) >= last
        at, last = at + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]
    assert idstore.token_ids(df.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_rows_without_identifier_are_spread(spark, tmp_path):
    df = documents(spark, [f"word {i % 7}" for i in range(400)], [None] * 390 + list(range(10)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = idstore.write_ids(df, vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/ids", 1)
        assert len({r["name"].split("-")[1] for r in files.collect()}) == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_elias_fano():
    rng = random.Random(7)
    for n, top in ((0, 1), (1, 0), (5, 3), (1000, 10), (3000, 10**12)):
        values = sorted(rng.randint(0, top) for _ in range(n))
        data = idstore.EliasFano.encode(np.array(values, np.int64))
        held, used = idstore.EliasFano.decode(memoryview(data + b"more"))
        assert used == len(data) and held.selects(0, n).tolist() == values
        for i in range(0, n, 97):
            assert held.select(i) == values[i]
            j = rng.randint(i, n)
            assert held.selects(i, j).tolist() == values[i:j]
        if n == 3000:
            assert len(data) < n * (3 + math.log2(top / n)) / 8 + 200


def test_id_file_documents():
    ids = [np.array(x, "<u2") for x in ([5, 6], [], [7] * 300, [1])]
    held = idstore.IdFile(idstore.pack([None, -3, 4, 4], ids))
    assert [held.doc_id(i) for i in range(4)] == [None, -3, 4, 4]
    for i in range(5):
        for j in range(i, 5):
            names, edges = held.stretch(i, j)
            assert names == [None, -3, 4, 4][i:j] and edges.tolist() == [0, 2, 2, 302, 303][i : j + 1]
    assert [held.document(i).tolist() for i in range(4)] == [x.tolist() for x in ids]
    with pytest.raises(ValueError):
        idstore.IdFile(idstore.pack([1], [np.array([1], "<u2")])[:-1])


# Near duplicates -------------------------------------------------------------------------------------------


def brute_fingerprint(t):
    w = words(t)
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints, threshold):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= threshold:
                up[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


def test_near_duplicates(spark, docs):
    df, rows = docs
    prints = [brute_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    expected = collections.Counter((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, classes(ids, prints, 2), strict=True))
    assert rows_of(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == expected
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [4096, 6])
@pytest.mark.parametrize("threshold", [0, 1, 2])
def test_links_between_fingerprints(spark, threshold, crowd):
    rng = random.Random(threshold)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in prints[:20]:
        for n in range(1, 6):  # neighbours at every distance, on either side of the threshold
            x = p
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            prints.append(x)
    centre = rng.getrandbits(64)
    prints += [centre ^ 1 << a ^ 1 << b for a in range(0, 64, 5) for b in range(a, 64, 7)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long").repartition(4)
    rows = df if crowd == 4096 else df
    links = simhash.near_links(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), threshold, crowd)
    stars = {r["a"]: r["b"] for r in simhash.components(links).collect()}
    found = collections.defaultdict(set)
    for i, p in enumerate(signed):
        found[stars.get(p, p)].add(i)
    expected = collections.defaultdict(set)
    for i, c in enumerate(classes(list(range(len(prints))), prints, threshold)):
        expected[c].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("hub", [simhash.HUB, 2])
def test_components_of_a_long_path(spark, hub):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(30, 200 + i) for i in range(9)] + [(100, 101), (101, 100), (7, 7)], "a long, b long").repartition(5)
    stars = {r["a"]: r["b"] for r in simhash.components(edges, hub).collect()}
    assert stars == {**{i: 0 for i in range(1, 61)}, **{200 + i: 0 for i in range(9)}, 101: 100}


def test_crowded_blocks_are_split_further(spark):
    """Fingerprints of one anchor that agree in most bits of the other half too."""
    rng = random.Random(9)
    low = rng.getrandbits(32)
    prints = sorted({(rng.getrandbits(17) << 47 | 5 << 32 | low) ^ (1 << rng.randrange(32) if rng.random() < 0.3 else 0) for _ in range(20_000)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    levels = []
    kept, simhash.materialize = simhash.materialize, lambda df, name: (levels.append(name), kept(df, name))[1]
    try:
        links = simhash.near_links(df, 2, 256)
    finally:
        simhash.materialize = kept
    assert levels.count("links") > 2
    stars = {r["a"]: r["b"] for r in simhash.components(links).collect()}
    known, up = set(prints), {p: p for p in prints}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    masks = [1 << a for a in range(64)] + [1 << a | 1 << b for a in range(64) for b in range(a)]
    for p in prints:
        for m in masks:
            if p ^ m in known:
                up[find(p)] = find(p ^ m)
    found, expected = collections.defaultdict(set), collections.defaultdict(set)
    for p, x in zip(prints, signed, strict=True):
        found[stars.get(x, x)].add(p)
        expected[find(p)].add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


# WARC ------------------------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    long, other = "x" * 200, "é" * 60
    rows = [(5, "http://a/b c\r\nX: y", long), (2, None, long), (9, "u", long), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", other), (1, "u", other), (1, "u", "again"), (None, "u", long), (2, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = rows_of(warc.archive(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    expected = []
    first = {long: 2, other: 1}
    seen_first = set()
    for i, _, h in rows:
        b = (h or "").encode()
        kind = "response" if h not in first else "revisit"
        if h in first and i == first[h] and h not in seen_first:
            kind = "response"
            seen_first.add(h)
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), kind, first[h] if kind == "revisit" else None))
    assert got == collections.Counter(expected)
    assert warc.archive(pages.limit(0)).count() == 0


def test_records_read_back(tmp_path):
    data = warc.capture(3, 0, "http://a/p?q", b"payload\r\n\r\nmore" * 20, hashlib.sha256(b"payload\r\n\r\nmore" * 20).hexdigest(), None, "2024-01-01T00:00:00Z")
    request, response, metadata = warc.records_in(data)
    assert (request["type"], response["type"], metadata["type"]) == ("request", "response", "metadata")
    assert request["concurrent_to"] == metadata["concurrent_to"] == [response["record_id"]]
    assert response["payload_bytes"] == 15 * 20 - 20 or response["payload_bytes"] == len(b"payload\r\n\r\nmore" * 20)
    assert response["target_uri"] == "http://a/p?q" and dict(metadata["fields"]) == {"page-id": "3"}
    with pytest.raises(ValueError):
        list(warc.records_in(data[:-5]))
    big = warc.capture(4, 0, "u", random.Random(1).randbytes(300_000), hashlib.sha256(random.Random(1).randbytes(300_000)).hexdigest(), None, "d")
    assert [r["type"] for r in warc.records_in(data + big)] == ["request", "response", "metadata"] * 2


def test_assembly_of_others_records(spark):
    """Links in either direction, over one record in between, and records without a capture."""
    schema = warc.RECORD
    row = lambda name, kind, to=(): (name, kind, "u", "d", list(to), None, 1, "x", None)
    records = spark.createDataFrame([row("r1", "response", ["q1"]), row("q1", "request"), row("m1", "metadata", ["q1"]), row("r2", "revisit"), row("q2", "request", ["r2"]), row("m2", "metadata", ["r2"]), row("m3", "metadata", ["nothing"]), row("r3", "response"), row("w", "warcinfo")], schema)
    got = {r["capture_id"]: ([x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["metadata"]]) for r in warc.assemble(records).collect()}
    assert got == {"r1": (["q1"], ["m1"]), "r2": (["q2"], ["m2"]), "r3": ([], [])}


# Quality rules ---------------------------------------------------------------------------------------------


def counted(t):
    t = t or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    c = collections.Counter(grams)
    again = {k + j for k, g in enumerate(grams) if c[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_statistics(spark):
    texts = [*corpus(40, 8), "a b c a b c a b", "a\na\n\na \nb", "# * <x>", "a a a a", "x" * 5000, "a b c " * 3000]
    df = documents(spark, texts)
    got = {r["doc_id"]: tuple(r)[1:6] for r in rules.statistics(df).collect()}
    assert got == {i: counted(t) for i, t in enumerate(texts)}


def test_rules(spark):
    df, labels, n = labelled(spark)
    plan = rules.judge(df, labels)
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())
    rows = {r["doc_id"]: r for r in plan.collect()}
    for i in range(n):
        failed = rows[i]["n_words"] < 50 or 100 * rows[i]["n_repeat_words"] > 50 * rows[i]["n_words"]
        assert rows[i]["base_failed"] == failed and (not failed or not rows[i]["kept"])
        assert failed or rows[i]["kept"] == (i % 4 > 0)
    assert all(r["kept"] == (not r["base_failed"]) for r in rules.judge(df, labels.limit(0)).collect())


def test_covering_learns_a_conjunction():
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        r = {k: rng.random() for k in rules.RATIOS}
        rows.append((r, r["symbol_share"] > 0.6 and r["words"] < 0.5))
    learned = rules.learn(rows)
    assert sum(any(rules.covers(x, r) for x in learned) == bad for r, bad in rows) > 570


# Language model --------------------------------------------------------------------------------------------


def test_scores(spark, docs):
    df, rows = docs
    got = lm.score(df, sample_docs=40, steps=20)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in rows if not held(i) for w in [*words(t), ""])
    n, v = sum(c.values()), len(c)
    expected = collections.Counter()
    for i, t in rows:
        w = [*words(t), ""]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        expected[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(base, 6)] += 1
    found = got.collect()
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected
    assert all(r["score"] <= 0 for r in found)
    assert lm.score(df.limit(0)).count() == 0


def as_tokens(spark, rows):
    """A table as the model makes it, of (doc_id, ids, held_out)."""
    return spark.createDataFrame([(k, i, bytearray(np.asarray(x, "<i4").tobytes()), h) for k, (i, x, h) in enumerate(rows)], "uid long, doc_id long, ids binary, held_out boolean")


def test_every_training_document_refines(spark):
    """Whatever its identifier: none is left out by its hash, the null one neither."""
    docs, _, _, t = tables()
    net = lm.Network(t.mass)
    for i in (None, *range(8)):
        assert lm.refined(as_tokens(spark, [(i, docs[0], False)]), net, t, len(docs[0]), 1).packed() != net.packed(), i
    assert lm.refined(as_tokens(spark, [(1, docs[0], True)]), net, t, len(docs[0]), 1).packed() == net.packed()


def test_training_deals_every_document_once(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 100)
    monkeypatch.setattr(lm, "COPIES", 5)
    docs = [[i, i + 1, i % 7] for i in range(200)] + [[9, 9, 9]] * 100
    rounds, each, dealt = lm.shards(as_tokens(spark, [(i, d, i % 10 == 0) for i, d in enumerate(docs)]), 900, 300)
    rows = dealt.collect()
    assert rounds == 2 and each == 5
    assert collections.Counter(tuple(np.frombuffer(r["ids"], "<i4").tolist()) for r in rows) == collections.Counter(tuple(d) for i, d in enumerate(docs) if i % 10)
    places = collections.Counter((r["round"], r["shard"]) for r in rows)
    assert set(places) <= {(a, b) for a in range(2) for b in range(5)} and max(places.values()) < 80
    copies = {(r["round"], r["shard"]) for r in rows if np.frombuffer(r["ids"], "<i4").tolist() == [9, 9, 9]}
    assert len(copies) > 5


def test_scores_do_not_follow_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "and", "stone", "rare%d" % rng.randrange(40)]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    df = documents(spark, [*texts, None, *texts[:9]], [*range(200), 200, *range(300, 309)])
    few, many = ({r["doc_id"]: r["score"] for r in lm.score(df.repartition(n), sample_docs=30, steps=10).collect()} for n in (4, 40))
    assert len(few) == 210 and few == pytest.approx(many, rel=1e-6)


def test_kinds_come_from_all_training_documents(spark, monkeypatch):
    """Words that the driver's few documents lack are of the kind of the documents that hold them."""
    kept = []
    monkeypatch.setattr(lm, "refined", lambda rows, network, tables, *rest: kept.append(tables) or network)
    made, numbers = lm.frequent, []
    monkeypatch.setattr(lm, "frequent", lambda *a: numbers.append(made(*a)) or numbers[-1])
    # Two kinds of documents by their frequent words; each has rare words too, spread so that few hold one.
    texts = [f"{'left up ' * 20 if i % 2 else 'right down ' * 20}{'odd' if i % 2 else 'even'}{i // 2 % 60}" for i in range(600)]
    lm.score(documents(spark, texts), sample_docs=20, steps=1)
    number = {w: i for i, (w, _, _) in enumerate(numbers[0])}
    of = lambda w: int(kept[0].class_of[number[w]])
    known = [i for i in range(60) if f"odd{i}".encode() in number and f"even{i}".encode() in number]
    assert len(known) > 50
    assert not {of(f"odd{i}".encode()) for i in known} & {of(f"even{i}".encode()) for i in known}
    assert of(b"left") != of(b"right")


def tables(n=80, seed=0, size=300, least=9):
    rng = random.Random(seed)
    vocab = [f"w{k}".encode() for k in range(size)] + [b"rare.", "é".encode(), b"odd"]
    docs = [[rng.choice(vocab[:size]) if rng.random() < 0.999 else rng.choice(vocab[size:]) for _ in range(rng.randint(1, 90))] for _ in range(n)]
    c = collections.Counter(w for d in docs for w in [*d, b""])
    top = [(w, lm.tail_class(w), k) for w, k in c.most_common() if k >= least]
    tail = np.zeros((lm.TAIL, 2))
    for w, k in c.items():
        if k < least:
            tail[lm.tail_class(w)] += k, k == 1
    number = {w: i for i, (w, _, _) in enumerate(top)}
    ids = [lm.numbered(d, number)[0] for d in docs]
    return ids, c, top, lm.tables_of(top, tail, sum(c.values()), len(c), lm.doc_kinds(ids, len(top)))


def stirred(net, seed=1):
    """A network with vectors of its own for words, so that what is learned within classes counts."""
    rng = np.random.default_rng(seed)
    for k in net.p:
        net.p[k] = (net.p[k] + rng.normal(0, 0.2, net.p[k].shape)).astype(net.p[k].dtype)
    return net


def test_probabilities_add_up(monkeypatch):
    monkeypatch.setattr(lm, "LEARNED", 100)
    docs, c, top, t = tables()
    assert (t.slot >= 0).sum() == 100 < len(top)
    net = stirred(lm.Network(t.mass))
    net.train(lm.streams_of(docs, t, 4), t, steps=5)
    state = net.states(np.array([[lm.INPUTS + lm.CLASSES, 3]]), np.zeros((2, lm.HIDDEN), np.float32))[0][:1].copy()
    every = lambda n: np.repeat(state, n, axis=0)
    logs = net.of_classes(every(lm.CLASSES), np.arange(lm.CLASSES))
    assert np.exp(logs).sum() == pytest.approx(1, rel=1e-5)
    within = net.of_words(every(len(top)), t.class_of, np.arange(len(top)), t)
    sums = np.bincount(t.class_of, np.exp(within), lm.CLASSES)
    assert sums[np.unique(t.class_of)] == pytest.approx(1, rel=1e-5) and np.ptp(within - t.in_class) > 0.1
    known = {w for w, _, _ in top}
    for k in range(lm.TAIL):
        rest = [n for w, n in c.items() if w not in known and lm.tail_class(w) == k]
        assert sum(n * 10 ** t.tail_known[k] for n in rest) + 10 ** t.tail_unknown[k] == pytest.approx(1)


def plain_scores(net, t, ids):
    """Log10 probability of each frequent word or tail class of one document, by the formulas, token by token."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n = lm.HIDDEN
    h, last, out = np.zeros(n), lm.INPUTS + lm.CLASSES, 0.0
    soft = lambda v: 1 / (1 + np.exp(-v))
    for i in ids.tolist():
        x, g = p["inputs"][last], h @ p["hidden"]
        z, r = soft(x[:n] + g[:n]), soft(x[n : 2 * n] + g[n : 2 * n])
        new = np.tanh(x[2 * n :] + r * g[2 * n :])
        h = z * h + (1 - z) * new
        logits = h @ p["out"] + p["bias"]
        k = int(t.class_of[i]) if i >= 0 else lm.KINDS * lm.BINS - 1 - i
        out += logits[k] - math.log(np.exp(logits).sum())
        if i >= 0:
            members = np.flatnonzero(t.class_of == k)
            own = np.array([t.in_class[j] + (h @ p["words"][t.slot[j]] if t.slot[j] >= 0 else 0) for j in members])
            out += own[members == i][0] - math.log(np.exp(own).sum())
        last = i if 0 <= i < lm.INPUTS else lm.INPUTS + k
    return out / math.log(10)


def test_scores_are_those_of_the_formula(monkeypatch):
    """Documents of any length, side by side, with states carried across windows."""
    monkeypatch.setattr(lm, "LEARNED", 100)
    monkeypatch.setattr(lm, "PLACES", 5)
    monkeypatch.setattr(lm, "AHEAD", 100)
    docs, _, _, t = tables(80, 3)
    docs = docs[:14]
    docs.append(np.array([1] * 200 + [-3, 2], np.int32))
    net = stirred(lm.Network(t.mass))
    net.train(lm.streams_of(docs, t, 4), t, steps=10)
    got = dict(lm.Scorer(net, t).run((i, t.fed([d]).astype(np.int32)) for i, d in enumerate(docs)))
    assert {i: x / math.log(10) for i, x in got.items()} == pytest.approx({i: plain_scores(net, t, d) for i, d in enumerate(docs)}, rel=1e-4)


def test_whole_scores(spark, docs, monkeypatch):
    """What the operator returns of each document, against the formula with the tables and the network that it made."""
    df, rows = docs
    kept, real = [], lm._scored
    monkeypatch.setattr(lm, "_scored", lambda tokens, network, tables: kept.append((network, tables)) or real(tokens, network, tables))
    made, numbers = lm.frequent, []
    monkeypatch.setattr(lm, "frequent", lambda *a: numbers.append(made(*a)) or numbers[-1])
    got = collections.Counter((r["doc_id"], round(r["score"], 2)) for r in lm.score(df, sample_docs=20, steps=5, vocabulary=8).collect())
    net, t = kept[0]
    number = {w: i for i, (w, _, _) in enumerate(numbers[0])}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, text in rows if not held(i) for w in [*words(text), ""])
    expected = collections.Counter()
    for i, text in rows:
        ids, tail = lm.numbered([w.encode() for w in words(text)], number)
        p = plain_scores(net, t, ids)
        for w, n in tail.items():
            k = lm.tail_class(w)
            p += n * (math.log10(c[w.decode()]) + t.tail_known[k] if c[w.decode()] else t.tail_unknown[k])
        expected[i, round(p, 2)] += 1
    off = collections.Counter((i, round(p + d, 2)) for (i, p), _ in (got - expected).items() for d in (-0.01, 0, 0.01))
    assert all((i, p) in off for i, p in (expected - got)) and (got - expected).total() < 8 and len(number) == 8


def test_gradients(monkeypatch):
    monkeypatch.setattr(lm, "LEARNED", 100)
    rng = np.random.default_rng(1)
    _, _, top, t = tables()
    net = lm.Network(np.ones(lm.CLASSES))
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    stirred(net)
    x = rng.integers(0, 50, (5, 3))
    x[2, 1] = lm.INPUTS + lm.CLASSES
    ids = rng.integers(-3, len(top), (5, 3))
    y, h = t.classes(ids), rng.normal(0, 0.3, (3, lm.HIDDEN))
    y[4, 2], ids[4, 2] = -1, -1  # an ended stream
    g, _, _ = net.gradients(x, y, ids, h, t)
    g = {k: v.copy() for k, v in g.items()}
    seen = int(t.slot[ids[(ids >= 0) & (t.slot[np.maximum(ids, 0)] >= 0)][0]])
    for k, at in (("hidden", (3, 40)), ("hidden", (1, 70)), ("out", (2, int(y[0, 0]))), ("bias", (int(y[1, 0]),)), ("inputs", (int(x[1, 0]), 9)), ("inputs", (int(x[0, 2]), 80)), ("words", (seen, 5))):
        old, eps, loss = net.p[k][at], 1e-3, []
        for d in (eps, -eps):
            net.p[k][at] = old + d
            loss.append(net.gradients(x, y, ids, h, t)[2])
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((loss[0] - loss[1]) / (2 * eps), rel=0.05, abs=2e-5)


# Packing ---------------------------------------------------------------------------------------------------


def test_packing(spark):
    texts = [*corpus(30, 6), "the and tion " * 2000, "word " * 1023, None]
    ids = [*range(len(texts) - 3), 0, 0, None]
    df = documents(spark, texts, ids)
    e = Encoder(vocabulary("byte_bpe_50k.json"))
    made = collections.defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        made[i].append(np.append(e.ids(t), 0).astype("<u4"))
    rows = packing.pack(df, vocabulary("byte_bpe_50k.json"), capacity=128, piece=32, tail=8, slack=2, group_windows=8).collect()
    for r in rows:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in made[r["doc_id"]])
    assert sum(r["length"] for r in rows) == sum(len(x) for v in made.values() for x in v)
    pieces = collections.Counter((r["doc_id"], r["doc_tokens"], r["start"], r["length"]) for r in rows)
    expected = collections.Counter()
    for i, v in made.items():
        for x in v:
            at = 0
            for n in packing.cuts(len(x), 128, 32, 8):
                expected[i, len(x), at, n] += 1
                at += n
            assert at == len(x)
    assert pieces == expected
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 128
    assert packing.pack(df.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_packed_ids_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idstore, "FILE_IDS", 300)
    texts = [*corpus(30, 6), "the and tion " * 2000, None]
    df = documents(spark, texts, [*range(len(texts) - 3), 0, 0, None])
    rows = packing.pack(df, vocabulary("byte_bpe_50k.json"), capacity=128, piece=32, tail=8, folder=f"file://{tmp_path}/ids").collect()
    files = {}
    for r in rows:
        held = files.setdefault(r["file"], idstore.IdFile((tmp_path / "ids" / r["file"]).read_bytes()))
        own = held.ids[r["file_start"] : r["file_start"] + r["length"]].astype("<u4")
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"]
    assert sum(f.n for f in files.values()) == len(texts) and len(files) > 1


def test_many_rows_of_one_identifier_make_many_groups(spark):
    df = documents(spark, ["the and"] * 600, [None] * 600)
    rows = packing.pack(df, vocabulary("byte_bpe_50k.json"), capacity=32, piece=16, tail=4, slack=1, group_windows=4).collect()
    groups = collections.Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 600 and len(groups) > 5 and max(groups.values()) < 200


def test_differencing_is_even():
    rng = random.Random(5)
    for k in (2, 7, 40):
        sizes = [rng.randint(1, 256) for _ in range(k * 6)]
        parts = packing.differencing(sizes, k)
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
        assert len(parts) == k and max(sums) - min(sums) <= 32
    assert packing.windows([700] * 5, 1024, 4) == [[i] for i in range(5)] or len(packing.windows([700] * 5, 1024, 4)) == 5


def test_count_rises_beyond_capacity():
    parts = packing.windows([600, 600, 600], 1024, 4)
    assert len(parts) == 3


# Secrets ---------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(t):
    t = t or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    kinds = collections.Counter(x[2] for x in out)
    return kinds["assign"], kinds["access"], kinds["hex"], ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


HEXED = "0123456789abcdef" * 2
KEY40 = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
SECRETS = [
    None,
    "",
    "nothing here",
    f'é password = "abc" secret=token:abcdefgh TOKEN: {HEXED} ſecret=abcdefgh',
    "AKIA" + "Z" * 16 + " AKIA" + "Z" * 15 + " xAKIAAKIA" + "Q" * 30,
    "api_key='a.b-c_d=e' apikey:x passwd=123456",
    "secret=token=abcdef password\n=abcdef token = =abcdef",
    HEXED + HEXED[:7] + " " + "a" * 23,
    f"AKIA{'Z' * 16} {KEY40} https://db.example.com:5432 user_id=maxime",
    f"{KEY40} https://db.example.com user_id=maxime",
    f"user_id=maxime {'x ' * 150} token=abcdefgh",
    f"user_id=maxime {'x ' * 50} token=abcdefgh",
    "token=abcdef " * 400,
]


def test_base_spans(spark):
    df = documents(spark, SECRETS)
    plan = secrets.scan(df)
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())
    rows = {r["doc_id"]: r for r in plan.collect()}
    for i, t in enumerate(SECRETS):
        a, b, c, spans = base(t)
        r = rows[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (a, b, c, hashlib.sha256(spans.encode()).hexdigest()), t
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))
        at = [int(x.split(":")[1]) for x in r["spans"].split(",") if x]
        assert at == sorted(at)


def test_weak_spans_need_their_parts(spark):
    rows = {r["doc_id"]: [x["kind"] for x in r["linked"]] for r in secrets.scan(documents(spark, SECRETS)).collect()}
    assert sorted(rows[8]) == ["endpoint", "ident", "key40"]
    assert sorted(rows[9]) == ["endpoint", "ident", "key40"]
    assert rows[10] == [] and rows[11] == ["ident"]
    assert all(rows[i] == [] for i in (0, 1, 2, 3, 5, 7, 12))


def test_links_reach_over_any_number_of_parts(spark):
    """A long part that holds many others doesn't hide its complement, and links are those of a plain comparison."""
    rng = random.Random(5)
    runs = "/".join(["ab12" * 6] * 300)
    texts = [f"https://db.example.com/ user_id={runs} {KEY40}", f"{KEY40} user_id={runs} AKIA{'Z' * 16}"]
    pool = [KEY40, "user_id=maxime", "login: bob", "token=abcdefgh", "https://db.example.com:5432", f"AKIA{'Z' * 16}", "ab12" * 7, *["x " * n for n in (20, 60, 95, 99, 100, 101, 140)]]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    secret, name = ("assign", "hex", "key40"), ("ident", "access")
    needs = {"ident": [secret], "key40": [name], "endpoint": [secret, name]}
    spans = F.array_sort(F.concat(*[secrets.found(F.col("text"), k) for k in secrets.ORDER]))
    every = {r["doc_id"]: [(x["start"], x["end"], x["kind"]) for x in r["s"]] for r in documents(spark, texts).select("doc_id", spans.alias("s")).collect()}
    for r in secrets.scan(documents(spark, texts)).collect():
        parts = every[r["doc_id"]]
        near = lambda a, kinds: any(k in kinds and s <= a[1] + 200 and e >= a[0] - 200 for s, e, k in parts)
        assert [(x["start"], x["end"], x["kind"]) for x in r["linked"]] == [a for a in parts if a[2] in needs and all(near(a, n) for n in needs[a[2]])]
    assert sum(k == "key40" for _, _, k in every[0]) == 1 and len(every[0]) > 200


def test_many_matches_in_one_text(spark):
    n = 20_000
    df = documents(spark, ["token=abcdefgh user_id=maxime " * n])
    found = secrets.scan(df, carry=True).select("n_assign", F.size("linked").alias("n"), F.length(secrets.redacted(F.col("row.text"), F.concat("base", "linked"))).alias("left"))
    found.collect()
    began = time.perf_counter()
    assert tuple(found.collect()[0]) == (n, n, n * 18)
    assert time.perf_counter() - began < 30  # growing arrays take minutes


def test_redaction(spark):
    rng = random.Random(8)
    many = " ".join(rng.choice(["token=abcdefgh", "ab12" * 7, f"password={HEXED}", "é", "secret=token=abcdef"]) for _ in range(500))
    df = documents(spark, SECRETS + [many])
    found = secrets.scan(df, carry=True)
    text = secrets.redacted(F.coalesce("row.text", F.lit("")), F.concat("base", "linked"))
    rows = {r["doc_id"]: r for r in found.select("doc_id", text.alias("t"), F.concat("base", "linked").alias("s")).collect()}
    for i, t in enumerate(SECRETS + [many]):
        out, at = "", 0
        for s in sorted((x["start"], x["end"]) for x in rows[i]["s"]):
            if s[0] >= at:
                out += (t or "")[at : s[0]] + "[SECRET]"
            at = max(at, s[1])
        assert rows[i]["t"] == out + (t or "")[at:]


# The pipeline ----------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(11)
    good = lambda n=70: " ".join(rng.choice(["the", "and", "stone", "river", "walks", "slow", "blue", "over"]) for _ in range(n)) + "."
    texts = [good() for _ in range(60)]
    bad = ["BUY!! ### | $$$ " * 20] * 5
    texts[7], texts[9] = texts[3], texts[3]
    texts[11] = texts[11] + " token = '" + HEXED + "'"
    items = [texts[20]]
    all_texts = [*texts, *bad, None]
    folder = f"file://{tmp_path}/sf"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(all_texts)], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(65)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, items[0])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = P.keep_good(spark, docs, folder)
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert set(range(60)) <= ids and not ids & set(range(60, 65)) and kept.columns == docs.columns
    one = P.keep_one_of_each(spark, kept, folder)
    ids = {r[0] for r in one.select("doc_id").collect()}
    assert 3 in ids and not ids & {7, 9} and one.columns == docs.columns
    clean = P.drop_contaminated(spark, one, folder)
    assert {r[0] for r in clean.select("doc_id").collect()} == ids - {20}
    masked = {r["doc_id"]: r for r in P.mask_secrets(spark, clean, folder).collect()}
    assert HEXED not in masked[11]["text"] and "[SECRET]" in masked[11]["text"] and masked[11]["n_chars"] == len(masked[11]["text"])
    assert all(masked[i]["text"] == all_texts[i] for i in masked if i != 11)
    packed = P.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(masked)
    e, files = Encoder(vocabulary("byte_bpe_50k.json")), {}
    for r in packed:  # what is packed can be read back from the files
        held = files.setdefault(r["file"], idstore.IdFile(open(r["file"].removeprefix("file://"), "rb").read()))
        own = held.ids[r["file_start"] : r["file_start"] + r["length"]]
        assert own.tolist() == np.append(e.ids(masked[r["doc_id"]]["text"]), 0)[r["start"] : r["start"] + r["length"]].tolist()


def test_repeated_documents_stay_once(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "a b c d", "y"), (None, "q r s t", "z"), (None, "a b c d", "z")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, P.keep_one_of_each(spark, docs, "").collect()), key=str) == [(1, "a b c d", "x"), (None, "q r s t", "z")]


def test_an_identifier_that_repeats_is_not_one_document(spark):
    """Rows are near duplicates by their texts alone."""
    import corpus_pipeline as P

    a, b = "a b c d e f", "q r s t u v"
    keep = lambda rows: sorted(map(tuple, P.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()))
    assert keep([(1, a), (2, b), (2, a)]) == [(1, a), (2, b)]
    assert keep([(3, a), (3, b)]) == [(3, a), (3, b)]


def test_stages_leave_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as P

    schema = "doc_id long, text string, rows int, kept_id long, place string, root int, `a.b` map<string,int>, `row` struct<`x.y`: int>, masked int, n_chars int"
    docs = spark.createDataFrame([(i % 3, t, 1, 2, "p", 3, {"k": 1}, (4,), 5, 6) for i, t in enumerate(["a b c d", "a b c d", f"token={HEXED} x", None, "q r"])], schema)
    folder = f"file://{tmp_path}/sf"
    spark.createDataFrame([(1, "q r")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert P.keep_good(spark, docs, folder).schema.simpleString() == docs.schema.simpleString()
    for stage, left in ((P.keep_one_of_each, 4), (P.drop_contaminated, 4), (P.mask_secrets, 5)):
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == left
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert P.pack_windows(spark, docs, folder).select("file").distinct().count() >= 1


def test_words_of_batches():
    texts = ["  A b\x0bÄ a ", "", None, "\x1cx\x85 B,\n\tb,", "zz zz."]
    number = {b"a": 0, "Ä".encode(): 1}
    found = lm.all_numbered(lm.split(pa.array(texts, pa.string())), number)
    for i, (text, ids) in enumerate(zip(texts, found, strict=True)):
        own = [*(text or "").encode().lower().split(), b""]
        assert ids.tolist() == [number.get(w, -1 - lm.tail_class(w)) for w in own]
        part = slice(found.tail_begin[i], found.tail_begin[i + 1])
        tail = dict(zip(found.words.take(pa.array(found.tail[part])).to_pylist(), found.tail_counts[part].tolist(), strict=True))
        assert tail == collections.Counter(w for w in own if w not in number)


def test_sums_by_halving():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 900):
        keys, rows = rng.integers(0, 9, n) ** 2, rng.normal(0, 1, (n, 3))
        seen, sums = lm.summed(rows, keys)
        assert seen.tolist() == sorted(set(keys.tolist()))
        assert np.allclose(sums, np.array([rows[keys == k].sum(axis=0) for k in seen]).reshape(-1, 3))


def test_many_words_at_once():
    """Tail classes by array, also of parts of arrays, and numbers by the place in an array of words."""
    words = pa.array(["a", "b.", "é", "é,", "7", "x!", "", "#", "(", "zz", "ü?"])
    for part in (words, words[3:9], words[:0], words.cast(pa.binary())[2:]):
        assert lm.tail_classes(part).tolist() == [lm.tail_class(w.encode() if isinstance(w, str) else w) for w in part.to_pylist()]
    texts = lm.split(pa.array([" b. a a é", None, "zz  (", "a"]))
    number = {b"a": 0, "é".encode(): 1, b"": 2}
    for lists in (texts, texts[1:], texts[:0]):
        one, other = lm.all_numbered(lists, number), lm.all_numbered(lists, pa.array(list(number), pa.binary()))
        assert [x.tolist() for x in one] == [x.tolist() for x in other] == [[number.get(w, -1 - lm.tail_class(w)) for w in [*(w.encode() for w in ws if w), b""]] for ws in lists.to_pylist()]


def test_levels_of_counts(spark):
    """One pass over the counts gives what the tables need: words, tokens and words that occur once, by tail class, and the frequent words' bound."""
    rows = [(f"w{i}", i % 3, 1 + i % 7 * (i % 5)) for i in range(300)]
    counts = spark.createDataFrame(rows, "word string, k int, c long")
    found = lm.levels(counts)
    for k in range(3):
        own = [c for _, j, c in rows if j == k]
        assert [sum(r[n] for r in found if r["k"] == k) for n in ("n", "c", "once")] == [len(own), sum(own), own.count(1)]
    for most in (0, 20, 100, 1000):
        top = lm.frequent(counts, most, found)
        assert len(top) <= most and top == sorted(((w.encode(), k, c) for w, k, c in rows if c >= max([lm.LEAST, *(c for _, _, c in top[-1:])])), key=lambda x: (-x[2], x[0]))[: len(top)]
    assert len(lm.frequent(counts, 1000, found)) == sum(c >= lm.LEAST for _, _, c in rows)
