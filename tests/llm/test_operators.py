"""The ten operators on small tables, against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import fmindex, html, langid, mixing, neardup, packing, queries, sstable, substring, tokens, toxicity, vectors
from lodestone.llm.common import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = "kept boolean, score double, d int, k int, begins int, size int, shard int, label int, p double"


def table(name, sf=SF):
    return pd.read_parquet(f"{sf}/{name}.parquet")


def words(text):
    return text.encode().split() if text else []


def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with the operators' own names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "one two"), (6, long), (6, long), (7, long + " tail"), (None, "no id here at all"), (None, None), (8, "x" * 20_000), (9, "Ünï cödé ß 漢字 \U0001f600"), (9, "another text of the same id")]
    full = [(i, t, "en" if i != 4 else None, None if i == 5 else "s", None, True, 0.5, 1, 2, 3, 4, 5, 6, 0.1) for i, t in rows]
    return spark.createDataFrame(full, f"{DOCS}, {EXTRA}")


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- Shared parts ---------------------------------------------------------------------------------


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
@settings(max_examples=4, deadline=None)
def test_components_of_links(spark, links):
    part = {}

    def find(x):
        part.setdefault(x, x)
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in part}


@pytest.mark.parametrize("name,lead", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_equal_the_library(name, lead):
    rng = random.Random(5)
    alphabet = " \n\ta.'1é́  s<|>ΩΣİ§|,\x1cB\x00\n"
    texts = ["", " ", "  a", "don't 's", "a  b", "日本 語", "<|endoftext|> a", "x" * 300 + " y"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    e = tokens.Encoder(tokens.default_path(name), lead)
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.batch(texts) == want and e.batch(texts[::-1]) == want[::-1]


# --- 1 toxicity -----------------------------------------------------------------------------------


def toxic_corpus(seed=0):
    rng = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi zo".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(400):
        w = [word() for _ in range(rng.randint(20, 200))]
        if i % 5 == 0:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["blorkish", "nastyword", "vilething", "crudejab"]))
        texts.append(" ".join(w))
        labels.append(int(i % 5 == 0))
    return texts, labels


def test_toxicity_held_out():
    texts, labels = toxic_corpus()
    model = toxicity.train(texts[:300], labels[:300])
    got = [model.score(t) >= 0.7 for t in texts[300:]]
    assert sum(g == bool(y) for g, y in zip(got, labels[300:], strict=True)) >= 97
    assert model.score(None) == model.score("") == model.score(" \n") == 0.0


def test_toxicity_as_plain_compression_gives_it():
    """A score from lengths of single compressions and the formula written out."""
    import zstandard

    texts, labels = toxic_corpus()
    model = toxicity.train(texts, labels)

    def length(content, word):
        options = zstandard.ZstdCompressionParameters.from_level(3, source_size=128, dict_size=len(content), write_content_size=False, write_dict_id=False, write_checksum=False)
        made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=options)
        return len(made.compress(b"\x00" * 32 + b" " + word + b" " + b"\x00" * 16))

    for text in ["one", "nastyword", "Blorkish vilething ba", *texts[:6]]:
        far = sorted(length(model.distances.ordinary, w) - length(model.distances.toxic, w) for w in text.lower().encode().split())[::-1]
        top = far[:3] + [min(0, far[: 3][-1])] * (3 - len(far))
        x = [*top, np.log1p(sum(d >= model.threshold for d in far)), np.log1p(len(far))]
        z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x, strict=True))
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_rows(spark):
    texts, labels = toxic_corpus()
    model = toxicity.train(texts, labels)
    got = toxicity.score(odd_docs(spark), model)
    assert got.columns.count("score") == 1 and got.count() == 13
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert toxicity.score(empty_docs(spark), model).count() == 0
    none = toxicity.fit(empty_docs(spark), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert none.score("any text") == 0.0
    one = toxicity.train(["only toxic texts here"], [1])
    assert one.score(None) == one.score("") == one.score(" \n") == 0.0 and one.score("more") == 1.0


def test_toxicity_labels_of_one_id(spark):
    rows = [(0, 1), (0, 0), (2, None), (None, 1), (3, 0), (3, 0)]
    got = toxicity.training_ids(spark.createDataFrame(rows, "doc_id bigint, toxic int")).collect()
    assert {r["doc_id"]: r["toxic"] for r in got} == {i: y for i, y in ((0, 1), (3, 0)) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_toxicity_query(spark):
    got = queries.queries()["op1_compression_toxicity"](spark, SF).toPandas()
    docs = table("documents")
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in got.itertuples())


def test_toxicity_learns_from_whole_texts(spark):
    """Toxic words stand behind the first 6,000 characters only."""
    texts, labels = toxic_corpus()
    rng = random.Random(1)
    ordinary = [w for t, y in zip(texts, labels, strict=True) if not y for w in t.split()]
    texts = [" ".join(rng.choices(ordinary, k=1500)) + " " + t for t in texts]
    assert min(map(len, texts)) > 6000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int")
    model = toxicity.fit(docs, rows)
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((model.score(texts[i]) >= 0.7) == bool(labels[i]) for i in held) >= 0.97 * len(held)


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, seed: taken.extend(zip(texts, toxic, strict=True)))
    docs = [(i, "word " * (100 if i % 3 else 1000)) for i in range(200)]
    toxicity.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id bigint, toxic int"), sample=20, sample_chars=500)
    for y in (0, 1):
        own = [t for t, toxic in taken if toxic == y]
        assert own and set(own) <= {t for _, t in docs} and sum(map(len, own)) <= 20 * 500


# --- 2 html ---------------------------------------------------------------------------------------


def test_blocks():
    page = "<html><head><title>T</title><style>x</style></head><body><nav><a href='/a'>A</a> b</nav><article><h1>H &amp; &lt;x&gt;</h1><p><b>one\n  two<br><p>three <i>in</i>line</p><script>var t='</p>';</script><div>left<p>right</div>tail</article><!-- no --><foot"
    assert [b.text for b in html.blocks_of(page)] == ["A b", "H & <x>", "one two", "three inline", "left", "right", "tail"]
    for odd in ("", "<", "<p", "</p>", "&", "<!--", "<script>", "a<b", "<p>x</p", "<a href='>", "\x00<p>é"):
        html.blocks_of(odd)


@pytest.mark.parametrize("page, want", [
    ("<p title=don't>Hello</p><p>World</p>", ["Hello", "World"]),
    ("<p title = \"a>b\" class='c>d' e='>Hi</p> there", []),
    ("<p title = \"a>b\" class='c>d' e=f'>Hi</p> there", ["Hi", "there"]),
    ("<a href=x?a='1&b=\"2\" >one</a><p \"odd'>two", ["one", "two"]),
    ("<div/>one<br/>two<p/>three<script src=x></script>", ["one", "two", "three"]),
    ("<math><mspace/><mi/>x</math> y<svg/> z", ["x y z"]),
    ("<form><datalist><option value=a><option value=b></datalist></form><article><p>one</p></article>", ["one"]),
    ("<form><datalist><option>a<option>b</datalist></form><p>one</p><select><option>c</option></select><p>two", ["one", "two"]),
    ("<select><option>a<option>b</select><p>one<select><optgroup><option>c</form><p>two", ["one", "two"]),
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b <object data=o><param name=n>fallback</object> c</p>", ["a x=2 b fallback c"]),
    ("<object><p>one</p><math><mi>x<p>two", ["one", "x", "two"]),
    ("<svg><path><p>one</p><svg><text>t</text></svg><p>two</p><svg><foreignObject><p>no</p></foreignObject></svg>three", ["one", "two", "three"]),
    ("<noscript><p>one</p><template><p>two</p>", ["one", "two"]),
    ("<p>one</p><script>var a = '<p>no</p>';<p>no</p>", ["one"]),
])
def test_blocks_after_elements_without_end(page, want):
    assert [b.text for b in html.blocks_of(page)] == want


def test_labeller(spark):
    model = html.fit(None, made_up=400, steps=120)
    rng, right, total = random.Random(99), 0, 0
    for _ in range(150):
        page, labels = html.made_up_page(rng)
        blocks = html.blocks_of(page)
        right += int((model.label([blocks])[0] == np.array(labels[: len(blocks)])).sum())
        total += len(blocks)
    assert right / total > 0.93
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<html></html>", "x"), (4, "u", "<nav><a>m</a></nav><article><h1>Head</h1><p>Body  text.</p></article><footer>f</footer>", "x"), (4, "u", "<p>" + "long " * 50_000 + "</p>", "x")]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"), model).toPandas()
    assert list(got.columns) == ["page_id", "url", "text", "n_chars"] and len(got) == 5
    assert all(len(t) == n for t, n in zip(got.text, got.n_chars, strict=True))
    assert got[got.page_id < 4].text.tolist() == ["", "", ""] and "Head\nBody text." in got[got.page_id == 4].text.tolist()
    assert html.extract(spark.createDataFrame([], "page_id bigint, html string"), model).count() == 0


class Plain(HTMLParser):
    """Blocks by Python's own parser: (text, is it in an article)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.inside, self.dropped = [], "", 0, 0

    def flush(self):
        if text := " ".join(self.now.split()):
            self.blocks.append((text, self.inside > 0))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag not in html.INLINE:
            self.flush()
        self.inside += tag == "article"
        self.dropped += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        if tag not in html.INLINE:
            self.flush()
        self.inside -= tag == "article"
        self.dropped -= tag in ("script", "style", "title")

    def handle_data(self, data):
        self.now += "" if self.dropped else data


def plain_blocks(page):
    p = Plain()
    p.feed(page)
    p.close()
    p.flush()
    return p.blocks


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_blocks_as_another_parser_finds_them(sf):
    for page in table("pages", sf).html.dropna():
        assert [b.text for b in html.blocks_of(page)] == [t for t, _ in plain_blocks(page)]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_html_query(spark, sf):
    """The main text of the tables' pages is what stands in their articles."""
    got = queries.queries()["op2_html_main_text"](spark, sf).toPandas().set_index("page_id")
    pages = table("pages", sf)
    want = {r.page_id: "\n".join(t for t, inside in plain_blocks(r.html or "") if inside) for r in pages.itertuples()}
    assert len(got) == len(pages) and np.mean([got.text[i] == t for i, t in want.items()]) > 0.98


def test_labels_of_blocks_as_a_plain_network_gives_them():
    """The batched passes against the equations, a block at a time, in double precision."""
    rng = random.Random(3)
    pages = [html.blocks_of(html.made_up_page(rng)[0]) for _ in range(12)]
    model = html.Labeller.new(8, 1)
    logistic = lambda v: 1 / (1 + np.exp(-v))
    p = {k: v.astype(float) for k, v in model.p.items()}

    def states(d, x):
        n, h, c = model.size, np.zeros(model.size), np.zeros(model.size)
        for v in x:
            a = v @ p[f"in_{d}"] + p[f"gate_{d}"] + h @ p[f"keep_{d}"]
            i, f, o, u = logistic(a[:n]), logistic(a[n : 2 * n]), logistic(a[2 * n : 3 * n]), np.tanh(a[3 * n :])
            c = f * c + i * u
            h = o * np.tanh(c)
            yield h

    vectors_ = [model.vectors(html.features(b)) for b in pages]
    logit = model.forward(vectors_)[0]
    for lane, (blocks, x) in enumerate(zip(pages, vectors_, strict=True)):
        paths, own_words, numbers = html.features(blocks)
        for k, v in enumerate(x):
            plain = sum(p["path"][i] for i in paths[k]) + numbers[k] @ p["number"] + p["bias"] + (np.mean([p["word"][i] for i in own_words[k]], axis=0) if len(own_words[k]) else 0)
            assert v == pytest.approx(np.tanh(plain), abs=1e-4)
        forward, backward = list(states("f", x)), list(states("b", x[::-1]))[::-1]
        want = [f @ p["out_f"] + b @ p["out_b"] + v @ p["skip"] + p["last"][0] for f, b, v in zip(forward, backward, x, strict=True)]
        assert logit[: len(x), lane] == pytest.approx(np.array(want), abs=1e-4)


def test_html_model_of_made_up_pages_alone():
    """Trained without the tables' pages, the labeller finds their articles too."""
    model = html.fit(None)
    pages = table("pages", "/root/testdata/sf0.01").html.dropna().tolist()
    blocks = [html.blocks_of(p) for p in pages]
    got = ["\n".join(b.text for b, m in zip(own, main, strict=True) if m) for own, main in zip(blocks, model.label(blocks), strict=True)]
    assert np.mean([t == "\n".join(x for x, inside in plain_blocks(p) if inside) for t, p in zip(got, pages, strict=True)]) > 0.97


# --- 3 substrings ---------------------------------------------------------------------------------


def brute_removed(texts, window):
    count = Counter(tuple(w[i : i + window]) for w in map(words, texts) for i in range(len(w) - window + 1))
    out = []
    for w in map(words, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


@given(st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_index_matches(seed):
    rng = np.random.default_rng(seed)
    least, symbols = int(rng.integers(3, 7)), int(rng.integers(2, 6))
    texts = [rng.integers(1, symbols + 1, rng.integers(least, 20)) for _ in range(rng.integers(1, 8))]
    weights = rng.integers(1, 3, len(texts))
    count = Counter()
    for t, w in zip(texts, weights, strict=True):
        for i in range(len(t) - least + 1):
            count[tuple(t[i : i + least])] += w
    for t, spans in zip(texts, fmindex.matched_intervals(fmindex.FMIndex(texts, weights, 32), least), strict=True):
        got, want = np.zeros(len(t), bool), np.zeros(len(t), bool)
        for a, b in spans:
            got[a:b] = True
        for i in range(len(t) - least + 1):
            if count[tuple(t[i : i + least])] >= 2:
                want[i : i + least] = True
        assert (got == want).all()


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring_query(spark, hot):
    docs = table("documents")
    got = substring.remove_repeats(spark.createDataFrame(docs[["doc_id", "text"]]), hot_passages=hot, shard_passages=50).toPandas().set_index("doc_id")
    for doc, text, kept in zip(docs.doc_id, docs.text, brute_removed(docs.text, 35), strict=True):
        r = got.loc[doc]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words(text)), len(words(text)) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())


@pytest.mark.parametrize("hot", [1, 3])
def test_substring_of_a_passage_in_most_texts(spark, hot):
    """Anchors that stay crowded: one passage in most texts, a template with a varying middle, copies of rims."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared, left, right = ([word() for _ in range(n)] for n in (50, 12, 12))
    texts = []
    for i in range(60):
        w = [word() for _ in range(30)]
        if i % 3:
            w += shared + [word() for _ in range(rng.randint(0, 30))]
        if i % 4 == 0:
            w += left + [word() for _ in range(11)] + right
        texts.append(" ".join(w))
    texts += [" ".join(left + ["m"] * 11 + right)] * 2 + [" ".join([word() for _ in range(5)] + shared[:34]) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["kept_text"] for r in substring.remove_repeats(docs, hot_passages=hot, shard_passages=20).collect()}
    assert [got[i].split() for i in range(len(texts))] == [[x.decode() for x in k] for k in brute_removed(texts, 35)]


def test_substring_odd_rows(spark):
    docs = odd_docs(spark)
    got = substring.remove_repeats(docs).toPandas()
    texts = [r["text"] for r in docs.collect()]
    want = Counter((len(words(t)), len(words(t)) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for t, k in zip(texts, brute_removed(texts, 35), strict=True))
    assert Counter(zip(got.n_words, got.n_removed, got.kept_sha256, strict=True)) == want
    assert {"d", "k", "begins", "size"} <= set(got.columns)
    assert substring.remove_repeats(empty_docs(spark)).count() == 0


# --- 4 language -----------------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    unit = langid.Unit(rng, 4, 3)
    unit.p = {k: v.astype(np.float64) for k, v in unit.p.items()}
    data, up = rng.integers(0, 256, (6, 5)), rng.normal(size=(6, 5, 4))
    unit.run(data)
    grad = unit.back(up)
    for name, at in (("keep", (1, 2)), ("keep", (3, 9)), ("enter", (int(data[2, 1]), 5)), ("enter", (int(data[0, 0]), 10))):
        eps, was = 1e-6, unit.p[name][at]
        unit.p[name][at] = was + eps
        more = (unit.run(data) * up).sum()
        unit.p[name][at] = was - eps
        less = (unit.run(data) * up).sum()
        unit.p[name][at] = was
        assert abs((more - less) / (2 * eps) - grad[name][at]) < 1e-3


def test_labels_of_bytes_as_a_plain_network_gives_them():
    """The fast passes against the equations, a byte at a time, in double precision."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdef ") for _ in range(200)) for _ in range(10)] + ["".join(rng.choice("uvwxyz ") for _ in range(200)) for _ in range(10)]
    model = langid.train(texts, ["aa"] * 10 + ["zz"] * 10, steps=20)
    logistic = lambda v: 1 / (1 + np.exp(-v))

    def states(d, data):
        n = d.keep.shape[1]
        h = np.zeros(n)
        for byte in data:
            x, keep = d.enter[byte].astype(float), d.keep.astype(float)
            z, r = logistic(2 * (x[:n] + keep[:n] @ h)), logistic(2 * (x[n : 2 * n] + keep[n : 2 * n] @ h))
            new = np.tanh(x[2 * n :] + r * (keep[2 * n :] @ h))
            h = z * h + (1 - z) * new
            yield d.leave.astype(float) @ h

    for text in ("fade", "vwx abc", "é" * 30, "ab cd ef " * 120):
        data, total = text.encode(), np.zeros(2)
        for a in range(0, len(data), langid.SEGMENT):
            own = data[a : a + langid.SEGMENT]
            for f, b in zip(states(model.forward, own), list(states(model.backward, own[::-1]))[::-1], strict=True):
                e = np.exp(f + b + model.bias)
                total += e / e.sum()
        assert model.probabilities([b"zz", data, b"a" * 700])[1] == pytest.approx(total / len(data), abs=1e-4)


def test_language_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 40}") for i in range(4000)], "doc_id bigint, text string, lang string")
    assert 1200 < len(langid.training_sample(docs, 50, 100)) < 3600
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(langid, "BROADCAST_LANGUAGES", 0)
    rows = langid.training_sample(docs, 50, 100)
    assert 100 < len(rows) < 450 and len({r["lang"] for r in rows}) > 30


def test_language_held_out(spark):
    got = queries.queries()["op4_gru_language"](spark, "/root/testdata/sf0.01").toPandas().merge(table("documents", "/root/testdata/sf0.01"), on="doc_id")
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang == held.lang_pred).mean() > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.itertuples())


def test_language_odd_rows(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(40)] + ["".join(rng.choice("uvwxyz ") for _ in range(300)) for _ in range(40)]
    model = langid.train(texts, ["aa"] * 40 + ["zz"] * 40, steps=60)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "abc"), (5, "vwxyz" * 40_000), (5, "vwxyz" * 40_000), (None, "fade")]
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()]
    assert Counter(got) == Counter([(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "zz"), (5, "zz"), (None, "aa")])
    alone, many = model.predict(["fade"]), model.predict(["fade", "vwxyz" * 100, "zz"])
    assert alone[0][0] == many[0][0] and abs(alone[0][1] - many[0][1]) < 1e-5
    assert langid.identify(empty_docs(spark), model).count() == 0
    nothing = langid.fit(empty_docs(spark))
    assert nothing.predict(["text"]) == [("und", 0.0)]


# --- 5 packing ------------------------------------------------------------------------------------


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    window, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    room: list[int] = []
    for n, w, o in zip(lengths, window.tolist(), offset.tolist(), strict=True):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[w] == min(fits) and o == 64 - room[w]
        else:
            assert w == len(room) and o == 0
            room.append(64)
        room[w] -= n


def check_packing(got, docs, sequence=2048):
    e = tokens.Encoder(tokens.default_path("byte_bpe_50k.json"), True)
    want = Counter()
    pieces = Counter()
    for doc, ids in zip(docs.doc_id, e.library([t or "" for t in docs.text]), strict=True):
        ids += tokens.END_ID
        want[(None if pd.isna(doc) else int(doc), zlib.crc32(ids), len(ids) // 4)] += 1
        for start in range(0, len(ids) // 4, sequence):  # full windows, then the rest
            part = ids[4 * start : 4 * (start + sequence)]
            pieces[(None if pd.isna(doc) else int(doc), start, len(part) // 4, zlib.crc32(part), len(ids) // 4)] += 1
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()) == pieces
    assert got.groupby("sequence_id").length.sum().max() <= sequence
    z = got.sort_values(["sequence_id", "offset"])
    assert (z.groupby("sequence_id").length.cumsum() - z.length == z.offset).all()
    assert got.length.sum() == sum(n * k for (_, _, n), k in want.items())
    whole = got[got.length == got.doc_tokens]
    assert not Counter((None if pd.isna(d) else int(d), c, n) for d, c, n in zip(whole.doc_id, whole.ids_crc32, whole.length, strict=True)) - want


def test_packing_query(spark):
    got = queries.queries()["op5_best_fit_packing"](spark, SF).toPandas()
    check_packing(got, table("documents"))
    assert 2048 * got.sequence_id.nunique() - got.length.sum() < 4096


def test_packing_of_one_row_many_times(spark):
    docs = spark.createDataFrame([(1, "the same text again")] * 2500 + [(None, f"text {i}") for i in range(300)], "doc_id bigint, text string").repartition(5)
    got = packing.pack(docs, sequence=64, shard_documents=300).toPandas()
    check_packing(got, docs.toPandas(), 64)
    shards = (got.sequence_id // 2**40).value_counts()
    assert len(shards) == 10 and shards.max() < 450


def test_packing_odd_rows(spark):
    docs = odd_docs(spark)
    check_packing(packing.pack(docs).toPandas(), docs.toPandas())
    assert packing.pack(empty_docs(spark)).count() == 0


# --- 6 MinHash ------------------------------------------------------------------------------------


def brute_groups(ids, texts, width, percent):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for t in texts:
        w = (t or "").encode().translate(low).split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    part = {i: i for i in ids}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                part[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in zip(ids, sets, strict=True)}


def check_groups(got, ids, texts, width, percent):
    groups, sizes = brute_groups(ids, texts, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.itertuples()} == {i: (sizes[i], groups[i], groups[i] == i) for i in ids}


def test_minhash_query(spark):
    docs = table("documents")
    check_groups(queries.queries()["op6_tensored_minhash"](spark, SF).toPandas(), docs.doc_id.tolist(), docs.text.tolist(), 3, 85)


def near_copies(seed=4):
    """A base that links copies which are not linked with each other, a chain, and strangers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(200)]
    texts = []
    for _ in range(40):
        w = list(base)
        for at in rng.sample(range(200), 4):
            w[at] = word()
        texts.append(" ".join(w))
    chain = [word() for _ in range(200)]
    for _ in range(15):
        chain = list(chain)
        for at in rng.sample(range(200), 4):
            chain[at] = word()
        texts.append(" ".join(chain))
    texts += [" ".join(word() for _ in range(50)) for _ in range(10)]
    texts.append(" ".join(base).upper())
    return texts


@pytest.mark.parametrize("block", [2000, 8])
def test_minhash_copies(spark, block):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check_groups(neardup.components(docs, block=block).toPandas(), list(range(len(texts))), texts, 3, 85)


def test_groups_in_many_batches(spark):
    """Blocks, shards and buckets that come in many small Arrow batches give what they give in one."""
    from lodestone.llm.common import light_batches

    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = sorted(map(tuple, substring.remove_repeats(docs, hot_passages=3, shard_passages=20).collect()))
    with light_batches(spark, 3000):
        check_groups(neardup.components(docs, block=2000).toPandas(), list(range(len(texts))), texts, 3, 85)
        assert sorted(map(tuple, substring.remove_repeats(docs, hot_passages=3, shard_passages=20).collect())) == spans


def test_minhash_odd_rows(spark):
    got = neardup.components(odd_docs(spark)).toPandas()
    assert len(got) == 13
    by = {r.doc_id: r for r in got.itertuples() if not pd.isna(r.doc_id)}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[4].n_shingles == by[5].n_shingles == 1
    assert by[7].component_id == 6 and not by[7].kept and by[6].kept
    assert got[got.doc_id.isna()].kept.all()
    assert neardup.components(empty_docs(spark)).count() == 0
    kept = neardup.drop_near_duplicates(odd_docs(spark))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 6, 8, 9, 9] and kept.columns == odd_docs(spark).columns


# --- 7 and 10 vectors -----------------------------------------------------------------------------


def vector_rows(spark, seed=2, n=400, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:80] = x[50] + rng.normal(scale=0.02, size=(30, dim))
    x[90] = x[91] = x[92]
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(n)]
    odd = [(1000, None), (1001, [float("nan")] * dim), (1002, [None] + [1.0] * (dim - 1)), (1003, [0.0] * dim), (1004, [float("inf")] * dim), (1050, []), (None, rows[3][1]), rows[7], (1051, rows[5][1][:-1])]
    return rows, spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")


@pytest.mark.parametrize("options", [{}, {"group_queries": 3, "slice_rows": 50, "pivots": 9}])
def test_top_products(spark, options):
    rows, frame = vector_rows(spark)
    x = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64)
    ids = [i for i, _ in rows] + [1003, 1051]
    x = np.concatenate([x, np.zeros((1, x.shape[1]), np.int64), np.append(x[5][:-1], 0)[None]])  # filled with a zero
    want = []
    for k, i in enumerate(ids):
        if i % 50 == 0:
            best = sorted((-int(x[k] @ x[j]), ids[j]) for j in range(len(ids)) if j != k)[:5]
            want += [(i, r + 1, v, -s) for r, (s, v) in enumerate(best)]
    frame = frame.withColumns({c: F.lit(7) for c in ("id", "q", "cell", "grp", "part", "score", "rank")})  # names that are used inside
    got = vectors.top_products(frame, F.pmod("vec_id", F.lit(50)) == 0, **options).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_products_sends_few_rows_of_clusters(spark, caplog):
    """Rows in tight clusters, and rows whose norms differ: most cells are ruled out, the answers stay exact."""
    rng = np.random.default_rng(12)
    level = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centres = level(rng.normal(size=(40, 32)))
    clusters = level(centres[rng.integers(0, 40, 4000)] + rng.normal(scale=0.02, size=(4000, 32)))
    norms = level(rng.normal(size=(4000, 32))) * np.exp(rng.normal(scale=1.5, size=(4000, 1)))
    for x, most in ((clusters, 0.25), (norms, 0.5)):
        frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
        caplog.clear()
        with caplog.at_level("INFO", logger=vectors.__name__):
            got = vectors.top_products(frame, F.pmod("vec_id", F.lit(50)) == 0, group_queries=8).collect()
        sent, of, groups = next(r.args for r in caplog.records if "cells" in r.msg)
        assert sent / of < most and groups >= 10
        whole = np.floor(256 * x).astype(np.int64)
        want = []
        for i in range(0, len(x), 50):
            score = whole @ whole[i]
            best = [j for j in np.lexsort((np.arange(len(x)), -score)) if j != i][:5]
            want += [(i, r + 1, int(j), int(score[j])) for r, j in enumerate(best)]
        assert sorted(map(tuple, got)) == want


def test_top_products_few_rows(spark):
    assert vectors.top_products(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in vectors.top_products(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 7, 65536)]


@pytest.mark.parametrize("times", [2, 6])
@pytest.mark.parametrize("n", [20, 400])
def test_top_products_repeated_rows(spark, times, n):
    rows, _ = vector_rows(spark, n=n) if n > 92 else ([(i, [float(v) for v in x]) for i, x in enumerate(np.random.default_rng(6).normal(size=(n, 8)).astype(np.float32))], None)
    once = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    often = spark.createDataFrame(rows * times, "vec_id bigint, embedding array<float>")
    want, got = (sorted(map(tuple, vectors.top_products(f, F.col("vec_id") % 10 == 0).collect())) for f in (once, often))
    assert got == want and len(got) == 5 * len([i for i, _ in rows if i % 10 == 0])


def brute_cosine(ids, x, least=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    part = {i: i for i in ids}

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = find(ids[a]), find(ids[b])
        part[max(p, q)] = min(p, q)
    return {i: (int(near[k].sum()), find(i), find(i) == i) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block", [1024, 7])
def test_cosine_components(spark, block):
    rows, frame = vector_rows(spark)
    want = brute_cosine([i for i, _ in rows], np.array([v for _, v in rows], np.float32).astype(float))
    want |= {i: (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1050, 1051)}
    frame = frame.withColumns({c: F.lit(7) for c in ("id", "same", "g", "pass", "key", "component", "copies", "others", "n_links")})  # names that are used inside
    got = vectors.cosine_components(frame, block=block).collect()
    assert len(got) == len(rows) + 9
    for r in got:
        assert tuple(r)[1:] == (want[r["vec_id"]] if r["vec_id"] is not None else (0, None, True)), r
    assert vectors.cosine_components(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def cone_rows(n=24_000, dim=64, pairs=300, seed=5):
    """A third of the rows in one cone (cosine about 0.9 with each other), in it pairs at cosine 0.955."""
    rng = np.random.default_rng(seed)
    level = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = level(rng.normal(size=(n, dim)))
    axis = x[0]
    side = rng.normal(size=(n // 3, dim))
    side = level(side - (side @ axis)[:, None] * axis)
    x[: n // 3] = np.sqrt(0.9) * axis + np.sqrt(0.1) * side
    a = x[:pairs]
    across = rng.normal(size=a.shape)
    across = level(across - (across * a).sum(1)[:, None] * a)
    x[n // 3 - pairs : n // 3] = 0.955 * a + np.sqrt(1 - 0.955**2) * across
    return x[rng.permutation(n)].astype(np.float32)


@pytest.mark.parametrize("options", [{}, {"carry": 10}])
def test_cosine_components_of_crowded_rows(spark, options):
    x = cone_rows()
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    u = vectors.unit(x.astype(float))
    links = np.zeros(len(x), int)
    for a in range(0, len(x), 2000):
        links[a : a + 2000] = (u[a : a + 2000] @ u.T >= 0.95).sum(1) - 1
    assert links.sum() >= 600
    got = {r["vec_id"]: r["n_links"] for r in vectors.cosine_components(frame, **options).collect()}
    assert [got[i] for i in range(len(x))] == links.tolist()


def test_cosine_components_in_many_partitions(spark):
    rng = np.random.default_rng(11)
    a, across = rng.normal(size=(2, 125, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    across -= (across * a).sum(1)[:, None] * a
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.concatenate([a, 0.951 * a + np.sqrt(1 - 0.951**2) * across]))]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        got = {r["vec_id"]: tuple(r)[1:] for r in vectors.cosine_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), carry=10).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == {i: (1, i % 125, i < 125) for i in range(250)}


# --- 8 token tables -------------------------------------------------------------------------------


def test_table_file(monkeypatch):
    rng = np.random.default_rng(1)
    w, parts, rows = sstable.Writer(2, 3), [], []
    for doc in [None, None, -5, -5, *range(0, 4000, 3)]:
        ids = rng.integers(0, 60_000, rng.integers(1, 200)).astype("<u2").tobytes()
        if doc == 3:
            ids = sstable.MARK * 3  # the mark itself, as ids
        rows.append((doc, np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
        parts += list(w.add(doc, ids))
    parts += list(w.finish())
    data = b"".join(p + sstable.MARK for p in parts)
    assert data.split(sstable.MARK) == [*parts, b""]
    r = sstable.Table.of(data)
    assert list(r.scan()) == rows and len(r.blocks) > 3
    for doc in (None, -5, 0, 3, 2997, 3999):
        assert r.get(sstable.key_of(doc)) == [v for d, v in rows if d == doc]
    assert r.get(sstable.key_of(1)) == [] and r.get(sstable.key_of(10**9)) == []
    for broken in (data[:-5], data[: -64 - 16 - 2] + sstable.MARK, b""):
        with pytest.raises(ValueError):
            sstable.Table.of(broken)
    with pytest.raises(ValueError):
        list(sstable.entries(parts[0][:-1] + b"?"))


def test_table_folder(spark, tmp_path):
    """Files of few documents; a hot id fills several; lookups and both kinds of reading agree."""
    rng = random.Random(3)
    rows = [(7 if i % 3 == 0 else i, " ".join(rng.choice("abc de fgh ij".split()) for _ in range(rng.randint(0, 60)))) for i in range(600)] + [(None, "none"), (-4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    folder = str(tmp_path / "tables")
    sstable.write_tables(docs, folder, shard_bytes=2000)
    e = tokens.Encoder(tokens.default_path("word_bpe_49k.json"), False)
    want: dict = {}
    for (doc, _), ids in zip(rows, e.library([t or "" for _, t in rows]), strict=True):
        want.setdefault(doc, []).append(ids + tokens.END_ID)
    got = sstable.Folder(spark, folder)
    assert len(got.files) > 8 and sum(got.table(k).documents for k in range(len(got.files))) == len(rows)
    assert sum(sstable.key_of(7) in got.table(k).firsts for k in range(len(got.files))) >= 2
    for doc in [None, -4, 7, 8, 599, 598, 3, 10**12]:
        assert sorted(got.get(doc)) == sorted(want.get(doc, []))
    read = sstable.read_tables(spark, folder)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in read.collect()) == Counter((d, zlib.crc32(v)) for d, vs in want.items() for v in vs)
    before = {r["file"]: r["before"] for r in sstable.ids_before(read, together=3).collect()}
    sizes = [got.table(k).ids for k in range(len(got.files))]
    assert before == {k: sum(sizes[:k]) for k in range(len(sizes))}


def check_tables(got, docs):
    e = tokens.Encoder(tokens.default_path("word_bpe_49k.json"), False)
    want = Counter()
    for doc, ids in zip(docs.doc_id, e.library([t or "" for t in docs.text]), strict=True):
        want[(None if pd.isna(doc) else int(doc), len(ids) // 4 + 1, zlib.crc32(ids + tokens.END_ID))] += 1
    z = got.sort_values("start")
    assert (z.n_tokens.cumsum() - z.n_tokens == z.start).all()
    assert z.doc_id.dropna().is_monotonic_increasing
    assert Counter((None if pd.isna(d) else int(d), n, c) for d, n, c in zip(z.doc_id, z.n_tokens, z.ids_crc32, strict=True)) == want


def test_token_tables(spark, tmp_path):
    check_tables(queries.queries()["op8_sstable_tokens"](spark, SF).toPandas(), table("documents"))
    check_tables(sstable.token_tables(odd_docs(spark)).toPandas(), odd_docs(spark).toPandas())
    assert sstable.token_tables(empty_docs(spark)).count() == 0


# --- 9 mixing -------------------------------------------------------------------------------------


def targets(spark, rows, weights=(5.0, 2.0, 1.0), budget=1.5, most=2.0):
    sources = spark.createDataFrame(rows, "source string, size bigint")
    return {r["source"]: r["target"] for r in mixing.source_targets(sources, weights, budget, most).collect()}


def shared_out(rows, weights, budget, most):
    """By hand: a source that passes its limit stops there, the rest is shared anew, one at a time."""
    order = sorted(rows, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    out, open_ = {}, dict(order)
    while open_:
        level = (budget * sum(n for _, n in rows) - sum(out.values())) / sum(weight[s] for s in open_)
        tight = min(open_, key=lambda s: most * open_[s] / weight[s])
        if most * open_[tight] >= level * weight[tight]:
            return out | {s: level * weight[s] for s in open_}
        out[tight] = most * open_.pop(tight)
    return out


def test_targets(spark):
    got = targets(spark, [("b", 100), ("a", 10), (None, 50), ("c", 1000)])
    assert got["a"] == 20 and got["b"] == 200 and got[None] == 100 and abs(sum(got.values()) - 1.5 * 1160) < 1e-6
    assert targets(spark, []) == {} and targets(spark, [("z", 0)]) == {"z": 0}
    rng = random.Random(4)
    for n in (1, 2, 7, 40):
        rows = [(f"{chr(rng.choice([65, 97, 0x3B1, 0xFFFF, 0x1F600]))}{i}", rng.choice([0, 1, 5, 1000, 10**6])) for i in range(n)] + [(None, 3)]
        want, got = shared_out(rows, (5.0, 2.0, 1.0), 1.5, 2.0), targets(spark, rows)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


@given(st.lists(st.tuples(st.integers(1, 50), st.floats(0.01, 0.99)), min_size=1, max_size=60), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_pivot(rows, seed):
    size, p = np.array([s for s, _ in rows]), np.array([x for _, x in rows])
    out = mixing.pivot(size, p, np.random.default_rng(seed).random(len(rows)))
    assert ((out > 0) & (out < 1)).sum() <= 1 and (out >= 0).all() and (out <= 1).all()
    assert abs((size * out).sum() - (size * p).sum()) < 1e-4


def test_pivot_keeps_expectations():
    size, p = np.array([3, 1, 5, 2]), np.array([0.3, 0.6, 0.25, 0.7])
    mean = np.mean([mixing.pivot(size, p, np.random.default_rng(s).random(4)) for s in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_mix_query(spark):
    f = queries.queries()["op9_pivotal_mix"]
    got, docs = f(spark, SF).toPandas(), table("documents")
    merged = got.merge(docs, on="doc_id")
    assert len(merged) == len(docs) and (merged["size"] == [len(words(t)) for t in merged.text]).all() and (merged.taken <= 2 * merged["size"]).all()
    for _, g in merged.groupby("source"):
        assert g.source_size.iloc[0] == g["size"].sum() and abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    again = f(spark, SF).toPandas().sort_values("doc_id")
    assert again.taken.tolist() == got.sort_values("doc_id").taken.tolist()


def test_mix_as_by_hand(spark):
    """Few enough documents for one group of each source: every decision is followed."""
    import xxhash

    docs = table("documents")
    docs["source"] = docs.source.where(docs.doc_id % 3 > 0, "one")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(spark.createDataFrame(docs[["doc_id", "text", "source"]])).collect()}
    size = {i: len(words(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    own: dict = {}
    for i, s in zip(docs.doc_id, docs.source, strict=True):
        own.setdefault(s, []).append(i)
    goal = shared_out([(s, sum(size[i] for i in ids)) for s, ids in own.items()], (5.0, 2.0, 1.0), 1.5, 2.0)
    undecided = 0
    for s, ids in own.items():
        rate = goal[s] / sum(size[i] for i in ids)
        part = rate - int(rate)
        ids = sorted((i for i in ids if size[i]), key=lambda i: (-size[i], str(i)))
        p, held = dict.fromkeys(ids, part), None
        for k, i in enumerate(ids) if 1e-9 < part < 1 - 1e-9 else ():
            if held is None:
                held = i
                continue
            draw = xxhash.xxh3_64_intdigest(f"0:0:{i}:{k}".encode()) / 2**64
            up, down = min((1 - p[held]) * size[held], p[i] * size[i]), min(p[held] * size[held], (1 - p[i]) * size[i])
            move = up if draw * (up + down) < down else -down
            p[held], p[i] = p[held] + move / size[held], p[i] - move / size[i]
            held = next((x for x in (held, i) if 1e-9 < p[x] < 1 - 1e-9), None)
        for i in ids:
            if 1e-9 < p[i] < 1 - 1e-9 and len(ids) > 1:
                undecided += 1  # the last of a source is drawn
                assert got[i] in (int(rate) * size[i], (int(rate) + 1) * size[i])
            else:
                assert got[i] == (int(rate) + round(p[i])) * size[i]
    assert undecided <= len(own)


def test_mix_tree(spark):
    rows = [(i, "w " * (1 + i % 7), "s" if i % 3 else "t", None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = mixing.mix_sources(docs, group_documents=8, fan_in=3).toPandas()
    assert len(got) == 600
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 7


def test_mix_of_one_row_many_times(spark, monkeypatch):
    """Copies of one row are dealt to many groups, and a table of sources that is not broadcast gives the same."""
    rows = [(7, "a b c", "s")] * 5000 + [(i, "d e", "t") for i in range(400)] + [(i, "f", None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = key(mixing.mix_sources(docs, group_documents=64, fan_in=4))
    assert len(got) == 5500
    for source in ("s", "t", None):
        own = [r for r in got if r[1] == source]
        assert abs(sum(r[6] for r in own) - own[0][4]) <= 3
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert key(mixing.mix_sources(docs, group_documents=64, fan_in=4)) == got


def test_mix_odd_rows(spark):
    got = mixing.mix_sources(odd_docs(spark)).toPandas()
    assert len(got) == 13 and (got[got["size"] == 0].taken == 0).all() and (got.taken <= 2 * got["size"]).all()
    assert mixing.mix_sources(empty_docs(spark)).count() == 0
