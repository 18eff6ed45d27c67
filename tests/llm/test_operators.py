"""Each operator against a plain computation of the same result, on small rows with the awkward cases in them."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonegauge.llm import boosting, bpe, html, langid, licences, queries, simhash, suffix, topk, toxicity, warc, winnow

DOCS = "doc_id bigint, text string, fingerprint string, score double"


def documents(spark, rows, partitions=3):
    """Rows of (doc_id, text), with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], DOCS).repartition(partitions)


@pytest.fixture(scope="module")
def words():
    draw = random.Random(4)
    return ["".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(300)]


@pytest.fixture(scope="module")
def corpus(words):
    """Texts with exact copies, near copies, shared passages, repeats inside a text, empty and NULL texts."""
    draw = random.Random(9)
    line = lambda n: " ".join(draw.choices(words, k=n))
    shared, texts = line(60), []
    for i in range(30):
        texts.append(line(draw.randint(1, 120)) + ("\n" + shared if i % 5 == 0 else "") + " " + line(5))
    texts += [texts[3], texts[3], texts[7] + " tail", "Ünï " + texts[8], shared + shared, "a" * 350, "", None, None, "é" * 130, texts[9].upper(), "x"]
    return [(i if i != 20 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (6, line(90))]


# 1 html


def plain_article(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", inside)
    return "\n".join(flat for b in blocks if (flat := " ".join(re.sub(r"<[^>]*>", " ", b).replace("&amp;", "&").split())))


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
    '<div class="ad">Buy now</div><article><h1>{0}</h1><p>{1} &amp; more<br>after</p><p><b>{1}</article><footer>&copy; site</footer></body></html>'
)


def test_html_extracts_articles(spark):
    pages = [(i, PAGE.format(f"Head {i}", " ".join(["word"] * i))) for i in range(1, 30)]
    special = [(100, None), (101, ""), (102, "<div><div>"), (102, "<div><div>"), (103, "<script>x")]
    frame = spark.createDataFrame([(i, h, "clash") for i, h in pages + special], "page_id bigint, html string, text string")
    found = [(r.page_id, r.text, r.n_chars) for r in html.extract_pages(frame, F.col("html"), {"page_id": "bigint"}).collect()]
    assert len(found) == len(pages) + len(special)
    for i, page in pages:
        assert (i, plain_article(page), len(plain_article(page))) in found
    assert sorted(f for f in found if f[0] >= 100) == [(100, "", 0), (101, "", 0), (102, "", 0), (102, "", 0), (103, "", 0)]


def test_html_decoding_never_keeps_a_child_of_a_dropped_node():
    nodes = html.parse("<div><section><p>a</p><p>b</p></section></div><p>c")
    draw = np.random.default_rng(1)
    for _ in range(200):
        score = draw.normal(0, 3, len(nodes))
        kept = html.decode(nodes, score)
        assert all(kept[n.parent] for n, k in zip(nodes, kept) if k and n.parent >= 0)


def test_html_hidden_is_an_attribute_not_a_word():
    marks = {page: html.parse(page)[1].hidden for page in ('<a title="the hidden cost">x</a>', "<figure title='a hidden gem' class=b>x</figure>", "<p data-x = hidden >x</p>", "<p hidden>x</p>", '<p class="a" hidden="">x</p>', "<p HIDDEN/>", '<p title="a"hidden>x</p>')}
    assert list(marks.values()) == [False, False, False, True, True, True, True]


def test_html_keeps_embedded_text_of_kept_elements():
    nodes = html.parse("<article><p>sum <math><mi>x</mi></math> <object><p>plan</p><script>no</script></object><canvas>chart <b hidden>no</b></canvas> <svg>no</svg></p></article><nav><math>no</math></nav>")
    score = np.array([2.0 if n.tag in ("#root", "article", "p") else -9.0 for n in nodes])
    assert html.text_of(nodes, html.decode(nodes, score)).split() == ["sum", "x", "plan", "chart"]


@pytest.mark.parametrize("page, words", [
    ("<p>a<!-->b</p><p>c", "ab c"), ("<p>a<!--->b", "ab"), ("<p>a<!-- x --!>b", "ab"), ("<p>a<!-- x -- >y-->b", "ab"), ('<p title="abc>text</p><p>more', "text more"),
    ("<p title=don't>one</p><p>it's</p>", "one it's"), ('<a href="x>y">k</a>', "k"), ("<p class='a' id=\"b>c\">z</p>", "z"), ("<p>a</i></b>b", "ab"),
])
def test_html_markup_that_is_not_well_formed(page, words):
    nodes = html.parse(page)
    assert html.text_of(nodes, [True] * len(nodes)).split() == words.split()


def test_html_stray_end_tags_cost_no_walk():
    import time

    started = time.perf_counter()
    nodes = html.parse("<b>" * 100_000 + "x</i>" * 100_000)
    assert len(nodes) == 100_001 and time.perf_counter() - started < 20


def test_html_on_unseen_layouts():
    model, right = html.train(), 0
    layouts = html.training_pages(60, seed=5)
    for page in layouts:
        marks = [True, *(m == "1" for m in re.findall(r'<[a-z0-9]+ data-k="(\d)"', page))]
        bare = re.sub(r"<head>.*?</head>", "", page).replace(' data-k="0"', "").replace(' data-k="1"', "")
        right += html.extract(bare, model) == html.text_of(html.parse(bare), marks)
    assert right >= 0.9 * len(layouts)


# 2 language


def test_language_held_out(spark):
    draw = random.Random(3)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "aeiou", "ee": "xyzab"}
    rows = [(i, " ".join("".join(draw.choices(alphabets[n], k=4)) for _ in range(30)), n) for i, n in enumerate(sorted(alphabets) * 40)]
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "bb"), (903, rows[0][1], None)]
    docs = spark.createDataFrame([(*r, "c") for r in rows + extra], "doc_id bigint, text string, lang string, lang_pred string")
    found = {r.doc_id: r for r in langid.identify(docs, F.col("doc_id") % 3 != 1, {"doc_id": "bigint"}).collect()}
    held = [(found[i].lang_pred, n) for i, _, n in rows if i % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[903].lang_pred == rows[0][2]
    assert all(0 <= r.score <= 1 for r in found.values())


@pytest.mark.parametrize("count", [2, 4, 6, 12])
def test_codewords_are_apart(count):
    code = langid.codewords(count)
    apart = (code.shape[1] - code @ code.T) / 2
    assert apart[~np.eye(count, dtype=bool)].min() >= max(1, code.shape[1] / 5)


def test_language_samples_copies_once_and_long_texts(spark):
    rows = [("da", f"dansk tekst nummer {i}") for i in range(30) for _ in range(100)] + [("fi", "suomi " * 4000 + str(i)) for i in range(5)] + [("en", f"short {i}") for i in range(40)] + [("en", "long " * 5000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = langid.sample_documents(docs, F.lit(True), per_language=3)
    by = {name: {t for n, t in found if n == name} for name in ("da", "fi", "en")}
    assert len(found) == 8 and {name: len(texts) for name, texts in by.items()} == {"da": 3, "fi": 2, "en": 3}
    assert all(name_text in rows for name_text in found) and max(map(len, by["en"])) < 20
    found = langid.sample_documents(docs, F.lit(True), per_language=150)
    assert sorted(found) == sorted({r for r in rows if r[0] != "en" or len(r[1]) < 20})


def test_language_learns_nothing_from_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert langid.identify(docs, F.lit(True), {"doc_id": "bigint"}).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], docs.schema)
    assert langid.identify(one, F.lit(True), {"doc_id": "bigint"}).first().lang_pred == "und"


# 3 tokens


def test_bpe_agrees_with_the_library(spark, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    draw = random.Random(8)
    rows = corpus + [(1000 + i, t) for i, t in enumerate(["th" * 3000 + "x", "<|endoftext|>A<|startoftext|>", "ΣΑΣ İ \x1c　é", "".join(draw.choices("theinar", k=5000)), "ab'S don't!!"])]
    found = bpe.encode_texts(documents(spark, rows), F.col("text"), path, {"doc_id": "bigint"}, with_ids=True).collect()
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in found), key=key) == sorted(want, key=key)
    for r in found:
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_bpe_parts_of_long_runs_in_several_tasks(spark):
    """Runs beyond the part length, between other words, repeated and in other alphabets: as if encoded in one piece."""
    draw = random.Random(21)
    run = lambda n, letters: "".join(draw.choices(letters, k=n))
    texts = [run(5000, "abcdefghijklmnop"), "some words " + run(700, "etaoinshrdlu") + ". Ünd " + run(333, "éüßñ") + "'s, end", run(900, "漢字かな"), run(260, "1234567890!?") * 2, "[CLS] " + run(1000, "ab")]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, texts[0]), (20, None), (21, ""), (22, "short words only"), (23, "x " * 400), (24, run(199, "abc") + " " + run(201, "abc"))]
    path = public_tokenizers.path("word_bpe_49k.json")
    by_part = lambda part: sorted(map(tuple, bpe.encode_texts(documents(spark, rows), F.col("text"), path, {"doc_id": "bigint"}, with_ids=True, part=part).collect()), key=str)
    assert by_part(200) == by_part(1 << 20) and len(by_part(200)) == len(rows)
    library = Tokenizer.from_file(path)
    for found in by_part(200):
        text = dict(rows)[found[0]] or ""
        assert found[4] == library.encode(text, add_special_tokens=False).ids
    model = bpe.BpeModel(bpe.load_spec(path))
    cut = bpe.encode_parts(spark.createDataFrame([("s", texts[0])], "s string, t string"), lambda: model, 200)
    assert cut.select(F.spark_partition_id()).distinct().count() > 1 and cut.where("seq = 1").count() == 25


def test_bpe_tables_are_small(spark, corpus):
    """Tables have a bound, hold the vocabulary's strings and no copies, and forgetting changes no result."""
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t for _, t in corpus if t] + ["unbelievable hyperparameterisations " + "".join(random.Random(4).choices("etaoin", k=900))]
    model, small = (bpe.BpeModel(bpe.load_spec(path)) for _ in range(2))
    tables = [small.words, small.windows, *small.leaves]
    for table in tables:
        table.most = 7
    assert [small.encode(t) for t in texts] == [model.encode(t) for t in texts]
    assert [small.words[c] for t in texts for c in small.chunks(t)] == [model.words[c] for t in texts for c in model.chunks(t)]
    assert max(map(len, tables)) <= 7
    held = [token for table in (model.windows, *model.leaves) for tokens in table.values() for token in tokens if token in model.numbers]
    assert len(held) > 100 and all(token is model.names[model.numbers[token]] for token in held)
    found = bpe.encode_texts(documents(spark, corpus), F.col("text"), path, {"doc_id": "bigint"}, with_ids=True)
    lean = bpe.encode_texts(documents(spark, corpus), F.col("text"), path, {"doc_id": "bigint"}, with_ids=True, with_decoded=False)
    assert lean.columns == found.drop("decoded").columns
    assert sorted(lean.collect(), key=str) == sorted(found.drop("decoded").collect(), key=str)


def test_bpe_tree_equals_one_merge():
    model = bpe.BpeModel(bpe.load_spec(public_tokenizers.path("word_bpe_49k.json")))
    draw = random.Random(2)
    for letters in ("ab", "the", "aeinrst", "o"):
        for size in (1, 24, 25, 49, 300, 1111):
            piece = "".join(draw.choices(letters, k=size))
            symbols = [*piece[:-1], piece[-1] + "</w>"]
            assert list(model.encode_piece(piece)) == model._merge_long(symbols) == model.merge(symbols)


# 4 near-duplicates


def plain_fingerprint(text, size=3):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(found[i : i + size]) for i in range(len(found) - size + 1)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (id, fingerprint) -> smallest id reachable for each row."""
    rows = list(range(len(prints)))
    up = {i: i for i in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in rows:
        for j in rows[:i]:
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                up[root(i)] = root(j)
    ids = {}
    for i in rows:
        ids.setdefault(root(i), []).append(prints[i][0])
    return [min((x for x in ids[root(i)] if x is not None), default=None) for i in rows]


def test_simhash_components(spark, corpus):
    found = simhash.near_duplicates(documents(spark, corpus)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in corpus]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in found], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("bound", [4, 512])
def test_simhash_links_on_either_path(spark, bound):
    """A dense group, with the bound under and over its size: the same components as all pairs have."""
    draw = random.Random(6)
    center, values = draw.getrandbits(64), {0}
    for _ in range(120):
        value = center
        for bit in draw.sample(range(64), draw.randint(0, 5)):
            value ^= 1 << bit
        values.add(value)
    values = sorted(values)
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp bigint")
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(frame, bound)).collect()}
    want = plain_components(list(enumerate(values)))
    groups = {}
    for v, c in zip(values, want):
        groups.setdefault(c, set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_simhash_keeps_one_of_each(spark, corpus):
    kept = simhash.one_of_each(documents(spark, [r for r in corpus if r[0] is not None])).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in corpus if i is not None]
    assert sorted(r.doc_id for r in kept) == sorted(set(plain_components(prints)))
    assert simhash.near_duplicates(documents(spark, [], 1)).count() == 0


def test_simhash_keeps_one_without_ids(spark, words):
    """Near copies without ids: one of them stays, or none where the group has a document with an id."""
    draw = random.Random(12)
    texts = [" ".join(draw.choices(words, k=60)) for _ in range(3)]
    near = lambda text: next(t for k in range(2000) if (t := f"{text} {k}") and 0 < (plain_fingerprint(t) ^ plain_fingerprint(text)).bit_count() <= 2)
    rows = [(None, texts[0]), (None, near(texts[0])), (None, texts[0]), (7, texts[1]), (None, near(texts[1])), (8, texts[1]), (9, texts[2]), (9, texts[2])]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id bigint, text string, _hash int, __row int, _DOC int")
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 7, 9]


# 5 toxicity


def test_toxicity_learns_words_and_stems(spark, words):
    draw = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        toxic, text = i % 4 == 0, draw.choices(words, k=draw.randint(20, 60))
        if toxic:
            for _ in range(3):
                text.insert(draw.randint(0, len(text)), draw.choice(["blarg", "Snorf", "zonk" + draw.choice(["ed", "ing", "ster", "ly"]), "bl4rg", "SNORF"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (901, "")]
    docs = documents(spark, rows)
    given = spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, given, F.col("doc_id") % 5 != 0)
    found = {r.doc_id: r for r in toxicity.score_texts(docs, model, {"doc_id": "bigint"}).collect()}
    held = [(found[i].predicted, y) for i, y in labels if i % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert found[900].predicted == found[901].predicted == 0 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())


def test_toxicity_samples_each_text_once(spark, monkeypatch):
    """One labelled text repeated more often than the sample is long, whose hash is the smallest."""
    sample, texts = 40, [f"text number {i} of many" for i in range(60)]
    hashed = documents(spark, enumerate(texts)).select("text", F.xxhash64(F.lit(3), F.col("text")).alias("h")).orderBy("h").collect()
    hot = hashed[0].text
    rows = [*enumerate(texts), *((100 + i, hot) for i in range(200)), (400, None), (401, "y" * 20_001)]
    labels = [(i, int(i % 3 == 0)) for i in range(60)] + [(100 + i, int(i == 7)) for i in range(200)] + [(401, 1)]
    given, seen = spark.createDataFrame(labels, "doc_id bigint, toxic int"), []
    monkeypatch.setattr(toxicity, "fit_sample", lambda rows, lexicons, persons: seen.extend(r[:2] for r in rows))
    toxicity.train(documents(spark, rows), given, F.lit(True), sample=sample)
    assert seen == [(r.text, int(r.text == hot or texts.index(r.text) % 3 == 0)) for r in hashed[:sample]]


@pytest.mark.parametrize("text, hits, total, changed, apart", [
    ("what an i.d.i.o.t here", 1, 3, 1, 1), ("i-d-i-o-t, moron", 2, 5, 1, 1), ("(i_d_i_o_t.)", 1, 3, 1, 1), ("i d i o t", 1, 3, 1, 1),
    ("idiot/moron/scum", 3, 6.5, 0, 0), ("idiot,MORON,sc0m,fine", 2, 5, 0, 0), ("you-idiot--scum/m0ron\u2014i.d.i.o.t", 4, 9.5, 2, 1), ("idiot moron scum", 3, 6.5, 0, 0), ("e.g. fine", 0, 0, 0, 0),
])
def test_toxicity_counts_every_word_of_a_token(text, hits, total, changed, apart):
    found = toxicity.Reader({"idiot": 3.0, "moron": 2.0, "scum": 1.5}, frozenset(["you"])).features(text)
    count = np.expm1(found[15])
    assert np.allclose([np.expm1(found[1]), found[3], found[9] * count, found[10] * count], [hits, total, changed, apart])
    assert found[4:7] == sorted(found[4:7], reverse=True) and sum(v > 0 for v in found[4:7]) == min(3, hits)
    assert found[8] == (hits if "you" in text else 0)


def test_toxicity_moves_no_text(spark, tmp_path, monkeypatch):
    """Labels that are too large to broadcast still meet ids only."""
    from tonegauge.llm import common

    rows = [(i, f"text {i} " + ("blarg" if i % 3 == 0 else "fine")) for i in range(60)]
    given = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    seen, settle = [], common.settle
    monkeypatch.setattr(common, "settle", lambda df, label: seen.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        common.labelled_sample(documents(spark, rows).coalesce(2), given, F.lit(True), "toxic", 50, 20, 100)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(seen) == 1 and "SortMergeJoin" not in seen[0] and "BroadcastHashJoin" in seen[0]


def test_toxicity_long_texts_and_words(spark):
    read = toxicity.Reader({"idiot": 3.0}, frozenset(["you"]), most=50, chars=2000, step=7)
    plain = toxicity.Reader({"idiot": 3.0}, frozenset(["you"]))
    draw = random.Random(1)
    text = " ".join(draw.choice(["you", "idiot", "i.d.i.o.t", "i d i o t", "x" * 300, f"w{i}"]) for i in range(3000))
    assert read.features(text) == plain.features(text)
    many = " ".join(f"w{i}" for i in range(3000))
    assert plain.features(many) == toxicity.Reader({}, frozenset(), step=50).features(many)
    letters = "ab" * 40
    once = spark.createDataFrame([("plain same", 0, i) for i in range(20)] + [(letters, 1, 30 + i) for i in range(20)], "_t string, _y int, _h bigint")
    found = toxicity.learn_lexicons(once, 5, 100, prefixes=())
    assert len(found) == 6 and all(letters in f for f in found) and not any(len(word) < len(letters) for f in found for word in f if word != "same")


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a b c")])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"), F.lit(True))
    assert toxicity.score_texts(docs, model, {"doc_id": "bigint"}).first().score == 0.5


def test_isotonic_is_monotone():
    draw = np.random.default_rng(2)
    x, y = boosting.isotonic(draw.normal(size=300), draw.integers(0, 2, 300))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and y.min() >= 0 and y.max() <= 1


# 6 repeated strings


def plain_dedup(rows, length=100):
    """rows: (id, text) -> (id, bytes, removed, spans, digest); a string is earlier by id, or by start in the same id."""
    last = 2**63 - 1
    first = {}
    data = [((last if i is None else i), i, (t or "").encode()) for i, t in rows]
    for at, _, b in data:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, (at, s)), (at, s))
    result = []
    for at, i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (at, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        result.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return result


@pytest.mark.parametrize("bound", [1, 2000])
def test_suffix_dedup(spark, corpus, bound):
    found = suffix.dedup(documents(spark, corpus), bound=bound).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found], key=key) == sorted(plain_dedup(corpus), key=key)


def test_suffix_intervals_equal_plain_grouping():
    draw = random.Random(1)
    base = "".join(draw.choices("ab ", k=400)).encode()
    pieces = [base[i : i + draw.randint(100, 168)] for i in (draw.randint(0, 230) for _ in range(50))] + [b"z" * 130, b"z" * 101]
    owner, start, group = suffix.equal_strings(pieces)
    found = {}
    for o, s, g in zip(owner.tolist(), start.tolist(), group.tolist()):
        found.setdefault(g, set()).add((o, s))
    want = {}
    for o, piece in enumerate(pieces):
        for s in range(len(piece) - 99):
            want.setdefault(piece[s : s + 100], set()).add((o, s))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_suffix_anchors_do_not_depend_on_the_stretch(monkeypatch):
    draw = random.Random(5)
    data = "".join(draw.choices("abcd", k=5000)).encode()
    runs = lambda: {(h, p + i) for _, h, p, n in zip(*suffix.anchors([data])) for i in range(n)}
    whole = runs()
    monkeypatch.setattr(suffix, "STRETCH", 700)
    assert runs() == whole and len(whole) == 4901
    assert suffix.dedup is not None


def test_suffix_empty(spark):
    assert suffix.dedup(documents(spark, [], 1)).count() == 0


# 7 archives


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x.org/{i}?a=é\r\nb", h, "clash") for i, h in rows], "page_id bigint, url string, html string, record_type string").repartition(3)


def test_warc_round_trip(spark):
    rows = [(i, f"<p>page {i} {'text ' * (i % 7)}</p>") for i in range(400)] + [(900, "same"), (901, "same"), (902, "same"), (903, None), (904, ""), (905, "é" * 70000), (905, "é" * 70000)]
    found = sorted(tuple(r) for r in warc.round_trip(spark, pages(spark, rows)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect() if r)
    data = [(i, (h or "").encode()) for i, h in rows]
    top = {}
    for i, b in data:
        top[b] = max(i, top.get(b, i))
    want = [(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if top[b] == i else "revisit", None if top[b] == i else top[b]) for i, b in data]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(found, key=key) == sorted(want, key=key)
    assert warc.round_trip(spark, pages(spark, [])).count() == 0


def test_warc_small_payloads_are_not_revisited(spark):
    rows = [(1, "tiny"), (2, "tiny"), (3, "long enough"), (4, "long enough")]
    kinds = {r.page_id: r.record_type for r in warc.round_trip(spark, pages(spark, rows), min_bytes=5).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def archive(records, path):
    with open(path, "wb") as stream:
        writer = warc.ArchiveWriter(stream)
        for data in records:
            writer.add(data)
        writer.close()
    return path


def test_warc_dictionary_leads_and_frames_hold_one_record(tmp_path):
    records = [warc.record(i, "http://x", f"<p>{i} some text of a page {i * i}</p>".encode() * 9, None) for i in range(300)]
    path = archive(records, tmp_path / "a.warc.zst")
    magic, length = struct.unpack("<II", path.read_bytes()[:8])
    assert magic == warc.DICTIONARY_MAGIC and length > 0
    with open(path, "rb") as stream:
        assert list(warc.frames(stream)) == records
    # a plain dictionary, as others write it
    learned = warc.trained_dictionary(records, 4096)
    packed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(learned)).compress(records[0])
    (tmp_path / "b").write_bytes(struct.pack("<II", warc.DICTIONARY_MAGIC, len(learned)) + learned + packed)
    with open(tmp_path / "b", "rb") as stream:
        assert list(warc.frames(stream)) == records[:1]


@pytest.mark.parametrize("spoil", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9", 1), lambda r: r[:-2], lambda r: r + r, lambda r: r.replace(b"body", b"Body"),
    lambda r: re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: x\r\n\r\nHTTP", r), lambda r: r.replace(b"WARC-Date", b"X-Date"), lambda r: r.replace(b"response\r\n", b"metadata\r\n", 1),
])
def test_warc_refuses_spoiled_records(spoil):
    good = warc.record(1, "http://x", b"<p>body</p>", None)
    assert warc.parse_record(good)["payload"] == b"<p>body</p>"
    with pytest.raises(warc.WarcError):
        warc.parse_record(spoil(good))


def test_warc_refuses_cut_archives(tmp_path):
    path = archive([warc.record(i, None, b"x" * 500, None) for i in range(3)], tmp_path / "a")
    path.write_bytes(path.read_bytes()[:-3])
    with open(path, "rb") as stream, pytest.raises(warc.WarcError):
        list(warc.frames(stream))


# 8 search


def plain_top(rows, k=5):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = sorted({(i, tuple(v)) for i, v in whole})
    result = []
    for q, a in whole:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))[:k]
            result += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(result)


@pytest.mark.parametrize("block", [16, 4096])
def test_top_k(spark, block):
    draw = np.random.default_rng(3)
    centers = draw.normal(size=(6, 8))
    rows = [(i, [float(x) for x in (centers[i % 6] + draw.normal(0, 0.1, 8)).astype(np.float32)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 520)]  # one vector many times
    rows += [(1000, None), (1050, [1.0] * 7 + [None]), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8), (1200, [2.0, 3.0]), (50, rows[50][1]), (1250, []), (1251, [])]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, score double").repartition(4)
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0, 5, data_block=block, query_block=block)
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_sends_queries_to_groups_that_can_hold_a_result(spark):
    """Many clusters, most of them outside the sample's first choice: few (query, group) pairs are left, none is lost."""
    draw = np.random.default_rng(8)
    centers = draw.normal(size=(30, 12)) * 4
    rows = [(i, [float(v) for v in centers[i % 30] + draw.normal(0, 0.05, 12)]) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    found = topk.top_k(frame, F.col("vec_id") % 50 == 0, 5, data_block=40, query_block=4, groups=32, sample=400)
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows)
    whole = [[int(np.floor(256 * x)) for x in v] for _, v in rows]
    tree = topk.upper_tree([(v, 1) for v in whole[:400]], 32)
    count = len(tree.centers[12])
    assert count > 20
    placed = topk.place_points(spark.createDataFrame([(v, [i]) for i, v in enumerate(whole)], "v array<bigint>, ids array<bigint>"), lambda: tree)
    radii = {(r.d, r.g): r.r for r in placed.groupBy("d", "g").agg(F.max("apart").alias("r")).collect()}
    probes = spark.createDataFrame([(v, i) for i, v in enumerate(whole) if i % 50 == 0], "v array<bigint>, qkey bigint")
    sent = topk.needed_groups(probes, lambda: tree, radii, 6).agg(F.sum(F.size("needs"))).first()[0]
    assert 30 <= sent < 0.2 * 30 * count


def test_top_k_refuses_products_beyond_64_bits():
    with pytest.raises(OverflowError):
        topk.DualSearch(np.array([[2**40]]), np.array([[2**30]]), [np.array([0])], 1)


def test_top_k_prunes_and_covers():
    draw = np.random.default_rng(5)
    centers = draw.integers(-400, 400, (40, 6))
    x = np.repeat(centers, 50, axis=0) + draw.integers(-3, 4, (2000, 6))
    tree = topk.cover_tree(x.astype(float))

    def check(node):
        points = np.concatenate(list(node.all_points()))
        assert np.sqrt(((x[points] - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-6
        for child in node.children:
            check(child)

    check(tree)
    assert sorted(np.concatenate(list(tree.all_points())).tolist()) == list(range(2000))
    find = topk.DualSearch(x[::20], x, [np.array([i]) for i in range(len(x))], 6)
    find.run()
    assert find.compared < 0.7 * 100 * 2000
    wide = topk.DualSearch(np.array([[2**40, 1]]), np.array([[2**22, 1], [2**22, 3]]), [np.array([0]), np.array([1])], 2)
    wide.run()
    assert wide.best[0] == [(-(2**62) - 3, 1), (-(2**62) - 1, 0)]


# 9 benchmark


def split_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def plain_hits(docs, items, size=13):
    result = []
    for i, text in docs:
        own, hit, names = split_words(text), set(), set()
        for name, other in items:
            other = split_words(other)
            width = min(size, len(other))
            if not width:
                continue
            wanted = {tuple(other[s : s + width]) for s in range(len(other) - width + 1)}
            for s in range(len(own) - width + 1):
                if tuple(own[s : s + width]) in wanted:
                    hit |= set(range(s, s + width))
                    names.add(str(name))
        result.append((i, len(own), len(hit), ",".join(sorted(names))))
    return result


@pytest.mark.parametrize("rows, filter_words", [(0, winnow.FILTER_WORDS), (500_000, winnow.FILTER_WORDS), (500_000, 1)])
def test_winnowing(spark, corpus, words, rows, filter_words):
    draw = random.Random(21)
    items = [(i, " ".join(draw.choices(words, k=draw.choice([3, 1, 12, 13, 14, 30])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, items[0][1]), (0, items[0][1]), (103, "w " * 20)]
    docs = list(corpus)
    for i in range(25):
        own = items[i][1].split()
        docs.append((2000 + i, " ".join(draw.choices(words, k=30)) + ". " + "-".join(own).upper() + " " + " ".join(draw.choices(words, k=30))))
        docs.append((3000 + i, " ".join(own[1:14]) + " " + " ".join(own[:12])))
    docs.append((4000, "w " * 50))
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, n_hit int")
    found = winnow.find_items(documents(spark, docs), bench, broadcast_rows=rows, filter_words=filter_words).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)) for r in found], key=key) == sorted(plain_hits(docs, items), key=key)


def test_filter_lets_every_hit_through(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("row"))
    hit = rows.where("row % 40 = 0")
    for filter_words, most in ((winnow.FILTER_WORDS, 5), (64, 4000)):
        marked = winnow.with_mark(rows, hit, filter_words)
        assert marked.count() == 20_000 and marked.where("row % 40 = 0 AND NOT _maybe").count() == 0
        assert marked.where("row % 40 <> 0 AND _maybe").count() <= most
    assert winnow.with_mark(rows, hit.limit(0)).where("_maybe").count() == 0


def test_winnowing_without_items(spark, corpus):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    found = winnow.find_items(documents(spark, corpus), bench)
    assert found.count() == len(corpus) and found.where("n_hit > 0").count() == 0
    assert winnow.find_items(documents(spark, [], 1), bench).count() == 0


# 10 licences


def plain_places(text):
    own, places = [w.decode() for w in split_words(text)], []
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        places += [(s, label) for s in range(len(own) - len(p) + 1) if own[s : s + len(p)] == p]
    return len(own), sorted(places)


def test_licences(spark, corpus):
    rows = list(corpus) + [
        (500, "Licensed under the Apache License, Version 2.0."), (501, "the MIT License and the mit license, MIT-LICENSE"), (502, "Licensed under CC BY-NC 4.0."),
        (503, "x " * 500 + "This work is licensed under the GNU General Public License, version 3. end"), (504, "gnu general public"),
        (505, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        (506, "apache license"), (507, "Redistribution in source and use of binary forms"), (508, "cc by cc by"), (508, "cc by cc by"),
    ]
    found = licences.scan(documents(spark, rows), ["doc_id"]).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for i, text in rows:
        if i in by and i not in (5, 6):
            count, places = plain_places(text)
            r = by[i]
            assert (r.n_words, r.n_base, r.first_word, r.last_word) == (count, len(places), places[0][0] if places else None, places[-1][0] if places else None)
            assert r.base_labels == sorted({label for _, label in places}) and 0 <= r.score <= 1
    assert [by[i].found_labels for i in (500, 502, 503, 505, 506, 507)] == [["apache-2.0"], ["cc-by-nc"], ["gpl-3.0"], ["bsd"], [], []]
    assert licences.scan(documents(spark, [], 1), ["doc_id"]).count() == 0


def test_licences_side_by_side_in_one_text(spark):
    """Common words of some licences must not lose against the rare words of another one in the same file."""
    by = {t.label: t.text for t in licences.TEMPLATES}
    wanted = ["bsd", "isc", "mit-text", "mpl-2.0"]
    filler = " ".join(f"w{i}" for i in range(400))
    rows = [(1, f" {filler} ".join(by[label] for label in wanted))]
    rows += [(10 + i, " ".join(reversed(" ".join(by[label] for label in by if label != "bsd").split()))) for i in range(6)]
    found = {r.doc_id: r for r in licences.scan(documents(spark, rows), ["doc_id"]).collect()}
    assert found[1].found_labels == wanted and found[1].score == 1
    assert found[10].found_labels == []


def test_licences_of_texts_that_begin_inside_a_template(spark):
    rows = [
        (1, "Apache License Version 2.0, January 2004"), (2, "Licensed under a Creative Commons Attribution 4.0 International License"), (3, "see also our Apache License Version 2.0, January 2004"),
        (4, "license version 2.0"), (5, "MIT License"), (6, "gnu general public license as published by the free software foundation"), (7, "the MIT License"),
    ]
    found = {r.doc_id: r for r in licences.scan(documents(spark, rows), ["doc_id"]).collect()}
    assert [found[i].found_labels for i in range(1, 8)] == [["apache-2.0"], ["cc-by-4.0"], ["apache-2.0"], [], [], [], ["mit-notice"]]
    assert [found[i].score for i in (1, 2, 3, 7)] == [5 / 8, 10 / 13, 5 / 8, 3 / 5]


def plain_labels(text):
    own, found = [w.decode() for w in split_words(text)], {}
    for template in licences.TEMPLATES:
        body = template.text.split()
        placed = [(licences.place_of(p.split(), body), p.split()) for p in template.mandatory]
        for start in range(-len(body), len(own)):
            if all(start + at >= 0 and own[start + at : start + at + len(p)] == p for at, p in placed):
                share = sum(0 <= start + j < len(own) and own[start + j] == word for j, word in enumerate(body)) / len(body)
                if share >= 0.6:
                    found[template.label] = max(share, found.get(template.label, 0))
    return sorted(found), max([*found.values(), 0.5 if plain_places(text)[1] else 0.0])


def test_licences_lose_no_alignment(spark):
    """Pieces of templates, changed words and licence words in any order, against every start of every template."""
    draw = random.Random(12)
    bodies = [t.text.split() for t in licences.TEMPLATES]
    pool = sorted({word for body in bodies for word in body} | {"alpha", "beta", "Gamma", "ß"})
    rows = []
    for i in range(160):
        parts = []
        for _ in range(draw.randint(1, 5)):
            body = list(draw.choice(bodies))
            for _ in range(draw.randint(0, 3)):
                body[draw.randrange(len(body))] = draw.choice(pool)
            cut = draw.choice([0, 0, draw.randint(0, 6)])
            parts += draw.choices(pool, k=draw.randint(0, 12)) + body[cut : len(body) - draw.choice([0, 0, draw.randint(0, 6)])]
        rows.append((i, " ".join(parts)))
    rows += [(900 + i, t.text) for i, t in enumerate(licences.TEMPLATES)] + [(990, ""), (991, None), (992, "license " * 3000)]
    found = {r.doc_id: (r.found_labels, r.score) for r in licences.scan(documents(spark, rows), ["doc_id"]).collect()}
    assert found == {i: plain_labels(text) for i, text in rows}
    assert all(t.label in found[900 + i][0] for i, t in enumerate(licences.TEMPLATES))


def test_licence_sql_agrees(spark, tmp_path):
    import duckdb

    rows = [(1, "x Licensed under the Apache License, Version 2.0."), (2, None), (3, ""), (4, "cc by cc by nc 4 0"), (4, "cc by cc by nc 4 0"), (5, "License version 2.0 " * 40)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op10_licence_scan"]
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = base.execute(queries.ORACLES["op10_licence_scan"])
    names = [c[0] for c in wanted.description]
    expected = sorted(map(str, wanted.fetchall()))
    mine = found(spark, str(tmp_path)).select(*names).collect()
    assert sorted(str(tuple(r)) for r in mine) == expected


def test_native_plans_have_no_python(spark, corpus):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    for frame in (winnow.find_items(documents(spark, corpus), bench), licences.scan(documents(spark, corpus), ["doc_id"])):
        assert not re.search("Python|Pandas|InArrow", frame._jdf.queryExecution().executedPlan().toString())
