"""Quality scores: what is learned, that whole texts are read, and the gradients."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegauge.llm import quality

DOCS, LABELS = "doc_id bigint, text string, score double, label string", "doc_id bigint, quality int, text string"


def prose(draw, n):
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(n))


def junk(draw, n):
    return " ".join(w.upper() + "!!" for w in prose(draw, n // 3).split()) + " " + "same " * n


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(2)
    rows = [(i, junk(draw, 150) if i % 4 == 0 else prose(draw, draw.randint(5, 300))) for i in range(240)]
    docs = spark.createDataFrame([(*r, 0.1, "clash") for r in rows], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), "clash") for i, _ in rows], LABELS)
    return rows, docs, labels


def test_held_out_documents(spark, table):
    rows, docs, labels = table
    model = quality.train(docs, labels, F.col("doc_id") % 5 != 0, epochs=40)
    found = {r.doc_id: r for r in quality.score_texts(docs, model, {"doc_id": "bigint"}).collect()}
    held = [i for i, _ in rows if i % 5 == 0]
    assert np.mean([found[i].predicted == (i % 4 != 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())


def test_awkward_rows(spark, table):
    rows, docs, labels = table
    model = quality.train(docs, labels, F.col("doc_id") % 5 != 0, epochs=5)
    odd = [(1, None), (1, ""), (2, " \n"), (None, "ab"), (None, "ab"), (3, "x" * 3_000_000), (4, "a " * 1_500_000), (5, " " * 1_200_000)]
    found = quality.score_texts(spark.createDataFrame([(*r, 0.1, "c") for r in odd], DOCS).coalesce(1), model, {"doc_id": "bigint"}).collect()
    assert len(found) == len(odd) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2, 5)}) == 1 and len({r.score for r in found if r.doc_id is None}) == 1
    assert quality.score_texts(spark.createDataFrame([], DOCS), model, {"doc_id": "bigint"}).count() == 0


def test_nothing_to_learn(spark, table):
    _, docs, labels = table
    none = quality.train(docs, labels.where("quality > 9"), F.lit(True))
    one = quality.train(docs, labels.where("quality = 1"), F.lit(True))
    assert none.flat == 0.5 and one.flat > 0.99
    assert quality.score_bags(none, quality.Passages(), ["a", None]).tolist() == [0.5, 0.5]
    assert quality.train(docs.limit(0), labels.limit(0), F.lit(True)).flat == 0.5


def test_sample_counts_copies_once(spark, table):
    copies = spark.createDataFrame([(i, "one text", 0.1, "c") for i in range(500)] + [(1000, "other", 0.1, "c"), (1000, "other", 0.1, "c"), (1001, "long " * 9000, 0.1, "c")], DOCS)
    labels = spark.createDataFrame([(i, int(i == 7), "c") for i in range(500)] + [(1000, None, "c"), (1000, 0, "c"), (1001, 1, "c"), (None, 1, "c"), (5000, 1, "c")], LABELS)
    kept, chosen = quality.labelled_sample(copies, labels, F.lit(True), "quality", 10_000, 3, 20_000)
    assert sorted(c[:2] for c in chosen) == [("one text", 1), ("other", 0)] and kept.count() == 2


def test_pieces_cut_at_passages(monkeypatch):
    text = prose(random.Random(1), 3000) + " tail " + "y" * 400 + " end"
    whole = text.split()
    monkeypatch.setattr(quality, "PIECE", 1000)
    parts = list(quality.pieces(text))
    assert sum(parts, []) == whole and len(parts) > 5 and all(len(p) % quality.PASSAGE == 0 for p in parts[:-1])


def test_scores_do_not_depend_on_pieces(monkeypatch):
    draw = random.Random(3)
    texts = [prose(draw, 4000), junk(draw, 900), "", prose(draw, 20)]
    rows, bag = quality.Passages().rows([t.split() for t in texts])
    model = quality.fit(rows, bag, np.array([1.0, 0, 0, 1]), epochs=20)
    whole = quality.score_bags(model, quality.Passages(), texts)
    monkeypatch.setattr(quality, "PIECE", 700)
    monkeypatch.setattr(quality, "TOKENS", 200)
    small = quality.score_bags(model, quality.Passages(entries=50, chars=100), texts)
    assert np.allclose(whole, small, atol=1e-9)


def test_gradients_by_difference():
    draw = np.random.default_rng(0)
    theta = [draw.normal(0, 0.5, s) for s in [(4, 3), (4, 2), (4, 2), (2,), (4,)]]
    x, bag, starts, label = draw.normal(size=(7, 4)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([0, 3, 5]), np.array([1.0, 0, 1])

    def loss(parts):
        encode, tan, gate, weigh, judge = parts
        h = np.c_[np.tanh(x @ encode), np.ones(7)]
        a = np.exp((np.tanh(h @ tan) * quality._sigmoid(h @ gate)) @ weigh)
        p = quality._sigmoid(np.array([(a[bag == b] / a[bag == b].sum()) @ h[bag == b] @ judge for b in range(3)]))
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for i, grad in enumerate(quality._gradients(theta, x, bag, starts, label)):
        for place in np.ndindex(theta[i].shape):
            moved = [t.copy() for t in theta]
            moved[i][place] += 1e-6
            assert abs((loss(moved) - loss(theta)) / 1e-6 - grad[place]) < 1e-4
