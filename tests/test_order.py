"""Positions, packing and quantiles: the operators that depend on an order over the whole table."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonegauge.operators import packing as P
from tonegauge.operators.positions import add_positions, sequential_ids
from tonegauge.operators.quantiles import exact_quantiles


def fold(tokens, limit):
    """The plain sequential rule."""
    chunks, used, chunk = [], 0, 0
    for t in tokens:
        if chunk == 0 or used + t > limit:
            chunk, used = chunk + 1, t
        else:
            used += t
        chunks.append(chunk)
    return chunks


def after(steps, carry, before):
    out, opened = steps.at(carry)
    return out, before + opened


def chained(slices, limit):
    """Chunks in all, by summaries only."""
    carry, before = limit + 1, 0
    parts = [P._summarise(np.array(s, dtype=np.int64), limit) for s in slices if s]
    for steps in parts:
        carry, before = after(steps, carry, before)
    folded = None
    for steps in parts:
        folded = steps if folded is None else P._compose(folded, steps)
    assert folded is None or after(folded, limit + 1, 0) == (carry, before)
    return before


tokens_lists = st.lists(st.lists(st.integers(0, 12), max_size=12), min_size=1, max_size=6)


@settings(max_examples=400, deadline=None)
@given(tokens_lists, st.integers(1, 20))
def test_summaries_chain_like_the_fold(slices, limit):
    rows = [t for s in slices for t in s]
    assert chained(slices, limit) == (fold(rows, limit)[-1] if rows else 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=15), st.lists(st.integers(0, 12), min_size=1, max_size=15), st.integers(1, 20), st.integers(0, 30))
def test_composition_equals_two_entries(a, b, limit, carry):
    first, second = (P._summarise(np.array(x, dtype=np.int64), limit) for x in (a, b))
    assert after(P._compose(first, second), carry, 0) == after(second, *after(first, carry, 0))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=6), min_size=3, max_size=3), st.integers(1, 20), st.integers(0, 30))
def test_composition_is_associative(parts, limit, carry):
    a, b, c = (P._summarise(np.array(x, dtype=np.int64), limit) for x in parts)
    assert after(P._compose(P._compose(a, b), c), carry, 0) == after(P._compose(a, P._compose(b, c)), carry, 0)


@pytest.mark.parametrize("tokens, limit, expected", [
    ([50, 40, 30, 90, 5], 75, [1, 2, 2, 3, 4]),
    ([100], 75, [1]),
    ([100, 0, 0, 100], 75, [1, 2, 2, 3]),
    ([0, 100], 75, [1, 2]),
])
def test_packing_edges(spark, tokens, limit, expected):
    df = spark.createDataFrame(list(enumerate(tokens)), "i int, tokens int")
    got = P.greedy_chunks(df, ["i"], max_tokens=limit, slices=3).orderBy("i").collect()
    assert [r["chunk_id"] for r in got] == expected == fold(tokens, limit)


@pytest.mark.parametrize("seed, rows, slices, limit", [(1, 3000, 16, 1000), (2, 500, 7, 40), (3, 40, 9, 5000), (4, 2000, 5, 1)])
def test_packing_equals_the_fold(spark, seed, rows, slices, limit):
    draw = random.Random(seed)
    tokens = [draw.choice([0, 0, draw.randint(1, 60), draw.randint(1, 200), 1500]) for _ in range(rows)]
    shuffled = list(enumerate(tokens))
    draw.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "i int, tokens int").repartition(5)
    packed = P.greedy_chunks(df, ["i"], max_tokens=limit, slices=slices)
    got = [r["chunk_id"] for r in packed.orderBy("i").collect()]
    assert got == fold(tokens, limit)
    stats = P.chunk_statistics(packed)
    assert stats.where((F.col("chunk_tokens") > limit) & (F.col("num_requests") > 1)).count() == 0
    total = P.chunk_totals(stats).first()
    assert (total["num_chunks"], total["num_requests"], total["total_tokens"]) == (max(got), rows, sum(tokens))


def test_a_thousand_slices_fold_on_many_levels(spark, monkeypatch):
    draw, limit = random.Random(8), 500
    slices = [[draw.randint(0, 90) for _ in range(draw.randint(1, 40))] for _ in range(1000)]
    summaries = [P._summarise(np.array(s), limit) for s in slices]
    want, carry, before = {}, limit + 1, 0
    for number, steps in enumerate(summaries):
        want[number] = (carry, before)
        carry, before = after(steps, carry, before)
    monkeypatch.setattr(P, "FOLDED_STEPS", 8 * max(len(s.low) for s in summaries))
    frame = spark.createDataFrame(pd.concat([P._columns(n, s) for n, s in enumerate(summaries)]), P._SUMMARY)
    found = P._entries(frame, 1000, limit + 1).collect()
    assert {r[P.SLICE]: (r["_carry"], r["_before"]) for r in found} == want


def test_packing_of_equal_rows_never_merges_phases(spark):
    df = spark.range(1000).select("id", F.lit(7).alias("tokens"))
    got = [r["chunk_id"] for r in P.greedy_chunks(df, ["id"], max_tokens=100, slices=11).orderBy("id").collect()]
    assert got == fold([7] * 1000, 100)


def test_packing_nothing(spark):
    empty = spark.createDataFrame([], "i int, tokens int")
    packed = P.greedy_chunks(empty, ["i"])
    assert packed.count() == 0 and packed.columns == ["i", "tokens", "chunk_id"]
    assert P.chunk_totals(P.chunk_statistics(packed)).first()["num_requests"] == 0


def test_positions_follow_the_order_with_a_hot_value(spark):
    rows = [("2022-01-01" if i % 3 else f"2022-02-{i % 28 + 1:02d}", i, f"text {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "day string, id int, body string").repartition(6)
    expected = {row[1]: place for place, row in enumerate(sorted(rows))}
    for key in (None, ["id"]):
        placed = add_positions(df, ["day", "id"], key, slices=7)
        assert {r["id"]: r["row_index"] for r in placed.collect()} == expected
        assert "body" in placed.columns


def test_sequential_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    assert {r["name"]: r["speech_id"] for r in sequential_ids(df, ["name"]).collect()} == {"a": "speech_0", "b": "speech_1", "c": "speech_2"}


@pytest.mark.parametrize("spread", [5, 10**9])
def test_quantiles_are_exact(spark, spread):
    rows = spark.range(60000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, "small").otherwise(F.lit(None)).alias("g"),
        F.when(F.col("id") % 11 != 0, (F.abs(F.xxhash64("id")) % spread).cast("double")).alias("v"),
    )
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[f"q_{i}"] for i in range(5)] for r in exact_quantiles(rows, ["g"], "v", points).collect()}
    want = {r["g"]: r["q"] for r in rows.groupBy("g").agg(F.percentile("v", points).alias("q")).collect()}
    assert got.keys() == want.keys()
    for group, values in want.items():
        assert got[group] == pytest.approx(values, abs=1e-6)


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 5.0), ("c", None), ("d", float("nan"))], "g string, v double")
    got = {r["g"]: (r["q_0"], r["q_1"]) for r in exact_quantiles(df, ["g"], "v", [0.5, 0.75]).collect()}
    assert got == {"a": (2.0, 6.0), "b": (5.0, 5.0)}


def test_quantiles_of_one_group_with_most_values(spark):
    rows = spark.range(1_000_000, numPartitions=8).select(F.when(F.col("id") % 10 == 0, "other").otherwise("hot").alias("g"), (F.col("id") * 7919 % 1_000_003).cast("double").alias("v"))
    got = {r["g"]: r["q_0"] for r in exact_quantiles(rows, ["g"], "v", [0.5]).collect()}
    want = {r["g"]: r["q"] for r in rows.groupBy("g").agg(F.percentile("v", 0.5).alias("q")).collect()}
    assert got == pytest.approx(want)
