"""The index kept up to date against the index of all rows at once; user aggregates against plain grouping."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonegauge.operators.aggregates import aggregate_by
from tonegauge.operators.incremental import update_index
from tonegauge.plans.jobs import fill_calendar
from tonegauge.operators.indices import daily_indices

ROWS = "country string, date date, score double, tone double, impact string"
OPTIONS = {"means": ["score", "tone"], "impacts": ["impact"]}
COLUMNS = ["country", "date", "score", "tone", "impact_diffusion_index", "speech_count"]


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def plain(df):
    return sorted(((*[round(v, 9) if isinstance(v, float) else v for v in r],) for r in df.select(*COLUMNS).collect()), key=str)


def whole(spark, rows):
    return fill_calendar(daily_indices(spark.createDataFrame(rows, ROWS), **OPTIONS))


@pytest.mark.parametrize("seed", [1, 2])
def test_deliveries_in_any_order(spark, tmp_path, seed):
    draw, folder, rows = random.Random(seed), str(tmp_path / "kept"), []
    for number in range(4):
        some = [(draw.choice(["de", "fr", None]), draw.choice([None, *map(day, (draw.randint(0, 200) for _ in range(6)))]), draw.choice([None, 1.0, 2.5]), draw.choice([None, None, 3.0]), draw.choice(["rise", "fall", "neutral", None])) for _ in range(12)]
        if number == 2:
            some = [(c, d and day(draw.randint(90, 95)), s, t, i) for c, d, s, t, i in some]
        rows += some
        frame = spark.createDataFrame(some, ROWS)
        update_index(frame, folder, f"delivery {number}", **OPTIONS)
        if number == 1:  # once more, as after a failure
            update_index(frame, folder, f"delivery {number}", **OPTIONS)
        assert plain(spark.read.parquet(f"{folder}/index")) == plain(whole(spark, rows))


def test_untouched_months_keep_their_files(spark, tmp_path):
    folder = str(tmp_path / "kept")
    rows = [("de", day(n), float(n), 1.0, "rise") for n in range(0, 200, 3)]
    update_index(spark.createDataFrame(rows, ROWS), folder, "first", **OPTIONS)
    files = {p for p in Path(folder).rglob("*.parquet")}
    update_index(spark.createDataFrame([("de", day(100), 7.0, 2.0, "fall")], ROWS), folder, "second", **OPTIONS)
    after = {p for p in Path(folder).rglob("*.parquet")}
    assert {p.parent.name for p in files - after} == {"month=2024-04"}
    update_index(spark.createDataFrame([], ROWS), folder, "third", **OPTIONS)
    assert {p for p in Path(folder).rglob("*.parquet")} == after
    rows.append(("de", day(100), 7.0, 2.0, "fall"))
    assert plain(spark.read.parquet(f"{folder}/index")) == plain(whole(spark, rows))


class Span:
    """Largest minus smallest value, and rows."""

    def start(self):
        return [None, None, 0]

    def update(self, state, columns):
        values = columns["v"].dropna()
        lows = [x for x in (state[0], None if values.empty else values.min()) if x is not None]
        highs = [x for x in (state[1], None if values.empty else values.max()) if x is not None]
        return [min(lows, default=None), max(highs, default=None), state[2] + len(columns["v"])]

    def merge(self, one, other):
        lows, highs = ([s[i] for s in (one, other) if s[i] is not None] for i in (0, 1))
        return [min(lows, default=None), max(highs, default=None), one[2] + other[2]]

    def finish(self, state):
        return {"span": None if state[0] is None else float(state[1] - state[0]), "rows": state[2]}


@pytest.mark.parametrize("groups", [50_000, 3])
def test_user_aggregate(spark, groups):
    draw = random.Random(3)
    rows = [(draw.choice(["a"] * 9 + ["b", None, "c"]), draw.choice([1, 2, None]), draw.choice([None, float(draw.randint(0, 99))])) for _ in range(3000)] + [("z", 9, None)]
    frame = spark.createDataFrame(rows, "k string, n int, v double").repartition(6)
    found = aggregate_by(frame, ["k", "n"], ["v"], Span(), "struct<span: double, rows: bigint>", groups=groups)
    table = pd.DataFrame(rows, columns=["k", "n", "v"])
    want = {}
    for (k, n), part in table.groupby(["k", "n"], dropna=False):
        v = part["v"].dropna()
        want[(k if isinstance(k, str) else None, int(n) if n == n else None)] = (None if v.empty else float(v.max() - v.min()), len(part))
    assert {(r.k, r.n): tuple(r.value) for r in found.collect()} == want
    assert aggregate_by(frame.limit(0), ["k"], ["v"], Span(), "struct<span: double, rows: bigint>").collect() == []


def test_user_aggregate_shuffles_states(spark):
    frame = spark.createDataFrame([("a", 1.0)] * 5000, "k string, v double").repartition(4)
    plan = aggregate_by(frame, ["k"], ["v"], Span(), "struct<span: double, rows: bigint>")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(k"):]
    assert below.index("MapInArrow") > 0 and "_state" in below.split("\n")[0] + below.split("\n")[1]


class Updates:
    """Times a state took in rows, and the rows."""

    def start(self):
        return [0, 0]

    def update(self, state, columns):
        return [state[0] + 1, state[1] + len(columns["v"])]

    def merge(self, one, other):
        return [one[0] + other[0], one[1] + other[1]]

    def finish(self, state):
        return {"updates": state[0], "rows": state[1]}


def test_user_aggregate_takes_many_rows_at_a_time(spark):
    """Groups that are spread over all batches are updated once in a task, not once in a batch."""
    frame = spark.range(0, 6000, 1, 3).select((F.col("id") % 50).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") * 1.0).alias("v"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "100")
    try:
        found = aggregate_by(frame, ["k"], ["v"], Updates(), "struct<updates: bigint, rows: bigint>").collect()
    finally:
        spark.conf.unset(name)
    assert sorted((r.k, *r.value) for r in found) == [(k, 3, 120) for k in range(50)]
