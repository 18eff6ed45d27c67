"""Bucketed tables, sketches, and job state kept by a stream."""

from __future__ import annotations

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from tonegauge.operators import sketches
from tonegauge.sources.bucketed import latest_of, open_bucketed, write_bucketed
from tonegauge.streaming.ledger import collect_ledger, current_states


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    left = spark.createDataFrame([(i % 50, i, f"v{i}") for i in range(200)] + [(None, 1, "n")], "k int, n int, v string").repartition(3)
    right = spark.createDataFrame([(i, i * i) for i in range(0, 80, 2)], "k int, w int")
    a, b = write_bucketed(left, str(tmp_path / "a"), "k", 4), write_bucketed(right, str(tmp_path / "b"), "k", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined, last = a.join(b, "k"), latest_of(a, "k", "n", ["n", "v"], count="rows")
        assert "Exchange" not in plan(joined) and "Exchange" not in plan(last)
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
        again = open_bucketed(spark, str(tmp_path / "a"), left.schema, "k", 4)
        assert "Exchange" not in plan(again.join(b, "k")) and again.count() == 201
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.k: (r.n, r.v, r.rows) for r in last.collect() if r.k is not None} == {k: (150 + k, f"v{150 + k}", 4) for k in range(50)}


def test_sketches_of_any_range(spark, tmp_path):
    draw = random.Random(2)
    rows = [(dt.date(2024, 1, 1 + draw.randint(0, 27)), draw.randint(0, 3000), draw.choice([None, draw.gauss(0, 9)])) for _ in range(20_000)] + [(None, 1, 1.0)]
    frame = spark.createDataFrame(rows, "date date, who int, score double")
    sketches.daily_sketches(frame, [], ["who"], ["score"]).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    assert kept.count() == 28
    for first, last in ((1, 28), (3, 9)):
        days = (dt.date(2024, 1, first), dt.date(2024, 1, last))
        found = sketches.estimates(sketches.merged_sketches(kept.where(F.col("date").between(*days)), [F.lit(1).alias("g")]), ["g"], [0.5]).first()
        mine = [r for r in rows if r[0] and days[0] <= r[0] <= days[1]]
        scores = sorted(r[2] for r in mine if r[2] is not None)
        assert found["rows"] == len(mine)
        assert abs(found["who_distinct"] / len({r[1] for r in mine}) - 1) < 4 * sketches.distinct_error()
        assert abs(sum(s <= found["score_q0"] for s in scores) / len(scores) - 0.5) < 2 * sketches.rank_error() + 0.001
    none = sketches.daily_sketches(frame.where("date = '2024-01-01'").withColumn("score", F.lit(None).cast("double")), [], [], ["score"])
    assert sketches.estimates(sketches.merged_sketches(none, ["date"]), ["date"]).first()["score_q0"] is None


def test_ledger_state_in_any_order(spark, tmp_path):
    draw = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    events = [(f"chunk{draw.randint(1, 6)}", f"b{draw.randint(1, 9)}", draw.choice(["completed", "in_progress", "failed"]), start + dt.timedelta(hours=draw.randint(0, 30)), i) for i in range(80)]
    events += [("_meta", "b1", "completed", start, 900), ("chunk1", "b1", "failed", None, 901)]
    inbox, table, checkpoint = (str(tmp_path / n) for n in ("inbox", "table", "checkpoint"))
    order = events[:]
    draw.shuffle(order)
    for part in range(3):
        spark.createDataFrame(order[part::3], "chunk_name string, batch_id string, status string, updated_at timestamp, event_id bigint").coalesce(1).write.mode("append").parquet(inbox)
        collect_ledger(spark, inbox, table, checkpoint, patience_ms=1)
        time.sleep(0.05)
    want = {}
    for chunk, batch, status, at, number in sorted((e for e in events if e[0] != "_meta" and e[3]), key=lambda e: (e[3], e[4])):
        others = [e for e in events if e[0] == chunk and e[1] != batch and e[3]]
        want[chunk] = (status, batch, max(others, key=lambda e: (e[3], e[4]))[1] if others else None)
    found = {r.chunk_name: r for r in current_states(spark, table).collect()}
    assert {c: (r.status, r.batch_id, r.previous_batch_id) for c, r in found.items()} == want
    # the next delivery's batch finds those whose clock has run out
    spark.createDataFrame([("chunk99", "b1", "completed", start, 999)], "chunk_name string, batch_id string, status string, updated_at timestamp, event_id bigint").write.mode("append").parquet(inbox)
    collect_ledger(spark, inbox, table, checkpoint, patience_ms=1)
    stuck = {r.chunk_name for r in current_states(spark, table).collect() if r.stuck}
    assert stuck == {c for c, (status, *_) in want.items() if status == "in_progress"}
