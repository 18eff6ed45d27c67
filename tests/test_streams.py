"""Streams: one parse for two outputs, replayed batches, windows under a watermark, late rows."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from tonegauge.operators.indices import daily_indices
from tonegauge.sources.tables import upsert
from tonegauge.streaming.ingest import collect_responses
from tonegauge.streaming.windows import collect_daily_index

GOOD = '{"custom_id": "a%d", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "{\\"summary\\": \\"s\\"}"}}]}}}'
ROWS = "country string, date date, score double, impact string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def forget_last_commit(checkpoint):
    """As after a failure between a batch's writes and its commit."""
    commits = [p for p in (Path(checkpoint) / "commits").iterdir() if p.name.isdigit()]
    last = max(commits, key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)


def test_one_parse_and_replay(spark, tmp_path):
    inbox, table, checkpoint = (str(tmp_path / n) for n in ("inbox", "table", "checkpoint"))
    lines = [GOOD % i if i % 3 else f"broken {i}" for i in range(30)]
    spark.createDataFrame([(x,) for x in lines], "raw string").repartition(3).write.text(inbox)
    read = collect_responses(spark, inbox, table, checkpoint, max_files=2)
    assert read == 30  # each line once, for both tables
    assert collect_responses(spark, inbox, table, checkpoint) == 0
    for _ in range(2):
        assert sorted(r.speech_id for r in spark.read.parquet(table).collect()) == sorted(f"a{i}" for i in range(30) if i % 3)
        aside = spark.read.parquet(f"{table}_set_aside").collect()
        assert sorted(r.raw for r in aside) == sorted(f"broken {i}" for i in range(0, 30, 3)) and len({r.batch for r in aside}) == 2
        forget_last_commit(checkpoint)
        assert collect_responses(spark, inbox, table, checkpoint) > 0


def test_daily_windows(spark, tmp_path):
    inbox, folder = str(tmp_path / "inbox"), str(tmp_path / "out")
    deliveries = [
        [("de", day(40), 1.0, "rise"), ("de", day(40), 3.0, "fall"), (None, day(41), 5.0, None)],
        # ten days behind the latest day is in time, eleven is late
        [("de", day(31), 7.0, "neutral"), ("de", day(30), 9.0, "rise"), ("fr", None, 1.0, "rise"), ("de", day(40), 8.0, "rise"), (None, day(80), 2.0, "fall")],
        [("fr", day(75), None, "rise"), ("de", day(41), 1.0, "fall")],
    ]
    for rows in deliveries:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(inbox)
        collect_daily_index(spark, inbox, ROWS, folder, 10, means=["score"], impacts=["impact"])
    late = [("de", day(30), 9.0, "rise"), ("fr", None, 1.0, "rise"), ("de", day(41), 1.0, "fall")]
    kept = [r for rows in deliveries for r in rows if r not in late]
    want = daily_indices(spark.createDataFrame(kept, ROWS), means=["score"], impacts=["impact"])
    columns = ["country", "date", "score", "impact_diffusion_index", "speech_count"]
    plain = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    for _ in range(2):
        assert plain(spark.read.parquet(f"{folder}/index")) == plain(want)
        assert sorted(((r.country, r.date, r.score, r.impact) for r in spark.read.parquet(f"{folder}/late").collect()), key=str) == sorted(late, key=str)
        for stream in ("arrivals", "windows"):  # both last batches once more
            forget_last_commit(f"{folder}/checkpoint/{stream}")
        collect_daily_index(spark, inbox, ROWS, folder, 10, means=["score"], impacts=["impact"])


def test_upsert_leaves_other_months_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda rows: spark.createDataFrame(rows, "k string, date date, v int")
    upsert(frame([("a", day(0), 1), (None, day(0), 2), ("a", day(40), 3)]), path, ["k", "date"])
    files = {p.name for p in Path(path).glob("month=2024-02/*.parquet")}
    upsert(frame([(None, day(0), 20), ("b", day(1), 4)]), path, ["k", "date"])
    upsert(frame([]), path, ["k", "date"])
    assert {p.name for p in Path(path).glob("month=2024-02/*.parquet")} == files
    got = sorted(((r.k, r.date, r.v) for r in spark.read.parquet(path).collect()), key=str)
    assert got == sorted([("a", day(0), 1), (None, day(0), 20), ("b", day(1), 4), ("a", day(40), 3)], key=str)
    assert spark.read.parquet(path).select(F.countDistinct("month")).first()[0] == 2
