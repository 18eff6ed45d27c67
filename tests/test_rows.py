"""Contracts, filters, joins, profiles, audit and ledger on small frames."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tonegauge.operators import audit as A
from tonegauge.operators import contracts as C
from tonegauge.operators import ingest as N
from tonegauge.operators import joins as J
from tonegauge.operators import ledger as L
from tonegauge.operators import profile as P


def day(n, month=1, year=2022):
    return dt.date(year, month, n)


# --- contracts ---------------------------------------------------------------------------------


def test_required_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.require_columns(df, ["a"])
    with pytest.raises(ValueError, match=r"speeches: no columns \['c', 'd'\]"):
        C.require_columns(df, ["d", "a", "c"], "speeches")


def test_column_resolution(spark):
    df = spark.createDataFrame([(1, 2, 3)], "text int, Main_Speaker int, content int")
    assert C.resolve_column(df, ("clean_text", "text")) == "text"
    assert C.resolve_column(df, ("speech",), containing="speaker") == "Main_Speaker"
    assert C.resolve_column(df, ("speech",), containing="date") is None


def test_defaults(spark):
    df = spark.createDataFrame([(None,), ("x",)], "author string")
    assert [tuple(r) for r in C.fill_defaults(df, ["author", "country"]).collect()] == [("Unknown", "Unknown"), ("x", "Unknown")]
    assert [tuple(r) for r in C.fill_missing_columns(df, ["author", "country"]).collect()] == [(None, "Unknown"), ("x", "Unknown")]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (float("nan"), 2.0)], "a double, b double")
    assert [tuple(r) for r in C.nan_to_null(df).collect()] == [(1.0, None), (None, 2.0)]


# --- filters -----------------------------------------------------------------------------------


def test_year_sample(spark):
    df = spark.createDataFrame([(day(1, 1, y), c) for y in (2021, 2022, 2023, 2024) for c in ("us", "ea")], "date date, country string")
    assert N.sample_years(df, 2022, 2023).count() == 4
    assert N.sample_years(df, 2022, 2023, "us", skip_unknown=True).count() == 4
    with pytest.raises(ValueError, match="no column institution"):
        N.sample_years(df, 2022, 2023, "us")
    assert N.sample_years(df, 2022, 2023, "us", "country").count() == 2


@pytest.mark.parametrize("kind", ["date", "timestamp_ntz"])
def test_year_bounds_reach_the_scan(spark, tmp_path, kind):
    path = str(tmp_path / "dated")
    spark.range(10).select(F.date_add(F.lit("2021-06-01").cast("date"), F.col("id").cast("int") * 100).cast(kind).alias("date")).write.parquet(path)
    kept = N.sample_years(spark.read.parquet(path), 2022, 2022)
    pushed = [line for line in kept._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "PushedFilters" in line]
    assert kept.count() == 3 and any("GreaterThanOrEqual" in line and "LessThan(" in line for line in pushed)


def test_date_range_keeps_the_whole_last_day(spark):
    stamps = ["2022-01-01 00:00:00", "2022-01-31 00:00:00", "2022-01-31 10:00:00", "2022-02-01 00:00:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "Date string").select(F.col("Date").cast("timestamp_ntz").alias("Date"))
    kept = N.between_dates(df, "2022-01-01", "2022-01-31")
    assert kept.columns == ["date"] and kept.count() == 3
    assert N.between_dates(df, "2022-01-01", "2022-01-31", midnight_end=True).count() == 2
    with pytest.raises(ValueError, match="No date column"):
        N.between_dates(spark.range(1), "2022-01-01", "2022-01-31")


def test_date_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "dated")
    spark.createDataFrame([(day(1), 1)], "date date, v int").write.parquet(path)
    plan = N.between_dates(spark.read.parquet(path), "2022-01-01", "2022-01-31")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2022-01-01)" in plan and "LessThanOrEqual(date,2022-01-31)" in plan


def test_unreadable_dates_are_set_aside(spark):
    df = spark.createDataFrame([("2022-01-02",), ("2022-13-01",), (None,)], "date string")
    good, aside = N.split_by_date(df)
    assert [r["date"] for r in good.collect()] == [day(2)]
    assert sorted(str(r["date_raw"]) for r in aside.collect()) == ["2022-13-01", "None"]


def test_latest_per_key_and_union(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert sorted(map(tuple, N.latest_per_key(df, ["k"], ["n"]).collect())) == [("a", 2, "y"), ("b", 1, "z")]
    assert N.union_chunks([df, df.select("v", "n", "k")]).where("k = 'a' and v = 'x'").count() == 2


def test_id_order_is_string_order(spark):
    df = spark.createDataFrame([("speech_2",), ("speech_10",)], "speech_id string")
    assert [r[0] for r in N.by_id(df).collect()] == ["speech_10", "speech_2"]


# --- joins -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def metadata(spark):
    rows = [(day(3), "Ann", "us", "T3"), (day(1), "Bob", "ea", "T1"), (day(2), "Cid", "us", "T2")]
    return spark.createDataFrame(rows, "date date, author string, country string, title string")


def test_positional_join(spark, metadata):
    scored = spark.createDataFrame([("speech_2", 5.0), ("speech_0", 1.0), ("speech_9", 9.0), ("bad", 0.0)], "speech_id string, score double")
    got = {r["speech_id"]: r["title"] for r in J.join_by_position(metadata, scored, ["date"]).collect()}
    assert got == {"speech_2": "T3", "speech_0": "T1"}
    numbered = metadata.withColumn("row_index", F.when(F.col("author") == "Ann", 0).otherwise(F.lit(7)))
    assert [r["title"] for r in J.join_by_position(numbered, scored).collect()] == ["T3"]
    with pytest.raises(ValueError, match="order_by"):
        J.join_by_position(metadata, scored)
    with pytest.raises(Exception, match="no number after"):
        J.join_by_position(metadata, scored, ["date"], strict=True).collect()


def test_duplicates_multiply_in_the_key_join(spark):
    speeches = spark.createDataFrame([("s1", "t")], "speech_id string, title string")
    results = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 3)], "speech_id string, score int")
    assert J.join_by_key(speeches, results).count() == 2


def test_lookup_tells_missing_rows(spark):
    sample = spark.createDataFrame([("a",), ("b",)], "k string")
    table = spark.createDataFrame([("a", None)], "k string, text string")
    assert {r["k"]: r["found"] for r in J.lookup(sample, table, "k").collect()} == {"a": True, "b": False}


# --- profiles ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        ("us", day(1), -60.0, "rise"), ("us", day(1), 60.0, None), ("us", day(2), 10.0, "fall"), ("us", day(3, 2), None, "rise"),
        ("ea", day(1), 20.0, "rise"), ("ea", day(5, 2), 30.0, "odd"), (None, day(7, 3), 0.0, "rise"), ("ea", None, 5.0, None),
    ]
    return spark.createDataFrame(rows, "country string, date date, hawkish_dovish_score double, market_impact_stocks string")


def test_counts(scored):
    assert [tuple(r) for r in P.value_counts(scored, "country").collect()] == [("us", 4), ("ea", 3)]
    assert [tuple(r) for r in P.year_counts(scored, last=1).collect()] == [(2022, 7)]
    assert sorted(map(tuple, P.month_counts(scored).collect())) == [(day(1), 4), (day(1, 2), 2), (day(1, 3), 1)]


def test_crosstab(scored):
    long = {(r["month"], r["country"]): r["count"] for r in P.month_crosstab(scored).collect()}
    assert long["Total", "Total"] == 6 and long["2022-01", "us"] == 3 and long["2022-02", "Total"] == 2
    wide = {r["month"]: r for r in P.month_crosstab_wide(scored, ["us", "ea"]).collect()}
    assert (wide["2022-01"]["us"], wide["2022-01"]["ea"], wide["Total"]["Total"]) == (3, 1, 6)


def test_a_group_named_like_a_margin_stays_apart(spark):
    df = spark.createDataFrame([(day(1), "Total", 1.0), (day(1), "OVERALL", 3.0)], "date date, country string, v double")
    cells = {(r["month"], r["country"], r["all_months"], r["all_groups"]): r["count"] for r in P.month_crosstab(df).collect()}
    assert cells["2022-01", "Total", False, False] == 1 and cells["2022-01", "Total", False, True] == 2
    rows = {(r["group"], r["is_total"]): r["p50"] for r in P.describe_by_group(df, ["v"]).collect()}
    assert rows == {("OVERALL", True): 2.0, ("OVERALL", False): 3.0, ("Total", False): 1.0}


def test_busy_days_and_load(scored):
    assert [tuple(r) for r in P.busy_days(scored).collect()] == [(day(1), "us", 2)]
    assert P.busiest_days(scored, k=1).count() == 1
    load = P.day_load(scored).first()
    assert (load["median"], load["max"], load["days_with_one"], load["days_with_more"]) == (1.0, 3, 4, 1)
    assert tuple(P.distinct_dates(scored).first()) == (5, 3)
    assert P.date_span(scored).first()["days"] == 65


def test_describe(scored):
    rows = {r["group"]: r for r in P.describe_by_group(scored, ["hawkish_dovish_score"]).collect()}
    assert [g for g, r in rows.items() if r["is_total"]] == ["OVERALL"]
    assert set(rows) == {"OVERALL", "us", "ea"}
    assert (rows["OVERALL"]["rows"], rows["us"]["rows"], rows["ea"]["rows"]) == (8, 4, 3)
    us = rows["us"]
    assert (us["min"], us["p25"], us["p50"], us["p75"], us["max"]) == (-60.0, -25.0, 10.0, 35.0, 60.0)
    assert us["mean"] == pytest.approx(10 / 3) and us["std"] == pytest.approx(60.2771, abs=1e-3)
    assert rows["OVERALL"]["p50"] == 10.0


def test_score_distribution(scored):
    row = P.score_distribution(scored, ["hawkish_dovish_score"]).first()
    assert row["median"] == 10.0
    assert [row[b] for b in ("very_dovish", "dovish", "neutral", "hawkish", "very_hawkish")] == [1, 0, 3, 2, 1]


def test_group_difference(scored):
    row = P.group_difference(scored, "us", "ea", ["hawkish_dovish_score"]).first()
    assert row["difference"] == pytest.approx(10 / 3 - 55 / 3) and row["substantial"] is True


def test_category_shares_keep_nulls_in_the_base(scored):
    rows = {(r["group"], r["value"]): (r["count"], r["percent"]) for r in P.category_shares(scored, ["market_impact_stocks"]).collect()}
    assert rows["us", "rise"] == (2, 50.0) and rows["OVERALL", "rise"] == (4, 50.0)
    assert ("us", None) not in rows and rows["ea", "odd"] == (1, pytest.approx(100 / 3))


def test_category_shares_scan_once(scored, spark, tmp_path):
    path = str(tmp_path / "scored")
    scored.write.parquet(path)
    shares = P.category_shares(spark.read.parquet(path), ["market_impact_stocks"])
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "ExistingRDD" in plan


def test_missing_profile(scored):
    rows = {r["column"]: (r["missing"], r["percent"]) for r in P.missing_profile(scored).collect()}
    assert rows == {"date": (1, 12.5), "country": (1, 12.5), "hawkish_dovish_score": (1, 12.5), "TOTAL": (3, None)}


def test_most_active_month_takes_the_earliest(spark):
    rows = [("us", day(1, m)) for m in (3, 3, 2, 2, 1)] + [("ea", day(1, 4))]
    df = spark.createDataFrame(rows, "country string, date date")
    assert {r["country"]: (r["month"], r["count"]) for r in P.most_active_month(df).collect()} == {"us": (day(1, 2), 2), "ea": (day(1, 4), 1)}
    assert {r["country"]: r["avg_per_month"] for r in P.average_per_month(df).collect()} == {"us": 1.25, "ea": 0.25}


# --- audit -------------------------------------------------------------------------------------


def test_extremes(spark):
    rows = [("us", "s1", day(2), 80.0), ("us", "s0", day(1), 80.0), ("us", "s2", day(1), -80.0), ("ea", "s3", day(1), 85.0), ("ea", "s4", day(1), -20.0), ("ea", "s5", day(3), 85.0)]
    df = spark.createDataFrame(rows, "country string, speech_id string, date date, hawkish_dovish_score double")
    assert {r["country"]: r["speech_id"] for r in A.extreme_rows(df).collect()} == {"us": "s2", "ea": "s3"}


def test_middle_sample_stays_in_the_middle(spark):
    rows = [("us" if i % 4 else "ea", f"s{i:03d}", day(i % 28 + 1), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "country string, speech_id string, date date, hawkish_dovish_score double")
    picks = A.middle_rows(df).collect()
    assert len(picks) == 2
    for pick in picks:
        own = sorted((r[2], r[1]) for r in rows if r[0] == pick["country"])
        place = own.index((pick["date"], pick["speech_id"]))
        assert int(len(own) * 0.2) <= place < int(len(own) * 0.8)
    assert sorted(map(tuple, picks)) == sorted(map(tuple, A.middle_rows(df.repartition(7)).collect()))


def test_middle_sample_of_keys_that_repeat_or_are_missing(spark):
    rows = [("us", "s1" if i % 2 else "s0", day(1), float(i)) for i in range(20)] + [("ea", None, day(i + 1), float(i)) for i in range(10)] + [(None, f"n{i}", day(i + 1), 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "country string, speech_id string, date date, hawkish_dovish_score double")
    picks = {r["country"]: r["speech_id"] for r in A.middle_rows(df).collect()}
    least = min(("s0", "s1"), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    assert picks.keys() == {"us", "ea", None} and picks["us"] == least and picks["ea"] is None
    inner = [f"n{i}" for i in range(2, 8)]
    assert picks[None] == min(inner, key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())


def test_assessment_of_every_row(spark):
    scored = spark.createDataFrame([("a", 50.0), ("b", -50.0), ("c", 0.0), ("d", 0.0)], "speech_id string, hawkish_dovish_score double")
    texts = spark.createDataFrame([("a", "Inflation must be met: tighten"), ("b", "inflation"), ("c", "")], "speech_id string, speech_text string")
    rows = {r["speech_id"]: r for r in A.assess(scored, texts).collect()}
    assert rows["a"]["assessment"].startswith("REASONABLE") and rows["a"]["hawkish_terms"] == ["inflation", "tighten"]
    assert rows["b"]["assessment"].startswith("QUESTIONABLE")
    assert rows["c"]["assessment"].startswith("ERROR") and rows["d"]["assessment"].startswith("ERROR")


# --- ledger ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("chunk01_input.jsonl", "b1", "submitted", 1), ("chunk01_input.jsonl", "b1", "failed", 2), ("chunk01_input.jsonl", "b2", "completed", 3),
        ("chunk02_input.jsonl", "b3", "validating", 1), ("chunk03_input.jsonl", None, "error", 1), ("chunk04_input.jsonl", "b4", "expired", 5),
        ("_metadata", "m", "completed", 9),
    ]
    return spark.createDataFrame(rows, "chunk_name string, batch_id string, status string, updated_at int")


def test_latest_state_and_replaced_batch(events):
    latest = {r["chunk_name"][:7]: r["status"] for r in L.latest_states(events).collect()}
    assert latest == {"chunk01": "completed", "chunk02": "validating", "chunk03": "error", "chunk04": "expired"}
    rows = {r["chunk_name"][:7]: (r["batch_id"], r["previous_batch_id"], r["resubmitted"]) for r in L.with_previous_batch(events).collect()}
    assert rows["chunk01"] == ("b2", "b1", True) and rows["chunk02"] == ("b3", None, False) and rows["chunk03"] == (None, None, False)


def test_replaced_batch_of_chunks_with_many_batches(spark):
    draw = random.Random(3)
    rows = [(f"chunk{draw.randint(1, 5)}", draw.choice([None, "a", "b", "c", "d"]), i) for i in range(120)] + [("chunk9", "a", 500), ("chunk9", None, 501)]
    found = {r["chunk_name"]: (r["batch_id"], r["previous_batch_id"]) for r in L.with_previous_batch(spark.createDataFrame(rows, "chunk_name string, batch_id string, updated_at int")).collect()}
    for chunk in {r[0] for r in rows}:
        own = [r[1] for r in sorted((r for r in rows if r[0] == chunk), key=lambda r: -r[2])]
        earlier = [b for b in own if b is not None and own[0] is not None and b != own[0]]
        assert found[chunk] == (own[0], earlier[0] if earlier else None)


def test_latest_by_one_column_is_a_hash_aggregate(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, n int, v string")
    latest = N.latest_per_key(df, ["k"], ["n"], columns=["k", "n"], count="rows")
    assert sorted(map(tuple, latest.collect()), key=str) == [("a", 2, 2), (None, 3, 1)]
    assert "SortAggregate" not in latest._jdf.queryExecution().executedPlan().toString()


def test_status_rollup(events):
    latest = L.latest_states(events)
    full, reduced = (L.status_rollup(latest, p).first().asDict() for p in ("full", "reduced"))
    assert full == {"total": 4, "completed": 1, "in_progress": 1, "failed": 0, "other": 2, "progress": 25.0}
    assert (reduced["failed"], reduced["other"]) == (1, 1)
    assert L.status_rollup(latest.limit(0)).first()["progress"] == 0.0


def test_chunks_left_to_do(spark, events):
    files = spark.createDataFrame([(f"chunk0{i}_input.jsonl",) for i in range(1, 7)], "chunk_name string")
    assert sorted(r[0][:7] for r in J.untracked_chunks(files, events).collect()) == ["chunk05", "chunk06"]
    again = J.chunks_to_submit(files, L.latest_states(events), ["completed", "in_progress"])
    assert sorted(r[0][:7] for r in again.collect()) == [f"chunk0{i}" for i in (2, 3, 4, 5, 6)]


def test_audit_reads_whole_texts(spark):
    """A term that first occurs behind 40,000 characters counts."""
    scored = spark.createDataFrame([("s1", 10.0), ("s2", 0.0)], "speech_id string, hawkish_dovish_score double")
    texts = spark.createDataFrame([("s1", "x " * 20_000 + "inflation"), ("s3", "inflation")], "speech_id string, speech_text string")
    rows = {r["speech_id"]: r for r in A.assess(scored, texts, hawkish=["inflation"], dovish=["ease"]).collect()}
    assert rows["s1"]["hawkish_terms"] == ["inflation"] and rows["s2"]["assessment"].startswith("ERROR")


def test_dataset_contents_names_columns_groups_and_years(spark):
    rows = [(day(1), "X"), (day(2), "X"), (day(1, year=2023), "Y"), (None, "Y"), (day(3), None)]
    found = {tuple(r) for r in P.dataset_contents(spark.createDataFrame(rows, "date date, country string")).select("part", "label", "place", "rows").collect()}
    assert found == {("column", "date", 0, None), ("column", "country", 1, None), ("group", "X", None, 2), ("group", "Y", None, 2), ("year", "2022", None, 3), ("year", "2023", None, 1)}
