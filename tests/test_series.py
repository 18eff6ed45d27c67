import datetime as dt

import pytest
from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.operators import calendar as C
from tonegauge.operators import indices as I
from tonegauge.plans.jobs import index_job


def day(n, month=1, year=2022):
    return dt.date(year, month, n)


def test_diffusion_counts_every_row_by_default(spark):
    rows = [("a", "rise"), ("a", None), ("a", "strengthen"), ("b", "neutral"), ("c", None), ("d", "rise"), ("d", "neutral"), ("d", "fall")]
    df = spark.createDataFrame(rows, "g string, v string").groupBy("g")
    got = {r[0]: r[1] for r in df.agg(I.diffusion_index(F.col("v"))).collect()}
    assert got == {"a": pytest.approx(100 / 3), "b": 50.0, "c": 0.0, "d": pytest.approx(50.0)}
    valid = {r[0]: r[1] for r in df.agg(I.diffusion_index(F.col("v"), valid_only=True)).collect()}
    assert valid == {"a": 100.0, "b": 50.0, "c": None, "d": pytest.approx(50.0)}
    assert dict(df.agg(I.diffusion_index(F.col("v")).alias("x")).dtypes)["x"] == "double"


def test_daily_means_skip_missing_values_and_dates(spark):
    rows = [(day(1), "us", 10.0, "rise"), (day(1), "us", None, "fall"), (day(1), "us", 20.0, None), (None, "us", 5.0, "rise")]
    df = spark.createDataFrame(rows, "date date, country string, hawkish_dovish_score double, market_impact_stocks string")
    daily = I.daily_indices(df, means=["hawkish_dovish_score"], impacts=["market_impact_stocks"]).collect()
    assert len(daily) == 1
    assert daily[0].asDict() == {
        "country": "us", "date": day(1), "hawkish_dovish_score": 15.0, "stocks_diffusion_index": pytest.approx(100 / 3), "speech_count": 3,
    }


@pytest.fixture(scope="module")
def daily(spark):
    rows = [
        ("a", day(1), 1.0, None, 1), ("a", day(3), None, None, 1), ("a", day(4), 3.0, 0.0, 1),
        ("b", day(2), 5.0, 7.0, 2), ("b", day(6), 6.0, None, 1),
    ]
    return spark.createDataFrame(rows, "country string, date date, hawkish_dovish_score double, uncertainty double, speech_count int")


def values(df, country, *columns):
    return [tuple(r[c] for c in columns) for r in df.where(F.col("country") == country).orderBy("date").collect()]


def test_filled_calendar(daily):
    filled = C.fill_calendar(daily)
    assert values(filled, "a", "date", "hawkish_dovish_score", "uncertainty", "speech_count") == [
        (day(1), 1.0, None, 1), (day(2), 1.0, None, 0), (day(3), 1.0, None, 1), (day(4), 3.0, 0.0, 1),
    ]
    assert values(filled, "b", "hawkish_dovish_score", "uncertainty", "speech_count") == [
        (5.0, 7.0, 2), (5.0, 7.0, 0), (5.0, 7.0, 0), (5.0, 7.0, 0), (6.0, 7.0, 1),
    ]
    again = C.fill_calendar(filled)
    assert sorted(map(str, again.collect())) == sorted(map(str, filled.collect()))
    assert filled.agg(F.sum("speech_count")).first()[0] == daily.agg(F.sum("speech_count")).first()[0]


def test_filled_calendar_matches_spine_and_carry(daily):
    joined = C.calendar_spine(daily).join(daily, ["country", "date"], "left")
    carried = C.carry_forward(joined, ["country"], ["hawkish_dovish_score", "uncertainty"]).withColumn("speech_count", F.coalesce("speech_count", F.lit(0)))
    filled = C.fill_calendar(daily)
    assert sorted(map(str, carried.select(*filled.columns).collect())) == sorted(map(str, filled.collect()))


def test_common_end(daily):
    end = C.common_end(daily)
    both = C.fill_calendar(daily, end=end)
    assert values(both, "a", "date", "hawkish_dovish_score", "speech_count")[-2:] == [(day(5), 3.0, 0), (day(6), 3.0, 0)]
    assert len(values(C.fill_calendar(daily, end=end, extend_only=["b"]), "a", "date")) == 4


def test_nothing_to_fill(daily):
    assert C.fill_calendar(daily.limit(0)).count() == 0
    assert C.calendar_spine(daily.limit(0)).count() == 0


def test_fill_needs_no_join_and_one_sort(daily):
    plan = C.fill_calendar(daily)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_calendar_grid(spark):
    rows = [("a", day(1), 0.0, 0.0, 1), ("a", day(5, 3, 2024), 40.0, 12.0, 2), ("b", day(1), None, 5.0, 1)]
    df = spark.createDataFrame(rows, "country string, date date, hawkish_dovish_score double, topic_growth double, speech_count int")
    grid = C.calendar_grid(df)
    counts = {(r["country"], r["metric"], r["year"]): r["count"] for r in grid.groupBy("country", "metric", "year").count().collect()}
    assert counts == {
        ("a", "hawkish_dovish_score", 2022): 365, ("a", "hawkish_dovish_score", 2024): 366, ("b", "hawkish_dovish_score", 2022): 365,
        ("a", "topic_growth", 2022): 1, ("a", "topic_growth", 2024): 1, ("b", "topic_growth", 2022): 1,
        ("a", "speech_count", 2022): 1, ("a", "speech_count", 2024): 1, ("b", "speech_count", 2022): 1,
    }
    cell = lambda c, m, d: grid.where((F.col("country") == c) & (F.col("metric") == m) & (F.col("date") == F.lit(d))).first()["value"]
    assert cell("a", "topic_growth", day(1)) == K.ZERO_DISPLAY_VALUE
    assert cell("a", "hawkish_dovish_score", day(1)) == 0.0
    assert cell("a", "hawkish_dovish_score", day(2)) == 0.0
    assert cell("a", "hawkish_dovish_score", day(5, 3, 2024)) == 40.0
    assert cell("b", "hawkish_dovish_score", day(1)) is None  # a day with rows but no score stays empty


def test_metric_catalog(spark, daily):
    catalog = {r["metric"]: r for r in C.metric_catalog(spark).collect()}
    assert set(catalog) == {*K.INDEX_METRICS, "speech_count"}
    assert catalog["topic_growth"]["title_with_scale"] == "Growth (0-100, higher=more emphasis)"
    assert catalog["speech_count"]["title_with_scale"] == "Speech Count"
    long = C.long_index(daily)
    assert long.count() == daily.count() * 3
    assert long.where("metric = 'hawkish_dovish_score'").first()["neutral"] == 0.0


def test_index_summary_and_coverage(daily):
    filled = C.fill_calendar(daily)
    cover = {r["country"]: r for r in I.index_coverage(filled).collect()}
    assert (cover["a"]["total_days"], cover["a"]["days_with_speeches"], cover["a"]["days_filled"], cover["a"]["total_speeches"]) == (4, 3, 1, 3)
    summary = {(r["country"], r["metric"]): r for r in I.index_summary(filled, metrics=["hawkish_dovish_score"]).collect()}
    assert summary["a", "hawkish_dovish_score"]["mean"] == 1.5


def test_index_job_on_many_groups(spark):
    rows = spark.range(5000).select(
        F.date_add(F.lit("2022-01-01").cast("date"), (F.col("id") * 37 % 400).cast("int")).alias("date"),
        F.concat(F.lit("g"), F.col("id") % 7).alias("country"), *[(F.col("id") % 101).cast("double").alias(m) for m in K.MEAN_METRICS],
        *[F.lit("rise").alias(m) for m in K.IMPACT_METRICS],
    )
    filled = index_job(rows, common_end=True)
    assert filled.agg(F.sum("speech_count")).first()[0] == 5000
    assert filled.groupBy("country").agg(F.max("date").alias("d")).select("d").distinct().count() == 1
