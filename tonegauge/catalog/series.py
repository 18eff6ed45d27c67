"""Daily indices and calendars (G1-G3, G17, F5, H1-H5, K2, L)."""

from collections import Counter

from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.catalog import base as B
from tonegauge.catalog.base import query, rounded
from tonegauge.catalog.profiles import h7_sql
from tonegauge.catalog.responses import CLASSIFIED
from tonegauge.operators import calendar, indices
from tonegauge.operators.aggregates import aggregate_by
from tonegauge.operators.incremental import update_index
from tonegauge.plans.jobs import index_job
from tonegauge.session import scratch_path
from tonegauge.sources import tables
from tonegauge.streaming.ingest import collect_responses
from tonegauge.streaming.ledger import collect_ledger, current_states
from tonegauge.streaming.windows import collect_daily_index

VALUES = [*K.MEAN_METRICS, *K.DIFFUSION_METRICS]


def _diffusion_sql(column: str, base: str = "count(*)") -> str:
    return f"(count(*) FILTER (WHERE {column} = 'rise') + 0.5 * count(*) FILTER (WHERE {column} = 'neutral')) * 100.0 / {base}"


DAILY = "daily AS (SELECT country, date, {}, {}, CAST(count(*) AS INT) AS speech_count FROM prepared GROUP BY country, date)".format(
    ", ".join(f"avg({m}) AS {m}" for m in K.MEAN_METRICS),
    ", ".join(f"CAST({_diffusion_sql(m)} AS DOUBLE) AS {indices.diffusion_name(m)}" for m in K.IMPACT_METRICS),
)
_ROUNDED = ", ".join(f"round({v}, 6) AS {v}" for v in VALUES)
_SPAN = "span AS (SELECT country, min(date) AS a, {} AS b FROM daily GROUP BY country)"
_SPINE = "spine AS (SELECT country, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)"
_FILL = "filled AS (SELECT s.country, s.date, {}, CAST(coalesce(d.speech_count, 0) AS INT) AS speech_count FROM spine s LEFT JOIN daily d ON d.country = s.country AND d.date = s.date WINDOW w AS (PARTITION BY s.country ORDER BY s.date ROWS UNBOUNDED PRECEDING))".format(
    ", ".join(f"last_value(d.{v} IGNORE NULLS) OVER w AS {v}" for v in VALUES)
)


def filled_sql(end: str = "max(date)") -> str:
    return f"{B.PREPARED}, {DAILY}, {_SPAN.format(end)}, {_SPINE}, {_FILL}"


def _daily(spark, sf):
    return indices.daily_indices(B.prepared(spark, sf))


@query("g1_daily_mean", f"WITH {B.PREPARED} SELECT country, date, {', '.join(f'round(avg({m}), 6) AS {m}' for m in K.MEAN_METRICS)} FROM prepared GROUP BY country, date")
def g1(spark, sf):
    return rounded(_daily(spark, sf).select("country", "date", *K.MEAN_METRICS), *K.MEAN_METRICS)


_VALID = "nullif(count(*) FILTER (WHERE {0} IN ('rise', 'fall', 'neutral')), 0)"


@query("g2_diffusion_index", "WITH {} SELECT country, date, {} FROM prepared GROUP BY country, date".format(
    B.PREPARED, ", ".join(
        f"round(CAST({_diffusion_sql(m)} AS DOUBLE), 6) AS {indices.diffusion_name(m)}, "
        f"round(CAST({_diffusion_sql(m, _VALID.format(m))} AS DOUBLE), 6) AS {indices.diffusion_name(m)}_valid" for m in K.IMPACT_METRICS
    )))
def g2(spark, sf):
    # K2: the custom aggregate is a native expression, so it combines on the map side
    columns = {}
    for m in K.IMPACT_METRICS:
        columns[indices.diffusion_name(m)] = indices.diffusion_index(F.col(m))
        columns[f"{indices.diffusion_name(m)}_valid"] = indices.diffusion_index(F.col(m), valid_only=True)
    return B.prepared(spark, sf).groupBy("country", "date").agg(*[F.round(c, 6).alias(n) for n, c in columns.items()])


@query("k2_custom_aggregate", "WITH {} SELECT author, {} FROM prepared GROUP BY author".format(
    B.PREPARED, ", ".join(f"round(CAST({_diffusion_sql(m)} AS DOUBLE), 6) AS {indices.diffusion_name(m)}" for m in K.IMPACT_METRICS)))
def k2(spark, sf):
    aggregates = [F.round(indices.diffusion_index(F.col(m)), 6).alias(indices.diffusion_name(m)) for m in K.IMPACT_METRICS]
    return B.prepared(spark, sf).groupBy("author").agg(*aggregates)


@query("g3_speech_count", "SELECT event_type AS country, CAST(ts AS DATE) AS date, CAST(count(*) AS INT) AS speech_count FROM events GROUP BY 1, 2")
def g3(spark, sf):
    events = B.table(spark, sf, "events").select(F.col("event_type").alias("country"), F.col("ts").cast("date").alias("date"))
    return indices.daily_indices(events, means=[], impacts=[])


@query("f5_date_alignment", f"WITH {B.PREPARED}, {DAILY} SELECT country, date, {_ROUNDED}, speech_count FROM daily")
def f5(spark, sf):
    return rounded(_daily(spark, sf), *VALUES)


@query("h1_calendar_spine", f"WITH {B.PREPARED}, {DAILY}, {_SPAN.format('max(date)')}, {_SPINE} SELECT country, date FROM spine")
def h1(spark, sf):
    return calendar.calendar_spine(B.prepared(spark, sf).select("country", "date"))


@query("h2_forward_fill", f"""WITH {B.PREPARED}, d AS (SELECT country, date, avg(uncertainty) AS uncertainty, avg(topic_international) AS topic_international FROM prepared GROUP BY country, date)
SELECT country, date, round(last_value(uncertainty IGNORE NULLS) OVER w, 6) AS uncertainty, round(last_value(topic_international IGNORE NULLS) OVER w, 6) AS topic_international
FROM d WINDOW w AS (PARTITION BY country ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def h2(spark, sf):
    names = ["uncertainty", "topic_international"]
    daily = indices.daily_indices(B.prepared(spark, sf), means=names, impacts=[]).drop("speech_count")
    return rounded(calendar.carry_forward(daily, ["country"], names), *names)


@query("h3_filled_index", f"WITH {filled_sql()} SELECT country, date, {_ROUNDED}, speech_count FROM filled")
def h3(spark, sf):
    return rounded(index_job(B.prepared(spark, sf)), *VALUES)


@query("h4_common_end", f"WITH {filled_sql('(SELECT max(date) FROM daily)')} SELECT country, date, {_ROUNDED}, speech_count FROM filled")
def h4(spark, sf):
    return rounded(index_job(B.prepared(spark, sf), common_end=True), *VALUES)


_GRID_METRICS = ["hawkish_dovish_score", "uncertainty", "topic_growth", "stocks_diffusion_index", "speech_count"]
_NEUTRAL = {"hawkish_dovish_score": 0, "stocks_diffusion_index": 50}


def _grid_sql(metric: str) -> str:
    if metric in _NEUTRAL:
        return (
            f"SELECT g.country, g.date, '{metric}' AS metric, round(CASE WHEN d.date IS NULL THEN {_NEUTRAL[metric]} ELSE d.{metric} END, 6) AS value "
            "FROM grid g LEFT JOIN daily d ON d.country = g.country AND d.date = g.date"
        )
    lifted = f"CASE WHEN {metric} = 0 THEN 0.01 ELSE {metric} END" if metric != "speech_count" else "CAST(speech_count AS DOUBLE)"
    return f"SELECT country, date, '{metric}' AS metric, round({lifted}, 6) AS value FROM daily"


@query("h5_calendar_grid", f"""WITH {B.PREPARED}, {DAILY}, years AS (SELECT DISTINCT country, year(date) AS y FROM daily),
grid AS (SELECT country, CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date FROM years)
{' UNION ALL '.join(_grid_sql(m) for m in _GRID_METRICS)}""")
def h5(spark, sf):
    daily = _daily(spark, sf).select("country", "date", *_GRID_METRICS)
    return rounded(calendar.calendar_grid(daily), "value").drop("year")


@query("g17_index_summary", "WITH {}, long AS ({}) SELECT country, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM long GROUP BY 1, 2".format(
    filled_sql(), " UNION ALL ".join(f"SELECT country, '{v}' AS metric, {v} AS value FROM filled" for v in VALUES)))
def g17(spark, sf):
    return rounded(indices.index_summary(index_job(B.prepared(spark, sf))), "mean", "std")


@query("g17_index_coverage", f"""WITH {filled_sql()} SELECT country, min(date) AS first_date, max(date) AS last_date, count(*) AS total_days,
  count(*) FILTER (WHERE speech_count > 0) AS days_with_speeches, count(*) FILTER (WHERE speech_count = 0) AS days_filled,
  CAST(sum(speech_count) AS BIGINT) AS total_speeches, round(avg(speech_count) FILTER (WHERE speech_count > 0), 6) AS avg_per_date FROM filled GROUP BY country""")
def g17_coverage(spark, sf):
    return rounded(indices.index_coverage(index_job(B.prepared(spark, sf))), "avg_per_date")


@query("events_daily_value", """WITH daily AS (SELECT event_type AS country, CAST(ts AS DATE) AS date, avg(value) AS value, CAST(count(*) AS INT) AS speech_count FROM events GROUP BY 1, 2),
span AS (SELECT country, min(date) AS a, max(date) AS b FROM daily GROUP BY country), """ + _SPINE + """
SELECT s.country, s.date, round(last_value(d.value IGNORE NULLS) OVER (PARTITION BY s.country ORDER BY s.date ROWS UNBOUNDED PRECEDING), 6) AS value,
  CAST(coalesce(speech_count, 0) AS INT) AS speech_count FROM spine s LEFT JOIN daily d ON d.country = s.country AND d.date = s.date""")
def events_daily(spark, sf):
    events = B.table(spark, sf, "events").select(F.col("event_type").alias("country"), F.col("ts").cast("date").alias("date"), "value")
    return rounded(calendar.fill_calendar(indices.daily_indices(events, means=["value"], impacts=[])), "value")


@query("l_incremental_responses", f"WITH {CLASSIFIED} SELECT custom_id AS speech_id FROM good")
def incremental(spark, sf):
    """Two deliveries of response files, each taken in once by the same checkpointed stream."""
    inbox, table, checkpoint = (scratch_path(spark, name) for name in ("inbox", "parsed", "stream"))
    lines = B.responses(spark, sf)
    for delivery in (F.col("chunk_number") <= 3, F.col("chunk_number") > 3):
        lines.where(delivery).select("raw").write.mode("append").text(inbox)
        collect_responses(spark, inbox, table, checkpoint)
    return spark.read.parquet(table).select("speech_id")


@query("l_set_aside", f"WITH {CLASSIFIED} SELECT md5(raw) AS raw_md5, custom_id, reason FROM classified WHERE reason IS NOT NULL")
def set_aside(spark, sf):
    """What the stream could not use is kept beside what it could."""
    inbox, table, checkpoint = (scratch_path(spark, name) for name in ("inbox", "parsed", "stream"))
    B.responses(spark, sf).select("raw").write.text(inbox)
    collect_responses(spark, inbox, table, checkpoint)
    return spark.read.parquet(f"{table}_set_aside").select(F.md5(F.col("raw").cast("binary")).alias("raw_md5"), "custom_id", "reason")


_DELAY = 1200
_LATE = f"date < (SELECT max(date) FROM prepared WHERE order_key % 3 <> 0) - INTERVAL {_DELAY} DAY"


@query("l_daily_window", f"""WITH {B.PREPARED.replace("prepared AS", "every AS")}, prepared AS (SELECT * FROM every WHERE order_key % 3 <> 0),
taken AS (SELECT * FROM prepared UNION ALL SELECT * FROM every WHERE order_key % 3 = 0 AND NOT ({_LATE})),
{DAILY.replace("FROM prepared", "FROM taken")} SELECT country, date, {_ROUNDED}, speech_count FROM daily
UNION ALL SELECT 'late', date, {", ".join("NULL" for _ in VALUES)}, CAST(count(*) AS INT) FROM every WHERE order_key % 3 = 0 AND {_LATE} GROUP BY date""")
def daily_window(spark, sf):
    """Two deliveries, the second with rows behind the watermark: the windows' index, and the late rows of each day."""
    inbox, folder = scratch_path(spark, "inbox"), scratch_path(spark, "windows")
    rows = B.prepared(spark, sf)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    for delivery in (F.col("order_key") % 3 != 0, F.col("order_key") % 3 == 0):
        rows.where(delivery).write.mode("append").parquet(inbox)
        collect_daily_index(spark, inbox, schema, folder, _DELAY)
    index = spark.read.parquet(f"{folder}/index").drop(tables.MONTH)
    late = spark.read.parquet(f"{folder}/late").groupBy("date").agg(F.count("*").cast("int").alias("speech_count")).withColumn("country", F.lit("late"))
    return rounded(index.unionByName(late, allowMissingColumns=True), *VALUES)


@query("h3_incremental_index", f"WITH {filled_sql()} SELECT country, date, {_ROUNDED}, speech_count FROM filled")
def h3_incremental(spark, sf):
    """The filled index after two deliveries, the second of which only touches its own days and what follows them."""
    folder = scratch_path(spark, "kept_index")
    rows = B.prepared(spark, sf)
    update_index(rows.where("order_key % 3 <> 0"), folder, "first")
    update_index(rows.where("order_key % 3 = 0"), folder, "second")
    return rounded(spark.read.parquet(f"{folder}/index").drop(tables.MONTH), *VALUES)


class DiffusionState:
    """g2's diffusion indices as an aggregate a user could have written: counts per label."""

    def __init__(self, names):
        self.names = names

    def start(self):
        return {}

    def update(self, state, columns):
        for name, values in columns.items():
            for label, n in Counter(values.tolist()).items():  # a few rows at a time: cheaper than a Series of counts
                key = (name, label if isinstance(label, str) else None)
                state[key] = state.get(key, 0) + int(n)
        return state

    def merge(self, one, other):
        return {key: one.get(key, 0) + other.get(key, 0) for key in {*one, *other}}

    def finish(self, state):
        out = {}
        for name, out_name in self.names.items():
            count = lambda *labels, name=name: sum(state.get((name, label), 0) for label in labels)
            points, rows, known = count("rise") + 0.5 * count("neutral"), sum(n for (c, _), n in state.items() if c == name), count("rise", "neutral", "fall")
            out[out_name] = points * 100 / rows
            out[f"{out_name}_valid"] = points * 100 / known if known else None
        return out


@query("k2_user_aggregate", "WITH {} SELECT country, date, {} FROM prepared GROUP BY country, date".format(
    B.PREPARED, ", ".join(
        f"round(CAST({_diffusion_sql(m)} AS DOUBLE), 6) AS {indices.diffusion_name(m)}, "
        f"round(CAST({_diffusion_sql(m, _VALID.format(m))} AS DOUBLE), 6) AS {indices.diffusion_name(m)}_valid" for m in K.IMPACT_METRICS
    )))
def k2_user(spark, sf):
    names = [n for m in K.IMPACT_METRICS for n in (indices.diffusion_name(m), f"{indices.diffusion_name(m)}_valid")]
    kind = "struct<" + ", ".join(f"{n}: double" for n in names) + ">"
    found = aggregate_by(B.prepared(spark, sf), ["country", "date"], K.IMPACT_METRICS, DiffusionState({m: indices.diffusion_name(m) for m in K.IMPACT_METRICS}), kind)
    return rounded(found.select("country", "date", "value.*"), *names)


@query("l_ledger_state", h7_sql())
def ledger_state(spark, sf):
    """Three deliveries of chunk events out of order, held as keyed state."""
    inbox, table, checkpoint = (scratch_path(spark, name) for name in ("events", "states", "stream"))
    events = B.ledger(spark, sf).select("chunk_name", "batch_id", "status", F.col("updated_at").cast("timestamp").alias("updated_at"), F.col("event_id").cast("bigint").alias("event_id"))
    for part in (2, 0, 1):
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(inbox)
        collect_ledger(spark, inbox, table, checkpoint)
    return current_states(spark, table).drop("stuck")
