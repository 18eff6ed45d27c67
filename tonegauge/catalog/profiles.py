"""Counts, distributions, completeness, job state (G4-G22, H7, I3)."""

from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.catalog import base as B
from tonegauge.catalog.base import query, rounded
from tonegauge.operators import ledger as L
from tonegauge.operators import sketches
from tonegauge.session import scratch_path
from tonegauge.operators import profile as P

_LATEST = "latest AS (SELECT chunk_name, arg_max(status, struct_pack(a := updated_at, b := event_id)) AS status, arg_max(batch_id, struct_pack(a := updated_at, b := event_id)) AS batch_id FROM ledger GROUP BY chunk_name)"
_ORDER = ["updated_at", "event_id"]


@query("g4_value_counts", f"WITH {B.SPEECHES} SELECT author, count(*) AS count FROM speeches WHERE author IS NOT NULL GROUP BY author")
def g4(spark, sf):
    return P.value_counts(B.speeches(spark, sf), "author")


@query("g5_year_distribution", f"WITH {B.PREPARED} SELECT CAST(year(date) AS INT) AS year, count(*) AS count FROM prepared GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def g5(spark, sf):
    return P.year_counts(B.prepared(spark, sf), last=5)


@query("g6_month_counts", f"WITH {B.PREPARED} SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS count FROM prepared GROUP BY 1")
def g6(spark, sf):
    return P.month_counts(B.prepared(spark, sf))


@query("g7_month_crosstab", f"""WITH {B.PREPARED}, m AS (SELECT strftime(date, '%Y-%m') AS month, country FROM prepared)
SELECT coalesce(month, 'Total') AS month, coalesce(country, 'Total') AS country, CAST(count(*) AS BIGINT) AS count,
  grouping(month) = 1 AS all_months, grouping(country) = 1 AS all_groups FROM m GROUP BY CUBE (month, country)""")
def g7(spark, sf):
    return P.month_crosstab(B.prepared(spark, sf))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("g7_month_crosstab_wide", f"""WITH {B.PREPARED}, m AS (SELECT strftime(date, '%Y-%m') AS month, country FROM prepared)
SELECT coalesce(month, 'Total') AS month, {', '.join(f'''count(*) FILTER (WHERE country = '{p}') AS "{p}"''' for p in _PRIORITIES)}, count(*) AS "Total"
FROM m GROUP BY ROLLUP (month)""")
def g7_wide(spark, sf):
    return P.month_crosstab_wide(B.prepared(spark, sf), _PRIORITIES)


@query("g8_busy_days", f"WITH {B.PREPARED} SELECT date, country, count(*) AS count FROM prepared GROUP BY 1, 2 HAVING count(*) > 1")
def g8(spark, sf):
    return P.busy_days(B.prepared(spark, sf))


@query("g9_day_load", f"""WITH {B.PREPARED}, d AS (SELECT count(*) AS c FROM prepared GROUP BY date)
SELECT round(avg(c), 6) AS mean, round(median(c), 6) AS median, max(c) AS max, count(*) FILTER (WHERE c = 1) AS days_with_one,
  count(*) FILTER (WHERE c >= 2) AS days_with_more FROM d""")
def g9(spark, sf):
    return rounded(P.day_load(B.prepared(spark, sf)), "mean", "median")


_DESCRIBE = ("count(*) AS rows, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, "
             "round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max")
_STATS = ["mean", "std", "min", "p25", "p50", "p75", "max"]


def _long_sql(source: str, group: str, metrics) -> str:
    return "long AS (" + " UNION ALL ".join(f"SELECT {group} AS grp, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}" for m in metrics) + ")"


@query("g10_grouped_describe", f"""WITH {B.PREPARED}, {_long_sql('prepared', 'country', K.MEAN_METRICS)}
SELECT coalesce(grp, 'OVERALL') AS "group", grouping(grp) = 1 AS is_total, metric, {_DESCRIBE} FROM long GROUP BY GROUPING SETS ((metric), (metric, grp))""")
def g10(spark, sf):
    return rounded(P.describe_by_group(B.prepared(spark, sf)), *_STATS)


@query("g10_describe_balances", f"""WITH {_long_sql('customer', 'c_mktsegment', ['c_acctbal'])}
SELECT coalesce(grp, 'OVERALL') AS "group", grouping(grp) = 1 AS is_total, metric, {_DESCRIBE} FROM long GROUP BY GROUPING SETS ((metric), (metric, grp))""")
def g10_balances(spark, sf):
    return rounded(P.describe_by_group(B.table(spark, sf, "customer"), ["c_acctbal"], "c_mktsegment"), *_STATS)


@query("g11_group_difference", f"""WITH {B.PREPARED}, {_long_sql('prepared', 'country', K.MEAN_METRICS)}, d AS (SELECT metric,
  avg(value) FILTER (WHERE grp = '1-URGENT') - avg(value) FILTER (WHERE grp = '5-LOW') AS difference FROM long GROUP BY metric)
SELECT metric, round(difference, 6) AS difference, abs(difference) > 0.5 AS substantial FROM d""")
def g11(spark, sf):
    return rounded(P.group_difference(B.prepared(spark, sf), "1-URGENT", "5-LOW", threshold=0.5), "difference")


@query("g12_category_share", """WITH {}, long AS ({}), counted AS (SELECT coalesce(grp, 'OVERALL') AS "group", "column", value, count(*) AS count FROM (
  SELECT 'OVERALL' AS grp, "column", value FROM long UNION ALL SELECT grp, "column", value FROM long) GROUP BY 1, 2, 3),
base AS (SELECT "group", "column", sum(count) AS total FROM counted GROUP BY 1, 2)
SELECT b."group", b."column", value, count, round(count * 100.0 / total, 6) AS percent FROM counted b JOIN base USING ("group", "column") WHERE value IS NOT NULL""".format(
    B.PREPARED, " UNION ALL ".join(f"SELECT country AS grp, '{m}' AS \"column\", {m} AS value FROM prepared" for m in K.IMPACT_METRICS)))
def g12(spark, sf):
    return rounded(P.category_shares(B.prepared(spark, sf)), "percent")


_NULLS = {m: f"count(*) FILTER (WHERE {m} IS NULL)" for m in K.KEY_COLUMNS}


@query("g13_missing_profile", "WITH {} {} UNION ALL SELECT 'TOTAL', {}, NULL FROM prepared".format(
    B.PREPARED,
    " UNION ALL ".join(f"SELECT '{m}' AS \"column\", {e} AS missing, round({e} * 100.0 / count(*), 6) AS percent FROM prepared" for m, e in _NULLS.items()),
    " + ".join(_NULLS.values())))
def g13(spark, sf):
    return rounded(P.missing_profile(B.prepared(spark, sf)), "percent")


@query("g14_date_span", "SELECT min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date, CAST(max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) AS BIGINT) AS days FROM events")
def g14(spark, sf):
    return P.date_span(B.table(spark, sf, "events").select(F.col("ts").cast("date").alias("date")))


_BUCKETS = {"very_dovish": "value < -50", "dovish": "value >= -50 AND value < -10", "neutral": "value BETWEEN -10 AND 10",
            "hawkish": "value > 10 AND value <= 50", "very_hawkish": "value > 50"}
_SCORES = ("hawkish_dovish_score", "uncertainty", "forward_guidance_strength")


@query("g15_score_distribution", f"""WITH {B.PREPARED}, {_long_sql('prepared', 'country', _SCORES)}
SELECT metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
  {', '.join(f"CASE WHEN metric = 'hawkish_dovish_score' THEN count(*) FILTER (WHERE {t}) END AS {b}" for b, t in _BUCKETS.items())} FROM long GROUP BY metric""")
def g15(spark, sf):
    return rounded(P.score_distribution(B.prepared(spark, sf), _SCORES), "mean", "median", "std", "min", "max")


@query("g18_distinct_dates", "SELECT count(DISTINCT CAST(ts AS DATE)) AS unique_dates, count(DISTINCT date_trunc('month', ts)) AS unique_months FROM events")
def g18(spark, sf):
    return P.distinct_dates(B.table(spark, sf, "events").withColumnRenamed("ts", "date"))


def _rollup_sql(profile: str) -> str:
    named = {c: "status IN (" + ", ".join(f"'{s}'" for s in states) + ")" for c, states in K.STATUS_CLASSES[profile].items()}
    other = "NOT (" + " OR ".join(named.values()) + ")"
    counts = ", ".join(f"count(*) FILTER (WHERE {test}) AS {c}" for c, test in {**named, "other": other}.items())
    return f"SELECT '{profile}' AS profile, count(*) AS total, {counts}, round(100.0 * count(*) FILTER (WHERE status = 'completed') / count(*), 6) AS progress FROM latest"


@query("g19_status_rollup", f"WITH {B.LEDGER}, {_LATEST} {_rollup_sql('full')} UNION ALL {_rollup_sql('reduced')}")
def g19(spark, sf):
    latest = L.latest_states(B.ledger(spark, sf).select("chunk_name", "status", *_ORDER), order_by=_ORDER)
    return rounded(L.status_rollups(latest), "progress")


@query("g21_most_active_month", f"""WITH {B.PREPARED}, m AS (SELECT country, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS count FROM prepared GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY count DESC, month) AS n FROM m) SELECT country, month, count FROM r WHERE n = 1""")
def g21(spark, sf):
    return P.most_active_month(B.prepared(spark, sf))


@query("g22_average_per_month", f"""WITH {B.PREPARED} SELECT country, count(*) AS total,
  round(count(*) * 1.0 / (SELECT count(DISTINCT date_trunc('month', date)) FROM prepared), 6) AS avg_per_month FROM prepared GROUP BY country""")
def g22(spark, sf):
    return rounded(P.average_per_month(B.prepared(spark, sf)), "avg_per_month")


_H7 = f"""WITH {B.LEDGER}, {_LATEST}, b AS (SELECT chunk_name, batch_id, max(struct_pack(a := updated_at, b := event_id)) AS place FROM ledger GROUP BY 1, 2),
prev AS (SELECT b.chunk_name, arg_max(b.batch_id, b.place) AS previous_batch_id FROM b JOIN latest l ON l.chunk_name = b.chunk_name AND l.batch_id <> b.batch_id GROUP BY 1)
SELECT l.chunk_name, l.status, l.batch_id, previous_batch_id, previous_batch_id IS NOT NULL AS resubmitted FROM latest l LEFT JOIN prev USING (chunk_name)"""


def h7_sql() -> str:
    return _H7


@query("h7_latest_state", _H7)
def h7(spark, sf):
    states = L.with_previous_batch(B.ledger(spark, sf), order_by=_ORDER)
    return states.select("chunk_name", "status", "batch_id", "previous_batch_id", "resubmitted")


@query("i3_top_busy_days", f"""WITH {B.PREPARED} SELECT date, country, count(*) AS count FROM prepared GROUP BY 1, 2 HAVING count(*) > 1
ORDER BY count DESC, date, country LIMIT 10""")
def i3(spark, sf):
    return P.busiest_days(B.prepared(spark, sf))


_SKETCHED = f"WITH {B.PREPARED} SELECT CAST(year(date) AS INT) AS year, count(*) AS rows, {{}} FROM prepared GROUP BY 1"


@query("g18_distinct_sketch", _SKETCHED.format("count(DISTINCT order_key) AS exact, TRUE AS within"))
def g18_sketch(spark, sf):
    """Distinct orders of a year from the sketches kept for its days, within four standard deviations."""
    path = scratch_path(spark, "sketches")
    rows = B.prepared(spark, sf)
    sketches.daily_sketches(rows, [], ["order_key"], []).write.parquet(path)
    year = F.year("date").cast("int").alias("year")
    found = sketches.estimates(sketches.merged_sketches(spark.read.parquet(path), [year]), ["year"])
    exact = rows.groupBy(year).agg(F.countDistinct("order_key").alias("exact"))
    within = F.abs(F.col("order_key_distinct") - F.col("exact")) <= 4 * sketches.distinct_error() * F.col("exact") + 1
    return found.join(exact, "year").select("year", "rows", "exact", within.alias("within"))


@query("g10_quantile_sketch", _SKETCHED.format("TRUE AS within"))
def g10_sketch(spark, sf):
    """Median score of a year from the sketches kept for its days: its rank is within twice the stated error of one half."""
    path = scratch_path(spark, "sketches")
    rows = B.prepared(spark, sf)
    sketches.daily_sketches(rows, [], [], ["uncertainty"]).write.parquet(path)
    year = F.year("date").cast("int").alias("year")
    found = sketches.estimates(sketches.merged_sketches(spark.read.parquet(path), [year]), ["year"], [0.5])
    ranks = rows.where("uncertainty IS NOT NULL").select(year, "uncertainty").join(found, "year").groupBy("year").agg(
        F.avg((F.col("uncertainty") < F.col("uncertainty_q0")).cast("double")).alias("below"), F.avg((F.col("uncertainty") <= F.col("uncertainty_q0")).cast("double")).alias("upto"))
    slack = 2 * sketches.rank_error() + 0.001
    within = (F.col("below") <= 0.5 + slack) & (F.col("upto") >= 0.5 - slack)
    return found.join(ranks, "year").select("year", "rows", within.alias("within"))
