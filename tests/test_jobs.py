"""Scans, sinks, the scoring stage, whole jobs, the stream and the driver contract."""

import importlib.util
import json
import subprocess
import sys
import weakref
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tonegauge import schemas
from tonegauge.operators.packing import chunk_statistics
from tonegauge.operators.scoring import envelope_lines, keyword_scorer, score_requests, score_with_function
from tonegauge.operators.requests import build_requests
from tonegauge.plans import jobs
from tonegauge.session import shared_dir
from tonegauge.sources import readers as R
from tonegauge.sources import writers as W
from tonegauge.streaming.ingest import collect_responses

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def speeches(spark):
    texts = ['Inflation, "tighten"\nand more', "ease, stimulus; weak", "plain é\r\nnext\rlast ", "inflation " * 400]
    rows = [(f"speech_{i}", f"2022-01-{i % 28 + 1:02d}", "Ann", "us" if i % 2 else "ea", f"T{i}", texts[i % 4]) for i in range(60)]
    rows += [("speech_60", None, None, "us", "", " lead")]
    frame = spark.createDataFrame(rows, "speech_id string, date string, author string, country string, title string, text string")
    return frame.withColumn("date", F.col("date").cast("date"))


@pytest.fixture(scope="module")
def dated(speeches):
    return speeches.where(F.col("date").isNotNull())


def test_csv_round_trip_of_awkward_text(spark, speeches, tmp_path):
    path = str(tmp_path / "t.csv")
    W.write_table(speeches, path, "csv")
    back = R.read_csv(spark, path, speeches.schema)
    unmarked = speeches.withColumn("title", F.nullif("title", F.lit("")))  # CSV knows no empty string beside a missing one
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, unmarked.collect()))
    with pytest.raises(ValueError, match="Unsupported format: excel"):
        W.write_table(speeches, path, "excel")


def test_preferred_scan(spark, speeches, tmp_path):
    parquet, csv = str(tmp_path / "p"), str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        R.read_preferred(spark, parquet, csv, speeches.schema)
    W.write_table(speeches.limit(1), csv, "csv")
    assert R.read_preferred(spark, parquet, csv, speeches.schema).count() == 1
    W.write_table(speeches, parquet, "parquet")
    assert R.read_preferred(spark, parquet, csv, speeches.schema).count() == 61


def test_cache_is_filled_once(spark, tmp_path):
    source, cache = str(tmp_path / "s"), str(tmp_path / "c")
    spark.range(3).write.parquet(source)
    assert R.read_cached(spark, cache, source).count() == 3
    spark.range(5).write.mode("overwrite").parquet(source)
    assert R.read_cached(spark, cache, source).count() == 3
    assert R.read_cached(spark, cache, source, refresh=True).count() == 5


def test_cache_with_a_schema_and_an_unfinished_write(spark, tmp_path):
    source, cache = str(tmp_path / "s"), tmp_path / "c"
    spark.range(3).write.parquet(source)
    cache.mkdir()
    assert R.read_cached(spark, str(cache), source, "id BIGINT").count() == 3
    again = R.read_cached(spark, str(cache), str(tmp_path / "gone"), "id BIGINT")
    assert again.schema.simpleString() == "struct<id:bigint>" and again.count() == 3


def test_missing_chunk_results(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no chunk results"):
        R.read_chunk_results(spark, str(tmp_path))
    (tmp_path / "chunk07_results.jsonl").write_text("a\nb\n")
    (tmp_path / "chunk12_results.jsonl").write_text("c\n")
    assert sorted(map(tuple, R.read_chunk_results(spark, str(tmp_path)).collect())) == [("a", 7), ("b", 7), ("c", 12)]


def test_chunk_names(one):
    assert [one(W.chunk_file_name(F.lit(n)))[0] for n in (1, 42, 1234)] == ["chunk01_input", "chunk42_input", "chunk1234_input"]


def test_report_keeps_null_fields(spark, tmp_path):
    path = str(tmp_path / "report")
    W.write_report(spark.range(1).select(F.struct(F.lit(1).alias("total")).alias("counts"), F.lit(None).cast("string").alias("note")), path)
    text = "".join(p.read_text() for p in Path(path).glob("part-*"))
    assert json.loads(text) == {"counts": {"total": 1}, "note": None}
    W.write_report(spark.range(3), path)
    assert spark.read.json(path).count() == 3


def test_requests_to_indices(spark, dated, tmp_path):
    """The whole way: chunk files, scoring, parsing, validation, join and index."""
    folder = str(tmp_path / "chunks")
    packed, aside = jobs.request_job(dated.withColumn("text", F.when(F.col("speech_id") != "none", F.col("text"))), folder, ["date", "speech_id"], max_tokens=1500)
    assert aside.count() == 0
    with pytest.raises(ValueError, match="unique"):
        jobs.request_job(dated.union(dated), folder, ["date"])
    stats = chunk_statistics(packed)
    assert stats.agg(F.sum("num_requests")).first()[0] == 60
    assert stats.where("chunk_tokens > 1500 and num_requests > 1").count() == 0
    written = spark.read.schema(schemas.REQUEST + ", chunk_file string").json(folder)
    per_file = {r["chunk_file"]: r["count"] for r in written.groupBy("chunk_file").count().collect()}
    assert per_file == {f"chunk{r['chunk_id']:02d}_input": r["num_requests"] for r in stats.collect()}
    requests = R.read_requests(spark, folder).select("custom_id", F.col("body.messages")[1]["content"].alias("prompt"))

    answers = score_requests(requests, keyword_scorer())
    results = tmp_path / "results"
    envelope_lines(answers).write.text(str(results))
    lines = R.read_lines(spark, str(results))
    broken = spark.createDataFrame([("{cut", "x")], "raw string, file_name string")
    outcome = jobs.response_job(lines.unionByName(broken))
    assert outcome.sentiment.count() == 60 and outcome.quarantined.count() == 1
    assert outcome.validated.where(~F.col("is_valid")).count() == 0

    prepared, aside = jobs.prepare_job(dated, outcome.sentiment)
    assert prepared.count() == 60 and aside.count() == 0
    scores = {r["speech_id"]: r["hawkish_dovish_score"] for r in prepared.collect()}
    assert scores["speech_0"] == 40.0 and scores["speech_1"] == -60.0 and scores["speech_2"] == 0.0 and scores["speech_3"] == 20.0
    index = jobs.index_job(prepared, common_end=True)
    assert index.agg(F.sum("speech_count")).first()[0] == 60
    assert index.groupBy("country").agg(F.max("date").alias("d")).select("d").distinct().count() == 1


def test_written_lines_follow_the_order(spark, dated, tmp_path):
    folder = str(tmp_path / "ordered")
    jobs.request_job(dated, folder, ["speech_id"], max_tokens=100_000)
    (only,) = [p for p in Path(folder).glob("chunk_file=*/*.txt")]
    ids = [json.loads(line)["custom_id"] for line in only.read_text().splitlines()]
    assert ids == sorted(ids) and len(ids) == 60


def test_scorer_sees_prompts_and_keeps_ids(spark, speeches):
    def scorer(prompts):
        return prompts.str.len().map(lambda n: json.dumps({"n": int(n)}))

    built = build_requests(speeches)
    rows = score_with_function(built, scorer).collect()
    lengths = {r["custom_id"]: len(r["prompt"]) for r in built.collect()}
    assert {r["custom_id"]: json.loads(r["response"]["body"]["choices"][0]["message"]["content"])["n"] for r in rows} == lengths


def test_scorer_sees_few_bytes_at_a_time(spark):
    """Prompts of one batch reach the function in slices of bounded bytes; NULLs and their ids stay."""

    def scorer(prompts):
        seen = int(prompts.str.len().sum())
        return prompts.map(lambda p: None if p is None else f"{len(p)} of {seen}")

    size = F.when(F.col("id") == 17, 9_000_000).when(F.col("id") % 10 == 0, 0).otherwise(1_000_000).cast("int")
    built = spark.range(0, 30, 1, 1).select(F.when(F.col("id") != 5, F.col("id").cast("string")).alias("custom_id"), F.when(F.col("id") != 3, F.repeat(F.lit("x"), size)).alias("prompt"))
    rows = {r["custom_id"]: r["response"]["body"]["choices"][0]["message"]["content"] for r in score_with_function(built, scorer).collect()}
    assert set(rows) == {None, *map(str, range(30))} - {"5"} and rows["3"] is None
    seen = {name: tuple(map(int, answer.split(" of "))) for name, answer in rows.items() if answer}
    assert all(own == (9_000_000 if name == "17" else 0 if name in ("0", "10", "20") else 1_000_000) for name, (own, _) in seen.items())
    assert max(total for name, (_, total) in seen.items() if total < 9_000_000) <= 5_000_000 and seen["17"][1] <= 13_000_000


def test_scored_prompts_are_let_go(spark):
    """Batches whose Series pandas keeps in a cycle are gone when the next ones come."""
    seen = []

    def scorer(prompts):
        alive = sum(ref() is not None for ref in seen)
        seen.append(weakref.ref(prompts))
        return prompts.str.len().map(lambda n: str(alive))

    built = spark.range(0, 12, 1, 1).select(F.col("id").cast("string").alias("custom_id"), F.lit("prompt").alias("prompt"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "1")
    try:
        rows = score_with_function(built, scorer).collect()
    finally:
        spark.conf.unset(name)
    assert [r["response"]["body"]["choices"][0]["message"]["content"] for r in rows] == ["0"] * 12


def test_stream_takes_each_file_once(spark, tmp_path):
    inbox, table, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    inbox.mkdir()

    def deliver(name, *ids):
        answer = {"message": {"content": '{"uncertainty": 1}'}}
        lines = [json.dumps({"custom_id": i, "response": {"status_code": 200, "body": {"choices": [answer]}}}) for i in ids]
        (inbox / name).write_text("\n".join([*lines, "{broken"]) + "\n")

    deliver("chunk01_results.jsonl", "a", "b")
    collect_responses(spark, str(inbox), table, checkpoint)
    deliver("chunk02_results.jsonl", "c")
    collect_responses(spark, str(inbox), table, checkpoint)
    collect_responses(spark, str(inbox), table, checkpoint)
    assert sorted(r["speech_id"] for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]
    assert [r["raw"] for r in spark.read.parquet(f"{table}_set_aside").collect()] == ["{broken"] * 2


def test_shared_dir_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or spark.sparkContext.getCheckpointDir())


@pytest.fixture(scope="module")
def contract():
    spec = importlib.util.spec_from_file_location("__spark_entry__", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_contract(spark, contract):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_queries_agree_with_sql(spark, contract):
    spec = importlib.util.spec_from_file_location("check_oracles", ROOT / "check_oracles.py")
    check = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(check)
    connection = check.duck(str(DATA))
    outcomes = {name: check.compare(spark, connection, str(DATA), name) for name in contract.queries()}
    assert {n: o for n, o in outcomes.items() if not o.startswith(("ok", "rows only"))} == {}


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_tasks_do_not_import_the_package(tmp_path):
    """Workers that cannot see the repository still run the Python stages."""
    script = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {str(ROOT / "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", [entry.queries()[n](spark, {str(DATA)!r}).count() for n in ("h6_token_chunks", "k1_user_function")])
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS [200, 200]" in done.stdout, done.stderr[-2000:]


def test_large_chunks_become_several_files_in_order(spark, tmp_path):
    lines = spark.range(4000).selectExpr("id", "CAST(id AS STRING) AS request", "IF(id < 3900, 1, 2) AS chunk_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        W.write_chunks(lines, str(tmp_path / "split"), order=["id"], split=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "split" / "chunk_file=chunk01_input").glob("part-*"))
    assert len(parts) > 1
    assert [int(n) for p in parts for n in p.read_text().split()] == list(range(3900))
    W.write_chunks(lines, str(tmp_path / "whole"), order=["id"])
    assert all(len(list(folder.glob("part-*"))) == 1 for folder in (tmp_path / "whole").glob("chunk_file=*"))
