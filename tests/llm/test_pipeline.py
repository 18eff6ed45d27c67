"""The pipeline's stages on a small table with planted cases."""

from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from tonegauge.llm import queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, tmp_path):
    draw = random.Random(7)
    alphabets = {"en": "abcdefgh", "fr": "ijklmnop"}
    word = lambda n: "".join(draw.choices(alphabets[n], k=draw.randint(2, 6)))
    line = lambda n, k: " ".join(word(n) for _ in range(k))
    rows = [(i, line(n, 80), n) for i, n in enumerate(["en", "fr"] * 40)]
    passage, item = line("en", 60), line("fr", 30)
    rows += [(100, rows[2][1], "en"), (101, rows[3][1], "fr"), (102, "12 34 !", "en"), (103, None, None), (104, line("en", 50) + " " + passage, "en"), (105, line("en", 40) + " " + passage, "en"), (106, line("fr", 30) + " " + item, "fr")]
    frame = spark.createDataFrame([(i, t, n, "s", len(t or "")) for i, t, n in rows], SCHEMA)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = table(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, str(tmp_path))
        result.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "bpe":
            assert docs.dtypes == [(c.split()[0], c.split()[1]) for c in SCHEMA.split(", ")]
    assert set(kept["language_id"]) == {i for i, _, _ in rows} - {102, 103}
    assert set(kept["simhash_near_dedup"]) == set(kept["language_id"]) - {100, 101}
    assert set(kept["suffix_dedup"]) == set(kept["simhash_near_dedup"])
    assert passage in kept["suffix_dedup"][104].text and passage not in kept["suffix_dedup"][105].text
    assert kept["suffix_dedup"][105].n_chars == len(kept["suffix_dedup"][105].text) < len(rows[-2][1])
    assert set(kept["decontamination"]) == set(kept["suffix_dedup"]) - {106}
    assert set(kept["bpe"]) == set(kept["decontamination"]) and all(r.n_tokens == len(r.ids) for r in kept["bpe"].values())


EXTRA = ["_hash", "_doc", "_row", "row", "hits", "w", "k", "ord", "told", "kept", "kept_text", "spans", "tied", "lang_pred", "ids", "n_tokens", "fp"]


def awkward(spark, tmp_path):
    """NULLs in every column, an empty and a very long text, repeated rows, and columns named like the operators' own."""
    rows, _ = table(spark, tmp_path / "plain")
    draw = random.Random(3)
    long = " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 6))) for _ in range(60_000))
    unnamed = " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 6))) for _ in range(70))
    rows = [*rows[:82], (200, long, "en"), (201, "", "fr"), (None, unnamed, None), (None, None, None), rows[5], rows[5]]
    frame = spark.createDataFrame([(i, t, n, None if i is None else "s", None if i is None else len(t or ""), *["x"] * len(EXTRA)) for i, t, n in rows], SCHEMA + "".join(f", {name} string" for name in EXTRA))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[7][1]), (None, None), (2, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows


def test_run_on_awkward_rows(spark, tmp_path):
    rows = awkward(spark, tmp_path)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # gone: copies (100, 101), texts without a letter (201 and the NULL one), the benchmark's passage (7)
    wanted = {i for i, _, _ in rows[:80]} - {7} | {200, None}
    assert len(found) == len(wanted) and {r.doc_id for r in found} == wanted
    assert all(r.n_tokens == len(r.ids) > 0 for r in found) and max(found, key=lambda r: r.n_tokens).doc_id == 200


def test_each_stage_on_awkward_rows(spark, tmp_path):
    """Every stage by itself: its own rows in, with the extra columns; only the columns of documents out."""
    rows = awkward(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    # 80 texts, 200, the one without an id, and 201 for both empty ones
    want = {"simhash_near_dedup": 80 + 3, "suffix_dedup": len(rows), "decontamination": len(rows) - 1, "bpe": len(rows)}
    for name, stage in corpus_pipeline.STAGES[1:]:
        result = stage(spark, docs, str(tmp_path))
        assert result.count() == want[name], name
        if name != "bpe":
            assert result.columns == list(corpus_pipeline.COLUMNS)


@pytest.mark.parametrize("text", ["nothing", None, "12 !"])
def test_run_without_languages(spark, tmp_path, text):
    """An empty table, one of NULL texts, and one in which nothing can be learned: no rows, the same columns."""
    rows = [] if text == "nothing" else [(1, text, None, None, None), (1, text, "en", "s", 4)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and {"doc_id", "n_tokens", "ids"} <= set(found.columns)


def test_every_operator_is_registered():
    assert sorted(int(name.split("_")[0][2:]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


ROOT, DATA = Path(__file__).resolve().parents[2], Path("/root/testdata/sf0.001")


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
queries = entry.queries()
names = [n for k in (1, 2, 3, 5, 7, 8, 11, 12, 13) for n in queries if n.startswith(f"op{{k}}_")]
print("ROWS", [queries[n](spark, {str(DATA)!r}).count() > 0 for n in names])
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert f"ROWS {[True] * 9}" in done.stdout, done.stderr[-2000:]
