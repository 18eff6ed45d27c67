import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonegauge import constants as K
from tonegauge.functions import scoring as S
from tonegauge.functions import text as X
from tonegauge.operators import requests as R


def column(spark, values, name="t", kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {kind}")


def collected(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_token_estimate_counts_code_points(spark):
    df = column(spark, ["", "abc", "abcd", "abcdefg", "é😀ab", None])
    assert collected(df, X.token_estimate(F.col("t"))) == [0, 0, 1, 1, 1, None]


def test_escaped_length_matches_json(spark):
    texts = ["", "plain", 'q"\\', "\b\f\n\r\t", "\x00\x07\x0b\x1f\x7f", "é€ü ", "😀 mixed é\n\x7f", 'é"\n😀', "/", "</script>"]
    assert collected(column(spark, texts), X.escaped_length(F.col("t"))) == [len(json.dumps(t)) - 2 for t in texts]
    assert len(json.dumps({"a": 'é"\n😀'})) == 31


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), min_size=20, max_size=40))
def test_escaped_length_of_any_text(spark, texts):
    assert collected(column(spark, texts), X.escaped_length(F.col("t"))) == [len(json.dumps(t)) - 2 for t in texts]


def test_clip_at_the_token_limit(spark):
    kept, cut = "a" * 32003, "é" * 32004
    assert collected(column(spark, [kept, cut]), X.clip_to_limit(F.col("t"))) == [kept, "é" * 32000 + K.TRUNCATION_NOTE]


def test_shorten_never_exceeds_the_length(spark):
    assert collected(column(spark, ["a" * 100, "b" * 101]), X.shorten(F.col("t"))) == ["a" * 100, "b" * 97 + "..."]
    assert collected(column(spark, ["abcdef"]), X.shorten(F.col("t"), 5, "~")) == ["abcd~"]


def test_excerpt_always_ends_in_dots(spark):
    assert collected(column(spark, ["ab", "x" * 600]), X.excerpt(F.col("t"))) == ["ab...", "x" * 500 + "..."]


@pytest.mark.parametrize("content, expected", [
    (f"a\n{K.TEXT_MARKER}\n  body\nmore \n\n{K.TASK_MARKER}\nrest", "body\nmore"),
    (f"a\n{K.TEXT_MARKER} same line\nbody", "body"),
    (f"a\n{K.TEXT_MARKER}\n body without end ", " body without end "),
    (f"{K.TEXT_MARKER}", None),
    ("no marker at all", None),
    (f"{K.TEXT_MARKER}\n x \n{K.TASK_MARKER}", "x"),
])
def test_section_between_markers(one, content, expected):
    rest = X.text_after_marker(F.lit(content))
    assert one(X.until_marker(rest))[0] == expected


def test_terms_are_substrings_unless_words_are_asked_for(one):
    text = F.lit("Increase rates, RELEASE")
    assert one(X.matched_terms(text, K.HAWKISH_TERMS))[0] == ["increase rates"]
    assert one(X.matched_terms(text, K.DOVISH_TERMS))[0] == ["ease"]
    assert one(X.matched_terms(text, K.DOVISH_TERMS, word_boundary=True))[0] == []
    assert one(X.matched_terms(F.lit("they ease."), K.DOVISH_TERMS, word_boundary=True))[0] == ["ease"]


@pytest.mark.parametrize("score, up, down, verdict", [
    (85, 3, 2, "REASONABLE"), (80, 3, 4, "QUESTIONABLE"), (50, 3, 1, "REASONABLE"), (75, 5, 3, "REASONABLE"),
    (0, 3, 1, "REASONABLE"), (0, 4, 1, "QUESTIONABLE"), (-30, 1, 2, "REASONABLE"), (-30, 2, 2, "QUESTIONABLE"),
    (20, 0, 0, "REASONABLE"), (20.5, 1, 1, "QUESTIONABLE"),
])
def test_verdicts(one, score, up, down, verdict):
    assert one(X.score_verdict(F.lit(score), F.lit(up), F.lit(down)))[0].startswith(verdict)


def test_stance_boundaries(spark):
    df = column(spark, [-50.1, -50.0, -10.0, 10.0, 10.1, 50.0, 50.1, None], kind="double")
    assert collected(df, S.stance(F.col("t"))) == [
        "very_dovish", "dovish", "neutral", "neutral", "hawkish", "hawkish", "very_hawkish", None
    ]


def test_polarity_ties(spark):
    df = column(spark, [-1.0, 0.0, 1.0, None], kind="double")
    assert collected(df, S.polarity(F.col("t"), F.lit(0))) == ["negative", "negative", "positive", None]
    assert collected(df, S.polarity(F.col("t"), F.lit(0), "positive")) == ["negative", "positive", "positive", None]
    with pytest.raises(ValueError):
        S.polarity(F.col("t"), F.lit(0), "up")


def test_quality_tiers(spark):
    df = column(spark, [95.0, 94.9, 85.0, 84.9], kind="double")
    assert collected(df, S.quality_tier(F.col("t"))) == ["excellent", "good", "good", "low"]


def test_numbers_in_names(spark):
    df = column(spark, ["speech_88", "speech_x", None])
    assert collected(df, S.number_in(F.col("t"), "speech_")) == [88, None, None]
    with pytest.raises(Exception, match="no number after"):
        collected(df, S.number_in(F.col("t"), "speech_", strict=True))
    names = column(spark, ["chunk07_input.jsonl"])
    assert collected(names, S.number_in(F.col("t"), "chunk", "_input")) == [7]
    assert collected(names, S.result_name(F.col("t"))) == ["chunk07_results.jsonl"]


def test_costs(one):
    thousand = S.cost_per_thousand(F.lit(1000), F.lit(500), K.REALTIME_PER_1K)
    assert one(thousand)[0] == pytest.approx(0.0075)
    assert one(S.cost_per_million(F.lit(1_000_000), F.lit(1_000_000)))[0] == pytest.approx(6.25)


def test_cost_labels(spark):
    df = column(spark, [0.005, 0.5, 1.0, 12.345], kind="double")
    assert collected(df, S.cost_label(F.col("t")))[:3] == ["$0.5000¢", "$0.5000", "$1.00"]
    assert collected(df, S.cost_label(F.col("t"), "c"))[0] == "$0.5000c"


@pytest.fixture(scope="module")
def speeches(spark):
    rows = [
        ("speech_1", "A \"quote\"\n", "Ann", "United States", "2022-01-03"),
        ("speech_2", "é" * 40000, None, "Euro area", "2022-01-04"),
        ("speech_3", None, "Bob", "Euro area", "2022-01-05"),
    ]
    return spark.createDataFrame(rows, "speech_id string, text string, author string, country string, date string")


@pytest.mark.parametrize("profile", ["full", "reduced"])
def test_requests_and_their_serialized_tokens(speeches, profile):
    built = R.build_requests(speeches, profile=profile, max_text_tokens=K.MAX_TEXT_TOKENS if profile == "full" else None).collect()
    assert [r["custom_id"] for r in built] == ["speech_1", "speech_2"]
    for row in built:
        request = row["request"].asDict(recursive=True)
        assert list(request) == list(K.REQUEST_FIELDS)
        assert request["body"]["temperature"] == K.TEMPERATURE[profile]
        assert row["tokens"] == len(json.dumps(request)) // 4
        assert row["prompt_tokens"] == len(row["prompt"]) // 4
    long = built[1]
    assert "- Speaker" not in long["prompt"] and "Speaker: Unknown" in long["prompt"]
    assert (K.TRUNCATION_NOTE in long["prompt"]) == (profile == "full")
    assert [r["speech_id"] for r in R.without_text(speeches).collect()] == ["speech_3"]


def test_own_template(speeches):
    built = R.build_requests(speeches, template="{{json}} {text} by {speaker}").first()
    assert built["prompt"] == '{json} A "quote"\n by Ann'
    assert built["tokens"] == len(json.dumps(built["request"].asDict(recursive=True))) // 4


def test_request_statistics(spark, speeches):
    stats = R.request_statistics(R.build_requests(speeches)).first()
    assert stats["num_requests"] == 2 and stats["estimated_output_tokens"] == 1000
    assert stats["savings"] == pytest.approx(stats["realtime_cost_estimate"] - stats["batch_cost_estimate"])
    known = spark.createDataFrame([(1265616,)] + [(0,)] * 310, "prompt_tokens bigint")
    row = R.request_statistics(known).first()
    assert (row["batch_cost_estimate"], row["realtime_cost_estimate"]) == (pytest.approx(2.35952), pytest.approx(4.71904))
    assert R.request_statistics(known.limit(0)).first()["total_input_tokens"] == 0


def test_request_file_errors(spark):
    lines = ["{}", "{not json", '{"custom_id":1,"method":2,"url":3,"body":null}', '{"custom_id":1,"method":2,"body":{}}', "[1]"]
    found = {r["raw"]: r["error"] for r in R.request_file_errors(column(spark, lines, "raw")).collect()}
    assert found == {
        "{}": "Missing required field 'custom_id'", "{not json": "Invalid JSON",
        '{"custom_id":1,"method":2,"body":{}}': "Missing required field 'url'", "[1]": "Missing required field 'custom_id'",
    }
