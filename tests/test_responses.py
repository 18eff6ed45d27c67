import json

import pytest
from pyspark.sql import functions as F

from tonegauge.operators import parse as P
from tonegauge.operators import validate as V


def content(**changes):
    record = {
        "hawkish_dovish_score": 45,
        "topics": {"inflation": 80, "growth": 30, "financial_stability": 20, "labor_market": 40, "international": 10},
        "uncertainty": 35, "forward_guidance_strength": 60, "key_sentences": ["One", "Two"],
        "market_impact": {"stocks": "fall", "bonds": "rise", "currency": "rise", "reasoning": "Because"},
        "summary": "A summary",
    }
    for path, value in changes.items():
        *parents, last = path.split("__")
        target = record
        for parent in parents:
            target = target[parent]
        if value is ...:
            del target[last]
        else:
            target[last] = value
    return record


def envelope(custom_id, answer, status=200):
    text = answer if isinstance(answer, str) else json.dumps(answer)
    return json.dumps({"custom_id": custom_id, "response": {"status_code": status, "body": {"choices": [{"message": {"content": text}}]}}})


def lines(spark, *raw):
    return spark.createDataFrame([(r,) for r in raw], "raw string")


def errors(spark, record, profile="full", **options):
    parsed = P.usable(P.classify_responses(lines(spark, envelope("s", record))))
    return V.validate(parsed, profile, **options).first()["errors"]


RULE_CASES = [
    ({}, [], []),
    ({"hawkish_dovish_score": -100}, [], []),
    ({"hawkish_dovish_score": 150}, ["hawkish_dovish_score out of range [-100, 100]: 150"], ...),
    ({"hawkish_dovish_score": 100.5}, ["hawkish_dovish_score out of range [-100, 100]: 100.5"], ...),
    ({"hawkish_dovish_score": 101.0}, ["hawkish_dovish_score out of range [-100, 100]: 101.0"], ...),
    ({"hawkish_dovish_score": "45"}, ["hawkish_dovish_score must be numeric, got: <class 'str'>"], ...),
    ({"hawkish_dovish_score": None}, ["hawkish_dovish_score must be numeric, got: <class 'NoneType'>"], ...),
    ({"hawkish_dovish_score": True}, [], []),
    ({"topics": [1]}, ["topics must be a dictionary, got: <class 'list'>"], ...),
    ({"topics__growth": ...}, ["Missing topic field: growth"], ...),
    ({"topics__growth": {}}, ["Topic 'growth' must be numeric, got: <class 'dict'>"], ["Topic 'growth' must be numeric"]),
    ({"topics__growth": -1}, ["Topic 'growth' out of range [0, 100]: -1"], ...),
    ({"uncertainty": "x"}, ["uncertainty must be numeric, got: <class 'str'>"], ["uncertainty must be numeric"]),
    ({"key_sentences": []}, ["key_sentences is empty"], []),
    ({"key_sentences": "x"}, ["key_sentences must be a list, got: <class 'str'>"], []),
    ({"summary": "  \n"}, ["summary is empty"], []),
    ({"summary": 3}, ["summary must be a string, got: <class 'int'>"], []),
    ({"market_impact": 1.5}, ["market_impact must be a dictionary, got: <class 'float'>"], ["market_impact must be a dictionary"]),
    ({"market_impact__bonds": ...}, ["Missing market_impact field: bonds"], []),
    ({"market_impact__reasoning": ...}, ["Missing market_impact field: reasoning"], []),
    ({"market_impact__currency": "strengthen"}, ["market_impact.currency must be one of ['rise', 'fall', 'neutral'], got: strengthen"], ...),
    ({"market_impact__currency": "Rise"}, ["market_impact.currency must be one of ['rise', 'fall', 'neutral'], got: Rise"], ...),
    ({"market_impact__currency": None}, ["market_impact.currency must be one of ['rise', 'fall', 'neutral'], got: None"], ...),
    ({"market_impact__currency": False}, ["market_impact.currency must be one of ['rise', 'fall', 'neutral'], got: False"], ...),
    ({"key_sentences": [], "summary": " "}, ["key_sentences is empty", "summary is empty"], []),
]


@pytest.mark.parametrize("profile", ["full", "reduced"])
def test_rules(spark, profile):
    raw = lines(spark, *[envelope(str(i), content(**changes)) for i, (changes, _, _) in enumerate(RULE_CASES)])
    validated = V.validate(P.usable(P.classify_responses(raw)), profile)
    found = {int(r["custom_id"]): r["errors"] for r in validated.collect()}
    for i, (changes, full, reduced) in enumerate(RULE_CASES):
        expected = full if profile == "full" or reduced is ... else reduced
        assert found[i] == expected, changes


def test_missing_fields_hide_other_errors(spark):
    record = {"hawkish_dovish_score": 150, "topics": {"inflation": 80}, "uncertainty": 35}
    expected = [f"Missing required field: {f}" for f in ("forward_guidance_strength", "key_sentences", "market_impact", "summary")]
    assert errors(spark, record) == expected


def test_null_scores_pass_on_request(spark):
    record = content(hawkish_dovish_score=None, topics__growth=None)
    assert errors(spark, record, null_is_number=True) == []
    assert len(errors(spark, record)) == 2


@pytest.fixture(scope="module")
def mixed(spark):
    return lines(
        spark, envelope("good", content()), envelope("failed", content(), 500), envelope("text", "no json"),
        envelope("list", [1]), envelope("null_topics", content(topics=None)), envelope("no_uncertainty", content(uncertainty=...)),
        envelope("good", content())[:40], "", envelope("top", {**content(market_impact__reasoning=...), "reasoning": "At the top"}),
        envelope("wrong", content(hawkish_dovish_score="45", key_sentences=None)),
    )


def test_lenient_parse_keeps_what_it_can(mixed):
    flat = {r["speech_id"]: r for r in P.parse_responses(mixed).collect()}
    assert set(flat) == {"good", "null_topics", "no_uncertainty", "top", "wrong"}
    assert flat["good"]["key_sentences"] == "One|Two" and flat["good"]["key_sentence_list"] == ["One", "Two"]
    assert flat["good"]["topic_inflation"] == 80.0
    assert flat["null_topics"]["topic_growth"] is None
    assert flat["no_uncertainty"]["uncertainty"] is None
    assert flat["top"]["market_impact_reasoning"] == "At the top"
    assert flat["wrong"]["hawkish_dovish_score"] is None and flat["wrong"]["key_sentences"] == ""


def test_strict_parse_wants_every_field(mixed):
    assert {r["speech_id"] for r in P.parse_responses(mixed, profile="reduced").collect()} == {"good", "top", "wrong"}


def test_quarantine_keeps_line_and_reason(mixed):
    aside = P.quarantine(P.classify_responses(mixed)).collect()
    assert sorted((r["custom_id"] or "", r["reason"]) for r in aside) == sorted([
        ("failed", "request failed: 500"), ("text", "content is not a JSON object"), ("list", "content is not a JSON object"),
        ("", "malformed envelope"), ("", "malformed envelope"),
    ])
    assert all(r["raw"] is not None for r in aside)
    total = mixed.count()
    assert P.usable(P.classify_responses(mixed)).count() + len(aside) == total


def test_filters_do_not_copy_the_parsing(mixed):
    plan = P.parse_responses(mixed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2  # the envelope and its content


def test_flat_rows_meet_the_same_rules(mixed):
    flat = P.parse_responses(mixed)
    found = {r["speech_id"]: r["errors"] for r in V.validate_flat(flat).collect()}
    assert found["good"] == []
    assert found["no_uncertainty"] == ["uncertainty must be numeric, got: <class 'NoneType'>"]
    assert len(found["null_topics"]) == 5
    assert found["wrong"] == ["hawkish_dovish_score must be numeric, got: <class 'NoneType'>"]  # an empty string is one sentence
    lenient = {r["speech_id"]: r["errors"] for r in V.validate_flat(flat, null_is_number=True).collect()}
    assert lenient["null_topics"] == [] and lenient["wrong"] == []


def test_flat_rows_out_of_range(mixed):
    flat = P.parse_responses(mixed).where("speech_id = 'good'")
    off = flat.withColumns({
        "hawkish_dovish_score": F.lit(150.0), "topic_growth": F.lit(-1.0), "key_sentences": F.lit(None).cast("string"),
        "market_impact_bonds": F.lit(None).cast("string"), "market_impact_stocks": F.lit("up"), "summary": F.lit(" "),
    })
    assert V.validate_flat(off).first()["errors"] == [
        "hawkish_dovish_score out of range [-100, 100]: 150.0", "Topic 'growth' out of range [0, 100]: -1.0", "key_sentences is empty",
        "market_impact.stocks must be one of ['rise', 'fall', 'neutral'], got: up",
        "market_impact.bonds must be one of ['rise', 'fall', 'neutral'], got: None", "summary is empty",
    ]
    assert len(V.validate_flat(off, "reduced").first()["errors"]) == 4


def test_sentences_split_on_every_pipe(one):
    assert one(P.split_sentences(F.lit("a|b c|")))[0] == ["a", "b c", ""]


@pytest.fixture(scope="module")
def validated(spark):
    raw = [envelope(f"s{i}", content(hawkish_dovish_score=0 if i % 2 else 150 + i, summary=" " if i % 4 == 0 else "x")) for i in range(20)]
    raw.append(envelope("s0", content(uncertainty=-1)))
    numbered = spark.createDataFrame(list(enumerate(raw)), "line int, raw string")
    return V.validate(P.usable(P.classify_responses(numbered)))


def test_batch_summary(validated):
    row = V.batch_summary(validated).first()
    assert (row["total"], row["valid"], row["invalid"]) == (21, 10, 11)
    assert row["validation_rate"] == pytest.approx(10 / 21 * 100) and row["tier"] == "low"
    empty = V.batch_summary(validated.limit(0)).first()
    assert (empty["total"], empty["validation_rate"]) == (0, 0.0)


def test_error_histogram(validated):
    rows = [(r[0], r[1]) for r in V.error_histogram(validated).collect()]
    assert rows == [("hawkish_dovish_score out of range [-100, 100]", 10), ("summary is empty", 5), ("uncertainty out of range [0, 100]", 1)]


def test_invalid_sample_shows_last_errors_of_a_repeated_id(validated):
    rows = V.invalid_sample(validated, ["line"], errors=1).collect()
    assert [r["custom_id"] for r in rows] == ["s0", "s2", "s4", "s6", "s8"]
    assert rows[0]["errors"] == ["uncertainty out of range [0, 100]: -1"]
    assert all(len(r["errors"]) == 1 for r in rows)
