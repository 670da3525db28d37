"""Validators, cleaning, scoring bounds."""

import json

import pytest

from alertloom.functions.sql import F, columns
from alertloom.operators import score, validate

GOOD = {
    "activity_id": 1, "activity_name": "Create", "category_uid": 2, "category_name": "Findings", "class_uid": 2004,
    "class_name": "Detection Finding", "type_uid": 200401, "finding_info": {"title": "Hello title", "uid": "uid-1234"},
    "metadata": {"product": {"name": "Prod", "vendor_name": "Vend"}, "version": "1.1.0"}, "severity_id": 3, "severity": "Low",
    "time": "2024-01-01T00:00:00Z",
    "evidences": [{"process": {"pid": 1234, "file": {"hashes": [{"algorithm": "MD5", "algorithm_id": 1, "value": "abcdef"}]}}},
                  {"actor": {"user": {"name": "bobby"}}}],
}
ANSWERS = {
    "good": json.dumps(GOOD),
    "bad": json.dumps({**GOOD, "severity_id": 7, "time": 5, "evidences": [{"process": {"pid": "x"}}, 3]}),
    "extra": json.dumps({**GOOD, "foo": 1, "severity": None, "finding_info": {"title": "t", "uid": "u", "zz": []}}),
    "missing": "so: " + json.dumps({k: v for k, v in GOOD.items() if k not in ("time", "metadata")}) + " ok",
    "list": "[1]",
    "broken": "{bad",
}


@pytest.fixture(scope="module")
def responses(spark):
    raw = json.dumps({"a": "Hello title", "b": 1234})
    df = spark.createDataFrame([(k, raw, v) for k, v in ANSWERS.items()], "id string, raw_log string, model_output string")
    return {r.id: r for r in score.normalize(df).collect()}


def test_valid_finding(responses):
    r = responses["good"]
    assert (r.validation_errors, r.error, r.schema_validity) == (None, None, 1.0)
    # Title and pid occur; uid, time, product names and user do not; hashes are too deep to be read.
    assert r.value_consistency == round(2 / 7, 3)


def test_errors_are_counted_and_located(responses):
    assert responses["bad"].validation_errors == [
        "('severity_id',): Input should be one of 8 allowed values",
        "('time',): Input should be a valid string",
        "('evidences', 0, 'process', 'pid'): Input should be a valid integer",
        "('evidences', 1): Input should be a valid dictionary",
    ]
    assert responses["bad"].schema_validity == 0.8
    assert responses["missing"].validation_errors == ["('metadata',): Field required", "('time',): Field required"]


def test_stripped_keys_are_warnings(responses):
    assert responses["extra"].validation_errors == ["foo", "severity", "finding_info.zz"]
    assert responses["extra"].schema_validity == 0.94
    assert "foo" not in json.loads(responses["extra"].ocsf)


def test_unusable_answers_are_rejected(responses):
    for key, error in (("list", "not_object"), ("broken", "JSON extraction failed")):
        r = responses[key]
        assert (r.decision, r.confidence, r.ocsf, r.error) == ("reject", 0.0, None, error)


def test_decision_bounds(spark):
    df = spark.createDataFrame([(0.85,), (0.8499999,), (0.6,), (0.5999999,)], "t double")
    got = [r.d for r in df.select(*columns(d=score.decide(F.col("t")))).collect()]
    assert got == ["accept", "review", "review", "reject"]


def _leaves(v, depth=0):
    """Leaf texts as the definition has them, in the order of the text."""
    if depth > 5:
        return []
    if isinstance(v, (dict, list)):
        return [x for e in (v.values() if isinstance(v, dict) else v) for x in _leaves(e, depth + 1)]
    if isinstance(v, str):
        return [v] if len(v) >= 4 and v not in score.CONSTANT_TEXTS else []
    return [str(v)] if v is not None and not isinstance(v, bool) and not -100 <= v <= 100 and v not in score.CONSTANT_NUMBERS else []


def test_leaves_come_in_the_order_of_the_text(spark):
    docs = [
        {"zz": "last", "aa": 'fi"rst', "a:b": "colon: x", "n": [101, -5, 2004, 1234, True, None, "abc", ""], "c": "Create"},
        {"d": {"d": {"d": {"d": {"d": "deep", "e": {"f": "too deep"}}}}}, "z": [[[["four", ["five!", ["sixth"]]]]]], "k": "é\u2028x\n"},
        {"m": {f"k{99 - i}": f"value {i}" for i in range(70)}, "a": "never"},
        [["list", {"x": "in list"}]], "text only", 5,
    ]
    rows = [(i, json.dumps(d, indent=indent)) for i, d in enumerate(docs) for indent in (None, 1)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", *columns(v=score._source_leaves(F.col("t")))).collect()
    for r in got:
        assert r.v == _leaves(docs[r.i])[:50], docs[r.i]


def test_leaves_as_they_are_written(spark):
    answer = json.dumps({"a": 'say "hi"', "b": "über", "c": "plain"})
    raw = json.dumps({"x": 'he said: say "hi" now', "y": "über plain"}, ensure_ascii=False)
    df = spark.createDataFrame([(raw, answer)], "raw_log string, model_output string")
    got = [score.normalize(df, parity=p, partitions=3).first().value_consistency for p in (True, False)]
    assert got == [0.333, 1.0]


def test_label_check(spark):
    rows = [
        (0, json.dumps(GOOD)),
        (1, json.dumps({**GOOD, "metadata": None, "finding_info": {"title": "", "uid": "u"}, "actor": {"a": [[], {"b": ""}]}})),
        (2, "{bad"),
    ]
    df = spark.createDataFrame(rows, "id int, ocsf string")
    got = {r.id: r.errors for r in validate.check_labels(df).collect()}
    assert got[0] == [] and got[2] == ["not valid JSON"]
    assert set(got[1]) == {
        "Forbidden key at event root: 'actor' — use finding_info.attacks or evidences[] instead",
        "Missing or empty finding_info.title",
        "metadata must be a dict",
        "Null/empty field found: metadata",
        "Null/empty field found: finding_info.title",
        "Null/empty item found: actor.a[0]",
        "Null/empty field found: actor.a[1].b",
    }


def test_empty_values_are_found_at_any_depth(spark):
    deep: object = {"x": None, "y": [1, {}], 'q"z': ""}
    for _ in range(40):
        deep = [{"k": deep}]
    df = spark.createDataFrame([(json.dumps({**GOOD, "more": deep, "text": 'a "," {} [] null'}),)], "ocsf string")
    base = "more" + "[0].k" * 40
    assert validate.check_labels(df).first().errors == [f'Null/empty field found: {base}.q"z', f"Null/empty field found: {base}.x", f"Null/empty item found: {base}.y[1]"]


def _chain(n, bad=None):
    process = None
    for i in range(n, -1, -1):
        above = {} if process is None else {"parent_process": process}
        process = {"name": f"p{i}", "pid": "x" if i == bad else i, "zz": 1, **above}
    return process


def test_processes_are_checked_and_kept_as_far_as_they_go(spark):
    evidences = {
        "good": [{"process": _chain(12)}, {"actor": {"process": _chain(5)}}],
        "bad": [{"process": _chain(12, 9)}, {"actor": {"process": _chain(5, 2)}}],
        "odd": [{"process": 3}, {"process": {"parent_process": {"parent_process": {"parent_process": "x"}}}}, {"process": None}, {"process": {"parent_process": {}}}],
        "text": [{"process": {"name": '"parent_process":', "parent_process": None}}],
    }
    docs = spark.createDataFrame([(k, json.dumps({**GOOD, "evidences": v})) for k, v in evidences.items()], "id string, t string")
    checked = validate.check_model(docs.selectExpr("id", "parse_json(t) AS v"), "v").selectExpr("id", "errors", "to_json(cleaned.evidences) AS kept")
    got = {r.id: r for r in checked.collect()}
    assert got["good"].errors == []
    drop = lambda p: {k: drop(v) if k == "parent_process" else v for k, v in p.items() if k != "zz"}
    assert json.loads(got["good"].kept) == [{"process": drop(_chain(12))}, {"actor": {"process": drop(_chain(5))}}]
    above = ", 'parent_process'"
    assert got["bad"].errors == [f"('evidences', 0, 'process'{above * 9}, 'pid'): Input should be a valid integer", f"('evidences', 1, 'actor', 'process'{above * 2}, 'pid'): Input should be a valid integer"]
    assert got["odd"].errors == ["('evidences', 0, 'process'): Input should be a valid dictionary", f"('evidences', 1, 'process'{above * 3}): Input should be a valid dictionary"]
    assert json.loads(got["text"].kept) == [{"process": {"name": '"parent_process":'}}]
