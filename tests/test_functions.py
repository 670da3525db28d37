"""Edge values of the scalar rules and text helpers."""

import json

import pytest
from pyspark.sql import functions as SF

from alertloom.functions import build as B
from alertloom.functions import scalars as sc
from alertloom.functions import text as tx
from alertloom.functions import variants as V
from alertloom.functions.sql import F, Sql, columns


def values(spark, expr: Sql, rows, ddl="v string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {ddl}")
    return [r.x for r in df.orderBy("i").select("i", *columns(x=expr)).orderBy("i").collect()]


TIMES = {
    "1704449472": "2024-01-05T10:11:12Z",
    "1704449472000": "2024-01-05T10:11:12Z",
    # Exactly 10^12 still counts as seconds, which is past year 9999.
    "1000000000000": None,
    "1704449472.9": "2024-01-05T10:11:12Z",
    "2024-01-05T10:11:12.123456789Z": "2024-01-05T10:11:12Z",
    "2024-01-05T10:11:12+05:30": "2024-01-05T04:41:12Z",
    "2024-01-05T10:11:12+0530": "2024-01-05T04:41:12Z",
    "2024-01-05T10:11:12": "2024-01-05T10:11:12Z",
    "2024-01-05 10:11:12": "2024-01-05T10:11:12Z",
    "2024-01-05": "2024-01-05T00:00:00Z",
    "01/05/2024 10:11:12": "2024-01-05T10:11:12Z",
    "soon": None,
    "10:11": None,
}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = dict(zip(TIMES, values(spark, sc.iso_time(F.col("v")), list(TIMES))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == TIMES


def test_time_wrappers_are_opened(spark):
    rows = ['{"t":{"$numberLong":"1704449472000"}}', '{"t":{"$date":{"$numberLong":"1704449472000"}}}',
            '{"t":{"$date":"2024-01-05T10:11:12Z"}}', '{"t":{"x":1}}', '{"t":""}', '{"t":null}', "{}"]
    got = values(spark, sc.iso_time(sc.time_text(V.parse(F.col("v")), "t")), rows)
    assert got == ["2024-01-05T10:11:12Z"] * 3 + [None] * 4


def test_severities(spark):
    scores = [(None,), (19,), (20,), (39,), (40,), (59,), (60,), (79,), (80,), (64,), (65,)]
    assert values(spark, sc.crowdstrike_severity(F.col("v")), scores, "v long") == [0, 1, 2, 2, 3, 3, 4, 4, 5, 4, 4]
    assert values(spark, sc.logrhythm_severity(F.col("v")), scores, "v long") == [0, 2, 2, 2, 3, 3, 3, 4, 4, 3, 4]
    assert values(spark, sc.text_severity(F.col("v")), [" HIGH ", "info", None, "x"]) == [4, 1, 0, 0]


def test_truthiness(spark):
    rows = ['{"a":0}', '{"a":false}', '{"a":[]}', '{"a":{}}', '{"a":""}', '{"a":null}', "{}", '{"a":"0"}', '{"a":"false"}',
            '{"a":"[]"}', '{"a":0.0}', '{"a":5}', '{"a":" "}']
    doc = V.parse(F.col("v"))
    assert values(spark, V.truthy(doc, "a"), rows) == [None] * 7 + ["0", "false", "[]", None, "5", " "]
    assert values(spark, V.nonempty(doc, "a"), rows)[:4] == ["0", "false", None, None]


def test_hash_and_observable(spark):
    got = values(spark, sc.hash_record("SHA-256", F.col("v")), ["", "  ", "0000", "00-00", " ab ", None])
    assert [g and g.value for g in got] == [None, None, None, None, "ab", None]
    assert values(spark, sc.hash_record("CRC", F.col("v")), ["ab"])[0].algorithm_id == 0
    obs = sc.observable(F.lit("n"), F.lit("User Name"), F.col("v"))
    assert values(spark, obs["type_id"], ["x"]) == [0]
    assert values(spark, obs, [" "]) == [None]


def test_first_per_key_keeps_order(spark):
    arr = F.split(F.col("v"), ",")
    assert values(spark, B.first_per_key(arr, lambda x: x), ["b,a,b,c,a"]) == [["b", "a", "c"]]


def test_mitre_paths_and_addresses(spark):
    raws = ["T1036.005 - Match Name", "TA0005 - Evasion", " Other ", "t1 - x", ""]
    assert values(spark, sc.mitre_uid(F.col("v")), raws) == ["T1036.005", "TA0005", None, None, None]
    assert values(spark, sc.mitre_name(F.col("v")), raws) == ["Match Name", "Evasion", "Other", "t1 - x", None]
    assert values(spark, sc.looks_like_ip(F.col("v")), ["1.2.3.4", "fe80::1", "a:b.", "host"]) == [True, True, False, False]
    assert values(spark, sc.path_tail(F.col("v")), ["C:\\a\\b.exe", "/x/y", "z"]) == ["b.exe", "y", "z"]
    assert values(spark, sc.first_of_comma_list(F.col("v")), [" a , b", ",b"]) == ["a", None]


ANSWERS = {
    '{"key": "value"}': {"key": "value"},
    'Here: ```json\n{"key": "value"}\n```': {"key": "value"},
    '```{"key": "value"}```': {"key": "value"},
    'before { "key": "value" } after': {"key": "value"},
    '{"key": "value"': None,
    "": None,
    "This is not JSON at all.": None,
    '{"l1": {"l2": {"l3": "value"}}}': {"l1": {"l2": {"l3": "value"}}},
    '{"a":1}} tail': {"a": 1},
    '{"a":1}]': {"a": 1},
    "1],[2": None,
    '{"a":"}"} x': None,
}


def test_extract_json(spark):
    got = values(spark, F.to_json(tx.extract_json(F.col("v"))), list(ANSWERS))
    assert [g and json.loads(g) for g in got] == list(ANSWERS.values())


def test_loose_digest_ignores_spacing(spark):
    a, b, c = values(spark, tx.loose_digest(F.col("v")), ["a  b\n", " a\u00a0b", "ab"])
    assert a == b != c


def test_deep_brace_span(spark):
    deep = "x" + "{" * 3000 + "}" * 3000 + "y"
    df = spark.createDataFrame([(deep,)], "v string")
    assert df.select(SF.length(tx.brace_span(F.col("v")).column()).alias("n")).first().n == 6000


def test_json_is_written_as_python_does(spark):
    docs = [
        {"b": 1, "a": [1, {"x": "é 𝄞 \u2028"}, [], {}, [[]]], "q\"k:\\": 'say "hi"', "e": "", ":": ":"},
        ["\t\n\r\b\f\x01\x1f\x7f/", None, True, False, -1.5, "x:", "a, b: {[", {"ü": {"ä": ["ö"]}}],
        "text", 5, [], {}, [1], {"a": {}},
    ]
    rows = [(i, json.dumps(d, ensure_ascii=False, indent=w)) for i, d in enumerate(docs) for w in (None, 3)]
    forms = {
        "lines": ({"indent": 2}, {"indent": 2, "ensure_ascii": False}), "lines_ascii": ({"indent": 2, "ascii_only": True}, {"indent": 2}),
        "one": ({}, {"ensure_ascii": False}), "one_ascii": ({"ascii_only": True}, {}),
        "compact": ({"compact": True}, {"ensure_ascii": False, "separators": (",", ":")}),
    }
    made = spark.createDataFrame(rows, "i int, t string").select("i", *columns(**{n: tx.dumps(F.col("t"), **a) for n, (a, _) in forms.items()}))
    for r in made.collect():
        for name, (_, b) in forms.items():
            assert r[name] == json.dumps(docs[r.i], **b), name
