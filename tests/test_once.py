"""Costly work is done once a row, and only where it is needed; every test makes its own rows."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as SF

from alertloom import schemas as S
from alertloom.functions import text as tx
from alertloom.functions import variants as V
from alertloom.functions.sql import F, columns
from alertloom.operators import label, training, validate
from alertloom.sources import files


def _counted(spark):
    """A function that counts the rows it is called for, and the count."""
    seen = spark.sparkContext.accumulator(0)

    @SF.udf("string")
    def same(value):
        seen.add(1)
        return value

    return same, seen


def test_rows_with_ordinals_are_computed_once(spark, tmp_path):
    same, seen = _counted(spark)
    df = spark.range(200).select("id", same(SF.col("id").cast("string")).alias("text"))
    got = label.with_ordinal(df, "id", f"{tmp_path}/pairs").orderBy("id").collect()
    assert [r.ordinal for r in got] == list(range(1, 201))
    assert seen.value == 200


def test_preview_makes_one_example(spark):
    same, seen = _counted(spark)
    messages = SF.array(SF.struct(SF.lit("user").alias("role"), same(SF.concat(SF.lit("x"), "id")).alias("content")))
    got = training.preview(spark.range(5, 300).select("id", messages.alias("messages")), "id", width=2).collect()
    assert [r.messages[0].content for r in got] == ["x5"]
    assert seen.value < 10


def test_preview_of_rows_without_place_and_of_none(spark):
    rows = spark.createDataFrame([(3, "c"), (None, "n")], "id long, t string")
    chats = rows.select("id", SF.array(SF.struct(SF.lit("user").alias("role"), SF.col("t").alias("content"))).alias("messages"))
    assert [r.messages[0].content for r in training.preview(chats, "id").collect()] == ["n"]
    assert training.preview(chats.limit(0), "id").collect() == []


def test_each_part_of_an_answer_is_parsed_once():
    assert tx.extract_json(F.col("v")).text.count("try_parse_json(") == 3


def test_source_is_the_part_that_is_parsed(spark):
    answers = ['{"a":1}', 'x ```json\n{"a":2}\n``` y', 'so {"a":3} }', '{"a":', "", None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, v string")
    found = rows.select("i", *columns(text=tx.source_json(F.col("v")), doc=F.to_json(tx.extract_json(F.col("v"))))).orderBy("i").collect()
    assert [r.doc for r in found] == ['{"a":1}', '{"a":2}', '{"a":3}', None, None, None]
    assert [r.text for r in found] == ['{"a":1}', '{"a":2}', '{"a":3}', None, None, None]


def test_chains_in_lists_are_checked_once():
    lists = validate._Apart()
    value, errors = validate._object(S.FINDING_FIELDS, V.Doc("`v`", "_m"), [], lists)
    assert "aggregate(sequence(1" not in value.text + "".join(e.text for e in errors)
    evidence = next(c.text for c in lists.named.values() if "aggregate(sequence(1" in c.text)
    # A chain as evidence, and one of its actor.
    assert evidence.count("aggregate(sequence(1") == 2


def test_one_line_forms_need_no_fold_and_are_pythons(spark):
    odd = {"k\n\"é": ["a:", "b,", "{", 'q"', "\\", "\u0001", "😀", "", {}, [], {"n": None}, True, 1.5], "z": {"y": [[]]}, "": ":"}
    rows = spark.createDataFrame([(json.dumps(odd),), (json.dumps(odd, ensure_ascii=False, separators=(",", ":")),)], "v string")
    ways = {
        "compact": (dict(compact=True), dict(ensure_ascii=False, separators=(",", ":"))),
        "ascii": (dict(ascii_only=True), {}),
        "wide": ({}, dict(ensure_ascii=False)),
        "lines": (dict(indent=2), dict(ensure_ascii=False, indent=2)),
    }
    forms = {n: tx.dumps(F.col("v"), **own) for n, (own, _) in ways.items()}
    assert all("aggregate(" not in forms[n].text for n in ("compact", "ascii", "wide"))
    for r in rows.select(*columns(**forms)).collect():
        for n, (_, python) in ways.items():
            assert r[n] == json.dumps(odd, **python), n


def _empties(v, path=""):
    kind = "item" if path.endswith("]") else "field"
    inner = [(f"{path}.{k}" if path else k, e) for k, e in v.items()] if isinstance(v, dict) else [(f"{path}[{i}]", e) for i, e in enumerate(v)] if isinstance(v, list) else []
    own = [f"Null/empty {kind} found: {path}"] if path and (v is None or v in ("", [], {})) and v is not False else []
    return own + [m for p, e in inner for m in _empties(e, p)]


def test_empty_values_beside_values_that_look_like_them(spark):
    docs = [{"a": [1, "x:", ",null,", {"b": "", "c": [[], [None, "nullable", "[]"]]}], "d": {"e:": {}, "f": [True, {}]}}, {"a": "[null]", "b": [1]}, [None, [""], {"k": None}], {}, []]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string")
    got = rows.select("i", *columns(found=validate.empty_fields(F.parse_json(F.col("t"))))).orderBy("i").collect()
    assert [r.found for r in got] == [_empties(d) for d in docs]


def test_chats_may_be_written_compressed(spark, tmp_path):
    chats = spark.range(3).select(SF.array(SF.struct(SF.lit("user").alias("role"), SF.col("id").cast("string").alias("content"))).alias("messages"))
    files.write_chat(chats, f"{tmp_path}/c", compression="gzip")
    files.write_chat(chats, f"{tmp_path}/p")
    names = lambda at: {n.rsplit(".", 1)[-1] for n in os.listdir(at) if n.startswith("part-")}
    assert names(f"{tmp_path}/c") == {"gz"} and names(f"{tmp_path}/p") == {"json"}
    assert files.read_chat(spark, f"{tmp_path}/c").count() == 3
