"""JSON array files read in ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from alertloom.plans import labelling
from alertloom.sources import arrays, files


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return rng.choice(['say "hi"', "}{][", "back\\slash", '\\"', "ends with \\", "", "é 𝄞 \n,", "},\n{"])
    if kind < 3:
        return rng.choice([1, -2.5, None, True])
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(['a"', "b}", "c", "d\\"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def read(spark, path):
    return sorted(((r.pos, r.raw_log, r.bad_json) for r in files.read_json_array(spark, str(path)).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("indent", [None, 2])
def test_any_array_in_any_ranges(spark, tmp_path, small_ranges, indent):
    rng = random.Random(4)
    made = [{"n": i, "v": value(rng)} for i in range(120)]
    (tmp_path / "a.json").write_text("\n " + json.dumps(made, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "b.json").write_text(json.dumps(made[:7], indent=indent))
    for size in (64, 1 << 20):
        small_ranges(size)
        assert [json.loads(t) for _, t, _ in read(spark, tmp_path / "a.json")] == made
    assert [p for p, _, _ in read(spark, tmp_path / "a.json")] == list(range(120))
    assert files.read_json_array(spark, str(tmp_path)).count() == 127


@pytest.mark.parametrize("broken", ["{bad}", '{"a": [1, 2}', '{"a": "open}', '{"a": {"b": 1}', "{'a': 1}", '{"a": 1}}'])
@pytest.mark.parametrize("sign", [",\n", ",\n  "])
def test_one_broken_element_is_one_bad_row(spark, tmp_path, small_ranges, broken, sign):
    small_ranges(100)
    texts = [json.dumps({"n": i, "t": '"x}'}) for i in range(40)]
    (tmp_path / "a.json").write_text("[" + sign[1:] + sign.join([*texts[:20], broken, *texts[20:]]) + "\n]\n")
    got = read(spark, tmp_path / "a.json")
    assert [json.loads(t)["n"] for _, t, bad in got if not bad] == list(range(40))
    assert sum(bad for _, _, bad in got) == 1


def test_other_files(spark, tmp_path):
    cases = {"[]": [], " [ ]\n": [], "": [], '{"a":1}': [True], "no": [True], "[1, 2]": [False, False], '[{"a":1}, 5, {"b":2}]': [False, False, False], '[{"a":1}, [2], "x"]': [False, False, True], "[{]": [True]}
    for text, want in cases.items():
        (tmp_path / "a.json").write_text(text)
        assert [bad for _, _, bad in read(spark, tmp_path / "a.json")] == want, text


def test_files_are_read_once_and_lines_of_broken_ones_twice(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("[" + ",\n".join(json.dumps({"n": i}) for i in range(30)) + "]")
    (tmp_path / "in" / "b.json").write_text("[\n" + ",\n".join(['{"open": [1', *(json.dumps({"n": i}) for i in range(9))]) + "\n]")
    made = arrays._pieces
    seen = {"}": spark.sparkContext.accumulator(0), None: spark.sparkContext.accumulator(0)}

    def counted(spark, path, separator):
        count = seen[separator]

        @F.udf("long")
        def same(at):
            count.add(1)
            return at

        df = made(spark, path, separator)
        # The place of a piece, the text of a line.
        return df.withColumn("at", same("at")) if separator else df.withColumn("value", F.when(same(F.length("value")) >= 0, F.col("value")))

    monkeypatch.setattr(arrays, "_pieces", counted)
    got = arrays.elements(spark, str(tmp_path / "in"), str(tmp_path / "scanned")).collect()
    assert len(got) == 40
    assert seen["}"].value == 31 + 10
    assert seen[None].value <= 2 * (30 + 12)


def test_query_lists_one_folder_of_files_of_a_thousand_elements(spark, tmp_path, monkeypatch):
    rows = spark.range(2600).selectExpr("id AS event_id", "timestamp'2024-01-01 00:00:00' AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\": 1}' AS props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    root = tmp_path / "arrays"
    monkeypatch.setattr(labelling, "scratch", lambda spark, prefix: str(tmp_path / prefix))
    got = labelling.QUERIES["read_json_arrays"](spark, str(tmp_path)).collect()
    bad = {i for i in range(2600) if i % 777 == 5 or i % 3000 == 1500}
    assert sorted(r.id for r in got if not r.bad_json) == sorted(set(range(2600)) - bad)
    assert sum(r.bad_json for r in got) == len(bad)
    assert not any(r.with_id for r in got)
    assert not [p for p in root.iterdir() if p.is_dir()]
    assert sorted(p.read_text().count("\n") - 2 for p in root.glob("part-*")) == [600, 1000, 1000]
