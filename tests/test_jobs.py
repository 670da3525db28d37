"""Queues, corrections, training data, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from alertloom.operators import label, metrics, route, state, training
from alertloom.sources import files
from alertloom.streaming import jobs, store

AT = "timestamp'2024-01-31 00:00:00'"


def responses(spark):
    rows = [
        ("a", "s", '{"class_uid":2004}', 0.92, "accept", 150, None),
        ("b", "s", '{"class_uid":2004}', 0.72, "review", 150, None),
        ("c", "s", None, 0.2, "reject", 150, None),
        ("d", "s", '{"class_uid":2004}', 0.5, "odd", 150, None),
    ]
    df = spark.createDataFrame(rows, "id string, source string, ocsf string, confidence double, decision string, latency_ms int, error string")
    return df.withColumns({"breakdown": F.lit("{}"), "validation_errors": F.lit("[]")})


def test_routing(spark):
    df, at = responses(spark), F.expr(AT)
    assert {r.raw_log_id for r in route.finding_rows(df, at).collect()} == {"a", "b", "d"}
    assert {r.raw_log_id: r.priority for r in route.review_rows(df, at).collect()} == {"b": "NORMAL", "c": "HIGH", "d": "HIGH"}
    status = {r.id: (r.status, r.error_message) for r in route.status_rows(df, at).collect()}
    assert status["a"] == ("PROCESSED", None) and status["c"] == ("FAILED", route.DEFAULT_ERROR)
    assert [r.raw_log_id for r in route.outbox_rows(df).collect()] == ["a"]
    assert {r.raw_log_id: (r.decision, r.success) for r in route.metric_rows(df, at).collect()}["d"] == ("REJECT", False)


def spoil(folder):
    """Spoils the rows, not the schema, of the files of a folder: a job that reads one fails."""
    made = list(folder.glob("*.parquet"))
    assert made
    for file in made:
        with open(file, "r+b") as data:
            data.seek(4)
            data.write(b"x" * 60)


def test_stream_gives_the_batch_rows_and_repeats_are_harmless(spark, tmp_path):
    df = responses(spark)
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    jobs.run_routing(source, f"{tmp_path}/out", f"{tmp_path}/ck", F.expr(AT), available_now=True).awaitTermination()
    jobs.route_batch(f"{tmp_path}/out", F.expr(AT))(df, 0)
    want = sorted(map(str, route.review_rows(df, F.expr(AT), "stream 0").collect()))
    got = jobs.read(spark, f"{tmp_path}/out", "manual_review").drop("batch_id", "producer")
    assert sorted(map(str, got.collect())) == want
    assert jobs.read(spark, f"{tmp_path}/out", "outbox").count() == 1


def test_a_retry_run_keeps_the_streams_messages(spark, tmp_path):
    root, at = str(tmp_path), F.expr(AT)
    failing = jobs.route_batch(root, at, send=lambda rows: 1 / 0)
    failing(responses(spark), 0)
    assert not any(r.published for r in jobs.findings(spark, root).collect())
    jobs.retry_outbox(spark, root, 0)
    jobs.route_batch(root, at)(responses(spark).withColumn("id", F.concat(F.lit("x"), "id")), 1)
    assert {r.raw_log_id for r in jobs.read(spark, root, "outbox").collect()} == {"a", "xa"}
    assert {r.raw_log_id for r in jobs.findings(spark, root).collect() if r.published} == {"a", "xa"}
    jobs.retry_outbox(spark, root, 1)
    assert jobs.read(spark, root, "outbox").count() == 2
    # A later run reads what is new or left, nothing older; what cannot be sent is left, and so is what is over the limit.
    for n in range(2, 6):
        failing(responses(spark).withColumn("id", F.concat(F.lit(f"y{n}"), "id")), n)
    jobs.retry_outbox(spark, root, 2, send=lambda rows: 1 / 0)
    failing(responses(spark).withColumn("id", F.concat(F.lit("z"), "id")), 6)
    for n in range(6):
        spoil(tmp_path / f"queue/producer=stream/batch_id={n}")
    due, _ = jobs.waiting(spark, root, 3)
    assert {r.raw_log_id for r in due.collect()} == {"y2a", "y3a", "y4a", "y5a", "za"}
    sent = []
    jobs.retry_outbox(spark, root, 3, limit=2, send=lambda rows: sent.extend(r.raw_log_id for r in rows.collect()))
    jobs.retry_outbox(spark, root, 3, limit=2, send=lambda rows: 1 / 0)
    jobs.retry_outbox(spark, root, 4, send=lambda rows: sent.extend(r.raw_log_id for r in rows.collect()))
    assert sorted(sent) == ["y2a", "y3a", "y4a", "y5a", "za"]
    assert jobs.waiting(spark, root, 5)[0].count() == 0
    assert sum(r.published for r in jobs.findings(spark, root).collect()) == 7


def test_corrected_findings_are_queued(spark, tmp_path):
    root, at = str(tmp_path), F.expr(AT)
    jobs.route_batch(root, at)(responses(spark), 0)
    corrected = jobs.findings(spark, root).filter("raw_log_id = 'b'").withColumns({"decision": F.lit("CORRECTED"), "ocsf_json": F.lit("{}")})
    jobs.enqueue(corrected, root, "correction", 0)
    jobs.retry_outbox(spark, root, 0)
    assert {r.raw_log_id for r in jobs.findings(spark, root).collect() if r.published} == {"a", "b"}


def test_uncommitted_batches_are_not_seen(spark, tmp_path):
    jobs.route_batch(str(tmp_path), F.expr(AT))(responses(spark), 0)
    store.put(route.finding_rows(responses(spark), F.expr(AT)), str(tmp_path), "finding_event", "stream", 1)
    assert {r.batch_id for r in jobs.read(spark, str(tmp_path), "finding_event").collect()} == {0}


RESPONSE = "id string, source string, ocsf string, confidence double, decision string, latency_ms int, error string, breakdown string, validation_errors string"


def raw_logs(spark, root, rows):
    """Raw logs and their states as an ingest stream would have stored them."""
    raw = spark.createDataFrame(rows, "id string, status string, t string").select(
        "id", F.lit("s").alias("source"), F.lit(None).cast("string").alias("format"), F.lit("{}").alias("raw_content"), F.to_timestamp("t").alias("received_at"), "status")
    store.put(raw, root, "raw_log", "ingest", 0)
    states = raw.withColumn("raw_batch", F.lit(0).cast("long"))
    store.put(jobs._state_rows(states, F.col("status"), F.col("received_at")), root, "raw_log_state", "ingest", 0)
    store.commit(spark, root, "ingest", 0)


def answer(decision="accept"):
    def respond(requests):
        return requests.select("id", "source", F.lit('{"class_uid":2004}').alias("ocsf"), F.lit(0.9).alias("confidence"), F.lit(decision).alias("decision"),
                               F.lit(1).alias("latency_ms"), F.lit(None).cast("string").alias("error"), F.lit("{}").alias("breakdown"), F.lit("[]").alias("validation_errors"))

    return respond


def test_reprocess_and_hand_back(spark, tmp_path):
    root = str(tmp_path)
    raw_logs(spark, root, [("p", "PENDING", "2024-01-30 23:59:00"), ("s", "IN_PROGRESS", "2024-01-30 23:40:00"), ("f", "IN_PROGRESS", "2024-01-30 23:55:00")])
    back = jobs.reprocess(spark, answer(), root, 1, F.expr(AT), healthy=False)
    assert {r.id: r.status for r in back.collect()} == {"p": "PENDING", "s": "PENDING"}
    soon = F.expr("timestamp'2024-01-31 00:01:00'")
    claimed = jobs.reprocess(spark, answer(), root, 2, soon)
    assert {r.id: r.status for r in claimed.collect()} == {"p": "IN_PROGRESS", "s": "IN_PROGRESS"}
    # The same run again does not claim anew, and what it handed over stays one batch.
    assert {r.id for r in jobs.reprocess(spark, answer(), root, 2, soon).collect()} == {"p", "s"}
    jobs.run_routing(jobs.inbox(spark, root, RESPONSE), root, f"{root}/ck", soon, available_now=True).awaitTermination()
    assert {r.id: r.status for r in jobs.raw_log_states(spark, root).collect()} == {"p": "PROCESSED", "s": "PROCESSED", "f": "IN_PROGRESS"}
    assert jobs.read(spark, root, "processing_metric").count() == 2


def test_interleaved_runs_claim_other_logs(spark, tmp_path):
    root = str(tmp_path)
    raw_logs(spark, root, [(f"p{i}", "PENDING", f"2024-01-30 23:5{i}:00") for i in range(5)])
    claims = {}

    def and_another_run(requests):
        claims[2] = {r.id for r in jobs.reprocess(spark, answer(), root, 2, F.expr(AT), limit=2).collect()}
        return answer()(requests)

    claims[1] = {r.id for r in jobs.reprocess(spark, and_another_run, root, 1, F.expr(AT), limit=2).collect()}
    assert claims == {1: {"p0", "p1"}, 2: {"p2", "p3"}}
    # While one run chooses, another does nothing; a lease that is old is void.
    with store.lease(spark, root, "reprocess", 5) as mine:
        assert mine and jobs.reprocess(spark, answer(), root, 3, F.expr(AT)) is None
        assert jobs.reprocess(spark, answer(), root, 3, F.expr(AT), minutes=0).count() == 1
    # Claims that led to nothing are due again after a while.
    later = F.expr("timestamp'2024-01-31 00:20:00'")
    assert jobs.due_logs(spark, root, later, None).count() == 5


def test_a_raw_log_has_one_finding_whoever_answers_it(spark, tmp_path):
    root, at = str(tmp_path), F.expr(AT)
    jobs.submit(responses(spark), root, "ingest", 0)
    routed = lambda: jobs.run_routing(jobs.inbox(spark, root, RESPONSE), root, f"{root}/ck", at, available_now=True).awaitTermination()
    routed()
    # The same logs by another producer, c with a finding now, and b twice.
    again = responses(spark).withColumns({"ocsf": F.lit('{"class_uid":1}'), "decision": F.lit("accept")})
    jobs.submit(again.union(again.filter("id = 'b'")), root, "reprocess", 0)
    routed()
    # A repeated hand-over of an old batch.
    jobs.submit(responses(spark), root, "ingest", 0)
    jobs.submit(responses(spark).filter("id = 'c'"), root, "late", 0)
    routed()
    found = jobs.findings(spark, root).collect()
    assert sorted((r.raw_log_id, r.class_uid) for r in found) == [("a", 2004), ("b", 2004), ("c", 1), ("d", 2004)]
    assert len({r.id for r in found}) == 4
    assert sorted(r.raw_log_id for r in jobs.read(spark, root, "outbox").collect()) == ["a", "c"]
    # A result without a finding counts once an attempt.
    assert jobs.read(spark, root, "processing_metric").filter("raw_log_id = 'c'").count() == 3


def test_snapshots_equal_all_batches(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, status string")

    def write(batch, producer, *r):
        store.put(rows(*r), root, "t", producer, batch)
        store.commit(spark, root, producer, batch)

    def check():
        every = state.latest(jobs.read(spark, root, "t").drop("producer", "batch_id"), "k", "v")
        want = sorted(map(tuple, every.collect()), key=str)
        assert sorted((r.k, r.v, r.status) for r in store.newest(spark, root, "t", "k", "v").collect()) == want
        opened = store.newest(spark, root, "t", "k", "v", keep=F.col("status") == "open")
        assert sorted((r.k, r.v, r.status) for r in opened.collect()) == [r for r in want if r[2] == "open"]

    write(0, "a", ("x", 1, "open"), ("y", 1, "open"), *((f"closed {i} {hash(str(i))}", 1, "shut") for i in range(300)))
    write(0, "b", ("z", 1, "open"), ("x", 2, "shut"))
    check()
    assert store.compact(spark, root, "t", "k", "v", by="status") == 1
    check()
    write(1, "a", ("y", 2, "shut"), ("w", 1, "open"))
    write(0, "c", ("z", 2, "open"))
    check()
    # What is in the snapshot is read from there.
    assert store.compact(spark, root, "t", "k", "v", by="status") == 2
    spoil(tmp_path / "snapshot/t/2/status=shut")
    spoil(tmp_path / "t/producer=a/batch_id=0")
    write(2, "a", ("y", 3, "open"))
    opened = store.newest(spark, root, "t", "k", "v", keep=F.col("status") == "open")
    assert {(r.k, r.v) for r in opened.collect()} == {("w", 1), ("y", 3), ("z", 2)}
    # A snapshot without its marks does not count.
    rows(("q", 9, "open")).write.parquet(f"{root}/snapshot/t/3")
    assert store.last_snapshot(spark, root, "t") == (2, {"a": 1, "b": 0, "c": 0})


def test_pending_order(spark):
    rows = [(1, "NORMAL", 0.7, None), (2, "NORMAL", 0.5, None), (3, "HIGH", 0.3, None), (4, "HIGH", 0.1, "x")]
    df = spark.createDataFrame(rows, "id int, priority string, confidence double, reviewed_at string")
    assert [r.id for r in metrics.pending_top(df).collect()] == [3, 2, 1]


def test_correction_gate(spark):
    reviews = spark.createDataFrame([(1, 10, None), (2, 20, "2024-01-01")], "id int, raw_log_id int, reviewed_at string")
    rows = [(1, "{}", "r", 5), (2, "{}", "r", 1), (3, "{}", "r", 1), (1, "{", "r", 1), (1, "{}", " ", 1), (1, "{}", "late", 6)]
    c = spark.createDataFrame(rows, "review_id int, corrected string, reviewer string, submitted int")
    got = {(r.review_id, r.corrected, r.reviewer): r.reject_reason for r in state.correction_gate(c, reviews, F.lit(True)).collect()}
    assert got == {(1, "{}", "r"): None, (2, "{}", "r"): "already_reviewed", (3, "{}", "r"): "not_found", (1, "{", "r"): "bad_json",
                   (1, "{}", " "): "blank_reviewer", (1, "{}", "late"): "already_reviewed"}
    assert state.correction_gate(c.limit(1), reviews, F.lit(False)).first().reject_reason == "invalid"


def test_effects_of_a_correction(spark):
    at = F.expr(AT)
    findings = route.finding_rows(responses(spark), at).withColumn("message_id", F.lit("m")).withColumn("published", F.lit(True))
    accepted = spark.createDataFrame([(1, "b", '{"class_uid":1}', "r", 1), (2, "b", '{"class_uid":2}', "r", 2), (3, "c", '{"class_uid":3,"class_name":"n"}', "q", 1)],
                                     "review_id int, raw_log_id string, corrected string, reviewer string, submitted int")
    last = state.last_corrections(accepted)
    out = {r.raw_log_id: r for r in state.upsert_corrections(findings, last, at).collect()}
    assert set(out) == {"a", "b", "c", "d"} and out["a"].published and out["a"].message_id == "m"
    assert (out["b"].ocsf_json, out["b"].class_uid, out["b"].decision, out["b"].published, out["b"].message_id) == ('{"class_uid":2}', 2004, "CORRECTED", False, None)
    assert (out["c"].class_uid, out["c"].class_name, out["c"].processing_time, out["c"].confidence) == (3, "n", 0, 1.0)
    reviews = spark.createDataFrame([(3, None, False), (9, None, False)], "id int, reviewed_at timestamp, exported_for_training boolean")
    closed = {r.id: r for r in state.reviewed(reviews, accepted, at).collect()}
    assert closed[3].reviewed_by == "q" and closed[3].reviewed_at is not None and closed[9].reviewed_at is None
    marked = state.mark_exported(reviews, reviews.filter("id = 3")).collect()
    assert {r.id: r.exported_for_training for r in marked} == {3: True, 9: False}
    raw = spark.createDataFrame([("b", "FAILED"), ("z", "PENDING")], "id string, status string")
    assert {r.id: r.status for r in state.processed(raw, last, at).collect()} == {"b": "PROCESSED", "z": "PENDING"}


def test_winners_are_found_by_hash(spark):
    log = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (None, 1, "z")], "k int, v int, t string")
    out = state.latest(log, "k", "v")
    assert {(r.k, r.t) for r in out.collect()} == {(1, "y"), (None, "z")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_split_is_exact_and_skew_safe(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").otherwise(F.concat(F.lit("v"), F.col("id") % 5)).alias("vendor"))
    out = training.assign_split(df, "vendor", F.sha2(F.col("id").cast("string"), 256), "id")
    counts = {(r.vendor, r.split): r["count"] for r in training.split_counts(out, "vendor").collect()}
    assert (counts["big", "train"], counts["big", "val"], counts["big", "test"]) == (720, 90, 90)
    assert (counts["v1", "train"], counts["v1", "val"], counts["v1", "test"]) == (16, 2, 2)
    assert training.missing_vendors(out, "vendor").count() == 0


def test_merge_correction_wins_and_keeps_position(spark):
    o = spark.createDataFrame([(0, "a  b", "o0"), (1, "c", "o1"), (2, "a b", "o2")], "ord int, m string, v string")
    c = spark.createDataFrame([(0, "c ", "n0"), (1, "new", "n1")], "ord int, m string, v string")
    got = {r.v: (r.position.is_correction, r.position.ord) for r in training.merge(o, c, "m", "ord").collect()}
    assert got == {"o2": (False, 0), "n0": (False, 1), "n1": (True, 1)}
    s = training.merge_summary(o, c, "m").first()
    assert (s.originals, s.corrections, s.replaced, s.added, s.total_out) == (3, 2, 1, 1, 3)


def test_prompts(spark):
    df = spark.createDataFrame([("test log", "palo-alto")], "raw string, source string")
    ex = F.array(*[F.struct(F.lit("l").alias("raw_log"), F.lit("{}").alias("ocsf"), F.lit("s").alias("source"))] * 2)
    row = df.select(training.prompt(F.col("source"), F.col("raw")).alias("a"), training.prompt(F.col("source"), F.col("raw"), ex).alias("b")).first()
    assert (len(row.a), len(row.b)) == (2, 6)
    assert "test log" in row.a[-1].content and "palo-alto" in row.a[-1].content


@pytest.mark.parametrize("step", [7, 1 << 40])
def test_ordinals_are_dense(spark, tmp_path, step):
    df = spark.range(0, 100 * step, 7 * step).select(F.col("id").alias("ord"))
    got = [r.ordinal for r in label.with_ordinal(df, "ord", f"{tmp_path}/pairs").orderBy("ord").collect()]
    assert got == list(range(1, 16))


def test_alert_files(spark, tmp_path):
    lines = ['{"_id":1,"source":"s","alert":{"b":2,"a":1}}', "", "  ", "{bad", '{"source":"t"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = files.read_jsonl(spark, f"{tmp_path}/a.jsonl").collect()
    assert [r.bad_json for r in got] == [False, True, False]
    assert json.loads(got[0].raw_log) == {"source": "s", "alert": {"a": 1, "b": 2}}
    (tmp_path / "a.json").write_text(json.dumps([{"_id": 1, "source": "s"}, {"source": "t"}], indent=1))
    assert [json.loads(r.raw_log) for r in files.read_json_array(spark, f"{tmp_path}/a.json").orderBy("pos").collect()] == [{"source": "s"}, {"source": "t"}]


def test_chat_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("log", "s", '{"class_uid":2004}'), ("log2", "s", '{"class_uid":"2004"}')], "raw string, source string, a string")
    chats = df.select(training.chat_example(F.col("source"), F.col("raw"), F.col("a")).alias("messages"))
    files.write_chat(chats, f"{tmp_path}/chat")
    back = training.check_chat(files.read_chat(spark, f"{tmp_path}/chat"))
    assert sorted(str(r.reject_reason) for r in back.collect()) == ["None", "class_uid"]
    assert files.read_chat_strict(spark, f"{tmp_path}/chat").count() == 2
    good = back.filter("reject_reason IS NULL").withColumn("split", F.lit("train"))
    files.write_splits(good, f"{tmp_path}/splits")
    assert files.read_split(spark, f"{tmp_path}/splits", "train").count() == 1


def test_large_array_file(spark, tmp_path):
    one = json.dumps({"_id": 1, "source": "s", "alert": {"text": "x" * 1000}})
    n = 140_000
    with open(tmp_path / "a.json", "w") as file:
        file.write("[" + ",\n".join([one] * n) + "]")
    got = files.read_json_array(spark, f"{tmp_path}/a.json")
    assert got.filter("NOT bad_json AND raw_log IS NOT NULL").count() == n


def test_rejected_lines_keep_their_keys(spark, tmp_path):
    lines = ["{bad", '{"a":1}', '{"messages":[{"role":"x","content":"y"}],"k":"v"}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    checked = training.check_chat(files.read_chat(spark, f"{tmp_path}/in.jsonl"))
    assert {r.line: r.reject_reason for r in checked.collect()} == dict(zip(lines, ["bad_line", "message_count", "message_count"], strict=True))
    files.write_rejected(checked, f"{tmp_path}/out")
    back = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert {"_raw": "{bad", "_reject_reason": "bad_line"} in back and {"a": 1, "_reject_reason": "message_count"} in back
    assert any(r.get("k") == "v" for r in back)


def test_exact_merge_and_its_summary_agree(spark):
    o = spark.createDataFrame([(0, "a  b", "o0"), (2, "a b", "o2")], "ord int, m string, v string")
    c = spark.createDataFrame([(0, "a b", "n0")], "ord int, m string, v string")
    assert {r.v for r in training.merge(o, c, "m", "ord", exact=True).collect()} == {"o0", "n0"}
    assert training.merge_summary(o, c, "m", exact=True).first().total_out == 2


def test_pair_and_digest_files(spark, tmp_path):
    pairs = spark.createDataFrame([("label_0001", "s", '{"a":1}', '{"class_uid":2004}')], "id string, source string, raw_log string, ocsf string")
    files.write_pairs(pairs, f"{tmp_path}/pairs")
    (row,) = files.read_pairs(spark, f"{tmp_path}/pairs").collect()
    assert (row.id, row.source, json.loads(row.raw_log), json.loads(row.ocsf), row.bad_json) == ("label_0001", "s", {"a": 1}, {"class_uid": 2004}, False)
    files.write_digests(spark.createDataFrame([("d1",), ("d2",)], "digest string"), f"{tmp_path}/digests")
    assert {r.value for r in spark.read.text(f"{tmp_path}/digests").collect()} == {"d1", "d2"}


def test_first_result_of_a_raw_log_counts(spark, tmp_path):
    df = responses(spark).withColumn("at", F.expr(AT))
    df.union(df).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    jobs.run_routing(source, f"{tmp_path}/out", f"{tmp_path}/ck", F.expr(AT), available_now=True, event_time="at").awaitTermination()
    assert jobs.read(spark, f"{tmp_path}/out", "processing_metric").count() == 4


def test_export_writes_chats_in_order_and_marks_them(spark, tmp_path):
    root = str(tmp_path)
    corrected = {i: json.dumps({"class_uid": 2004 if i % 5 else 1, "n": i}) if i % 7 else "{bad" for i in range(200, 300)}
    rows = [(str(i), f"r{i}", "s", c, i % 3 == 0) for i, c in corrected.items()]
    reviews = spark.createDataFrame(rows, "id string, raw_log_id string, source string, corrected string, exported_for_training boolean").withColumn("reviewed_at", F.expr(AT)).repartition(7)
    raw = spark.createDataFrame([(f"r{i}", f'{{"b": {i}, "a": 1}}') for i in range(200, 299)], "id string, raw_content string")
    good = [i for i in range(200, 299) if i % 3 and i % 5 and i % 7]
    dry = jobs.export_chats(reviews, raw, root, 0, dry_run=True).first()
    assert (dry.converted, dry.fetched) == (len(good), len([i for i in range(200, 299) if i % 3]))
    jobs.export_chats(reviews.filter("id < '250'"), raw, root, 1)
    jobs.export_chats(reviews, raw, root, 2)
    jobs.export_chats(reviews, raw, root, 2)
    for run, want in ((0, good), (1, [i for i in good if i < 250]), (2, [i for i in good if i >= 250])):
        lines = files.read_lines_in_order(spark, f"{root}/chats/{run}").orderBy("place").collect()
        messages = [json.loads(r.line)["messages"] for r in lines]
        assert [json.loads(m[2]["content"])["n"] for m in messages] == want
        assert all(m[1]["content"].endswith(f'{{"a":1,"b":{i}}}') for m, i in zip(messages, want, strict=True))
    assert sorted(int(r.id) for r in jobs.read(spark, root, "exported").collect()) == good


def test_pending_reviews_whose_raw_log_is_gone_are_passed_over(spark):
    rows = [(i, 1000 + i, "HIGH", i / 1000, None) for i in range(300)]
    reviews = spark.createDataFrame(rows, "id int, raw_log_id int, priority string, confidence double, reviewed_at string")
    for first in (0, 5, 45, 297, 300):
        raw = spark.range(1000 + first, 1300).select("id", F.lit("x").alias("raw_content"), F.lit("t").alias("received_at"))
        got = [r.id for r in metrics.pending_with_raw(reviews, raw).orderBy("id").collect()]
        assert got == list(range(first, min(first + 20, 300)))
