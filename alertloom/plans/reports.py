"""Queries on metrics, reviews, queues, state and ingest contracts, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.sql import Sql
from alertloom.functions.stage import once
from alertloom.operators import ingest, metrics, state, validate
from alertloom.plans import bindings as bind
from alertloom.plans.scoring import MODEL_FINDING
from alertloom.session import scratch



def _as_of():
    return F.expr(bind.AS_OF_SQL)


def _text(name: str):
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss").alias(name)


def _r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def _metric(s, d):
    return bind.view(s, d, bind.METRIC)


def _raw(s, d):
    return bind.view(s, d, bind.RAW_LOG)


def _finding(s, d):
    return bind.view(s, d, bind.FINDING)


def _review(s, d):
    return bind.view(s, d, bind.REVIEW)


def _timeline(s, d):
    rows = _r6(metrics.timeline(_metric(s, d), _as_of()), "avg_confidence")
    return metrics.timeline_labels(rows).select(
        _text("bucket"), "count", "avg_confidence", F.col("avg_latency_ms").cast("bigint").alias("avg_latency_ms"), "day"
    )


def _queue(s, d):
    q = metrics.review_queue(_review(s, d), _as_of())
    return q.select(
        "pending_count",
        _text("oldest_queued_at"),
        "oldest_minutes",
        metrics.format_minutes(F.col("oldest_minutes")).alias("shown"),
    )


def _ages(s, d):
    r = metrics.pending(_review(s, d))
    return r.select(
        "id",
        metrics.time_ago(F.col("queued_at"), _as_of()).alias("age"),
        metrics.review_band(F.col("confidence")).alias("band"),
    )


def _titles(s, d):
    rows = bind.view(s, d, bind.EVENT).selectExpr(
        "id", "to_json(named_struct('finding_info', named_struct('title', CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 > 1 THEN concat(ty, k) END))) AS j"
    )
    return rows.select("id", metrics.alert_title(F.col("j")).alias("title"))


def _claim(s, d):
    raw = _raw(s, d)
    due = state.reprocess_candidates(raw, _as_of(), limit=None)
    return state.apply_claim(raw, due).select("id", "status")


def _state_log(s, d):
    """Status changes per user: every event is a new version of its user's row."""
    return bind.view(s, d, bind.EVENT).selectExpr("u AS key", "id AS version", "ty AS status", "k")


def _corrections(s, d):
    """One correction per event and for some a second: some reviews are unknown, done, or given bad input."""
    made = once(bind.dealt(s, d, bind.EVENT), ["id", "u"], j=Sql(MODEL_FINDING))
    rows = made.selectExpr(
        "id AS review_id", "CASE WHEN id % 31 = 0 THEN '{bad' ELSE j END AS corrected",
        "CASE WHEN id % 41 = 0 THEN '  ' ELSE concat('r', u) END AS reviewer", "explode(CASE WHEN id % 5 = 0 THEN array(id, -id - 1) ELSE array(id) END) AS submitted",
    )
    return rows


def _gate(s, d):
    read = _corrections(s, d).withColumn("v", F.try_parse_json("corrected"))
    checked = validate.check_model(read, "v")
    told = checked.select("review_id", "corrected", "reviewer", "submitted", F.col("cleaned").isNotNull().alias("fits"))
    return state.correction_gate(told, _review(s, d), F.col("fits"), table=scratch(s, "gate"))


def _accepted(s, d):
    """Written once: the gate feeds several tables."""
    passed = _gate(s, d).filter(F.col("reject_reason").isNull()).select("review_id", "raw_log_id", "corrected", "reviewer", "submitted")
    path = scratch(s, "accepted")
    passed.write.parquet(path)
    return s.read.schema(passed.schema).parquet(path)


def _stored_findings(s, d):
    """Findings in their stored shape."""
    rows = _finding(s, d)
    null = lambda t: F.lit(None).cast(t)
    return rows.select(
        "raw_log_id", "class_uid", null("string").alias("class_name"), F.lit(9).alias("activity_id"), F.lit("Old").alias("activity_name"),
        F.lit(1).alias("severity_id"), F.lit("{}").alias("ocsf_json"), "confidence", "decision", F.col("latency_ms").alias("processing_time"),
        F.col("normalized_at").cast("timestamp").alias("normalized_at"), "published", F.when(F.col("published"), "m").alias("message_id"),
    )


def _upsert(s, d):
    """Every tenth correction is of a raw log without a finding (those have negative numbers), so that corrections also insert."""
    last = state.last_corrections(_accepted(s, d))
    moved = last.withColumn("raw_log_id", F.when(F.col("raw_log_id") % 10 == 1, -F.col("raw_log_id")).otherwise(F.col("raw_log_id")))
    done = state.upsert_corrections(_stored_findings(s, d), moved, _as_of())
    return done.withColumns({"n_json": F.length("ocsf_json").cast("bigint"), "normalized_at": F.date_format("normalized_at", "yyyy-MM-dd HH:mm:ss")}).drop("ocsf_json")


def _correction_state(s, d):
    """Reviews and raw logs after the corrections."""
    accepted = _accepted(s, d)
    reviews = state.reviewed(_review(s, d).drop("corrected"), accepted, _as_of())
    raw = state.processed(_raw(s, d), accepted, _as_of()).select(F.col("id").alias("raw_log_id"), "status", F.col("processed_at").isNotNull().alias("done"))
    return reviews.join(raw, "raw_log_id", "left").select("id", "reviewed_by", F.col("reviewed_at").isNotNull().alias("reviewed"), F.length("corrected").cast("bigint").alias("n_json"), "status", "done")


def _export_marks(s, d):
    reviews = _review(s, d)
    due = reviews.filter("corrected IS NOT NULL AND NOT exported_for_training")
    return state.mark_exported(reviews, due).select("id", "exported_for_training")


def _dedup(s, d):
    rows = bind.view(s, d, bind.EVENT).selectExpr("u AS raw_log_id", "id AS ord", "ty", "k")
    return state.first_per_raw_log(rows, "ord")


def _ingest(s, d):
    rows = bind.view(s, d, bind.EVENT).selectExpr(
        "id",
        """CASE id % 7 WHEN 0 THEN concat('{"source":"s","rawContent":', props, '}')
             WHEN 1 THEN concat('{"rawContent":', props, '}') WHEN 2 THEN '{"source":"","rawContent":{"a":1}}'
             WHEN 3 THEN '{"source":"s","rawContent":{}}' WHEN 4 THEN '{"source":"s","rawContent":{"a":1},"extra":1}'
             WHEN 5 THEN '[1]' ELSE '{"source":5,"rawContent":{"a":1}}' END AS body""",
    )
    return ingest.check_single(rows).select("id", F.coalesce("reject_reason", F.lit("ok")).alias("outcome"))


def _batch(s, d):
    rows = bind.view(s, d, bind.EVENT).selectExpr(
        "id", """concat('{"source":"', ty, '","alerts":[', CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN props ELSE concat(props, ',{"k":-1}') END, ']}') AS body"""
    )
    exploded = ingest.explode_batch(ingest.check_batch(rows))
    return exploded.select("id", "source", F.col("position").cast("bigint").alias("position"),
                           F.get_json_object("raw_content", "$.k").cast("bigint").alias("k"))


def _requests(s, d):
    rows = bind.view(s, d, bind.EVENT).selectExpr(
        "id",
        "CASE WHEN id % 11 = 0 THEN ' \\t ' ELSE concat(' ', props, ' ') END AS raw_log",
        "CASE id % 5 WHEN 0 THEN ' Palo-Alto ' WHEN 1 THEN 'palo_alto' WHEN 2 THEN '-x' WHEN 3 THEN 'A' ELSE concat(ty, k) END AS source",
        "CASE id % 4 WHEN 0 THEN ' CEF' WHEN 1 THEN 'xml' WHEN 2 THEN 'Json' END AS format",
    )
    return ingest.check_request(rows).select("id", "source", "format", F.length("raw_log").cast("bigint").alias("n_raw"),
                                             F.coalesce("reject_reason", F.lit("ok")).alias("outcome"))


def _outbox(s, d):
    due = state.retry_candidates(_finding(s, d), limit=None)
    payload = F.concat(F.lit('{"class_uid":2004,"raw_log_id":'), F.col("raw_log_id").cast("string"), F.lit("}"))
    delivered = state.outbox(due.filter(F.col("source") == "splunk"), payload)
    return state.outbox(due, payload, delivered)


QUERIES = {
    "metrics_overview": lambda s, d: _r6(metrics.overview(_metric(s, d)), "avg_confidence", "avg_latency_ms", "success_rate", "review_rate"),
    "metrics_cards": lambda s, d: metrics.presented_overview(metrics.overview(_metric(s, d))),
    "metrics_by_source": lambda s, d: _r6(metrics.by_source(_metric(s, d)), "avg_confidence", "avg_latency_ms"),
    "metrics_by_decision": lambda s, d: _r6(metrics.by_decision(_metric(s, d)), "percentage"),
    "metrics_timeline": _timeline,
    "metrics_review_queue": _queue,
    "sources_by_confidence": lambda s, d: metrics.presented(metrics.sources_by_confidence(metrics.by_source(_metric(s, d)))),
    "sources_by_latency": lambda s, d: _r6(metrics.sources_by_latency(metrics.by_source(_metric(s, d))), "avg_latency_ms").select("source", "avg_latency_ms"),
    "age_bands": _ages,
    "alert_titles": _titles,
    "review_pending_topk": lambda s, d: metrics.pending_top(_review(s, d)).select("id", "priority", "confidence"),
    "review_pending_with_raw": lambda s, d: metrics.pending_with_raw(_review(s, d), _raw(s, d)).select("id", "priority", "confidence", "raw_content"),
    "review_filter_priority": lambda s, d: metrics.with_priority(_review(s, d), "HIGH").select("id", "confidence"),
    "reprocess_candidates": lambda s, d: state.reprocess_candidates(_raw(s, d), _as_of()).select("id", "status"),
    "reprocess_claim": _claim,
    "retry_candidates": lambda s, d: state.retry_candidates(_finding(s, d)).select("id", "decision"),
    "retry_outbox": _outbox,
    "latest_state": lambda s, d: state.latest(_state_log(s, d), "key", "version"),
    "orphan_reviews": lambda s, d: state.orphans(_review(s, d), _raw(s, d)).select("id", "raw_log_id"),
    "dedup_findings": _dedup,
    "correction_gate": lambda s, d: _gate(s, d).select("review_id", "submitted", F.coalesce("reject_reason", F.lit("ok")).alias("outcome")),
    "correction_upsert": _upsert,
    "correction_state": _correction_state,
    "export_marks": _export_marks,
    "ingest_contract": _ingest,
    "batch_explode": _batch,
    "request_contract": _requests,
}

_M, _R, _V = bind.duck("m", bind.METRIC), bind.duck("r", bind.RAW_LOG), bind.duck("v", bind.REVIEW)
_E, _FI = bind.duck("e", bind.EVENT), bind.duck("f", bind.FINDING)
_TS = bind.AS_OF_SQL
_MINUTES = f"cast(floor((epoch_us({_TS}) - epoch_us(queued_at)) / 60000000) AS bigint)"
_DUE = f"(status = 'PENDING' OR (status = 'IN_PROGRESS' AND received_at < {_TS} - INTERVAL 10 MINUTE))"
_PENDING = "v WHERE reviewed_at IS NULL"
_TOP = "ORDER BY CASE WHEN priority = 'HIGH' THEN 0 ELSE 1 END, confidence, id LIMIT 20"
# One row per correction: the second ones came first.  The JSON's length follows from its parts.
_GATE = f"""{_E}, {_V}, s AS (SELECT *, id AS submitted FROM e UNION ALL SELECT *, -id - 1 FROM e WHERE id % 5 = 0),
    t AS (SELECT s.id, s.u, s.submitted, v.raw_log_id, CASE WHEN s.id % 41 = 0 THEN 'blank_reviewer' WHEN s.id % 31 = 0 THEN 'bad_json'
        WHEN s.id % 13 = 0 OR s.id % 11 = 0 THEN 'invalid' WHEN v.id IS NULL THEN 'not_found'
        WHEN v.reviewed_at IS NOT NULL OR (s.id % 5 = 0 AND submitted >= 0) THEN 'already_reviewed' ELSE 'ok' END AS outcome,
        length(concat('{{"activity_id":1,"activity_name":"Create","category_uid":2,"category_name":"Findings","class_uid":2004,"class_name":"Detection Finding","type_uid":200401,',
            '"finding_info":{{"title":"', ty, ' alert ', cast(k AS varchar), '","uid":"uid-', cast(s.id AS varchar), '"}},',
            '"metadata":{{"product":{{"name":"Prod","vendor_name":"Vend"}},"version":"1.1.0"}},"severity_id":3,"severity":"Medium","time":"', iso, 'Z"',
            CASE WHEN s.id % 2 = 0 THEN ',"status":"New"' ELSE '' END,
            CASE WHEN s.id % 3 = 0 THEN concat(',"device":{{"hostname":"host', cast(u AS varchar), '","ip":"10.0.0.', cast(k AS varchar), '"}}') ELSE '' END,
            CASE WHEN s.id % 7 = 0 THEN concat(',"extra":', cast(s.id AS varchar)) ELSE '' END, '}}')) AS n_json
        FROM s LEFT JOIN v ON s.id = v.id),
    c AS (SELECT * FROM t WHERE outcome = 'ok')"""

ORACLES = {
    "metrics_overview": f"""WITH {_M} SELECT count(*) AS total_logs, round(avg(confidence), 6) AS avg_confidence,
        round(avg(latency_ms), 6) AS avg_latency_ms, round(100.0 * sum(CASE WHEN success THEN 1 ELSE 0 END) / count(*), 6) AS success_rate,
        round(100.0 * sum(CASE WHEN success THEN 0 ELSE 1 END) / count(*), 6) AS review_rate FROM m""",
    "metrics_cards": f"""WITH {_M}, o AS (SELECT count(*) AS n, avg(confidence) AS c, avg(latency_ms) AS l, 100.0 * avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS r FROM m)
        SELECT n AS total_logs, printf('%.2f', c) AS confidence, CASE WHEN c >= 0.85 THEN 'Healthy' ELSE 'Low' END AS health,
        concat(cast(cast(round(l) AS bigint) AS varchar), 'ms') AS latency, printf('%.1f%%', r) AS success, printf('%.1f%%', 100 - r) AS review FROM o""",
    "metrics_by_source": f"""WITH {_M} SELECT source, count(*) AS count, round(avg(confidence), 6) AS avg_confidence,
        round(avg(latency_ms), 6) AS avg_latency_ms FROM m GROUP BY source""",
    "metrics_by_decision": f"""WITH {_M} SELECT decision, count(*) AS count,
        round(100.0 * count(*) / (SELECT count(*) FROM m), 6) AS percentage FROM m GROUP BY decision""",
    "metrics_timeline": f"""WITH {_M} SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, n AS count, c AS avg_confidence, l AS avg_latency_ms,
        strftime(b, '%b %-d') AS day FROM (SELECT date_trunc('hour', ts) AS b, count(*) AS n, round(coalesce(avg(confidence), 0), 6) AS c,
        cast(round(avg(latency_ms)) AS bigint) AS l FROM m WHERE ts > {_TS} - INTERVAL 7 DAY GROUP BY 1) t""",
    "metrics_review_queue": f"""WITH {_V}, q AS (SELECT count(*) AS pending_count, min(queued_at) AS queued_at FROM {_PENDING})
        SELECT pending_count, strftime(queued_at, '%Y-%m-%d %H:%M:%S') AS oldest_queued_at, {_MINUTES} AS oldest_minutes,
        concat(cast({_MINUTES} // 60 AS varchar), 'h ', cast({_MINUTES} % 60 AS varchar), 'm') AS shown FROM q""",
    "sources_by_confidence": f"""WITH {_M} SELECT source, count(*) AS count, printf('%.2f', avg(confidence)) AS confidence,
        concat(cast(cast(round(avg(latency_ms)) AS bigint) AS varchar), 'ms') AS latency,
        CASE WHEN avg(confidence) >= 0.88 THEN 'green' WHEN avg(confidence) >= 0.83 THEN 'teal' ELSE 'amber' END AS band FROM m GROUP BY source""",
    "sources_by_latency": f"WITH {_M} SELECT source, round(avg(latency_ms), 6) AS avg_latency_ms FROM m GROUP BY source",
    "age_bands": f"""WITH {_V}, a AS (SELECT id, confidence, {_MINUTES} AS mins FROM {_PENDING})
        SELECT id, CASE WHEN mins < 1 THEN 'just now' WHEN mins < 60 THEN concat(cast(mins AS varchar), 'm ago')
        WHEN mins < 1440 THEN concat(cast(mins // 60 AS varchar), 'h ago') ELSE concat(cast(mins // 1440 AS varchar), 'd ago') END AS age,
        CASE WHEN confidence < 0.6 THEN 'red' WHEN confidence < 0.85 THEN 'amber' ELSE 'green' END AS band FROM a""",
    "alert_titles": f"WITH {_E} SELECT id, CASE WHEN id % 5 > 1 THEN concat(ty, cast(k AS varchar)) ELSE 'Unknown alert' END AS title FROM e",
    "review_pending_topk": f"WITH {_V} SELECT id, priority, confidence FROM {_PENDING} {_TOP}",
    "review_pending_with_raw": f"""WITH {_V}, {_R}, j AS (SELECT v.*, r.raw_content FROM v JOIN r ON v.raw_log_id = r.id)
        SELECT id, priority, confidence, raw_content FROM j WHERE reviewed_at IS NULL {_TOP}""",
    "review_filter_priority": f"WITH {_V} SELECT id, confidence FROM {_PENDING} AND priority = 'HIGH'",
    "reprocess_candidates": f"WITH {_R} SELECT id, status FROM r WHERE {_DUE} ORDER BY received_at, id LIMIT 10",
    "reprocess_claim": f"WITH {_R} SELECT id, CASE WHEN {_DUE} THEN 'IN_PROGRESS' ELSE status END AS status FROM r",
    "retry_candidates": f"WITH {_FI} SELECT id, decision FROM f WHERE NOT published AND decision = 'ACCEPT' ORDER BY normalized_at, id LIMIT 10",
    "retry_outbox": f"""WITH {_FI}, o AS (SELECT raw_log_id, concat('{{"class_uid":2004,"raw_log_id":', cast(raw_log_id AS varchar), '}}') AS value
        FROM f WHERE NOT published AND decision = 'ACCEPT' AND source <> 'splunk') SELECT raw_log_id, value,
        sha256(concat(cast(raw_log_id AS varchar), chr(1), value)) AS message_id FROM o""",
    "latest_state": f"WITH {_E} SELECT u AS key, id AS version, ty AS status, k FROM e QUALIFY row_number() OVER (PARTITION BY u ORDER BY id DESC) = 1",
    "orphan_reviews": f"WITH {_V} SELECT id, raw_log_id FROM v WHERE raw_log_id < 0",
    "dedup_findings": f"WITH {_E} SELECT u AS raw_log_id, id AS ord, ty, k FROM e QUALIFY row_number() OVER (PARTITION BY u ORDER BY id) = 1",
    "correction_gate": f"WITH {_GATE} SELECT id AS review_id, submitted, outcome FROM t",
    "correction_upsert": f"""WITH {_GATE}, {_FI}, k AS (SELECT * FROM f),
        n AS (SELECT * REPLACE (CASE WHEN raw_log_id % 10 = 1 THEN -raw_log_id ELSE raw_log_id END AS raw_log_id) FROM c)
        SELECT coalesce(k.raw_log_id, c.raw_log_id) AS raw_log_id, 2004 AS class_uid, CASE WHEN k.id IS NULL THEN 'Detection Finding' END AS class_name,
        CASE WHEN k.id IS NULL THEN 1 ELSE 9 END AS activity_id, CASE WHEN k.id IS NULL THEN 'Create' ELSE 'Old' END AS activity_name,
        CASE WHEN k.id IS NULL THEN 3 ELSE 1 END AS severity_id, CASE WHEN c.id IS NULL THEN k.confidence ELSE 1.0 END AS confidence,
        CASE WHEN c.id IS NULL THEN k.decision ELSE 'CORRECTED' END AS decision, CASE WHEN k.id IS NULL THEN 0 ELSE k.latency_ms END AS processing_time,
        strftime(CASE WHEN k.id IS NULL THEN {_TS} ELSE k.normalized_at END, '%Y-%m-%d %H:%M:%S') AS normalized_at,
        CASE WHEN c.id IS NULL THEN k.published ELSE false END AS published, CASE WHEN c.id IS NULL AND k.published THEN 'm' END AS message_id,
        CASE WHEN c.id IS NULL THEN 2 ELSE c.n_json END AS n_json
        FROM k FULL OUTER JOIN n AS c ON k.raw_log_id = c.raw_log_id""",
    "correction_state": f"""WITH {_GATE}, {_R} SELECT v.id, CASE WHEN c.id IS NOT NULL THEN concat('r', cast(c.u AS varchar)) END AS reviewed_by,
        v.reviewed_at IS NOT NULL OR c.id IS NOT NULL AS reviewed, c.n_json, CASE WHEN r.id IS NULL THEN NULL WHEN c.id IS NOT NULL THEN 'PROCESSED' ELSE r.status END AS status,
        CASE WHEN r.id IS NOT NULL THEN c.id IS NOT NULL END AS done
        FROM v LEFT JOIN c ON v.id = c.id LEFT JOIN r ON v.raw_log_id = r.id""",
    "export_marks": f"WITH {_V} SELECT id, exported_for_training OR corrected IS NOT NULL AS exported_for_training FROM v",
    "ingest_contract": f"""WITH {_E} SELECT id, CASE id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'bad_source' WHEN 2 THEN 'bad_source'
        WHEN 3 THEN 'bad_content' WHEN 4 THEN 'unknown_key' WHEN 5 THEN 'not_an_object' ELSE 'bad_source' END AS outcome FROM e""",
    "batch_explode": f"""WITH {_E} SELECT id, ty AS source, p AS position, CASE WHEN p = 0 THEN k ELSE -1 END AS k
        FROM e, (SELECT 0 AS p UNION ALL SELECT 1) x WHERE (id % 3 = 1 AND p = 0) OR id % 3 = 2""",
    "request_contract": f"""WITH {_E}, c AS (SELECT id, CASE id % 5 WHEN 0 THEN 'palo-alto' WHEN 1 THEN 'palo_alto' WHEN 2 THEN '-x' WHEN 3 THEN 'a'
        ELSE concat(ty, cast(k AS varchar)) END AS source, CASE id % 4 WHEN 0 THEN 'cef' WHEN 1 THEN 'xml' WHEN 2 THEN 'json' ELSE 'unknown' END AS format,
        CASE WHEN id % 11 = 0 THEN 0 ELSE length(props) END AS n_raw FROM e)
        SELECT id, source, format, n_raw, CASE WHEN id % 11 = 0 THEN 'empty_raw_log' WHEN id % 5 IN (1, 2) THEN 'unsafe_source'
        WHEN format = 'xml' THEN 'unknown_format' ELSE 'ok' END AS outcome FROM c""",
}
