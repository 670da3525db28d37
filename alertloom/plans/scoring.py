"""Queries on extraction, validation, scoring, routing and streaming, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions.sql import F as X
from alertloom.functions.sql import Sql
from alertloom.functions.stage import once
from alertloom.functions.text import extract_json
from alertloom.operators import route, score, validate
from alertloom.plans import bindings as bind
from alertloom.session import scratch
from alertloom.streaming import jobs

# A finding as a model would write it, with planned faults.
MODEL_FINDING = """to_json(named_struct('activity_id', 1, 'activity_name', 'Create', 'category_uid', 2, 'category_name', 'Findings',
    'class_uid', 2004, 'class_name', 'Detection Finding', 'type_uid', 200401,
    'finding_info', named_struct('title', concat(ty, ' alert ', k), 'uid', concat('uid-', id)),
    'metadata', CASE WHEN id % 13 <> 0 THEN named_struct('product', named_struct('name', 'Prod', 'vendor_name', 'Vend'), 'version', '1.1.0') END,
    'severity_id', CASE WHEN id % 11 = 0 THEN 7 ELSE 3 END, 'severity', 'Medium', 'time', concat(iso, 'Z'),
    'status', CASE WHEN id % 2 = 0 THEN 'New' END,
    'device', CASE WHEN id % 3 = 0 THEN named_struct('hostname', concat('host', u), 'ip', concat('10.0.0.', k)) END,
    'extra', CASE WHEN id % 7 = 0 THEN id END))"""
_RAW = """to_json(named_struct('title', concat(ty, ' alert ', k), 'id', concat('uid-', id), 'at', CASE WHEN id % 2 = 0 THEN concat(iso, 'Z') END,
    'host', concat('host', u)))"""
_ANSWER = """CASE id % 4 WHEN 0 THEN j WHEN 1 THEN concat('Here:\\n```json\\n', j, '\\n```\\nDone.')
    WHEN 2 THEN concat('Sure. ', j, ' That is all }') ELSE concat('{"cut": ', substr(j, 1, 40)) END"""


def _answers(s, d):
    rows = bind.dealt(s, d, bind.EVENT)
    made = once(rows, ["id"], raw_log=Sql(_RAW), j=Sql(MODEL_FINDING))
    return once(made, ["id", "raw_log"], model_output=Sql(_ANSWER))


def _extract(s, d):
    found = once(_answers(s, d), ["id"], v=extract_json(X.col("model_output")))
    return found.select("id", F.col("v").isNotNull().alias("found"),
                        F.try_variant_get("v", "$.finding_info.uid", "string").alias("uid"))


def _labels(s, d):
    """Findings with faults for the label check, straight from the events."""
    text = """to_json(named_struct('activity_id', CASE WHEN id % 5 = 0 THEN 9 ELSE 1 END, 'category_uid', 2, 'category_name', 'Findings',
        'class_uid', 2004, 'class_name', CASE WHEN id % 3 = 0 THEN '' ELSE 'Detection Finding' END, 'type_uid', 200401,
        'finding_info', named_struct('title', concat('t', k), 'uid', CASE WHEN id % 7 = 0 THEN NULL ELSE 'u' END, 'types', array('', 'x')),
        'metadata', named_struct('product', named_struct('name', 'Prod', 'vendor_name', 'Vend'), 'version', CASE WHEN id % 4 = 0 THEN '1.7.0' ELSE '1.1.0' END),
        'severity_id', CASE WHEN id % 11 = 0 THEN 6 ELSE 3 END, 'severity', 'Medium', 'time', CASE WHEN id % 13 = 0 THEN NULL ELSE concat(iso, 'Z') END,
        'user', CASE WHEN id % 17 = 0 THEN 'bob' END))"""
    made = once(bind.dealt(s, d, bind.EVENT), ["id"], ocsf=Sql(f"CASE WHEN id % 19 = 0 THEN '{{bad' ELSE {text} END"))
    return validate.check_labels(made)


def _model(s, d):
    read = once(_answers(s, d), ["id"], v=extract_json(X.col("model_output")))
    checked = validate.check_model(read.filter(F.col("v").isNotNull()), "v")
    return checked.select(
        "id", F.array_join("errors", ";").alias("errors"), F.array_join("stripped", ";").alias("stripped"),
        F.col("cleaned").isNotNull().alias("valid"),
    )


# Process and ancestors, innermost text first; the ninth ancestor of every third event has a bad pid.
_CHAIN = """aggregate(sequence(0, id % 14), '', (a, i) -> concat('{"name":"p', id % 14 - i, '","pid":',
    CASE WHEN id % 3 = 0 AND id % 14 - i = 9 THEN '"x"' ELSE cast(id % 14 - i AS string) END, CASE WHEN a = '' THEN '' ELSE concat(',"parent_process":', a) END, '}'))"""
_CHAINED = """concat('{"activity_id":1,"class_uid":2004,"type_uid":200401,"severity_id":3,"time":"', iso, 'Z","finding_info":{"title":"t","uid":"u"},
    "metadata":{"product":{"name":"Prod","vendor_name":"Vend"}},"evidences":[{"process":', chain, '},{"actor":{"process":', chain, '}}]}')"""


def _ancestors(s, d):
    """The model check on processes with up to 13 ancestors, as evidence and as actor; how many are kept, and which is the last."""
    made = once(bind.dealt(s, d, bind.EVENT), ["id", "iso"], chain=Sql(_CHAIN))
    read = once(made, ["id"], v=Sql(f"parse_json({_CHAINED})"))
    checked = validate.check_model(read, "v").select("id", F.array_join("errors", ";").alias("errors"), F.to_json("cleaned.evidences").alias("kept"))
    names = F.transform(F.regexp_extract_all("kept", F.lit('"p([0-9]+)"'), F.lit(1)), lambda x: x.cast("int"))
    return checked.select("id", "errors", (F.size(F.split("kept", '"parent_process":')) - 1).alias("n_kept"), F.array_max(names).alias("last"))


def _leaf_order(s, d):
    """Consistency of findings that stay uncleaned and have more leaves than count: those that come first in the answer are looked for."""
    told = "transform(sequence(1, {n}), i -> concat('{name} ', id, ' ', i))"
    made = once(bind.dealt(s, d, bind.EVENT), ["id"], hits=Sql(told.format(n="10 + id % 30", name="hit")), misses=Sql(told.format(n="60", name="miss")))
    rows = once(made, ["id"], raw_log=Sql("to_json(named_struct('seen', hits))"), model_output=Sql("to_json(named_struct('zz', hits, 'aa', misses))"))
    return score.normalize(rows).select("id", "value_consistency", "n_errors")


def _responses(s, d):
    """Responses read off the metric rows: every decision, some without a finding."""
    return bind.view(s, d, bind.METRIC).select(
        "id", "source",
        F.when((F.col("id") % 6 != 0) | (F.col("decision") == "ACCEPT"), F.concat(F.lit('{"class_uid":2004,"severity_id":3,"n":'), F.col("id").cast("string"), F.lit("}"))).alias("ocsf"),
        "confidence", F.coalesce(F.lower("decision"), F.lit("odd")).alias("decision"), "latency_ms",
        F.when(F.col("id") % 12 == 0, "JSON extraction failed").alias("error"),
        F.lit("{}").alias("breakdown"), F.lit("[]").alias("validation_errors"),
    )


def _now():
    return F.expr(bind.AS_OF_SQL)


def _stream_timeline(s, d):
    """The metric rows through a stream over the given table; each batch rewrites the hours it touched."""
    root = scratch(s, "timeline")
    source = f"{d}/events.parquet"
    events = s.readStream.schema(s.read.parquet(source).schema).parquet(_folder(source))
    rows = bind.of(events, bind.METRIC).selectExpr("cast(ts AS timestamp) AS timestamp", "confidence", "latency_ms")
    jobs.run_timeline(rows, root, f"{root}/ck", available_now=True).awaitTermination()
    jobs.compact_timeline(s, root)
    return jobs.timeline(s, root).select(
        F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "count",
        F.round("avg_confidence", 6).alias("avg_confidence"), F.col("avg_latency_ms").cast("bigint").alias("avg_latency_ms"))


def _folder(path: str) -> str:
    """A stream reads folders or patterns: a table that is one file is named by a pattern that fits it alone."""
    return path.removesuffix(".parquet") + ".parque[t]"


def _routed(s, d, name: str) -> str:
    """The responses through the routing stream, then one retry run with the stream's batch number."""
    root = scratch(s, name)
    rows = _responses(s, d)
    rows.write.parquet(f"{root}/in")
    source = s.readStream.schema(rows.schema).parquet(f"{root}/in")
    jobs.run_routing(source, root, f"{root}/ck", _now(), available_now=True).awaitTermination()
    return root


def _stream_routing(s, d):
    """Counts of what each table received."""
    root = _routed(s, d, "routing")
    counts = [jobs.read(s, root, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in jobs.TABLES]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total


def _stream_retry(s, d):
    """Delivery after batches whose messages could not be sent, and two retry runs: every accepted finding, once."""
    root = scratch(s, "retry")
    broken = jobs.route_batch(root, _now(), send=lambda rows: 1 / 0)
    broken(_responses(s, d).filter("id % 4 = 0"), 0)
    jobs.route_batch(root, _now(), producer="other")(_responses(s, d).filter("id % 2 = 1"), 0)
    jobs.retry_outbox(s, root, 0)
    broken(_responses(s, d).filter("id % 4 = 2"), 1)
    jobs.retry_outbox(s, root, 1)
    found = jobs.findings(s, root).filter("decision = 'ACCEPT'").select("raw_log_id", "published", "message_id")
    return found.join(jobs.read(s, root, "outbox").select("raw_log_id", "value", F.col("producer").alias("sent_by"), F.col("batch_id").cast("bigint").alias("run")), "raw_log_id", "left")


def _stream_first_result(s, d):
    """Two producers answer the same raw logs, one of them again later: a finding, and a message, for the first answer that has one."""
    root = scratch(s, "first")
    rows = _responses(s, d)
    given = lambda n: F.when(F.col("id") % n != 0, F.concat(F.lit('{"class_uid":2004,"n":'), F.col("id").cast("string"), F.lit(f',"from":{n}}}')))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def answered(n: int, producer: str, batch_id: int) -> None:
        jobs.submit(rows.withColumns({"ocsf": given(n), "decision": F.when(given(n).isNotNull(), "accept").otherwise("reject")}), root, producer, batch_id)
        jobs.run_routing(jobs.inbox(s, root, fields), root, f"{root}/ck", _now(), available_now=True).awaitTermination()

    answered(2, "ingest", 0)
    answered(3, "reprocess", 0)
    answered(5, "late", 0)
    found = jobs.findings(s, root).select("id", "raw_log_id", F.get_json_object("ocsf_json", "$.from").cast("int").alias("from"), "published", "message_id")
    tried = jobs.read(s, root, "processing_metric").groupBy("raw_log_id").agg(F.count("*").alias("n_results"))
    return found.join(tried, "raw_log_id")


def _stream_normalize(s, d):
    """Ingest bodies to raw logs and answers in one stream, and to routed tables in another; newest state and decision of each log."""
    root = scratch(s, "normalize")
    bodies = bind.view(s, d, bind.EVENT).selectExpr(
        "CASE WHEN id % 10 = 0 THEN '[1]' ELSE concat('{\"source\":\"', ty, '\",\"rawContent\":{\"n\":', id, ',\"props\":', props, '}}') END AS body", "id AS delivery")
    bodies.write.parquet(f"{root}/in")

    def respond(raw_logs):
        n = F.get_json_object("raw_log", "$.n").cast("bigint")
        return raw_logs.select(
            "id", "source", F.when(n % 4 != 0, F.concat(F.lit('{"class_uid":2004,"n":'), n.cast("string"), F.lit("}"))).alias("ocsf"),
            F.when(n % 4 == 0, 0.0).when(n % 4 == 1, 0.9).otherwise(0.7).alias("confidence"),
            F.when(n % 4 == 0, "reject").when(n % 4 == 1, "accept").otherwise("review").alias("decision"),
            F.lit(5).alias("latency_ms"), F.lit(None).cast("string").alias("error"), F.lit("{}").alias("breakdown"), F.lit("[]").alias("validation_errors"))

    stream = s.readStream.schema("body string, delivery long").parquet(f"{root}/in")
    jobs.run_ingest(stream, respond, root, f"{root}/ck", F.col("delivery"), _now(), available_now=True).awaitTermination()
    fields = "id string, source string, ocsf string, confidence double, decision string, latency_ms int, error string, breakdown string, validation_errors string"
    jobs.run_routing(jobs.inbox(s, root, fields), root, f"{root}/ck2", _now(), available_now=True).awaitTermination()
    raw = jobs.read(s, root, "raw_log").select(F.col("id").alias("raw_log_id"), "source", F.get_json_object("raw_content", "$.n").cast("bigint").alias("n"))
    state_rows = jobs.raw_log_states(s, root).select(F.col("id").alias("raw_log_id"), "status", "error_message")
    found = jobs.findings(s, root).select("raw_log_id", "decision", "published", F.get_json_object("ocsf_json", "$.n").cast("bigint").alias("n_json"))
    review = jobs.read(s, root, "manual_review").select("raw_log_id", "priority")
    joined = raw.join(state_rows, "raw_log_id", "left").join(found, "raw_log_id", "left").join(review, "raw_log_id", "left")
    return joined.drop("raw_log_id")


QUERIES = {
    "extract_json": _extract,
    "validate_label": lambda s, d: _labels(s, d).select("id", F.array_join(F.array_sort("errors"), ";").alias("errors")),
    "validate_summary": lambda s, d: validate.validation_summary(_labels(s, d)),
    "validate_model": _model,
    "process_ancestors": _ancestors,
    "normalize_response": lambda s, d: score.normalize(_answers(s, d)).select(
        "id", "decision", F.round("confidence", 2).alias("confidence"), "schema_validity", "field_coverage", "value_consistency",
        "n_errors", "n_warnings", "error"),
    "score_leaf_order": _leaf_order,
    "route_findings": lambda s, d: route.finding_rows(_responses(s, d), _now()).drop("normalized_at"),
    "route_metrics": lambda s, d: route.metric_rows(_responses(s, d), _now()).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")),
    "route_status": lambda s, d: route.status_rows(_responses(s, d), _now()).withColumn("processed_at", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss")),
    "route_review": lambda s, d: route.review_rows(_responses(s, d), _now(), "b 0").withColumn("queued_at", F.date_format("queued_at", "yyyy-MM-dd HH:mm:ss")),
    "route_accept": lambda s, d: route.outbox_rows(_responses(s, d)),
    "stream_timeline": _stream_timeline,
    "stream_routing": _stream_routing,
    "stream_retry": _stream_retry,
    "stream_first_result": _stream_first_result,
    "stream_normalize": _stream_normalize,
}

_E, _M = bind.duck("e", bind.EVENT), bind.duck("m", bind.METRIC)
_OCSF = """concat('{"class_uid":2004,"severity_id":3,"n":', cast(id AS varchar), '}')"""
_LABEL_ERRORS = """concat_ws(';', CASE WHEN id % 13 = 0 THEN 'Missing required field: time' END,
    CASE WHEN id % 17 = 0 THEN 'Forbidden key at event root: ''user'' — use finding_info.attacks or evidences[] instead' END,
    CASE WHEN id % 7 = 0 THEN 'Missing or empty finding_info.uid' END,
    CASE WHEN id % 4 = 0 THEN 'metadata.version must be ''1.1.0''' END,
    CASE WHEN id % 11 = 0 THEN 'severity_id 6 not allowed' END, CASE WHEN id % 5 = 0 THEN 'activity_id 9 not allowed' END,
    CASE WHEN id % 5 = 0 THEN 'type_uid 200401 != class_uid*100+activity_id' END,
    CASE WHEN id % 13 = 0 THEN 'time must be a non-empty string' END, CASE WHEN id % 3 = 0 THEN 'Null/empty field found: class_name' END,
    'Null/empty item found: finding_info.types[0]')"""
_N_ERR = "(CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END)"
_SCORE = f"""{_E}, a AS (SELECT id, u, k, {_N_ERR} AS n_errors, CASE WHEN {_N_ERR} = 0 AND id % 7 = 0 THEN 1 ELSE 0 END AS n_warnings,
    CASE WHEN id % 13 = 0 THEN 9 ELSE 13 END AS n_schema, CASE WHEN id % 13 = 0 THEN 10 ELSE 14 END AS n_req,
    2 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n_rec, CASE WHEN id % 3 = 0 THEN 3 ELSE 0 END AS n_rich,
    2 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END
      + CASE WHEN {_N_ERR} > 0 AND id % 7 = 0 AND id > 100 THEN 1 ELSE 0 END AS n_hit,
    4 + CASE WHEN id % 13 <> 0 THEN 2 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END
      + CASE WHEN {_N_ERR} > 0 AND id % 7 = 0 AND id > 100 THEN 1 ELSE 0 END AS n_leaf FROM e)"""

ORACLES = {
    "extract_json": f"WITH {_E} SELECT id, id % 4 <> 3 AS found, CASE WHEN id % 4 <> 3 THEN concat('uid-', cast(id AS varchar)) END AS uid FROM e",
    "validate_label": f"""WITH {_E} SELECT id, CASE WHEN id % 19 = 0 THEN 'not valid JSON' ELSE
        array_to_string(list_sort(string_split({_LABEL_ERRORS}, ';')), ';') END AS errors FROM e""",
    "validate_summary": f"WITH {_E} SELECT sum(CASE WHEN id % 19 = 0 THEN 0 ELSE 1 END) AS total, cast(sum(CASE WHEN id % 19 = 0 THEN 0 ELSE 1 END) - count(*) AS bigint) AS passed, count(*) AS failed FROM e",
    "validate_model": f"""WITH {_E} SELECT id, concat_ws(';', CASE WHEN id % 13 = 0 THEN '(''metadata'',): Field required' END,
        CASE WHEN id % 11 = 0 THEN '(''severity_id'',): Input should be one of 8 allowed values' END) AS errors,
        CASE WHEN id % 13 <> 0 AND id % 11 <> 0 AND id % 7 = 0 THEN 'extra' ELSE '' END AS stripped,
        id % 13 <> 0 AND id % 11 <> 0 AS valid FROM e WHERE id % 4 <> 3""",
    "process_ancestors": f"""WITH {_E}, a AS (SELECT id, id % 14 AS n, id % 3 = 0 AND id % 14 >= 9 AS bad,
            concat(repeat(', ''parent_process''', 9), ', ''pid''): Input should be a valid integer') AS place FROM e)
        SELECT id, CASE WHEN bad THEN concat('(''evidences'', 0, ''process''', place, ';(''evidences'', 1, ''actor'', ''process''', place) ELSE '' END AS errors,
        CASE WHEN NOT bad THEN cast(2 * n AS integer) END AS n_kept, CASE WHEN NOT bad THEN cast(n AS integer) END AS last FROM a""",
    "route_findings": f"""WITH {_M} SELECT sha256(concat('finding', chr(1), cast(id AS varchar))) AS id, id AS raw_log_id, 2004 AS class_uid, NULL AS class_name, NULL AS activity_id,
        NULL AS activity_name, 3 AS severity_id, {_OCSF} AS ocsf_json, confidence, coalesce(decision, 'REJECT') AS decision, latency_ms AS processing_time, false AS published, NULL AS message_id
        FROM m WHERE id % 6 <> 0 OR decision = 'ACCEPT'""",
    "route_metrics": f"WITH {_M} SELECT id AS raw_log_id, '{bind.AS_OF}' AS timestamp, source, confidence, coalesce(decision, 'REJECT') AS decision, latency_ms, success FROM m",
    "route_status": f"""WITH {_M} SELECT id, CASE WHEN id % 6 <> 0 OR coalesce(decision, '') = 'ACCEPT' THEN 'PROCESSED' ELSE 'FAILED' END AS status, '{bind.AS_OF}' AS processed_at,
        CASE WHEN id % 6 <> 0 OR coalesce(decision, '') = 'ACCEPT' THEN NULL WHEN id % 12 = 0 THEN 'JSON extraction failed' ELSE 'No OCSF output produced' END AS error_message FROM m""",
    "route_review": f"""WITH {_M} SELECT sha256(concat('review', chr(1), cast(id AS varchar), chr(1), 'b 0')) AS id, id AS raw_log_id, source, CASE WHEN id % 6 <> 0 THEN {_OCSF} END AS model_output,
        confidence, '{{}}' AS breakdown, '[]' AS validation_errors, CASE WHEN decision = 'REVIEW' THEN 'NORMAL' ELSE 'HIGH' END AS priority, '{bind.AS_OF}' AS queued_at,
        NULL AS corrected, NULL AS reviewed_by, NULL AS reviewed_at, false AS exported_for_training FROM m WHERE coalesce(decision, '') <> 'ACCEPT'""",
    "route_accept": f"""WITH {_M}, o AS (SELECT id AS raw_log_id, concat('{{"class_uid":2004,"severity_id":3,"n":', cast(id AS varchar), '}}') AS value FROM m WHERE decision = 'ACCEPT')
        SELECT raw_log_id, value, sha256(concat(cast(raw_log_id AS varchar), chr(1), value)) AS message_id FROM o""",
    "stream_timeline": f"""WITH {_M} SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, n AS count, c AS avg_confidence, l AS avg_latency_ms FROM
        (SELECT date_trunc('hour', ts) AS b, count(*) AS n, round(coalesce(avg(confidence), 0), 6) AS c, cast(round(avg(latency_ms)) AS bigint) AS l FROM m GROUP BY 1) t""",
    "stream_routing": f"""WITH {_M}, f AS (SELECT id, decision, id % 6 <> 0 OR coalesce(decision, '') = 'ACCEPT' AS has FROM m)
        SELECT 'finding_event' AS name, count(*) AS n FROM f WHERE has UNION ALL SELECT 'processing_metric', count(*) FROM f
        UNION ALL SELECT 'raw_log_state', count(*) FROM f UNION ALL SELECT 'manual_review', count(*) FROM f WHERE coalesce(decision, '') <> 'ACCEPT'
        UNION ALL SELECT 'outbox', count(*) FROM f WHERE decision = 'ACCEPT'""",
}
ORACLES["stream_retry"] = f"""WITH {_M}, o AS (SELECT id AS raw_log_id, concat('{{"class_uid":2004,"severity_id":3,"n":', cast(id AS varchar), '}}') AS value FROM m WHERE decision = 'ACCEPT')
    SELECT raw_log_id, true AS published, sha256(concat(cast(raw_log_id AS varchar), chr(1), value)) AS message_id, value,
    CASE WHEN raw_log_id % 2 = 0 THEN 'retry' ELSE 'other' END AS sent_by, cast(CASE WHEN raw_log_id % 4 = 2 THEN 1 ELSE 0 END AS bigint) AS run FROM o"""
ORACLES["stream_first_result"] = f"""WITH {_M}, o AS (SELECT id, CASE WHEN id % 2 <> 0 THEN 2 WHEN id % 3 <> 0 THEN 3 WHEN id % 5 <> 0 THEN 5 END AS f FROM m)
    SELECT sha256(concat('finding', chr(1), cast(id AS varchar))) AS id, id AS raw_log_id, f AS "from", true AS published,
    sha256(concat(cast(id AS varchar), chr(1), '{{"class_uid":2004,"n":', cast(id AS varchar), ',"from":', cast(f AS varchar), '}}')) AS message_id,
    1 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS n_results FROM o WHERE f IS NOT NULL"""
ORACLES["score_leaf_order"] = f"WITH {_E} SELECT id, round((10 + id % 30) / 50.0::double, 3) AS value_consistency, 6 AS n_errors FROM e"
ORACLES["stream_normalize"] = f"""WITH {_E} SELECT id AS n, ty AS source, CASE WHEN id % 4 = 0 THEN 'FAILED' ELSE 'PROCESSED' END AS status,
    CASE WHEN id % 4 = 0 THEN 'No OCSF output produced' END AS error_message, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ACCEPT' ELSE 'REVIEW' END AS decision,
    CASE WHEN id % 4 <> 0 THEN id % 4 = 1 END AS published, CASE WHEN id % 4 <> 0 THEN id END AS n_json,
    CASE id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN NULL ELSE 'NORMAL' END AS priority FROM e WHERE id % 10 <> 0"""
# Scores as the definitions give them: leaves are title, uid, time, severity (never in the alert text), product
# names, host and ip; the alert text holds title, uid (and so the number kept of an uncleaned finding), host
# and, for even ids, the time.
ORACLES["normalize_response"] = f"""WITH {_SCORE}, b AS (SELECT *, greatest(0, n_schema / 13.0::double - n_errors * 0.05::double - n_warnings * 0.02::double) AS s,
    0.5::double * n_req / 14 + 0.3::double * n_rec / 9 + 0.2::double * n_rich / 20 AS c, n_hit / n_leaf::double AS v FROM a),
    z AS (SELECT *, id % 4 <> 3 AS ok, 0.4::double * s + 0.3::double * c + 0.3::double * v AS t FROM b)
    SELECT id, CASE WHEN NOT ok THEN 'reject' WHEN t >= 0.85 THEN 'accept' WHEN t >= 0.6 THEN 'review' ELSE 'reject' END AS decision,
    CASE WHEN ok THEN round(round(t, 3), 2) ELSE 0 END AS confidence, CASE WHEN ok THEN round(s, 3) END AS schema_validity, CASE WHEN ok THEN round(c, 3) END AS field_coverage,
    CASE WHEN ok THEN round(v, 3) END AS value_consistency, CASE WHEN ok THEN n_errors END AS n_errors, CASE WHEN ok THEN n_warnings END AS n_warnings,
    CASE WHEN NOT ok THEN 'JSON extraction failed' END AS error FROM z"""
