"""Queries on the scalar rules over event columns, with oracles."""

from __future__ import annotations

from alertloom.functions import scalars as sc
from alertloom.functions import variants as V
from alertloom.functions.sql import F as X
from alertloom.functions.sql import Sql, columns
from alertloom.functions.stage import once
from alertloom.plans import bindings as bind

_WORD = "CASE id % 6 WHEN 0 THEN ' HIGH ' WHEN 1 THEN 'info' WHEN 2 THEN 'Low' WHEN 3 THEN 'x' WHEN 4 THEN 'critical' END"
_NAME = "CASE id % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'closed' WHEN 2 THEN 'in_progress' WHEN 3 THEN 'suppressed' WHEN 4 THEN 'working' WHEN 5 THEN 'redirected' ELSE 'active' END"
_RAW_TIME = """CASE id % 8 WHEN 0 THEN concat('"', iso, 'Z"') WHEN 1 THEN concat('"', iso, '.1234567+0530"') WHEN 2 THEN '1704449472'
    WHEN 3 THEN '{"$numberLong":"1704449472000"}' WHEN 4 THEN '"1704449472000"' WHEN 5 THEN '"soon"' WHEN 6 THEN 'null'
    ELSE concat('"', substr(iso, 6, 2), '/', substr(iso, 9, 2), '/', substr(iso, 1, 4), ' ', substr(iso, 12, 8), '"') END"""
_HASH = "CASE id % 5 WHEN 0 THEN '0000' WHEN 1 THEN ' ' WHEN 2 THEN '00-00' WHEN 3 THEN concat(' ab', cast(k AS string), ' ') END"
_MITRE = "CASE id % 4 WHEN 0 THEN 'T1036.005 - Match Name' WHEN 1 THEN concat('TA0005 - ', ty) WHEN 2 THEN concat(' ', ty, ' ') END"
_ADDRESS = "CASE id % 5 WHEN 0 THEN concat('10.0.0.', cast(k AS string)) WHEN 1 THEN 'fe80::1' WHEN 2 THEN 'a:b.' WHEN 3 THEN concat('1000.0.0.', cast(k AS string)) ELSE ty END"
_PATH = r"CASE id % 4 WHEN 0 THEN concat('C:\\tmp\\f', cast(k AS string)) WHEN 1 THEN concat('/tmp/f', cast(k AS string)) WHEN 2 THEN concat('f', cast(k AS string)) ELSE '/tmp/' END"
_LIST = "CASE id % 4 WHEN 0 THEN concat(' f', cast(k AS string), ' , x') WHEN 1 THEN ',x' WHEN 2 THEN concat('f', cast(k AS string)) END"
_TITLE = "CASE id % 3 WHEN 0 THEN concat('AIE MITRE-TA0001 MITRE-TA', lpad(cast(k AS string), 4, '0')) WHEN 1 THEN 'MITRE-TA01' END"


def _query(inputs: dict[str, str], build):
    """Input columns made from the events, then the rules over them."""

    def run(s, d):
        made = once(bind.view(s, d, bind.EVENT), ["id", "k"], **{n: Sql(t) for n, t in inputs.items()})
        return made.select("id", *columns(**build()))

    return run


QUERIES = {
    "severity_scales": _query({"word": _WORD, "score": "CASE WHEN id % 9 > 0 THEN k END"}, lambda: {
        "text_id": sc.text_severity(X.col("word")),
        "crowdstrike_id": sc.crowdstrike_severity(X.col("score")),
        "logrhythm_id": sc.logrhythm_severity(X.col("score")),
        "label": sc.severity_label(sc.crowdstrike_severity(X.col("score"))),
    }),
    "status_maps": _query({"name": _NAME}, lambda: {
        n: sc.lookup(t, X.col("name")) for n, t in (
            ("crowdstrike", sc.CROWDSTRIKE_STATUSES), ("splunk", sc.SPLUNK_STATUSES), ("defender", sc.DEFENDER_STATUSES),
            ("logrhythm", sc.LOGRHYTHM_STATUS_NAMES), ("sentinel", sc.SENTINEL_STATUSES))
    } | {"code": sc.lookup(sc.LOGRHYTHM_STATUS_CODES, X.col("k"))}),
    "timestamp_normalize": _query(
        {"t": sc.time_text(V.parse(Sql(f"concat('{{\"t\":', {_RAW_TIME}, '}}')")), "t").text},
        lambda: {"at": sc.iso_time(X.col("t"))}),
    "hash_build": _query({"h": _HASH}, lambda: {
        "algorithm_id": sc.hash_record("SHA-256", X.col("h"))["algorithm_id"].cast("int"),
        "hash": sc.hash_record("SHA-256", X.col("h"))["value"], "same": sc.hash_value(X.col("h"))}),
    "observable_build": _query({"h": _HASH, "t": "CASE id % 3 WHEN 0 THEN 'Hash' WHEN 1 THEN 'User Name' ELSE 'Domain' END"}, lambda: {
        "type_id": sc.observable(X.lit("n"), X.col("t"), X.col("h"))["type_id"].cast("int"),
        "model_type_id": sc.observable(X.lit("n"), X.col("t"), X.col("h"), sc.MODEL_OBSERVABLE_TYPES)["type_id"].cast("int"),
        "value": sc.observable(X.lit("n"), X.col("t"), X.col("h"))["value"]}),
    "mitre_parse": _query({"m": _MITRE, "title": _TITLE}, lambda: {
        "uid": sc.mitre_uid(X.col("m")), "name": sc.mitre_name(X.col("m")),
        "in_title": X.array_join(sc.mitre_ids_in_title(X.col("title")), ",")}),
    "ip_like": _query({"a": _ADDRESS}, lambda: {"ip": sc.looks_like_ip(X.col("a"))}),
    "path_tail": _query({"p": _PATH}, lambda: {"tail": sc.path_tail(X.col("p"))}),
    "comma_first": _query({"c": _LIST}, lambda: {"head": sc.first_of_comma_list(X.col("c"))}),
}

_E = bind.duck("e", bind.EVENT)
_CROWD = "CASE WHEN id % 9 = 0 THEN 0 WHEN k <= 19 THEN 1 WHEN k <= 39 THEN 2 WHEN k <= 59 THEN 3 WHEN k <= 79 THEN 4 ELSE 5 END"
_VALUE = "CASE WHEN id % 5 = 3 THEN concat('ab', cast(k AS string)) END"
_SHOWN = f"CASE id % 5 WHEN 0 THEN '0000' WHEN 2 THEN '00-00' WHEN 3 THEN concat('ab', cast(k AS string)) END"
_FILE = "concat('f', cast(k AS string))"

ORACLES = {
    "severity_scales": f"""WITH {_E} SELECT id, CASE id % 6 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 5 ELSE 0 END AS text_id, {_CROWD} AS crowdstrike_id,
        CASE WHEN id % 9 = 0 THEN 0 WHEN k <= 39 THEN 2 WHEN k <= 64 THEN 3 ELSE 4 END AS logrhythm_id,
        CASE {_CROWD} WHEN 1 THEN 'Informational' WHEN 2 THEN 'Low' WHEN 3 THEN 'Medium' WHEN 4 THEN 'High' WHEN 5 THEN 'Critical' ELSE 'Unknown' END AS label FROM e""",
    "status_maps": f"""WITH {_E} SELECT id, CASE id % 7 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 2 END AS crowdstrike,
        CASE id % 7 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 3 THEN 3 END AS splunk, CASE id % 7 WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 4 END AS defender,
        CASE id % 7 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 END AS logrhythm, CASE id % 7 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 6 THEN 2 END AS sentinel,
        CASE WHEN k IN (0, 8) THEN 1 WHEN k IN (1, 2) THEN 2 WHEN k BETWEEN 3 AND 6 THEN 4 WHEN k = 7 THEN 3 END AS code FROM e""",
    "timestamp_normalize": f"""WITH {_E} SELECT id, CASE WHEN id % 8 IN (0, 7) THEN concat(iso, 'Z') WHEN id % 8 = 1 THEN strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%SZ')
        WHEN id % 8 IN (2, 3, 4) THEN '2024-01-05T10:11:12Z' END AS at FROM e""",
    "hash_build": f"WITH {_E} SELECT id, CASE WHEN id % 5 = 3 THEN 3 END AS algorithm_id, {_VALUE} AS hash, {_VALUE} AS same FROM e",
    "observable_build": f"""WITH {_E} SELECT id, CASE WHEN id % 5 IN (0, 2, 3) THEN CASE id % 3 WHEN 0 THEN 8 WHEN 1 THEN 0 ELSE 28 END END AS type_id,
        CASE WHEN id % 5 IN (0, 2, 3) THEN CASE id % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 0 END END AS model_type_id, {_SHOWN} AS value FROM e""",
    "mitre_parse": f"""WITH {_E} SELECT id, CASE id % 4 WHEN 0 THEN 'T1036.005' WHEN 1 THEN 'TA0005' END AS uid,
        CASE id % 4 WHEN 0 THEN 'Match Name' WHEN 1 THEN ty WHEN 2 THEN ty END AS name,
        CASE WHEN id % 3 = 0 THEN concat('TA0001,TA', lpad(cast(k AS string), 4, '0')) END AS in_title FROM e""",
    "ip_like": f"WITH {_E} SELECT id, id % 5 IN (0, 1) AS ip FROM e",
    "path_tail": f"WITH {_E} SELECT id, CASE WHEN id % 4 < 3 THEN {_FILE} END AS tail FROM e",
    "comma_first": f"WITH {_E} SELECT id, CASE WHEN id % 4 IN (0, 2) THEN {_FILE} END AS head FROM e",
}
