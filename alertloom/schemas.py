"""Record layouts: the finding (nested) and the four operational tables (flat).

The finding layout is declared once as ``Field`` trees that also say which
fields are required and which integer set a field must belong to; the Spark
``StructType`` and the validator are both derived from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------

CLASS_UID = 2004
CLASS_NAME = "Detection Finding"
CATEGORY_UID = 2
CATEGORY_NAME = "Findings"
LABEL_VERSION = "1.1.0"
MODEL_VERSION = "1.7.0"

STATUSES = ("PENDING", "IN_PROGRESS", "PROCESSED", "FAILED")
DECISIONS = ("ACCEPT", "REVIEW", "REJECT", "CORRECTED")
PRIORITIES = ("NORMAL", "HIGH")
LOG_FORMATS = ("json", "cef", "syslog", "csv", "leef", "unknown")

# fixed values: integer sets of the model schema; 99 is "other" throughout.
SEVERITY_IDS = (*range(7), 99)
MALWARE_CLASS_IDS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 99)
OBSERVABLE_TYPE_IDS = (*range(49), 99)
DEVICE_TYPE_IDS = (*range(16), 99)
FILE_TYPE_IDS = (*range(9), 99)
HASH_ALGORITHM_IDS = (*range(18), 99)
DIRECTION_IDS = (*range(5), 99)
OS_TYPE_IDS = (0, 99, 100, 101, 200, 201, 300, 301, 302, 400, 401, 402)
USER_TYPE_IDS = (*range(5), 99)
STATUS_IDS = (*range(7), 99)
RISK_LEVEL_IDS = (*range(5), 99)


# --- finding ----------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """One field: ``kind`` is text, int, float, bool, map, texts, obj, objs or chain.

    A chain is an object that holds another of its kind under ``parent_process``, and so on without end: ``levels`` of
    them are typed, what lies above is one VARIANT.
    """

    kind: str
    required: bool = False
    allowed: tuple[int, ...] | None = None
    default: object = None
    fields: dict[str, "Field"] | None = None
    levels: int = 0


def _text(required=False, default=None):
    return Field("text", required, default=default)


def _int(required=False, allowed=None, default=None):
    return Field("int", required, allowed=allowed, default=default)


def _obj(fields, required=False):
    return Field("obj", required, fields=fields)


def _objs(fields, required=False):
    return Field("objs", required, fields=fields)


def _texts(*names):
    return {n: _text() for n in names}


_FLOAT, _BOOL, _MAP, _TEXTS = Field("float"), Field("bool"), Field("map"), Field("texts")

# The names and kinds of a finding's fields.
_NAME_UID = _texts("name", "uid")
_PRODUCT = {"name": _text(True), "vendor_name": _text(True), **_texts("uid", "version")}
_OS = {**_texts("name", "type"), "type_id": _int(allowed=OS_TYPE_IDS), **_texts("version")}
_ACCOUNT = {**_texts("name", "uid", "type"), "type_id": _int()}
_USER = {
    **_texts("name", "uid", "email_addr", "type"),
    "type_id": _int(allowed=USER_TYPE_IDS),
    "account": _obj(_ACCOUNT),
    "org": _obj(_NAME_UID),
}
_HASH = {
    "algorithm": _text(True),
    "algorithm_id": _int(True, HASH_ALGORITHM_IDS),
    "value": _text(True),
}
_FILE = {
    **_texts("name", "path"),
    "hashes": _objs(_HASH),
    "type": _text(),
    "type_id": _int(allowed=FILE_TYPE_IDS),
    "size": _int(),
}


_PROCESS = {
    "name": _text(),
    "pid": _int(),
    **_texts("uid", "cmd_line", "created_time"),
    "file": _obj(_FILE),
    "user": _obj(_USER),
}
PARENT = "parent_process"
_ENDPOINT = {"ip": _text(), "port": _int(), **_texts("hostname", "domain", "mac", "uid", "name")}
_CONNECTION = {
    "protocol_name": _text(),
    "protocol_num": _int(),
    "direction": _text(),
    "direction_id": _int(allowed=DIRECTION_IDS),
}
_API = {
    "operation": _text(),
    "service": _obj(_NAME_UID),
    "request": _obj({"data": _MAP, "uid": _text()}),
    "response": _obj({"data": _MAP, **_texts("message", "error", "error_message"), "code": _int()}),
}
_EMAIL = {"from": _text(), "to": _TEXTS, **_texts("subject", "uid"), "files": _objs(_FILE)}
_EVIDENCE = {
    "process": Field("chain", fields=_PROCESS, levels=3),
    "actor": _obj({"user": _obj(_USER), "process": Field("chain", fields=_PROCESS, levels=1)}),
    "src_endpoint": _obj(_ENDPOINT),
    "dst_endpoint": _obj(_ENDPOINT),
    "connection_info": _obj(_CONNECTION),
    "api": _obj(_API),
    "email": _obj(_EMAIL),
    "data": _MAP,
}
_DEVICE = {
    **_texts("hostname", "name", "ip", "mac", "uid", "domain", "type"),
    "type_id": _int(allowed=DEVICE_TYPE_IDS),
    "os": _obj(_OS),
    "location": _obj({**_texts("city", "country"), "lat": _FLOAT, "long": _FLOAT}),
    "org": _obj(_NAME_UID),
    "owner": _obj(_USER),
    "agent": _objs(_texts("name", "uid", "version", "type")),
}
_OBSERVABLE = {
    "name": _text(True),
    "type": _text(True),
    "type_id": _int(True, OBSERVABLE_TYPE_IDS),
    "value": _text(True),
}
_ATTACK = {"tactic": _obj(_NAME_UID), "technique": _obj(_NAME_UID), "sub_technique": _obj(_NAME_UID)}
_FINDING_INFO = {
    "title": _text(True),
    "uid": _text(True),
    **_texts(
        "desc", "created_time", "modified_time", "first_seen_time", "last_seen_time", "src_url"
    ),
    "types": _TEXTS,
    "uid_alt": _text(),
    "data_sources": _TEXTS,
    "analytic": _obj({**_texts("name", "type"), "type_id": _int(), "uid": _text()}),
    "attacks": _objs(_ATTACK),
    "product": _obj(_PRODUCT),
}
_METADATA = {
    "product": _obj(_PRODUCT, True),
    "version": _text(default=MODEL_VERSION),
    **_texts("uid", "correlation_uid", "log_name"),
    "profiles": _TEXTS,
    **_texts("original_time", "log_format"),
}
_CVE = {
    "uid": _text(True),
    **_texts("title", "desc", "type", "created_time", "modified_time"),
    "cvss": _objs({"version": _text(), "base_score": _FLOAT, "severity": _text()}),
    "epss": _obj({"score": _FLOAT, "percentile": _FLOAT}),
    "product": _obj(_PRODUCT),
    "references": _TEXTS,
    "related_cwes": _objs({"uid": _text(True), **_texts("caption", "src_url")}),
}
_MALWARE = {
    **_texts("name", "uid"),
    "classification_ids": Field("ints", True, allowed=MALWARE_CLASS_IDS),
    "classifications": _TEXTS,
    "severity_id": _int(allowed=SEVERITY_IDS),
    **_texts("severity", "provider"),
    "num_infected": _int(),
    "cves": _objs(_CVE),
    "files": _objs(_FILE),
}
_ENRICHMENT = {**_texts("name", "value", "type", "provider"), "data": _MAP, "desc": _text()}
_RESOURCE = {
    **_texts("name", "hostname", "ip"),
    "owner": _obj(_USER),
    **_texts("uid", "type"),
    "data": _MAP,
}

FINDING_FIELDS: dict[str, Field] = {
    "activity_id": _int(True),
    "activity_name": _text(),
    "category_uid": _int(default=CATEGORY_UID, allowed=(CATEGORY_UID,)),
    "category_name": _text(default=CATEGORY_NAME),
    "class_uid": _int(default=CLASS_UID, allowed=(CLASS_UID,)),
    "class_name": _text(default=CLASS_NAME),
    "type_uid": _int(True),
    "finding_info": _obj(_FINDING_INFO, True),
    "metadata": _obj(_METADATA, True),
    "severity_id": _int(True, SEVERITY_IDS),
    "time": _text(True),
    "severity": _text(),
    "confidence_score": _int(),
    "risk_score": _int(),
    "risk_level": _text(),
    "risk_level_id": _int(allowed=RISK_LEVEL_IDS),
    "impact_score": _int(),
    "type_name": _text(),
    "status": _text(),
    "status_id": _int(allowed=STATUS_IDS),
    **_texts("status_detail", "status_code", "message", "comment"),
    "count": _int(),
    "is_alert": _BOOL,
    "malware": _objs(_MALWARE),
    **_texts("start_time", "end_time"),
    "duration": _int(),
    "timezone_offset": _int(),
    "device": _obj(_DEVICE),
    "evidences": _objs(_EVIDENCE),
    "observables": _objs(_OBSERVABLE),
    "resources": _objs(_RESOURCE),
    "enrichments": _objs(_ENRICHMENT),
    "vendor_attributes": _MAP,
    "unmapped": _MAP,
    "raw_data": _text(),
}

_FREE_MAP = T.MapType(T.StringType(), T.VariantType())
_SCALARS = {
    "text": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "map": _FREE_MAP,
    "texts": T.ArrayType(T.StringType()),
    "ints": T.ArrayType(T.LongType()),
}


def spark_type(field: Field) -> T.DataType:
    if field.kind == "obj":
        return struct_of(field.fields)
    if field.kind == "objs":
        return T.ArrayType(struct_of(field.fields))
    if field.kind == "chain":
        above = T.VariantType()
        for _ in range(field.levels):
            above = T.StructType([*struct_of(field.fields).fields, T.StructField(PARENT, above)])
        return above
    return _SCALARS[field.kind]


def struct_of(fields: dict[str, Field]) -> T.StructType:
    return T.StructType([T.StructField(n, spark_type(f)) for n, f in fields.items()])


FINDING = struct_of(FINDING_FIELDS)
FINDING_INFO = FINDING["finding_info"].dataType
METADATA = FINDING["metadata"].dataType
PRODUCT = METADATA["product"].dataType
ANALYTIC = FINDING_INFO["analytic"].dataType
ATTACK = FINDING_INFO["attacks"].dataType.elementType
NAME_UID = ATTACK["tactic"].dataType
DEVICE = FINDING["device"].dataType
OS = DEVICE["os"].dataType
AGENT = DEVICE["agent"].dataType.elementType
EVIDENCE = FINDING["evidences"].dataType.elementType
ACTOR = EVIDENCE["actor"].dataType
USER = ACTOR["user"].dataType
ACCOUNT = USER["account"].dataType
PROCESS = EVIDENCE["process"].dataType
PARENT_PROCESS = PROCESS["parent_process"].dataType
GRANDPARENT_PROCESS = PARENT_PROCESS["parent_process"].dataType
FILE = PROCESS["file"].dataType
HASH = FILE["hashes"].dataType.elementType
ENDPOINT = EVIDENCE["src_endpoint"].dataType
EMAIL = EVIDENCE["email"].dataType
OBSERVABLE = FINDING["observables"].dataType.elementType

# --- tables -----------------------------------------------------------------

RAW_LOG = (
    "id string, source string, format string, raw_content string, received_at timestamp, "
    "processed_at timestamp, status string, error_message string"
)
FINDING_EVENT = (
    "id string, raw_log_id string, class_uid int, class_name string, activity_id int, "
    "activity_name string, severity_id int, ocsf_json string, confidence double, decision string, "
    "processing_time int, normalized_at timestamp, published boolean, message_id string"
)
MANUAL_REVIEW = (
    "id string, raw_log_id string, source string, model_output string, confidence double, "
    "breakdown string, validation_errors string, priority string, queued_at timestamp, "
    "reviewed_at timestamp, reviewed_by string, corrected string, exported_for_training boolean"
)
PROCESSING_METRIC = (
    "id string, timestamp timestamp, source string, confidence double, latency_ms int, "
    "decision string, success boolean"
)
CHAT = "messages array<struct<role:string,content:string>>"
