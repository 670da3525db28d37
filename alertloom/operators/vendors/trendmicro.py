"""Trend Micro Vision One: ``indicators`` are folded by type, ``impactScope`` fills gaps."""

from __future__ import annotations


from alertloom import schemas as S
from alertloom.functions import build as B
from alertloom.functions import scalars as sc
from alertloom.functions import variants as V
from alertloom.functions.sql import F, Sql
from alertloom.functions.text import strip
from alertloom.operators.vendors.common import (
    Leaves,
    Vendor,
    any_of,
    attack,
    info,
    metadata,
    rule,
    user_actor,
)

_OBSERVED = {
    "ip": ("evidences[].src_endpoint.ip", "IP Address"),
    "domain": ("evidences[].dst_endpoint.domain", "Domain"),
    "url": ("evidences[].dst_endpoint.url", "URL"),
}
_REGISTRY = ("registry_key", "registry_value", "registry_value_data")


def _indicator(i: Sql) -> Sql:
    """(type, text, first ip); a host value is an object with a name and addresses."""
    as_object = V.is_object(i, "value")
    return F.struct(
        V.text(i, "type").alias("type"),
        B.some_text(
            F.when(as_object, V.truthy(i, "value", "name")).otherwise(strip(V.text(i, "value")))
        ).alias("text"),
        F.when(as_object, F.get(V.truthy_items(i, "value", "ips"), 0)).alias("ip"),
    )


def _techniques(a: Sql) -> Sql:
    filters = F.flatten(
        F.array_compact(V.over(V.items(a, "matchedRules"), lambda r: V.items(r, "matchedFilters")))
    )
    ids = V.over(filters, lambda f: V.truthy_items(f, "mitreTechniqueIds"))
    return B.nonempty_array(F.array_distinct(F.flatten(F.array_compact(ids))))


def _not_objects(a: Sql, *keys: str) -> Sql:
    return F.exists(V.items(a, *keys), lambda e: ~V.is_object(e))


def _fold(indicators: Sql) -> Sql:
    texts = lambda type_: F.filter(
        F.transform(indicators, lambda i: F.when(i["type"] == type_, i["text"])),
        lambda t: t.isNotNull(),
    )
    first = lambda type_: F.get(texts(type_), 0)
    last = lambda type_: F.try_element_at(texts(type_), -1)
    pids = F.filter(
        F.transform(texts("process_id"), lambda t: t.try_cast("long")), lambda p: p.isNotNull()
    )
    return F.struct(
        first("command_line").alias("cmd_line"),
        first("fullpath").alias("path"),
        F.array_distinct(texts("file_sha256")).alias("hashes"),
        first("host").alias("host"),
        V.pick_first(indicators, lambda i: F.when(i["type"] == "host", i["ip"])).alias("ip"),
        # A pid of 0 gives way to a later one.
        F.coalesce(F.get(F.filter(pids, lambda p: p != 0), 0), F.get(pids, 0)).alias("pid"),
        first("user").alias("user"),
        *[last(k).alias(k) for k in _REGISTRY],
        F.array_compact(F.transform(
            indicators,
            lambda i: sc.raw_observable(
                sc.lookup({k: v[0] for k, v in _OBSERVED.items()}, i["type"]),
                sc.lookup({k: v[1] for k, v in _OBSERVED.items()}, i["type"]),
                F.when(i["type"].isin(*_OBSERVED), i["text"]),
            ),
        )).alias("observed"),
    )


def leaves(a: Sql) -> dict[str, Sql]:
    scope = V.items(a, "impactScope", "entities")
    host = lambda e, value: F.when(
        (V.text(e, "entityType") == "host") & V.is_object(e, "entityValue"), value
    )
    account = lambda e: F.when(
        (V.text(e, "entityType") == "account") & V.is_text(e, "entityValue"),
        V.truthy(e, "entityValue"),
    )
    return {
        "title": V.first_truthy(a, "model", "alertName"),
        "uid": V.first_truthy(a, "id", "workbenchId"),
        "desc": V.truthy(a, "description"),
        "url": V.truthy(a, "workbenchLink"),
        "rule": V.head(V.over(V.items(a, "matchedRules"), lambda r: V.first_truthy(r, "name", "ruleName"))),
        "techniques": _techniques(a),
        "time": sc.first_time_text(a, "createdDateTime", "createdAt"),
        "severity": V.text(a, "severity"),
        "score": V.integer(a, "score"),
        "status": V.truthy(a, "investigationStatus"),
        "seen": V.let(
            F.filter(
                V.over(V.items(a, "indicators"), _indicator),
                lambda i: i["text"].isNotNull() | i["ip"].isNotNull(),
            ),
            _fold,
        ),
        "scope_host": V.head(V.over(scope, lambda e: host(e, V.truthy(e, "entityValue", "name")))),
        "scope_ip": V.head(
            V.over(scope, lambda e: host(e, F.get(V.truthy_items(e, "entityValue", "ips"), 0)))
        ),
        "scope_user": V.head(V.over(scope, account)),
        "provider": V.truthy_value(a, "alertProvider"),
        "model_type": V.truthy_value(a, "modelType"),
        "bad_type": any_of(
            V.text(a, "score").isNotNull() & V.integer(a, "score").isNull(),
            V.truthy_not_object(a, "impactScope"),
            F.coalesce(_not_objects(a, "matchedRules"), F.lit(False)),
            F.coalesce(_not_objects(a, "indicators"), F.lit(False)),
            F.coalesce(_not_objects(a, "impactScope", "entities"), F.lit(False)),
        ),
    }


def build(x: Leaves) -> dict[str, Sql]:
    seen = x.seen
    file_name = sc.path_tail(seen["path"])
    hash_records = F.transform(
        seen["hashes"],
        lambda h: B.always(S.HASH, algorithm=F.lit("SHA-256"), algorithm_id=F.lit(3), value=h),
    )
    some_hash = F.size(seen["hashes"]) > 0
    hashes = Sql(F.when(some_hash, hash_records).text, tests=(some_hash.text,))
    file = B.record(S.FILE, name=file_name, path=seen["path"], hashes=hashes)
    process = B.record(S.PROCESS, cmd_line=seen["cmd_line"], pid=seen["pid"], file=file)

    own_device = B.record(S.DEVICE, hostname=seen["host"], ip=seen["ip"])
    scope_device = B.record(S.DEVICE, hostname=x.scope_host, ip=x.scope_ip)
    user = F.coalesce(seen["user"], x.scope_user)

    hashed = F.transform(
        seen["hashes"],
        lambda h: sc.raw_observable("evidences[].process.file.hashes.SHA-256", "Hash", h),
    )
    named = B.list_of(sc.raw_observable("evidences[].process.file.name", "File Name", file_name))
    return {
        "finding_info": info(
            x,
            desc=x.desc,
            src_url=x.url,
            analytic=rule(x.rule),
            attacks=F.transform(x.techniques, lambda t: attack(technique_uid=t)),
        ),
        "metadata": metadata("Vision One", "Trend Micro"),
        "time": x.time,
        "severity_id": sc.text_severity(x.severity),
        "confidence_score": x.score,
        "status": x.status,
        "device": F.coalesce(own_device, scope_device),
        "evidences": B.arr(B.record(S.EVIDENCE, process=process, actor=user_actor(name=user))),
        "observables": B.joined(seen["observed"], hashed, named),
        "unmapped": B.free_map(
            **{k: seen[k] for k in _REGISTRY},
            alert_provider=x.provider,
            model_type=x.model_type,
        ),
    }


VENDOR = Vendor("trendmicro", leaves, build, aliases=("trend_micro",))
