"""Splunk Enterprise Security notables; several fields hold a text or a list."""

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
    attack,
    endpoint,
    info,
    metadata,
    rule,
    user_actor,
)

FLAT_MITRE = "annotations.mitre_attack"


def _texts_of(v: Sql, *keys: str) -> Sql:
    return F.transform(V.items(v, *keys), lambda e: strip(V.text(e)))


def _tactics(a: Sql) -> Sql:
    """Sorted distinct tactic names from the flat key and from ``annotations`` (object or JSON text)."""
    flat = F.when(V.is_list(a, FLAT_MITRE), _texts_of(a, FLAT_MITRE)).otherwise(
        F.array(strip(V.truthy(a, FLAT_MITRE)))
    )
    as_text = F.when(V.is_text(a, "annotations"), strip(V.text(a, "annotations")))
    from_text = V.let(
        F.when(as_text.startswith("{"), V.parse_strict(as_text)),
        lambda parsed: _texts_of(F.try_variant_get(parsed, "$.mitre_attack", "variant")),
    )
    both = B.joined(flat, from_text, _texts_of(a, "annotations", "mitre_attack"))
    named = F.filter(both, lambda t: t.isNotNull() & (t != ""))
    return F.array_sort(F.array_distinct(named))


def _address(a: Sql, first: str, second: str) -> Sql:
    """First value that is not empty; of a list its head; kept only when it looks like an IP."""
    chosen = F.when(V.nonempty(a, first).isNotNull(), V.get(a, first)).otherwise(V.get(a, second))
    head = V.let(
        chosen,
        lambda c: F.when(V.is_list(c), V.truthy(F.get(V.items(c), 0))).otherwise(
            V.truthy(c)
        ),
    )
    return V.let(head, lambda h: F.when(sc.looks_like_ip(h), h))


def leaves(a: Sql) -> dict[str, Sql]:
    user = V.first_truthy(a, "user", "user_id")
    origin = V.truthy(a, "orig_host")
    bucket = V.get(a, "_bkt")
    return {
        "title": V.first_truthy(a, "search_name", "rule_name", "rule_title", "signature"),
        "uid": F.coalesce(
            V.first_truthy(a, "rule_id", "event_id", "_cd"),
            F.concat(
                F.lit("splunk-"),
                F.coalesce(
                    V.text(a, "_bkt"), F.when(bucket.isNotNull(), "None").otherwise("unknown")
                ),
            ),
        ),
        "desc": V.first_truthy(a, "rule_description", "savedsearch_description"),
        "url": V.truthy(a, "webUrl"),
        "rule": V.first_truthy(a, "search_name", "rule_name"),
        "tactics": _tactics(a),
        "time": sc.first_time_text(a, "_time", "timestamp"),
        "severity": V.first_truthy(a, "urgency", "severity"),
        "status": strip(V.first_truthy(a, "status", "disposition")),
        "src": _address(a, "src_ip", "src"),
        "dst": _address(a, "dest_ip", "dest"),
        "user": F.nullif(user, F.lit(sc.ZERO_GUID)),
        "origin": F.when(sc.looks_like_ip(origin), origin),
        "app": V.truthy_value(a, "app"),
        "vendor_product": V.truthy_value(a, "vendor_product"),
        "security_domain": V.truthy_value(a, "security_domain"),
        "sid": V.truthy(a, "sid"),
        "search_name": V.truthy_value(a, "search_name"),
        "bad_type": F.lit(False),
    }


def build(x: Leaves) -> dict[str, Sql]:
    evidence = B.record(
        S.EVIDENCE,
        src_endpoint=endpoint(x.src),
        dst_endpoint=endpoint(x.dst),
        actor=user_actor(name=x.user),
    )
    raw = B.list_of(
        sc.raw_observable("evidences[].src_endpoint.ip", "IP Address", x.src),
        sc.raw_observable("evidences[].dst_endpoint.ip", "IP Address", x.dst),
        sc.raw_observable("evidences[].actor.user.name", "User Name", x.user),
        sc.raw_observable("evidences[].src_endpoint.ip", "IP Address", x.origin),
    )
    return {
        "finding_info": info(
            x,
            desc=x.desc,
            src_url=x.url,
            analytic=rule(x.rule),
            attacks=B.nonempty_array(F.transform(x.tactics, lambda t: attack(tactic_name=t))),
        ),
        "metadata": metadata("Splunk Enterprise Security", "Splunk"),
        "time": x.time,
        "severity_id": sc.text_severity(x.severity),
        "status_id": F.coalesce(
            sc.lookup(sc.SPLUNK_STATUSES, F.lower(x.status)),
            sc.lookup(sc.SPLUNK_STATUS_CODES, x.status),
        ),
        "evidences": B.arr(evidence),
        "observables": raw,
        "unmapped": B.free_map(
            app=x.app,
            vendor_product=x.vendor_product,
            security_domain=x.security_domain,
            sid=x.sid,
            search_name=x.search_name,
        ),
    }


VENDOR = Vendor("splunk", leaves, build)
