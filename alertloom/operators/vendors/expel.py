"""Expel Workbench."""

from __future__ import annotations


from alertloom.functions import build as B
from alertloom.functions import scalars as sc
from alertloom.functions import variants as V
from alertloom.functions.sql import F, Sql
from alertloom.operators.vendors.common import Leaves, Vendor, any_of, attack, info, metadata


def leaves(a: Sql) -> dict[str, Sql]:
    at = lambda name: ("attributes", name)
    return {
        "title": V.truthy(a, *at("title")),
        "uid": V.truthy(a, "id"),
        "detection_type": V.truthy(a, *at("detection_type")),
        "short_link": V.truthy(a, *at("short_link")),
        "time": F.coalesce(
            sc.time_text(a, *at("created_at")), sc.time_text(a, *at("updated_at"))
        ),
        "severity": F.when(V.is_text(a, *at("analyst_severity")), V.text(a, *at("analyst_severity"))),
        # Only a JSON boolean counts, not the texts "true" and "false".
        "is_incident": F.when(
            V.kind(V.get(a, *at("is_incident"))) == "BOOLEAN", V.text(a, *at("is_incident"))
        ),
        "lifecycle": V.truthy(a, *at("attack_lifecycle")),
        "threat_type": V.truthy_value(a, *at("threat_type")),
        "attack_vector": V.truthy_value(a, *at("attack_vector")),
        "attack_timing": V.truthy_value(a, *at("attack_timing")),
        "malware_family": V.truthy_value(a, *at("malware_family")),
        "bad_type": any_of(
            V.truthy_not_object(a, "attributes"), V.truthy_not_text(a, *at("attack_lifecycle"))
        ),
    }


def build(x: Leaves) -> dict[str, Sql]:
    tactic = sc.lookup(sc.EXPEL_TACTICS, F.upper(x.lifecycle))
    return {
        "finding_info": info(
            x,
            types=B.arr(x.detection_type),
            src_url=x.short_link,
            attacks=B.arr(attack(tactic_name=tactic)),
        ),
        "metadata": metadata("Expel Workbench", "Expel"),
        "time": x.time,
        "severity_id": F.coalesce(sc.lookup(sc.ANALYST_SEVERITIES, F.lower(x.severity)), F.lit(0)),
        "status_id": F.when(x.is_incident == "true", 2).when(x.is_incident == "false", 1),
        "unmapped": B.free_map(
            threat_type=x.threat_type,
            attack_vector=x.attack_vector,
            attack_timing=x.attack_timing,
            malware_family=x.malware_family,
        ),
    }


VENDOR = Vendor("expel", leaves, build)
