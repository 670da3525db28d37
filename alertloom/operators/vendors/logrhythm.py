"""LogRhythm: fields sit in ``alarmDetails``, or at the top level when that key is absent."""

from __future__ import annotations


from alertloom import schemas as S
from alertloom.functions import build as B
from alertloom.functions import scalars as sc
from alertloom.functions import variants as V
from alertloom.functions.sql import F, Sql
from alertloom.functions.text import strip
from alertloom.operators.vendors.common import Leaves, Vendor, any_of, attack, metadata, rule


def leaves(a: Sql) -> dict[str, Sql]:
    nested = V.get(a, "alarmDetails")
    flat = nested.isNull()
    inside = _fields(V.get(a, "alarmDetails"))
    outside = _fields(a)
    chosen = {n: F.when(flat, outside[n]).otherwise(inside[n]) for n in inside}
    return {
        **chosen,
        "bad_type": any_of((~flat) & ~V.is_object(nested), chosen["bad_type"]),
    }


def _fields(d: Sql) -> dict[str, Sql]:
    status_number = F.when(
        ~V.is_text(d, "alarmStatus"), F.try_variant_get(V.get(d, "alarmStatus"), "$", "double")
    )
    return {
        "title": V.truthy(d, "alarmRuleName"),
        "uid": V.text(d, "alarmId"),
        "time": sc.first_time_text(d, "dateInserted", "alarmDate"),
        "start_time": sc.time_text(d, "eventDateFirst"),
        "end_time": sc.time_text(d, "eventDateLast"),
        "rbp_max": V.integer(d, "rbpMax"),
        "rbp_max_value": V.nonempty_value(d, "rbpMax"),
        "status_name": F.lower(strip(V.truthy(d, "alarmStatusName"))),
        "status_code": F.when(status_number == F.floor(status_number), status_number.cast("int")),
        "count": V.integer(d, "eventCount"),
        "entity": V.truthy(d, "entityName"),
        "updated_by": V.truthy_value(d, "lastUpdatedName"),
        "bad_type": any_of(
            V.truthy_not_text(d, "alarmRuleName"),
            V.truthy_not_text(d, "alarmStatusName"),
        ),
    }


def build(x: Leaves) -> dict[str, Sql]:
    tactic_ids = sc.mitre_ids_in_title(x.title)
    return {
        "finding_info": B.always(
            S.FINDING_INFO,
            title=x.title,
            uid=B.some_text(x.uid),
            analytic=rule(x.title),
            attacks=F.transform(tactic_ids, lambda t: attack(tactic_uid=t)),
        ),
        "metadata": metadata("LogRhythm SIEM", "LogRhythm"),
        "time": x.time,
        "start_time": x.start_time,
        "end_time": x.end_time,
        "severity_id": sc.logrhythm_severity(x.rbp_max),
        "status_id": F.coalesce(
            sc.lookup(sc.LOGRHYTHM_STATUS_NAMES, x.status_name),
            sc.lookup(sc.LOGRHYTHM_STATUS_CODES, x.status_code),
        ),
        "count": F.when(x.count > 0, x.count),
        "device": B.record(S.DEVICE, hostname=x.entity),
        "vendor_attributes": B.free_map(rbp_max=x.rbp_max_value),
        "unmapped": B.free_map(last_updated_by=x.updated_by),
    }


VENDOR = Vendor("logrhythm", leaves, build)
