"""What every vendor mapping has: scalar leaves read from the alert, then a finding built on them.

The two steps are separate projections.  Leaves are the only place that touches
the VARIANT, and the build step may use a leaf many times at no cost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce


from alertloom import schemas as S
from alertloom.functions import build as B
from alertloom.functions import scalars as sc
from alertloom.functions.sql import F, Sql


class Leaves:
    """Attribute access to the leaf struct: ``x.title``; ``x.as_of`` is the default time."""

    def __init__(self, struct: Sql, as_of: Sql):
        self._struct = struct
        self.as_of = as_of

    def __getattr__(self, name: str) -> Sql:
        return self._struct.getField(name)


@dataclass(frozen=True)
class Vendor:
    """``leaves`` must hold ``bad_type``: true where the reference's mapper would raise."""

    name: str
    leaves: Callable[[Sql], dict[str, Sql]]
    build: Callable[[Leaves], dict[str, Sql]]
    aliases: tuple[str, ...] = ()
    # Observables are one per value, not one per type and value.
    distinct_values: bool = False
    # Both must be there, else the alert is skipped as ``missing_required``.
    required: tuple[str, str] = ("title", "uid")


def any_of(*conditions: Sql) -> Sql:
    return F.coalesce(reduce(lambda a, b: a | b, conditions), F.lit(False))


def finding(parts: dict[str, Sql], as_of: Sql) -> Sql:
    """Constant head plus the vendor's parts; a time that cannot be read becomes ``as_of``."""
    parts = dict(parts)
    severity = parts.pop("severity_id")
    status_id = parts.get("status_id")
    if status_id is not None:
        parts.setdefault("status", sc.status_label(status_id))
    when = parts.pop("time")
    return B.always(
        S.FINDING,
        activity_id=F.lit(1),
        activity_name=F.lit("Create"),
        category_uid=F.lit(S.CATEGORY_UID),
        category_name=F.lit(S.CATEGORY_NAME),
        class_uid=F.lit(S.CLASS_UID),
        class_name=F.lit(S.CLASS_NAME),
        type_uid=F.lit(S.CLASS_UID * 100 + 1),
        severity_id=severity,
        severity=sc.severity_label(severity),
        time=F.coalesce(sc.iso_time(when), sc.iso_utc(as_of)),
        **{k: defaulted(v, as_of) if k in ("start_time", "end_time") else v for k, v in parts.items()},
    )


def defaulted(time_value: Sql, as_of: Sql) -> Sql:
    """Optional time: NULL stays NULL, an unreadable one becomes ``as_of``."""
    return F.when(time_value.isNotNull(), F.coalesce(sc.iso_time(time_value), sc.iso_utc(as_of)))


def info(x: Leaves, **fields: Sql) -> Sql:
    return B.always(S.FINDING_INFO, title=x.title, uid=x.uid, **fields)


def rule(name: Sql, uid: Sql | None = None) -> Sql:
    return F.when(
        name.isNotNull(),
        B.always(S.ANALYTIC, name=name, type=F.lit("Rule"), type_id=F.lit(1), uid=uid),
    )


def attack(
    tactic_name: Sql | None = None,
    tactic_uid: Sql | None = None,
    technique_name: Sql | None = None,
    technique_uid: Sql | None = None,
) -> Sql:
    return B.record(
        S.ATTACK,
        tactic=B.record(S.NAME_UID, name=tactic_name, uid=tactic_uid),
        technique=B.record(S.NAME_UID, name=technique_name, uid=technique_uid),
    )


def metadata(product: Sql | str, vendor: Sql | str, original_time: Sql | None = None) -> Sql:
    return B.always(
        S.METADATA,
        product=B.always(S.PRODUCT, name=F.lit(product), vendor_name=F.lit(vendor)),
        version=F.lit(S.LABEL_VERSION),
        original_time=original_time,
    )


def endpoint(ip: Sql, port: Sql | None = None) -> Sql:
    """NULL without an address; port 0 is left out."""
    port = F.nullif(port, F.lit(0).cast("long")) if port is not None else None
    record = F.when(ip.isNotNull(), B.always(S.ENDPOINT, ip=ip, port=port))
    return Sql(record.text, tests=ip.present())


def user_actor(**fields: Sql) -> Sql:
    return B.record(S.ACTOR, user=B.record(S.USER, **fields))


def os_record(name: Sql, os_id: Sql) -> Sql:
    return B.record(S.OS, name=name, type=sc.lookup(sc.OS_LABELS, os_id), type_id=os_id)


def file_record(schema, name: Sql, path: Sql, sha256: Sql, md5: Sql) -> Sql:
    return B.record(
        schema,
        name=name,
        path=path,
        hashes=B.arr(sc.hash_record("SHA-256", sha256), sc.hash_record("MD5", md5)),
    )
