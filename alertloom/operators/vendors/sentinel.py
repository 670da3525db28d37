"""Microsoft Sentinel incidents: the ``entities`` list is folded by ``kind``."""

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
    endpoint,
    metadata,
    user_actor,
)


def _entity(e: Sql) -> Sql:
    kind = V.text(e, "kind")
    prop = lambda *names: F.coalesce(*[V.truthy(e, "properties", n) for n in names])
    of = lambda name, value: F.when(kind == name, value)
    url = prop("url", "friendlyName")
    account_name = F.coalesce(V.text(e, "properties", "accountName"), F.lit(""))
    return F.struct(
        F.coalesce(
            of("Ip", prop("address", "friendlyName")), of("MailMessage", prop("senderIp"))
        ).alias("src_ip"),
        of("Host", prop("hostName")).alias("hostname"),
        of("Host", prop("osFamily")).alias("os"),
        of("Host", prop("dnsDomain")).alias("domain"),
        of("Account", prop("accountName")).alias("user"),
        F.coalesce(
            of("Account", F.concat(account_name, F.lit("@"), prop("upnSuffix"))),
            of("Mailbox", prop("mailboxPrimaryAddress")),
        ).alias("email"),
        of("MailMessage", prop("subject")).alias("subject"),
        of("MailMessage", prop("sender", "senderAddress")).alias("sender"),
        F.coalesce(
            of(
                "Ip",
                sc.raw_observable(
                    "evidences[].src_endpoint.ip", "IP Address", prop("address", "friendlyName")
                ),
            ),
            of(
                "Url",
                F.when(
                    ~url.startswith("/"),
                    sc.raw_observable("evidences[].dst_endpoint.url", "URL", url),
                ),
            ),
        ).alias("observable"),
    )


def _fold(entities: Sql) -> Sql:
    first = lambda name: V.pick_first(entities, lambda e: e[name]).alias(name)
    last = lambda name: V.pick_last(entities, lambda e: e[name]).alias(name)
    return F.struct(
        *[first(n) for n in ("src_ip", "hostname", "os", "user", "email", "sender")],
        *[last(n) for n in ("domain", "subject")],
        F.array_compact(F.transform(entities, lambda e: e["observable"])).alias("observables"),
    )


def leaves(a: Sql) -> dict[str, Sql]:
    prop = lambda *names: ("properties", *names)
    extra = lambda name: ("properties", "additionalData", name)
    texts = lambda name: F.transform(V.items(a, *extra(name)), lambda e: V.truthy(e))
    return {
        "title": V.truthy(a, *prop("title")),
        "uid": F.coalesce(V.truthy(a, *prop("incidentNumber")), V.text(a, "name")),
        "desc": V.truthy(a, *prop("description")),
        "url": V.truthy(a, *prop("incidentUrl")),
        "tactics": texts("tactics"),
        "techniques": texts("techniques"),
        "product": V.truthy(F.get(V.items(a, *extra("alertProductNames")), 0)),
        "time": sc.time_text(a, *prop("createdTimeUtc")),
        "severity": V.text(a, *prop("severity")),
        "status": V.truthy(a, *prop("status")),
        "seen": V.let(V.over(V.items(a, "entities"), _entity), _fold),
        "provider_incident_id": V.truthy(a, *prop("providerIncidentId")),
        "alerts_count": V.nonempty_value(a, *extra("alertsCount")),
        "bad_type": any_of(
            V.truthy_not_object(a, "properties"),
            V.truthy_not_object(a, *prop("additionalData")),
            V.truthy_not_text(a, *prop("status")),
        ),
    }


def build(x: Leaves) -> dict[str, Sql]:
    seen = x.seen
    status_id = sc.lookup(sc.SENTINEL_STATUSES, F.lower(strip(x.status)))
    pairs = F.arrays_zip(
        F.coalesce(x.tactics, F.array()), F.coalesce(x.techniques, F.array())
    )
    attacks = F.transform(pairs, lambda p: attack(tactic_name=p["0"], technique_uid=p["1"]))
    user = B.record(S.EVIDENCE, actor=user_actor(name=seen["user"], email_addr=seen["email"]))
    mail = B.record(
        S.EVIDENCE,
        src_endpoint=endpoint(seen["src_ip"]),
        email=B.record(S.EMAIL, subject=seen["subject"], **{"from": seen["sender"]}),
    )
    return {
        "finding_info": B.always(
            S.FINDING_INFO,
            title=x.title,
            uid=B.some_text(x.uid),
            desc=x.desc,
            src_url=x.url,
            attacks=B.nonempty_array(F.array_compact(attacks)),
        ),
        "metadata": metadata(F.coalesce(x.product, F.lit("Microsoft Sentinel")), "Microsoft"),
        "time": x.time,
        "severity_id": sc.text_severity(x.severity),
        "status_id": status_id,
        "status": F.coalesce(sc.status_label(status_id), x.status),
        "device": B.record(
            S.DEVICE,
            hostname=seen["hostname"],
            domain=seen["domain"],
            os=B.record(S.OS, name=seen["os"]),
        ),
        "evidences": B.arr(user, mail),
        "observables": seen["observables"],
        "unmapped": B.free_map(
            provider_incident_id=x.provider_incident_id, alerts_count=x.alerts_count
        ),
    }


VENDOR = Vendor("sentinel", leaves, build, distinct_values=True)
