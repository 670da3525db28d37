"""Microsoft Defender: the ``evidence`` list is folded by ``@odata.type``."""

from __future__ import annotations


from alertloom import schemas as S
from alertloom.functions import build as B
from alertloom.functions import scalars as sc
from alertloom.functions import variants as V
from alertloom.functions.sql import F, Sql
from alertloom.operators.vendors.common import (
    Leaves,
    Vendor,
    any_of,
    attack,
    defaulted,
    endpoint,
    info,
    metadata,
    user_actor,
)

_KIND = "#microsoft.graph.security."


def _evidence(e: Sql) -> Sql:
    kind = V.text(e, "@odata.type")
    of = lambda name, value: F.when(kind == _KIND + name, value)
    return F.struct(
        F.coalesce(
            of("mailboxEvidence", V.truthy(e, "userAccount", "accountName")),
            of("userEvidence", V.truthy(e, "userAccount", "accountName")),
        ).alias("user"),
        F.coalesce(
            of("mailboxEvidence", V.truthy(e, "primaryAddress")),
            of("userEvidence", V.truthy(e, "userAccount", "userPrincipalName")),
        ).alias("email"),
        F.coalesce(
            of("analyzedMessageEvidence", V.truthy(e, "senderIp")),
            of("ipEvidence", V.truthy(e, "ipAddress")),
        ).alias("ip"),
        of("analyzedMessageEvidence", V.truthy(e, "subject")).alias("subject"),
        of("analyzedMessageEvidence", V.truthy(e, "sender")).alias("sender"),
        of("analyzedMessageEvidence", V.truthy_items(e, "recipients")).alias("recipients"),
        F.coalesce(
            of("analyzedMessageEvidence", V.truthy_items(e, "urls")),
            of("urlEvidence", B.arr(V.truthy(e, "url"))),
        ).alias("urls"),
        of("processEvidence", F.nullif(V.integer(e, "processId"), F.lit(0).cast("long"))).alias("pid"),
        of(
            "processEvidence",
            B.record(
                S.FILE, name=V.truthy(e, "imageFile", "name"), path=V.truthy(e, "imageFile", "path")
            ),
        ).alias("file"),
    )


def _fold(evidence: Sql) -> Sql:
    """First value of each scalar, all values of the lists, in list order."""
    first = lambda name: V.pick_first(evidence, lambda e: e[name]).alias(name)
    every = lambda name: F.flatten(
        F.filter(F.transform(evidence, lambda e: e[name]), lambda t: t.isNotNull())
    )
    scalars = ("user", "email", "ip", "subject", "sender", "pid", "file")
    return F.struct(
        *[first(n) for n in scalars],
        B.nonempty_array(every("recipients")).alias("recipients"),
        every("urls").alias("urls"),
    )


def leaves(a: Sql) -> dict[str, Sql]:
    return {
        "title": V.truthy(a, "title"),
        "uid": V.first_truthy(a, "id", "alertId", "providerAlertId"),
        "desc": V.truthy(a, "description"),
        "category": V.truthy(a, "category"),
        "created": sc.time_text(a, "createdDateTime"),
        "url": V.first_truthy(a, "alertWebUrl", "incidentWebUrl"),
        "techniques": V.truthy_items(a, "mitreTechniques"),
        "product": V.truthy(a, "productName"),
        "severity": V.text(a, "severity"),
        "status": V.truthy(a, "status"),
        "seen": V.let(V.over(V.items(a, "evidence"), _evidence), _fold),
        "detection_source": V.truthy_value(a, "detectionSource"),
        "incident_id": V.truthy(a, "incidentId"),
        "detector_id": V.truthy(a, "detectorId"),
        "provider_alert_id": V.truthy(a, "providerAlertId"),
        "bad_type": any_of(V.truthy_not_text(a, "status")),
    }


def build(x: Leaves) -> dict[str, Sql]:
    seen = x.seen
    src_ip, user_email, urls = seen["ip"], seen["email"], seen["urls"]
    status_id = sc.lookup(sc.DEFENDER_STATUSES, F.replace(F.lower(x.status), F.lit(" "), F.lit("")))
    mail = B.record(
        S.EVIDENCE,
        src_endpoint=endpoint(src_ip),
        email=B.record(
            S.EMAIL,
            subject=seen["subject"],
            to=seen["recipients"],
            **{"from": seen["sender"]},
        ),
    )
    user = B.record(S.EVIDENCE, actor=user_actor(name=seen["user"], email_addr=user_email))
    process = B.record(
        S.EVIDENCE, process=B.record(S.PROCESS, pid=seen["pid"], file=seen["file"])
    )
    raw = B.joined(
        B.list_of(
            sc.raw_observable("evidences[].src_endpoint.ip", "IP Address", src_ip),
            sc.raw_observable("evidences[].actor.user.email_addr", "Email Address", user_email),
        ),
        F.transform(urls, lambda u: sc.raw_observable("evidences[].email.url", "URL", u)),
    )
    return {
        "finding_info": info(
            x,
            desc=x.desc,
            types=B.arr(x.category),
            created_time=defaulted(x.created, x.as_of),
            src_url=x.url,
            attacks=F.transform(x.techniques, lambda t: attack(technique_uid=t)),
        ),
        "metadata": metadata(
            F.coalesce(x.product, F.lit("Microsoft Defender for Office 365")), "Microsoft"
        ),
        "time": x.created,
        "severity_id": sc.text_severity(x.severity),
        "status_id": status_id,
        "status": F.coalesce(sc.status_label(status_id), x.status),
        "evidences": B.arr(mail, user, process),
        "observables": raw,
        "unmapped": B.free_map(
            detection_source=x.detection_source,
            incident_id=x.incident_id,
            detector_id=x.detector_id,
            provider_alert_id=x.provider_alert_id,
        ),
    }


VENDOR = Vendor("microsoft", leaves, build, aliases=("microsoft_defender",))
