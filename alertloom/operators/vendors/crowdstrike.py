"""CrowdStrike Falcon."""

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
    file_record,
    info,
    metadata,
    os_record,
    rule,
    user_actor,
)

_TEXTS = ("status", "sha256", "md5", "ioc_type")
_OBJECTS = ("device", "parent_details", "grandparent_details")


def leaves(a: Sql) -> dict[str, Sql]:
    dev = lambda name: V.truthy(a, "device", name)
    return {
        "title": V.first_truthy(a, "display_name", "name"),
        "uid": V.first_truthy(a, "composite_id", "id", "indicator_id"),
        "desc": V.truthy(a, "description"),
        "src_url": V.truthy(a, "falcon_host_link"),
        "created": sc.time_text(a, "created_timestamp"),
        "rule": V.first_truthy(a, "name", "display_name"),
        "pattern": V.nonempty(a, "pattern_id"),
        "pattern_value": V.nonempty_value(a, "pattern_id"),
        "tactic": V.truthy(a, "tactic"),
        "tactic_id": V.truthy(a, "tactic_id"),
        "technique": V.truthy(a, "technique"),
        "technique_id": V.truthy(a, "technique_id"),
        "product": V.truthy(F.get(V.items(a, "source_products"), 0)),
        "vendor": V.truthy(F.get(V.items(a, "source_vendors"), 0)),
        "original_time": V.first_truthy(a, "timestamp", "created_timestamp"),
        "time": sc.first_time_text(a, "timestamp", "created_timestamp", "context_timestamp"),
        "start_time": sc.time_text(a, "start_timestamp"),
        "end_time": sc.time_text(a, "end_timestamp"),
        "severity": V.integer(a, "severity"),
        "severity_value": V.nonempty_value(a, "severity"),
        "confidence": V.integer(a, "confidence"),
        "status": F.lower(V.truthy(a, "status")),
        "hostname": dev("hostname"),
        "ip": dev("local_ip"),
        "external_ip": dev("external_ip"),
        "mac": dev("mac_address"),
        "agent_id": F.coalesce(dev("device_id"), dev("agent_id")),
        "agent_version": dev("agent_version"),
        "os_version": dev("os_version"),
        "platform": F.lower(dev("platform_name")),
        "device_type": dev("product_type_desc"),
        "cmdline": V.truthy(a, "cmdline"),
        "filename": V.truthy(a, "filename"),
        "filepath": V.truthy(a, "filepath"),
        "sha256": V.truthy(a, "sha256"),
        "md5": V.truthy(a, "md5"),
        "pid": V.integer(a, "local_process_id"),
        **_ancestor(a, "parent", "parent_details"),
        **_ancestor(a, "grand", "grandparent_details"),
        "user": V.truthy(a, "user_name"),
        "domain": V.truthy(a, "logon_domain"),
        "network": F.filter(V.over(
            V.items(a, "network_accesses"),
            lambda n: F.struct(
                V.first_truthy(n, "local_address", "local_ip").alias("local_ip"),
                V.integer(n, "local_port").alias("local_port"),
                V.first_truthy(n, "remote_address", "remote_ip").alias("remote_ip"),
                V.integer(n, "remote_port").alias("remote_port"),
            ),
        ), lambda n: n["local_ip"].isNotNull() | n["remote_ip"].isNotNull()),
        "ioc_type": F.lower(V.truthy(a, "ioc_type")),
        "ioc_value": V.truthy(a, "ioc_value"),
        "dns": F.array_compact(
            V.over(V.items(a, "dns_requests"), lambda d: V.truthy(d, "domain_name"))
        ),
        "scenario": V.truthy_value(a, "scenario"),
        "data_domains": V.truthy_value(a, "data_domains"),
        "aggregate_id": V.truthy_value(a, "aggregate_id"),
        "control_graph_id": V.truthy_value(a, "control_graph_id"),
        "bad_type": any_of(
            *[V.truthy_not_text(a, n) for n in _TEXTS],
            *[V.truthy_not_object(a, n) for n in _OBJECTS],
            V.truthy_not_text(a, "device", "platform_name"),
            V.text(a, "confidence").isNotNull() & V.integer(a, "confidence").isNull(),
        ),
    }


def _ancestor(a: Sql, prefix: str, key: str) -> dict[str, Sql]:
    return {
        f"{prefix}_cmdline": V.truthy(a, key, "cmdline"),
        f"{prefix}_pid": V.integer(a, key, "local_process_id"),
        f"{prefix}_filename": V.truthy(a, key, "filename"),
        f"{prefix}_filepath": V.truthy(a, key, "filepath"),
        # A grandparent is used only beside a parent object that is not empty.
        f"{prefix}_given": V.truthy(a, key).isNotNull(),
    }


def build(x: Leaves) -> dict[str, Sql]:
    return {
        "finding_info": info(
            x,
            desc=x.desc,
            src_url=x.src_url,
            created_time=defaulted(x.created, x.as_of),
            analytic=rule(x.rule, x.pattern),
            attacks=B.arr(attack(x.tactic, x.tactic_id, x.technique, x.technique_id)),
        ),
        "metadata": metadata(
            F.coalesce(x.product, F.lit("Falcon")),
            F.coalesce(x.vendor, F.lit("CrowdStrike")),
            x.original_time,
        ),
        "time": x.time,
        "start_time": x.start_time,
        "end_time": x.end_time,
        "severity_id": sc.crowdstrike_severity(x.severity),
        "confidence_score": x.confidence,
        "status_id": sc.lookup(sc.CROWDSTRIKE_STATUSES, x.status),
        "device": _device(x),
        "evidences": _evidences(x),
        "observables": _raw_observables(x),
        "vendor_attributes": B.free_map(severity=x.severity_value),
        "unmapped": B.free_map(
            scenario=x.scenario,
            pattern_id=x.pattern_value,
            data_domains=x.data_domains,
            aggregate_id=x.aggregate_id,
            control_graph_id=x.control_graph_id,
        ),
    }


def _device(x: Leaves) -> Sql:
    agent = F.when(
        x.agent_id.isNotNull() | x.agent_version.isNotNull(),
        B.always(S.AGENT, name=F.lit("Falcon"), uid=x.agent_id, version=x.agent_version),
    )
    return B.record(
        S.DEVICE,
        hostname=x.hostname,
        ip=x.ip,
        mac=x.mac,
        uid=x.agent_id,
        type=x.device_type,
        os=os_record(x.os_version, sc.lookup(sc.CROWDSTRIKE_OS, x.platform)),
        agent=B.arr(agent),
    )


def _evidences(x: Leaves) -> Sql:
    grand = B.record(
        S.GRANDPARENT_PROCESS,
        cmd_line=x.grand_cmdline,
        pid=x.grand_pid,
        file=B.record(S.FILE, name=x.grand_filename, path=x.grand_filepath),
    )
    parent = B.record(
        S.PARENT_PROCESS,
        cmd_line=x.parent_cmdline,
        pid=x.parent_pid,
        file=B.record(S.FILE, name=x.parent_filename, path=x.parent_filepath),
        parent_process=F.when(x.parent_given, grand),
    )
    process = B.record(
        S.PROCESS,
        cmd_line=x.cmdline,
        pid=x.pid,
        file=file_record(S.FILE, x.filename, x.filepath, x.sha256, x.md5),
        parent_process=parent,
    )
    first = B.record(
        S.EVIDENCE,
        process=process,
        actor=user_actor(name=x.user, account=B.record(S.ACCOUNT, name=x.domain)),
    )
    network = F.transform(
        x.network,
        lambda n: B.always(
            S.EVIDENCE,
            src_endpoint=endpoint(n["local_ip"], n["local_port"]),
            dst_endpoint=endpoint(n["remote_ip"], n["remote_port"]),
        ),
    )
    return F.when(
        first.isNotNull() | (F.size(x.network) > 0), B.joined(B.list_of(first), network)
    )


def _raw_observables(x: Leaves) -> Sql:
    known = x.ioc_type.isin(*sc.IOC_FIELDS)
    single = B.list_of(
        sc.raw_observable("device.ip", "IP Address", x.ip),
        sc.raw_observable("device.external_ip", "IP Address", x.external_ip),
        sc.raw_observable("evidences[].process.file.name", "File Name", x.filename),
        sc.raw_observable(
            "evidences[].process.file.hashes.SHA-256",
            "Hash",
            sc.hash_value(x.sha256),
        ),
        sc.raw_observable(
            "evidences[].process.file.hashes.MD5", "Hash", sc.hash_value(x.md5)
        ),
        sc.raw_observable(
            sc.lookup(sc.IOC_FIELDS, x.ioc_type),
            sc.lookup(sc.IOC_TYPES, x.ioc_type),
            F.when(known, x.ioc_value),
        ),
    )
    domains = F.transform(
        x.dns, lambda d: sc.raw_observable("evidences[].dst_endpoint.domain", "Domain", d)
    )
    remotes = F.transform(
        F.filter(x.network, lambda n: n["remote_ip"].isNotNull()),
        lambda n: sc.raw_observable("evidences[].dst_endpoint.ip", "IP Address", n["remote_ip"]),
    )
    return B.joined(single, domains, remotes)


VENDOR = Vendor("crowdstrike", leaves, build)
