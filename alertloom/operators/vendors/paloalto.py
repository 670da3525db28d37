"""Palo Alto Cortex XDR."""

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
    endpoint,
    file_record,
    info,
    metadata,
    os_record,
    user_actor,
)


def leaves(a: Sql) -> dict[str, Sql]:
    return {
        "title": V.truthy(a, "name"),
        "uid": V.first_truthy(a, "alert_id", "external_id"),
        "desc": V.truthy(a, "description"),
        "category": V.truthy(a, "category"),
        "tactic": V.truthy(a, "mitre_tactic_id_and_name"),
        "technique": V.truthy(a, "mitre_technique_id_and_name"),
        "product": V.truthy(a, "source"),
        "time": sc.first_time_text(a, "detection_timestamp", "event_timestamp", "local_insert_ts"),
        "severity": V.text(a, "severity"),
        "host_name": V.truthy(a, "host_name"),
        "host_ip": sc.first_of_comma_list(V.truthy(a, "host_ip")),
        "mac": sc.first_of_comma_list(V.truthy(a, "mac")),
        "endpoint_id": V.truthy(a, "endpoint_id"),
        "os_name": V.first_truthy(a, "agent_os_sub_type", "agent_os_type"),
        "os_type": F.lower(V.truthy(a, "agent_os_type")),
        "cmd_line": V.first_truthy(
            a, "action_process_image_command_line", "action_process_cmdline"
        ),
        "file_name": V.truthy(a, "action_file_name"),
        "file_path": V.truthy(a, "action_file_path"),
        "sha256": V.truthy(a, "action_file_sha256"),
        "md5": V.truthy(a, "action_file_md5"),
        "user": F.nullif(V.truthy(a, "user_name"), F.lit("N/A")),
        "remote_ip": V.truthy(a, "action_remote_ip"),
        "remote_port": V.integer(a, "action_remote_port"),
        "local_ip": V.truthy(a, "action_local_ip"),
        "local_port": V.integer(a, "action_local_port"),
        "module_id": V.truthy_value(a, "module_id"),
        "alert_type": V.truthy_value(a, "alert_type"),
        "matching_status": V.truthy_value(a, "matching_status"),
        "external_id": V.truthy(a, "external_id"),
        "bad_type": any_of(
            V.truthy_not_text(a, "agent_os_type"),
            V.truthy_not_text(a, "action_file_sha256"),
            V.truthy_not_text(a, "action_file_md5"),
        ),
    }


def build(x: Leaves) -> dict[str, Sql]:
    file = file_record(S.FILE, x.file_name, x.file_path, x.sha256, x.md5)
    evidence = B.record(
        S.EVIDENCE,
        process=B.record(S.PROCESS, cmd_line=x.cmd_line, file=file),
        actor=user_actor(name=x.user),
        src_endpoint=endpoint(x.local_ip, x.local_port),
        dst_endpoint=endpoint(x.remote_ip, x.remote_port),
    )
    raw = B.list_of(
        sc.raw_observable("device.ip", "IP Address", x.host_ip),
        sc.raw_observable("evidences[].dst_endpoint.ip", "IP Address", x.remote_ip),
        sc.raw_observable("evidences[].process.file.name", "File Name", x.file_name),
        sc.raw_observable(
            "evidences[].process.file.hashes.SHA-256",
            "Hash",
            sc.hash_value(x.sha256),
        ),
        sc.raw_observable(
            "evidences[].process.file.hashes.MD5", "Hash", sc.hash_value(x.md5)
        ),
    )
    return {
        "finding_info": info(
            x,
            desc=x.desc,
            types=B.arr(x.category),
            attacks=B.arr(
                attack(
                    sc.mitre_name(x.tactic),
                    sc.mitre_uid(x.tactic),
                    sc.mitre_name(x.technique),
                    sc.mitre_uid(x.technique),
                )
            ),
        ),
        "metadata": metadata(F.coalesce(x.product, F.lit("Cortex XDR")), "Palo Alto Networks"),
        "time": x.time,
        "severity_id": sc.text_severity(x.severity),
        "device": B.record(
            S.DEVICE,
            hostname=x.host_name,
            ip=x.host_ip,
            mac=x.mac,
            uid=x.endpoint_id,
            os=os_record(x.os_name, sc.lookup(sc.PALOALTO_OS, x.os_type)),
        ),
        "evidences": B.arr(evidence),
        "observables": raw,
        "unmapped": B.free_map(
            module_id=x.module_id,
            alert_type=x.alert_type,
            matching_status=x.matching_status,
            endpoint_id=x.endpoint_id,
            external_id=x.external_id,
        ),
    }


VENDOR = Vendor("paloalto", leaves, build, aliases=("palo_alto",))
