"""One full alert per vendor, then the reasons for which an alert is skipped."""

import json

import pytest
from pyspark.sql import functions as F

from alertloom.operators import label, validate
from alertloom.operators.vendors import BUILT_IN, registry
from alertloom.operators.vendors.common import Vendor

AS_OF = "timestamp'2024-01-31 00:00:00'"
HEAD = {
    "activity_id": 1, "activity_name": "Create", "category_uid": 2, "category_name": "Findings",
    "class_uid": 2004, "class_name": "Detection Finding", "type_uid": 200401,
}
GRAPH = "#microsoft.graph.security."

ALERTS = {
    "expel": {"source": " Expel ", "alert": {"id": 5, "attributes": {
        "title": "T", "short_link": "http://x", "created_at": "2024-01-05T10:11:12.1234567Z", "analyst_severity": "HIGH",
        "is_incident": False, "attack_lifecycle": "c2", "threat_type": ["a"]}}},
    "logrhythm": {"source": "logrhythm", "alert": {"alarmDetails": {
        "alarmRuleName": "AIE: MITRE-TA0001 x MITRE-TA0002", "alarmId": 12, "dateInserted": 1704449472000, "rbpMax": "65",
        "alarmStatus": 3, "eventCount": 2, "entityName": "host1", "lastUpdatedName": "bob"}}},
    "paloalto": {"source": "palo_alto", "alert": {
        "name": "PA", "alert_id": 7, "category": "Malware", "mitre_tactic_id_and_name": "TA0005 - Defense Evasion",
        "mitre_technique_id_and_name": "Weird", "detection_timestamp": 1704449472, "severity": "high",
        "host_ip": " 1.2.3.4, 5.6.7.8", "agent_os_type": "Windows", "action_file_name": "a.exe", "action_file_sha256": "abc",
        "action_file_md5": "0000-00", "user_name": "N/A", "action_remote_ip": "1.2.3.4", "action_remote_port": "443"}},
    "crowdstrike": {"source": "crowdstrike", "alert": {
        "display_name": "CS", "id": "u1", "pattern_id": 10, "timestamp": "2024-01-05T10:11:12+0530", "severity": 70,
        "confidence": "80", "status": "NEW", "device": {"hostname": "h", "local_ip": "10.0.0.1", "external_ip": "10.0.0.1",
        "platform_name": "Windows", "device_id": "d1"}, "sha256": "ff", "local_process_id": "12",
        "parent_details": {"cmdline": "p"}, "grandparent_details": {"cmdline": "g"}, "user_name": "bob", "logon_domain": "D",
        "network_accesses": [{"remote_address": "8.8.8.8", "remote_port": 53}, "x", {}],
        "dns_requests": [{"domain_name": "d.com"}, {"domain_name": "d.com"}], "ioc_type": "domain", "ioc_value": "d.com"}},
    "splunk": {"source": "splunk", "alert": {
        "search_name": "SS", "annotations.mitre_attack": ["b", "a"], "annotations": '{"mitre_attack":["c","a"]}',
        "_time": "1704449472.5", "urgency": "Low", "status": 2, "src_ip": ["1.1.1.1", "2.2.2.2"], "dest": "host",
        "user": "bob", "orig_host": "1.1.1.1", "sid": 12}},
    "microsoft": {"source": "microsoft", "alert": {
        "title": "MS", "id": "m1", "createdDateTime": "2024-01-05T10:11:12Z", "status": "Weird",
        "mitreTechniques": ["T1", None, "T2"], "evidence": [
            {"@odata.type": GRAPH + "mailboxEvidence", "userAccount": {"accountName": "al"}, "primaryAddress": "al@x"},
            {"@odata.type": GRAPH + "analyzedMessageEvidence", "senderIp": "9.9.9.9", "subject": "s", "sender": "q@x",
             "recipients": ["r1", None], "urls": ["u1", "u2"]},
            {"@odata.type": GRAPH + "urlEvidence", "url": "u1"},
            {"@odata.type": GRAPH + "processEvidence", "processId": "77", "imageFile": {"name": "n"}}]}},
    "sentinel": {"source": "sentinel", "alert": {
        "name": "n1", "properties": {"title": "SE", "incidentNumber": 0, "createdTimeUtc": {"$date": "1704449472000"},
        "severity": "Medium", "status": "Active", "additionalData": {"tactics": ["A", "B"], "techniques": ["T1"], "alertsCount": 3}},
        "entities": [{"kind": "Ip", "properties": {"address": "4.4.4.4"}}, {"kind": "Ip", "properties": {"friendlyName": "4.4.4.4"}},
            {"kind": "Account", "properties": {"accountName": "a", "upnSuffix": "x.com"}}, {"kind": "Url", "properties": {"url": "/x"}},
            {"kind": "Url", "properties": {"url": "http://x"}}, {"kind": "MailMessage", "properties": {"subject": "s1", "sender": "q"}},
            {"kind": "MailMessage", "properties": {"subject": "s2"}}]}},
    "trendmicro": {"source": "trend_micro", "alert": {
        "model": "TM", "id": "w1", "score": 64, "createdAt": "bad time", "matchedRules": [{"name": "R1", "matchedFilters": [
            {"mitreTechniqueIds": ["T1", "T2"]}, {"mitreTechniqueIds": ["T1"]}]}],
        "indicators": [{"type": "fullpath", "value": "C:\\x\\y.exe"}, {"type": "file_sha256", "value": "aa"},
            {"type": "file_sha256", "value": "aa"}, {"type": "ip", "value": "5.5.5.5"},
            {"type": "host", "value": {"name": "h", "ips": ["1.1.1.1"]}}, {"type": "process_id", "value": 0},
            {"type": "process_id", "value": 5}, {"type": "registry_key", "value": "k1"}, {"type": "registry_key", "value": "k2"}],
        "impactScope": {"entities": [{"entityType": "account", "entityValue": "acc"}]}}},
}

SKIPPED = {
    "unknown_source": {"source": "nope", "alert": {}},
    "missing_source": {"alert": {}},
    "missing_required": {"source": "expel", "alert": {"id": 1}},
    "bad_type": {"source": "crowdstrike", "alert": {"name": "a", "id": 1, "status": 5}},
    "bad_json": "{bad",
}


@pytest.fixture(scope="module")
def mapped(spark):
    rows = [(k, json.dumps(v)) for k, v in ALERTS.items()]
    rows += [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in SKIPPED.items()]
    df = spark.createDataFrame(rows, "key string, raw_log string")
    out = label.map_alerts(df, as_of=AS_OF).select("key", "skip_reason", "time_defaulted", F.to_json("finding").alias("j"))
    return {r.key: (r.skip_reason, r.time_defaulted, json.loads(r.j) if r.j else None) for r in out.collect()}


def finding(mapped, vendor):
    reason, _, doc = mapped[vendor]
    assert reason is None
    assert {k: doc[k] for k in HEAD} == HEAD
    return doc


@pytest.mark.parametrize("reason", SKIPPED)
def test_skip_reasons(mapped, reason):
    assert mapped[reason][0] == reason and mapped[reason][2] is None


def test_expel(mapped):
    f = finding(mapped, "expel")
    assert f["finding_info"] == {"title": "T", "uid": "5", "src_url": "http://x", "attacks": [{"tactic": {"name": "Command and Control"}}]}
    assert (f["severity_id"], f["severity"], f["status_id"], f["time"]) == (4, "High", 1, "2024-01-05T10:11:12Z")
    assert f["unmapped"] == {"threat_type": ["a"]}


def test_logrhythm(mapped):
    f = finding(mapped, "logrhythm")
    assert [a["tactic"]["uid"] for a in f["finding_info"]["attacks"]] == ["TA0001", "TA0002"]
    assert (f["severity_id"], f["status_id"], f["count"], f["device"]) == (4, 4, 2, {"hostname": "host1"})
    assert f["vendor_attributes"] == {"rbp_max": "65"} and f["time"] == "2024-01-05T10:11:12Z"


def test_paloalto(mapped):
    f = finding(mapped, "paloalto")
    assert f["finding_info"]["attacks"] == [{"tactic": {"name": "Defense Evasion", "uid": "TA0005"}, "technique": {"name": "Weird"}}]
    assert f["device"]["ip"] == "1.2.3.4" and f["device"]["os"]["type_id"] == 100
    # A zero hash and the placeholder user leave no trace; the repeated address is one observable.
    assert f["evidences"][0]["process"]["file"]["hashes"] == [{"algorithm": "SHA-256", "algorithm_id": 3, "value": "abc"}]
    assert "actor" not in f["evidences"][0]
    assert [o["value"] for o in f["observables"]] == ["1.2.3.4", "a.exe", "abc"]


def test_crowdstrike(mapped):
    f = finding(mapped, "crowdstrike")
    assert f["time"] == "2024-01-05T04:41:12Z" and f["metadata"]["original_time"] == "2024-01-05T10:11:12+0530"
    process = f["evidences"][0]["process"]
    assert process["pid"] == 12 and process["parent_process"] == {"cmd_line": "p", "parent_process": {"cmd_line": "g"}}
    assert f["evidences"][1] == {"dst_endpoint": {"ip": "8.8.8.8", "port": 53}}
    assert [o["value"] for o in f["observables"]] == ["10.0.0.1", "ff", "d.com", "8.8.8.8"]
    assert f["device"]["agent"] == [{"name": "Falcon", "uid": "d1"}]
    assert f["vendor_attributes"] == {"severity": 70} and f["unmapped"] == {"pattern_id": 10}


def test_splunk(mapped):
    f = finding(mapped, "splunk")
    assert [a["tactic"]["name"] for a in f["finding_info"]["attacks"]] == ["a", "b", "c"]
    assert f["finding_info"]["uid"] == "splunk-unknown" and f["status_id"] == 2
    assert f["evidences"] == [{"actor": {"user": {"name": "bob"}}, "src_endpoint": {"ip": "1.1.1.1"}}]
    assert [(o["value"], o["type_id"]) for o in f["observables"]] == [("1.1.1.1", 2), ("bob", 0)]


def test_microsoft(mapped):
    f = finding(mapped, "microsoft")
    assert "status_id" not in f and f["status"] == "Weird"
    assert f["evidences"] == [
        {"src_endpoint": {"ip": "9.9.9.9"}, "email": {"from": "q@x", "to": ["r1"], "subject": "s"}},
        {"actor": {"user": {"name": "al", "email_addr": "al@x"}}},
        {"process": {"pid": 77, "file": {"name": "n"}}},
    ]
    assert [o["value"] for o in f["observables"]] == ["9.9.9.9", "al@x", "u1", "u2"]


def test_sentinel(mapped):
    f = finding(mapped, "sentinel")
    assert f["finding_info"]["uid"] == "n1"
    assert f["finding_info"]["attacks"] == [{"tactic": {"name": "A"}, "technique": {"uid": "T1"}}, {"tactic": {"name": "B"}}]
    assert f["evidences"][1]["email"] == {"from": "q", "subject": "s2"}
    assert [o["value"] for o in f["observables"]] == ["4.4.4.4", "http://x"]
    assert f["unmapped"] == {"alerts_count": 3} and f["time"] == "2024-01-05T10:11:12Z"


def test_trendmicro(mapped):
    f = finding(mapped, "trendmicro")
    assert mapped["trendmicro"][1] is True and f["time"] == "2024-01-31T00:00:00Z"
    assert f["evidences"][0]["process"]["pid"] == 5 and f["evidences"][0]["actor"]["user"]["name"] == "acc"
    assert f["evidences"][0]["process"]["file"]["name"] == "y.exe"
    assert [o["value"] for o in f["observables"]] == ["5.5.5.5", "aa", "y.exe"]
    assert f["unmapped"] == {"registry_key": "k2"}


def test_source_names_are_unique():
    assert registry()["palo_alto"] == "paloalto" and len(registry()) == 11
    twice = Vendor("mine", lambda a: {}, lambda x: {}, aliases=("splunk",))
    with pytest.raises(ValueError):
        registry((*BUILT_IN, twice))


def test_raw_values_keep_no_empties_and_findings_pass_the_label_check(spark):
    alert = {"name": "n", "composite_id": "c", "created_timestamp": "2024-01-01T00:00:00Z", "severity": 50, "data_domains": [[], {"z": ""}],
             "scenario": {"a": None, "b": "", "c": [1, "", {}, [None]], "d": {"e": []}, "f": 'null,"",[] "x" {}', 'g"h': False, "i": 0}}
    df = spark.createDataFrame([(json.dumps({"source": "crowdstrike", "alert": alert}),)], "raw_log string")
    mapped = label.map_alerts(df).select("skip_reason", F.to_json("finding").alias("ocsf"))
    row = validate.check_labels(mapped).first()
    assert row.skip_reason is None and row.errors == []
    assert json.loads(row.ocsf)["unmapped"]["scenario"] == {"c": [1], "f": 'null,"",[] "x" {}', 'g"h': False, "i": 0}
    assert "data_domains" not in json.loads(row.ocsf)["unmapped"]
