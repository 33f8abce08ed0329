"""Vendor records, exports, address classes, indicators and roles: literal cases with the values that they must give."""

import json

from pyspark.sql import functions as F

from lumenwatch.functions import redaction
from lumenwatch.operators import context
from lumenwatch.sources import mappers


def mapped(spark, name, *records):
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    out = mappers.MAPPERS[name](spark.createDataFrame(rows, "n int, body string"), "n").orderBy("n").collect()
    return [{k: v for k, v in r.asDict().items() if v is not None and k not in ("n", "source", "log_product", "log_service")} for r in out]


def test_sign_ins(spark):
    told = {"actor": [{"type": "User", "alternateId": "alice@example.com"}], "client": {"ipAddress": "198.51.100.25"}, "target": [{"id": "0oa", "alternateId": "Salesforce"}], "eventType": "user.session.start", "published": "2026-08-04T10:08:00Z"}
    same = {"ts_text": "2026-08-04T10:08:00Z", "user_name": "alice@example.com", "src_ip": "198.51.100.25", "category": "authentication", "resource": "Salesforce"}
    assert mapped(spark, "okta", told | {"outcome": {"result": "FAILURE"}}, told | {"outcome": {"result": "SUCCESS"}}, "not json") == [same | {"action": "login_failed", "outcome": "failure"}, same | {"action": "login", "outcome": "success"}, {"action": "okta_event", "outcome": "success"}]
    got = mapped(spark, "entra", {"resultType": "50126"}, {"resultType": "0"}, {}, {"resultType": "failure"}, {"resultType": None, "result": "Success"}, {"resultType": " doesNotApply "}, {"resultType": "interrupted"})
    assert [(r["action"], r["outcome"], r.get("result_code")) for r in got] == [("login_failed", "failure", "50126"), ("login", "success", "0"), ("login", "unknown", None), ("login_failed", "failure", "failure"), ("login", "success", "Success"), ("login_failed", "failure", "doesNotApply"), ("login", "interrupted", "interrupted")]


def test_audit_and_assets(spark):
    (got,) = mapped(spark, "github", {"@timestamp": 1720000000000, "actor": "alice", "action": "repo.create", "ip": "198.51.100.25", "org": "acme", "repo": "acme/webapp"})
    assert got == {"ts_text": "1720000000.000", "user_name": "alice", "src_ip": "198.51.100.25", "cloud_account": "acme", "action": "repo.create", "category": "cloud", "outcome": "unknown", "resource": "acme/webapp"}
    (got,) = mapped(spark, "assets", {"hostname": "web-01", "ip": "10.0.0.5", "owner": "alice", "os": "ubuntu-22.04", "org": "acme"})
    assert got == {"host": "web-01", "src_ip": "10.0.0.5", "user_name": "alice", "cloud_account": "acme", "action": "asset_inventory_observed", "category": "endpoint", "resource": "ubuntu-22.04"}
    (got,) = mapped(spark, "cloudtrail", {"eventName": "AssumeRole", "errorCode": "Denied", "requestID": "r1", "userIdentity": {"arn": "arn:aws:iam::1:user/bob"}, "recipientAccountId": "7", "requestParameters": {"roleArn": "arn:aws:iam::1:role/admin", "roleName": "other"}})
    assert got == {"record_id": "r1", "user_name": "bob", "cloud_account": "7", "action": "AssumeRole", "category": "cloud", "outcome": "failure", "resource": "admin"}


def test_processes_and_network(spark):
    event = {"System": {"EventID": 1, "EventRecordID": 41, "UtcTime": "2026-08-04T10:08:00Z", "Computer": "alice-pc"}, "EventData": {"Image": "C:\\Tools\\mimikatz.exe", "CommandLine": "mimikatz.exe sekurlsa::logonpasswords", "ParentImage": "C:\\Windows\\explorer.exe", "IntegrityLevel": "High"}}
    (got,) = mapped(spark, "sysmon", {"Event": event})
    assert (got["process_name"], got["category"], got["action"], got["record_id"], got["event_code"], got["resource"], got["integrity_level"]) == ("mimikatz.exe", "process", "process_start", "41", 1, "C:\\Windows\\explorer.exe", "High")
    xml = '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Microsoft-Windows-Sysmon"/><EventID>1</EventID><Computer>alice-pc</Computer></System><EventData><Data Name="Image">C:\\Tools\\mimikatz.exe</Data><Data Name="CommandLine">a sekurlsa</Data></EventData></Event>'
    (got,) = mapped(spark, "sysmon_xml", xml)
    assert (got["process_name"], got["command_line"], got["host"], got["provider_name"], got["event_code"]) == ("mimikatz.exe", "a sekurlsa", "alice-pc", "Microsoft-Windows-Sysmon", 1)
    (got,) = mapped(spark, "zeek", {"ts": 1720000000, "uid": "C1", "id.orig_h": "10.0.0.5", "id.resp_h": "203.0.113.20", "proto": "http", "host": "web.example.com", "uri": "index.php?page=../../etc/passwd"})
    assert got == {"record_id": "C1", "ts_text": "1720000000", "host": "web.example.com", "src_ip": "10.0.0.5", "dst_ip": "203.0.113.20", "action": "http_request", "category": "network", "resource": "http", "url": "web.example.com/index.php?page=../../etc/passwd"}
    got = mapped(spark, "suricata", *({"event_type": "alert", "alert": {"signature": "ET", "severity": s}} for s in (1, 2, 3, 4, 5, "1")), {})
    assert [r["severity"] for r in got] == ["critical", "high", "medium", "low", "info", "info", "info"] and got[0]["resource"] == "ET" and got[0]["action"] == "alert"


def test_exports(spark):
    bodies = ['{"Records": [{"a": 1}, {"b": 2}, 3]}', '{\n "a": 3\n}', '{"a": 4}\n{"Records": [{"c": 5}]}\nbroken {\n[6]', "[7]", "", None]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string")
    assert sorted((r.n, r.body) for r in mappers.exported(rows, "n").collect()) == [(0, '{"a":1}'), (0, '{"b":2}'), (1, '{"a":3}'), (2, '{"a":4}'), (2, '{"c":5}')]


def test_address_classes(spark):
    cases = {
        "login from 203.0.113.9.": "login from <IP:public>.", "100.64.1.2 and 100.128.0.1": "<IP:internal> and <IP:public>", "999.1.1.1.1 stays, 01.2.3.4 too": "999.1.1.1.1 stays, 01.2.3.4 too",
        "10.0.0.1,172.31.0.1,172.32.0.1": "<IP:internal>,<IP:internal>,<IP:public>", "1.2.3.4.5": "<IP:public>.5", "é1.2.3.4 v1.2.3": "é1.2.3.4 v1.2.3", "": "", None: "",
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    assert [r.m for r in df.orderBy("i").select(redaction.address_tokens(F.col("t")).alias("m")).collect()] == list(cases.values())


def test_indicators_and_roles(spark):
    bundle = spark.createDataFrame([("a", None, "[IPv4-Addr:value = '1.1.1.1'] OR [url:value='X']"), ("b", "n", "seen 'Marker' and 'two'"), ("c", "n", "bare words")], "id string, name string, pattern string")
    assert sorted(map(tuple, context.indicator_clauses(bundle).collect())) == [("a", "threat indicator", "ipv4-addr", "1.1.1.1"), ("a", "threat indicator", "url", "x"), ("b", "n", "any", "marker"), ("b", "n", "any", "two")]
    people = spark.createDataFrame([("svc", " Backup", "active", None), ("off", "backup", " Suspended", ["R2"]), ("own", None, None, ["R2", "", "N1"]), ("odd", "nothing", "active", None)], "key string, role string, status string, expected_rules array<string>")
    roles = spark.createDataFrame([("backup", "R1"), ("backup", "N1")], "role string, rule_id string")
    found = spark.createDataFrame([(f"{u}{r}{s}", r, [f"user:{u.upper()}"], s, 40) for u in ("svc", "off", "own", "odd") for r in ("R1", "R2", "N1") for s in (75, 100)], "finding_id string, rule_id string, entities array<string>, severity int, risk_points int")
    got = {r.finding_id: (r.severity, r.risk_points) for r in context.routine_for_role(found, people, roles, ["N1"]).where("routine").collect()}
    assert got == {"svcR175": (25, 10), "ownR275": (25, 10)}
