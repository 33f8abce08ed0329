"""Registered queries of the shipped rules over parsed lines with their raw documents, with their SQL."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.predicates import fields_of
from ..functions.published import PUBLISHED, WATCHLIST
from ..operators import detection
from ..sources import lines
from ..sources.events import ENTITY_FIELDS, ENTITY_LIST, V, entities_of, micros, security_events
from .detection import _matrix, _matrix_table

#: Literal cases: the rule meant, whether it fires, and the members of the line. The events say how many lines there are and whose they are.
CASES: list[tuple[str, bool, dict[str, Any]]] = [
    ("AUTO-AUTH-001", True, {"category": "authentication", "action": "login_attempt", "outcome": "access denied"}),
    ("AUTO-AUTH-001", False, {"category": "authentication", "action": "mfa_prompt", "outcome": "pending"}),
    ("AUTO-CRED-001", True, {"category": "authentication", "action": "login", "outcome": "success", "src_ip": "198.51.100.1"}),
    ("AUTO-CRED-001", False, {"category": "authentication", "action": "login_success", "src_ip": ""}),
    ("AUTO-EXEC-001", True, {"category": "process", "process_name": "powershell.exe", "command_line": "powershell -enc SQBFAFgA"}),
    ("AUTO-EXEC-001", False, {"category": "process", "process_name": "powershell.exe", "command_line": "powershell.exe -NoProfile -Command Get-Date"}),
    ("SIG-EXEC-001", True, {"category": "process", "log_product": "windows", "process_name": "C:\\Program Files\\PowerShell\\7\\pwsh.exe", "command_line": "pwsh.exe -noprofile -enc SQBFAFgA"}),
    ("SIG-EXEC-001", False, {"category": "process", "log_product": "windows", "process_name": "C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe", "command_line": "powershell.exe -enc AzureAD"}),
    ("AUTO-EXEC-002", True, {"category": "process", "process_name": "mshta.exe", "command_line": "mshta.exe javascript:alert(1)"}),
    ("AUTO-EXEC-002", False, {"category": "process", "process_name": "notepad.exe", "command_line": "notepad.exe certutil.txt"}),
    ("AUTO-CLOUD-001", True, {"category": "cloud", "action": "assume_role", "cloud_account": "staging", "resource": "OrganizationAccountAdminRole"}),
    ("AUTO-CLOUD-001", False, {"category": "cloud", "action": "AssumeRole", "cloud_account": "prod", "resource": "ReadOnlyRole"}),
    ("AUTO-IMPACT-002", True, {"category": "cloud", "action": "repo.transfer", "cloud_account": "acme", "resource": "acme/payments"}),
    ("AUTO-IMPACT-002", False, {"category": "cloud", "action": "repo.archived", "cloud_account": "acme", "resource": "acme/payments"}),
    ("AUTO-DEFEV-003", True, {"category": "cloud", "action": "protected_branch.policy_override", "cloud_account": "acme"}),
    ("AUTO-DEFEV-003", False, {"category": "cloud", "action": "protected_branch.rejected_ref_update", "cloud_account": "acme"}),
    ("AUTO-IMPACT-003", True, {"category": "cloud", "action": "team.remove_member", "cloud_account": "acme"}),
    ("AUTO-IMPACT-003", False, {"category": "cloud", "action": "org.invite_member", "cloud_account": "acme"}),
    ("AUTO-IMPACT-004", True, {"category": "process", "process_name": "bcdedit.exe", "command_line": "bcdedit /set {default} recoveryenabled No"}),
    ("AUTO-IMPACT-004", False, {"category": "process", "process_name": "vssadmin.exe", "command_line": "vssadmin list shadows"}),
    ("AUTO-COLLECT-001", True, {"category": "process", "process_name": "rar.exe", "command_line": "rar a -hpSecret123 stage.rar C:\\Users\\alice\\Documents"}),
    ("AUTO-COLLECT-001", False, {"category": "process", "process_name": "tar", "command_line": "tar czf logs.tgz /var/log"}),
    ("AUTO-C2-002", True, {"category": "process", "process_name": "ScreenConnect.ClientService.exe", "command_line": "ScreenConnect.ClientService.exe"}),
    ("AUTO-C2-002", False, {"category": "process", "process_name": "mstsc.exe", "command_line": "mstsc.exe /v:finance-02"}),
    ("AUTO-DISCO-002", True, {"category": "process", "process_name": "net.exe", "command_line": "net group \"domain admins\" /domain"}),
    ("AUTO-DISCO-002", False, {"category": "process", "process_name": "net.exe", "command_line": "net localgroup administrators svc_helpdesk /add"}),
    ("AUTO-DISCO-003", True, {"category": "process", "process_name": "nltest.exe", "command_line": "nltest /dclist:corp.local"}),
    ("AUTO-DISCO-003", False, {"category": "process", "process_name": "ping.exe", "command_line": "ping dc-01"}),
    ("AUTO-PERSIST-001", True, {"category": "process", "process_name": "schtasks.exe", "command_line": "schtasks /create /tn Updater /tr C:\\temp\\p.exe /sc minute"}),
    ("AUTO-PERSIST-001", False, {"category": "process", "process_name": "schtasks.exe", "command_line": "schtasks /query /fo LIST"}),
    ("AUTO-DEFEV-004", True, {"category": "process", "process_name": "powershell.exe", "command_line": "Set-MpPreference -DisableRealtimeMonitoring $true"}),
    ("AUTO-DEFEV-004", False, {"category": "process", "process_name": "netsh.exe", "command_line": "netsh advfirewall show allprofiles"}),
    ("AUTO-PERSIST-002", True, {"category": "process", "process_name": "net.exe", "command_line": "net user /add svc_backup Passw0rd!"}),
    ("AUTO-PERSIST-002", False, {"category": "process", "process_name": "net.exe", "command_line": "net localgroup administrators"}),
    ("AUTO-CRED-004", True, {"category": "process", "process_name": "vssadmin.exe", "command_line": "C:\\Windows\\System32\\VSSADMIN.EXE Create Shadow /For=C:"}),
    ("AUTO-CRED-004", False, {"category": "process", "process_name": "powershell.exe", "command_line": "powershell Get-WmiObject Win32_ShadowCopy"}),
    ("AUTO-EMAIL-001", True, {"category": "email", "action": "suspicious_attachment_blocked"}),
    ("AUTO-EMAIL-001", False, {"category": "email", "action": "spam_filtered"}),
    ("AUTO-DISCO-001", True, {"category": "process", "process_name": "cmd.exe", "command_line": "cmd.exe /c ipconfig /all"}),
    ("AUTO-DISCO-001", False, {"category": "process", "process_name": "cmd.exe", "command_line": "cmd.exe /c ipconfig"}),
    ("AUTO-DEFEV-001", True, {"category": "process", "process_name": "explorer.exe", "command_line": "C:\\Users\\alice\\Downloads\\explorer.exe"}),
    ("AUTO-DEFEV-001", False, {"category": "process", "process_name": "svchost.exe", "command_line": "C:\\Windows\\System32\\svchost.exe -k netsvcs"}),
    ("AUTO-DEFEV-002", True, {"category": "process", "process_name": "wevtutil.exe", "command_line": "wevtutil cl security"}),
    ("AUTO-DEFEV-002", False, {"category": "process", "process_name": "cmd.exe", "command_line": "cmd.exe /c dir *.evtx"}),
    ("AUTO-IMPACT-001", True, {"category": "process", "process_name": "LockBit.exe", "command_line": "LockBit.exe -encrypt C:\\Users\\alice\\Documents\\Q3_report.xlsx"}),
    ("AUTO-IMPACT-001", False, {"category": "process", "process_name": "notepad.exe", "command_line": "notepad.exe -encrypt x"}),
    ("AUTO-LAT-001", True, {"category": "process", "process_name": "wmic.exe", "command_line": "wmic /node:finance-02 process call create cmd.exe"}),
    ("AUTO-LAT-001", False, {"category": "process", "process_name": "wmic.exe", "command_line": "wmic cpu get loadpercentage"}),
    ("AUTO-WEB-001", True, {"category": "network", "action": "http_request", "url": "/index.php?page=../../../../etc/passwd"}),
    ("AUTO-WEB-001", False, {"category": "network", "action": "http_request", "URL": "/index.php?page=../../../../etc/passwd", "url": "/index.php?page=about"}),
    ("AUTO-C2-001", True, {"category": "process", "process_name": "socat", "command_line": "socat TCP4-LISTEN:8443,fork SSL:server.example.com:443"}),
    ("AUTO-C2-001", False, {"category": "process", "process_name": "ssh.exe", "command_line": "ssh alice@203.0.113.99 'ls -la'"}),
    ("AUTO-EXFIL-001", True, {"category": "network", "action": "data_transfer", "direction": "outbound", "bytes_sent": 10000000}),
    ("AUTO-EXFIL-001", True, {"category": "network", "action": "upload", "direction": "outbound", "bytes_sent": 5000000}),
    ("AUTO-EXFIL-001", False, {"category": "network", "action": "data_transfer", "direction": "outbound", "bytes_sent": 4999999}),
    ("AUTO-EXFIL-001", False, {"category": "network", "action": "data_transfer", "direction": "inbound", "bytes_sent": 1500000000}),
]
#: Rules besides the shipped ones: paths below an object and below a number, a number's own kind, and fields that no line has.
PROBES = [
    {"rule_id": "PROBE-NESTED", "severity": 25, "techniques": ["T9999"], "selection": {"raw.context.level": 3}},
    {"rule_id": "PROBE-TEXT", "severity": 25, "techniques": ["T9999"], "selection": {"raw.context.level": "3"}},
    {"rule_id": "PROBE-BELOW", "severity": 25, "techniques": ["T9999"], "selection": {"raw.bytes_sent.unit": {"exists": True}}},
    {"rule_id": "PROBE-DNS", "severity": 25, "techniques": ["T1071.004"], "selection": {"category": "dns", "query": {"contains": ".zip"}, "details": {"exists": True}}},
    {"rule_id": "PROBE-QUERY", "severity": 25, "techniques": ["T1071.004"], "selection": {"query": {"endswith": ".top"}}},
]
RULES = [*PUBLISHED, *PROBES]
#: What follows a case's members in its line: whose it is, and a context whose level is a number in even events, else a text.
TAIL = """', "user": "' || coalesce(user_name, '') || '", "hostname": "' || coalesce(host, '') || '", "context": {"level": ' || CASE WHEN event_id % 2 = 0 THEN '3' ELSE '"3"' END || '}}'"""


def _case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.element_at(F.array(*[F.struct(F.lit(r).alias("meant"), F.lit(f).alias("fires"), F.lit(json.dumps(m)[:-1]).alias("head")) for r, f, m in CASES]), (F.col("event_id") % len(CASES) + 1).cast("int"))
    return security_events(spark, sf_dir).select("seq", "event_id", case["meant"].alias("meant"), case["fires"].alias("fires"), F.concat(case["head"], F.expr(TAIL)).alias("line"))


def _case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines parsed and normalized, with their raw documents."""
    rows = normalize.normalized(lines.records(_case_lines(spark, sf_dir).select("seq", "line"), raw=True))
    return rows.withColumn("event_id", F.col("seq") - 1).withColumn("us", micros()).withColumn("entities", entities_of(*ENTITY_FIELDS))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.evaluate(_case_events(spark, sf_dir), RULES)


def published_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped rules and the probes over lines, raw documents included."""
    return _published(spark, sf_dir).select("finding_id", "event_id", "rule_id", "severity", "risk_points", F.concat_ws(",", "entities").alias("entities"), F.concat_ws(",", "techniques").alias("techniques"))


def published_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule: true and false positives and negatives on the lines written for it. The case travels as a member of the line."""
    line = F.concat(F.expr("left(line, length(line) - 1)"), F.lit(', "meant": "'), F.col("meant"), F.lit('", "fires": '), F.col("fires").cast("string"), F.lit("}"))
    rows = normalize.normalized(lines.records(_case_lines(spark, sf_dir).select("seq", line.alias("line")), raw=True))
    rows = rows.withColumns({"meant": F.try_variant_get("raw", "$.meant", "string"), "fires": F.try_variant_get("raw", "$.fires", "boolean")})
    return detection.case_counts(rows, RULES, "meant", "fires")


def missing_field_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that most rules read and no line fills."""
    return detection.missing_fields(_case_events(spark, sf_dir), RULES)


def technique_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the matrix and the watchlist the findings reach."""
    out = detection.reach(_published(spark, sf_dir), _matrix_table(spark), WATCHLIST)
    return out.withColumns({c: F.concat_ws(",", c) for c in ("unknown_ids", "gaps")})


# The SQL reads members of the JSON by name; selections are written out by the tests below.


def _sql_field(name: str) -> str:
    if not name.startswith("raw."):
        return name
    return f"json_extract_string(doc, '$.{name[4:]}')"


def _sql_value(v: Any) -> str:
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def _sql_test(name: str, operator: str, value: Any) -> str:
    field = f"coalesce({_sql_field(name)}, '')"
    if operator == "exists":
        return f"{_sql_field(name)} IS {'NOT ' if value else ''}NULL"
    if operator == "regex":
        return f"regexp_matches({field}, {_sql_value(value)}, 'i')"
    negated, base = operator.startswith("not_"), operator.removeprefix("not_").split("_")[0]
    call = {"contains": "contains", "startswith": "starts_with", "endswith": "ends_with"}[base]
    tests = " OR ".join(f"{call}(lower({field}), {_sql_value(v.lower())})" for v in (value if isinstance(value, list) else [value]))
    return f"{'NOT ' if negated else ''}({tests})"


def _sql_equal(name: str, value: Any) -> str:
    own = f" AND json_type(doc, '$.{name[4:]}') {'=' if isinstance(value, str) else '<>'} 'VARCHAR'" if name.startswith("raw.") else ""
    return f"coalesce({_sql_field(name)} = {_sql_value(str(value))}{own}, false)"


def _sql_selection(selection: dict[str, Any]) -> str:
    out = []
    for name, wanted in selection.items():
        if name in ("all_of", "any_of"):
            out.append("(" + (" AND " if name == "all_of" else " OR ").join(_sql_selection(s) for s in wanted) + ")")
        elif name == "not":
            out.append(f"NOT {_sql_selection(wanted)}")
        elif isinstance(wanted, dict):
            out += [_sql_test(name, operator, value) for operator, value in wanted.items()]
        else:
            out.append(_sql_equal(name, wanted))
    return "(" + " AND ".join(out) + ")"


_FIELDS = ["query", "details", "process_name", "command_line", "resource", "log_product", "cloud_account", "src_ip", "action", "category"]
_heads = ", ".join(_sql_value(json.dumps(m)[:-1]) for _, _, m in CASES)
_meant, _fires = ", ".join(f"'{r}'" for r, _, _ in CASES), ", ".join(str(f).lower() for _, f, _ in CASES)
_i = f"[event_id % {len(CASES)} + 1]"
_rows = ", ".join(f"('{r['rule_id']}', {r['severity']}, {r.get('risk_points', r['severity'])}, {[*r['techniques']]!r}::VARCHAR[])" for r in RULES)
_hit = ", ".join(f"CASE WHEN {_sql_selection(r['selection'])} THEN '{r['rule_id']}' END" for r in RULES)
_reads = ", ".join(f"('{r['rule_id']}', '{f}')" for r in RULES for f in sorted(fields_of(r["selection"])))
_names = sorted({f for r in RULES for f in fields_of(r["selection"])})
CASE_CTE = f"""{V}, cl AS (SELECT event_id, ([{_meant}]){_i} AS meant, ([{_fires}]){_i} AS fires, CAST(([{_heads}]){_i} || {TAIL} AS JSON) AS doc FROM v),
cd AS (SELECT event_id, meant, fires, doc, {", ".join(f"CASE WHEN trim(doc->>'{f}') <> '' THEN doc->>'{f}' END AS {f}" for f in _FIELDS)},
  lower(coalesce(doc->>'outcome', 'unknown')) AS outcome, CASE WHEN trim(doc->>'user') <> '' THEN doc->>'user' END AS user_name, CASE WHEN trim(doc->>'hostname') <> '' THEN doc->>'hostname' END AS host FROM cl),
ce AS (SELECT * REPLACE (coalesce(action, 'process_start') AS action) FROM cd), rr(rule_id, severity, risk_points, techniques) AS (VALUES {_rows}),
ch AS (SELECT *, list_filter([{_hit}], lambda r: r IS NOT NULL) AS fired FROM ce)"""
_FOUND = f"{CASE_CTE}, cf AS (SELECT event_id, rule_id, severity, risk_points, techniques, {ENTITY_LIST} AS entities FROM (SELECT *, unnest(fired) AS rule_id FROM ch) JOIN rr USING (rule_id))"

QUERIES = [published_findings, published_cases, missing_field_histogram, technique_reach]
SQL = {
    "published_findings": f"WITH {_FOUND} SELECT sha256(rule_id || ':' || event_id) AS finding_id, event_id, rule_id, severity, risk_points, array_to_string(entities, ',') AS entities, array_to_string(techniques, ',') AS techniques FROM cf",
    "published_cases": f"""WITH {CASE_CTE}, j AS (SELECT meant AS rule_id, fires, list_contains(fired, meant) AS hit FROM ch)
SELECT rule_id, count(*) FILTER (fires AND hit) AS tp, count(*) FILTER (NOT fires AND hit) AS fp, count(*) FILTER (fires AND NOT hit) AS fn, count(*) FILTER (NOT fires AND NOT hit) AS tn FROM j GROUP BY 1""",
    "missing_field_histogram": f"""WITH {CASE_CTE}, rd(rule_id, field) AS (VALUES {_reads}),
filled AS (UNPIVOT (SELECT {", ".join(f'count({_sql_field(n)}) AS "{n}"' for n in _names)} FROM ce) ON COLUMNS(*) INTO NAME field VALUE n),
h AS (SELECT field, count(*) AS rules FROM rd ANTI JOIN (SELECT field FROM filled WHERE n > 0) USING (field) GROUP BY 1)
SELECT field, rules, CAST(row_number() OVER (ORDER BY rules DESC, field) AS INTEGER) AS place FROM h ORDER BY place LIMIT 15""",
    "technique_reach": f"""WITH {_FOUND}, m(technique, tactics) AS (VALUES {_matrix}), u AS (SELECT DISTINCT unnest(techniques) AS technique FROM cf), w AS (SELECT unnest({WATCHLIST!r}) AS technique),
k AS (SELECT DISTINCT technique, technique IN (SELECT technique FROM u) AS used FROM m), p AS (SELECT split_part(technique, '.', 1) AS parent, bool_or(used) AS used, bool_or(NOT contains(technique, '.')) AS own FROM k GROUP BY 1),
a AS (SELECT (SELECT count(*) FROM k) AS technique_total, (SELECT count(*) FROM k WHERE used) AS technique_covered, (SELECT count(*) FROM p WHERE own) AS parent_total, (SELECT count(*) FROM p WHERE own AND used) AS parent_covered)
SELECT *, round(100.0 * technique_covered / technique_total, 1) AS technique_percent, round(100.0 * parent_covered / parent_total, 1) AS parent_percent,
  (SELECT string_agg(technique, ',' ORDER BY technique) FROM u ANTI JOIN m USING (technique)) AS unknown_ids, (SELECT coalesce(string_agg(technique, ',' ORDER BY technique), '') FROM w ANTI JOIN u USING (technique)) AS gaps FROM a""",
}
