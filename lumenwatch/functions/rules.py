"""Seed rules and technique rows, as plain text content. Fixed values."""

RULES = [
    {"rule_id": "SEED-AUTH-1", "name": "Failed sign-in", "severity": 25, "risk_points": 10, "techniques": ["T1110"], "selection": {"category": "authentication", "outcome": "failure"}},
    {"rule_id": "SEED-EXEC-1", "name": "Encoded command", "severity": 75, "risk_points": 40, "techniques": ["T1059.001", "T1027"], "selection": {"category": "process", "command_line": {"contains": " -ENC "}}},
    {"rule_id": "SEED-EXEC-2", "name": "Shell started by name with arguments", "severity": 50, "risk_points": 20, "techniques": ["T1059"], "selection": {"process_name": {"in": ["powershell.exe", "pwsh.exe"]}, "command_line": {"contains_all": ["/c", "step1"]}, "not": {"command_line": {"endswith_any": ["step1", "step12"]}}}},
    {"rule_id": "SEED-CLOUD-1", "name": "Role assumed from inside", "severity": 50, "risk_points": 15, "techniques": ["T1078.004"], "selection": {"action": "AssumeRole", "cloud_account": {"exists": True}, "src_ip": {"not_startswith": "203.", "exists": True}}},
    {"rule_id": "SEED-RARE-1", "name": "Unusual variant", "severity": 75, "risk_points": 30, "techniques": ["T1562.001"], "selection": {"action": {"regex": "_rare[0-4]$"}}},
    {"rule_id": "SEED-WEB-1", "name": "Request without host or of a rare kind", "severity": 25, "risk_points": 5, "techniques": ["T1190"], "selection": {"any_of": [{"action": "http_request", "host": {"exists": False}}, {"action": {"startswith_any": ["http_request_", "assumerole_"]}}]}},
    {"rule_id": "SEED-EXT-1", "name": "Failure from a documentation range", "severity": 75, "risk_points": 35, "techniques": ["T1110", "T1133"], "selection": {"all_of": [{"src_ip": {"startswith": "203.0.113."}}, {"outcome": ["failure"]}]}},
    {"rule_id": "SEED-HOST-1", "name": "Hostless activity", "severity": 0, "risk_points": 0, "techniques": [], "selection": {"host": {"exists": False}, "user_name": {"not_in": ["u1", "u2"]}, "category": {"not_equals": "network"}}},
]

#: (technique, name, tactics)
TECHNIQUES = [
    ("T1110", "Brute Force", ["credential-access"]),
    ("T1059", "Command and Scripting Interpreter", ["execution"]),
    ("T1059.001", "PowerShell", ["execution"]),
    ("T1027", "Obfuscated Files or Information", ["defense-evasion"]),
    ("T1078", "Valid Accounts", ["initial-access", "persistence", "privilege-escalation", "defense-evasion"]),
    ("T1562", "Impair Defenses", ["defense-evasion"]),
    ("T1190", "Exploit Public-Facing Application", ["initial-access"]),
    ("T1003", "OS Credential Dumping", ["credential-access"]),
    ("T1003.001", "LSASS Memory", ["credential-access"]),
    ("T1486", "Data Encrypted for Impact", ["impact"]),
    ("T1041", "Exfiltration Over C2 Channel", ["exfiltration"]),
    ("T1021", "Remote Services", ["lateral-movement"]),
]
