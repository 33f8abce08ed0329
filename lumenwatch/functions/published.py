"""The shipped rule content beside the seed rules, in the same form."""

# Rules by id with name, severity, risk, techniques and selection.
PUBLISHED = [
    {"rule_id": "AUTO-DISCO-002", "name": "Domain account or group enumeration", "severity": 50, "risk_points": 40, "techniques": ["T1087"], "selection": {"category": "process", "command_line": {"contains_any": ["net user /domain", "net user /dom", "net group \"domain admins\"", "net group /domain", "net localgroup administrators", "get-aduser", "get-adgroupmember", "get-localgroup", "dsquery user", "dsquery group", "wmic useraccount"], "not_contains_any": ["/add", "/delete", "/del "]}}},
    {"rule_id": "AUTO-COLLECT-001", "name": "Data archived with a password before exfiltration", "severity": 75, "risk_points": 65, "techniques": ["T1560"], "selection": {"category": "process", "command_line": {"contains_any": ["a -hp", "rar a -p", "7z a -p", "7z.exe a -p", "7za a -p", "-mhe=on", "winrar.exe a -", "makecab /f", "compress-archive -path"]}}},
    {"rule_id": "AUTO-IMPACT-003", "name": "Organization member or collaborator access removed", "severity": 50, "risk_points": 40, "techniques": ["T1531"], "selection": {"category": "cloud", "action": {"contains_any": ["org.remove_member", "org.remove_outside_collaborator", "org.remove_billing_manager", "team.remove_member", "repo.remove_member"]}}},
    {"rule_id": "AUTO-CLOUD-001", "name": "Administrative cloud role assumed", "severity": 50, "risk_points": 55, "techniques": ["T1078", "T1078.004", "T1098"], "selection": {"category": "cloud", "action": {"contains_any": ["AssumeRole", "assume_role"]}, "resource": {"contains_any": ["Admin", "Administrator", "Owner"]}}},
    {"rule_id": "AUTO-EXEC-002", "name": "Suspicious scripting interpreter with download or execute pattern", "severity": 75, "risk_points": 70, "techniques": ["T1059"], "selection": {"category": "process", "process_name": {"endswith_any": ["cmd.exe", "cscript.exe", "wscript.exe", "mshta.exe"]}, "command_line": {"contains_any": ["certutil", "bitsadmin", "powershell -e", "-encodedcommand", "mshta", "rundll32", "iex ", "wget", "curl"]}}},
    {"rule_id": "AUTO-PERSIST-002", "name": "Local or domain account created or privileged", "severity": 75, "risk_points": 60, "techniques": ["T1136", "T1098"], "selection": {"category": "process", "command_line": {"regex": r"(net\s+(user|localgroup|group)\b.*/add)|new-localuser|add-localgroupmember|useradd\s|usermod\s+-ag\s+(sudo|wheel)"}}},
    {"rule_id": "AUTO-DEFEV-004", "name": "Endpoint security control disabled", "severity": 75, "risk_points": 70, "techniques": ["T1685", "T1686"], "selection": {"category": "process", "command_line": {"contains_any": ["disablerealtimemonitoring", "disablebehaviormonitoring", "disableioavprotection", "add-mppreference -exclusionpath", "set-mppreference -exclusion", "sc stop windefend", "sc config windefend", "sc delete windefend", "netsh advfirewall set allprofiles state off", "netsh firewall set opmode disable", "systemctl stop auditd", "systemctl disable auditd", "setenforce 0", "service auditd stop"]}}},
    {"rule_id": "AUTO-C2-001", "name": "Encrypted tunnel to external host", "severity": 75, "risk_points": 75, "techniques": ["T1573"], "selection": {"category": "process", "process_name": {"contains_any": ["ssh.exe", "stunnel", "socat", "iodine", "dnscat2", "proxychains", "obfs4"]}, "command_line": {"contains_any": ["-R ", "-L ", "-D ", "tls", "8443"]}}},
    {"rule_id": "AUTO-AUTH-001", "name": "Failed authentication", "severity": 25, "risk_points": 10, "techniques": ["T1110"], "selection": {"category": "authentication", "outcome": {"contains_any": ["fail", "denied", "error"]}}},
    {"rule_id": "AUTO-IMPACT-004", "name": "System recovery destroyed before encryption", "severity": 100, "risk_points": 90, "techniques": ["T1490"], "selection": {"category": "process", "command_line": {"contains_any": ["vssadmin delete shadows", "vssadmin.exe delete shadows", "shadowcopy delete", "wbadmin delete catalog", "wbadmin delete systemstatebackup", "wbadmin delete backup", "recoveryenabled no", "bootstatuspolicy ignoreallfailures", "Remove-VMSnapshot"]}}},
    {"rule_id": "AUTO-EXFIL-001", "name": "Large outbound data transfer", "severity": 75, "risk_points": 80, "techniques": ["T1041"], "selection": {"category": "network", "action": {"contains_any": ["exfil", "data_transfer", "upload"]}, "raw.direction": "outbound", "raw.bytes_sent": {"regex": "^([5-9][0-9]{6}|[1-9][0-9]{7,})$"}}},
    {"rule_id": "AUTO-LAT-001", "name": "Lateral movement tool in use", "severity": 75, "risk_points": 65, "techniques": ["T1021"], "selection": {"category": "process", "process_name": {"contains_any": ["psexec", "wmic.exe", "winrs.exe", "mstsc.exe", "ssh.exe"]}, "command_line": {"contains_any": ["/node:", "-s cmd", "-d ", "3389", "5985"]}}},
    {"rule_id": "AUTO-DEFEV-002", "name": "Security log clearing or removal", "severity": 75, "risk_points": 70, "techniques": ["T1070"], "selection": {"category": "process", "command_line": {"contains_any": ["wevtutil cl", "wevtutil clear-log", "clear-eventlog", "remove-eventlog", "del *.evtx", "rm -rf /var/log", "journalctl --vacuum"]}}},
    {"rule_id": "AUTO-DEFEV-001", "name": "System process running from user-writable path", "severity": 50, "risk_points": 55, "techniques": ["T1036"], "selection": {"category": "process", "process_name": {"endswith_any": ["svchost.exe", "lsass.exe", "explorer.exe", "winlogon.exe", "services.exe"]}, "command_line": {"contains_any": ["\\temp\\", "\\tmp\\", "\\appdata\\", "\\downloads\\", "/tmp/", "/temp/"]}}},
    {"rule_id": "AUTO-EMAIL-001", "name": "Phishing email delivered", "severity": 75, "risk_points": 75, "techniques": ["T1566", "T1566.001"], "selection": {"category": "email", "action": {"contains_any": ["phish", "malicious_email", "suspicious_attachment"]}}},
    {"rule_id": "AUTO-IMPACT-001", "name": "Ransomware encryption activity", "severity": 100, "risk_points": 100, "techniques": ["T1486"], "selection": {"category": "process", "process_name": {"contains_any": ["lockbit", "conti", "ryuk", "blackcat", "alphv", "wannacry", "petya", "hive"]}, "command_line": {"contains": "-encrypt"}}},
    {"rule_id": "AUTO-C2-002", "name": "Commodity remote-access tool launched", "severity": 50, "risk_points": 50, "techniques": ["T1219"], "selection": {"category": "process", "process_name": {"contains_any": ["anydesk", "teamviewer", "screenconnect", "connectwise", "atera", "splashtop", "rustdesk", "tvnserver", "ammyy", "supremo"]}}},
    {"rule_id": "AUTO-DISCO-003", "name": "Domain controller or remote host enumeration", "severity": 50, "risk_points": 40, "techniques": ["T1018", "T1482"], "selection": {"category": "process", "command_line": {"contains_any": ["net view /domain", "net view /all", "nltest /dclist", "nltest /domain_trusts", "get-adcomputer", "get-addomaincontroller", "dsquery computer", "arp -a"]}}},
    {"rule_id": "AUTO-PERSIST-001", "name": "Scheduled task or cron job created", "severity": 50, "risk_points": 45, "techniques": ["T1053"], "selection": {"category": "process", "command_line": {"contains_any": ["schtasks /create", "schtasks.exe /create", "schtasks /ru system", "new-scheduledtask", "register-scheduledtask", "crontab -e", "crontab -r", "systemd-run --on", "at.exe "]}}},
    {"rule_id": "AUTO-DEFEV-003", "name": "Source branch protection removed or overridden", "severity": 75, "risk_points": 65, "techniques": ["T1484"], "selection": {"category": "cloud", "action": {"contains_any": ["protected_branch.destroy", "protected_branch.policy_override", "branch_protection_rule.destroy"]}}},
    {"rule_id": "AUTO-IMPACT-002", "name": "Source repository destroyed or transferred out", "severity": 75, "risk_points": 70, "techniques": ["T1485"], "selection": {"category": "cloud", "action": {"contains_any": ["repo.destroy", "repo.transfer", "repository.destroy", "repo.delete"]}}},
    {"rule_id": "AUTO-CRED-004", "name": "Volume shadow copy created", "severity": 50, "risk_points": 35, "techniques": ["T1003.003"], "selection": {"category": "process", "command_line": {"contains_any": ["vssadmin create shadow", "vssadmin.exe create shadow", "shadowcopy call create", "win32_shadowcopy).create"]}}},
    {"rule_id": "AUTO-EXEC-001", "name": "Encoded PowerShell command", "severity": 75, "risk_points": 85, "techniques": ["T1059.001", "T1027"], "selection": {"category": "process", "process_name": {"contains": "powershell"}, "command_line": {"contains_any": ["-enc", "-encodedcommand"]}}},
    {"rule_id": "AUTO-DISCO-001", "name": "System information discovery", "severity": 25, "risk_points": 20, "techniques": ["T1082"], "selection": {"category": "process", "command_line": {"contains_any": ["systeminfo", "ipconfig /all", "quser", "net config"]}}},
    {"rule_id": "AUTO-CRED-001", "name": "Successful remote authentication", "severity": 25, "risk_points": 25, "techniques": ["T1078", "T1078.001"], "selection": {"category": "authentication", "action": {"contains": "login"}, "outcome": "success", "src_ip": {"regex": "^.+$"}}},
    {"rule_id": "AUTO-WEB-001", "name": "Web exploit attempt against public application", "severity": 75, "risk_points": 75, "techniques": ["T1190"], "selection": {"category": "network", "action": {"contains_any": ["http", "web", "request"]}, "raw.url": {"contains_any": ["../", "etc/passwd", "union select", "cmd.exe", "%00", "phpinfo", "webshell"]}}},
    {"rule_id": "SIG-EXEC-001", "name": "Encoded PowerShell Execution", "severity": 75, "risk_points": 75, "techniques": ["T1059.001", "T1027"], "selection": {"all_of": [{"category": "process", "log_product": "windows"}, {"process_name": {"endswith_any": ["\\powershell.exe", "\\pwsh.exe"]}, "command_line": {"contains_any": ["-enc", "-encodedcommand", "IEX"]}}, {"not": {"command_line": {"contains_any": ["AzureAD", "ModuleAnalyzer"]}}}]}},
]

# The techniques that a rule set should reach.
WATCHLIST = ["T1059", "T1059.001", "T1566", "T1078", "T1190", "T1110", "T1003", "T1027", "T1070", "T1036", "T1082", "T1021", "T1041", "T1486", "T1573"]
