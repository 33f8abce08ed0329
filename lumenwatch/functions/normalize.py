"""Normalized fields of records: aliases, category, action, outcome, severity and time."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lines import Fields, without_year

#: Aliases by field, categories, keyword rungs and severity words.
ALIASES = {
    "source": ["source", "vendor", "product", "event.provider"],
    "user_name": ["user", "username", "user.name", "actor", "principal", "account"],
    "host": ["host", "hostname", "computer", "device.name", "agent.hostname"],
    "src_ip": ["src_ip", "source.ip", "sourceipaddress", "client_ip", "ipaddress", "remoteaddress"],
    "dst_ip": ["dst_ip", "destination.ip", "dest_ip", "server_ip"],
    "process_name": ["process_name", "process.name", "image", "process"],
    "command_line": ["command_line", "process.command_line", "cmdline", "commandline"],
    "cloud_account": ["cloud_account", "accountid", "awsaccountid", "tenantid", "subscriptionid"],
    "resource": ["resource", "resourceid", "object", "target"],
    "event_code": ["event_code", "event.code", "eventid"],
    "original_file_name": ["original_file_name", "originalfilename", "file.pe.original_file_name"],
    "parent_process_name": ["parent_process_name", "process.parent.name", "parentimage"],
    "parent_command_line": ["parent_command_line", "process.parent.command_line", "parentcommandline"],
    "target_object": ["target_object", "targetobject"],
    "target_file_name": ["target_file_name", "targetfilename", "file.path"],
    "details": ["details"],
    "script_block_text": ["script_block_text", "scriptblocktext"],
    "image_loaded": ["image_loaded", "imageloaded"],
    "provider_name": ["provider_name", "providername", "event.provider"],
    "hashes": ["hashes", "file.hash"],
    "integrity_level": ["integrity_level", "integritylevel"],
    "log_product": ["log_product", "product", "os.type"],
    "log_service": ["log_service", "service", "channel"],
    "record_id": ["event_id", "id", "uuid"],
}
OUTCOMES = ["outcome", "event.outcome", "result", "status"]
ACTIONS = ["action", "event.action", "operation", "eventname", "event_name", "activitydisplayname"]
TIMES = ["timestamp", "@timestamp", "time", "eventtime"]
SEVERITY, MESSAGE, CATEGORY = ["severity", "level", "risk"], ["message", "msg"], ["category", "event.category"]
CATEGORIES = ["authentication", "process", "network", "dns", "cloud", "file", "endpoint", "application", "email"]
RUNGS = [
    ("authentication", ["login", "logon", "signin", "authentication", "mfa", "password"]),
    ("process", ["powershell", "cmd.exe", "bash", "process", "commandline", "exec"]),
    ("dns", ["dns", "query_name", "domain"]),
    ("email", ["phish", "spam", "mailbox", "recipient"]),
    ("cloud", ["cloudtrail", "assumerole", "iam", "azure", "aws", "gcp"]),
    ("network", ["connection", "firewall", "src_ip", "dst_ip", "port"]),
]
WORDS = {"info": 0, "informational": 0, "low": 25, "medium": 50, "moderate": 50, "high": 75, "critical": 100, "crit": 100}


def category_of(explicit: Column, values: Column, message: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", F.slice(values, 1, 20), F.coalesce(message, F.lit(""))))

    def rung(hay: Column) -> Column:
        out = F.when(F.lower(explicit).isin(*CATEGORIES), F.lower(explicit))
        for name, words in RUNGS:
            out = out.when(reduce(or_, [hay.contains(w) for w in words]), name)
        return out.otherwise("unknown")

    return F.transform(F.array(hay), rung)[0]


def default_action(category: Column, message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    signin = F.when(text.contains("fail"), "login_failed").when(text.contains("success") | text.contains("accept"), "login_success").otherwise("login")
    return F.when(category == "authentication", signin).when(category == "process", "process_start").when(category == "dns", "dns_query").when(category == "network", "network_connection").otherwise("observed")


def severity_of(value: Column, is_number: Column) -> Column:
    """Numbers by 90, 70, 40 and above 0; words by table; numbers written as strings are informational."""
    n = value.try_cast("double")
    words = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    by_number = F.when(n >= 90, 100).when(n >= 70, 75).when(n >= 40, 50).when(n > 0, 25).otherwise(0)
    return F.when(value.isNull(), 0).when(is_number, by_number).otherwise(F.coalesce(words[F.lower(F.trim(value))], F.lit(0)))


def timestamp_of(text: Column, otherwise: Column) -> Column:
    """ISO text (naive is UTC), without zone; anything else is `otherwise`."""
    zone = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})$", 1)
    minutes = F.regexp_extract(text, r"[+-](\d{2}):?(\d{2})$", 1).try_cast("int") * 60 + F.regexp_extract(text, r"[+-]\d{2}:?(\d{2})$", 1).try_cast("int")
    naive = F.regexp_replace(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ").try_cast("timestamp_ntz")
    shift = F.when(zone == "+", -minutes).when(zone == "-", minutes).otherwise(0)
    iso = naive + F.make_dt_interval(mins=shift)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), F.coalesce(iso, otherwise)).otherwise(otherwise)


def epoch_of(seconds: Column) -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.try_cast("decimal(18,6)"))


def normalized(records: DataFrame, now: Column | None = None) -> DataFrame:
    """records with the normalized fields; ts_defaulted marks those whose time isn't readable, which takes now (the start of 1970 if not given).

    A raw document that records carry goes along.
    """
    now = now if now is not None else F.lit("1970-01-01").cast("timestamp_ntz")
    look = Fields(*[n for names in (*ALIASES.values(), OUTCOMES, ACTIONS) for n in names], typed=(*TIMES, *SEVERITY, *MESSAGE, *CATEGORY))
    found = {name: look.field(*names) for name, names in ALIASES.items()}
    found |= {"source": F.coalesce(found["source"], F.lit("unknown")), "log_product": F.lower(found["log_product"]), "log_service": F.lower(found["log_service"])}
    rows = look.of(records).select(
        "seq", "format", *[c for c in records.columns if c == "raw"], "all_values", *[c.alias(name) for name, c in found.items()], F.coalesce(look.filled(*MESSAGE)["value"], F.lit("")).alias("message"), F.coalesce(look.filled(*CATEGORY)["value"], F.lit("")).alias("_explicit"),
        look.field(*ACTIONS).alias("_action"), F.lower(F.coalesce(look.field(*OUTCOMES), F.lit("unknown"))).alias("outcome"), look.filled(*SEVERITY).alias("_severity"), look.filled(*TIMES).alias("_time"),
    )
    rows = rows.withColumn("category", category_of(F.col("_explicit"), F.col("all_values"), F.col("message")))
    rows = rows.withColumns({"action": F.coalesce("_action", default_action(F.col("category"), F.col("message"))), "severity": severity_of(F.col("_severity.value"), ~F.col("_severity.text"))})
    # numbers are seconds; numbers written as texts aren't times
    text = F.when(F.col("_time.text"), F.col("_time.value"))
    time = F.when(text.isNull(), epoch_of(F.col("_time.value"))).when(text.rlike(r"^[A-Za-z]{3}\s+\d"), without_year(text, now)).otherwise(timestamp_of(text, F.lit(None).cast("timestamp_ntz")))
    rows = rows.withColumn("ts", time)
    return rows.withColumn("ts_defaulted", F.col("ts").isNull()).withColumn("ts", F.coalesce("ts", now)).drop("all_values", "_explicit", "_action", "_time", "_severity")
