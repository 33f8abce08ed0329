"""Record mappers: vendor records (a JSON text column) to the common event fields, as projections.

Each mapper takes a DataFrame with a column `body` and gives FIELDS, with nulls where a source has nothing to
say, and its own further fields. A body is parsed once, into a VARIANT; one that isn't JSON gives nulls.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("source", "log_product", "log_service", "record_id", "ts_text", "user_name", "host", "src_ip", "dst_ip", "cloud_account", "action", "category", "outcome", "resource", "severity")
#: Severity words of numbered alerts, words of sign-in kinds, and words of failure.
ALERT_SEVERITY = {1: "critical", 2: "high", 3: "medium", 4: "low"}
SIGN_IN = ["session", "authentication", "authn", "mfa", "sso", "password"]
OKTA_FAILURES, ENTRA_FAILURES = ["fail", "denied", "error"], ["fail", "denied", "error", "notapply"]


def _key(path: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("/"))


def raw(path: str, doc: str = "_doc") -> Column:
    """The value at a path of names and places, as a VARIANT."""
    return F.try_variant_get(doc, _key(path), "variant")


def at(*paths: str, doc: str = "_doc") -> Column:
    """The first of the values at these paths that isn't absent, null or an empty text, as text."""
    values = [F.try_variant_get(doc, _key(p), "string") for p in paths]
    return F.coalesce(*[F.when(v != "", v) for v in values])


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def holds(text: Column, words: list[str]) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def basename(path: Column) -> Column:
    return F.coalesce(F.nullif(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), F.lit("")), path)


def seconds_of(*paths: str) -> Column:
    """A time as text; numbers beyond 1e12 are milliseconds."""
    value = F.coalesce(*[raw(p) for p in paths])
    number = F.when(~is_text(value), F.try_variant_get(value, "$", "double"))
    return F.when(number > 1e12, (number / 1000).cast("decimal(20,3)").cast("string")).otherwise(at(*paths))


def _mapped(df: DataFrame, keep: tuple[str, ...], **columns: Column | str) -> DataFrame:
    rows = df.withColumn("_doc", F.try_parse_json("body"))
    given = {k: F.lit(v) if isinstance(v, str) else v for k, v in columns.items()}
    empty = F.lit(None).cast("string")
    return rows.select(*keep, *[given.pop(f, empty).alias(f) for f in FIELDS], *[v.alias(k) for k, v in given.items()])


def cloudtrail(df: DataFrame, *keep: str) -> DataFrame:
    arn, role = at("userIdentity/arn"), at("requestParameters/roleArn")
    return _mapped(
        df, keep, source="aws.cloudtrail", log_product="aws", log_service="cloudtrail", category="cloud",
        record_id=at("eventID", "requestID"), ts_text=at("eventTime"), action=at("eventName"), src_ip=at("sourceIPAddress"),
        user_name=F.coalesce(at("userIdentity/userName"), F.when(arn.contains("/"), F.nullif(F.substring_index(arn, "/", -1), F.lit("")))),
        cloud_account=at("userIdentity/accountId", "recipientAccountId"),
        resource=F.coalesce(F.substring_index(role, "/", -1), at("requestParameters/roleName")),
        outcome=F.when(at("errorCode").isNull(), "success").otherwise("failure"),
        event_source=at("eventSource"), event_type=at("eventType"), aws_region=at("awsRegion"),
    )


def okta(df: DataFrame, *keep: str) -> DataFrame:
    """Results that speak of failure are failed logins, whatever the event; others succeed."""
    kind = F.lower(F.coalesce(at("eventType"), F.lit("")))
    result = F.lower(F.coalesce(at("outcome/result"), F.lit("unknown")))
    failed, told = holds(result, OKTA_FAILURES), F.coalesce(at("eventType"), F.lit("okta_event"))
    named = F.when(holds(result, ["success", "succeed"]) & holds(kind, ["session", "authentication"]), "login").otherwise(told)
    return _mapped(
        df, keep, source="okta", log_product="okta", log_service="okta", record_id=at("uuid"), ts_text=at("published", "ts", "dateTime"),
        user_name=at("actor/0/alternateId", "actor/0/displayName", "actor/0/login"), src_ip=at("client/ipAddress"),
        action=F.when(failed, "login_failed").otherwise(named), category=F.when(holds(kind, SIGN_IN), "authentication"),
        outcome=F.when(failed, result).otherwise("success"), resource=at("target/0/alternateId", "target/0/displayName", "target/0/id"),
    )


def github(df: DataFrame, *keep: str) -> DataFrame:
    return _mapped(
        df, keep, source="github", log_product="github", log_service="audit", category="cloud", ts_text=seconds_of("@timestamp", "timestamp"),
        action=at("action"), user_name=at("actor", "user"), src_ip=at("ip", "ip_address"), cloud_account=at("org", "organization", "system"),
        resource=at("repo", "repository"), outcome=F.coalesce(at("events_result", "result"), F.lit("unknown")),
    )


def entra(df: DataFrame, *keep: str) -> DataFrame:
    """Sign-ins: a numeric result code is a success only if it is 0; words are read otherwise."""
    code = F.trim(F.coalesce(F.try_variant_get("_doc", "$.resultType", "string"), F.try_variant_get("_doc", "$.result", "string")))
    code = F.nullif(code, F.lit(""))
    word = F.lower(code)
    outcome = (
        F.when(code.isNull(), "unknown")
        .when(code.rlike(r"^-*\d+$"), F.when(code.rlike("^-*0$"), "success").otherwise("failure"))
        .when(holds(word, ENTRA_FAILURES), "failure")
        .when(word.contains("success"), "success")
        .otherwise(word)
    )
    return _mapped(
        df, keep, source="microsoft.entra", log_product="azure", log_service="signinlogs", category="authentication",
        record_id=at("id"), ts_text=at("createdDateTime", "activityDateTime", "timestamp"), action=F.when(outcome == "failure", "login_failed").otherwise("login"),
        user_name=at("userPrincipalName", "userDisplayName"), src_ip=at("ipAddress", "ip_address"), resource=at("appDisplayName"), host=at("deviceDetail/displayName"),
        cloud_account=at("tenantId", "userId"), outcome=outcome, result_code=code,
    )


def event_code(text: Column) -> Column:
    """An event number as a number; other texts have none."""
    return F.when(F.trim(text).rlike(r"^-?\d+$"), F.trim(text).try_cast("int"))


#: Fields of process records: our name, and theirs in the data part.
SYSMON = {
    "command_line": "CommandLine", "original_file_name": "OriginalFileName", "parent_process_name": "ParentImage", "parent_command_line": "ParentCommandLine", "target_object": "TargetObject",
    "target_file_name": "TargetFilename", "details": "Details", "script_block_text": "ScriptBlockText", "image_loaded": "ImageLoaded", "hashes": "Hashes", "integrity_level": "IntegrityLevel",
}


def _process(df: DataFrame, keep: tuple[str, ...], image: Column, number: Column, fields: dict[str, Column], **more: Column) -> DataFrame:
    return _mapped(df, keep, source="sysmon", log_product="windows", log_service="sysmon", category="process", action="process_start", resource=fields["parent_process_name"], event_code=event_code(number), process_name=basename(image), **fields, **more)


def sysmon(df: DataFrame, *keep: str) -> DataFrame:
    """Records with a System and an EventData part, under Event or at the top; the image, command line and parent may lie in either or at the top."""
    system, data = lambda n: (f"Event/System/{n}", f"System/{n}"), lambda n: (f"Event/EventData/{n}", f"EventData/{n}")
    anywhere = lambda n: at(*data(n), *system(n), n)
    both = ("Image", "CommandLine", "ParentImage")
    fields = {ours: anywhere(n) if n in both else at(*data(n), n) for ours, n in SYSMON.items()}
    provider = at("Event/System/Provider/Name", "System/Provider/Name", "ProviderName")
    return _process(df, keep, anywhere("Image"), at(*system("EventID"), "EventID"), fields, record_id=at(*system("EventRecordID"), "EventRecordID"), ts_text=at(*system("UtcTime"), *data("UtcTime"), "UtcTime"), host=at(*system("Computer"), "Computer"), provider_name=provider)


def sysmon_xml(df: DataFrame, *keep: str) -> DataFrame:
    """The XML form: elements of the System part, and each Data element by its name."""
    filled = lambda path: F.nullif(F.expr(f"xpath_string(body, '{path}')"), F.lit(""))
    system = lambda n: filled(f'//*[local-name()="System"]/*[local-name()="{n}"]')
    data = lambda n: filled(f'//*[local-name()="EventData"]/*[@Name="{n}"]')
    either = lambda n: F.coalesce(data(n), system(n))
    fields = {ours: either(n) if n in ("CommandLine", "ParentImage") else data(n) for ours, n in SYSMON.items()}
    provider = filled('//*[local-name()="System"]/*[local-name()="Provider"]/@Name')
    return _process(df, keep, either("Image"), system("EventID"), fields, record_id=system("EventRecordID"), ts_text=F.coalesce(system("UtcTime"), data("UtcTime")), host=system("Computer"), provider_name=provider)


def zeek(df: DataFrame, *keep: str) -> DataFrame:
    """Records with a uri are requests; a url needs a host too."""
    uri, host = at("uri"), at("host")
    url = F.concat(host, F.when(uri.startswith("/"), uri).otherwise(F.concat(F.lit("/"), uri)))
    return _mapped(
        df, keep, source="zeek", category="network", record_id=at("uid"), ts_text=seconds_of("ts"), action=F.when(uri.isNull(), "network_connection").otherwise("http_request"),
        src_ip=at("id.orig_h"), dst_ip=at("id.resp_h"), resource=at("proto"), host=F.when(url.isNotNull(), host), url=url,
    )


def suricata(df: DataFrame, *keep: str) -> DataFrame:
    words = F.create_map(*[F.lit(x) for pair in ALERT_SEVERITY.items() for x in pair])
    number = raw("alert/severity")
    severity = F.when(is_text(number), None).otherwise(words[F.try_variant_get(number, "$", "int")])
    return _mapped(
        df, keep, source="suricata", category="network", record_id=at("event_id"), ts_text=at("timestamp"), action=F.coalesce(at("event_type"), F.lit("alert")),
        src_ip=at("src_ip"), dst_ip=at("dest_ip", "dst_ip"), resource=at("alert/signature"), severity=F.coalesce(severity, F.lit("info")),
    )


def assets(df: DataFrame, *keep: str) -> DataFrame:
    return _mapped(
        df, keep, source="asset", category="endpoint", action="asset_inventory_observed", host=at("hostname", "fqdn", "name"), src_ip=at("ip", "ip_address"),
        user_name=at("owner", "responsible_owner"), cloud_account=at("account", "org"), resource=at("os", "os_version"),
    )


MAPPERS: dict[str, Callable[..., DataFrame]] = {"cloudtrail": cloudtrail, "okta": okta, "github": github, "entra": entra, "sysmon": sysmon, "sysmon_xml": sysmon_xml, "zeek": zeek, "suricata": suricata, "assets": assets}


def exported(files: DataFrame, *keep: str) -> DataFrame:
    """body of each record of exports (a text column `body`): {"Records": [...]}, one object, or an object a line; what is none of these gives no record."""
    lines = F.split(F.trim("body", F.lit(" \t\r\n")), "\\n")
    whole = F.try_parse_json(lines[0]).isNull() & F.try_parse_json("body").isNotNull()  # the parser stops after one value, so a first line that is one comes first
    documents = F.when(whole, F.array("body")).otherwise(lines)
    rows = files.select(*keep, F.explode(documents).alias("_text")).withColumn("_doc", F.try_parse_json("_text"))
    listed = F.try_variant_get("_doc", "$.Records", "array<variant>")
    rows = rows.select(*keep, F.explode(F.coalesce(listed, F.array("_doc"))).alias("_record")).where(F.schema_of_variant("_record").startswith("OBJECT"))
    return rows.select(*keep, F.to_json("_record").alias("body"))


def lookup_records(files: DataFrame, schema: str) -> DataFrame:
    """Rows of lookup files (a text column `body`): a JSON array, one object, or {"records"|"assets"|"identities"|"users": [...]}; unreadable files give none."""
    names = ("records", "assets", "identities", "users")
    listed = F.coalesce(*[F.from_json(F.get_json_object("body", f"$.{n}"), f"array<struct<{schema}>>") for n in names])
    whole = F.from_json("body", f"array<struct<{schema}>>")
    single = F.array(F.from_json("body", f"struct<{schema}>"))
    body = F.trim("body")
    rows = F.when(body.startswith("["), whole).when(body.startswith("{"), F.coalesce(listed, single))
    return files.select(F.explode(rows).alias("r")).where("r IS NOT NULL").select("r.*")


def exploited_catalogue(files: DataFrame) -> DataFrame:
    """cve, vendor, product, due and ransomware of a known-exploited catalogue (a text column `body`); ids that aren't CVEs go."""
    kind = "array<struct<cveID:string,vendorProject:string,product:string,dueDate:string,knownRansomwareCampaignUse:string>>"
    rows = files.select(F.explode(F.from_json(F.get_json_object("body", "$.vulnerabilities"), kind)).alias("v"))
    cve = F.upper(F.trim("v.cveID"))
    return rows.where(cve.rlike(r"^CVE-\d{4}-\d{4,}$")).select(cve.alias("cve"), F.col("v.vendorProject").alias("vendor"), F.col("v.product").alias("product"), F.col("v.dueDate").alias("due"), (F.lower("v.knownRansomwareCampaignUse") == "known").alias("ransomware"))


def technique_bundle(files: DataFrame) -> DataFrame:
    """technique, name and tactics of a technique bundle (a text column `body`), without revoked or deprecated objects."""
    kind = "array<struct<type:string,name:string,revoked:boolean,x_mitre_deprecated:boolean,external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>"
    rows = files.select(F.explode(F.from_json(F.get_json_object("body", "$.objects"), kind)).alias("o"))
    rows = rows.where((F.col("o.type") == "attack-pattern") & ~F.coalesce("o.revoked", F.lit(False)) & ~F.coalesce("o.x_mitre_deprecated", F.lit(False)))
    own = F.filter("o.external_references", lambda r: r["source_name"] == "mitre-attack")
    tactics = F.transform(F.filter("o.kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: p["phase_name"])
    out = rows.select(F.try_element_at(own, F.lit(1))["external_id"].alias("technique"), F.col("o.name").alias("name"), tactics.alias("tactics"))
    return out.where("technique IS NOT NULL")
