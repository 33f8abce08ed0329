"""Raw lines to records: JSON lines, CEF, syslog, CEF inside syslog and plain messages, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines nested deeper are kept as messages; syslog's severities by number, as names and as values; outcome words; months.
DEPTH = 64
SYSLOG_SEVERITIES = ["emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug"]
SYSLOG_VALUES = [100, 100, 100, 75, 50, 25, 25, 0]
FAILURE = ["fail", "denied", "deny", "error", "reject", "blocked", "block", "invalid"]
SUCCESS = ["success", "accepted", "allowed", "permitted", "granted", "passed"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
RFC5424 = r"^<(\d{1,3})>\d\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(\[[^\]]*(?:\][^\[]*\[[^\]]*)*\]|-)\s*(.*)$"
RFC3164 = r"^<(\d{1,3})>\s*([A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(?:(\S+)\s+)?(.*)$"
CEF = r"(?s)^CEF:\d+\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(\d*)\|(.*)$"
CEF_PAIR = r"([a-zA-Z0-9_.-]+)=([^=]*?)(?=\s+[a-zA-Z0-9_.-]+=|\s*$)"
#: sshd and session messages: the pattern, which fields its groups are, and the outcome.
LOGINS = [
    (r"(?i)Failed password for (?:invalid user )?(\S+) from ([\d.]+)", ("user", "src_ip"), "failure"),
    (r"(?i)Accepted password for (\S+) from ([\d.]+)", ("user", "src_ip"), "success"),
    (r"(?i)session opened for user (\S+)", ("user",), "success"),
]


def depth(line: Column) -> Column:
    """How deep brackets nest outside strings; lines with few brackets are not walked."""
    bare = F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    walked = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda s, c: F.struct(
            (s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(s["top"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("top"),
        ),
    )
    return F.when(F.length(F.regexp_replace(bare, r"[^\[{]", "")) > DEPTH, walked["top"]).otherwise(0)


def pair(key: str, value: Column, text: bool = True) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"), F.lit(text).alias("text"))


def parts_of(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that takes the whole text, found in one run; null if it doesn't fit."""
    found = F.regexp_replace(text, F.lit(pattern), F.lit("".join(f"\x01${i}" for i in range(1, groups + 1))))
    return F.when(found.startswith("\x01"), F.split(found, "\x01"))


def last_of(keys: Column, values: Column, name: str) -> Column:
    """The value of a key, of arrays whose last entries come first."""
    return F.get(values, F.array_position(keys, F.lit(name)).cast("int") - 1)


def present(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def worded_outcome(text: Column) -> Column:
    return F.when(text.rlike("|".join(FAILURE)), "failure").when(text.rlike("|".join(SUCCESS)), "success")


def _unescaped(value: Column) -> Column:
    for code, plain in (("\\=", "="), ("\\|", "|"), ("\\n", "\n"), ("\\r", "\r"), ("\\\\", "\\")):
        value = F.replace(value, F.lit(code), F.lit(plain))
    return value


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def cef_fields(line: Column) -> Column:
    """A CEF line's header and extension as fields, null if it is none: later ones count, and severity is tenfold, 100 at most."""
    return _once(parts_of(line, CEF, 7), lambda p: F.when(p.isNotNull(), _once(_cef(p), _completed)))


def _cef(part: Column) -> Column:
    head = [pair(k, part[i]) for i, k in ((1, "vendor"), (2, "product"), (3, "product_version"), (4, "signature_id"), (5, "message"))]
    severity = F.least(F.coalesce(part[6].try_cast("decimal(20,0)"), F.lit(0)), F.lit(10)) * 10
    keys, values = (F.regexp_extract_all(part[7], F.lit(CEF_PAIR), F.lit(i)) for i in (1, 2))
    renamed = lambda k: F.when(k == "src", "src_ip").when(k == "dst", "dst_ip").otherwise(k)
    named = lambda k, v, text: F.struct(k.alias("key"), v.alias("value"), F.lit(text).alias("text"))
    pairs = F.zip_with(keys, values, lambda k, v: named(renamed(F.lower(k)), _unescaped(F.trim(v)), True))
    pairs = F.transform(pairs, lambda p: F.when((p["key"] == "rt") & p["value"].rlike(r"^\d{10}(\.\d+)?$"), named(F.lit("timestamp"), p["value"], False)).otherwise(p))
    return F.concat(F.array(*head, pair("severity", severity.cast("int"), False)), pairs)


def _completed(fields: Column) -> Column:
    """fields with what actors, targets and words tell: the acting user before the target, the target's host before the source's."""
    keys, values = F.reverse(fields["key"]), F.reverse(fields["value"])
    last = lambda k: last_of(keys, values, k)
    told = F.lower(F.concat_ws(" ", last("message"), F.coalesce(last("msg"), F.lit(""))))
    outcome = F.when(~F.array_contains(keys, "outcome"), worded_outcome(told))
    return F.concat(fields, present(F.array(pair("outcome", outcome), pair("user", F.coalesce(last("suser"), last("duser"))), pair("host", F.coalesce(last("dhost"), last("shost"))))))


def syslog_fields(line: Column) -> Column:
    """A syslog line's fields, RFC 5424 or 3164, null if it is neither: facility, severity as a value, and user, address and outcome of login messages."""
    new, old = parts_of(line, RFC5424, 8), parts_of(line, RFC3164, 4)
    none = F.lit(None).cast("string")
    parts = F.coalesce(new, F.transform(F.array(old), lambda p: F.when(p.isNotNull(), F.array(p[0], p[1], p[2], p[3], none, none, none, none, p[4])))[0])
    return _once(F.when(line.startswith("<"), parts), lambda p: F.when(p.isNotNull(), _syslog(p)))


def _syslog(part: Column) -> Column:
    named = lambda c: F.when(~c.isin("-", ""), c)
    pri, text = part[1].try_cast("int"), part[8]
    pairs = [
        pair("host", named(part[3])), pair("app", named(part[4])), pair("message", text), pair("severity", F.element_at(F.array(*map(F.lit, SYSLOG_VALUES)), pri % 8 + 1), False),
        pair("facility", F.floor(pri / 8).cast("int"), False), pair("pri", pri, False), pair("structured_data", named(part[7])), pair("timestamp", named(part[2])),
    ]
    login = F.array().cast("array<struct<key:string,value:string,text:boolean>>")
    for pattern, names, outcome in reversed(LOGINS):
        login = F.when(text.rlike(pattern), F.array(*[pair(k, F.regexp_extract(text, pattern, i + 1)) for i, k in enumerate(names)], pair("outcome", F.lit(outcome)))).otherwise(login)
    return F.concat(present(F.array(*pairs)), login)


def documents(fields: Column) -> Column:
    """The fields of a line that isn't JSON as one document, all values texts; the last of equal keys counts."""
    keys = F.array_distinct(F.transform(fields, lambda f: f["key"]))
    latest = F.transform(keys, lambda k: F.element_at(F.filter(fields, lambda f: f["key"] == k), -1)["value"])
    return F.to_variant_object(F.map_from_arrays(keys, latest))


def records(lines: DataFrame, raw: bool = False) -> DataFrame:
    """lines (seq, line) that aren't blank, with format and fields (a list of key, value and whether it was a text; the last of equal keys counts).

    JSON objects give their members, and an array of objects a record for each; other JSON and unknown text are a
    message; JSON nested deeper than DEPTH is kept as a message of its own format, never dropped. A CEF payload
    of a syslog line adds its fields after the line's own. A line is parsed once by each reader that it may be for.
    With raw, records carry their document too: a JSON object as it is written, of other lines their fields.
    """
    rows = lines.withColumn("line", F.trim("line")).where("line <> ''").select("seq", "line")
    line = F.col("line")
    opened = F.length(line) * 2 - F.length(F.replace(line, F.lit("{"))) - F.length(F.replace(line, F.lit("[")))
    deep = F.when((opened > DEPTH) & line.rlike(r"^[\[{]"), depth(line) > DEPTH).otherwise(False)
    closed = (line.startswith("{") & line.endswith("}")) | (line.startswith("[") & line.endswith("]"))
    rows = rows.withColumn("deep", deep).withColumn("doc", F.when(closed & ~F.col("deep"), F.try_parse_json(line)))
    items = F.try_variant_get("doc", "$", "array<variant>")
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    listed = line.startswith("[") & F.coalesce((F.size(items) > 0) & F.forall(items, is_object), F.lit(False))
    rows = rows.withColumn("doc", F.explode(F.when(listed, items).otherwise(F.array("doc"))))
    rows = rows.withColumn("json", F.coalesce(is_object(F.col("doc")), F.lit(False)))
    rows = rows.withColumn("own", F.when(~F.col("json"), syslog_fields(line)))
    text = F.try_element_at(F.filter("own", lambda f: f["key"] == "message"), F.lit(-1))["value"]
    rows = rows.withColumn("payload", F.when(~F.col("json"), F.when(F.col("own").isNull(), line).otherwise(text)))
    rows = rows.withColumn("cef", F.when(F.col("payload").startswith("CEF:"), cef_fields(F.col("payload"))))
    own, cef = F.col("own").isNotNull(), F.col("cef").isNotNull()
    form = F.when(F.col("deep") & line.startswith("{"), "json-too-deep").when(F.col("json"), "json").when(own & cef, "syslog+cef").when(cef, "cef").when(own, "syslog").otherwise("message")
    members = F.transform(F.map_entries(F.try_variant_get("doc", "$", "map<string,variant>")), lambda f: F.struct(F.lower(f["key"]).alias("key"), F.try_variant_get(f["value"], "$", "string").alias("value"), (F.schema_of_variant(f["value"]) == "STRING").alias("text")))
    fields = F.coalesce(F.when(F.col("json"), members), F.when(own & cef, F.concat("own", "cef")), F.col("cef"), F.col("own"), F.array(pair("message", line)))
    rows = rows.select("seq", form.alias("format"), fields.alias("fields"), "json", "doc")
    if raw:
        rows = rows.withColumn("raw", F.when(F.col("json"), F.col("doc")).otherwise(documents(F.col("fields"))))
    return rows.drop("json", "doc")


class Fields:
    """Looks names up in the fields of rows, once each; of the typed names also whether they were given as a text."""

    def __init__(self, *names: str, typed: tuple[str, ...] = ()):
        self.names, self.typed = [*dict.fromkeys((*names, *typed))], typed

    def of(self, rows: DataFrame) -> DataFrame:
        """rows with all_values of their fields and a column for each name; the last of repeated keys counts."""
        laid = rows.withColumns({f"_{c}": F.reverse(F.col(f"fields.{c}")) for c in ("key", "value", "text")})
        place = {n: F.array_position("_key", F.lit(n)).cast("int") - 1 for n in self.names}
        found = [F.get("_value", p).alias(f"={n}") for n, p in place.items()] + [F.get("_text", place[n]).alias(f"?{n}") for n in self.typed]
        # the lambda keeps this projection's code in small methods, which the JVM compiles
        return laid.select(*rows.columns, F.transform("fields", lambda f: f["value"]).alias("all_values"), *found)

    def field(self, *names: str) -> Column:
        """The first of the named fields that isn't blank."""
        return F.coalesce(*[F.when(F.trim(F.col(f"`={n}`")) != "", F.col(f"`={n}`")) for n in names])

    def filled(self, *names: str) -> Column:
        """value and text of the first of the typed names that isn't empty, or, as a number, list or switch, zero, empty or false."""
        entries = F.array(*[F.struct(F.col(f"`={n}`").alias("value"), F.col(f"`?{n}`").alias("text")) for n in names])
        real = lambda f: (f["value"] != "") & (f["text"] | ~f["value"].isin("false", "[]", "{}") & (F.coalesce(f["value"].try_cast("double"), F.lit(1.0)) != 0))
        return F.get(F.filter(entries, real), 0)


def priority(pri: Column) -> tuple[Column, Column]:
    """Syslog facility number and severity name."""
    number = pri.try_cast("int")
    return F.floor(number / 8).cast("int"), F.element_at(F.array(*map(F.lit, SYSLOG_SEVERITIES)), number % 8 + 1)


def without_year(text: Column, now: Column) -> Column:
    """A date like `Jan  2 03:04:05` in the latest year in which it isn't more than a day after now."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.initcap(F.substring(text, 1, 3))).cast("int")
    day, clock = F.regexp_extract(text, r"^\w+\s+(\d+)", 1).cast("int"), F.split(F.regexp_extract(text, r"(\d+:\d+:\d+)$", 1), ":")
    at = lambda year: F.try_make_timestamp_ntz(year, month, day, clock[0].cast("int"), clock[1].cast("int"), clock[2].cast("double"))
    return F.when(at(F.year(now)) > now + F.expr("INTERVAL 1 DAY"), at(F.year(now) - 1)).otherwise(at(F.year(now)))
