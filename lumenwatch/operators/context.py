"""Threat indicators, assets, identities, networks and vulnerabilities joined to entities."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.events import value_of

#: Criticality spellings, levels with their risk multiplier in per cent, and IPv4 ranges by scope.
SPELLINGS = {"crit": "critical", "sev1": "critical", "tier0": "critical", "tier-0": "critical", "crown-jewel": "critical", "very high": "critical", "important": "high", "sev2": "high", "moderate": "medium", "normal": "medium", "standard": "medium", "minor": "low", "none": "low"}
LEVELS = {"low": 75, "medium": 100, "high": 150, "critical": 200}
SCOPES = [
    ("loopback", ["127.0.0.0/8"]),
    ("link-local", ["169.254.0.0/16"]),
    ("multicast", ["224.0.0.0/4"]),
    ("documentation", ["192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24"]),
    ("private", ["0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.168.0.0/16", "198.18.0.0/15", "240.0.0.0/4"]),
    ("reserved", ["100.64.0.0/10"]),
]
#: The same for IPv6, tested in this order; an address in none of them is public, an IPv4-mapped one has its IPv4 address's scope.
SCOPES6 = [
    ("loopback", ["::1/128"]),
    ("link-local", ["fe80::/10"]),
    ("multicast", ["ff00::/8"]),
    ("documentation", ["2001:db8::/32"]),
    ("public", ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]),
    ("private", ["::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2002::/16", "fc00::/7"]),
]


def cidr_range(cidr: str) -> tuple[int, int]:
    """First and last address of an IPv4 range, host bits ignored."""
    address, _, bits = cidr.partition("/")
    size = 1 << (32 - int(bits or 32))
    whole = sum(int(p) << (24 - 8 * i) for i, p in enumerate(address.split(".")))
    return whole // size * size, whole // size * size + size - 1


def ipv4(text: Column) -> Column:
    """The address as a number; null if it isn't four parts of 0 to 255."""
    parts = F.split(text, r"\.")
    number = sum((parts[i].try_cast("long") * F.lit(1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    return F.when(text.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), number)


def ip_scope(number: Column) -> Column:
    out = F.when(number.isNull(), None)
    for scope, cidrs in SCOPES:
        for lo, hi in map(cidr_range, cidrs):
            out = out.when(number.between(lo, hi), scope)
    return out.otherwise("public")


def ipv6_digits(text: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, with `::` and an IPv4 tail written out; null if it is none."""
    tail = F.regexp_extract(text, r":([0-9]+\.[0-9.]+)$", 1)
    last = F.lpad(F.hex(ipv4(tail)), 8, "0")
    text = F.lower(F.when(tail == "", text).otherwise(F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.substring(last, 1, 4), F.lit(":"), F.substring(last, 5, 4))))
    sides = F.split(text, "::")
    groups = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
    a, b = groups(F.try_element_at(sides, F.lit(1))), groups(F.coalesce(F.try_element_at(sides, F.lit(2)), F.lit("")))
    left = F.lit(8) - F.size(a) - F.size(b)
    whole = F.when(F.size(sides) == 1, left == 0).when(F.size(sides) == 2, left >= 1).otherwise(False)
    digits = lambda g: F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")
    valid = whole & F.forall(F.concat(a, b), lambda x: x.rlike("^[0-9a-f]{1,4}$"))
    return F.when(valid, F.concat(digits(a), F.repeat(F.lit("0000"), left), digits(b)))


def ip6_scope(digits: Column) -> Column:
    mapped = F.lit("0" * 20 + "ffff")
    out = F.when(digits.isNull(), None).when(F.substring(digits, 1, 24) == mapped, ip_scope(F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")))
    for scope, cidrs in SCOPES6:
        for net in map(ipaddress.IPv6Network, cidrs):
            out = out.when(digits.between(f"{int(net[0]):032x}", f"{int(net[-1]):032x}"), scope)
    return out.otherwise("public")


def scope_of(text: Column) -> Column:
    """The scope of an IPv4 or IPv6 address; null if the text is neither."""
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    return F.coalesce(ip_scope(ipv4(text)), once(once(text, ipv6_digits), ip6_scope))  # each value computed once, else the expression grows out of hand


def named_ranges(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """addresses (ip) with labels of all named ranges (label, prefix, net) that hold them, sorted.

    An equi-join on (prefix length, leading bits): each address is cut once for each prefix length in use
    (33 at most), so a large range table needs no range comparison. IPv4 alone; scope_of() knows both kinds.
    """
    lengths = [r[0] for r in ranges.select("prefix").distinct().collect()]  # at most 33
    cuts = F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.shiftright(F.col("ip_number"), 32 - p).alias("net")) for p in lengths]))
    rows = addresses.select("ip").distinct().withColumn("ip_number", ipv4(F.col("ip"))).where("ip_number IS NOT NULL")
    found = rows.withColumn("cut", cuts).select("ip", "cut.prefix", "cut.net").join(ranges, ["prefix", "net"])
    found = found.groupBy("ip").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    out = addresses.join(found, "ip", "left").withColumn("scope", ip_scope(ipv4(F.col("ip"))))
    unknown = F.when(F.col("scope") == "public", F.array(F.lit("unknown-external"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("labels", F.coalesce("labels", unknown))


def criticality(text: Column) -> Column:
    """One of the four levels, or null."""
    word = F.lower(F.trim(text))
    aliases = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    word = F.coalesce(aliases[word], word)
    return F.when(word.isin(*LEVELS), word)


def multiplier(level: Column) -> Column:
    out = F.when(level.isNull(), 100)
    for name, percent in LEVELS.items():
        out = out.when(level == name, percent)
    return out


def last_record(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in records.columns if c not in (key, order)]
    latest = records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return latest.select(key, "row.*")


def risk_by_criticality(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """findings with the highest criticality (key, criticality) of their entities, and risk scaled by it: at least 1 if it was positive."""
    keyed = findings.select("finding_id", F.explode("entities").alias("entity")).withColumn("key", F.lower(value_of(F.col("entity"))))
    top = keyed.join(assets.select("key", multiplier(F.col("criticality")).alias("m")), "key").groupBy("finding_id").agg(F.max("m").alias("m"))
    scaled = F.rint(F.col("risk_points") * F.col("m") / 100).cast("int")
    out = findings.join(top, "finding_id", "left")
    return out.withColumn("risk_points", F.when(F.col("m").isNull() | (F.col("risk_points") <= 0), F.col("risk_points")).otherwise(F.greatest(scaled, F.lit(1)))).drop("m")


def risk_by_context(findings: DataFrame, contexts: DataFrame) -> DataFrame:
    """findings with their risk scaled by the highest criticality (entity, criticality) that is known of their entities: at least 1 if it was positive."""
    top = findings.select("finding_id", F.explode("entities").alias("entity")).join(contexts.where("criticality IS NOT NULL").select("entity", multiplier(F.col("criticality")).alias("m")), "entity").groupBy("finding_id").agg(F.max("m").alias("m"))
    return findings.join(top, "finding_id", "left").withColumn("risk_points", risk_by(F.col("m"))).drop("m")


def risk_by(m: Column) -> Column:
    """risk_points scaled by m per cent, if that is known: at least 1 if it was positive."""
    scaled = F.rint(F.col("risk_points") * m / 100).cast("int")
    return F.when(m.isNull() | (F.col("risk_points") <= 0), F.col("risk_points")).otherwise(F.greatest(scaled, F.lit(1)))


def routine_rules(identities: DataFrame, roles: DataFrame, never: list[str]) -> DataFrame:
    """(key, rule_id) that are routine for an account (key, role, status and, if there, expected_rules): its role's rules (role, rule_id) and its own, without those of `never`; none for accounts that are off."""
    on = identities.where(~F.coalesce(F.lower(F.trim("status")).isin(*DISABLED), F.lit(False)))
    of_role = on.withColumn("role", F.lower(F.trim("role"))).join(roles, "role").select("key", "rule_id")
    own = [on.select("key", F.explode("expected_rules").alias("rule_id")).where("rule_id <> ''")] if "expected_rules" in on.columns else []
    return reduce(DataFrame.unionByName, own, of_role).where(~F.col("rule_id").isin(*never)).distinct()


def routine_risk() -> Column:
    return F.when(F.col("risk_points") > 0, F.greatest(F.rint(F.col("risk_points") * 0.25).cast("int"), F.lit(1))).otherwise(F.col("risk_points"))


def entity_facts(entities: DataFrame, contexts: DataFrame, identities: DataFrame, roles: DataFrame, never: list[str]) -> DataFrame:
    """What weighs on findings of an entity: m, its multiplier by criticality (contexts: entity, criticality), and routine, the rules that are routine for it as a user; entities without either have no row."""
    named = entities.select("entity").distinct()
    known = contexts.where("criticality IS NOT NULL").select("entity", multiplier(F.col("criticality")).alias("m"))
    rules = routine_rules(identities, roles, never).groupBy("key").agg(F.collect_set("rule_id").alias("routine"))  # a role's rules
    users = named.where(F.col("entity").startswith("user:")).withColumn("key", F.lower(F.trim(value_of(F.col("entity"))))).join(rules, "key").select("entity", "routine")
    return named.join(known, "entity", "left").join(users, "entity", "left").where("m IS NOT NULL OR routine IS NOT NULL")


def event_facts(events: DataFrame, facts: DataFrame) -> DataFrame:
    """Per event, the highest m of its entities and all rules that are routine for one of them (entity_facts)."""
    rows = events.select("event_id", F.explode("entities").alias("entity")).join(facts, "entity")
    return rows.groupBy("event_id").agg(F.max("m").alias("m"), F.array_distinct(F.flatten(F.collect_list("routine"))).alias("routine"))  # an event's entities are few


def routine_for_role(findings: DataFrame, identities: DataFrame, roles: DataFrame, never: list[str]) -> DataFrame:
    """findings with routine: whether their rule is routine for a user among their entities. Such a finding below critical keeps a severity of at most 25 and a quarter of its risk."""
    users = findings.select("finding_id", "rule_id", F.explode("entities").alias("entity")).where(F.col("entity").startswith("user:"))
    active = routine_rules(identities, roles, never)
    routine = users.withColumn("key", F.lower(F.trim(value_of(F.col("entity"))))).join(active, ["key", "rule_id"], "left_semi").select("finding_id").distinct().withColumn("routine", F.lit(True))
    out = findings.join(routine, "finding_id", "left").withColumn("routine", F.coalesce("routine", F.lit(False)) & (F.col("severity") < 100))
    return out.withColumn("risk_points", F.when(F.col("routine"), routine_risk()).otherwise(F.col("risk_points"))).withColumn("severity", F.when(F.col("routine"), F.least("severity", F.lit(25))).otherwise(F.col("severity")))


def exposure(inventory: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per host (host, cve): vulnerabilities, those known to be exploited (cve, ransomware), the first ten of them, and a level."""
    rows = inventory.distinct().join(catalogue, "cve", "left")
    exploited = F.col("ransomware").isNotNull()
    out = rows.groupBy("host").agg(
        F.count("*").alias("cves"),
        F.count_if(exploited).alias("exploited"),
        F.count_if(F.coalesce("ransomware", F.lit(False))).alias("ransomware"),
        F.slice(F.array_sort(F.collect_set(F.when(exploited, F.col("cve")))), 1, 10).alias("first_exploited"),
    )
    return out.withColumn("level", F.when(F.col("ransomware") > 0, "critical").when(F.col("exploited") > 0, "high"))


def indicator_clauses(bundle: DataFrame) -> DataFrame:
    """(indicator, name, type, value) of each [type:field = 'value'] clause of STIX patterns (id, name, pattern); a pattern without clauses gives its quoted texts, of type any."""
    pattern = r"\[\s*([\w.-]+):([\w.'-]+)\s*=\s*'([^']*)'"
    types, values = (F.regexp_extract_all("pattern", F.lit(pattern), F.lit(i)) for i in (1, 3))
    quoted = F.transform(F.regexp_extract_all("pattern", F.lit("'([^']*)'"), F.lit(1)), lambda v: F.struct(F.lit("any").alias("type"), v.alias("value")))
    clauses = F.when(F.size(types) > 0, F.arrays_zip(types.alias("type"), values.alias("value"))).otherwise(quoted)
    return bundle.select(F.col("id").alias("indicator"), "name", F.explode(clauses).alias("c")).select("indicator", F.coalesce("name", F.lit("threat indicator")).alias("name"), F.lower("c.type").alias("type"), F.lower("c.value").alias("value")).where("value <> ''")


#: Substring clauses are compared row by row against a broadcast of at most as many.
CLAUSES = 50_000


def indicator_hits(events: DataFrame, clauses: DataFrame, address: str, haystack: Column) -> DataFrame:
    """One finding for each event with all indicators it meets: IPv4 clauses by equality, others as substrings of the haystack."""
    exact = clauses.where("type = 'ipv4-addr'")
    by_ip = events.select("event_id", F.lower(address).alias("value")).join(exact, "value").select("event_id", "indicator")
    rest = clauses.where("type <> 'ipv4-addr'").select("indicator", "value")
    if rest.count() > CLAUSES:
        raise ValueError("more substring clauses than may be broadcast; split them into several calls")
    by_text = events.select("event_id", F.lower(haystack).alias("hay")).join(F.broadcast(rest), F.contains("hay", "value")).select("event_id", "indicator")
    found = by_ip.union(by_text).groupBy("event_id").agg(F.array_sort(F.collect_set("indicator")).alias("indicators"))
    return found.select("event_id", F.concat_ws(",", "indicators").alias("indicators"), F.lit(75).alias("severity"), F.lit(75).alias("risk_points"))


#: The fields that name an identity, in order, words for yes, and states of disabled accounts.
IDENTITY_KEYS = ["username", "user", "name", "sam_account_name", "upn", "email"]
YES, DISABLED = ["1", "true", "yes", "y"], ["disabled", "inactive", "terminated", "suspended"]


def identity_index(records: DataFrame) -> DataFrame:
    """A row for each key that names a record of a directory export (IDENTITY_KEYS as far as there, position and any other columns).

    A full value names the last record that has it; a mail address's local part names the first, and only where it is no full value.
    """
    rest = [c for c in records.columns if c not in IDENTITY_KEYS]
    names = F.array(*[F.struct(F.lit(i).alias("place"), F.col(k).cast("string").alias("value")) for i, k in enumerate(IDENTITY_KEYS) if k in records.columns])
    rows = records.select(F.struct(*rest).alias("row"), "position", F.explode(F.filter(names, lambda x: F.trim(x["value"]) != "")).alias("n"))
    key = F.lower(F.trim("n.value"))
    both = F.explode(F.array(F.struct(key.alias("key"), F.lit(True).alias("whole")), F.struct(F.lower(F.trim(F.substring_index("n.value", "@", 1))).alias("key"), F.lit(False).alias("whole"))))
    rows = rows.select("row", F.struct("position", "n.place").alias("order"), both.alias("k")).select("row", "order", "k.key", "k.whole").where("key <> ''")
    found = F.coalesce(F.max_by(F.when(F.col("whole"), F.col("row")), F.when(F.col("whole"), F.col("order"))), F.min_by("row", "order"))
    return rows.groupBy("key").agg(found.alias("row")).select("key", "row.*")


def highest(levels: Column) -> Column:
    """The highest of an array of criticality levels, or null."""
    return F.try_element_at(F.array_sort(F.transform(F.array_compact(levels), lambda x: F.struct(multiplier(x).alias("m"), x.alias("level")))), F.lit(-1))["level"]


def identity_context(entities: DataFrame, index: DataFrame) -> DataFrame:
    """entity, source, criticality and tags of user entities in the index (key, privileged, status, criticality): privileged and disabled accounts are critical."""
    users = entities.select("entity").distinct().where(F.col("entity").startswith("user:")).withColumn("key", F.lower(F.trim(value_of(F.col("entity")))))
    rows = users.join(index, "key")
    strong = F.coalesce(F.lower(F.col("privileged").cast("string")).isin(*YES), F.lit(False))
    off = F.coalesce(F.lower(F.trim("status")).isin(*DISABLED), F.lit(False))
    level = F.when(strong | off, "critical").otherwise(criticality(F.col("criticality")))
    tags = F.array_compact(F.array(F.when(strong, "privileged"), F.when(off, "disabled-account")))
    return rows.select("entity", F.lit("identity").alias("source"), level.alias("criticality"), tags.alias("tags"))


def indicator_lookup(entities: DataFrame, clauses: DataFrame, listed: int = 10) -> DataFrame:
    """entity, how many indicator clauses (indicator, name, type, value) equal its value, and the first names by indicator."""
    by_value = clauses.groupBy("value", F.coalesce("name", "indicator").alias("name")).agg(F.count("*").alias("n"), F.min("indicator").alias("first"))
    order = Window.partitionBy("value").orderBy("first", "name")
    by_value = by_value.withColumn("r", F.row_number().over(order)).groupBy("value").agg(F.sum("n").alias("hits"), F.array_sort(F.collect_list(F.when(F.col("r") <= listed, F.struct("r", "name")))).alias("l"))
    known = entities.select("entity").distinct().withColumn("value", F.lower(F.trim(value_of(F.col("entity")))))
    return known.join(by_value, "value").select("entity", "hits", F.transform("l", lambda x: x["name"]).alias("indicators"))


def context_table(*parts: DataFrame) -> DataFrame:
    """All that enrichers (entity, source, criticality, tags; a row an entity each) know of each entity: sources, the highest criticality, and tags."""
    rows = reduce(DataFrame.unionByName, [p.select("entity", "source", "criticality", "tags", F.lit(i).alias("place")) for i, p in enumerate(parts)])
    found = rows.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("place", "source", "criticality", "tags"))).alias("c"))
    return found.select("entity", F.transform("c", lambda x: x["source"]).alias("sources"), highest(F.col("c.criticality")).alias("criticality"), F.array_distinct(F.flatten("c.tags")).alias("tags"))
