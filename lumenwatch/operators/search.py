"""Searches, timelines, source health, keyword retrieval and audit verification."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import newest_of

#: Words that searches leave out.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with",
    "as", "by", "at", "from", "this", "that", "these", "those", "is", "are",
    "was", "were", "be", "been",
]
SEARCHED = ["event_id", "action", "user_name", "host", "src_ip", "source", "command_line"]
KINDS = {"user": "user_name", "host": "host", "ip": "src_ip"}


def search_events(events: DataFrame, text: str | None = None, entity: str | None = None) -> DataFrame:
    """Case-insensitive LIKE over SEARCHED (% and _ are wildcards), and an entity: exact for KINDS, else part of any column."""
    tests: list[Column] = []
    if text:
        tests.append(reduce(or_, [F.coalesce(F.col(c).cast("string").ilike(f"%{text}%"), F.lit(False)) for c in SEARCHED]))
    if entity:
        kind, _, value = entity.partition(":")
        tests.append(F.col(KINDS[kind]) == value if kind in KINDS else F.concat_ws(" ", *[F.col(c).cast("string") for c in SEARCHED], "cloud_account").contains(value or kind))
    return events.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def source_health(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def entity_profile(rows: DataFrame, newest: int = 25) -> DataFrame:
    """Per entity, over its newest events: how many, first and last time, and distinct actions and categories."""
    last = newest_of(rows, ["entity"], [F.desc("us"), F.desc("seq")], newest)
    return last.groupBy("entity").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.concat_ws(",", F.array_sort(F.collect_set("action"))).alias("actions"), F.concat_ws(",", F.array_sort(F.collect_set("category"))).alias("categories"))


def event_summary() -> Column:
    """One line about an event; fields it doesn't have are unknown."""
    told = lambda c, none: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none))
    return F.concat(F.coalesce("action", F.lit("unknown")), F.lit(" user="), told("user_name", "unknown-user"), F.lit(" host="), told("host", "unknown-host"), F.lit(" src_ip="), told("src_ip", "unknown-ip"))


def timeline(incidents: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of an incident's course: one for its creation (its title, risk and summary) and one for each finding (its rule_name, risk, and its event's summary)."""
    rows = members.join(events.select("event_id", "action", "user_name", "host", "src_ip"), "event_id", "left")
    rows = rows.select("incident_key", "us", F.lit("finding").alias("kind"), F.col("finding_id").alias("ref"), F.col("rule_name").alias("title"), "severity", F.col("risk_points").cast("long").alias("risk"), event_summary().alias("summary"))
    made = incidents.select("incident_key", F.col("first_us").alias("us"), F.lit("incident_created").alias("kind"), F.col("incident_key").alias("ref"), "title", "severity", F.col("risk_score").cast("long").alias("risk"), F.coalesce("summary", F.lit("Incident created.")).alias("summary"))
    return rows.unionByName(made)


def tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))


def retrieve(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best documents (doc_id, text) of each query (query_id, text): sum over query words of tf * (ln((1 + N) / (1 + df)) + 1).

    Query words pick the postings before any score is made, so only their postings are shuffled; repeated
    words of a query count again. Ties go to the smaller doc_id.
    """
    n = corpus.agg(F.count("*").alias("n_docs"))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    postings = corpus.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    postings = postings.join(asked.select("term").distinct(), "term", "left_semi")
    df = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    weights = df.select("term", (F.log((F.lit(1) + F.col("n_docs")) / (F.lit(1) + F.col("df"))) + 1).alias("idf"))
    scored = postings.join(weights, "term").join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("times") * F.col("tf") * F.col("idf")).alias("score"))
    scored = scored.withColumn("score", F.round("score", 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def audit_log(events: DataFrame, block: int = 1 << 16) -> DataFrame:
    """An audit row for each event: seq, payload, the payload's hash and the one before it."""
    payload = F.concat_ws("|", F.col("seq").cast("string"), "action", F.coalesce("user_name", F.lit("")), "outcome")
    return chained(events.select("seq", payload.alias("payload")).withColumn("hash", F.sha2("payload", 256)), "prev_hash", block)


def chained(log: DataFrame, name: str, block: int = 1 << 16) -> DataFrame:
    """log with the hash of the row before it in seq: windows within blocks of seq, and the last hash of the block before."""
    rows = log.withColumn("_block", F.floor(F.col("seq") / block))
    inside = Window.partitionBy("_block").orderBy("seq")
    ends = rows.groupBy("_block").agg(F.max_by("hash", "seq").alias("_end"))
    ends = ends.select((F.lead("_block").over(Window.orderBy("_block"))).alias("_block"), "_end").where("_block IS NOT NULL")  # a row for each block
    return rows.withColumn("_lag", F.lag("hash").over(inside)).join(ends, "_block", "left").withColumn(name, F.coalesce("_lag", "_end", F.lit(""))).drop("_block", "_lag", "_end")


def verify_chain(log: DataFrame) -> DataFrame:
    """Rows of a log whose hash isn't their payload's, or whose prev_hash isn't the hash before."""
    rows = chained(log, "_before")
    problem = F.when(F.col("hash") != F.sha2("payload", 256), "payload").when(F.col("prev_hash") != F.col("_before"), "link")
    return rows.select("seq", problem.alias("problem")).where("problem IS NOT NULL")


def seal(key: bytes, text: Column) -> Column:
    """HMAC-SHA256 of the text under the key, in lower-case hexadecimal digits."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    inner = F.sha2(F.concat(pad(0x36), text.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def verify_seals(log: DataFrame, key: bytes) -> DataFrame:
    """Rows of a log (seq, hash, mac) whose mac isn't their hash's seal, or that have none although an earlier row has one."""
    sealed = F.coalesce("mac", F.lit("")) != ""
    first = log.where(sealed).agg(F.min("seq").alias("_first"))  # one row
    rows = log.crossJoin(F.broadcast(first))
    problem = F.when(sealed & (F.col("mac") != seal(key, F.coalesce("hash", F.lit("")))), "mac").when(~sealed & (F.col("seq") > F.col("_first")), "unsigned")
    return rows.select("seq", problem.alias("problem")).where("problem IS NOT NULL")


def seal_summary(log: DataFrame) -> DataFrame:
    """Per tenant: rows of an audit log, and those with a seal."""
    return log.groupBy("tenant").agg(F.count("*").alias("total"), F.count("mac").alias("sealed"))


def open_incidents(stored: DataFrame, entities: list[str], newest: int = 500) -> DataFrame:
    """Per tenant, the newest open incidents that share one of the entities (a top-k report)."""
    rows = stored.where(F.col("status").isin("open", "investigating") & F.arrays_overlap("entities", F.array(*map(F.lit, entities))))
    return newest_of(rows, ["tenant"], [F.desc("last_us"), F.asc("incident_key")], newest)


def search_incidents(stored: DataFrame, text: str | None = None, entity: str | None = None, status: str | None = None, newest: int = 50) -> DataFrame:
    """Incidents (incident_key, title, severity, status, entities, kill_chain) by case-insensitive LIKE over their fields, part of an entity and status: the highest risk first, then the newer (a top-k report)."""
    data = F.to_json(F.struct("entities", "kill_chain"))
    fields = [F.col("incident_key"), F.col("title"), F.col("severity").cast("string"), data]
    tests = [reduce(or_, [f.ilike(f"%{text}%") for f in fields])] if text else []
    tests += [data.ilike(f"%{entity}%")] if entity else []
    tests += [F.col("status") == status] if status else []
    found = stored.where(reduce(lambda a, b: a & b, tests, F.lit(True)))
    return found.orderBy(F.desc("risk_score"), F.desc("first_us"), "incident_key").limit(newest)


def incident_bundle(incidents: DataFrame, members: DataFrame, proposals: DataFrame, log: DataFrame) -> DataFrame:
    """All that is stored about each incident: a row (incident_key, part, ref, told) for its findings, their events, its proposals and its latest decision in a log (incident_key, decision, at)."""
    row = lambda df, part, ref, told: df.select("incident_key", F.lit(part).alias("part"), ref.cast("string").alias("ref"), told.cast("string").alias("told"))
    own = members.join(incidents.select("incident_key"), "incident_key", "left_semi")
    latest = log.groupBy("incident_key").agg(F.max_by("decision", "at").alias("decision"), F.max("at").alias("at"))
    parts = [
        row(own, "finding", F.col("finding_id"), F.col("rule_id")),
        row(own.select("incident_key", "event_id").distinct(), "event", F.col("event_id"), F.lit("")),
        row(proposals, "proposal", F.concat_ws(" ", "action", "target"), F.when(F.col("approval_required"), "approval").otherwise("free")),
        row(latest.join(incidents.select("incident_key"), "incident_key", "left_semi"), "decision", F.col("at"), F.col("decision")),
    ]
    return reduce(DataFrame.unionByName, parts)


def audit_list(log: DataFrame, newest: int = 100) -> DataFrame:
    """The newest audit rows of each tenant (a top-k report)."""
    return newest_of(log, ["tenant"], [F.desc("seq")], newest)


def incident_document() -> Column:
    """A stored incident as a text for retrieval: title, status, resolution, techniques, entities and summary, as far as there."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, " "))
    parts = [F.concat(F.lit("[past incident] "), F.coalesce("title", F.lit(""))), F.concat(F.lit("status="), "status"), F.concat(F.lit("resolution="), "resolution"), listed("kill_chain"), listed("entities"), F.nullif(F.col("summary"), F.lit(""))]
    return F.concat_ws(" | ", *parts)


def retrieval_corpus(stored: DataFrame, runbooks: DataFrame, newest: int = 50) -> DataFrame:
    """doc_id and text of the runbooks (name, content) and of each tenant's newest incidents (a top-k corpus)."""
    last = newest_of(stored, ["tenant"], [F.desc("first_us"), F.asc("incident_key")], newest)
    books = runbooks.select(F.concat(F.lit("runbook:"), "name").alias("doc_id"), F.concat(F.lit("[runbook] "), "name", F.lit("\n"), "content").alias("text"))
    return last.select(F.col("incident_key").alias("doc_id"), incident_document().alias("text")).unionByName(books)
