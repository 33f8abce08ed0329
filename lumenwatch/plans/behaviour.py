"""Registered queries of behaviour, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behaviour, graph
from ..sources.events import X, security_events

BURST_US = 6 * 3600 * 1_000_000


def behaviour_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.signals(security_events(spark, sf_dir), BURST_US)


def behaviour_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.findings(behaviour_signals(spark, sf_dir))


def behaviour_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.baseline(security_events(spark, sf_dir))


def behaviour_baseline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of the sources' events, merged, equal the baseline of all events."""
    events = security_events(spark, sf_dir)
    first = F.col("source").isin("src0", "src1")
    return behaviour.merge_baselines(behaviour.baseline(events.where(first)), behaviour.baseline(events.where(~first)))


def behaviour_score_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last ten days against the baseline of the days before."""
    events = security_events(spark, sf_dir)
    cut = events.agg((F.max("us") - 10 * 86_400_000_000).alias("cut"))
    events = events.crossJoin(F.broadcast(cut))  # one row
    old = events.where("us <= cut")
    return behaviour.score_only(events.where("us > cut"), behaviour.baseline(old), behaviour.recent_times(old), BURST_US)


def behaviour_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last ten days scored warm: the state of the days before, and what the batch itself showed earlier."""
    events = security_events(spark, sf_dir)
    cut = events.agg((F.max("us") - 10 * 86_400_000_000).alias("cut"))
    events = events.crossJoin(F.broadcast(cut))  # one row
    old = events.where("us <= cut").drop("cut")
    state, recent = graph.save(behaviour.baseline(old), "baseline"), graph.save(behaviour.recent_times(old), "recent")
    return behaviour.signals(events.where("us > cut").drop("cut"), BURST_US, state, recent)


_LAST = "OVER (PARTITION BY entity ORDER BY seq ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING)"
SIGNAL_CTES = f"""u1 AS (SELECT event_id, seq, entity, 'novel_action' AS signal, 15 AS points FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) AS r,
  row_number() OVER (PARTITION BY entity, action ORDER BY seq) AS ra FROM x) WHERE r > 1 AND ra = 1),
u2 AS (SELECT event_id, seq, 'user:' || user_name, 'novel_src_ip', 25 FROM (SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY seq) AS r,
  row_number() OVER (PARTITION BY user_name, src_ip ORDER BY seq) AS ra FROM v WHERE user_name <> '' AND src_ip <> '') WHERE r > 1 AND ra = 1),
u3 AS (SELECT event_id, seq, 'user:' || user_name, 'novel_host', 20 FROM (SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY seq) AS r,
  row_number() OVER (PARTITION BY user_name, host ORDER BY seq) AS ra FROM v WHERE user_name <> '' AND host <> '') WHERE r > 1 AND ra = 1),
u4 AS (SELECT event_id, seq, entity, 'off_hours', 20 FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) AS r,
  row_number() OVER (PARTITION BY entity, hour ORDER BY seq) AS rh FROM x) WHERE r > 5 AND rh = 1),
u5 AS (SELECT event_id, seq, entity, 'burst', 25 FROM (SELECT *, len(list_filter(list(us) {_LAST}, lambda t: t >= us - {BURST_US})) + 1 AS n FROM x) WHERE n >= 8),
u6 AS (SELECT event_id, seq, coalesce(entities[1], 'global:unknown'), 'rare_action', greatest(1.0, round_even(20 * (1.0 - s / (seq - 1) / 0.05), 0)) FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY action ORDER BY seq) - 1 AS DOUBLE) AS s FROM ve) WHERE seq - 1 >= 20 AND s / (seq - 1) <= CAST(0.05 AS DOUBLE)),
f AS (SELECT *, min(seq) OVER (PARTITION BY entity, action) AS fa, min(seq) OVER (PARTITION BY entity) AS fe FROM x),
q AS (SELECT *, coalesce(sum(CASE WHEN seq = fe THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS peers,
  coalesce(sum(CASE WHEN seq = fa THEN 1 ELSE 0 END) OVER (PARTITION BY kind, action ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS doers FROM f),
u7 AS (SELECT event_id, seq, entity, 'peer_rare', greatest(1.0, round_even(20 * (1.0 - fr / 0.2), 0)) FROM
  (SELECT *, CAST(doers - CASE WHEN fa < seq THEN 1 ELSE 0 END AS DOUBLE) / CAST(peers - 1 AS DOUBLE) AS fr FROM q WHERE peers >= 5) WHERE fr <= CAST(0.2 AS DOUBLE)),
s AS (SELECT * FROM u1 UNION ALL SELECT * FROM u2 UNION ALL SELECT * FROM u3 UNION ALL SELECT * FROM u4 UNION ALL SELECT * FROM u5 UNION ALL SELECT * FROM u6 UNION ALL SELECT * FROM u7)"""
SIGNALS = f"{X},\n{SIGNAL_CTES}"
_COUNTS = """SELECT 'entity_action' AS name, entity AS key, action AS value, count(*) AS n FROM x{w} GROUP BY ALL
UNION ALL SELECT 'user_src_ip', user_name, src_ip, count(*) FROM v{a} user_name <> '' AND src_ip <> '' GROUP BY ALL
UNION ALL SELECT 'user_host', user_name, host, count(*) FROM v{a} user_name <> '' AND host <> '' GROUP BY ALL
UNION ALL SELECT 'entity_hour', entity, CAST(hour AS STRING), count(*) FROM x{w} GROUP BY ALL
UNION ALL SELECT 'entity', entity, '', count(*) FROM x{w} GROUP BY ALL
UNION ALL SELECT 'action', action, '', count(*) FROM v{w} GROUP BY ALL
UNION ALL SELECT 'kind_action', kind, action, count(DISTINCT entity) FROM x{w} GROUP BY ALL"""
_CUT = "(SELECT max(us) - 10 * 86400000000 FROM v)"


def _unseen(rows: str, key: str, value: str, name: str, entity: str, points: int) -> str:
    some = f"{key} <> '' AND {value} <> ''"
    return f"""SELECT event_id, seq, {entity} AS entity, '{name}' AS signal, CAST({points} AS BIGINT) AS points FROM {rows} r WHERE us > {_CUT} AND {some}
  AND EXISTS (SELECT 1 FROM {rows} o WHERE o.us <= {_CUT} AND o.{key} = r.{key} AND o.{value} <> '')
  AND NOT EXISTS (SELECT 1 FROM {rows} o WHERE o.us <= {_CUT} AND o.{key} = r.{key} AND o.{value} = r.{value})"""


_OLD = f"""o AS (SELECT * FROM x WHERE us <= {_CUT}), nw AS (SELECT * FROM x WHERE us > {_CUT}), ov AS (SELECT * FROM ve WHERE us <= {_CUT}), nv AS (SELECT * FROM ve WHERE us > {_CUT}),
en AS (SELECT entity, count(*) AS n, list(us ORDER BY seq DESC)[1:256] AS times FROM o GROUP BY 1), eh AS (SELECT DISTINCT entity, hour FROM o), ea AS (SELECT DISTINCT kind, entity, action FROM o),
ka AS (SELECT kind, action, count(*) AS doers FROM ea GROUP BY ALL), kp AS (SELECT kind, count(DISTINCT entity) AS peers FROM o GROUP BY 1), an AS (SELECT action, count(*) AS seen FROM ov GROUP BY 1), tn AS (SELECT count(*) AS total FROM ov)"""
_STATIC = f"""SELECT event_id, seq, entity, 'off_hours', 20 FROM nw JOIN en USING (entity) WHERE n >= 5 AND NOT EXISTS (SELECT 1 FROM eh WHERE eh.entity = nw.entity AND eh.hour = nw.hour)
UNION ALL SELECT event_id, seq, entity, 'burst', 25 FROM nw JOIN en USING (entity) WHERE n >= 5 AND len(list_filter(times, lambda t: t >= us - {BURST_US})) + 1 >= 8
UNION ALL SELECT event_id, seq, coalesce(entities[1], 'global:unknown'), 'rare_action', CAST(greatest(1.0, round_even(20 * (1.0 - f / 0.05), 0)) AS BIGINT) FROM (SELECT *, CAST(coalesce(seen, 0) AS DOUBLE) / total AS f FROM nv LEFT JOIN an USING (action), tn) WHERE total >= 20 AND f <= CAST(0.05 AS DOUBLE)
UNION ALL SELECT event_id, seq, entity, 'peer_rare', CAST(greatest(1.0, round_even(20 * (1.0 - f / 0.2), 0)) AS BIGINT) FROM (SELECT nw.*, CAST(coalesce(doers, 0) - CASE WHEN ea.entity IS NULL THEN 0 ELSE 1 END AS DOUBLE) / (peers - 1) AS f
  FROM nw JOIN kp USING (kind) LEFT JOIN ka ON ka.kind = nw.kind AND ka.action = nw.action LEFT JOIN ea ON ea.entity = nw.entity AND ea.action = nw.action WHERE peers >= 5) WHERE f <= CAST(0.2 AS DOUBLE)"""
QUERIES = [behaviour_signals, behaviour_findings, behaviour_baseline, behaviour_baseline_merge, behaviour_score_only, behaviour_warm]
SQL = {
    "behaviour_signals": f"WITH {SIGNALS} SELECT event_id, seq, entity, signal, CAST(points AS BIGINT) AS points FROM s",
    "behaviour_findings": f"""WITH {SIGNALS}, t AS (SELECT event_id, CAST(least(sum(points), 100) AS BIGINT) AS score, string_agg(DISTINCT signal, ', ' ORDER BY signal) AS names FROM s GROUP BY 1)
SELECT *, CASE WHEN score >= 50 THEN 'high' ELSE 'medium' END AS severity FROM t WHERE score >= 25""",
    "behaviour_baseline": f"WITH {X} {_COUNTS.format(w='', a=' WHERE')}",
    "behaviour_baseline_merge": f"WITH {X} {_COUNTS.format(w='', a=' WHERE')}",
    "behaviour_warm": f"WITH {SIGNALS} SELECT event_id, s.seq, entity, signal, CAST(points AS BIGINT) AS points FROM s JOIN v USING (event_id) WHERE us > {_CUT}",
    "behaviour_score_only": f"WITH {X}, {_OLD} "
    + " UNION ALL ".join((_unseen("x", "entity", "action", "novel_action", "entity", 15), _unseen("v", "user_name", "src_ip", "novel_src_ip", "'user:' || user_name", 25), _unseen("v", "user_name", "host", "novel_host", "'user:' || user_name", 20), _STATIC)),
}
