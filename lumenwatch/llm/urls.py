"""URL filters with redirect equivalence.

A page is the node host + path of its url. Redirects (meta refresh, or given edges) and canonical links join
nodes; distributed connected components make aliases of one another. A page that a rule fits takes the
rule's verdict. Any other page takes its component's: allow if an explicit allow rule fits any alias
(allow goes first), else block if a block rule fits one, else allow.

Links are resolved as browsers do: against the page's url or its <base>, with . and .. removed; a link to
a query or fragment alone is the page itself; links of other schemes (mailto:, javascript:) are none. Tags
are read from < to the next > without another < between, so unclosed tags cost no more than closed ones.

Defined cases: a null url, or one without ://, has an empty host and path, no rule and no alias; urls in
other forms of the same host and path are one node; a page may have several canonical links, and each
joins; repeated pages are judged each; links to urls that have no page still join those that point there;
empty tables give no rows; clashing columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, save
from .decontaminate import LOWER, UPPER

#: Rules are broadcast up to this many; beyond it they are joined by shuffle.
BROADCAST_RULES = 200_000
TAG = r"(?is)<(?:link|meta|base)\s[^<>]*>"
CANONICAL = r"(?is)^<link\s(?:.*\s)?rel\s*=\s*[\"']?\s*canonical\b"
REFRESH = r"(?is)^<meta\s(?:.*\s)?http-equiv\s*=\s*[\"']?\s*refresh\b"
BASE = r"(?is)^<base\s"
HREF = r"(?is)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
TARGET = r"(?is)[;\s\"']url\s*=\s*[\"']?\s*([^\"'\s>]+)"
SCHEME, WEB = r"^[A-Za-z][A-Za-z0-9+.-]*:", r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def without_dots(path: Column) -> Column:
    """The path with its . and .. segments removed; paths without any are left alone."""
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    step = lambda kept, x: F.when(x == "..", up(kept)).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    slash = lambda k: F.when(path.rlike(r"/\.\.?$") & (F.try_element_at(k, F.lit(-1)) != ""), "/").otherwise("")
    joined = let(kept, lambda k: F.concat(F.array_join(k, "/"), slash(k)))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), let(joined, lambda x: F.when(x == "", "/").otherwise(x))).otherwise(path)


def resolved(rows: DataFrame, name: str, href: str, host: str, path: str, outer: bool = False) -> DataFrame:
    """rows with the url that a link leads to, seen from the columns host and path; outer keeps rows whose link leads to no web page."""
    here, way = F.concat(F.lit("http://"), host), F.regexp_extract(href, r"^[^?#]*", 0)
    inner = F.concat(F.regexp_extract(path, r"^.*/", 0), F.when(F.col(path).contains("/"), "").otherwise("/"), way)
    url = (
        F.when(F.col(href).rlike(WEB), F.col(href))
        .when(F.col(href).rlike(SCHEME), F.lit(None))
        .when(F.col(href).startswith("//"), F.concat(F.lit("http:"), href))
        .when(F.col(href).rlike("^([?#]|$)"), F.concat(here, path))
        .otherwise(F.concat(here, F.when(F.col(href).startswith("/"), way).otherwise(inner)))
    )
    rows = rows.select("*", (F.explode_outer if outer else F.explode)(F.array_compact(F.array(url))).alias("_url"))
    to = F.when(F.col("_url").isNotNull(), F.concat(F.lit("http://"), host_of(F.col("_url")), let(path_of(F.col("_url")), without_dots)))
    return rows.withColumn(name, to).drop("_url")


def unescaped(ref: Column) -> Column:
    return F.regexp_replace(F.trim(ref), "&amp;", "&")


def href_of(tag: Column) -> Column:
    return unescaped(F.concat(*[F.coalesce(F.regexp_extract(tag, HREF, i), F.lit("")) for i in (1, 2, 3)]))


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges (from_url, to_url) of canonical links and meta refreshes in the pages' html."""
    wanted = lambda t: t.rlike(BASE) & t.rlike(HREF) | t.rlike(CANONICAL) | t.rlike(REFRESH)
    rows = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.filter(F.regexp_extract_all("html", F.lit(TAG), F.lit(0)), wanted).alias("tags"))
    rows = rows.where("size(tags) > 0").select("url", "tags", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("base", href_of(F.try_element_at(F.filter("tags", lambda t: t.rlike(BASE)), F.lit(1))))
    rows = resolved(rows, "base", "base", "host", "path", outer=True)
    rows = rows.withColumn("host", F.when(F.col("base").isNull(), F.col("host")).otherwise(host_of(F.col("base")))).withColumn("path", F.when(F.col("base").isNull(), F.col("path")).otherwise(path_of(F.col("base"))))
    links = F.transform(F.filter("tags", lambda t: ~t.rlike(BASE)), lambda t: F.when(t.rlike(CANONICAL), href_of(t)).otherwise(unescaped(F.regexp_extract(t, TARGET, 1))))
    found = rows.select("url", "host", "path", F.explode(F.filter(links, lambda x: x != "")).alias("href"))
    return resolved(found, "to_url", "href", "host", "path").select(F.col("url").alias("from_url"), "to_url")


def ruled(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """nodes (host, path) with the longest rule (host, path, verdict) that fits: rule and rule_verdict, null without one.

    A rule fits its host and all subdomains if the path starts with its own; equal lengths go to allow.
    """
    rules = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict")).distinct()
    rules = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    parts = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    fits = nodes.withColumn("_host", suffix).join(rules, "_host").where(F.col("path").startswith(F.col("_path")))
    rule = F.concat("_host", "_path")
    best = F.max(F.struct(F.length(rule), F.col("_verdict") == "allow", rule.alias("rule"), F.col("_verdict").alias("v")))
    fits = fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", F.col("b.rule").alias("rule"), F.col("b.v").alias("rule_verdict"))
    return nodes.join(fits.hint("merge"), ["host", "path"], "left")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; redirects: further edges (from_url, to_url)."""
    edges = link_edges(pages)
    edges = edges if redirects is None else edges.unionByName(redirects.select("from_url", "to_url"))
    ends = [F.struct(host_of(F.col(c)).alias("host"), path_of(F.col(c)).alias("path")).alias(n) for c, n in (("from_url", "a"), ("to_url", "b"))]
    edges = save(edges.select(*ends).where("a.host <> '' AND b.host <> ''").distinct(), "links")
    alias = components(edges).select("node.host", "node.path", "component")
    known = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = known.where("host <> ''")
    nodes = named.select("host", "path").union(alias.select("host", "path")).distinct()
    nodes = ruled(nodes, rules).join(alias.hint("merge"), ["host", "path"], "left")
    nodes = save(nodes, "nodes")
    group = nodes.where("component IS NOT NULL AND rule IS NOT NULL").groupBy("component").agg(F.min("rule_verdict").alias("group_verdict"))  # allow sorts before block
    verdict = F.coalesce("rule_verdict", "group_verdict", F.lit("allow")).alias("verdict")
    nodes = nodes.join(group.hint("merge"), "component", "left").select("host", "path", "rule", verdict)
    rest = known.where("host = ''").select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return named.join(nodes.hint("merge"), ["host", "path"]).select("page_id", "host", "path", "rule", "verdict").unionByName(rest)


#: The rules (host, path, verdict) of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_NODE = lambda url: f"translate(regexp_extract({url}, '{_URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract({url}, '{_URL}', 2) AS path"
_REF = lambda name: rf"""trim(replace(regexp_extract(tag, '(?is)[\s;"'']{name}\s*=\s*["'']?\s*([^"''>]*)', 1), '&amp;', '&'), ' "''')"""
SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, {_NODE("coalesce(url, '')")} FROM pages),
t AS (SELECT host, path, url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta|base)\s[^<>]*>')) AS tag FROM p WHERE host <> ''),
h AS (SELECT host, path, CASE WHEN starts_with(lower(tag), '<link') THEN {_REF("href")} ELSE {_REF("url")} END AS href FROM t
  WHERE regexp_matches(tag, '(?is)^<link\s.*rel\s*=\s*.?canonical') OR regexp_matches(tag, '(?is)^<meta\s.*http-equiv\s*=\s*.?refresh')),
l AS (SELECT host AS h1, path AS p1, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN 'http:' || href
  WHEN starts_with(href, '/') THEN 'http://' || host || href WHEN href[1] IN ('?', '#') THEN 'http://' || host || path
  ELSE 'http://' || host || regexp_replace(path, '[^/]*$', '') || CASE WHEN path = '' THEN '/' ELSE '' END || href END AS target
  FROM h WHERE href <> ''),
e0 AS (SELECT DISTINCT h1, p1, {_NODE("target")} FROM l),
e AS (SELECT h1, p1, host AS h2, path AS p2 FROM e0 WHERE host <> '' UNION SELECT host, path, h1, p1 FROM e0 WHERE host <> ''),
reach AS (SELECT h1, p1, h2, p2 FROM e UNION SELECT r.h1, r.p1, e.h2, e.p2 FROM reach r JOIN e ON r.h2 = e.h1 AND r.p2 = e.p1),
n AS (SELECT DISTINCT host, path FROM p WHERE host <> '' UNION SELECT h1, p1 FROM e),
rules(rh, rp, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
fit AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM n JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
g AS (SELECT h1 AS host, p1 AS path, min(v) AS gv FROM reach JOIN fit ON fit.host = h2 AND fit.path = p2 GROUP BY ALL)
SELECT page_id, p.host, p.path, fit.rule, coalesce(fit.v, gv, 'allow') AS verdict
FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path LEFT JOIN g ON p.host = g.host AND p.path = g.path"""
