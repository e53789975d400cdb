"""URL filters with redirect equivalence, as DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, need, read, stored
from .components import connected_components

#: Rules go into the plan as a literal; longer lists are refused.
MAX_RULES = 10_000
ALLOW, BLOCK = "allow", "block"

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def page_key(url: Column) -> Column:
    """What makes two urls the same page here: host and the rest without scheme and fragment."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(host_of(url), F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest))))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The fitting rule as a struct ``(verdict, rule)``, or null.

    ``rules`` are ``(verdict, host, path prefix)``.  A rule fits its host and all
    subdomains if the path starts with its prefix.  The longest ``host + prefix``
    wins; of equally long ones allow wins, then the first by code points.  The
    host's suffixes are looked up in a map, so the cost does not grow with the list.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} go into a plan")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, h, prefix in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"verdict {verdict!r}")
        by_host.setdefault(h.lower(), []).append((prefix, verdict))
    one = lambda h, p, v: F.struct(F.lit(-len(h + p)).alias("longest"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"), F.lit(p).alias("prefix"))
    if not by_host:
        return F.lit(None).cast("struct<longest: int, verdict: string, rule: string, prefix: string>")
    known = F.map_from_arrays(F.array(*map(F.lit, by_host)), F.array(*[F.array(*[one(h, p, v) for p, v in found]) for h, found in by_host.items()]))
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(known, s), F.array().cast("array<struct<longest: int, verdict: string, rule: string, prefix: string>>")))), lambda r: F.startswith(path, r["prefix"]))
    return F.array_min(fitting)


def _bind(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, which also keeps the generated code small."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _attribute(tag: Column, name: str) -> Column:
    return F.btrim(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), F.lit("\"'"))


def resolve(url: Column, target: Column) -> Column:
    """``target`` seen from the page at ``url``: absolute, ``//host``, ``/path``, ``?query`` or relative to the directory.

    Fragments alone, empty targets and schemes without ``//`` lead nowhere (null).
    """
    base = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(url, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.concat(base, F.coalesce(F.nullif(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*/|/)", 1), F.lit("")), F.lit("/")))

    def choose(t: Column) -> Column:
        return (
            F.when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), t)
            .when(t.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), t))
            .when(t.startswith("/"), F.concat(base, t))
            .when(t.startswith("?"), F.concat(page, t))
            .when((t == "") | t.startswith("#") | t.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
            .otherwise(F.concat(folder, t))
        )

    return _bind(F.btrim(F.replace(target, F.lit("&amp;"), F.lit("&")), F.lit(" \t\r\n\f")), choose)


def page_links(pages: DataFrame) -> DataFrame:
    """``(from_url, to_url)`` of canonical links and refresh redirects in ``pages(url, html)``.

    All ``link`` and ``meta`` tags of the whole html are read.  Null html has none.
    """
    tags = F.expr(r"""regexp_extract_all(html, '(?is)<(?:link|meta)\\s[^>]*>', 0)""")
    rows = pages.where(F.col("html").rlike(r"(?i)canonical|refresh")).select("url", F.explode(tags).alias("tag"))

    def target(tag: Column) -> Column:
        rel = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
        refresh = F.lower(_attribute(tag, "http-equiv")) == "refresh"
        wait = r"""(?is)^\s*[\d.]+\s*[;,]\s*(?:url\s*=)?\s*['"]?([^'"]*)"""
        return F.when(rel, _attribute(tag, "href")).when(refresh, F.regexp_extract(_attribute(tag, "content"), wait, 1))

    return rows.select(F.col("url").alias("from_url"), resolve(F.col("url"), _bind(F.col("tag"), target)).alias("to_url")).where("to_url IS NOT NULL")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict, component)`` for every page.

    A page with a fitting rule gets that rule's verdict; an explicit allow holds
    whatever its aliases are.  A page without one is blocked if it is reachable,
    over canonical links, refresh redirects and the given ``redirects(from_url,
    to_url)`` in either direction, from a url that a rule blocks (crawled or not),
    and allowed otherwise.  Urls that differ in scheme or fragment only are one node.

    ``component`` is the smallest node of the page's class, null for pages without
    links.  Null urls and urls without ``://`` have empty host and path, fit no
    rule, have no links and are allowed.  Repeated rows stay; an empty table gives
    an empty result; further columns are ignored.
    """
    rows = need(pages, [c for c in (id_col, url_col, html_col) if c]).toDF(*(["page_id", "url", "html"][: 3 if html_col else 2]))
    url = F.col("url")
    parts = rows.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    judged = parts.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("own"), page_key(url).alias("key"))
    edges = []
    if html_col:
        edges.append(page_links(rows))
    if redirects is not None:
        edges.append(need(redirects, ("from_url", "to_url")))
    if not edges:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit(ALLOW)).alias("verdict"), F.lit(None).cast("string").alias("component"))
    linked = edges[0]
    for e in edges[1:]:
        linked = linked.unionAll(e)
    to_key = stored(linked, "url-links").select(page_key(F.col("from_url")).alias("u"), page_key(F.col("to_url")).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = connected_components(to_key)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    blocks = rule_for(host_of(as_url), path_of(as_url), rules)["verdict"] == BLOCK
    tainted = nodes.groupBy("component").agg(F.max(F.coalesce(blocks, F.lit(False))).alias("blocked"))
    aliases = stored(nodes.join(stored(tainted, "url-tainted"), "component").select("node", "component", "blocked"), "url-aliases")
    return judged.join(aliases, judged.key == aliases.node, "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("blocked"), F.lit(BLOCK)), F.lit(ALLOW)).alias("verdict"), "component"
    )


RULES = ((ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), RULES)


OP4_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
    regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') AS rest FROM pages),
k AS (SELECT *, CASE WHEN contains(url, '://') THEN host || CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END END AS key FROM u),
tags AS (SELECT key, url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM k WHERE regexp_matches(html, '(?i)canonical|refresh')),
links AS (
  SELECT key, CASE WHEN regexp_matches(tag, '(?is)\srel\s*=\s*["'']?[^"''>]*canonical') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''>\s]+)', 1)
    WHEN regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)url\s*=\s*([^"''>\s]+)', 1) END AS target FROM tags),
edge AS (SELECT key AS a, regexp_replace(translate(regexp_extract(target, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(target, '://[^/?#]*([^#]*)', 1), '^([^/?]*)$', '\1/') AS b FROM links WHERE contains(target, '://') AND key IS NOT NULL),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge UNION SELECT a, a FROM edge UNION SELECT b, b FROM edge),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
rules(host, prefix, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
seen AS (SELECT DISTINCT host, path FROM k UNION SELECT regexp_extract(b, '^([^/?]*)', 1), regexp_extract(b, '^[^/?]*([^?]*)', 1) FROM edge),
fit AS (SELECT s.host, s.path, max_by(r.host || r.prefix, length(r.host || r.prefix)) AS rule, max_by(r.verdict, length(r.host || r.prefix)) AS verdict
  FROM seen s JOIN rules r ON (s.host = r.host OR s.host LIKE '%.' || r.host) AND starts_with(s.path, r.prefix) GROUP BY ALL),
bad AS (SELECT r.a, bool_or(coalesce(f.verdict = 'block', false)) AS blocked, min(r.b) AS component FROM reach r
  LEFT JOIN fit f ON f.host = regexp_extract(r.b, '^([^/?]*)', 1) AND f.path = regexp_extract(r.b, '^[^/?]*([^?]*)', 1) GROUP BY r.a)
SELECT k.page_id, k.host, k.path, f.rule, coalesce(f.verdict, CASE WHEN b.blocked THEN 'block' END, 'allow') AS verdict, b.component
FROM k LEFT JOIN fit f USING (host, path) LEFT JOIN bad b ON b.a = k.key
"""
