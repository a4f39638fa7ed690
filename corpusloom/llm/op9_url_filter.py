"""URL filters with redirect equivalence.

Rules block or allow a host with its subdomains under a path; the longest fitting rule decides. Addresses
that redirect to one another, or that name one canonical address, are one resource: the connected
components over redirect and canonical-link edges share decisions. In a component with an explicitly
allowed member all others without a rule are allowed; else a blocked member blocks them; else they are
allowed. Nodes are addresses without fragment, with lower-case host.

Edges come from `<link rel=canonical>` and `<meta http-equiv=refresh>` of each page, and from a table of
redirects (source, target) if there is one. Tags are read in Python, on pages that speak of such links only; all
other steps are DataFrame operations: components by alternating stars (see ``common.components``), keys that many
pages share cost one aggregate row a task. The SQL reads plain tags only, which is enough for the tables.

A null address, or one without "://", has empty host and path, no rule and no node, and is allowed. Null
html has no edges; very long html is searched whole. Repeated pages give repeated rows. Of rules of one length
an allowing one wins. Columns beside page_id, url and html are ignored, whatever their names. An empty table
gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .op6_html import _ATTRIBUTE as ATTRIBUTE
from .op6_html import _NAME as NAME
from .op6_html import _RAW as RAW
from .op6_html import _Tags as Tags

#: verdict, host, path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule (ties: allow first, then by name), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """The address as a node: lower-case scheme and host, no fragment; null without "://"."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), F.when(rest == "", "/").otherwise(rest)))


def declared(url: str, html: str) -> list[str]:
    """Addresses that a page names as its canonical one or refreshes to, resolved against its own (or its base element's).
    Tags are read as in ``op6_html``: not in markup comments, scripts and the like, and with quoted values."""
    tags, at, base, found = Tags(html), 0, None, []
    lower = None
    while (opens := html.find("<", at)) >= 0:
        if html.startswith("<!--", opens):
            end = html.find("-->", opens + 4)
            if end < 0:
                break
            at = end + 3
            continue
        match = NAME.match(html, opens + 1)
        if not match:
            at = opens + 1
            continue
        tag, at = match[1].lower(), tags.end(match.end())
        if html[at - 1] != ">":  # cut off inside a tag
            break
        if html[opens + 1] == "/":
            continue
        attributes = html[match.end() : at - 1]
        if tag in RAW and not (tag == "svg" and attributes.endswith("/")):
            if lower is None:
                lower = html.lower() if len(html.lower()) == len(html) else html
            end = lower.find(f"</{tag}", at)
            if end < 0:
                break
            at = end
        elif tag in ("link", "meta", "base"):
            values: dict[str, str] = {}
            for name, *value in ATTRIBUTE.findall(attributes):
                values.setdefault(name.lower(), entities.unescape(value[0] or value[1] or value[2]).strip())
            if tag == "base" and base is None and values.get("href"):
                base = values["href"]
            elif tag == "link" and "canonical" in values.get("rel", "").lower().split():
                found.append(values.get("href", ""))
            elif tag == "meta" and values.get("http-equiv", "").lower() == "refresh" and (target := _REFRESH.search(values.get("content", ""))):
                found.append(target[1] or target[2] or target[3] or "")
    out = []
    for link in found:
        try:
            out += [urljoin(urljoin(url, base or ""), link.strip())] if link.strip() else []
        except ValueError:  # no address
            continue
    return out


_REFRESH = re.compile(r"""url\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s][^\s]*))""", re.I)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _declared(urls: pd.Series, htmls: pd.Series) -> pd.Series:
    return pd.Series([declared(u, h) for u, h in zip(urls, htmls)], dtype=object)


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): each page's node and the node of its canonical address or refresh target. Only pages whose html speaks of
    either are read."""
    telling = pages.where(F.col("html").rlike("(?i)canonical|refresh") & F.col("url").contains("://"))
    return (
        telling.select("url", F.explode(_declared("url", "html")).alias("link"))
        .select(node_of(F.col("url")).alias("a"), node_of(F.col("link")).alias("b"))
        .where("a is not null and b is not null and a <> b")
    )


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url, html) -> page_id, host, path, rule, verdict."""
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(
            redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).where("a <> b")
        )
    members = common.components(edges)
    decided = members.select("node", "root", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"].alias("v"))
    roots = decided.groupBy("root").agg(F.min("v").alias("method"))  # allow < block
    method = decided.join(roots, "root").where("method is not null").select("node", "method")
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")).withColumn(
        "r", rule_of(F.col("host"), F.col("path"), rules)
    )
    return judged.join(method, "node", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "method", F.lit("allow")).alias("verdict")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))


def _rule_sql(host: str, path: str, what: str) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2]))
    cases = " ".join(
        f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{v if what == 'verdict' else h + p}'"
        for v, h, p in ordered
    )
    return f"CASE {cases} END"


def _host_sql(u: str) -> str:
    return f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"


def _path_sql(u: str) -> str:
    return f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _node_sql(u: str) -> str:
    rest = f"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    scheme = f"translate(regexp_extract({u}, '(?s)^(.*?)://', 1), '{_UPPER}', '{_LOWER}')"
    return f"CASE WHEN contains({u}, '://') THEN {scheme} || '://' || {_host_sql(u)} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"


_ORIGIN_SQL = "regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)"
_FOLDER_SQL = f"regexp_extract({_path_sql('url')}, '(?s)^(.*/)', 1)"

OP9_SQL = f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\brel\\s*=\\s*["'']?\\s*canonical\\b')),
      lambda t: regexp_extract(t, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]*)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b')),
      lambda t: regexp_extract(t, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]*)', 1)))) AS raw
  FROM pages WHERE html IS NOT NULL),
links AS (SELECT url, trim(replace(raw, '&amp;', '&')) AS link FROM tags),
targets AS (
  SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?):', 1) || ':' || link
    WHEN starts_with(link, '/') THEN {_ORIGIN_SQL} || link
    WHEN link <> '' THEN {_ORIGIN_SQL} || CASE WHEN {_FOLDER_SQL} = '' THEN '/' ELSE {_FOLDER_SQL} END || link END AS target FROM links),
edges AS (SELECT {_node_sql('url')} AS a, {_node_sql('target')} AS b FROM targets),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
decided AS (SELECT a AS node, min({_rule_sql(_host_sql('b'), _path_sql('b'), 'verdict')}) AS method FROM reach GROUP BY a),
judged AS (
  SELECT page_id, {_host_sql('url')} AS host, {_path_sql('url')} AS path, {_node_sql('url')} AS node FROM pages)
SELECT page_id, host, path, {_rule_sql('host', 'path', 'rule')} AS rule,
  coalesce({_rule_sql('host', 'path', 'verdict')}, method, 'allow') AS verdict
FROM judged LEFT JOIN decided USING (node)
"""

QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES = {"op9_url_filter": OP9_SQL}
