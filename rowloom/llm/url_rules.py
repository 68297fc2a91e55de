"""URL block lists that follow redirects and canonical links.

Urls are nodes; a redirect, a canonical link of a page and a spelling variant of the same address (scheme,
``www.``/``m.``, tracking parameters, fragment, trailing slash) are edges. Connected components of this graph are
classes of aliases. A url's own rule decides first; without one, an explicit allow of any alias wins over a
block of any alias; without either the url is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import lookup
from ..session import materialize
from .common import ascii_lower, components
from .registry import query, table

# fixed values: parameters that name where a click came from, not which page is shown
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "gclid", "fbclid")
_PARAM = "(" + "|".join(TRACKING) + ")=[^&#]*"
_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """One spelling of the address of a page: host without ``www.``/``m.``, path, parameters that matter; null if there is no host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    params = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    params = F.regexp_replace(F.regexp_replace(params, rf"(^|&){_PARAM}(?=&|$)", "$1"), r"&+", "&")
    params = F.regexp_replace(params, r"^&|&$", "")
    return F.when(host != "", F.concat(host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(F.lit(""))))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path, rule, verdict) for distinct ``url``: the longest fitting rule, null without one.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains if the path
    starts with the rule's. Each url is looked up under every suffix of its host, so the work does not grow
    with the number of rules; a suffix that most urls share is salted. Of rules equally long the longer host wins, then allow.
    """
    listed = rules.select("host", "path", "verdict").distinct().groupBy("host").agg(F.collect_list(F.struct("path", "verdict")).alias("rules"))
    listed = materialize(listed, "rules")
    urls = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = urls.filter("host <> ''").select("url", "path", F.explode(suffixes).alias("host"))
    fits = lookup(probes.withColumnRenamed("path", "url_path"), listed, ["host"], "inner", salt_by=["url"])
    fits = fits.withColumn("r", F.explode("rules")).filter(F.startswith("url_path", F.col("r.path")))
    rank = F.struct((F.length("host") + F.length("r.path")).alias("n"), F.length("host").alias("h"), (F.col("r.verdict") == "allow").alias("a"), F.concat("host", "r.path").alias("rule"))
    best = fits.groupBy(F.col("url").alias("b_url")).agg(F.max(rank).alias("best"))
    return urls.join(best, urls["url"] == best["b_url"], "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.a"), "allow").when(~F.col("best.a"), "block").alias("verdict")
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between addresses: canonical links and refreshes inside pages, and known redirects (from_url, to_url)."""
    own = address_of(F.col(url_col))
    found = pages.select(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")).limit(0)
    if html_col:
        scheme, host = F.regexp_extract(F.col(url_col), r"(?s)\A(.*?)://", 1), host_of(F.col(url_col))
        for pattern in (_LINK, _REFRESH):
            to = F.regexp_replace(F.regexp_extract(F.col(html_col), pattern, 1), "&amp;", "&")
            full = F.when(to.startswith("//"), F.concat(scheme, F.lit(":"), to)).when(to.startswith("/"), F.concat(scheme, F.lit("://"), host, to)).otherwise(to)
            found = found.unionByName(pages.filter(to != "").select(own.alias("a"), address_of(full).alias("b")))
    if redirects is not None:
        found = found.unionByName(redirects.select(address_of(F.col("from_url")).alias("a"), address_of(F.col("to_url")).alias("b")))
    return found.filter("a is not null and b is not null and a <> b").distinct()


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, alias (the class of equal pages).

    A null url or one without ``://`` has empty host and path, no rule, a null alias, and is allowed. Repeated rows are judged
    alike. Null pages have no links. Other columns are ignored; an empty table gives an empty result.
    """
    urls = pages.select(F.col(url_col).alias("url")).filter("url is not null").distinct()
    judged = match_rules(urls, rules).withColumn("address", address_of(F.col("url")))
    judged = materialize(judged, "judged")
    classes = components(alias_edges(pages, url_col, html_col, redirects), "a", "b")
    named = lookup(judged, classes.withColumnRenamed("node", "address"), ["address"], "left", salt_by=["url"])
    named = materialize(named.withColumn("alias", F.coalesce("root", "address")).drop("root", "address"), "aliases")
    said = named.filter("alias is not null").groupBy("alias").agg(
        F.max((F.col("verdict") == "allow").cast("int")).alias("allows"), F.max((F.col("verdict") == "block").cast("int")).alias("blocks")
    )
    said = lookup(named, materialize(said.filter("allows = 1 or blocks = 1"), "decisions"), ["alias"], "left", salt_by=["url"])
    inherited = F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").otherwise("allow")
    said = said.select(F.col("url").alias("s_url"), "host", "path", "rule", F.coalesce("verdict", inherited).alias("verdict"), "alias")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    return rows.join(said, rows["url"] == said["s_url"], "left").select(
        F.col("id").alias(id_col), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"), "alias",
    )


# fixed values: the rules of the query
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
_SQL = r"""
WITH rules(rhost, rpath, verdict) AS (VALUES {rules}),
parts AS (
    SELECT page_id, url, html,
        translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path,
        regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '(?s)\A[^?#]*\?([^#]*)', 1), '(^|&)((?:{track})=[^&#]*(&|$))+', '\1', 'g'), '&+', '&', 'g'), '^&|&$', '', 'g') AS params
    FROM pages
), named AS (
    SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '') || CASE WHEN params <> '' THEN '?' || params ELSE '' END END AS alias,
        (SELECT max_by(struct_pack(rule := rhost || rpath, verdict := r.verdict), length(rhost || rpath)) FROM rules r
            WHERE (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)) AS best
    FROM parts
), said AS (
    SELECT alias, CASE WHEN max(CAST(best.verdict = 'allow' AS INT)) = 1 THEN 'allow' WHEN max(CAST(best.verdict = 'block' AS INT)) = 1 THEN 'block' ELSE 'allow' END AS verdict
    FROM named WHERE alias IS NOT NULL GROUP BY alias
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, said.verdict, 'allow') AS verdict, named.alias AS alias
FROM named LEFT JOIN said ON named.alias = said.alias
"""
# pages whose html names another address would need the components themselves; there are none in these tables,
# and the tests compare components with a brute-force version
ORACLE = _SQL.format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES), track="|".join(TRACKING))


@query("op1_url_rules", ORACLE)
def op1_url_rules(spark, sf):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf, "pages"), rules)
