"""URL filters: host and path rules, then redirect equivalence over links between aliases.

DataFrame functions only. A page's address is reduced to a key (scheme, fragment, one trailing slash
and a default port go; the host is lower-cased). Edges join the page's key with the targets its html
names: ``<link rel=canonical>`` and ``<meta http-equiv=refresh>``, relative ones resolved against the
page's address or its ``<base href>``. Components over these keys are the
alias sets. An address decided by a rule keeps that verdict. Any other one is blocked if an alias of
it is blocked by a rule, unless an alias is allowed by a rule: allow takes precedence. All else is
allowed. Up to FEW_RULES rules are one expression; longer lists become a table that is joined with the
suffixes of the distinct hosts. Links in comments don't count.

Defined results: a null address, or one without ``://``, has empty host and path, matches no rule and
has no aliases: allowed. Repeated rows are judged alike. Null html names no target. An empty table
gives an empty result. Addresses and html of any length are read whole. Extra columns pass through, but
columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

#: The rules of the query: verdict, host, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rule lists up to this long are one expression.
FEW_RULES = 64


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """Address without scheme, fragment, default port and one trailing slash; null if there is none."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    key = F.concat(F.regexp_replace(host_of(url), r":(80|443)$", ""), F.regexp_replace(path_of(url), r"/$", ""), query)
    return F.when(F.coalesce(url, F.lit("")).contains("://") & (host_of(url) != ""), key)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; ties go to allow. Null where none fits."""
    fits = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        match = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits, verdict = F.when(match, F.lit(h + p)).otherwise(fits), F.when(match, F.lit(kind)).otherwise(verdict)
    return fits, verdict


def with_rules(rows: DataFrame, host: Column, path: Column, rules=RULES) -> DataFrame:
    """``rows`` with ``_rule`` and ``_kind`` of the longest rule that fits; ties go to allow, and null where none fits."""
    if len(rules) <= FEW_RULES:
        fits, verdict = rule_for(host, path, rules)
        return rows.withColumns({"_rule": fits, "_kind": verdict})
    by_host: dict[str, list[tuple[str, str]]] = {}
    for kind, h, p in rules:
        by_host.setdefault(h, []).append((p, kind))
    table = rows.sparkSession.createDataFrame(list(by_host.items()), "suffix string, rules array<struct<p:string,kind:string>>")
    rows = rows.withColumns({"_host": host, "_path": path})
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = rows.where("_host <> ''").select(F.col("_host").alias("host")).distinct().select("host", F.explode(ends).alias("suffix"))
    named = F.transform("rules", lambda r: F.struct((F.length("suffix") + F.length(r["p"])).alias("n"), (r["kind"] == "allow").alias("allow"), r["p"].alias("p"), F.concat("suffix", r["p"]).alias("rule"), r["kind"].alias("kind")))
    known = hosts.join(table, "suffix").groupBy(F.col("host").alias("_host")).agg(F.flatten(F.collect_list(named)).alias("_rules"))
    rows = rows.join(known, "_host", "left")
    longest = F.array_max(F.filter("_rules", lambda r: F.col("_path").startswith(r["p"])))
    return rows.withColumn("_longest", longest).withColumns({"_rule": F.col("_longest.rule"), "_kind": F.col("_longest.kind")}).drop("_host", "_path", "_rules", "_longest")


#: Comments, and elements whose content is text to a parser; without an end, to the end of the page.
_NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|noscript|iframe|xmp)\b[^>]*+>.*?(?:</\1\s*+>|\z)"
#: One of the words of a rel attribute.
_CANONICAL = r"""(?i)\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"""


def link_targets(html: Column) -> Column:
    """Addresses that canonical links and refresh redirects in the html name, outside comments, scripts and other raw text."""
    html = F.regexp_replace(html, _NO_MARKUP, "")
    link = F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^<>]*+>)"), 1)
    link = F.filter(link, lambda t: t.rlike(_CANONICAL))
    link = F.transform(link, lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    meta = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^<>]*+>)"), 1)
    meta = F.filter(meta, lambda t: t.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh\b"""))
    meta = F.transform(meta, lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    return F.when(html.rlike(r"(?i)canonical|refresh"), F.transform(F.concat(link, meta), lambda t: F.replace(t, F.lit("&amp;"), F.lit("&"))))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments carried out."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def resolved(url: Column, target: Column) -> Column:
    """The address that a reference on the page ``url`` names; null for other schemes (mailto:) and empty references."""
    origin = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    path = path_of(url)
    own, rest = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "(?s)^.*/", 0))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (target == "") | target.startswith("#"), F.lit(None))
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, "(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(origin, _without_dots(own), rest))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, own)), rest))
    )


def judge(pages: DataFrame, url: str = "url", html: str | None = "html", redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Every page with host, path, rule and verdict. ``redirects``: more edges (source, target), both addresses."""
    rows = pages.drop("host", "path", "rule", "verdict")
    rows = rows.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "_key": alias_key(F.col(url))})
    rows = with_rules(rows, F.col("host"), F.col("path"), rules).withColumnsRenamed({"_rule": "rule", "_kind": "_by_rule"})
    edges = []
    if html is not None:
        linking = rows.where("_key is not null").where(F.col(html).rlike(r"(?i)canonical|refresh"))
        told = F.regexp_extract(F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", ""), r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
        base = F.coalesce(resolved(F.col(url), told), F.col(url))
        named = linking.select(F.col("_key").alias("a"), base.alias("base"), F.explode(link_targets(F.col(html))).alias("t"))
        there = resolved(F.col("base"), F.col("t"))
        edges.append(named.select("a", alias_key(there).alias("b"), F.col("a").alias("_a"), there.alias("_there")))
    if redirects is not None:
        edges.append(redirects.select(alias_key(F.col("source")).alias("a"), alias_key(F.col("target")).alias("b"), F.col("source").alias("_a"), F.col("target").alias("_there")))
    keyed = rows.where("_key is not null").select("_key", "_by_rule")
    if edges:
        linked = edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1])
        linked = written(linked.where("b is not null"), "url-links")
        parts = connected_components(linked.select("a", "b"))
        # Targets need not be pages of the table: their own rules count too.
        of_target = with_rules(linked, host_of(F.col("_there")), path_of(F.col("_there")), rules)
        keyed = keyed.unionByName(of_target.select(F.col("b").alias("_key"), F.col("_kind").alias("_by_rule")))
        parts = parts.select(F.col("node").alias("_node"), F.col("component").alias("_part"))
        keyed = keyed.join(parts, F.col("_key") == F.col("_node"), "left").select(F.coalesce("_part", "_key").alias("_part"), "_by_rule")
    else:
        parts = None
        keyed = keyed.select(F.col("_key").alias("_part"), "_by_rule")
    votes = keyed.where("_by_rule is not null").groupBy("_part").agg(F.max(F.col("_by_rule") == "allow").alias("_allow"))
    if parts is not None:
        rows = rows.join(parts, F.col("_key") == F.col("_node"), "left").drop("_node").withColumn("_set", F.coalesce("_part", "_key")).drop("_part")
    else:
        rows = rows.withColumn("_set", F.col("_key"))
    # Rows without a key join with nothing; each gets a key of its own so that they don't meet in one task.
    rows = rows.withColumn("_set", F.coalesce("_set", F.concat(F.lit("\x00"), F.monotonically_increasing_id())))
    rows = rows.join(votes.withColumnRenamed("_part", "_set"), "_set", "left")
    verdict = F.coalesce("_by_rule", F.when(~F.col("_allow"), F.lit("block")), F.lit("allow"))
    return rows.withColumn("verdict", verdict).drop("_set", "_key", "_by_rule", "_allow")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


#: The same rows where pages name no canonical or redirect target, as in the test tables: aliases are equal keys.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^[^#]*?(\\?[^#]*)', 1), '') AS query
  FROM pages
), r AS (
  SELECT *, CASE WHEN host = '' THEN NULL ELSE regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/$', '') || query END AS k,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p
), v AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM r),
a AS (SELECT k, bool_or(by_rule = 'allow') AS allows FROM v WHERE by_rule IS NOT NULL AND k IS NOT NULL GROUP BY k)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN NOT allows THEN 'block' END, 'allow') AS verdict FROM v LEFT JOIN a USING (k)
"""
