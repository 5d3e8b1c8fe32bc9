"""URL rules whose decisions spread over redirects and canonical links, with explicit allow precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlframe.llm.common import materialize
from mlframe.llm.components import connected_components

#: Rules of the contract query: verdict, host, start of path (fixed values).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Query parameters that only name where a visitor came from (fixed values).
TRACKING = r"(utm_\w+|gclid|fbclid|ref|mc_cid|mc_eid)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to /, ? or #, A-Z lower-cased) and path (then up to ? or #); both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    head = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 0)
    host = F.regexp_extract(head, r"(?s)^([^/]*)", 1)
    return lower_ascii(host), F.substring(head, F.length(host) + 1, F.length(head))


def node_key(url: Column) -> Column:
    """What stands for a page in the graph of aliases: host without www., path without a slash at its end, query without tracking parameters; scheme and fragment do not count. Null for an url without a host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(^|&){TRACKING}=[^&]*", ""), "^&", "")
    key = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host != "", key)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. Of rules of one length the first counts."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        here = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(start))
        fits = F.when(here, F.struct(F.lit(rule_host + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def decoded(text: Column) -> Column:
    """``text`` with character references read, as far as addresses need them: those of printable ASCII characters by number, and the named ones of markup."""
    found = F.regexp_extract_all(text, F.lit(r"&#(?:[xX]0{0,6}[0-7]?[0-9A-Fa-f]|0{0,6}[0-9]{1,3});"), F.lit(0))
    digits = lambda r: F.regexp_replace(r, "[&#;xX]", "")
    code = lambda r: F.when(F.contains(F.lower(r), F.lit("x")), F.conv(digits(r), 16, 10)).otherwise(digits(r)).cast("int")
    read = lambda done, r: F.when(code(r) == 38, F.replace(done, r, F.lit("&amp;"))).when(code(r).between(32, 126), F.replace(done, r, F.char(code(r)))).otherwise(done)
    out = F.when(F.contains(text, F.lit("&#")), F.aggregate(found, text, read)).otherwise(text)
    for name, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(character))
    return out


def without_dots(path: Column) -> Column:
    """A path with its . and .. parts worked out; .. stops at the root."""
    parts = F.split(path, "/")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda done, part: F.when(part == ".", done).when(part == "..", up(done)).otherwise(F.concat(done, F.array(part))))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.array_join(done, "/"), end)).otherwise(path)


def resolved(target: Column, scheme: Column, host: Column, path: Column) -> Column:
    """The whole url that a reference on a page of ``scheme``, ``host`` and ``path`` means; null if it names the page itself or has a scheme without a host."""
    own = F.when(path == "", F.lit("/")).otherwise(path)
    joined = F.when(F.startswith(target, F.lit("/")), target).when(F.startswith(target, F.lit("?")), F.concat(own, target)).otherwise(F.concat(F.regexp_extract(own, "(?s)^.*/", 0), target))
    start, rest = F.regexp_extract(joined, r"(?s)^[^?#]*", 0), F.regexp_extract(joined, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when((target == "") | F.startswith(target, F.lit("#")), F.lit(None).cast("string"))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target))
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(host != "", F.concat(scheme, F.lit("://"), host, without_dots(start), rest))
    )


def links_of(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Edges from the pages' own markup: canonical links, and refreshes that redirect. Character references in a target are read, and targets are resolved against the page's url."""
    html = F.col(html_col)
    link = F.regexp_extract(html, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?\s*[\d.]*\s*[;,]?\s*url\s*=\s*'?([^\"'\s>]+)", 1)
    either = lambda x, word: F.when(F.contains(F.lower(html), F.lit(word)), x)
    host, path = host_and_path(F.col(url_col))
    scheme = F.regexp_extract(F.col(url_col), r"^([^:/?#]*)://", 1)
    found = pages.where(F.col(html_col).isNotNull()).select(F.col(url_col).alias("source"), host.alias("host"), path.alias("path"), scheme.alias("scheme"), F.explode(F.array_compact(F.array(either(link, "canonical"), either(refresh, "http-equiv")))).alias("raw")).where("raw <> ''")
    found = found.withColumn("target", decoded(F.col("raw")))
    return found.select("source", resolved(F.col("target"), F.col("scheme"), F.col("host"), F.col("path")).alias("target")).where("target is not null")


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Judges every page's url; one row per row of ``pages``.

    A rule (verdict, host, start of path) fits its host, all subdomains, and paths that start so; the longest wins. A page without a rule takes the verdict of its aliases: urls joined by ``redirects`` (columns source and target) or by canonical links and refreshes in the pages' own html, directly or through others, and urls that differ only in scheme, www., fragment, a slash at the end or tracking parameters. Among aliases one explicit allow outweighs any number of blocks; without any explicit decision the page is allowed. The targets of links count as aliases with the rules that fit them, even if no page has their url.

    Columns: page_id, host, path, rule (null if none), verdict, via (rule, alias or default), component (the smallest key of the page's aliases; null without links).

    Null urls and urls without :// have empty host and path, no aliases, and are allowed by default. Repeated rows give repeated rows; an empty table gives none. Other columns are not read.

    Only urls with links enter the components; decisions of a component meet in one aggregate with partial sums, and pages of one hot host or key are spread by a join that adaptive execution may split.
    """
    host, path = host_and_path(F.col(url_col))
    edges = []
    if html_col:
        edges.append(links_of(pages, url_col, html_col))
    if redirects is not None:
        edges.append(redirects.select("source", "target"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path")).withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).withColumn("key", node_key(F.col("url")))
    vote = lambda rule: F.struct((rule["verdict"] == "allow").cast("int").alias("allow"), (rule["verdict"] == "block").cast("int").alias("block"))
    same = base.where("key is not null and own is not null").select("key", vote(F.col("own")).alias("v"))
    key_component = None
    if edges:
        links = edges[0] if len(edges) == 1 else edges[0].unionAll(edges[1])
        links = materialize(links.distinct())
        ends = links.select(F.col("source").alias("url")).unionAll(links.select(F.col("target").alias("url"))).distinct()
        h, p = host_and_path(F.col("url"))
        ends = ends.select(node_key(F.col("url")).alias("key"), rule_of(h, p, rules).alias("own")).where("key is not null and own is not null")
        same = same.unionAll(ends.select("key", vote(F.col("own")).alias("v")))
        key_component = connected_components(links.select(node_key(F.col("source")).alias("a"), node_key(F.col("target")).alias("b")))
    apart = F.concat(F.lit("\0"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))  # else all rows that need no join would meet in one task
    base = base.withColumn("key", F.coalesce("key", apart))
    votes = same.groupBy("key").agg(F.max("v.allow").alias("allow"), F.max("v.block").alias("block"))
    if key_component is not None:
        votes = votes.join(key_component.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("component", "key"))
        votes = votes.groupBy("group").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
        base = base.join(key_component.withColumnRenamed("node", "key"), "key", "left")
    else:
        votes, base = votes.withColumnRenamed("key", "group"), base.withColumn("component", F.lit(None).cast("string"))
    judged = base.withColumn("group", F.when(F.col("own").isNull(), F.coalesce("component", "key")).otherwise(apart)).join(votes, "group", "left")
    spread = F.when(F.col("allow") == 1, F.lit("allow")).when(F.col("block") == 1, F.lit("block"))
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", spread, F.lit("allow")).alias("verdict"), F.when(F.col("own").isNotNull(), "rule").when(spread.isNotNull(), "alias").otherwise("default").alias("via"), "component")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract query: every url of ``pages``, aliases from their own markup."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP8_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, strpos(url, '://') AS pos FROM pages
), parts AS (
  SELECT page_id, url, html, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM p
), q AS (
  SELECT page_id, url, html,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path
  FROM parts
), tags AS (
  SELECT url AS source, host, path, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme,
    unnest([
      regexp_extract(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b'))[1], '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
      regexp_extract(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b'))[1], '(?is)\bcontent\s*=\s*["'']?\s*[\d.]*\s*[;,]?\s*url\s*=\s*''?([^"''\s>]+)', 1)
    ]) AS target
  FROM q
), refs AS (
  SELECT source, host, CASE WHEN path = '' THEN '/' ELSE path END AS own, scheme,
    replace(replace(replace(replace(replace(list_reduce(list_prepend(target, regexp_extract_all(target, '&#(?:[xX]0{0,6}[0-7]?[0-9A-Fa-f]|0{0,6}[0-9]{1,3});')),
      lambda done, r: CASE WHEN CAST(CASE WHEN lower(r) LIKE '&#x%' THEN '0x' ELSE '' END || regexp_replace(r, '[&#;xX]', '', 'g') AS INTEGER) = 38 THEN replace(done, r, '&amp;') WHEN CAST(CASE WHEN lower(r) LIKE '&#x%' THEN '0x' ELSE '' END || regexp_replace(r, '[&#;xX]', '', 'g') AS INTEGER) BETWEEN 32 AND 126 THEN replace(done, r, chr(CAST(CASE WHEN lower(r) LIKE '&#x%' THEN '0x' ELSE '' END || regexp_replace(r, '[&#;xX]', '', 'g') AS INTEGER))) ELSE done END),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&') AS target
  FROM tags WHERE target <> ''
), whole AS (
  SELECT *, CASE WHEN target LIKE '/%' THEN target WHEN target LIKE '?%' THEN own || target ELSE regexp_extract(own, '(?s)^.*/') || target END AS joined FROM refs
), dots AS (
  SELECT *, regexp_extract(joined, '(?s)^[^?#]*') AS start, regexp_extract(joined, '(?s)^[^?#]*(.*)$', 1) AS rest, string_split(regexp_extract(joined, '(?s)^[^?#]*'), '/') AS parts FROM whole
), links AS (
  SELECT DISTINCT source, CASE WHEN target = '' OR target LIKE '#%' THEN NULL
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target END
    WHEN target LIKE '//%' THEN scheme || ':' || target
    WHEN host <> '' THEN scheme || '://' || host || CASE WHEN contains(start, '/.') THEN
      array_to_string(list_reduce(list_prepend([parts[1]], list_transform(parts[2:], lambda x: [x])), lambda done, x: CASE WHEN x[1] = '.' THEN done WHEN x[1] = '..' THEN CASE WHEN len(done) > 1 THEN done[1:len(done) - 1] ELSE done END ELSE done || x END), '/') || CASE WHEN parts[-1] IN ('.', '..') THEN '/' ELSE '' END
      ELSE start END || rest END AS target
  FROM dots
), urls AS (
  SELECT url FROM pages UNION SELECT source FROM links WHERE target IS NOT NULL UNION SELECT target FROM links WHERE target IS NOT NULL
), u AS (
  SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM urls WHERE url IS NOT NULL
), v AS (
  SELECT url, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path,
    regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '(^|&)(utm_\w+|gclid|fbclid|ref|mc_cid|mc_eid)=[^&]*', '', 'g'), '^&', '') AS query
  FROM u
), n AS (
  SELECT url, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM v
), e AS (
  SELECT a.key AS a, b.key AS b FROM links JOIN n a ON a.url = source JOIN n b ON b.url = target WHERE a.key <> b.key
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, b.b FROM reach r JOIN both_ways b ON b.a = r.other
), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
grp AS (
  SELECT coalesce(component, key) AS g, max(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1 ELSE 0 END) AS allow, max(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 ELSE 0 END) AS block
  FROM n LEFT JOIN comp ON node = key WHERE key IS NOT NULL GROUP BY 1
)
SELECT q.page_id, q.host, q.path, n.rule,
  CASE WHEN n.rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN n.rule IS NOT NULL THEN 'block' WHEN grp.allow = 1 THEN 'allow' WHEN grp.block = 1 THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN n.rule IS NOT NULL THEN 'rule' WHEN grp.allow = 1 OR grp.block = 1 THEN 'alias' ELSE 'default' END AS via,
  comp.component
FROM q LEFT JOIN n ON n.url = q.url LEFT JOIN comp ON comp.node = n.key LEFT JOIN grp ON grp.g = coalesce(comp.component, n.key)
"""
