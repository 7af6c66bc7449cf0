"""URL filters: rules by host and path, carried to aliases over redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm.text import ascii_lower
from lumigraph.operators.components import connected_components
from lumigraph.sources.tables import stash, table

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


#: Character references that addresses are written with, & last, and what they stand for.
REFERENCES = (
    ("(?i)&quot;|&#0*34;|&#x0*22;", '"'), ("(?i)&apos;|&#0*39;|&#x0*27;", "'"), ("(?i)&#0*47;|&#x0*2f;|&sol;", "/"), ("(?i)&#0*58;|&#x0*3a;|&colon;", ":"), ("(?i)&#0*61;|&#x0*3d;|&equals;", "="),
    ("(?i)&#0*63;|&#x0*3f;|&quest;", "?"), ("(?i)&lt;|&#0*60;|&#x0*3c;", "<"), ("(?i)&gt;|&#0*62;|&#x0*3e;", ">"), ("(?i)&amp;|&#0*38;|&#x0*26;", "&"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What aliases are told apart by: host, path and query.  Scheme and fragment don't count, an empty path is /; null without a host."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.regexp_extract(url, r"(?s)^.*?://([^#]*)", 1), r"(?s)\?.*", 0)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], verdict: bool) -> Column:
    """The longest rule that fits, as host and path joined, or its verdict; null if none fits."""
    out = F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r), reverse=False):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        out = F.when(fits, F.lit(what if verdict else at + start)).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute without its quotes, character references read; empty without it."""
    value = F.regexp_replace(F.regexp_extract(tag, rf"""(?is)(?<![\w-]){name}\s*=\s*("[^"]*|'[^']*|[^"'<>]+)""", 1), "^[\"']", "")
    for pattern, sign in REFERENCES:
        value = F.regexp_replace(value, pattern, sign)
    return value


def _without_dots(path: Column) -> Column:
    """A path from / on with its segments . and .. carried out."""
    parts = F.split(path, "/")
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    done = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    done = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)
    return F.concat(F.lit("/"), F.array_join(done, "/"))


def resolved(base: Column, target: Column) -> Column:
    """The address that `target` means on a page of URL `base`: relative to its scheme, host or directory."""
    site, path = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0), path_of(base)
    own, rest = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^.*/", 0), F.lit("")), F.lit("/"))
    below = F.concat(site, _without_dots(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))), rest)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
        .when(own == "", F.concat(site, path, rest))
        .otherwise(below)
    )


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of every canonical link and refresh redirect in `html`, resolved against the page's URL or its <base>; what stands in comments is none."""
    html, tag = F.col("html"), F.col("tag")
    pages = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select("url", F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", " ").alias("html"))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^<>]*>"), F.lit(0))
    base = F.regexp_extract(_attribute(F.regexp_extract(html, r"(?is)<base\b[^<>]*(?<![\w-])href\b[^<>]*>", 0), "href"), r"^\s*(\S+)", 1)
    base = F.when(base == "", F.col("url")).otherwise(resolved(F.col("url"), base))
    tags = pages.select("url", base.alias("base"), F.explode(tags).alias("tag"))
    href = F.regexp_extract(_attribute(tag, "href"), r"^\s*(\S+)", 1)
    moved = F.regexp_extract(_attribute(tag, "content"), r"""(?is)^\s*[\d.]*\s*[;,]\s*+(?:url\s*=\s*+)?+["']?\s*([^"'\s]+)""", 1)
    canonical = tag.rlike(r"(?is)^<link\b") & _attribute(tag, "rel").rlike(r"(?i)(?<!\S)canonical(?!\S)")
    refresh = tag.rlike(r"(?is)^<meta\b") & _attribute(tag, "http-equiv").rlike(r"(?i)^\s*refresh\b")
    found = tags.select("url", "base", F.when(canonical, href).when(refresh, moved).alias("target")).where("target <> ''")
    return found.select("url", resolved(F.col("base"), F.col("target")).alias("target")).where(F.instr("target", "://") > 0)


def judge(pages: DataFrame, edges: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    `edges` (url, target) are redirects and canonical links; by default those
    that the pages' html states.  A node is host, path and query: scheme and
    fragment never part aliases, and pages that differ in their query are
    aliases only where a link says so.  Pages that a rule fits have its verdict.
    The others take that of their connected component: allow if a rule allows
    any address there (an explicit allow goes before blocks), else block if a
    rule blocks one, else allow.  Addresses that are only targets count too.

    A null url, or one without ://, has empty host and path, fits no rule and
    has no aliases: allow.  A null html states no link; a very long one is read
    whole.  Repeated rows each give a row; extra columns are not looked at; an
    empty table gives no rows.
    """
    h, p = F.col("host"), F.col("path")
    alone = F.concat(F.lit("/"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("/"), F.xxhash64("url").cast("string"))  # no node begins with /
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(node_of(F.col("url")), alone).alias("node"))
    found = found.withColumn("rule", _rule(h, p, rules, False)).withColumn("own", _rule(h, p, rules, True))
    edges = stash(links(pages)) if edges is None else edges  # each is parsed once
    ends = [(node_of(F.col(c)), _rule(host_of(F.col(c)), path_of(F.col(c)), rules, True)) for c in ("url", "target")]
    edges = stash(edges.select(ends[0][0].alias("a"), ends[1][0].alias("b"), ends[0][1].alias("rule_a"), ends[1][1].alias("rule_b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b"))
    group = connected_components(edges, "a", "b")
    ruled = edges.select(F.col("a").alias("id"), F.col("rule_a").alias("own")).unionAll(edges.select("b", "rule_b")).where("own IS NOT NULL").distinct()
    said = group.join(ruled, "id").groupBy("component").agg(F.min("own").alias("said"))  # allow sorts before block
    said = group.join(said, "component").select(F.col("id").alias("node"), "said")
    return found.join(said, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "said", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


#: Links are read where their address is whole or begins with / or //; components by recursion over all reachable pairs.
SQL = r"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
tag AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|$)', ' ', 'g'), '(?is)<(?:link|meta)\b[^<>]*>')) AS tag FROM u WHERE contains(url, '://')),
raw AS (SELECT url, CASE WHEN regexp_matches(tag, '(?is)^<link\b.*[\s"'']rel\s*=\s*["'']?(?:[^"''>]*\s)?canonical(?:[\s"''>/]|$)') THEN regexp_extract(tag, '(?is)[\s"'']href\s*=\s*["'']?\s*([^\s"''>]+)', 1)
                         WHEN regexp_matches(tag, '(?is)^<meta\b.*[\s"'']http-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)[\s"'']content\s*=\s*["'']?\s*[\d.]*\s*[;,]\s*(?:url\s*=)?\s*["'']?\s*([^\s"''>]+)', 1) END AS target FROM tag),
link AS (SELECT url, CASE WHEN target LIKE '//%' THEN regexp_extract(url, '^.*?:') || target WHEN target LIKE '/%' THEN regexp_extract(url, '^.*?://[^/?#]*') || target ELSE replace(target, '&amp;', '&') END AS target FROM raw WHERE target <> ''),
ends AS (SELECT url AS x FROM link WHERE contains(target, '://') UNION SELECT target FROM link WHERE contains(target, '://') UNION SELECT url FROM u),
part AS (SELECT x, translate(regexp_extract(x, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(x, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(regexp_extract(x, '^.*?://([^#]*)', 1, 's'), '\?.*', 0, 's') AS query FROM ends),
r AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node,
             CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM part),
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS own FROM r),
edge AS (SELECT a.node AS x, b.node AS y FROM link JOIN v a ON a.x = link.url JOIN v b ON b.x = link.target WHERE a.node <> b.node),
both_ways AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge),
reach AS (SELECT DISTINCT x, x AS y FROM both_ways UNION SELECT reach.x, e.y FROM reach JOIN both_ways e ON e.x = reach.y),
said AS (SELECT reach.x AS node, min(v.own) AS said FROM reach JOIN v ON v.node = reach.y GROUP BY reach.x)
SELECT page_id, v.host, v.path, v.rule, coalesce(v.own, said.said, 'allow') AS verdict FROM u JOIN v ON v.x = u.url LEFT JOIN said ON said.node = v.node
"""
