"""URL filter with redirect equivalence (operator 8), in built-in functions only.

Rules are looked up by an equality join on the suffixes of a host. Pages that
no rule fits take the decision of their aliases: pages of the same address, and
those joined to it by redirects (meta refresh) and canonical links, as
connected components. An explicit allow goes before a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import cut, table
from tidewake.llm.components import connected_components

#: The rules of the registered query, (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Rule lists of up to so many rows are broadcast; longer ones are shuffled.
BROADCAST_RULES = 100_000
HOST = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*(\?[^#]*)"
TRACKING = r"(?<=[?&])(utm_[a-z]+=[^&]*&?)"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
#: A tag's attributes, quoted ones with any character; a tag of over 200 pieces is none.
_REST = r"""(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+'){0,200}+>"""
TAGS = r"(?is)<(?:link|meta|base)" + _REST
ATTRIBUTE = r"""(?s)(?<=[\s"'/])([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
REFRESH_URL = r"""(?is)^[\s\d.]*[;,]?\s*url\s*=\s*["']?([^"'\s]+)"""
#: Entities that addresses are written with; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)" + HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)" + PATH, 1)


def address(url: Column) -> Column:
    """Host without its scheme's own port, path without a slash at its end, and query without campaign parameters; null without ``://``."""
    host = F.when(url.rlike("(?i)^http://"), F.regexp_replace(host_of(url), ":80$", "")).when(url.rlike("(?i)^https://"), F.regexp_replace(host_of(url), ":443$", "")).otherwise(host_of(url))
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, "(?s)" + QUERY, 1), TRACKING, ""), r"[?&]$", "")
    return F.when(url.contains("://"), F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), query))


def _resolved(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    ends_in_folder = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_in_folder & (F.size(kept) > 0), "/").otherwise(""))


def absolute(to: Column, base: Column) -> Column:
    """The address that ``to`` means on a page of address ``base``; other schemes, bare fragments and nothing are null."""
    scheme, here = F.regexp_extract(base, r"(?s)^(.*?)://", 1), path_of(base)
    site, folder = F.concat(scheme, F.lit("://"), host_of(base)), F.regexp_replace(path_of(base), r"[^/]*$", "")
    path, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(to.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$"), None)
        .when(to.startswith("?"), F.concat(site, here, to))
        .when(to.startswith("/"), F.concat(site, _resolved(path), rest))
        .otherwise(F.concat(site, _resolved(F.concat(folder, path)), rest))
    )


def attribute(tag: Column, name: str) -> Column:
    """A tag's first attribute of a name, without quotes and with entities decoded; null if there is none."""
    pairs = F.arrays_zip(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)).alias("name"), F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)).alias("value"))
    value = F.get(F.filter(pairs, lambda p: F.lower(p["name"]) == name), F.lit(0))["value"]
    value = F.trim(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"))
    for entity, character in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(character))
    return value


def targets(url: Column, html: Column) -> Column:
    """Absolute targets of a page's canonical links and meta refreshes (unique, without nulls), read tag by tag.

    Comments are left out first; an attribute is quoted or bare, ``rel`` is a
    list of words, and relative addresses begin at the page's ``base``, if it has one.
    """
    tags = F.regexp_extract_all(F.regexp_replace(html, COMMENT, ""), F.lit(TAGS), F.lit(0))
    bases = F.filter(tags, lambda t: t.rlike(r"(?i)^<base\b") & attribute(t, "href").isNotNull())
    base = F.coalesce(absolute(attribute(F.get(bases, F.lit(0)), "href"), url), url)

    def target(tag: Column) -> Column:
        words = F.split(F.lower(attribute(tag, "rel")), r"\s+")
        refresh = F.nullif(F.regexp_extract(attribute(tag, "content"), REFRESH_URL, 1), F.lit(""))
        return F.when(tag.rlike(r"(?i)^<link\b") & F.array_contains(words, "canonical"), attribute(tag, "href")).when(tag.rlike(r"(?i)^<meta\b") & (F.lower(attribute(tag, "http-equiv")) == "refresh"), refresh)

    found = F.array_compact(F.transform(tags, target))
    return F.when(html.rlike("(?i)canonical|refresh"), F.array_compact(F.array_distinct(F.transform(found, lambda t: absolute(t, base)))))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules))
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``rules`` has columns verdict (allow or block) and rule (host and path).
    The longest fitting rule wins; of equally long ones allow, then the larger
    text. A page without a rule takes its component's decision: allow if any
    alias has an allowing rule, else block if any has a blocking one, else
    allow. A null url, or one without ``://``, has empty host and path, no rule
    and no alias, and is allowed. Null html has no links. Repeated rows are
    judged alike; other columns are ignored; an empty table gives an empty
    result. Very long html is read whole, in the scan, if it speaks of a canonical link or a refresh at all.
    """
    url = F.col("url")
    p = cut(
        pages.select(
            F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
            address(url).alias("address"), F.transform(targets(url, F.col("html")), lambda t: address(t)).alias("targets"),
        ),
        "pages",
    )
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice("parts", k, F.size("parts")), "."))
    rule_host, rule_path = F.regexp_extract("rule", r"^([^/]*)", 1), F.regexp_extract("rule", r"^[^/]*(.*)$", 1)
    r = rules.select("verdict", "rule", rule_host.alias("suffix"), rule_path.alias("rule_path"))
    hosts = p.where("host <> ''").select("row", "path", parts.alias("parts")).select("row", "path", F.explode(suffix).alias("suffix"))
    fits = hosts.join(F.broadcast(r) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else r, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct(F.length("rule").alias("length"), (F.col("verdict") == "allow").alias("allow"), "rule")).alias("best")
    ruled = p.join(fits.groupBy("row").agg(best), "row", "left")

    links = p.where("address IS NOT NULL").select(F.col("address").alias("a"), F.explode("targets").alias("b"))
    groups = connected_components(links)
    decided = ruled.where("best IS NOT NULL AND address IS NOT NULL").groupBy("address").agg(F.max("best.allow").alias("allow"))
    decided = decided.join(groups, decided["address"] == groups["node"], "left").select(F.coalesce("component", "address").alias("component"), "allow")
    decided = decided.groupBy("component").agg(F.max("allow").alias("alias_allow"))
    aliases = ruled.join(groups, ruled["address"] == groups["node"], "left").withColumn("component", F.coalesce("component", "address"))
    found = aliases.join(decided, "component", "left")
    allow = F.coalesce(F.col("best.allow"), F.col("alias_allow"), F.lit(True))
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP8_SQL = r"""
WITH RECURSIVE rules(verdict, rule, host, path) AS (
  VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
         ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')
), p AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), fits AS (
  SELECT n, verdict, rule, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC, verdict, rule DESC) AS k
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
), j AS (
  SELECT p.*, rule, verdict,
         CASE WHEN contains(url, '://') THEN host || regexp_replace(path, '/+$', '') ||
           regexp_replace(regexp_replace(regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1), '([?&])(?:utm_[a-z]+=[^&]*(?:&|$))+', '\1', 'g'), '[?&]$', '') END AS address,
         regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS c
  FROM p LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
), links AS (
  SELECT DISTINCT address AS a, translate(regexp_extract(c, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_extract(c, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '') AS b
  FROM j WHERE c LIKE '%://%' AND address IS NOT NULL
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (
  SELECT DISTINCT address, address FROM j WHERE address IS NOT NULL
  UNION SELECT node, b FROM reach JOIN both_ways ON other = a
), groups AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
decided AS (
  SELECT component, bool_or(verdict = 'allow') AS allow FROM j JOIN groups ON address = node WHERE verdict IS NOT NULL GROUP BY component
)
SELECT page_id, host, path, rule, CASE WHEN coalesce(verdict = 'allow', allow, true) THEN 'allow' ELSE 'block' END AS verdict
FROM j LEFT JOIN groups ON address = node LEFT JOIN decided USING (component)
"""
