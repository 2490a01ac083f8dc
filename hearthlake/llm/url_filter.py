"""Operator 3: URL rules, carried to aliases by redirect equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.llm.common import cut, lower_ascii
from hearthlake.llm.components import components

#: (verdict, host, path) of the query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

_LINK, _META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_TARGET = r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)"
#: Characters that urls in attributes have as entities: by name, and all of these by number.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "sol": "/", "equals": "=", "quest": "?", "colon": ":", "num": "#"}
NUMBERED = "<>\"' /=?:#%+-_.,;@!$()*~[]&"


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value as it stands, without quotes; empty if the tag has none."""
    value = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.trim(F.regexp_replace(value, r"^[\"']|[\"']$", ""))


def decoded(value: Column) -> Column:
    """Entities of ENTITIES and NUMBERED as characters; the ampersand last, so nothing is decoded twice."""
    out = value
    for c in NUMBERED:
        mark = rf"&#(?:0*{ord(c)}|[xX]0*(?:{ord(c):x}|{ord(c):X}));"
        out = out if c == "&" else F.regexp_replace(out, mark, "\\$" if c == "$" else c)
    for name, c in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(c))
    return F.when(value.contains("&"), F.regexp_replace(out, r"&(?:amp|#0*38|#[xX]0*26);", "&")).otherwise(value)


def host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, rule_host string, rule_path string")


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with host and path) and rule, action: the longest rule whose host is the
    url's or a parent domain and whose path the url's starts with; null without one.

    Each url meets rules through the suffixes of its host, so the work follows
    labels of a host and rules of a domain, not their product with all rules;
    Spark broadcasts the rules if their size allows that and joins by shuffle
    otherwise. Of equally long rules allow wins.
    """
    labels = F.split("host", r"\.")
    count = F.size("labels")
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice("labels", i, count), "."))
    found = (
        urls.withColumn("_row", F.monotonically_increasing_id())
        .withColumn("labels", labels)
        .withColumn("suffix", F.explode(suffixes))
        .join(rules, (F.col("suffix") == F.col("rule_host")) & F.startswith("path", "rule_path"), "left")
    )
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.when(F.col("action").isNotNull(), F.struct(F.length(rule).alias("n"), (F.col("action") == "allow").alias("first"), rule.alias("rule"), F.col("action"))))
    return (
        found.groupBy("_row", *urls.columns).agg(best.alias("best")).select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    )


def node(url: Column) -> Column:
    """What names a url in the graph: host, path and query, without scheme and fragment."""
    return F.concat(host(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))


def _without_dots(path: Column) -> Column:
    """A path that begins with ``/`` without its ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(segment == ".", kept).when(segment == "..", up).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.lit("")), step)
    return F.concat(F.array_join(kept, "/"), F.when((F.size(kept) == 1) | last.isin(".", ".."), "/").otherwise(""))


def _absolute(url: Column, to: Column) -> Column:
    """Where a link ``to`` on the page ``url`` leads; null for another scheme without ``://`` and for a mere fragment."""
    scheme, at = F.regexp_extract(url, r"(?s)^(.*?)://", 1), path(url)
    target, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(at, r"(?s)^/(.*/)", 1))
    joined = F.when(target == "", at).when(F.startswith(target, F.lit("/")), target).otherwise(_without_dots(F.concat(folder, target)))
    return (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(~to.rlike("^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.concat(scheme, F.lit("://"), host(url), joined, rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b) node pairs of all redirects (meta refresh) and canonical links that the pages' html states,
    relative ones against the page's own url (``<base>`` is not read). Comments are no links, ``rel`` may have other
    words beside canonical, and entities in urls are characters."""
    html = F.coalesce("html", F.lit(""))
    shown = F.regexp_replace(html, _COMMENT, " ")

    def canonical(tag: Column) -> Column:
        return F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")

    def refresh(tag: Column) -> Column:
        return F.lower(_attribute(tag, "http-equiv")) == "refresh"

    tags = F.concat(
        F.transform(F.filter(F.regexp_extract_all("shown", F.lit(_LINK), F.lit(0)), canonical), lambda tag: decoded(_attribute(tag, "href"))),
        F.transform(F.filter(F.regexp_extract_all("shown", F.lit(_META), F.lit(0)), refresh), lambda tag: F.regexp_extract(decoded(_attribute(tag, "content")), _TARGET, 1)),
    )
    to = (
        pages.where(F.col("url").contains("://") & html.rlike("(?i)canonical|refresh"))
        .select("url", shown.alias("shown")).select("url", F.explode(tags).alias("to"))
        .where("to <> ''")
    )
    return to.select(node(F.col("url")).alias("a"), node(_absolute(F.col("url"), F.col("to"))).alias("b")).where("b IS NOT NULL")


def equivalent(links: DataFrame) -> DataFrame:
    """(node, component) of every url that ``links`` connect with another; urls are numbered for that, not hashed."""
    links = cut(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    # the numbers are written before they are used, so a task that is run again does not change them
    names = cut(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("id", F.monotonically_increasing_id()))
    ends = [names.select(F.col("node").alias(side), F.col("id").alias(f"{side}_id")) for side in "ab"]
    return names.join(components(links.join(ends[0], "a").join(ends[1], "b"), "a_id", "b_id", "id"), "id").select("node", "component")


def filter_urls(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule and verdict (allow or block) of every page.

    A page that a rule fits has the rule's verdict. Any other takes it from the
    urls it is equivalent to over redirect and canonical links (``links``: node
    pairs; by default those in the pages' html): allow if a rule allows one of
    them, else block if a rule blocks one, else allow. Equivalence is the
    connected components of the links, found by Spark jobs.

    A null url, or one without ``://``, has no host and no rule and is allowed;
    null html has no links; repeated pages are judged alike; no pages, no rows.
    """
    links = page_links(pages) if links is None else links
    pages = pages.select("page_id", "url")
    judged = judge(pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}), rules)
    groups = cut(equivalent(links))
    members = groups.select(
        "node", "component", F.regexp_extract("node", r"(?s)^([^/?#]*)", 1).alias("host"), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path")
    )
    of_group = (
        judge(members, rules)
        .groupBy("component")
        .agg(F.bool_or(F.col("action") == "allow").alias("allows"), F.bool_or(F.col("action") == "block").alias("blocks"))
        .where("blocks AND NOT coalesce(allows, false)")
    )
    blocked = groups.join(of_group, "component", "left_semi").select(F.col("node").alias("_node"), F.lit("block").alias("by_alias")).distinct()
    return (
        judged.join(blocked, (node(F.col("url")) == F.col("_node")) & F.col("action").isNull(), "left")
        .select("page_id", "url", "host", "path", "rule", F.coalesce("action", "by_alias", F.lit("allow")).alias("verdict"))
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, rules_table(spark, RULES)).drop("url")


ORACLE = """
WITH u AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(action, rh, rp) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'),
  ('block','net','/es/'), ('block','net','/fr/'))
SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule,
  coalesce(max_by(action, length(rh || rp)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY page_id, url, host, path
"""
