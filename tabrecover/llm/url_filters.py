"""URL rules, spread over urls that lead to the same page.

A url is judged by the longest rule that fits it. A url without a rule takes the
decision of its aliases: urls are linked by redirects and canonical links, and a
connected component in which some url is blocked is blocked, unless some url of
it is allowed by a rule; without any rule it is allowed. DataFrame operations
only.

Defined results: a url that is null or has no ``://`` has an empty host and path,
fits no rule, has no alias and is allowed. Repeated rows are judged alike. Rules
of equal length: allow wins. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrecover.llm.common import stored
from tabrecover.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most numbers of labels that the hosts of rules may have; a list has a handful.
LABEL_COUNTS = 64

_CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>;]+)"""


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next slash, question mark, hash or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to the next question mark, hash or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def alias_of(url: Column) -> Column:
    """The form that all ways to write one address share; null where there is no host.

    Servers lead these to one page: http and https, a ``www.`` or ``m.`` host, a default
    port, a closing slash, an index or ``.html`` ending, a fragment, and tracking parameters.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_\w+|ref|gclid|fbclid)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def _without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` steps taken."""

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.concat(path, F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")), "/")
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def html_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst`` of canonical links and redirects written in pages; relative addresses are resolved against the page's."""
    url, html = F.col(url_col), F.col(html_col)
    found = F.array(F.regexp_extract(html, _CANONICAL, 1), F.regexp_extract(html, _REFRESH, 1))
    rows = pages.filter(html.rlike("(?i)canonical|refresh"))
    rows = rows.select(url.alias("src"), F.explode(found).alias("dst")).filter(F.col("dst") != "")
    src, dst = F.col("src"), F.col("dst")
    start = F.concat(F.substring_index(src, "://", 1), F.lit("://"), host_of(src))
    page = F.regexp_extract(src, r"^[^#]*", 0)
    path, tail = F.regexp_extract(dst, r"^[^?#]*", 0), F.regexp_extract(dst, r"^[^?#]*(.*)$", 1)
    folder = F.concat(F.regexp_extract(path_of(src), r"^(.*/)?", 0), path)
    folder = F.when(path.startswith("/"), path).when(folder.startswith("/"), folder).otherwise(F.concat(F.lit("/"), folder))
    full = (
        F.when(dst.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), dst)
        .when(dst.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(dst.startswith("//"), F.concat(F.substring_index(src, "//", 1), dst))
        .when(dst.startswith("#"), F.concat(page, dst))
        .when(dst.startswith("?"), F.concat(start, path_of(src), dst))
        .otherwise(F.concat(start, _without_dots(folder), tail))
    )
    return rows.select("src", full.alias("dst")).filter(F.col("dst").isNotNull())


def longest_rule(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` of those distinct places that a rule fits.

    ``rules``: verdict (allow or block), host, path. A rule is looked up by the last
    labels of a host, so a list of any length is an ordinary join.
    """
    rules = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    labels = F.size(F.split("rule_host", r"\.")).alias("n")
    counts = [r["n"] for r in rules.select(labels).distinct().limit(LABEL_COUNTS + 1).collect()]
    if len(counts) > LABEL_COUNTS:
        raise ValueError(f"hosts of rules have more than {LABEL_COUNTS} different numbers of labels")
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in sorted(counts)])) if counts else F.array()
    keyed = places.select("host", "path").distinct().withColumn("rule_host", F.explode(ends.cast("array<string>")))
    fits = keyed.join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max_by(
        F.struct(rule.alias("rule"), "verdict"),
        F.struct(F.length(rule), F.col("verdict") == "allow", rule),
    )
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def judge(
    pages: DataFrame, rules: DataFrame, links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, alias`` of every row.

    ``links`` (src, dst) are redirects and canonical links between urls. Every url is
    also linked to the form its spellings share.
    """
    url = F.col(url_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.md5(alias_of(url)).alias("node"),
        F.when(host_of(url) != "", F.md5(F.concat(F.lit("url "), url))).alias("own"),
        alias_of(url).alias("alias"),
    )
    rows = stored(rows)
    ruled = stored(longest_rule(rows, rules))
    edges = rows.select(F.col("own").alias("u"), F.col("node").alias("v"))
    if links is not None:
        ends = [F.md5(alias_of(F.col(c))) for c in ("src", "dst")]
        # Stored, or every filter on an end would be written out down to the address in each plan of the components,
        # and the links be searched for again by each.
        edges = edges.unionByName(stored(links.select(ends[0].alias("u"), ends[1].alias("v"))))
    member = components(edges).withColumnRenamed("node", "own")
    judged = rows.join(ruled, ["host", "path"], "left").join(member, "own", "left")
    # One row per component that a rule reaches; allow comes before block.
    decided = (
        judged.filter(F.col("verdict").isNotNull())
        .groupBy("component")
        .agg(F.min("verdict").alias("spread"))
    )
    verdict = F.coalesce("verdict", "spread", F.lit("allow"))
    return judged.join(decided, "component", "left").select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", verdict.alias("verdict"), "alias"
    )
