"""URL filters with redirect equivalence.

A rule is a host and a path prefix with an action; it fits its host and all subdomains, and the
longest fitting rule decides a URL. URLs that redirect to each other (given redirects, and
refresh and canonical tags of the pages) are aliases: connected components of those edges, found
by distributed star contraction. A URL without a rule of its own takes its component's decision:
allow if a rule allows any alias, else block if a rule blocks any, else allow. A rule of its own
always comes first.

Nulls: a null url, and one without `://`, has empty host and path, fits no rule and has no
aliases: allow. Null html has no edges. Repeated rows get equal verdicts. Rules of equal length:
allow first. Very long urls and pages are read whole. An empty table gives no rows. Columns other
than page_id, url and html are not read. Every matching tag of a page counts. Dot segments are
removed where a path names a resource; a page's own rule sees its path as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small
from .components import components

#: Rules of the registered query, in order: action, host and path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

_URL = r"://([^/?#]*)([^?#]*)(\?[^#]*)?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _without_dots(path: Column) -> Column:
    """The path less its segments . and .. (RFC 3986, 5.2.4)."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    dots = (F.element_at(parts, -1) == ".") | (F.element_at(parts, -1) == "..")
    up = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), up)
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.when(dots & (F.size(kept) > 0), F.concat(joined, F.lit("/"))).otherwise(joined)).otherwise(path)


def node_of(url: Column) -> Column:
    """What names a resource: `://host/path?query`; null for urls without a host."""
    path = _without_dots(path_of(url))
    query = F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))
    return F.when(host_of(url) != "", F.concat(F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), query))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame([(action, rule) for action, rule in rules], "action string, rule string")


def decided(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (with host and path) plus rule and action of the longest fitting rule, or nulls."""
    told = rules.select(F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("substring(rule, instr(rule, '/'))").alias("prefix"), "rule", "action").distinct()
    labels = told.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    one = F.struct(F.length("rule").alias("size"), (F.col("action") == "allow").alias("allows"), F.col("rule").alias("rule"), F.col("prefix").alias("prefix"))
    by_host = small(told.groupBy("rule_host").agg(F.collect_list(one).alias("fit")))
    out = urls
    for n in range(1, labels + 1):  # the last n labels of the host
        ending = F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n))
        out = out.join(by_host.toDF(f"host_{n}", f"fit_{n}"), ending == F.col(f"host_{n}"), "left").drop(f"host_{n}")
    fits = [F.coalesce(f"fit_{n}", F.array().cast(by_host.schema["fit"].dataType)) for n in range(1, labels + 1)]
    if not fits:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    best = F.array_max(F.filter(F.concat(*fits), lambda r: F.col("path").startswith(r["prefix"])))
    out = out.withColumn("best", best)
    return out.select(*[f"`{c}`" for c in urls.columns], F.col("best.rule").alias("rule"), F.when(F.col("best.allows"), "allow").when(F.col("best").isNotNull(), "block").alias("action"))


def _links(name: str, kind: str, link: str) -> Column:
    """What the link pattern finds in each tag of that name that matches the kind."""
    tags = F.regexp_extract_all("html", F.lit(rf"(?is)(<{name}\b[^>]*>)"), F.lit(1))
    return F.transform(F.filter(tags, lambda t: t.rlike(kind)), lambda t: F.regexp_extract(t, link, 1))


def _resolved(link: Column, url: Column) -> Column:
    """The link as a URL, seen from the page at url; null for other schemes and empty links."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    base = F.concat(F.lit("x://"), host_of(url))
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(base, path, link))
        .otherwise(F.concat(base, F.regexp_replace(path, "[^/]*$", ""), link))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) between a page and the targets of its canonical links and refresh tags."""
    # The token may stand anywhere in the list; a value without quotes is one token.
    rel = r"""(?is)\brel\s*=\s*(?:"(?:[^">]*\s)?canonical\b|'(?:[^'>]*\s)?canonical\b|canonical\b)"""
    canonical = _links("link", rel, r"(?is)\bhref\s*=\s*[\"']?([^\"'>\s]*)")
    refresh = _links("meta", r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b", r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]*)")
    told = pages.where("html is not null").select("url", F.explode(F.array_distinct(F.concat(canonical, refresh))).alias("link")).where("link <> ''")
    return told.select(node_of(F.col("url")).alias("a"), node_of(_resolved(F.col("link"), F.col("url"))).alias("b")).where("a <> b")


def alias_verdicts(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, verdict) of the URLs in components that some rule decides."""
    found = components(edges)
    ruled = decided(found.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    by = ruled.groupBy(F.col("component").alias("in")).agg(F.max(F.when(F.col("action") == "allow", 2).when(F.col("action") == "block", 1)).alias("most")).where("most is not null")
    return found.join(by, F.col("component") == F.col("in")).select("node", F.when(F.col("most") == 2, "allow").otherwise("block").alias("alias_verdict"))


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; redirects: (source, target) urls."""
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).where("a <> b"))
    url = F.col("url")
    own = decided(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("of_node")), rules)
    both = own.join(alias_verdicts(edges, rules), F.col("of_node") == F.col("node"), "left")
    return both.select("page_id", "host", "path", "rule", F.coalesce("action", "alias_verdict", F.lit("allow")).alias("verdict"))
