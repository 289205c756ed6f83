"""URL filters with redirect equivalence, with built-in functions only.

Explicit rules judge the URLs they fit. Redirects and canonical links make URLs aliases; connected components over
those edges carry the decisions to the URLs that no rule fits, an allowed alias before a blocked one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commweave.llm.common import lower_ascii
from commweave.llm.graph import connected_components

#: (verdict, host, start of the path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Query parameters that don't change the page.
TRACKING = r"utm_[a-z]+|gclid|fbclid|ref"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """One spelling of URLs that name one page: host in lower case, no scheme, port 80 or 443, fragment, tracking parameters or last slash.

    Null for null and for what has no ``://``.
    """
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=|$)"))
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    page = F.concat(host, F.regexp_replace(path_of(url), r"/$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(""))
    return F.when(F.instr(url, "://") > 0, page)


def _folded(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``."""

    def step(a: Column, segment: Column) -> Column:
        return F.when(segment == ".", a).when(segment == "..", F.regexp_replace(a, r"/[^/]*$", "")).otherwise(F.concat(a, F.lit("/"), segment))

    # A path that ends in such a segment names a folder.
    whole = F.regexp_replace(F.regexp_replace(path, r"^/", ""), r"(^|/)(\.\.?)$", "$1$2/")
    return F.aggregate(F.split(whole, "/"), F.lit(""), step)


def resolve(base: Column, link: Column) -> Column:
    """A link's absolute URL as seen on the page ``base``: absolute, protocol-relative, from the root, by query, or relative to the page's folder.

    Null where either is null, where ``base`` has no ``://``, and for schemes without ``//`` such as mailto.
    """
    scheme, authority = F.regexp_extract(base, r"^([^:/?#]*)://", 1), F.regexp_extract(base, r"://([^/?#]*)", 1)
    site = F.concat(scheme, F.lit("://"), authority)
    path, link_path = path_of(base), F.regexp_extract(link, r"^([^?#]*)", 1)
    rest = F.substr(link, F.length(link_path) + 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    found = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
    found = found.when(link_path == "", F.concat(site, path, F.when(link.startswith("?"), link).otherwise(F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1))))
    found = found.when(link.startswith("/"), F.concat(site, _folded(link_path), rest)).otherwise(F.concat(site, _folded(F.concat(folder, link_path)), rest))
    return F.when(F.instr(base, "://") > 0, found)


def links_in(html: Column) -> Column:
    """Targets of a page's canonical links and refreshes as written, ``&amp;`` read as &; an array without nulls."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link\b[^>]*\brel\s*=\s*[\"']?canonical\b|meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*>"), F.lit(0))
    target = lambda t: F.regexp_extract(t, r"(?i)\b(?:href\s*=\s*|url\s*=\s*[\"']?)[\"']?([^\"'\s>]+)", 1)
    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.replace(target(t), F.lit("&amp;"), F.lit("&"))), lambda u: u != "")


def _rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits (of equally long ones an allowing one), as a struct; null if none does. The list is a parameter."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(rule_host + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    redirects: optional (src, dst) URLs, dst as seen from src; all canonical links and refreshes are read from the whole
    pages besides, relative ones as seen from the page's URL. A URL that no rule fits is allowed if an alias is, else
    blocked if an alias is, else allowed. A null or malformed URL has empty host and path and no alias. Repeated rows are
    judged alike, of equally long rules an allowing one counts; an empty table gives an empty one.
    """
    u = F.col(url)
    told = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), normal_form(u).alias("key")).withColumn("r", _rule(F.col("host"), F.col("path"), rules))
    edges = pages.sparkSession.sql("SELECT CAST(NULL AS STRING) AS src, CAST(NULL AS STRING) AS dst WHERE false")
    if html:
        told_links = pages.select(u.alias("u"), F.explode(links_in(F.col(html))).alias("link"))
        edges = edges.unionByName(told_links.select(normal_form(F.col("u")).alias("src"), normal_form(resolve(F.col("u"), F.col("link"))).alias("dst")))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(normal_form(F.col("src")).alias("src"), normal_form(resolve(F.col("src"), F.col("dst"))).alias("dst")))
    alias = connected_components(edges).withColumnRenamed("node", "key")
    at = F.coalesce("component", "key").alias("component")
    # Targets that aren't pages themselves are judged too, and so can decide for their aliases.
    outside = alias.select("key", "component", F.concat(F.lit("http://"), F.col("key")).alias("u"))
    outside = outside.select("component", _rule(host_of(F.col("u")), path_of(F.col("u")), rules).alias("r"))
    decided = told.where("r is not null and key is not null").join(alias, "key", "left").select(at, "r").unionByName(outside.where("r is not null"))
    verdicts = decided.groupBy("component").agg(F.min("r.verdict").alias("theirs"))  # allow sorts before block
    open_ = told.where("r is null").join(alias, "key", "left").withColumn("component", at).join(verdicts, "component", "left")
    columns = ["page_id", "host", "path"]
    clear = told.where("r is not null").select(*columns, "r.rule", "r.verdict")
    return clear.unionByName(open_.select(*columns, F.lit(None).cast("string").alias("rule"), F.coalesce("theirs", F.lit("allow")).alias("verdict")))
