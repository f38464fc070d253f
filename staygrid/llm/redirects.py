"""URL verdicts that reach over redirects and canonical links.

Pages and the addresses they name by ``<link rel="canonical">`` or a refresh ``<meta>`` tag, and the pairs of a redirect table, are
the edges of a graph of addresses; its connected components are sets of aliases. A rule that blocks one address of a component blocks
every alias that no rule of its own decides: an explicit allow holds for the address it names, whatever its aliases are.

Rules sit in the plan as one expression. Only addresses with an edge enter the components; a page that a third of the web declares
canonical is a hub of the star steps, whose rows the joins split. Every scan, join and expression is Spark's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from staygrid.llm.components import components
from staygrid.llm.shared import settle

# Verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REST, HOST, PATH, TAIL = "(?s)://(.*)$", "^([^/?#]*)", "^[^/?#]*([^?#]*)", "(?s)^[^/?#]*(.*)$"
CLEANING = [("(?s)#.*$", ""), ("([?&])utm_[^&]*", "$1"), ("([?&])&+", "$1"), ("[?&]+$", ""), ("^[/?].*", "")]
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
SCHEME, OTHER_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://", "^[A-Za-z][A-Za-z0-9+.-]*:"


def by_length(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The longest rule first; of equal rules the one that allows."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for an address without it."""
    return F.coalesce(F.regexp_extract(url, REST, 1), F.lit(""))


def host_of(rest_: Column) -> Column:
    return F.translate(F.regexp_extract(rest_, HOST, 1), UPPER, LOWER)


def path_of(rest_: Column) -> Column:
    return F.regexp_extract(rest_, PATH, 1)


def address(rest_: Column) -> Column:
    """Host, path and query without scheme, fragment and tracking parameters; empty without a host."""
    for pattern, by in CLEANING:
        rest_ = F.regexp_replace(rest_, pattern, by)
    return F.concat(host_of(rest_), F.regexp_extract(rest_, TAIL, 1))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]], give) -> Column:
    """``give(verdict, host, path)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for v, h, p in reversed(by_length(rules)):
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(give(v, h, p))).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def resolved(target: Column, host: Column, path: Column) -> Column:
    """The absolute address a page's link names; null for other schemes, fragments and empty links. Dot segments stay as written."""
    origin = F.concat(F.lit("http://"), host)
    folder = F.regexp_extract(path, "^(.*/)", 1)
    return (
        F.when((target == "") | target.startswith("#"), None)
        .when(target.rlike(SCHEME), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike(OTHER_SCHEME), None)
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target))
    )


def declared_links(pages: DataFrame) -> DataFrame:
    """Address pairs ``a``, ``b`` that pages declare by canonical links and refresh tags outside comments, scripts and styles; empty
    where a link names none. The tags found are written once."""
    pages = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select(rest(F.col("url")).alias("from"), F.regexp_replace("html", HIDDEN, "").alias("html"))
    tags = pages.select("from", F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    canonical = F.when(_attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), _attribute(tag, "href"))
    refresh = F.when(F.lower(_attribute(tag, "http-equiv")) == "refresh", F.regexp_extract(_attribute(tag, "content"), r"""(?i)url\s*=\s*["']?([^"']*)""", 1))
    named = settle(tags.select("from", F.coalesce(canonical, refresh).alias("target")).where("target <> ''"))
    target = F.trim(F.replace("target", F.lit("&amp;"), F.lit("&")))
    absolute = named.select("from", resolved(target, host_of(F.col("from")), path_of(F.col("from"))).alias("to"))
    return absolute.select(address(F.col("from")).alias("a"), address(rest(F.col("to"))).alias("b"))


def aliases(links: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``address``, ``alias_of`` (the least address of its component) and ``blocked`` (a rule blocks an address of the component)."""
    nodes = components(links.where("a <> '' AND b <> ''"))
    verdict = ruled(host_of(F.col("node")), path_of(F.col("node")), rules, lambda v, h, p: v)
    blocked = nodes.groupBy("component").agg(F.coalesce(F.bool_or(verdict == "block"), F.lit(False)).alias("blocked"))
    return nodes.join(blocked, "component").select(F.col("node").alias("address"), F.col("component").alias("alias_of"), "blocked")


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Each page's ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``alias_of``.

    ``rules`` (verdict, host, path) fit a host and its subdomains and the paths that begin with theirs; the longest wins, of equal ones
    the one that allows. ``redirects`` may add pairs of urls ``source``, ``target``. Without a rule a page is blocked if a rule blocks
    one of its aliases, else allowed. ``alias_of`` names its component, null for a page without links.

    A url that is null or has no ``://`` has empty host and path, no rule and no alias; null html declares nothing; a null ``page_id``
    stays null; repeated rows give a row each; an empty table gives no rows; other columns are not read.
    """
    links = declared_links(pages.select("url", "html"))
    if redirects is not None:
        more = redirects.select(address(rest(F.col("source"))).alias("a"), address(rest(F.col("target"))).alias("b"))
        links = links.union(more)
    parts = pages.select("page_id", rest(F.col("url")).alias("_rest")).select("page_id", host_of(F.col("_rest")).alias("host"), path_of(F.col("_rest")).alias("path"), address(F.col("_rest")).alias("address"))
    host, path = F.col("host"), F.col("path")
    own = ruled(host, path, rules, lambda v, h, p: v)
    reached = F.when(F.col("blocked"), "block").otherwise("allow")
    return parts.join(aliases(links, rules), "address", "left").select(
        "page_id", "host", "path", ruled(host, path, rules, lambda v, h, p: h + p).alias("rule"), F.coalesce(own, reached).alias("verdict"), "alias_of")
