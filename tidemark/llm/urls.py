"""URL filter that carries decisions over to aliases.  DataFrame and SQL functions only.

A rule names a host and a path prefix and blocks or allows.  It fits its host
and every subdomain; the longest fitting rule decides.  Addresses that redirect
to each other, or name each other as canonical, are one class: an address
without a rule of its own is allowed if a member of its class is allowed by a
rule, else blocked if one is blocked, else allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.scratch import Scratch
from tidemark.llm.skew import join_per_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"

#: (host, path, verdict) of the query.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: Rules up to which they are broadcast; beyond, they are joined by host.
BROADCAST_RULES = 20_000
#: Places and addresses with a verdict up to which they are broadcast; beyond, they are joined by a sort.
BROADCAST_PLACES = 20_000

#: Pages in which none of this stands have no link; (?i) and (?s) are spelled out for both engines.
MENTIONS = r"(?i)canonical|refresh"
COMMENT = r"(?s)<!--.*?-->"
LINK, META, BASE = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>", r"(?is)<base\b[^>]*>"
REL = r"(?is)[\s\"'/]rel\s*=\s*(?:\"[^\"]*\bcanonical\b[^\"]*\"|'[^']*\bcanonical\b[^']*'|canonical\b)"
EQUIV = r"(?is)[\s\"'/]http-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?is)[\s\"'/]href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
CONTENT = r"(?is)[\s\"'/]content\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s]+)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
#: What stands for an ampersand in an attribute.
AMPERSAND = r"(?i)&(?:amp|#38|#x26);"


def host_of(url):
    """From the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url):
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def node_of(url):
    """An address without scheme, fragment and the port that its scheme implies; an empty path is /; null if it has no ://."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    port = F.when(scheme == "http", r":80$").when(scheme == "https", r":443$").otherwise(r":$")
    path = path_of(url)
    named = F.concat(F.regexp_replace(host_of(url), port, F.lit("")), F.when(path == "", "/").otherwise(path), F.regexp_extract(url, PARTS, 3))
    return F.when(F.contains(url, F.lit("://")), named)


def _let(value, use):
    """``use`` of a value that is computed once: as the variable of a lambda it is never put in several places of a plan."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _attribute(tag, pattern: str):
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _without_dots(path):
    """A path without . and .. segments."""
    root = F.array(F.lit("")).cast("array<string>")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
    step = lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    stack = lambda parts: F.aggregate(F.slice(parts, 2, F.size(parts)), root, step)
    closed = lambda parts: F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(stack(parts), F.array(F.lit("")))).otherwise(stack(parts))
    return F.when(F.contains(path, F.lit("/.")), _let(F.split(path, "/"), lambda parts: F.array_join(closed(parts), "/"))).otherwise(path)


def _parts(address):
    return F.struct(F.substring_index(address, "://", 1).alias("scheme"), F.regexp_extract(address, PARTS, 1).alias("host"), F.regexp_extract(address, PARTS, 2).alias("path"), F.regexp_extract(address, PARTS, 3).alias("rest"))


def resolve(base, target):
    """The address that a link of a page at ``base`` names; null if that is none of the web."""

    def full(at, to):
        site = F.concat(at["scheme"], F.lit("://"), at["host"])
        folder = F.when(F.contains(at["path"], F.lit("/")), F.regexp_extract(at["path"], r"(?s)^(.*/)", 1)).otherwise("/")
        return (
            F.when(F.contains(to, F.lit("://")) & to.rlike(SCHEME), to)
            .when((to == "") | to.startswith("#") | to.rlike(SCHEME), None)
            .when(to.startswith("//"), F.concat(at["scheme"], F.lit(":"), to))
            .when(to.startswith("/"), F.concat(site, to))
            .when(to.startswith("?"), F.concat(site, at["path"], to))
            .otherwise(F.concat(site, folder, to))
        )

    tidy = lambda x: F.concat(x["scheme"], F.lit("://"), x["host"], _without_dots(x["path"]), x["rest"])
    return _let(target, lambda to: _let(_parts(base), lambda at: _let(full(at, to), lambda f: _let(_parts(f), tidy))))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): each page and the addresses that its canonical links and refreshes name.

    All links of a page count, but for those in comments; relative targets start at
    the page's address, or at its <base>.  Targets without :// that name a scheme
    (mailto:) are no addresses.
    """
    html = F.col("html")
    rows = pages.where(F.contains("url", F.lit("://")) & html.rlike(MENTIONS)).select("url", F.regexp_replace(html, COMMENT, "").alias("html"))
    tags = lambda kind: F.regexp_extract_all("html", F.lit(kind), F.lit(0))
    links = F.transform(F.filter(tags(LINK), lambda t: t.rlike(REL)), lambda t: _attribute(t, HREF))
    refreshes = F.transform(F.filter(tags(META), lambda t: t.rlike(EQUIV)), lambda t: F.regexp_extract(_attribute(t, CONTENT), REFRESH, 1))
    clean = lambda t: F.trim(F.regexp_replace(t, AMPERSAND, "&"))
    rows = rows.select("url", F.regexp_extract("html", BASE, 0).alias("base"), F.concat(links, refreshes).alias("to"))
    rows = rows.select("url", clean(_attribute(F.col("base"), HREF)).alias("base"), F.explode(F.filter(F.transform("to", clean), lambda t: t != "")).alias("to"))
    start = _let(resolve(F.col("url"), F.col("base")), lambda b: F.coalesce(b, F.col("url")))
    to = _let(start, lambda at: resolve(at, F.col("to")))
    return rows.select(_let(F.col("url"), node_of).alias("a"), _let(to, node_of).alias("b")).where("a is not null and b is not null and a <> b").distinct()


def rule_of(places: DataFrame, rules: DataFrame, small: bool, labels: int) -> DataFrame:
    """place (host, path), rule, verdict for each of the distinct places that a rule fits.

    ``labels`` is the number of labels of the longest host of a rule: longer ends of
    a host meet no rule, so a host of any number of labels has few that are tried.
    """
    count = "length(host) - length(replace(host, '.', '')) + 1"
    suffixes = F.expr(f"transform(sequence(1, least({count}, {max(1, labels)})), i -> substring_index(host, '.', -i))")
    byhost = rules.groupBy("rule_host").agg(F.collect_set(F.struct("rule_path", "rule_verdict")).alias("rules"))
    byhost = F.broadcast(byhost) if small else byhost
    fits = places.withColumn("rule_host", F.explode(suffixes)).join(byhost, "rule_host")
    fits = fits.withColumn("r", F.explode("rules")).where(F.expr("startswith(path, r.rule_path)"))
    rule = F.concat("rule_host", "r.rule_path")
    rank = F.struct(F.length(rule).alias("l"), F.when(F.col("r.rule_verdict") == "allow", 1).otherwise(0).alias("a"), rule.alias("rule"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), F.col("r.rule_verdict").alias("verdict")), rank).alias("b"))
    return best.select("host", "path", "b.rule", "b.verdict")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, edges: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    ``edges`` (a, b: addresses as of :func:`node_of`) defaults to what the html
    names.  A null url, or one without ://, has an empty host and path, no rule
    and no class, and is allowed.  Repeated rows and null ids keep their rows;
    equally long rules: allow goes first.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "urls")
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    none = "select '' as rule_host, '' as rule_path, '' as rule_verdict where false"
    table = spark.sql(f"select * from values {quoted} as r(rule_host, rule_path, rule_verdict)" if rules else none)
    small, labels = len(rules) <= BROADCAST_RULES, max((r[0].count(".") + 1 for r in rules), default=1)
    links = scratch.keep(link_edges(pages) if edges is None else edges, "links")
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    sized = lambda df: F.broadcast(df) if df.count() <= BROADCAST_PLACES else df.hint("merge")
    if links.isEmpty():  # each address is a class of its own
        ruled = scratch.keep(rule_of(rows.select("host", "path").distinct(), table, small, labels), "ruled")
        out = rows.join(sized(ruled), ["host", "path"], "left").withColumn("_by_class", F.lit(None).cast("string"))
    else:
        classes = components(links, scratch)
        place = F.concat(F.lit("x://"), "node")
        parts = classes.select("node", "component", F.regexp_extract(place, PARTS, 1).alias("host"), F.regexp_extract(place, PARTS, 2).alias("path"))
        ruled = scratch.keep(rule_of(rows.select("host", "path").union(parts.select("host", "path")).distinct(), table, small, labels), "ruled")
        said = parts.join(ruled, ["host", "path"]).groupBy("component").agg(F.bool_or(F.col("verdict") == "allow").alias("let"))
        sizes = classes.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
        said = scratch.keep(said.join(sizes, "component"), "said")
        passed = join_per_key(classes, said, ["component"], classes.count(), "_n").select(F.col("node").alias("_node"), F.when(F.col("let"), "allow").otherwise("block").alias("_by_class"))
        passed = scratch.keep(passed, "passed")
        out = rows.join(sized(ruled), ["host", "path"], "left").join(sized(passed), F.col("node") == F.col("_node"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "_by_class", F.lit("allow")).alias("verdict"))
