"""Block and allow rules for URLs, with verdicts that follow redirects and canonical links.

A rule is a host and a path prefix; it fits the host, its subdomains, and paths which start
with its path. The longest rule decides. Pages which point at one another by a canonical
link or a refresh redirect are aliases: the connected components of these edges, found by
star contraction over written tables. A page without a rule of its own takes the verdict
of its aliases: allowed if an allow rule names one of them, else blocked if a block rule
does, else allowed. Only DataFrame functions are used.

Defined results. NULL urls and urls without ``://`` have an empty host and path, no rule
and the verdict allow; a page without a host has no aliases. NULL or empty html has no edges. Tag and attribute
names are read in any case, values with or without quotes, ``rel`` as a list of tokens;
every canonical link and refresh of a page counts. Of entities ``&amp;`` and its numeric
forms are decoded. Relative links start from the page's own url; ``<base>`` is not read. Scheme and fragment do not tell nodes
apart. Repeated rows get equal verdicts. Of two equal rules, allow wins.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import reduce_to_stars
from ..operators.joins import salted_join
from ..session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 10_000
MAX_BROADCAST_NODES = 500_000

# Tags end at the first > outside quotes; an attribute's name follows white space, a quote or a slash.
LINK = r"""(?is)<link(?=[\s/])(?:[^>"']|"[^"]*"|'[^']*')*>"""
META = r"""(?is)<meta(?=[\s/])(?:[^>"']|"[^"]*"|'[^']*')*>"""
# Attributes before a given one are passed over whole, so that its name in a value does not count.
BEFORE = r"""(?is)^<\w+(?:[\s/]+(?!%s[\s=/>])[^\s=/>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*[\s/]+%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
TARGET = r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?\s*([^"'\s]*)"""
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"
ENTITIES = ["(?i)&#0*38;|&#x0*26;|&amp;", "&"]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query; NULL without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct (size, allowed, rule), or NULL."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: they are part of the plan")
    by_host = defaultdict(list)
    for r in rules:
        by_host[r.host].append(r)
    if not by_host:
        return F.lit(None).cast("struct<size:int,allowed:boolean,rule:string,path:string>")

    def entry(r: Rule) -> Column:
        return F.struct(
            F.lit(len(r.name)).alias("size"),
            F.lit(r.verdict == "allow").alias("allowed"),
            F.lit(r.name).alias("rule"),
            F.lit(r.path).alias("path"),
        )

    table = F.create_map(*[c for h, own in by_host.items() for c in (F.lit(h), F.array(*map(entry, own)))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    known = F.filter(F.transform(suffixes, lambda s: F.element_at(table, s)), lambda own: own.isNotNull())
    return F.array_max(F.filter(F.flatten(known), lambda r: path.startswith(r["path"])))


def attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute ``name`` of a tag, with &amp; decoded, or an empty string."""
    pattern = BEFORE % (name, name)
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.trim(F.regexp_replace(value, *map(F.lit, ENTITIES)))


def without_dots(path: Column) -> Column:
    """A path from its root with its . and .. segments resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda done, one: F.when(one == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(one == ".", done)
        .otherwise(F.concat(done, F.array(one))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(last.isin(".", "..") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve(link: Column, url: Column) -> Column:
    """A link as a url with a scheme: relative ones start from the page's own url."""
    root, path = F.concat(F.lit("http://"), host_of(url)), path_of(url)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    own, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike(SCHEME), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("#"), F.regexp_extract(url, r"(?s)^([^#]*)", 1))
        .when(link.startswith("?"), F.concat(root, path, link))
        .when(link.startswith("/"), F.concat(root, F.when(own.rlike(r"/\.\.?(/|$)"), without_dots(own)).otherwise(own), rest))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct edges (u, v), u > v, between nodes, from the links of each page."""
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    canonical = F.filter(tags(LINK), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(tags(META), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh")
    links = F.concat(
        F.transform(canonical, lambda t: attribute(t, "href")),
        F.transform(refresh, lambda t: F.regexp_extract(attribute(t, "content"), TARGET, 1)),
    )
    rows = pages.select(F.col(url).alias("_url"), F.explode(links).alias("_link")).where("_link <> ''")
    whole = resolve(F.col("_link"), F.col("_url"))
    ends = rows.select(node_of(F.col("_url")).alias("a"), node_of(whole).alias("b")).where("a <> b")
    return ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def alias_verdicts(edges: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """Node and the verdict (allow, block or NULL) which the rules give to its component."""
    stars = reduce_to_stars(stage(edges, "alias-edges"), [])
    if stars is None:
        return None
    stars = stars.select("u", "v")
    members = stars.unionByName(stars.select(F.col("v").alias("u"), "v").distinct())
    as_url = F.concat(F.lit("http://"), "u")
    named = members.withColumn("_allowed", rule_of(host_of(as_url), path_of(as_url), rules)["allowed"])
    roots = named.groupBy("v").agg(F.max("_allowed").alias("_best")).where("_best IS NOT NULL")
    roots = stage(roots, "alias-roots")
    if roots.count() <= MAX_BROADCAST_NODES:
        found = members.join(F.broadcast(roots), "v")
    else:
        found = salted_join(members, roots, ["v"], "u")
    return found.select(F.col("u").alias("_node"), F.when(F.col("_best"), "allow").otherwise("block").alias("_alias"))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``."""
    found = alias_verdicts(alias_edges(pages, url, html), rules)
    rows = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    if found is None:
        rows = rows.withColumn("_alias", F.lit(None).cast("string"))
    else:
        found = stage(found, "alias-verdicts")
        rows = rows.withColumn("_node", node_of(F.col(url)))
        if found.count() <= MAX_BROADCAST_NODES:
            rows = rows.join(F.broadcast(found), "_node", "left")
        else:
            rows = salted_join(rows, found, ["_node"], html, "left")
    own = F.when(F.col("_rule.allowed"), "allow").when(~F.col("_rule.allowed"), "block")
    rows = rows.withColumn("rule", F.col("_rule.rule")).withColumn("verdict", F.coalesce(own, "_alias", F.lit("allow")))
    return rows.drop("_rule", "_node", "_alias")
