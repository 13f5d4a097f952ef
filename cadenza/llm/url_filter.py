"""Allow and block decisions on URLs that reach every alias of a page.

A rule names a host and a path start and fits that host with its subdomains; the longest fitting rule decides. URLs tied
together by canonical links or redirects are aliases: they form the components of a graph whose nodes are URLs without
fragment, scheme and host in lower case. A URL under a rule keeps the rule's action. Any other URL takes the decisions of its
component, where an explicit allow precedes a block; without either it is allowed.

All canonical links and refresh redirects of a page count, with their attributes in any order. Their targets may be relative to
the page, to its directory or query, and are resolved against its URL; ``<base>`` is not looked at, and targets of
schemes without ``//`` (mailto, javascript) name no page.

A null URL, or one without ``://``, has an empty host and path, no rule and no aliases, and is allowed. Repeated rows get
the same verdict. Targets that no row names still carry rules into their component.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.common import lookup
from cadenza.core.session import materialise
from cadenza.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A rule list is code or configuration, so its size does not follow the data; beyond this many it becomes a joined table.
LITERAL_RULES = 64

# Tags by which a page states where it really lives: (tag, what it must hold, where its target stands).
LINKS = ((r"(?i)<link\s[^>]*>", r"""(?i)\srel\s*=\s*["']?\s*canonical["'\s/>]""", r"""(?i)\shref\s*=\s*["']?\s*([^"'\s>]+)"""),
         (r"(?i)<meta\s[^>]*>", r"""(?i)\shttp-equiv\s*=\s*["']?\s*refresh["'\s/>]""", r"""(?i)[\s;,"'=]url\s*=\s*["']?\s*([^"'\s>]+)"""))


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^#]*", 0)


def node_of(url: Column) -> Column:
    """The URL as a node: without fragment, scheme and host in lower case."""
    head = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*", 0)
    return F.concat(F.translate(head, UPPER, LOWER), F.substr(without_fragment(url), F.length(head) + 1, F.length(url)))


def plain_path(path: Column) -> Column:
    """A path that starts with a slash without its ``.`` and ``..`` segments."""
    none = F.array().cast("array<string>")
    parts = F.split(F.substr(path, F.lit(2), F.length(path)), "/")
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(none)
    kept = F.aggregate(parts, none, lambda acc, s: F.when(s == "..", up(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    # A path that ends in such a segment ends in a slash.
    tail = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(path)


def resolved(url: Column, to: Column) -> Column:
    """The absolute URL that the reference ``to`` on the page ``url`` names; null if it names no other page."""
    scheme, origin = F.regexp_extract(url, r"^[^/?#]*", 0), F.regexp_extract(url, r"^[^/?#]*://[^/?#]*", 0)
    path = path_of(url)
    folder = F.regexp_extract(path, r"^.*/", 0)
    ref, query = F.regexp_extract(to, r"^[^?#]*", 0), F.regexp_extract(to, r"^[^?#]*(\?[^#]*)?", 1)
    full = F.when(F.startswith(ref, F.lit("/")), ref).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), ref))
    return (F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
            .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(F.startswith(to, F.lit("//")), F.concat(scheme, to))
            .when(F.startswith(to, F.lit("#")), F.lit(None))
            .when(F.startswith(to, F.lit("?")), F.concat(origin, path, query))
            .otherwise(F.concat(origin, plain_path(full), query)))


def with_rules(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Add rule and action of the longest rule that fits (host, path); both null without one."""
    split = sorted(((r, *r.partition("/")[::2], a) for r, a in rules), key=lambda x: (-len(x[0]), x[0]))
    if len(split) <= LITERAL_RULES:
        rule = action = F.lit(None).cast("string")
        for text, host, path, act in reversed(split):
            fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + path))
            rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
        return urls.withColumns({"rule": rule, "action": action})
    # Many rules: look each suffix of a host up by equality. Suffixes have at most as many labels as the longest rule.
    table = urls.sparkSession.createDataFrame(split, "rule string, rule_host string, rule_path string, action string")
    most = max(h.count(".") + 1 for _, h, _, _ in split)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    hit = (urls.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes)).join(lookup(table, len(split)), "rule_host")
           .filter(F.startswith("path", F.concat(F.lit("/"), "rule_path"))).groupBy("host", "path")
           .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best")))
    return urls.join(hit, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "action": F.col("best.action")}).drop("best")


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """a, b: a page and the pages that its canonical links and refresh redirects name, as nodes."""
    def named(tag: str, needs: str, target: str) -> Column:
        tags = F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: F.rlike(t, F.lit(needs)))
        return F.transform(tags, lambda t: F.regexp_extract(t, target, 1))

    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).filter("instr(url, '://') > 0")
    rows = rows.select("url", F.explode(F.array_distinct(F.concat(*(named(*link) for link in LINKS)))).alias("to")).filter("to <> ''")
    rows = rows.select("url", resolved(F.col("url"), F.replace("to", F.lit("&amp;"), F.lit("&"))).alias("to")).filter("to IS NOT NULL")
    return rows.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               html_col: str | None = "html", links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict. ``links(a, b)`` adds redirects known from elsewhere, such as a crawl log."""
    edges = page_links(pages, url_col, html_col) if html_col else None
    if links is not None:
        more = links.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
        edges = more if edges is None else edges.unionByName(more)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = with_rules(rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
    if edges is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    member = materialise(components(edges), "aliases")
    ruled = with_rules(member.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    said = ruled.filter("action IS NOT NULL").groupBy("component").agg(F.min("action").alias("inherited"))      # allow < block
    aliases = member.join(said, "component").select(F.col("node").alias("key"), "inherited")
    rows = rows.withColumn("key", F.when(F.instr("url", "://") > 0, node_of(F.col("url"))))
    return rows.join(aliases, "key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", "inherited", F.lit("allow")).alias("verdict"))
