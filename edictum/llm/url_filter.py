"""URL filters with redirect equivalence.

Rules name a host (with all its subdomains) and a path prefix; the longest that fits decides.
Pages that no rule names take part through their aliases: redirects (meta refresh) and
canonical links are edges between urls, their connected components are classes of the same
page, and a block of any url in a class holds for all its urls, except those that a rule allows.
All of it is DataFrame operations; only pages with an edge take part in the components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictum.llm.components import connected_components
from edictum.llm.workspace import materialize

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path).
Rule = tuple[str, str, str]
#: Tags that can hold links (one ends before the next ``<``, so no page is searched twice), what makes them do, and what is no part of a page's markup.
_TAGS = r"(?i)<(?:link|meta)\b[^<>]*+>"
_CANONICAL, _HREF = r"""(?is)^<link\b.*[\s"'/]rel\s*=\s*["']?canonical\b""", r"""(?i)[\s"'/]href\s*=\s*["']?([^"'\s>]+)"""
_REFRESH, _URL = r"""(?is)^<meta\b.*[\s"'/]http-equiv\s*=\s*["']?refresh\b""", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
_NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), AZ, az)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct of rule (host and path) and verdict of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    return F.coalesce(*(F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in ordered), F.lit(None).cast("struct<rule:string,verdict:string>"))


def address(url: Column) -> Column:
    """A url as a node: without its fragment, host in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    return F.concat(F.regexp_extract(bare, r"(?s)^(.*?://|)", 1), F.when(F.locate("://", bare) > 0, host_of(bare)).otherwise(F.lit("")), F.regexp_replace(bare, r"(?s)^.*?://[^/?#]*", ""))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``url``, ``alias``: all canonical and redirect targets in the pages, made absolute.

    Tags in comments and scripts don't count; neither do tags with ``<`` or ``>`` in their attributes, or without an end. A page takes
    time in proportion to its length. Relative targets are completed by scheme and host of the page; those without an absolute
    page url are ignored, as are null urls and pages.
    """
    html, url = F.col(html_col), F.col(url_col)
    marked = pages.select(url.alias("url"), html.alias("html")).filter(F.col("html").rlike("(?i)canonical|refresh") & F.col("url").contains("://"))
    marked = marked.withColumn("html", F.regexp_replace("html", _NO_MARKUP, " "))
    tags = marked.select("url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0)))).alias("tag"))
    target = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _URL, 1))
    each = tags.select("url", target.alias("t")).filter("t <> ''").withColumn("t", F.replace("t", F.lit("&amp;"), F.lit("&")))
    scheme, site = F.regexp_extract("url", r"(?s)^(.*?)://", 1), F.regexp_extract("url", r"(?s)^.*?://[^/?#]*", 0)
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(path_of(F.col("url")), r"(?s)^.*/", 0), F.lit("")), F.lit("/")))
    full = F.when(F.col("t").contains("://"), F.col("t")).when(F.col("t").startswith("//"), F.concat(scheme, F.lit(":"), F.col("t"))).when(F.col("t").startswith("/"), F.concat(site, F.col("t"))).otherwise(F.concat(folder, F.col("t")))
    return each.select(address(F.col("url")).alias("url"), address(full).alias("alias")).distinct()


def judge(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``by`` (rule, alias or default) of every page.

    A rule that fits decides. Else a page is blocked if a url of its class of aliases is blocked
    by a rule, and has the verdict ``default`` if not. ``edges`` (url, alias) adds redirects that
    are known from elsewhere. Null urls and urls without ``://`` have empty host and path, fit
    no rule but those of an empty host, and have no aliases. Repeated rows are judged each. An
    empty table gives no rows; other columns are left out.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    links = alias_edges(pages, url_col, html_col)
    if edges is not None:
        links = links.unionByName(edges.select(address(F.col("url")).alias("url"), address(F.col("alias")).alias("alias"))).distinct()
    classes = connected_components(links, "url", "alias")
    by_url = classes.withColumn("m", matched_rule(host_of(F.col("node")), path_of(F.col("node")), rules))
    blocked = by_url.filter("m.verdict = 'block'").select("component").distinct()
    aliases = materialize(classes.join(blocked, "component").select(F.col("node").alias("__node")).distinct(), "blocked")
    own = F.when(F.col("url").contains("://"), address(F.col("url")))
    out = judged.join(aliases, own == F.col("__node"), "left")
    alias = F.col("__node").isNotNull()
    by = F.when(F.col("m").isNotNull(), "rule").when(alias, "alias").otherwise("default")
    return out.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce(F.col("m.verdict"), F.when(alias, F.lit("block")), F.lit(default)).alias("verdict"), by.alias("by"))
