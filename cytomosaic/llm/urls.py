"""URL rules with decisions carried along redirects and canonical links.

A page's own rule decides. A page without one takes the decision of its equivalence class: the connected component over
redirect edges (a refresh header in the page), declared canonical links, and the spellings that servers redirect to one
another by convention (scheme, ``www.`` and ``m.`` hosts, fragment, campaign parameters, a trailing slash or ``.html``).
In a class an explicit allow comes before any block, and a block before nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomosaic.llm.common import Workspace
from cytomosaic.llm.components import components

# patterns of a page's own statements: a tag, and the address in it
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
BASE = r"""(?is)<base\b[^>]*\bhref\s*=[^>]*>"""
#: Query parameters that do not make another page.
CAMPAIGN = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, or nulls. ``rules`` are (verdict, host, path); the list is an argument."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def spelled(df: DataFrame, url: str, out: str) -> DataFrame:
    """Adds ``out``, the spelling that other spellings of the page at ``url`` redirect to; null without a host.

    Parts that are named more than once are columns of their own, step by step, so that each is computed once.
    """
    address = F.col(url)
    df = df.withColumns({
        "_host": F.regexp_replace(host_of(address), r"^(www|m)\.", ""),
        "_path": F.regexp_replace(path_of(address), r"(?s)(/index)?(\.html?|/)+$", ""),
        "_query": F.split(F.regexp_extract(address, r"(?s)\?([^#]*)", 1), "&"),
    })
    kept = F.filter("_query", lambda p: ~p.rlike(CAMPAIGN) & (p != ""))
    df = df.withColumn("_tail", F.array_join(F.array_sort(kept), "&"))
    whole = F.concat("_host", "_path", F.when(F.col("_tail") != "", F.concat(F.lit("?"), "_tail")).otherwise(""))
    return df.withColumn(out, F.when(F.col("_host") != "", whole)).drop("_host", "_path", "_query", "_tail")


def without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments carried out."""

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/"), "/")
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolved(df: DataFrame, link: str, url: str, out: str) -> DataFrame:
    """Adds ``out``, the link as a page states it put against the address ``url``; null for other schemes without a host,
    and without an address."""
    address, clean, own, rest = F.col(url), F.col("_clean"), F.col("_own"), F.col("_rest")
    df = df.withColumn("_clean", F.replace(F.col(link), F.lit("&amp;"), F.lit("&")))
    df = df.withColumns({
        "_own": F.regexp_extract(clean, r"(?s)^([^?#]*)", 1),
        "_rest": F.regexp_extract(clean, r"(?s)^[^?#]*(.*)$", 1),
        "_root": F.regexp_extract(address, r"(?s)^(.*?://[^/?#]*)", 1),
        "_page": path_of(address),
    })
    folder = F.concat(F.lit("/"), F.regexp_extract("_page", r"(?s)^/(.*/)?", 1))
    whole = (
        F.when(clean.isNull(), F.lit(None))
        .when(own.contains("://"), clean)
        .when(clean.startswith("//"), F.concat(F.lit("http:"), clean))
        .when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (F.col("_root") == ""), F.lit(None))
        .when(own.startswith("/"), F.concat("_root", without_dots(own), rest))
        .when(own != "", F.concat("_root", without_dots(F.concat(folder, own)), rest))
        .when(rest.startswith("?"), F.concat("_root", "_page", rest))
        .otherwise(F.concat("_root", "_page", F.regexp_extract(address, r"(?s)(\?[^#]*)", 1)))
    )
    return df.withColumn(out, whole).drop("_clean", "_own", "_rest", "_root", "_page")


def stated(pages: DataFrame) -> DataFrame:
    """Adds ``_base``, ``_canonical`` and ``_refresh`` to (page_id, url, html), without the html: addresses as the page
    writes them, or null. Each html is searched once for each kind of tag."""
    html = F.coalesce(F.col("html"), F.lit(""))
    tags = {"_base": (BASE, HREF), "_canonical": (CANONICAL, HREF), "_refresh": (REFRESH, TARGET)}
    found = pages.select("page_id", "url", *[F.regexp_extract(F.regexp_extract(html, tag, 0), address, 1).alias(c) for c, (tag, address) in tags.items()])
    return found.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in tags})


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url, html).

    A null or hostless url has empty host and path, fits no rule, is linked with nothing and gets ``default``. Repeated
    rows are judged alike. Links are read from all of the html; a null html has none. Other columns are not read.
    """
    ws = Workspace(pages.sparkSession, "urls")
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    found = resolved(stated(pages), "_base", "url", "_against").withColumn("_against", F.coalesce("_against", "url"))
    found = resolved(resolved(found, "_canonical", "_against", "_canonical_url"), "_refresh", "_against", "_refresh_url")
    for address, out in (("url", "spelling"), ("_canonical_url", "_canonical_as"), ("_refresh_url", "_refresh_as")):
        found = spelled(found, address, out)
    read = found.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "spelling", F.array_compact(F.array("_canonical_as", "_refresh_as")).alias("targets")
    )
    read = ws.keep(read.select("page_id", "host", "path", "spelling", "targets", name.alias("rule"), verdict.alias("own")), "pages")

    edges = read.select(F.col("spelling").alias("a"), F.explode("targets").alias("b"))
    classes = components(edges, ws).select(F.col("node").alias("spelling"), "label")
    # what each spelling says, before it is looked up in the classes; a spelling that no link mentions is its own class
    said = (
        read.filter("spelling IS NOT NULL AND own IS NOT NULL")
        .groupBy("spelling")
        .agg(F.max(F.col("own") == "allow").alias("allows"))
        .join(classes, "spelling", "left")
        .groupBy(F.coalesce("label", "spelling").alias("class"))
        .agg(F.max("allows").alias("allows"))
    )
    spellings = read.filter("spelling IS NOT NULL AND own IS NULL").select("spelling").distinct()
    carried = (
        spellings.join(classes, "spelling", "left")
        .withColumn("class", F.coalesce("label", "spelling"))
        .join(said, "class")
        .select("spelling", F.when(F.col("allows"), "allow").otherwise("block").alias("carried"))
    )
    return read.join(carried, "spelling", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", "carried", F.lit(default)).alias("verdict")
    )
