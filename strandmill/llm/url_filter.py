"""URL filters with redirect equivalence, with DataFrame functions only.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest wins.
Pages that name other addresses for themselves (any canonical links, refresh redirects) or that a table of redirects
joins are aliases: connected components over these edges. A page without a rule of its own is blocked if any address
of its component is blocked by a rule; an explicit allow on the page's own address always holds.

Rules up to `INLINE` become one expression; more are joined on host suffixes, once for each distinct host and path.
Pages are never grouped by host, so a frequent host is no hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

INLINE = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ://, or empty."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """Host, path and query: what two spellings of an address share; null without a host."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def _verdict(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and own (its verdict) to rows with host and path."""
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict in ('allow', 'block')").distinct()
    few = rules.limit(INLINE + 1).collect()
    if len(few) <= INLINE:
        # Of equally long rules the allowing one holds, then the first by text.
        ordered = sorted(few, key=lambda r: (-len(r["host"] + r["path"]), r["verdict"], r["host"] + r["path"]))
        best = reduce(
            lambda rest, r: F.when(
                ((F.col("host") == r["host"]) | F.col("host").endswith("." + r["host"])) & F.col("path").startswith(r["path"]),
                F.struct(F.lit(r["host"] + r["path"]).alias("rule"), F.lit(r["verdict"]).alias("own")),
            ).otherwise(rest),
            reversed(ordered),
            F.lit(None).cast("struct<rule:string,own:string>"),
        )
        return rows.withColumn("_best", best).select(*rows.columns, "_best.rule", "_best.own")
    places = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), "."))
    spread = places.withColumn("labels", labels).select("host", "path", F.explode(suffixes).alias("rule_host"))
    renamed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict"))
    fits = spread.join(renamed, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length(text)).alias("n"), F.col("verdict").alias("own"), text.alias("rule"))).alias("_best"))
    judged = best.select("host", "path", "_best.rule", "_best.own")
    return rows.join(judged, ["host", "path"], "left").select(*rows.columns, "rule", "own")


def _attribute(html: Column, tag: str, value: str) -> Column:
    """What `value` finds in each tag that matches, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}[^>]*>"), F.lit(0)), lambda t: F.regexp_extract(t, rf"(?is){value}", 1))


def _without_dots(path: Column) -> Column:
    """The path with its segments . and .. carried out."""
    parts = F.slice(F.split(path, "/", -1), 2, 1 << 30)
    last = F.element_at(parts, -1)
    parts = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    step = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.concat(done, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(step, "/"))


def resolved(to: Column, url: Column) -> Column:
    """The whole address of a link's target as it stands in a page: a scheme of its own, //host, /path, ?query or
    relative to the page's folder. Null for none, for a mere #fragment and for schemes without a host."""
    to = F.trim(F.regexp_replace(to, r"(?i)&(amp|#38|#x26);", "&"))
    own, path = host_of(url), path_of(url)
    ahead, rest = F.regexp_extract(to, r"^[^?#]*", 0), F.regexp_extract(to, r"^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/(.*/)?", 1))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | to.startswith("#") | (to == "") | (own == ""), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("?"), F.concat(F.lit("http://"), own, path, to))
        .otherwise(F.concat(F.lit("http://"), own, _without_dots(F.when(to.startswith("/"), ahead).otherwise(F.concat(folder, ahead))), rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): a page's address and each that one of its canonical links or refresh redirects names."""
    html, url = F.col("html"), F.col("url")
    canonical = _attribute(html, r"link\b[^>]*\brel\s*=\s*[\"']?canonical\b", r"\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = _attribute(html, r"meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b", r"\burl\s*=\s*[\"']?([^\"'\s>]+)")
    found = pages.where(html.isNotNull() & html.rlike("(?i)canonical|refresh")).select("url", F.explode(F.concat(canonical, refresh)).alias("to"))
    return found.select(address_of(url).alias("a"), address_of(resolved(F.col("to"), url)).alias("b")).where("a is not null and b is not null")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, by (rule, alias or default) for every page.

    Every canonical link and refresh redirect of a page counts, its target resolved against the page's url.
    Null urls and such without :// have empty host and path, which no rule of a non-empty path fits, and no aliases.
    Repeated pages are judged alike. Without edges or rules only the default is left. `redirects`: (source, target).
    """
    rows = pages.select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    judged = _verdict(rows, rules)
    edges = page_links(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(redirects.select(address_of(F.col("source")), address_of(F.col("target"))).toDF("a", "b").where("a is not null and b is not null"))
    edges = written(edges.distinct(), "redirects")
    final = judged.withColumn("aliased", F.lit(False))
    if not edges.isEmpty():
        nodes = written(connected_components(edges), "aliases")
        places = nodes.select("node", "component", F.regexp_extract("node", r"^[^/?#]*", 0).alias("host"), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1).alias("path"))
        bad = _verdict(places, rules).where("own = 'block'").select("component").distinct()
        blocked = nodes.join(bad, "component", "left_semi").select(F.col("node").alias("address"), F.lit(True).alias("aliased"))
        final = judged.withColumn("address", address_of(F.col("url"))).join(blocked, "address", "left")
    verdict = F.coalesce("own", F.when(F.col("aliased"), F.lit("block")), F.lit(default))
    by = F.when(F.col("own").isNotNull(), "rule").when(F.col("aliased"), "alias").otherwise("default")
    return final.select("page_id", "host", "path", "rule", verdict.alias("verdict"), by.alias("by"))
