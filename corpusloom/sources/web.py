"""Links of web pages, and the policy for addresses that may be fetched."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths

_HREF = r"""(?is)<(?:a|area|link)\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
_BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


def resolve(base, link):
    """Absolute URL of a link, native: absolute, //host, /path, ?query and relative forms with '..' steps."""
    scheme = F.regexp_extract(base, r"^([A-Za-z]+):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    bare = F.regexp_replace(link, "#.*$", "")
    local = F.when(bare == "", path).when(bare.startswith("?"), F.concat(path, bare)).when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    query = F.regexp_extract(local, r"(\?.*)$", 1)
    steps = F.split(F.regexp_replace(local, r"\?.*$", ""), "/")
    flat = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    dots = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    whole = F.concat(site, F.array_join(flat, "/"), dots, query)
    return F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare).when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare)).otherwise(whole)


def links(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id", same_domain: bool = False, suffix: str | None = ".pdf", ambiguous: bool = False, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """key, position (from 1), link: http(s) targets of a, area and link tags, first seen first, once a page.

    suffix: only paths that end so; ``ambiguous`` also takes paths whose last part has no extension.
    limit: links of a page (the feature's own bound), None for all.
    """
    page = F.lower(F.col(url))
    base = F.coalesce(F.nullif(F.regexp_extract(F.col(html), _BASE, 1), F.lit("")), F.col(url))
    found = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda g: F.lit(None).cast("string"))
    hrefs = F.zip_with(F.zip_with(*(F.regexp_extract_all(F.col(html), F.lit(_HREF), F.lit(g)) for g in (1, 2)), lambda a, b: F.concat(a, b)), F.regexp_extract_all(F.col(html), F.lit(_HREF), F.lit(3)), lambda a, b: F.trim(F.concat(a, b)))
    del found
    rows = pages.where(F.col(html).isNotNull() & F.col(url).isNotNull()).select(key, page.alias("__page"), base.alias("__base"), F.posexplode(hrefs).alias("__n", "__h"))
    unescaped = F.replace(F.col("__h"), F.lit("&amp;"), F.lit("&"))
    rows = rows.where("__h <> ''").select(key, "__page", "__n", resolve(F.col("__base"), unescaped).alias("link")).where(F.col("link").rlike("^(?i:https?)://"))
    path = F.regexp_extract("link", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    if suffix:
        hit = F.lower(path).endswith(suffix.lower())
        if ambiguous:
            hit = hit | ~F.regexp_extract(path, "([^/]*)$", 1).contains(".")
        rows = rows.where(hit)
    if same_domain:
        rows = rows.where(paths.url_domain(F.col("link")) == paths.url_domain(F.col("__page")))
    if pattern:
        rows = rows.where(F.col("link").rlike(pattern))
    first = rows.groupBy(key, "link").agg(F.min("__n").alias("__n"))
    out = first.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("__n")))
    return (out.where(F.col("position") <= limit) if limit else out).select(key, "position", "link")


def page_links(spark: SparkSession, path: str, suffix: str | None = ".pdf", ambiguous: bool = False, same_domain: bool = True, limit: int | None = 200) -> DataFrame:
    return links(spark.read.parquet(path), suffix=suffix, ambiguous=ambiguous, same_domain=same_domain, limit=limit)


def unique_names(rows: DataFrame, name: str = "name", order: str = "position") -> DataFrame:
    """Names made distinct: the n-th of equal names (n > 1) gets __n before its extension."""
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order))
    c = F.col(name)
    marked = F.concat(F.regexp_replace(c, r"(\.[^.]+)$", ""), F.lit("__"), F.col("__n"), F.regexp_extract(c, r"(\.[^.]+)$", 1))
    return rows.withColumn("__n", n).withColumn(name, F.when(F.col("__n") == 1, c).otherwise(marked)).drop("__n")


def is_global(address: str) -> bool:
    """Whether an IP address is on the public network."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    inner = getattr(ip, "ipv4_mapped", None)
    return (inner or ip).is_global and not ip.is_multicast


def may_redirect(old: str, new: str) -> bool:
    """No step from https to http, no other scheme, and only within one site (the last two labels of the host)."""
    a, b = urlsplit(old), urlsplit(urljoin(old, new))
    if b.scheme not in ("http", "https") or (a.scheme == "https" and b.scheme == "http") or not b.hostname:
        return False
    site = lambda h: ".".join((h or "").lower().rsplit(".", 2)[-2:])
    return site(a.hostname) == site(b.hostname)


def retry_waits(tries: int, first: float = 1.0) -> list[float]:
    return [first * 2**i for i in range(max(0, tries - 1))]
