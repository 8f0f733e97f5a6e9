"""Stored web pages: text, links, titles, and the pages reachable from an address."""

from __future__ import annotations

import html as entities

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from inquest.constants import (MAX_SITE_DEPTH, MAX_SITE_PAGES, MIN_PAGE_CHARS, SKIP_LINKS)
from inquest.functions.strings import strip
from inquest.session import cut_lineage

HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>"
TAG = r"<[a-zA-Z/!?][^>]*>"
HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
MARK = "\u0001"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
ROOT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*"


@F.pandas_udf(T.ArrayType(T.StringType()))
def characters(references: pd.Series) -> pd.Series:
    """What each character reference of a text stands for."""
    return references.map(lambda r: None if r is None else [entities.unescape(x) for x in r])


def decoded(text: Column) -> Column:
    """Character references replaced by the characters they name.

    Only the references go to Python, so a task there holds no whole texts.
    """
    named = characters(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
    return F.array_join(F.zip_with(F.split(text, REFERENCE), named, lambda part, c: F.concat(
        part, F.coalesce(c, F.lit("")))), "")


def resolved(base: Column, href: Column) -> Column:
    """A link relative to its page, without fragment and closing slash; null without an address."""
    root = F.regexp_extract(base, ROOT, 0)
    scheme = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", 0)
    page = F.regexp_replace(F.substring(base, F.length(root) + 1, F.length(base)), r"[?#].*$", "")
    link = F.regexp_replace(decoded(href), r"#.*$", "")
    path, query = F.regexp_replace(link, r"\?.*$", ""), F.regexp_extract(link, r"\?.*$", 0)
    folder = F.regexp_replace(page, r"[^/]*$", "")
    parts = F.split(F.when(path.startswith("/"), path).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), path)), "/")
    last = F.element_at(parts, -1)
    steps = F.concat(parts, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")))
    # "." stays where it is, ".." goes one up, but never above the root
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda out, part: F.when(
        part == ".", out).when(part == "..", F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1))
                               .otherwise(out)).otherwise(F.concat(out, F.array(part))))
    joined = F.concat(root, F.array_join(kept, "/"), query)
    whole = (F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
             .when(link.startswith("//"), F.concat(scheme, link))
             .when(link == "", F.regexp_replace(base, r"#.*$", ""))
             .when(path == "", F.concat(root, page, query)).otherwise(joined))
    return F.when(root != "", F.coalesce(F.nullif(F.rtrim(whole, F.lit("/")), F.lit("")), whole))


def visible_markup(html: Column) -> Column:
    return F.regexp_replace(html, HIDDEN, "")


def without_tags(html: Column) -> Column:
    return F.regexp_replace(visible_markup(html), TAG, MARK)


def title_markup(html: Column) -> Column:
    return F.regexp_extract(visible_markup(html), TITLE, 1)


def text_of(marked: Column) -> Column:
    """Text nodes, stripped, one per line."""
    return F.array_join(F.filter(F.transform(F.split(decoded(marked), MARK), strip), lambda t: t != ""), "\n")


def title_of(markup: Column) -> Column:
    return F.nullif(F.substring(strip(decoded(markup)), 1, 200), F.lit(""))


def page_text(html: Column) -> Column:
    return text_of(without_tags(html))


def page_title(html: Column) -> Column:
    return title_of(title_markup(html))


def title_from_url(url: Column) -> Column:
    """The last part of the path in words, else the host."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    path = F.rtrim(F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), F.lit("/"))
    last = F.element_at(F.split(path, "/"), -1)
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.when(last == "", host).otherwise(F.substring(F.translate(last, "-_", "  "), 1, 200))


def without_fragment(url: Column) -> Column:
    bare = F.regexp_replace(url, r"#.*$", "")
    return F.coalesce(F.nullif(F.rtrim(bare, F.lit("/")), F.lit("")), bare)


def site_of(url: Column) -> Column:
    """The host, where ``www`` makes no difference."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def page_documents(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``url``, ``title`` and ``text`` of pages that have enough to read."""
    # in a column of its own the markup is read once, though its text is used twice
    read = pages.select(F.col(url).alias("url"), title_markup(F.col(html)).alias("head"),
                        without_tags(F.col(html)).alias("marked"))
    title = F.coalesce(title_of(F.col("head")), title_from_url(F.col("url")))
    return (read.select("url", title.alias("title"), text_of(F.col("marked")).alias("text"))
            .where(F.length("text") >= MIN_PAGE_CHARS))


def page_hrefs(pages: DataFrame, url: str = "url", html: str = "html",
               keep: list[str] = ()) -> DataFrame:
    """Every link as written, with its place on the page."""
    quoted = F.regexp_extract_all(visible_markup(F.col(html)), F.lit(HREF), 1)
    hrefs = F.filter(F.transform(quoted, lambda h: F.btrim(h, F.lit("\"'"))), lambda h: h != "")
    return pages.select(F.col(url).alias("src_url"), *keep,
                        F.posexplode(hrefs).alias("position", "href"))


def page_links(pages: DataFrame, url: str = "url", html: str = "html",
               keep: list[str] = ()) -> DataFrame:
    """Edges ``src_url`` to ``dst_url`` for addresses on the web."""
    return (page_hrefs(pages, url, html, keep)
            .withColumn("dst_url", resolved(F.col("src_url"), F.col("href")))
            .where(F.lower("dst_url").rlike("^https?://")))


def followable(target: Column, start: Column) -> Column:
    return ~target.rlike(SKIP_LINKS) & (site_of(target) == site_of(start))


def page_graph(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """Readable pages (``url, title, characters``) and the links a walk may follow, both stored.

    The markup is read where it lies; only addresses and titles leave a task. Of pages stored
    under one address one readable one counts.
    """
    address = without_fragment(F.col(url))
    marked = pages.select(address.alias("url"), F.xxhash64(html).alias("mark"), F.col(html).alias("html"),
                          without_tags(F.col(html)).alias("marked"), title_markup(F.col(html)).alias("head"))
    read = marked.select("url", "mark", "html", F.length(text_of(F.col("marked"))).alias("characters"),
                         F.coalesce(title_of(F.col("head")), title_from_url(F.col("url"))).alias("title"))
    read = read.where(F.col("characters") >= MIN_PAGE_CHARS)
    nodes = cut_lineage(read.groupBy("url").agg(F.min(F.struct("mark", "title", "characters")).alias("p"))
                        .select("url", "p.*"))
    links = page_links(read.select("url", "html", "mark"), "url", "html", ["mark"])
    inside = links.where(followable(F.col("dst_url"), F.col("src_url"))).groupBy(
        "src_url", "mark", "dst_url").agg(F.min("position").alias("position"))
    chosen = inside.join(nodes.select(F.col("url").alias("src_url"), "mark"), ["src_url", "mark"])
    edges = cut_lineage(chosen.join(nodes.select(F.col("url").alias("dst_url")), "dst_url").select(
        "src_url", "dst_url", "position"))
    return nodes.drop("mark"), edges


def numbered_visits(level: DataFrame, counts: DataFrame) -> DataFrame:
    """``visit`` after ``counts`` (``start, n``) earlier ones of each walk, by parent and position.

    Rows are dealt by ranges; only how many rows of a walk each range holds is put together.
    """
    order = ["start", "parent", "position", "url"]
    dealt = cut_lineage(level.repartitionByRange(*order).sortWithinPartitions(*order)
                        .withColumn("range", F.spark_partition_id())
                        .withColumn("place", F.monotonically_increasing_id()))
    held = dealt.groupBy("start", "range").agg(F.count(F.lit(1)).alias("here"), F.min("place").alias("first"))
    before = Window.partitionBy("start").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.select("start", "range", "first", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    at = F.col("place") - F.col("first") + F.col("before") + F.coalesce("n", F.lit(0)) + 1
    return (dealt.join(offset, ["start", "range"]).join(counts, "start", "left")
            .select(*level.columns, at.cast("int").alias("visit")))


def walk_sites(graph: tuple[DataFrame, DataFrame], starts: DataFrame, max_pages: int | None = None,
               max_depth: int | None = None) -> DataFrame:
    """``start, visit, depth, url, title, characters``: breadth-first walks from each of ``starts``.

    A level is one message along every link that leaves the last one; of several, a page takes the
    one from the page visited first, then of the first link. Pages too short to read are neither
    counted nor followed. Without limits a walk ends where no new page is met.
    """
    nodes, edges = graph
    first = starts.select(F.col("url").alias("start"), without_fragment(F.col("url")).alias("url")).distinct()
    level = first.join(nodes.select("url"), "url").select(
        "start", "url", F.lit(0).alias("parent"), F.lit(0).alias("position"))
    counts = first.select("start", F.lit(0).cast("long").alias("n"))
    found, depth = None, 0
    while True:
        visits = numbered_visits(level, counts).withColumn("depth", F.lit(depth))
        if max_pages is not None:
            visits = visits.where(F.col("visit") <= max_pages)
        visits = cut_lineage(visits.select("start", "url", "visit", "depth"))
        found = visits if found is None else cut_lineage(found.unionByName(visits))
        if visits.isEmpty() or depth == max_depth:
            break
        counts = found.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
        sent = visits.join(edges, visits["url"] == edges["src_url"]).groupBy(
            "start", F.col("dst_url").alias("url")).agg(F.min(F.struct("visit", "position")).alias("at"))
        level = sent.join(found.select("start", "url"), ["start", "url"], "left_anti").select(
            "start", "url", F.col("at.visit").alias("parent"), F.col("at.position").alias("position"))
        depth += 1
    return found.join(nodes, "url").select("start", "visit", "depth", "url", "title", "characters")


def reachable_pages(pages: DataFrame, start_url: str, max_pages: int | None = MAX_SITE_PAGES,
                    max_depth: int | None = MAX_SITE_DEPTH, url: str = "url",
                    html: str = "html") -> DataFrame:
    """Stored pages of one site in the order a breadth-first walk meets them."""
    if not start_url.lower().startswith(("http://", "https://")):
        raise ValueError("The address must start with http:// or https://")
    mine = pages.where(site_of(F.col(url)) == site_of(F.lit(start_url)))
    start = pages.sparkSession.createDataFrame([(start_url,)], "url string")
    walked = walk_sites(page_graph(mine, url, html), start, None if max_pages is None else max(1, max_pages),
                        None if max_depth is None else max(0, max_depth))
    return walked.select("visit", "depth", "url", "title", "characters").orderBy("visit")
