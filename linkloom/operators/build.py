"""From a feed of links to rows of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import html, urls
from linkloom.functions.links import classify_rel, evidence_hash
from linkloom.schema import FEED, INDEX


def conform(feed: DataFrame, *more: str) -> DataFrame:
    """The feed with all its columns, names in any case and missing ones null, and some more of its own."""
    have = {c.lower(): c for c in feed.columns}
    return feed.select(*more, *(F.col(f"`{have[f.name]}`").cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in FEED))


def build_links(
    feed: DataFrame, as_of: str | Column, status: str = "ARCHIVED_ONLY", arrival: Column | None = None, keep: tuple[str, ...] = (), reason: str = ""
) -> DataFrame:
    """Rows of the index for a feed; links without a page, a target or a host are dropped, as are urls with an
    impossible port. ``arrival`` orders rows and becomes their id (null: none yet);
    ``keep`` names columns of the feed to carry along. With ``reason`` nothing is dropped: a column of that name says why a link is
    none, and is null for the others."""
    now = F.lit(as_of) if isinstance(as_of, str) else as_of
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = (F.lit(None) if arrival is None else arrival).cast("long").alias("id")
    feed = conform(feed.withColumn("_arrival", number), "_arrival", *keep).withColumnRenamed("_arrival", "id")
    whole = (text("source_url") != "") & (text("target_url") != "")
    feed = feed if reason else feed.where(whole)
    names = {"source_url": ("normalized_source_url", "source_hostname"), "target_url": ("normalized_target_url", "normalized_target_hostname")}
    feed = urls.with_normalized(feed, names)
    good = F.expr("normalized_source_url is not null and normalized_target_url is not null and source_hostname <> '' and normalized_target_hostname <> ''")
    # a filter would be pushed below the urls' expressions and compute them again; a generator is not
    if reason:
        port = F.expr("normalized_source_url is null or normalized_target_url is null")
        feed = feed.withColumn(reason, F.when(~whole, "no source_url or no target_url").when(port, "an impossible port").when(~good, "no host"))
        keep = (*keep, reason)
    else:
        feed = feed.select("*", F.explode(F.when(good, F.array(F.lit(1)))).alias("_kept")).drop("_kept")
    made = {
        "normalized_target_domain": urls.registrable_domain(F.col("normalized_target_hostname")),
        "source_domain": urls.registrable_domain(F.col("source_hostname")),
        "target_hostname": F.col("normalized_target_hostname"),
        "rel_original": text("rel"),
        "link_type": F.when(text("rel") == "", "UNKNOWN").otherwise(classify_rel(F.col("rel"))),
        "verification_status": F.lit(status), "live_backlink_present": F.lit(None), "last_checked_at": F.lit(None),
        "first_discovered_at": now, "last_seen_at": now, "created_at": now, "updated_at": now, "redirect_chain": F.lit(""),
        "evidence_hash": evidence_hash(F.col("normalized_source_url"), F.col("normalized_target_url"), F.col("collection"), F.col("record_filename")),
    }
    plain = {f.name: text(f.name) for f in INDEX if f.dataType.simpleString() == "string" and f.name in FEED.names}
    return feed.select(*keep, *(made.get(f.name, plain.get(f.name, F.col(f.name) if f.name in feed.columns else F.lit(None))).cast(f.dataType).alias(f.name) for f in INDEX))


def links_of_pages(pages: DataFrame, url: str = "url", body: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """A feed from pages: one row for each link, with the page's title."""
    found = html.page_links(pages, url, body, keep)
    return found.select(
        *keep, "position", F.col(url).alias("source_url"), F.col("resolved_url").alias("target_url"), "anchor_text",
        "image_alt", "rel", F.col("title").alias("source_title"),
    )


def links_of_responses(records: DataFrame, filename: str = "") -> DataFrame:
    """A feed from archived responses (see sources.warc): those of HTML pages with an address."""
    keep = ("source_http_status", "content_type", "record_filename")
    named = records if "filename" in records.columns else records.withColumn("filename", F.lit(filename))
    return links_of_pages(html_responses(named), keep=keep).withColumn("dataset_type", F.lit("warc"))


def html_responses(records: DataFrame, *keep: str, whole: bool = False) -> DataFrame:
    """Pages (url, html) among archived records: responses of HTML with an address. With ``whole`` other records stay too, without
    html."""
    kind = F.coalesce(F.nullif(F.coalesce(F.col("http_headers")["content-type"], F.lit("")), F.lit("")), F.col("content_type"))
    page = F.expr("record_type = 'response' and target_uri <> ''") & F.contains(F.lower(kind), F.lit("html"))
    pages = records if whole else records.where(page)
    return pages.select(
        *keep, F.col("target_uri").alias("url"), F.when(page, F.col("payload")).alias("html"), F.col("http_status").alias("source_http_status"),
        kind.alias("content_type"), F.col("filename").alias("record_filename"),
    )


def links_of_wat(pages: DataFrame) -> DataFrame:
    """A feed from pages of a metadata archive (source_url, title, links, filename): urls are resolved."""
    rows = pages.select(F.col("source_url"), F.col("title").alias("source_title"), F.col("filename").alias("record_filename"), F.inline("links"))
    rows = urls.with_resolved(rows, "source_url", "url", "target_url").where("target_url is not null")
    return rows.select(
        "source_url", "target_url", F.col("text").alias("anchor_text"), F.col("alt").alias("image_alt"), "rel", "source_title",
        "record_filename", F.lit("wat").alias("dataset_type"),
    )
