"""Whether links still stand on their pages, decided from fetched pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from linkloom.functions import html, urls
from linkloom.operators.build import build_links, links_of_pages
from linkloom.operators.merge import dealt
from linkloom.operators.search import Target, matches_link


def decision(error: Column, status: Column, empty: Column, present: Column, had_archive: Column) -> Column:
    """The verification status: of a blocked page, of one that gave nothing, of one with the link, of one without."""
    gone = F.when(had_archive, "ARCHIVED_ONLY").otherwise("SOURCE_UNAVAILABLE")
    out = F.when(error == "blocked", "VERIFICATION_FAILED").when(error.isNotNull() | (status >= 400) | status.isNull() | empty, gone)
    return out.when(present, F.when(had_archive, "ARCHIVED_CONFIRMED").otherwise("LIVE_CONFIRMED")).otherwise("REMOVED")


def page_evidence(final_url: Column, status: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(final_url, F.lit("")), status.cast("string"), F.sha2(body, 256)), 256)


def verify(fetches: DataFrame, target: Target | Sequence[Target], had_archive: Column | None = None, checked_at: str = "") -> DataFrame:
    """A result for each fetch: status, whether a link to the target, or to one of several, is there (null if the page
    gave nothing), evidence."""
    targets = [target] if isinstance(target, Target) else list(target)
    had = F.lit(True) if had_archive is None else had_archive
    keep = fetches.columns
    rows = fetches.withColumns({"_base": F.coalesce("final_url", "url"), "_had": had})
    rows = html.parsed(rows, "body", [*keep, "_base", "_had"], base="_base")
    found = F.exists("anchors", lambda a: reduce(or_, (matches_link(a["resolved_url"], t, a["hostname"]) for t in targets), F.lit(False)))
    rows = rows.withColumn("_present", F.coalesce(found, F.lit(False)))  # columns of their own: computed once
    empty = F.coalesce(F.octet_length("body"), F.lit(0)) == 0
    rows = rows.withColumn("_verdict", decision(F.col("error"), F.col("status"), empty, F.col("_present"), F.col("_had")))
    present, status = F.col("_present"), F.col("_verdict")
    parsed = status.isin("ARCHIVED_CONFIRMED", "LIVE_CONFIRMED", "REMOVED")
    chain = F.to_json(F.coalesce("redirect_chain", F.array().cast("array<string>")))
    return rows.select(
        F.col("url").alias("source_url"), status.alias("verification_status"), F.col("status").alias("source_http_status"),
        F.coalesce("content_type", F.lit("")).alias("content_type"), F.when(parsed, present.cast("int")).alias("live_backlink_present"),
        F.when(F.col("error").isNull(), chain).otherwise("[]").alias("redirect_chain"),
        F.when(parsed, page_evidence(F.col("_base"), F.col("status"), F.col("body"))).otherwise("").alias("evidence_hash"),
        F.lit(checked_at).alias("last_checked_at"),
    )


def matching_links(fetches: DataFrame, target: Target | Sequence[Target] | DataFrame) -> DataFrame:
    """The links to a target, or to one of several, on fetched pages: a search of live pages, without an index. Of a table of
    targets (target, mode) each link comes with every one that it matches."""
    pages = fetches.where("error is null and status < 400")
    links = links_of_pages(pages.select(F.coalesce("final_url", "url").alias("url"), F.col("body").alias("html")))
    if isinstance(target, DataFrame):
        return links_to(links.withColumn("_host", urls.hostname(F.col("target_url"))), target, "target_url", "_host").drop("_host")
    targets = [target] if isinstance(target, Target) else list(target)
    return links.where(reduce(or_, (matches_link(F.col("target_url"), t) for t in targets), F.lit(False)))


def target_keys(targets: DataFrame) -> DataFrame:
    """(target, mode, kind, value, prefix) of a table of targets (target, mode): what of a link each asks for, a host, an url, a domain, or
    a domain and the beginning of a path."""
    schema = to_arrow_schema(T.StructType.fromDDL(TARGET_KEY))

    def key(raw: str, mode: str) -> tuple:
        t = Target(raw, mode)
        kind = {"exact_hostname": "host", "exact_url": "url", "path_prefix": "path"}.get(mode, "domain")
        return raw, mode, kind, {"host": t.hostname, "url": t.url}.get(kind, t.domain), t.prefix if kind == "path" else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [key(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return targets.select("target", "mode").where("target is not null and mode is not null").distinct().mapInArrow(run, TARGET_KEY)


TARGET_KEY = "target string, mode string, kind string, value string, prefix string"


def links_to(links: DataFrame, targets: DataFrame, url: str, host: str) -> DataFrame:
    """Links with each target (target, mode) that they match, as ``matches_link`` has it, for any number of targets: a link's host, url and
    domain are looked up by equality; so are, where its domain has targets with paths, the beginnings of its path that are as
    long as one of these. url and host name columns of the normalised url and its host."""
    keys, domain = target_keys(targets), urls.registrable_domain(F.col(host))
    links = links.where(F.col(host) != "")
    own = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("host", F.col(host)), ("url", F.col(url)), ("domain", domain)))))
    plain = links.withColumn("_k", own).withColumns({"_kind": F.col("_k.kind"), "_value": F.col("_k.value")}).drop("_k")
    wanted = keys.where("kind <> 'path'").select("target", "mode", F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    plain = plain.join(wanted, ["_kind", "_value"]).drop("_kind", "_value")
    paths = keys.where("kind = 'path'").select("target", "mode", F.col("value").alias("_value"), F.col("prefix").alias("_prefix"))
    lengths = paths.groupBy("_value").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    below = links.withColumns({"_value": domain, "_path": urls.path_of(F.col(url))}).join(lengths, "_value")
    below = below.withColumn("_n", F.explode("_lengths")).where(F.col("_n") <= F.length("_path"))
    below = below.withColumn("_prefix", F.substring("_path", F.lit(1), F.col("_n"))).join(paths, ["_value", "_prefix"])
    return plain.unionByName(below.drop("_value", "_prefix", "_path", "_lengths", "_n"))


def in_order(listed: DataFrame, results: DataFrame) -> DataFrame:
    """Results of verification by the place of their url in a list (place, url); an url that the list has twice comes twice, one without
    a result has nulls."""
    rows = listed.select("place", F.col("url").alias("source_url")).join(results, "source_url", "left")
    return rows.select("place", *results.columns).orderBy("place")


def source_list(lines: DataFrame) -> DataFrame:
    """Urls of a list, one a line: stripped, none blank."""
    return lines.select(urls.strip(F.col("value")).alias("url")).where("url <> ''")


def apply_verification(index: DataFrame, results: DataFrame, now: str, tasks: int | None = None) -> DataFrame:
    """The index with results (id and a result's columns, one row an id; ids that it lacks are left out): all replace what was there, but
    an empty hash. tasks: how many join and sort rows (``merge.tasks_for``)."""
    new = results.select("id", *(F.col(c).alias(f"_{c}") for c in results.columns if c != "id"), F.lit(True).alias("_new"))
    if tasks is not None:
        index, new = dealt(index, tasks, "id"), dealt(new, tasks, "id")
    rows = index.join(new, "id", "left")
    replaced = ("verification_status", "source_http_status", "content_type", "live_backlink_present", "redirect_chain", "last_checked_at")
    take = {c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in replaced}
    take["evidence_hash"] = F.when(F.coalesce("_evidence_hash", F.lit("")) != "", F.col("_evidence_hash")).otherwise(F.col("evidence_hash"))
    take["updated_at"] = F.when(F.col("_new"), F.lit(now)).otherwise(F.col("updated_at"))
    return rows.select(*(take.get(c, F.col(c)).alias(c) for c in index.columns))


def had_archive(dataset_type: Column) -> Column:
    return ~F.coalesce(dataset_type, F.lit("")).isin("", "live")


def crawl(links: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(url, level) of pages reached from seeds (url) within so many links of (source, target), nearest first. Each
    level is an anti join with all levels before, which stay as they were written; tables cut the lineage."""
    levels = [seeds.select("url").distinct().withColumn("level", F.lit(0)).checkpoint()]
    seen = levels[0]
    for level in range(1, depth + 1):
        edge = links.join(levels[-1], links.source == levels[-1].url).select(F.col("target").alias("url")).distinct()
        levels.append(edge.join(seen, "url", "left_anti").withColumn("level", F.lit(level)).checkpoint())
        if levels[-1].isEmpty():
            break
        seen = seen.unionByName(levels[-1])
    return seen if most is None else seen.orderBy("level", "url").limit(most)


def seed_crawl(fetches: DataFrame, as_of: str, domain: str | None = None, max_pages: int | None = None) -> DataFrame:
    """A feed of confirmed live links of fetched seed pages; only those to a registrable domain if one is given."""
    pages = fetches.where("error is null and status < 400")
    pages = pages if max_pages is None else pages.limit(max_pages)
    pages = pages.select(F.coalesce("final_url", "url").alias("url"), F.col("body").alias("html"), F.col("status").alias("source_http_status"), "content_type")
    feed = links_of_pages(pages, keep=("source_http_status", "content_type")).withColumn("dataset_type", F.lit("live"))
    rows = build_links(feed, as_of, "LIVE_CONFIRMED").withColumn("live_backlink_present", F.lit(1))
    return rows if domain is None else rows.where(F.col("normalized_target_domain") == Target(domain).domain)
