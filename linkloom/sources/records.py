"""Records of link datasets and archives, each with its place in its file and, if it is no good, with the reason.

Rows are links; a record without links is one row too. A record that is no good has an ``error``, a link that leads nowhere a
``refused``. So one pass over files gives the links, what was refused, and how far it went, and what a record is worth is
decided by the executors; the driver only lists files.

``place`` grows along a file. With ``exact`` it is the record's number, from 0, which costs datasets a count of their blocks
before; otherwise it is any number that grows, such as a byte's, and a file is split freely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import html, urls
from linkloom.operators.build import html_responses
from linkloom.schema import RECORD
from linkloom.sources import files, warc

#: The numbers that ``monotonically_increasing_id`` gives in one partition.
_OWN = (1 << 33) - 1


def _shaped(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows as records: columns of these names that there are, or what is given for them, or null."""
    value = lambda f: columns[f.name] if f.name in columns else F.col(f.name) if f.name in rows.columns else F.lit(None)
    return rows.select(*(value(f).cast(f.dataType).alias(f.name) for f in RECORD))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows of a file scan with where they came from."""
    return rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_own"))


def _placed(rows: DataFrame, exact: bool) -> DataFrame:
    """Marked rows with their place. A block that starts later in a file comes later, and its rows follow each other in one
    task; a task's rows are no more than the bytes before its next block, so a block's start and a row's number in its task
    add up to a number that grows."""
    if not exact:
        return rows.withColumn("place", F.col("_block") + F.col("_own").bitwiseAND(F.lit(_OWN))).drop("_path", "_block", "_own")
    blocks = rows.groupBy("_path", "_block").agg(F.min("_own").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # a row a block is few rows: sent around, so that the file's rows stay where they are read
    rows = rows.join(F.broadcast(blocks), ["_path", "_block"]).withColumn("place", F.col("_before") + F.col("_own") - F.col("_first"))
    return rows.drop("_path", "_block", "_own", "_first", "_before")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(place, url) of a list of urls, one a line: stripped, none blank, with the numbers of their lines."""
    lines = _placed(_marked(spark.read.text(path)), True)
    return lines.select("place", urls.strip(F.col("value")).alias("url")).where("url <> ''")


def _dataset(feed: DataFrame) -> DataFrame:
    """Records of a feed with a place and perhaps an error: each is one link."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    error = F.when((text("source_url") == "") | (text("target_url") == ""), "no source_url or no target_url")
    return _shaped(feed, position=F.lit(0), error=F.coalesce("_error", error) if "_error" in feed.columns else error)


def parsed_lines(rows: DataFrame, collection: str, kind: str = "jsonl") -> DataFrame:
    """Records of lines of JSON (value, place); blank lines are none. ``_none`` says why a file has no lines."""
    schema = T.StructType([*files.JSON, T.StructField("_broken", T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    none = F.col("_none") if "_none" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("_none", none).where((urls.strip(F.coalesce("value", F.lit(""))) != "") | F.col("_none").isNotNull()).withColumn("o", parsed)
    broken = ~F.col("value").rlike(r"^\s*\{") | F.col("o").isNull() | F.col("o._broken").isNotNull()
    error = F.coalesce("_none", F.when(broken, "no JSON object"))
    return _dataset(files.objects(rows.withColumn("_error", error), collection, kind, "place", "_error"))


def _table(spark: SparkSession, path: str, kind: str, collection: str, exact: bool) -> DataFrame:
    if kind == "csv":
        return _dataset(files.feed_of(_placed(_marked(files.scan_csv(spark, path)), exact), collection, "csv", "place"))
    if kind == "parquet":
        rows = spark.read.parquet(path)
        rows = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.lit(0).cast("long").alias("_block"), F.col("_metadata.row_index").alias("_own"))
        return _dataset(files.feed_of(_placed(rows, True), collection, "parquet", "place", filled=True))
    if kind == "jsonl":
        return parsed_lines(_placed(_marked(spark.read.text(path)), exact), collection, "jsonl")
    whole = spark.read.text(path, wholetext=True)
    items = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", T.ArrayType(T.StringType())))
    rows = whole.withColumn("items", items).withColumn("_none", F.when(F.col("items").isNull(), "no JSON array")).drop("value")
    return parsed_lines(rows.select("_none", F.posexplode_outer("items").alias("place", "value")), collection, "jsonl")


def archived_records(rows: DataFrame, kind: str, collection: str = "") -> DataFrame:
    """Records of an archive's rows (``warc.scan`` or ``warc.scan_ranges``), damage among them; of responses the HTML pages with an
    address have links."""
    origin = {"collection": F.lit(collection), "dataset_type": F.lit(kind)}
    keep = ["place", "bytes", "error", *(c for c in ("record_offset", "record_length") if c in rows.columns)]
    rows = rows.withColumns({"place": F.col("position"), "bytes": F.length("payload").cast("long")}).drop("position")
    if kind == "wat":
        pages = warc.wat_pages(rows.withColumn("json", warc.text_of(F.col("payload"))), *(c for c in keep if c != "error"), whole=True)
        links = pages.select("*", F.posexplode_outer("links").alias("position", "link")).select("*", "link.*")
        links = urls.with_resolved(links, "source_url", "url", "target_url")
        lost = F.col("target_url").isNull() & F.col("link").isNotNull() & ~urls.is_ignored(F.col("url"))
        named = {"refused": F.when(lost, F.concat(F.lit("no address: "), "url")), "source_title": F.col("title"), "anchor_text": F.col("text"), "image_alt": F.col("alt")}
        return _shaped(links, record_filename=F.col("filename"), **named, **origin)
    pages = html_responses(rows, *keep, whole=True)
    found = html.parsed(pages, "html", [*keep, "url", "source_http_status", "content_type", "record_filename"], base="url")
    found = found.select("*", F.posexplode_outer(F.filter("anchors", lambda a: a["hostname"] != "")).alias("position", "a")).drop("anchors")
    lost = F.col("a").isNotNull() & F.col("a.resolved_url").isNull()
    named = {"anchor_text": F.col("a.anchor_text"), "image_alt": F.col("a.image_alt"), "rel": F.col("a.rel"), "target_url": F.col("a.resolved_url")}
    refused = F.when(lost, F.concat(F.lit("no address: "), "a.href"))
    return _shaped(found, refused=refused, source_url=F.col("url"), source_title=F.col("title"), **named, **origin)


def read_records(spark: SparkSession, path: str, collection: str = "", first: int = 0, count: int | None = None) -> DataFrame:
    """Records of a file, by its ending: all, or so many from a place on. Places of datasets are then exact."""
    kind = files.kind_of(path)
    if kind in ("warc", "wat"):
        rows = warc.scan(spark, warc.list_files(spark, path) or [path], "response" if kind == "warc" else "metadata", first=first, count=count)
        return archived_records(rows, kind, collection)
    several = kind != "json" and len(warc.list_files(spark, path)) > 1  # a folder of parts
    rows = _table(spark, path, kind, collection, several or first > 0 or count is not None)
    rows = rows if not first else rows.where(F.col("place").isNull() | (F.col("place") >= first))
    return rows if count is None else rows.where(F.col("place").isNull() | (F.col("place") < first + count))
