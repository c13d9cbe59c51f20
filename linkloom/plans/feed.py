"""Inputs of the registered queries, derived from the driver's tables by plain arithmetic that Spark and DuckDB
share: a feed of links from lineitem, fetched pages from orders, and lines and documents for the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import merge
from linkloom.operators.build import build_links

#: A feed column and what it is, as SQL of both engines.
_SQL = {
    "id": "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000",
    "source_url": """concat(CASE l_linenumber % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'https' ELSE 'HTTP' END, '://',
        CASE l_suppkey % 4 WHEN 0 THEN 'www.' WHEN 1 THEN 'Blog.' WHEN 2 THEN 'a.b.' ELSE '' END, 'Site', CAST(l_suppkey % 40 AS STRING),
        CASE l_suppkey % 3 WHEN 0 THEN '.com' WHEN 1 THEN '.org' ELSE '.co.uk' END,
        CASE l_linenumber % 5 WHEN 0 THEN ':443' WHEN 1 THEN ':8080' WHEN 2 THEN ':80' ELSE '' END,
        '/p/', CAST(l_orderkey % 20 AS STRING), CASE l_linenumber % 4 WHEN 0 THEN '#top' WHEN 1 THEN '?ref=A' ELSE '' END)""",
    "target_url": """concat(CASE l_partkey % 2 WHEN 0 THEN 'https' ELSE 'http' END, '://', CASE l_partkey % 3 WHEN 0 THEN 'user@' ELSE '' END,
        CASE l_partkey % 5 WHEN 0 THEN 'Shop.' WHEN 1 THEN 'www.' ELSE '' END, 'target', CAST(l_partkey % 25 AS STRING),
        CASE l_partkey % 4 WHEN 0 THEN '.de' WHEN 1 THEN '.com' WHEN 2 THEN '.co.uk' ELSE '.net' END,
        CASE l_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/Docs/a_b' ELSE concat('/docs/', CAST(l_partkey % 6 AS STRING)) END)""",
    "anchor_text": "CASE l_linestatus WHEN 'O' THEN concat('Open É ', CAST(l_partkey % 7 AS STRING)) ELSE '' END",
    "image_alt": "CASE WHEN l_partkey % 3 = 0 THEN 'logo' ELSE '' END",
    "rel": "CASE l_returnflag WHEN 'A' THEN 'nofollow' WHEN 'N' THEN 'ugc, NoFollow' ELSE CASE l_linenumber % 2 WHEN 0 THEN 'noopener' ELSE '' END END",
    "source_title": "concat('Title ', CAST(l_orderkey % 20 AS STRING))",
    "collection": "CASE l_suppkey % 5 WHEN 0 THEN '' ELSE concat('crawl-', CAST(l_suppkey % 5 AS STRING)) END",
    "dataset_type": "CASE l_suppkey % 3 WHEN 0 THEN 'wat' WHEN 1 THEN 'warc' ELSE 'csv' END",
    "record_filename": "concat('part-', CAST(l_suppkey % 4 AS STRING))",
    "source_http_status": "CAST(CASE l_linenumber WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 301 END AS INT)",
    "content_type": "'text/html'",
    "seen_at": "concat(CAST(CAST(l_shipdate AS DATE) AS STRING), 'T00:00:00+00:00')",
    "status": "CASE l_partkey % 4 WHEN 0 THEN 'LIVE_CONFIRMED' WHEN 1 THEN 'REMOVED' ELSE 'ARCHIVED_ONLY' END",
    "live": "CAST(CASE l_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS INT)",
}

FEED_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _SQL.items()) + " FROM lineitem"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table; with columns, these of it, dealt over as many tasks as there are cores where it is a file of fewer: for
    queries that do much with each row."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not columns:
        return table
    wide, table = spark.sparkContext.defaultParallelism, table.select(*columns)
    return table if table.rdd.getNumPartitions() >= wide else table.repartition(wide)


def feed(spark: SparkSession, sf_dir: str, part: tuple[int, int] | None = None) -> DataFrame:
    """All links; or those whose id leaves this rest, by this number, in the order of their ids, into which the table's
    columns are put before texts are made of them."""
    known = read(spark, sf_dir, "lineitem").columns
    table = read(spark, sf_dir, "lineitem", *(c for c in known if c in " ".join(_SQL.values())))
    if part is not None:
        table = table.where(f"({_SQL['id']}) % {part[1]} = {part[0]}").orderBy(F.expr(_SQL["id"]))
    return table.selectExpr(*(f"{v} AS {k}" for k, v in _SQL.items()))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the index for the feed, with the feed's times, statuses and marks. Its hosts are ASCII."""
    out = build_links(feed(spark, sf_dir), "", arrival=F.col("id"), keep=("seen_at", "status", "live"))
    times = ("first_discovered_at", "last_seen_at", "created_at", "updated_at")
    out = out.withColumns(dict.fromkeys(times, F.col("seen_at")) | {"verification_status": F.col("status"), "live_backlink_present": F.col("live")})
    return out.drop("seen_at", "status", "live")


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """How many tasks fold the feed; its rows are counted from the files' footers."""
    return merge.tasks_for(spark, read(spark, sf_dir, "lineitem").count())


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(None, rows(spark, sf_dir), tasks(spark, sf_dir))
