"""Listings of a crawl, from files: its collections, its archives, its index of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators.search import Target
from linkloom.schema import CDX

COLLECTION = "id string, name string, `cdx-api` string, timegate string"


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(COLLECTION).option("multiLine", True).json(path)
    return rows.select("id", "name", F.col("`cdx-api`").alias("cdx_api"), "timegate").where("id is not null")


def read_paths(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A listing of archives, one path a line, plain or gzip; the first ones if a number is given."""
    rows = spark.read.text(path).select(urls.strip(F.col("value")).alias("path")).where("path <> ''")
    return rows if max_files is None else rows.limit(max_files)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """An index of captures, one JSON object a line; lines without a number for offset or length are skipped."""
    text = ", ".join(f"`{f.name}` string" for f in CDX)
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\{")).select(F.from_json("value", text).alias("o")).select("o.*")
    rows = rows.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in CDX))
    return rows.where("offset is not null and length is not null")


def query_captures(captures: DataFrame, pattern: str, match_type: str = "domain", limit: int | None = 1000, filters: tuple[str, ...] = ()) -> DataFrame:
    """Captures of a url, a prefix, a host or a domain; filters are ``field:value``, ``!field:value`` or ``~field:regex``."""
    host = urls.hostname(F.col("url"))
    wanted = Target(pattern).hostname
    if match_type == "exact":
        rows = captures.where(F.col("url") == pattern)
    elif match_type == "prefix":
        rows = captures.where(F.col("url").startswith(pattern))
    else:
        rows = captures.where((host == wanted) | (host.endswith(f".{wanted}") if match_type == "domain" else F.lit(False)))
    for f in filters:
        name, _, value = f.lstrip("!~=").partition(":")
        test = F.col(name).rlike(value) if f.startswith("~") else F.col(name) == value
        rows = rows.where(~test if f.startswith("!") else test)
    return rows if limit is None else rows.limit(limit)


def usable_captures(captures: DataFrame, max_records: int | None = None) -> DataFrame:
    """Captures of status 200; others do not count against the number."""
    rows = captures.where("status = '200'")
    return rows if max_records is None else rows.limit(max_records)
