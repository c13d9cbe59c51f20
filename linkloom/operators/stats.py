"""Counts of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def total(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("n"))


def is_empty(index: DataFrame) -> bool:
    return index.isEmpty()


def index_stats(index: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, and how many different source pages, source domains and target domains they have."""
    names = {"source_pages": "normalized_source_url", "source_domains": "source_domain", "target_domains": "normalized_target_domain"}
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return index.agg(F.count("*").alias("backlinks"), *(distinct(c).alias(n) for n, c in names.items()))


def overview(index: DataFrame, jobs, spark: SparkSession) -> dict[str, int]:
    """The index's counts with those of the tables beside it (streaming.jobs.Jobs)."""
    beside = {"errors": len(jobs.errors(limit=None)), "checkpoints": jobs.frame(spark, "checkpoints").count(), "active_jobs": len(jobs.list(active_only=True, limit=None))}
    return index_stats(index).head().asDict() | beside


def collection_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("collection").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "collection")


def collections(index: DataFrame) -> DataFrame:
    return index.where("collection <> ''").select("collection").distinct().orderBy("collection")


def top_source_domains(index: DataFrame, limit: int = 500) -> DataFrame:
    """The most frequent source domains; a blank one takes a place among them and is then left out."""
    counts = index.groupBy("source_domain").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "source_domain").limit(limit).where("source_domain <> ''")


def live_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("live_backlink_present") == 1).alias("live"), F.count("*").alias("total"))
