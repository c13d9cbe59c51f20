"""Ingestion: jobs over files of any kind, and Structured Streaming over folders of JSON lines.

A batch of files is one pass over their records (see ``sources.records``). Its links, what was refused, and how far each file was
read are committed by one manifest of the index. So a job that stops, at whatever record, goes on behind the last record whose links
the index has, and a batch that is repeated is left out: the index is the one of an uninterrupted run. A file that cannot be read
becomes an error of the job, and the others of its batch are read without it.

Of a stream, files become micro-batches of the index's upsert. Progress is Spark's own, the checkpoint folder says which files are
done; the number of the last merged batch is committed with its rows, so a batch that Spark repeats is not merged twice. Stopping
and pausing a job stop its query."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators.build import build_links
from linkloom.schema import INDEX
from linkloom.sources.files import expanded, kind_of, parse_jsonl
from linkloom.sources.records import parsed_lines, read_records
from linkloom.sources.stored import PROGRESS, StoredIndex
from linkloom.streaming.jobs import Jobs


#: What a batch's rows keep of their records: which file's, where in it, where the link is in the record, what is wrong.
_KEPT = ("_file", "place", "position", "error", "refused", "bytes")
#: Kinds of files that are read anew by each pass over their records, which costs less than to hold all of them on disk meanwhile.
_READ_ANEW = ("csv", "jsonl", "parquet")


def upsert_batches(index: StoredIndex, as_of: str | Callable[[], str], collection: str = "", job: tuple[Jobs, int] | None = None, stream: str = "stream"):
    """A foreachBatch function that merges each micro-batch of lines into the index, once."""
    number_of = job[1] if job else 0

    def merge(lines: DataFrame, number: int) -> None:
        done = index.progress(number_of).where(F.col("file") == stream).head()
        if done is not None and done["upto"] > number:
            return
        found = parsed_lines(lines.withColumn("place", F.monotonically_increasing_id()), collection).withColumn("_file", F.lit(0))
        stats, counts = _merge(index, found, as_of if isinstance(as_of, str) else as_of(), number_of, {0: stream}, {0: (0, number + 1, False)})
        if job:
            jobs, job_id = job
            jobs.bump(job_id, **counts)
            jobs.checkpoint(job_id, "batch", {"batch": number})
            if jobs.wants_stop(job_id):
                raise StopIngestion(f"job {job_id}")

    return merge


class StopIngestion(RuntimeError):
    """A job was told to pause or to stop; its batch is done and will be seen as such or be repeated."""


def ingest(
    spark: SparkSession, folder: str, index: StoredIndex, checkpoint: str, as_of: str | Callable[[], str], collection: str = "",
    max_files: int | None = None, job: tuple[Jobs, int] | None = None, follow: bool = False,
) -> StreamingQuery:
    """Ingests JSON-lines files of a folder, those that are there or, with ``follow``, also those to come."""
    stream = spark.readStream.format("text")
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    writer = stream.load(folder).writeStream.foreachBatch(upsert_batches(index, as_of, collection, job, checkpoint)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="10 seconds") if follow else writer.trigger(availableNow=True)).start()


def run_job(spark: SparkSession, jobs: Jobs, job_id: int, folder: str, index: StoredIndex, checkpoint: str, as_of: str | Callable[[], str], **options) -> str:
    """Runs an ingestion to its end under a job's row; returns the job's state then."""
    jobs.update(job_id, status="running")
    query = ingest(spark, folder, index, checkpoint, as_of, job=(jobs, job_id), **options)
    try:
        query.awaitTermination()
        state = "completed"
    except Exception as e:  # the query's own error
        told = jobs.wants_stop(job_id)
        state = told or "failed"
        if not told:
            jobs.record_error("ingest", str(e)[:500], job_id)
    jobs.update(job_id, status=state)
    return state


class BadFile(NamedTuple):
    path: str
    message: str


def _merge(
    index: StoredIndex, records: DataFrame, as_of: str, job_id: int, paths: dict[int, str], ends: dict[int, tuple[int, int | None, bool]],
    anew: bool = False,
) -> tuple[list[BadFile], dict[str, int]]:
    """Records of files, by ``_file``, as one batch of the index. ends: by file, where it began, where it ends if that is known before, and
    whether it is then read as a whole (None: if fewer records than asked for were there). anew: records are read by each pass: one that
    counts them, without their urls, one that writes their links, and one for what is refused, if anything is; else they are kept
    meanwhile. Returns files that are none, and counts."""
    rows, refused = build_links(records, as_of, keep=_KEPT, reason="_reason"), Observation()
    rows = rows if anew else rows.persist()
    try:
        first = F.coalesce("position", F.lit(0)) == 0  # each record has one such row
        bad, malformed = F.col("place").isNull(), F.col("place").isNotNull() & F.col("error").isNotNull()
        links = F.col("error").isNull() & F.col("refused").isNull() & F.col("_reason").isNull()
        seen = rows.groupBy("_file").agg(
            F.max(F.when(bad, F.col("error"))).alias("bad"), F.count_if(first & ~bad).alias("records"), F.count_if(first & malformed).alias("malformed"),
            F.count("*").alias("rows"), F.max("place").alias("last"), F.max("position").alias("most"), F.sum(F.when(first, F.col("bytes"))).alias("bytes"),
            F.count_if(first & F.col("bytes").isNotNull()).alias("pages"),
        ).collect()  # one row a file of the batch
        places, positions = (1 + max((r[c] or 0 for r in seen), default=0) for c in ("last", "most"))
        number = (F.col("_file") * F.lit(places) + F.col("place")) * F.lit(positions) + F.coalesce("position", F.lit(0))
        record = F.coalesce(F.col("error"), F.col("refused"), F.col("_reason"))
        wrong = record.isNotNull() & (F.col("error").isNotNull() | F.col("refused").isNotNull() | (F.col("target_url") != ""))
        batch = rows.observe(refused, F.count_if(wrong).alias("n")).where(links).withColumn("id", number.cast("long")).select(*INDEX.names)
        by = {r["_file"]: r for r in seen}
        done = []
        for k, path in paths.items():
            start, end, whole = ends[k]
            r = by.get(k)
            upto = end if end is not None else 1 + r["last"] if r and r["last"] is not None else start
            done.append((job_id, path, r["records"] if r else 0, upto, bool(whole) or bool(r and r["bad"])))
        name = F.coalesce(*(F.when(F.col("_file") == k, F.lit(p)) for k, p in paths.items()))
        context = F.when(bad, "import").when(malformed, "record").otherwise("link")
        detail = F.concat_ws(" -> ", "source_url", "target_url")
        rejected = rows.where(wrong).select(F.lit(job_id).cast("long").alias("job"), name.alias("file"), F.col("place").alias("record"), context.alias("context"), record.alias("message"), detail.alias("detail"))
        progress = rows.sparkSession.createDataFrame(done, PROGRESS).coalesce(1)

        def some(written: int) -> DataFrame | None:
            known = any(r["malformed"] or r["bad"] for r in seen)
            return rejected if known or (refused.get["n"] if written else not rejected.isEmpty()) else None

        counts = index.upsert(batch, progress, some, placed=True, size=sum(r["rows"] for r in seen))
    finally:
        rows.unpersist()
    total = lambda c: sum(r[c] or 0 for r in seen)
    counts |= {"records_read": total("records"), "malformed_records": total("malformed"), "links": counts["inserted"] + counts["duplicates"], "pages": total("pages"), "bytes_downloaded": total("bytes")}
    return [BadFile(paths[r["_file"]], r["bad"]) for r in seen if r["bad"]], counts


def _merge_files(
    spark: SparkSession, index: StoredIndex, paths: list[str], as_of: str, collection: str, job_id: int, begun: dict[str, int], most: int | None
) -> tuple[list[BadFile], dict[str, int]]:
    """Files as one batch, each from its place on. ``most`` bounds the records, of one file then."""
    found, ends = [], {}
    for k, path in enumerate(paths):
        found.append(read_records(spark, path, collection, begun.get(path, 0), most).withColumn("_file", F.lit(k)))
        ends[k] = (begun.get(path, 0), None, most is None)
    anew = all(kind_of(p) in _READ_ANEW for p in paths)
    return _merge(index, reduce(DataFrame.unionByName, found), as_of, job_id, dict(enumerate(paths)), ends, anew)


def run_files(
    spark: SparkSession, jobs: Jobs, job_id: int, paths: list[str], index: StoredIndex, as_of: str, collection: str = "user-import",
    max_files: int | None = None, max_records: int | None = None, at_once: int = 20,
) -> str:
    """Ingests files and folders of link datasets and archives under a job's row, from where the index says that the job is; returns
    its state then. With ``max_records`` files are read one by one, in order, and no more records than that in all; a later run
    without it, or with a larger one, goes on behind the last of them."""
    files = expanded(spark, paths)[:max_files]
    jobs.update(job_id, status="running")
    known = {r["file"]: r for r in index.progress(job_id).collect()}  # no more than the files that the driver has listed
    records = sum(r["records"] for r in known.values())
    begun = {f: r["upto"] for f, r in known.items()}
    done = {f for f, r in known.items() if r["whole"]}
    todo = [f for f in files if f not in done]
    while todo and (max_records is None or records < max_records):
        if state := jobs.wants_stop(job_id):
            jobs.update(job_id, status=state)
            return state
        group, todo = (todo[:1], todo[1:]) if max_records else (todo[:at_once], todo[at_once:])
        left = None if max_records is None else max_records - records
        read = lambda some, left=left: _merge_files(spark, index, some, as_of, collection, job_id, begun, left)
        try:
            parts = [read(group)]
        except Exception:  # one of them: each alone
            parts = []
            for path in group:
                try:
                    parts.append(read([path]))
                except Exception as e:
                    parts.append(([BadFile(path, str(e)[:500])], {}))
                    index.commit_progress(job_id, path)
        bad = [b for found, _ in parts for b in found]
        for path, message in bad:
            jobs.record_error("import", message, job_id, path)
        total = {k: sum(c.get(k, 0) for _, c in parts) for k in set().union(*(c for _, c in parts))}
        records += total.get("records_read", 0)
        ended = group if left is None or total.get("records_read", 0) < left else []
        if left is not None and ended and not bad:
            index.commit_progress(job_id, group[0])  # fewer than asked for: that was all
        done.update(ended, (b.path for b in bad))
        jobs.bump(job_id, files=len(group), errors=len(bad), **total)
        jobs.checkpoint(job_id, "files", {"files": len(done), "records": records})
        index.maintain()
    jobs.update(job_id, status="completed")
    return "completed"


def domain_counts(lines: DataFrame, as_of: str) -> DataFrame:
    """A stream's running count of links by target domain: a keyed aggregation, no window."""
    rows = build_links(parse_jsonl(lines), as_of)
    return rows.groupBy("normalized_target_domain").agg(F.count("*").alias("links"), F.max("last_seen_at").alias("last_seen_at"))


def wait(query: StreamingQuery, seconds: float) -> bool:
    until = time.time() + seconds
    while query.isActive and time.time() < until:
        time.sleep(0.2)
    return not query.isActive
