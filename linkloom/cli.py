"""python -m linkloom.cli: build, watch and search a link index from the command line."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from linkloom.operators import merge, stats, verify
from linkloom.operators.search import FILTERS, SORTABLE, VIEWS, Search, Target, total_pages
from linkloom.schema import MATCH_MODES
from linkloom.sources.sinks import EXPORTS, export
from linkloom.sources.stored import StoredIndex
from linkloom.streaming import ingest
from linkloom.streaming.jobs import Jobs, now


def pages(index: DataFrame, search: Search, first: int, size: int, number: int | None) -> Iterator[tuple[int, int, list]]:
    """(page, of how many, rows): so many pages from the first on, or all that follow."""
    last = total_pages(search.count(index).head()[0], size)
    stop = last if number is None else min(last, first + number - 1)
    rows = search.page(index, first, size).collect()
    for page in range(first, stop + 1):
        yield page, last, rows
        if page < stop:
            rows = search.after(index, (rows[-1][search.order_by], rows[-1]["id"]), size).collect()


def _search_of(args: argparse.Namespace) -> Search:
    options: dict[str, object] = {}
    for text in args.where:
        name, _, value = text.partition("=")
        if name == "link_types":
            options[name] = value.split(",")
        elif name in ("live_only", "exclude_blank_anchor", *VIEWS):
            options[name] = value.lower() in ("", "1", "true", "yes")
        else:
            options[name] = int(value) if name == "source_http_status" else value
    return Search(args.target, args.mode, sort_by=args.sort, descending=not args.ascending, **options)


def build(spark: SparkSession, args: argparse.Namespace) -> int:
    jobs = Jobs(args.jobs)
    job = args.job or jobs.create("files", {"paths": args.paths, "collection": args.collection})
    state = ingest.run_files(
        spark, jobs, job, args.paths, StoredIndex(spark, args.index), now(), args.collection, args.max_files, args.max_records
    )
    print(json.dumps({"job": job, "state": state, "stats": jobs.get(job)["stats"]}))
    return int(state == "failed")


def status(spark: SparkSession, args: argparse.Namespace) -> int:
    jobs, rows = Jobs(args.jobs), StoredIndex(spark, args.index).read()
    print(json.dumps({} if rows is None else stats.overview(rows, jobs, spark)))
    for job in jobs.list():
        print(json.dumps({k: job[k] for k in ("id", "job_type", "status", "stats")}))
    for error in jobs.errors(20):
        print(json.dumps(error))
    return 0


def control(spark: SparkSession | None, args: argparse.Namespace) -> int:
    """Pause and stop reach a job between two of its groups of files; a resumed job goes on with ``build --job``."""
    jobs = Jobs(args.jobs)
    if jobs.get(args.job) is None:
        print(f"no job {args.job}", file=sys.stderr)
        return 1
    flags = {"pause": {"pause": True}, "resume": {"pause": False, "cancel": False}, "stop": {"cancel": True}}
    jobs.control(args.job, **flags[args.command])
    return 0


def search(spark: SparkSession, args: argparse.Namespace) -> int:
    wanted, index = _search_of(args), StoredIndex(spark, args.index)
    rows = index.read(wanted.target.domain if wanted.target and args.mode in ("root_domain", "path_prefix") else None)
    if rows is None:
        print("the index is empty", file=sys.stderr)
        return 1
    if args.export:
        print(export(args.export, rows, wanted, args.to))
        return 0
    found = 0
    for page, last, part in pages(rows, wanted, args.page, args.size, args.pages):
        print(f"page {page} of {last}")
        for r in part:
            print("\t".join(str(r[c] or "") for c in ("source_url", "target_url", "anchor_text", "link_type", "verification_status", "last_seen_at")))
        found += len(part)
    Jobs(args.jobs).add_history(args.target, args.mode, found)
    return 0


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    """Verdicts on fetched pages, as JSON lines."""
    targets = [Target(t, args.mode) for t in args.targets]
    results = verify.verify(spark.read.parquet(args.fetches), targets, checked_at=now())
    for line in results.toJSON().toLocalIterator():
        print(line)
    return 0


def selftest(spark: SparkSession, args: argparse.Namespace) -> int:
    """A small index is built, searched and checked in a temporary folder."""
    with tempfile.TemporaryDirectory() as folder:
        with open(f"{folder}/a.csv", "w", encoding="utf-8") as f:
            f.write("source_url,target_url\nhttp://a.org/,http://www.b.com:80/x\nhttp://a.org/,http://www.b.com/x#y\nhttp://c.org/,http://notb.com/\n")
        jobs, index = Jobs(f"{folder}/jobs"), StoredIndex(spark, f"{folder}/index", buckets=4)
        state = ingest.run_files(spark, jobs, jobs.create("files", {}), [f"{folder}/a.csv"], index, now())
        found = [r["source_url"] for r in index.search(Search("b.com")).collect()]
        sound = tuple(merge.integrity(index.read()).head()) == (0, 0, 0)
        good = state == "completed" and found == ["http://a.org/"] and sound and index.read().count() == 2
    print("sound" if good else "not sound")
    return int(not good)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="linkloom", description=__doc__)
    out.add_argument("--index", default="linkloom-index", help="folder of the stored index")
    out.add_argument("--jobs", default="linkloom-jobs", help="the driver's folder of jobs, errors and searches")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, text: str, spark: bool = True) -> argparse.ArgumentParser:
        added = commands.add_parser(name, help=text)
        added.set_defaults(run=run, spark=spark)
        return added

    p = command("build", build, "read files and folders into the index, or go on with a job")
    p.add_argument("paths", nargs="+")
    p.add_argument("--collection", default="user-import")
    p.add_argument("--max-files", type=int)
    p.add_argument("--max-records", type=int)
    p.add_argument("--job", type=int, help="the job to go on with")
    command("status", status, "counts of the index, jobs, last errors")
    for name in ("pause", "resume", "stop"):
        command(name, control, f"{name} a job", spark=False).add_argument("job", type=int)
    p = command("search", search, "who links to a target")
    p.add_argument("target", nargs="?", default="")
    p.add_argument("--mode", choices=MATCH_MODES, default="root_domain")
    p.add_argument("--where", action="append", default=[], metavar="NAME=VALUE", help=", ".join((*FILTERS, *VIEWS)))
    p.add_argument("--sort", choices=SORTABLE, default="last_seen_at")
    p.add_argument("--ascending", action="store_true")
    p.add_argument("--page", type=int, default=1)
    p.add_argument("--pages", type=int, help="how many pages; all that follow if not given")
    p.add_argument("--size", type=int, default=50)
    p.add_argument("--export", choices=tuple(EXPORTS))
    p.add_argument("--to", default="linkloom-export")
    p = command("verify", check, "whether fetched pages still have links to targets")
    p.add_argument("fetches", help="Parquet files of fetched pages")
    p.add_argument("targets", nargs="+")
    p.add_argument("--mode", choices=MATCH_MODES, default="root_domain")
    command("selftest", selftest, "build and search a small index")
    return out


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(words)
    if args.spark and spark is None:
        spark = SparkSession.builder.appName("linkloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
