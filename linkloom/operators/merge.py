"""The keyed upsert of the index, as one ordered fold by key, and its other changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.links import evidence_hash
from linkloom.functions.urls import registrable_domain
from linkloom.schema import INDEX, KEY, VERSION

#: What a later row of the same key replaces: always, where it is not null, where it is not empty.
REPLACED = ("last_seen_at", "verification_status", "live_backlink_present", "updated_at")
IF_KNOWN = ("source_http_status", "last_checked_at")
IF_FILLED = ("redirect_chain", "evidence_hash")
#: Rows that a task behind a shuffle sorts, so long as there are fewer than ``TASKS`` such tasks. To so many Spark writes rows as they
#: come; for more of them tasks before the shuffle gather theirs in memory, and spill what is too much.
TASK_ROWS, TASKS = 200_000, 200
#: What goes last through the shuffle: the lengths of these differ most, and places in a row that are the same in the next one, as are
#: those of all columns before them, take next to nothing when compressed.
VARIED = (
    "anchor_text", "image_alt", "source_title", "normalized_source_url", "source_url", "source_hostname", "normalized_target_url", "target_url",
    "normalized_target_hostname",
)


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks that sort so many rows in memory; None where the session's own number of partitions does."""
    own, wanted = int(spark.conf.get("spark.sql.shuffle.partitions")), min(TASKS, -(-rows // TASK_ROWS))
    return wanted if wanted > (own if own <= TASKS else spark.sparkContext.defaultParallelism) else None


def dealt(rows: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    return rows.repartition(*by) if tasks is None else rows.repartition(tasks, *by)


def _place(url: str) -> Column:
    """What stands in a url where hosts do, up to a colon: the host, but of numbered ones of many parts."""
    return F.substring_index(F.substring_index(F.substring_index(url, "/", 3), "/", -1), ":", 1)


def fold(
    rows: DataFrame, order: Column, placed: bool = False, near: dict[str, Column] | None = None, tasks: int | None = None, apart: bool = False
) -> DataFrame:
    """One row for each key: the first one's columns, but for those that later rows replace. Every part is a
    minimum or maximum; rows of one key and one order are told apart by all their columns. Rows go through the one shuffle as they
    are, each column once, and are put in order and folded behind it: tasks that folded before would sort whole rows, which few of them
    share a key with, and spill. order: by columns of the index that do not follow from others. placed: the hosts, domains and evidence of all rows are those that ``build_links`` gave their urls,
    so rows are grouped by hosts too, filters and counts of hosts and domains pass below the fold, and domains and the evidence,
    that of the last row, are reckoned behind the fold and not shuffled. near: values by name that follow from the key; rows with the
    same ones come out in one task, so that who writes them by these needs no second shuffle; of placed ones only hosts that their urls
    do not show are shuffled then. tasks: how many fold (``tasks_for``). apart: orders of a key's rows all differ, and each column is folded
    by itself, so that those which nobody asks for are not shuffled."""
    hosts = ("normalized_target_hostname", "source_hostname") if placed else ()
    by = (*KEY, *hosts)
    own = {} if not placed else {
        "target_hostname": F.col("normalized_target_hostname"), "normalized_target_domain": registrable_domain(F.col("normalized_target_hostname")),
        "source_domain": registrable_domain(F.col("source_hostname")),
    }
    later = ("evidence_hash",) if placed else ()
    first = [f.name for f in INDEX if f.name not in ("id", *by, *own, *REPLACED, *IF_KNOWN, *IF_FILLED)]
    names = [f.name for f in INDEX if f.name not in (*own, *later)]
    rows = rows.select(*(c for c in names if c not in VARIED), *VARIED, *(v.alias(c) for c, v in (near or {}).items()))
    shown = {h: _place(u) for h, u in zip(hosts, ("normalized_target_url", "normalized_source_url"), strict=False)} if near else {}
    rows = dealt(rows.withColumns({h: F.nullif(F.col(h), p) for h, p in shown.items()}), tasks, *(near or KEY))
    rows = rows.withColumns({h: F.coalesce(F.col(h), p) for h, p in shown.items()})
    rows = rows.select(*names, *(near or {}), (order if apart else F.struct(order.alias("_o"), F.xxhash64(*names).alias("_h"))).alias("_order"))
    last = lambda c: F.max_by(c, "_order").alias(c)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c)
    filled = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c) != "", F.col("_order"))), F.lit("")).alias(c)
    found = [F.max_by(F.struct("collection", "record_filename"), "_order").alias("e")] if placed else []
    # a number first: rows are sorted by it, and by the long urls behind it only where it is the same
    out = rows.groupBy(*(near or {}), F.xxhash64(*KEY).alias("_key"), *by).agg(
        F.min_by("id", "_order").alias("id"), *(F.min_by(c, "_order").alias(c) for c in (first if apart else ())),
        *(() if apart else (F.min_by(F.struct(*first), "_order").alias("a"),)), *map(last, REPLACED), *map(known, IF_KNOWN),
        *(filled(c) for c in IF_FILLED if c not in later), *found,
    )
    if placed:
        own["evidence_hash"] = evidence_hash(F.col("normalized_source_url"), F.col("normalized_target_url"), F.col("e.collection"), F.col("e.record_filename"))
    own |= {} if apart else {c: F.col(f"a.{c}") for c in first}
    return out.select(*(own.get(f.name, F.col(f.name)).alias(f.name) for f in INDEX))


def upsert(index: DataFrame | None, batch: DataFrame, tasks: int | None = None) -> DataFrame:
    """The index with a batch of ``build_links`` whose ids are its order of arrival; new keys get ids above the index's."""
    if index is None:
        return fold(batch, F.col("id"), placed=True, tasks=tasks)
    top = index.agg(F.max("id")).head()[0] or 0
    later = batch.withColumn("id", F.col("id") + F.lit(top + 1))
    return fold(index.unionByName(later), F.col("id"), tasks=tasks)


def insert_counts(index: DataFrame | None, batch: DataFrame, compat: bool = False) -> DataFrame:
    """One row (inserted, duplicates): keys that the index lacks, and the batch's other rows. With ``compat``
    every row of a key that was made and changed within one second counts as inserted."""
    keys = batch.groupBy(*KEY).agg(F.count("*").alias("rows"), F.min("created_at").alias("made"), F.max("updated_at").alias("changed"))
    old = None if index is None else index.select(*KEY, F.col("created_at").alias("old"))
    keys = keys.withColumn("old", F.lit(None).cast("string")) if old is None else keys.join(old, list(KEY), "left")
    fresh = F.when(F.coalesce("old", "made") == F.col("changed"), F.col("rows")).otherwise(0) if compat else F.when(F.col("old").isNull(), 1).otherwise(0)
    total = keys.agg(F.coalesce(F.sum(fresh), F.lit(0)).cast("long").alias("inserted"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return total.select("inserted", (F.col("rows") - F.col("inserted")).cast("long").alias("duplicates"))


def delete_collection(index: DataFrame, collection: str) -> DataFrame:
    return index.where(F.col("collection") != collection)


def migrate_legacy(index: DataFrame, legacy: DataFrame, now: str) -> DataFrame:
    """The index with the rows of an older link table that it lacks."""
    rows = legacy_rows(legacy, now).join(index.select(*KEY), list(KEY), "left_anti")
    return index.unionByName(rows.select(*index.columns))


def legacy_rows(legacy: DataFrame, now: str) -> DataFrame:
    """Rows of an older link table: no hosts or domains, status UNVERIFIED, type UNKNOWN."""
    have = {c.lower() for c in legacy.columns}
    pick = lambda *names: F.coalesce(F.col(next(n for n in names if n in have)).cast("string"), F.lit("")) if have & set(names) else F.lit("")
    source, target = pick("source_url", "source", "from_url"), pick("target_url", "target", "to_url")
    values = {
        "normalized_source_url": source, "source_url": source, "normalized_target_url": target, "target_url": target,
        "anchor_text": pick("anchor_text", "anchor"), "collection": pick("collection"), "dataset_type": F.lit("legacy"),
        "link_type": F.lit("UNKNOWN"), "verification_status": F.lit("UNVERIFIED"),
    } | dict.fromkeys(("first_discovered_at", "last_seen_at", "created_at", "updated_at"), F.lit(now))
    if "id" in have:
        values["id"] = F.col("id")
    nullable = ("id", "source_http_status", "live_backlink_present", "last_checked_at", "record_offset", "record_length")
    rows = legacy.select(*(values.get(f.name, F.lit(None if f.name in nullable else "")).cast(f.dataType).alias(f.name) for f in INDEX))
    return fold(rows, F.col("id"))


def integrity(index: DataFrame) -> DataFrame:
    """One row of counts that are zero in a sound index: repeated keys, repeated ids, nulls in key columns."""
    names = ("repeated_keys", "repeated_ids", "null_keys")
    null = F.greatest(*(F.col(k).isNull() for k in KEY))
    counts = (
        index.groupBy(*KEY).count().where("count > 1").agg(F.count("*").alias("n")),
        index.groupBy("id").count().where("count > 1").agg(F.count("*").alias("n")),
        index.agg(F.count_if(null).alias("n")),
    )
    rows = [c.select(*(F.col("n").alias(x) if k == j else F.lit(0).cast("long").alias(x) for j, x in enumerate(names))) for k, c in enumerate(counts)]
    return rows[0].union(rows[1]).union(rows[2]).agg(*(F.sum(x).alias(x) for x in names))


#: What each schema version added to the index: columns and their defaults, in the order of versions.
ADDED: dict[int, dict[str, object]] = {
    2: {"first_discovered_at": "", "last_seen_at": ""},
    3: {"verification_status": "UNVERIFIED", "live_backlink_present": None, "last_checked_at": None},
    4: {"collection": "", "dataset_type": "", "record_filename": "", "record_offset": None, "record_length": None},
    5: {"redirect_chain": "", "evidence_hash": ""},
    6: {"created_at": "", "updated_at": ""},
}


def upgraded(index: DataFrame, version: int = 1) -> DataFrame:
    """An index written under an earlier version, step by step: columns that a later version added, where they are
    missing, get their defaults. A version that this one does not know is an error."""
    if version > VERSION:
        raise ValueError(f"the index has schema version {version}, known are versions up to {VERSION}")
    types = {f.name: f.dataType for f in INDEX}
    for step in range(2, VERSION + 1):
        new = {c: F.lit(v).cast(types[c]) for c, v in ADDED[step].items() if c not in index.columns}
        index = index.withColumns(new) if new else index
    rest = {c: F.lit(None if t.simpleString() != "string" else "").cast(t) for c, t in types.items() if c not in index.columns}
    return (index.withColumns(rest) if rest else index).select(*INDEX.names)
