"""The written index: a base by bucket, layers of changes over it, and manifests that say which files count.

A bucket is a hash of the target domain; a large one is cut into parts by a hash of the urls. A change (``upsert``) writes its
own rows alone, folded by key, as one layer of few files that are sorted by bucket and domain, and then a manifest of the
next number that names it after the others. Readers merge base and layers: of a key that the base has, a layer's
row replaces what later rows replace; a key that it lacks is a row of its own. Nothing of the base moves for that, and a
search for one domain opens its bucket and, of the layers, the row groups of that bucket.

``maintain`` keeps layers few: such of similar size are folded into one, and when all of them weigh more than
``SHARE`` of the base, they are folded into the buckets that they touch (``compact``), where a bucket whose parts are larger than
``PART_BYTES`` gets more of them. So a row is written a few times in its life, whatever the index's size.

Beside each layer and each rewriting of the base stand sketches of its source pages and domains and target domains, a row a bucket and
part, and the manifest counts rows. So ``stats`` opens no row of the index.

With the rows a change can commit what has been read for them (``progress``: files and records) and what was refused
(``rejected``): both are files that the same manifest names, so they hold if and only if the rows do. ``vacuum`` deletes what only
older manifests name; nothing is deleted before, as a slow reader may still need it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import merge, verify
from linkloom.operators.search import Search
from linkloom.schema import INDEX, KEY, VERSION

PROGRESS = "job long, file string, records long, upto long, whole boolean"
REJECTED = "job long, file string, record long, context string, message string, detail string"
#: What is counted by sketches: names and columns.
SKETCHED = {"source_pages": "normalized_source_url", "source_domains": "source_domain", "target_domains": "normalized_target_domain"}
_SORTED = ("bucket", "part", "normalized_target_domain", "normalized_source_url")


def over(base: DataFrame, layer: DataFrame) -> DataFrame:
    """The rows of an index with a later one over them, each with one row a key. What changes joins to the keys of the base,
    so where it is small enough to be sent around, the base is not shuffled."""
    later = layer.select(*KEY, *(F.col(c).alias(f"_{c}") for c in (*merge.REPLACED, *merge.IF_KNOWN, *merge.IF_FILLED)), F.lit(True).alias("_later"))
    both = base.join(later, list(KEY), "left")
    value = {c: F.when(F.col("_later"), F.col(f"_{c}")).otherwise(F.col(c)) for c in merge.REPLACED}
    value |= {c: F.coalesce(f"_{c}", c) for c in merge.IF_KNOWN}
    value |= {c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)) for c in merge.IF_FILLED}
    both = both.select(*(value.get(c, F.col(c)).alias(c) for c in INDEX.names))
    return both.unionByName(layer.select(*INDEX.names).join(base.select(*KEY), list(KEY), "left_anti").select(*INDEX.names))


def with_few(base: DataFrame, layer: DataFrame, few_later: bool) -> DataFrame:
    """The same as ``over``, where the layer has few rows (``few_later``), or the base: the few are sent around, and the others stay
    where they are read. Of keys that both have, the many are asked once more."""
    few, many = (layer, base) if few_later else (base, layer)
    here, there = ("", "_") if few_later else ("_", "")  # before names of the base and of the layer
    both = many.join(F.broadcast(few.select(*KEY, *(F.col(c).alias(f"_{c}") for c in INDEX.names if c not in KEY), F.lit(True).alias("_few"))), list(KEY), "left")
    old, new = (lambda c: F.col(f"{here}{c}")), (lambda c: F.col(f"{there}{c}"))
    value = {c: old(c) if few_later else F.when(F.col("_few"), old(c)).otherwise(new(c)) for c in INDEX.names if c not in KEY}
    value |= {c: F.when(F.col("_few"), new(c)).otherwise(old(c)) if few_later else new(c) for c in merge.REPLACED}
    value |= {c: F.coalesce(new(c), old(c)) for c in merge.IF_KNOWN}
    value |= {c: F.coalesce(F.nullif(new(c), F.lit("")), old(c), new(c)) for c in merge.IF_FILLED}
    held = many.select(*KEY).join(F.broadcast(few.select(*KEY)), list(KEY), "left_semi")
    alone = few.select(*INDEX.names).join(F.broadcast(held), list(KEY), "left_anti")
    return both.select(*(value.get(c, F.col(c)).alias(c) for c in INDEX.names)).unionByName(alone.select(*INDEX.names))


def run_of(sizes: list[int], least: int = 4) -> int:
    """How many of the last layers are folded into one: each is no more than twice as large as all after it; 0 if these
    are fewer than ``least``. So a byte is folded anew only when as much again has come, by and large."""
    n, total = 0, 0
    while n < len(sizes) and (n == 0 or sizes[-1 - n] <= 2 * total):
        total += sizes[-1 - n]
        n += 1
    return n if n >= least else 0


class StoredIndex:
    BUCKETS = 64
    #: Bytes of layers, as a share of the base's, beyond which they are folded into it.
    SHARE = 0.25
    #: Tasks that a bucket of new rows is dealt to at most, by a hash of the page.
    DEALT = 16
    #: Bytes of a part of a bucket beyond which it is cut.
    PART_BYTES = 1 << 30
    #: Rows of layers that are sent around to those of a larger one.
    FEW_ROWS = 100_000

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def _manifests(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/manifest-*.json")) or []
        return sorted(int(s.getPath().getName().removeprefix("manifest-").removesuffix(".json")) for s in found)

    def version(self) -> int:
        return max(self._manifests(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Schema version, number of buckets, parts of the buckets that have several, the highest id that was given, the
        base's folder and bytes by bucket and part, and in order the layers, the progress and what was rejected."""
        if not (v := version or self.version()):
            return {"schema": VERSION, "buckets": self.buckets, "parts": {}, "top": -1, "base": {}, "layers": [], "progress": [], "rejected": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{v}.json", wholetext=True).head()[0])

    def _commit(self, manifest: dict) -> int:
        v = self.version() + 1
        out = self._fs.create(self._path(f"{self.path}/manifest-{v}.json"), False)  # fails if another writer was first
        out.write(bytearray(json.dumps(manifest | {"schema": VERSION}).encode()))
        out.close()
        return v

    def _bytes(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.path}/{folder}")).getLength()

    # reading

    def _bucket(self, domain: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(domain), F.lit(buckets)).cast("int")

    def _near(self, buckets: int, tasks: int | None = None) -> dict[str, Column]:
        """By what the fold of new rows, whose domains follow from their urls, deals them, so that they are written as they come out: some
        groups for each task, so that tasks have about as much."""
        dealt = max(self.DEALT, -(-16 * (tasks or 0) // buckets))
        return {"_bucket": self._bucket(F.col("normalized_target_domain"), buckets), "_dealt": F.pmod(F.xxhash64("normalized_source_url"), F.lit(dealt)).cast("int")}

    def _base(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame | None:
        folders = [u["folder"] for k, u in manifest["base"].items() if buckets is None or int(k.partition("-")[0]) in buckets]
        return merge.upgraded(self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders)), manifest["schema"]) if folders else None

    def _layer(self, layer: dict, schema: int, buckets: set[int] | None = None, domain: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{layer['folder']}")
        rows = merge.upgraded(rows if buckets is None else rows.where(F.col("bucket").isin(*buckets)), schema)
        return rows if domain is None else rows.where(F.col("normalized_target_domain") == domain)

    def _layers(self, manifest: dict, layers: list[dict], buckets: set[int] | None = None, domain: str | None = None) -> DataFrame:
        """Layers as one: one row a key. A single one has no more. If all others than the largest have few rows, it is not shuffled."""
        rows = [self._layer(x, manifest["schema"], buckets, domain) for x in layers]
        tasks = merge.tasks_for(self.spark, sum(x["rows"] for x in layers))
        folded = lambda some: some[0] if len(some) == 1 else merge.fold(reduce(DataFrame.unionByName, some), F.col("id"), tasks=tasks, apart=True)
        large = max(range(len(layers)), key=lambda k: layers[k]["rows"])
        if sum(x["rows"] for x in layers) - layers[large]["rows"] > self.FEW_ROWS:
            return folded(rows)
        out = rows[large]
        if large:
            out = with_few(folded(rows[:large]), out, False)
        return with_few(out, folded(rows[large + 1 :]), True) if rows[large + 1 :] else out

    def _rows(self, manifest: dict, buckets: set[int] | None = None, domain: str | None = None) -> DataFrame:
        base = self._base(manifest, buckets)
        if base is not None and domain is not None:
            base = base.where(F.col("normalized_target_domain") == domain)
        if not manifest["layers"]:
            return self.spark.createDataFrame([], INDEX) if base is None else base
        later = self._layers(manifest, manifest["layers"], buckets, domain)
        return later if base is None else over(base, later)

    def read(self, domain: str | None = None) -> DataFrame | None:
        """All rows, or those of one target domain; None if nothing was ever written."""
        if not (v := self.version()):
            return None
        manifest = self.manifest(v)
        if domain is None:
            return self._rows(manifest)
        return self._rows(manifest, self._buckets_of(manifest, domain), domain)

    def _buckets_of(self, manifest: dict, *domains: str) -> set[int]:
        return set(self.spark.range(1).select(*(self._bucket(F.lit(d), manifest["buckets"]).alias(f"b{k}") for k, d in enumerate(domains))).head())

    def search(self, search: Search) -> DataFrame:
        """Rows that a search finds. Every kind of target names its registrable domain, so only that one's bucket is
        opened."""
        if (target := search.target) and target.mode == "exact_url" and (v := self.version()):  # also of rows without a domain
            rows = self._rows(manifest := self.manifest(v), self._buckets_of(manifest, target.domain, ""))
        else:
            rows = self.read(target.domain if target else None)
        return self.spark.createDataFrame([], INDEX) if rows is None else search.rows(rows)

    def progress(self, job: int) -> DataFrame:
        """(file, records, upto, whole): how many records of each file this job has read, the place from which it goes on, and whether
        that was all."""
        folders = [f"{self.path}/{f}" for f in self.manifest()["progress"]]
        rows = self.spark.read.schema(PROGRESS).parquet(*folders) if folders else self.spark.createDataFrame([], PROGRESS)
        return rows.where(F.col("job") == job).groupBy("file").agg(F.sum("records").alias("records"), F.max("upto").alias("upto"), F.max("whole").alias("whole"))

    def rejected(self) -> DataFrame:
        """Records and links that changes of the index refused, with the reason."""
        folders = [f"{self.path}/{f}" for f in self.manifest()["rejected"]]
        return self.spark.read.schema(REJECTED).parquet(*folders) if folders else self.spark.createDataFrame([], REJECTED)

    def stats(self) -> dict[str, int] | None:
        """Rows (null if a layer was written without counting), and about how many different source pages, source domains and target
        domains, within some 2 %: from the manifest and from sketches alone."""
        if not self.version():
            return None
        manifest = self.manifest()
        units, layers = manifest["base"].values(), manifest["layers"]
        known = all(x.get("inserted") is not None for x in layers)
        out = {"backlinks": sum(u["rows"] for u in units) + sum(x["inserted"] for x in layers) if known else None}
        wanted = [u["folder"] for u in units] + [x["folder"] for x in layers]
        folders = sorted({f"{self.path}/sketches-{w.partition('/')[0]}" for w in wanted})
        if not folders:
            return out | dict.fromkeys(SKETCHED, 0)
        rows = self.spark.read.parquet(*folders).join(self.spark.createDataFrame([(w,) for w in wanted], "folder string"), "folder", "left_semi")
        return out | rows.agg(*(F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in SKETCHED)).head().asDict()

    # writing

    def _sketched(self, rows: DataFrame, folder: Column, name: str) -> dict[str, int]:
        """Sketches of written rows, by their folder; returns the rows of each."""
        sketches = rows.groupBy(folder.alias("folder")).agg(F.count("*").alias("rows"), *(F.hll_sketch_agg(c, F.lit(12)).alias(n) for n, c in SKETCHED.items()))
        sketches.write.option("compression", "zstd").parquet(f"{self.path}/sketches-{name}")
        return {r[0]: r[1] for r in self.spark.read.parquet(f"{self.path}/sketches-{name}").select("folder", "rows").collect()}  # a row a bucket and part

    def _written(self, rows: DataFrame, kind: str) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return folder

    def _write_layer(self, rows: DataFrame, buckets: int, dealt: bool = False) -> dict:
        """A layer of one row a key, in as few files as its size asks for. dealt: rows of a bucket are in few tasks as they come."""
        counted = Observation()
        rows = rows.select(*INDEX.names, self._bucket(F.col("normalized_target_domain"), buckets).alias("bucket"))
        order = [c for c in _SORTED if c != "part"]
        rows = (rows if dealt else rows.repartitionByRange(*order)).sortWithinPartitions(*order).observe(counted, F.count("*").alias("n"))
        folder = self._written(rows, "layer")
        if counted.get["n"]:
            self._sketched(self.spark.read.parquet(f"{self.path}/{folder}"), F.lit(folder), folder)
        return {"folder": folder, "bytes": self._bytes(folder), "rows": counted.get["n"]}

    def _write_base(self, rows: DataFrame, buckets: int, parts: dict[str, int], dealt: bool = False) -> dict:
        """New folders of the base, by bucket and part. dealt: rows of a bucket are in few tasks as they come."""
        rows = rows.select(*INDEX.names, self._bucket(F.col("normalized_target_domain"), buckets).alias("bucket"))
        several = F.lit(1)
        for k, n in parts.items():
            several = F.when(F.col("bucket") == int(k), n).otherwise(several)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("normalized_source_url", "normalized_target_url"), several).cast("int"))
        rows = (rows if dealt else rows.repartitionByRange(*_SORTED)).withColumn("unit", F.concat_ws("-", "bucket", "part"))
        rows = rows.sortWithinPartitions("unit", *_SORTED[2:]).drop("bucket", "part")  # the writer asks for units one after the other
        folder = f"base-{uuid.uuid4().hex}"
        rows.write.partitionBy("unit").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        made = [s.getPath().getName() for s in self._fs.globStatus(self._path(f"{self.path}/{folder}/unit=*")) or []]
        if not made:
            return {}
        unit = F.concat(F.lit(f"{folder}/unit="), F.col("unit"))
        counts = self._sketched(self.spark.read.schema(f"{INDEX.simpleString()[7:-1].replace(':', ' ')}, unit string").parquet(f"{self.path}/{folder}"), unit, folder)
        return {m.removeprefix("unit="): {"folder": f"{folder}/{m}", "bytes": self._bytes(f"{folder}/{m}"), "rows": counts[f"{folder}/{m}"]} for m in made}

    def replace(self, rows: DataFrame) -> int:
        """These rows, with their ids, in place of all that there is."""
        return self._replaced(rows, False)

    def fill(self, batch: DataFrame) -> int:
        """The fold of rows of ``build_links``, whose ids are their order of arrival, in place of all that there is: by one shuffle."""
        return self._replaced(merge.fold(batch, F.col("id"), placed=True, near=self._near(self.buckets)), True)

    def _replaced(self, rows: DataFrame, dealt: bool) -> int:
        top = Observation()
        base = self._write_base(rows.observe(top, F.max("id").alias("top")), self.buckets, {}, dealt)
        highest = -1 if (t := top.get["top"]) is None else t
        return self._commit(self.manifest() | {"buckets": self.buckets, "parts": {}, "base": base, "layers": [], "top": highest})

    def upsert(
        self, batch: DataFrame, progress: DataFrame | None = None, rejected: DataFrame | Callable[[int], DataFrame | None] | None = None,
        count: bool = True, placed: bool = False, size: int = 0,
    ) -> dict[str, int]:
        """Merges rows whose ids are their order of arrival, and commits the progress and the refused records with them; a function
        is asked for these when the batch is written, of so many keys.
        Returns how many keys are new, how many rows not; for that the keys of the batch's buckets are read. Without
        ``count`` nothing of the index is read, and the numbers are of the batch's keys and its other rows. placed: all rows are as
        ``build_links`` made them (see ``merge.fold``). size: rows of the batch, if they are known, by which tasks fold them."""
        before = self.manifest()
        tasks = merge.tasks_for(self.spark, size)
        rows, new = Observation(), {"inserted": 0, "duplicates": 0}
        start = before["top"] + 1
        ids = batch.withColumn("id", F.col("id") + F.lit(start)).observe(rows, F.count("*").alias("n"), F.max("id").alias("top"))
        layer = self._write_layer(merge.fold(ids, F.col("id"), placed, self._near(before["buckets"], tasks), tasks), before["buckets"], True)
        after = dict(before)
        if layer["rows"]:
            new = {"inserted": layer["rows"], "duplicates": rows.get["n"] - layer["rows"]}
            if count and (known := self._known(before, layer)):
                new = {"inserted": layer["rows"] - known, "duplicates": new["duplicates"] + known}
            layer["inserted"] = new["inserted"] if count else None
            after |= {"layers": [*before["layers"], layer], "top": rows.get["top"]}
        else:
            self._fs.delete(self._path(f"{self.path}/{layer['folder']}"), True)
        for name, more in (("progress", progress), ("rejected", rejected(layer["rows"]) if callable(rejected) else rejected)):
            if more is not None:
                after[name] = [*before[name], self._written(more, name)]
        if after != before:
            self._commit(after)
        return new

    def commit_progress(self, job: int, file: str) -> int:
        """Notes that nothing of this file is left for a job."""
        manifest, rows = self.manifest(), self.spark.createDataFrame([(job, file, 0, 0, True)], PROGRESS).coalesce(1)
        return self._commit(manifest | {"progress": [*manifest["progress"], self._written(rows, "progress")]})

    def _known(self, before: dict, layer: dict) -> int:
        """How many keys of a layer the index has already; of many keys 128 bits are compared."""
        added = self.spark.read.parquet(f"{self.path}/{layer['folder']}").select(*KEY, "bucket")
        touched = {r[0] for r in added.select("bucket").distinct().collect()}  # one row a bucket
        old = [self._layer(x, before["schema"], touched).select(*KEY) for x in before["layers"]]
        if (base := self._base(before, touched)) is not None:
            old.append(base.select(*KEY))
        if not old:
            return 0
        new, known = added.select(*KEY), reduce(DataFrame.unionByName, old)
        if layer["rows"] <= self.FEW_ROWS:  # these are sent to the index's keys, not those moved
            return known.join(F.broadcast(new), list(KEY), "left_semi").distinct().count()
        digest = lambda rows: rows.select(F.xxhash64(*KEY).alias("a"), F.xxhash64(*reversed(KEY)).alias("b"))
        return digest(new).join(digest(known), ["a", "b"], "left_semi").count()

    def delete_collection(self, collection: str) -> int:
        """Deletes a collection's rows; layers go into the base first, as a row's collection is the first one's."""
        self.compact()
        before = self.manifest()
        if (rows := self._base(before)) is None:
            return 0
        bucket = self._bucket(F.col("normalized_target_domain"), before["buckets"])
        gone = {r[0]: r[1] for r in rows.where(F.col("collection") == collection).groupBy(bucket).count().collect()}
        if gone:
            self._rebased(before, merge.delete_collection(self._base(before, set(gone)), collection), set(gone))
        return sum(gone.values())

    def apply_verification(self, results: DataFrame, now: str) -> int:
        """Results, by id, over the stored rows; layers go into the base first. Where the rows are is read from ids and domains
        alone, of row groups that can have such ids, and only these buckets are written. Returns how many rows changed."""
        self.compact()
        before = self.manifest()
        low, high = results.agg(F.min("id"), F.max("id")).head()
        if low is None or (rows := self._base(before)) is None:
            return 0
        rows = rows.where(F.col("id").between(low, high)).select("id", self._bucket(F.col("normalized_target_domain"), before["buckets"]).alias("bucket"))
        held = {r[0]: r[1] for r in rows.join(results.select("id"), "id", "left_semi").groupBy("bucket").count().collect()}  # a row a bucket
        if held:
            self._rebased(before, verify.apply_verification(self._base(before, set(held)), results, now), set(held))
        return sum(held.values())

    def migrate(self, legacy: DataFrame, now: str) -> int:
        """Adds the rows of an older link table whose keys the index lacks, as a layer; how many."""
        rows = merge.legacy_rows(legacy, now)
        if (own := self.read()) is not None:
            rows = rows.join(own.select(*KEY), list(KEY), "left_anti")
        return self.upsert(rows.select(*INDEX.names).withColumn("id", F.coalesce("id", F.monotonically_increasing_id())), count=False)["inserted"]

    # maintenance

    def _rebased(self, before: dict, rows: DataFrame, touched: set[int], **more) -> int:
        kept = {k: u for k, u in before["base"].items() if int(k.partition("-")[0]) not in touched}
        parts = more.get("parts", before["parts"])
        made = self._write_base(rows, before["buckets"], {k: n for k, n in parts.items() if int(k) in touched})
        return self._commit(before | {"base": kept | made} | more)

    def compact(self) -> int:
        """Folds all layers into the buckets that they touch; buckets that grew too large get more parts."""
        before = self.manifest()
        if not (layers := before["layers"]):
            return self.version()
        several = self.spark.read.parquet(*(f"{self.path}/{x['folder']}" for x in layers)).groupBy("bucket").count().collect()  # one row a bucket
        rows = sum(r["count"] for r in several)
        size = {r["bucket"]: sum(x["bytes"] for x in layers) * r["count"] // max(1, rows) for r in several}
        for k, unit in before["base"].items():
            if (b := int(k.partition("-")[0])) in size:
                size[b] += unit["bytes"]
        parts = dict(before["parts"])
        for b, n in size.items():
            if (wanted := 1 << max(0, (-(-n // self.PART_BYTES) - 1).bit_length())) > parts.get(str(b), 1):
                parts[str(b)] = wanted
        return self._rebased(before, self._rows(before, set(size)), set(size), parts=parts, layers=[])

    def maintain(self) -> str:
        """Does what sizes ask for, as the manifest has them: nothing, a fold of the last layers, or of all into the base."""
        manifest = self.manifest()
        layers = manifest["layers"]
        if layers and sum(x["bytes"] for x in layers) > self.SHARE * sum(u["bytes"] for u in manifest["base"].values()) and len(layers) >= 4:
            self.compact()
            return "compacted"
        if n := run_of([x["bytes"] for x in layers]):
            folded = self._write_layer(self._layers(manifest, layers[-n:]), manifest["buckets"])
            inserted = [x.get("inserted") for x in layers[-n:]]
            folded["inserted"] = None if None in inserted else sum(inserted)
            self._commit(manifest | {"layers": [*layers[:-n], folded]})
            return "folded"
        return "kept"

    def _folders(self, manifest: dict) -> set[str]:
        return {u["folder"] for u in (*manifest["base"].values(), *manifest["layers"])} | {*manifest["progress"], *manifest["rejected"]}

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests before the last ``keep`` and folders that none of these names; the number of folders."""
        known = self._manifests()
        used = set().union(*(self._folders(self.manifest(v)) for v in known[-keep:]))
        used |= {f"sketches-{f.partition('/')[0]}" for f in used}
        there = [s.getPath() for s in self._fs.globStatus(self._path(f"{self.path}/{{layer,progress,rejected,sketches}}-*")) or []]
        units = [s.getPath() for s in self._fs.globStatus(self._path(f"{self.path}/base-*/unit=*")) or []]
        gone = [p for p in there if p.getName() not in used] + [p for p in units if f"{p.getParent().getName()}/{p.getName()}" not in used]
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifest-{v}.json"), False)
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
