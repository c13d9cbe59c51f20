"""What the training-data operators share: words, hashes, batches, tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Maps the bytes of a UTF-8 text so that bytes.split() gives its item words: A-Z to lower case, what is not
#: [0-9a-z] or beyond ASCII to a space.
ITEM_WORDS = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)
#: Rows, and bytes of its columns, in a batch that a Python worker handles at once; a larger row is a batch alone.
BATCH_ROWS, BATCH_BYTES = 2000, 6 << 20
#: What a session is set to where it has no value of its own: bytes in a batch on its way to a Python worker, and rows in
#: one that a scan holds, as these are whole texts.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": 512}
#: Of intermediate tables: small row groups, as a task holds one until it is full; and in a folder of the local file
#: system, such as a mounted one, no checksum files beside them, for which two processes are started a file to set modes.
WRITING = {
    "compression": "zstd", "parquet.block.size": str(32 << 20),
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
}
#: Rows in a file of a table whose number of rows is known.
FILE_ROWS = 200_000


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    return utf8(text).translate(ITEM_WORDS).split()


class WordHashes(dict):
    """Word to 64-bit hash, the same in every worker; forgets all when it grows beyond its bound."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n consecutive entries."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + m]
    return mix(out)


def slices(batch: pa.RecordBatch, *columns: str | int) -> Iterator[pa.RecordBatch]:
    """The batch in order, in parts of at most ``BATCH_ROWS`` rows and, but for single rows, ``BATCH_BYTES`` bytes of
    these columns, or of all that have a length."""
    size = np.zeros(batch.num_rows + 1, np.int64)
    for c in columns or range(batch.num_columns):
        column = batch.column(c)
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size[1:] += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    size = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, size[at] + BATCH_BYTES, "right")) - 1
        end = min(max(end, at + 1), at + BATCH_ROWS)
        part = batch.slice(at, end - at)
        at = end
        yield part


_kept: dict[object, object] = {}


def kept_in_worker(key: object, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker from task to task, such as a table of words it has seen. Only the last
    operator's is kept, so a worker that serves many holds one."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], Iterator[dict]], schema: str) -> DataFrame:
    """Runs fn over small batches of df's rows as lists by column; fn yields columns of results."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for out in fn(dict(zip(part.schema.names, (c.to_pylist() for c in part.columns), strict=True))):
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return map_arrow(df, run, schema)


def edit_rows(
    df: DataFrame, column: str, fn: Callable[[list], tuple[np.ndarray | None, dict[str, list]]]
) -> DataFrame:
    """Whole rows of df through fn, which sees one column and gives a mask of rows to keep (or None) and new
    values by column name. Other columns, whatever their names, pass as they are."""
    schema = df.schema
    arrow = to_arrow_schema(schema)
    at = schema.names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keep, new = fn(part.column(at).to_pylist())
                columns = [
                    pa.array(new[f.name], f.type) if f.name in new else part.column(i).cast(f.type)
                    for i, f in enumerate(arrow)
                ]
                out = pa.RecordBatch.from_arrays(columns, names=arrow.names)
                yield out if keep is None else out.filter(pa.array(keep))

    return map_arrow(df, run, schema)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in batches of bounded size (``BOUNDS``), as a batch stands in the memory of the JVM and of the worker
    at once."""
    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def bounded(spark: SparkSession) -> None:
    for name, value in BOUNDS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one where that is unset, if the driver
    and the executors are one process."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a written table in the shared folder: computed once, and no lineage behind it. With the number of its rows,
    or a bound on it, it is written in as few files as its size asks for; not for joins by hash tables, as a task keeps
    those of all partitions that it goes through."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    df.write.options(**WRITING).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, group: str, ranges: list, order: list, name: str, rows: int) -> DataFrame:
    """df, of so many rows at most, written, with each row's place from 1 on among the rows of its group, in an order that starts with ``ranges``.
    Groups are cut into ranges, numbered each alone and moved up by the rows before, so a large group is many tasks."""
    ranged = df.repartitionByRange(group, *ranges).withColumn("_range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_range", group).orderBy(*ranges, *order))
    table = stored(ranged.withColumn("_place", place), "numbered", rows)
    before = Window.partitionBy("_group").orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_own")).agg(F.max("_place").alias("_size"))
    sizes = sizes.withColumn("_before", F.sum("_size").over(before)).where("_before is not null")  # of cut groups
    table = table.join(sizes, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_own")), "left")
    number = (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("long").alias(name)
    return table.select(*df.columns, number)


def hashed(df: DataFrame) -> DataFrame:
    """df as the side of a join that is held in hash tables, so that the other, larger one is not sorted. For sides whose
    keys are spread evenly, so that each of their partitions is of bounded size."""
    return df.hint("shuffle_hash")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(key: Column, fraction: float) -> Column:
    """True for about this fraction of keys, chosen by hash; all if the fraction is 1 or more."""
    if fraction >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(fraction * (1 << 30))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))
