"""Link datasets in files: delimited text, JSON, Parquet, archives; dispatched by ending."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.urls import strip
from linkloom.operators.build import links_of_responses, links_of_wat

REQUIRED = ("source_url", "target_url")
TEXT = ("source_url", "target_url", "anchor_text", "image_alt", "rel", "rel_original", "source_title", "collection")


class SourceError(ValueError):
    """A file that cannot be read as a link dataset."""


def _text(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def feed_of(rows: DataFrame, collection: str, dataset_type: str, *keep: str, filled: bool = False) -> DataFrame:
    """rows as a feed, with columns to keep. A rel or collection column holds even where it is empty, unless ``filled``."""
    by = {c.strip().lower(): F.col(f"`{c}`") for c in rows.columns}
    if missing := [c for c in REQUIRED if c not in by]:
        raise SourceError(f"missing columns: {', '.join(missing)}")
    value = {c: _text(by[c]) for c in TEXT if c in by}
    rel, own = value.get("rel"), value.get("collection")
    other = value.get("rel_original", F.lit(""))
    if filled:
        rel = other if rel is None else F.coalesce(F.nullif(rel, F.lit("")), other)
        own = F.lit(collection) if own is None else F.coalesce(F.nullif(own, F.lit("")), F.lit(collection))
    value["rel"] = other if rel is None else rel
    value["collection"] = F.lit(collection) if own is None else own
    names = [c for c in TEXT if c != "rel_original"]
    return rows.select(*keep, *(value.get(c, F.lit("")).alias(c) for c in names), F.lit(dataset_type).alias("dataset_type"))


def scan_csv(spark: SparkSession, path: str, sep: str = ",", line_ends_in_cells: bool = True) -> DataFrame:
    return spark.read.options(header=True, multiLine=line_ends_in_cells, escape='"', sep=sep, mode="PERMISSIVE").csv(path)


def read_csv(
    spark: SparkSession, path: str, collection: str = "", dataset_type: str = "csv", sep: str = ",", line_ends_in_cells: bool = True
) -> DataFrame:
    """Quoted cells may hold line ends, so a file is one task; without them a large file is split."""
    return feed_of(scan_csv(spark, path, sep, line_ends_in_cells), collection, dataset_type)


JSON = T.StructType([T.StructField(c, T.StringType()) for c in TEXT])


def objects(items: DataFrame, collection: str, dataset_type: str, *keep: str) -> DataFrame:
    """Feed of a column ``o`` of objects, with columns to keep: per record, a key that is there holds even where it is empty."""
    value = {c: _text(F.col(f"o.{c}")) for c in TEXT}
    rel = F.coalesce(F.col("o.rel"), F.col("o.rel_original"), F.lit(""))
    value |= {"rel": strip(rel), "collection": strip(F.coalesce(F.col("o.collection"), F.lit(collection)))}
    rows = items.select(*keep, *(value[c].alias(c) for c in TEXT if c != "rel_original"), F.lit(dataset_type).alias("dataset_type"))
    return rows


def read_jsonl(spark: SparkSession, path: str, collection: str = "", dataset_type: str = "jsonl") -> DataFrame:
    """Lines that are blank, broken or no object are skipped."""
    lines = spark.read.text(path)
    return parse_jsonl(lines, collection, dataset_type)


def parse_jsonl(lines: DataFrame, collection: str = "", dataset_type: str = "jsonl") -> DataFrame:
    """The same for a DataFrame of lines, also a streaming one."""
    lines = lines.where(F.col("value").rlike(r"^\s*\{"))
    schema = T.StructType([*JSON, T.StructField("_broken", T.StringType())])
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("o"))
    return objects(parsed.where("o is not null and o._broken is null"), collection, dataset_type)


def _first_character(spark: SparkSession, path: str) -> str:
    """The first character of a file, plain or compressed, that is no white space."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    conf, where = spark.sparkContext._jsc.hadoopConfiguration(), hadoop.fs.Path(path)
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    stream = where.getFileSystem(conf).open(where)
    stream = codec.createInputStream(stream) if codec else stream
    try:
        while (c := stream.read()) >= 0:
            if chr(c) not in " \t\r\n":
                return chr(c)
        return ""
    finally:
        stream.close()


def read_json_array(spark: SparkSession, path: str, collection: str = "", dataset_type: str = "jsonl") -> DataFrame:
    """A file that holds one array; what is no object in it is skipped, any other root is an error."""
    for file in expanded(spark, [path]):
        if _first_character(spark, file) != "[":
            raise SourceError(f"{file}: not a JSON array")
    whole = spark.read.text(path, wholetext=True)
    item = F.from_json("value", T.ArrayType(T.StringType()))
    refused = F.raise_error(F.concat(F.lit("not a JSON array: "), F.input_file_name()))
    items = whole.select(F.explode(F.when(item.isNotNull(), item).otherwise(refused)).alias("value"))
    return parse_jsonl(items, collection, dataset_type)


def read_parquet(spark: SparkSession, path: str, collection: str = "", dataset_type: str = "parquet") -> DataFrame:
    return feed_of(spark.read.parquet(path), collection, dataset_type, filled=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A list, one value a line: stripped, none blank."""
    return spark.read.text(path).select(strip(F.col("value")).alias("value")).where("value <> ''")


#: Endings of files by kind, and the reader of those that are tables.
KINDS = {
    "warc": (".warc", ".warc.gz"), "wat": (".wat", ".wat.gz"), "csv": (".csv", ".csv.gz"),
    "jsonl": (".jsonl", ".jsonl.gz", ".ndjson"), "json": (".json", ".json.gz"), "parquet": (".parquet",),
}
_TABLES = {"csv": read_csv, "jsonl": read_jsonl, "json": read_json_array, "parquet": read_parquet}


def kind_of(path: str) -> str:
    name = path.lower().rstrip("/")
    for kind, endings in KINDS.items():
        if name.endswith(endings):
            return kind
    raise SourceError(f"unknown kind of file: {path}")


def _links(spark: SparkSession, path: str, kind: str, collection: str, records: Callable[[DataFrame], DataFrame]) -> DataFrame:
    from linkloom.sources import warc

    if kind == "warc":
        feed = links_of_responses(records(warc.read_warc(spark, path)))
    elif kind == "wat":
        feed = links_of_wat(records(warc.read_wat(spark, path)))
    else:
        return records(_TABLES[kind](spark, path, collection))
    return feed.withColumn("collection", F.lit(collection))


def read_links(spark: SparkSession, path: str, collection: str = "", records: Callable[[DataFrame], DataFrame] = lambda r: r) -> DataFrame:
    """A feed from a file by its ending, from a pattern of files of one ending (``*.csv``), or from a folder's files of
    any known endings. ``records`` is applied to records before their links are taken, such as a limit."""
    try:
        return _links(spark, path, kind_of(path), collection, records)
    except SourceError:
        found = [f for f in expanded(spark, [path]) if f != path]
        if not found:
            raise
    feeds = [_links(spark, f, kind_of(f), collection, records) for f in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def expanded(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that are meant, a folder's in the order of their names; what is no known kind stays, to be an error of
    that file alone. Spark's own folders of parts count as one file."""
    from linkloom.sources.warc import list_files

    out = []
    for p in paths:
        try:
            out += [p] if kind_of(p) == "parquet" or not re.search(r"[*?{\[]", p) else list_files(spark, p)
        except SourceError:
            out += list_files(spark, p) or [p]
    return [p for p in out if not p.rpartition("/")[2].startswith(("_", "."))]
