"""Exports of a search's result."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.search import Search, ordered_values
from linkloom.schema import EXPORT_COLUMNS, INDEX, VERSION


def export_view(index: DataFrame, search: Search, header: bool = True) -> DataFrame:
    """The exported columns of a search's rows in its order; null shows as empty only in delimited files."""
    rows = search.sorted(index).select(*EXPORT_COLUMNS)
    return rows.withColumnRenamed("rel_original", "rel") if header else rows


def write_delimited(index: DataFrame, search: Search, folder: str, sep: str = ",", one_file: bool = True) -> str:
    """Delimited text with CRLF line ends and a header, as one file in order or as sorted parts."""
    rows = export_view(index, search)
    rows = rows.coalesce(1) if one_file else rows
    rows.write.mode("overwrite").options(
        header=True, sep=sep, quote='"', escape='"', lineSep="\r\n", emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(folder)
    return folder


def write_csv(index: DataFrame, search: Search, folder: str, **options) -> str:
    return write_delimited(index, search, folder, ",", **options)


def write_tsv(index: DataFrame, search: Search, folder: str, **options) -> str:
    return write_delimited(index, search, folder, "\t", **options)


def _pour(lines: Iterable[str], path: str, progress: Callable[[int], None] | None = None, every: int = 1000) -> str:
    """Lines into a local file that appears when it is whole; progress hears of every thousandth line and the last."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    n = 0
    with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
        for line in lines:
            f.write(line)
            n += 1
            if progress and n % every == 0:
                progress(n)
    if progress:
        progress(n)
    shutil.move(temporary, path)
    return path


def write_json(index: DataFrame, search: Search, path: str, progress: Callable[[int], None] | None = None) -> str:
    """One JSON array in a local file, an object a line, partition by partition through the driver."""
    rows = export_view(index, search, header=False)
    objects = rows.select(F.to_json(F.struct(*EXPORT_COLUMNS), {"ignoreNullFields": "false"}).alias("o"))

    def lines():
        first = True
        for row in objects.toLocalIterator():
            yield ("[\n" if first else ",\n") + row[0]
            first = False
        yield "[]" if first else "\n]"

    return _pour(lines(), path, progress)


def write_json_lines(index: DataFrame, search: Search, folder: str) -> str:
    """The same objects as JSON lines, written by the executors."""
    rows = export_view(index, search, header=False)
    rows.select(F.to_json(F.struct(*EXPORT_COLUMNS), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(folder)
    return folder


def write_values(index: DataFrame, search: Search, folder: str, columns: list[str], one_file: bool = True, unique: bool = True) -> str:
    """Text of a column's values, or of several with tabs between, each once as it first occurs and none blank."""
    if unique:
        values = ordered_values(search.rows(index), search, columns)
    else:
        values = search.sorted(index).select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns))
        for c in columns:
            values = values.where(F.col(c) != "")
    values = values.select(F.concat_ws("\t", *columns).alias("value"))
    (values.coalesce(1) if one_file else values).write.mode("overwrite").text(folder)
    return folder


#: Formats by name.
EXPORTS: dict[str, Callable] = {
    "csv": write_csv,
    "tsv": write_tsv,
    "json": write_json,
    "source_urls": lambda index, search, path: write_values(index, search, path, ["source_url"]),
    "target_urls": lambda index, search, path: write_values(index, search, path, ["target_url"]),
    "referring_domains": lambda index, search, path: write_values(index, search, path, ["source_domain"]),
    "source_target_pairs": lambda index, search, path: write_values(index, search, path, ["source_url", "target_url"]),
}


def export(name: str, index: DataFrame, search: Search, path: str) -> str:
    if name not in EXPORTS:
        raise ValueError(f"unknown format {name!r}; known are {', '.join(EXPORTS)}")
    return EXPORTS[name](index, search, path)


def format_of(path: str) -> str:
    return {".json": "json", ".tsv": "tsv"}.get(os.path.splitext(path)[1].lower(), "csv")


def describe() -> str:
    return json.dumps({"version": VERSION, "columns": INDEX.names})
