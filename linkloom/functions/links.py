"""What a link's attributes say, and text functions of the search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def classify_rel(rel: Column) -> Column:
    """FOLLOW without one of the three flags, MULTIPLE_REL_VALUES with several, else the flag."""
    words = F.split(F.lower(F.coalesce(rel, F.lit(""))), r"(?U)[,\s]+")
    flags = F.array_intersect(words, F.array(*map(F.lit, ("nofollow", "sponsored", "ugc"))))
    return F.when(F.size(flags) == 0, "FOLLOW").when(F.size(flags) > 1, "MULTIPLE_REL_VALUES").otherwise(F.upper(flags[0]))


def evidence_hash(source: Column, target: Column, collection: Column, filename: Column, offset: Column | None = None) -> Column:
    """sha256 of the parts between bars; an offset that is not known yet reads ``None``."""
    last = F.lit("None") if offset is None else F.coalesce(offset.cast("string"), F.lit("None"))
    parts = [F.coalesce(c, F.lit("")) for c in (source, target, collection, filename)]
    return F.sha2(F.concat_ws("|", *parts, last), 256)


def sql_like(text: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters alone and knows no escape."""
    escape = next(c for c in "\x01\x02\x03\x04" if c not in pattern)
    low = pattern.translate(str.maketrans(_UPPER, _LOWER))
    return F.like(F.translate(text, _UPPER, _LOWER), F.lit(low), F.lit(escape))


def human_bytes(size: Column) -> Column:
    """A size as B, KB, MB, GB or TB with one decimal."""
    out = F.format_string("%.1f TB", size / F.lit(1024.0**4))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", size / F.lit(1024.0**k))).otherwise(out)
    return out


def storage_estimate(pages: Column, links_per_page: int = 40, bytes_per_link: int = 320) -> Column:
    return pages * links_per_page * bytes_per_link
