"""The link index's columns, allowed values and inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: what columns of the index may hold
LINK_TYPES = ("FOLLOW", "NOFOLLOW", "SPONSORED", "UGC", "MULTIPLE_REL_VALUES", "UNKNOWN")
STATUSES = (
    "LIVE_CONFIRMED", "ARCHIVED_CONFIRMED", "ARCHIVED_ONLY", "REMOVED", "SOURCE_UNAVAILABLE", "VERIFICATION_FAILED", "UNVERIFIED",
)
MATCH_MODES = ("exact_hostname", "root_domain", "exact_url", "path_prefix")
JOB_STATES = ("pending", "running", "paused", "stopping", "stopped", "completed", "failed")
# fixed values: the index's columns in order
INDEX_COLUMNS = (
    ("id", "long"), ("normalized_target_domain", "string"), ("normalized_target_hostname", "string"),
    ("normalized_target_url", "string"), ("normalized_source_url", "string"), ("source_url", "string"),
    ("source_domain", "string"), ("source_hostname", "string"), ("source_title", "string"), ("target_url", "string"),
    ("target_hostname", "string"), ("anchor_text", "string"), ("image_alt", "string"), ("link_type", "string"),
    ("rel_original", "string"), ("source_http_status", "int"), ("content_type", "string"),
    ("verification_status", "string"), ("live_backlink_present", "int"), ("first_discovered_at", "string"),
    ("last_seen_at", "string"), ("last_checked_at", "string"), ("collection", "string"), ("dataset_type", "string"),
    ("record_filename", "string"), ("record_offset", "long"), ("record_length", "long"), ("redirect_chain", "string"),
    ("evidence_hash", "string"), ("created_at", "string"), ("updated_at", "string"),
)
KEY = ("normalized_source_url", "normalized_target_url", "link_type")
# fixed values: exported columns in order; rel_original is headed rel in delimited files
EXPORT_COLUMNS = (
    "source_url", "source_domain", "source_title", "target_url", "target_hostname", "anchor_text", "image_alt",
    "link_type", "rel_original", "source_http_status", "verification_status", "live_backlink_present",
    "first_discovered_at", "last_seen_at", "last_checked_at", "collection", "dataset_type", "record_filename",
    "record_offset", "record_length", "redirect_chain", "evidence_hash",
)

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "binary": T.BinaryType(), "strings": T.ArrayType(T.StringType())}


def _struct(columns) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in columns])


INDEX = _struct(INDEX_COLUMNS)
#: A link as the sources give it: a page, what it links to, and what is said about it.
FEED = _struct((
    ("source_url", "string"), ("target_url", "string"), ("anchor_text", "string"), ("image_alt", "string"), ("rel", "string"),
    ("source_title", "string"), ("collection", "string"), ("dataset_type", "string"), ("record_filename", "string"),
    ("record_offset", "long"), ("record_length", "long"), ("source_http_status", "int"), ("content_type", "string"),
))
FETCHES = _struct((
    ("url", "string"), ("final_url", "string"), ("status", "int"), ("content_type", "string"), ("body", "binary"),
    ("redirect_chain", "strings"), ("error", "string"),
))
CDX = _struct((
    ("urlkey", "string"), ("timestamp", "string"), ("url", "string"), ("mime", "string"), ("status", "string"),
    ("digest", "string"), ("length", "long"), ("offset", "long"), ("filename", "string"),
))
#: A link of a record of a file, or a record without links. place and position: of the record in its file, null if the file is no
#: good, and of the link in its record, null if it has none.
RECORD = _struct((
    ("place", "long"), ("position", "int"), ("error", "string"), ("refused", "string"), ("bytes", "long"), ("source_url", "string"),
    ("source_title", "string"), ("collection", "string"), ("dataset_type", "string"), ("record_filename", "string"),
    ("record_offset", "long"), ("record_length", "long"), ("source_http_status", "int"), ("content_type", "string"),
    ("target_url", "string"), ("anchor_text", "string"), ("image_alt", "string"), ("rel", "string"),
))
#: Raised by additive changes of INDEX; a table written under a lower version gets the missing columns on reading.
VERSION = 6
