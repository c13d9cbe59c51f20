"""Links and titles of HTML pages. The parser runs in Python, once for each page, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from linkloom.functions import urls
from linkloom.functions.links import classify_rel

#: Bytes of pages that a worker parses at once, and that are sent to it at once where the session says nothing else.
MOST_BYTES = 8 << 20
LINK = "struct<position:int,href:string,rel:string,anchor_text:string,image_alt:string,is_image:boolean,resolved_url:string,hostname:string>"


class Tokens(HTMLParser):
    """The page as a list of tokens: ``(name, attributes)`` for a start of a title, link or image, ``(name, None)`` for
    an end, ``(None, text)`` for text."""

    SEEN = frozenset(("a", "img", "title"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str | None, object]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SEEN:
            self.found.append((tag, dict(attrs)))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SEEN:
            self.found.append((tag, None))

    def handle_data(self, data: str) -> None:
        self.found.append((None, data))


def tokens(html: str) -> list[tuple[str | None, object]]:
    """What the standard parser gives up on is where the page ends."""
    reader = Tokens()
    with suppress(AssertionError, ValueError):
        reader.feed(html)
        reader.close()
    return reader.found


def anchors_of(found: list[tuple[str | None, object]]) -> list[dict]:
    """Links from tokens, by the place where they end; those left open end behind the last token, inner ones first.
    A link's text and images are the tokens between its start and its end that lie in no inner link."""
    depth, spans, starts = [], [], []
    for k, (name, value) in enumerate(found):
        if name == "a" and value is not None:
            starts.append(k)
        elif name == "a" and starts:
            spans.append((starts.pop(), k))
        depth.append(starts[-1] if starts else -1)  # the innermost open link at each token
    spans += [(k, len(found)) for k in reversed(starts)]
    inside: dict[int, list[int]] = {}
    for k, owner in enumerate(depth):
        if owner >= 0 and owner != k:
            inside.setdefault(owner, []).append(k)
    out = []
    for position, (start, _) in enumerate(spans):
        own = [found[k] for k in inside.get(start, ())]
        words = [x.strip() for name, x in own if name is None]
        images = [x.get("alt") or "" for name, x in own if name == "img" and x is not None]
        text = " ".join(filter(None, words))
        attributes = found[start][1]
        out.append({
            "position": position, "href": attributes.get("href") or "", "rel": attributes.get("rel") or "", "anchor_text": text,
            "image_alt": next(filter(None, images), "").strip(), "is_image": bool(images) and not text,
        })
    return out


def title_of(found: list[tuple[str | None, object]]) -> str:
    """All text that stands behind a title's start and before the next title's end, with the white space around it."""
    parts, within = [], False
    for name, value in found:
        if name == "title":
            within = value is not None
        elif name is None and within:
            parts.append(value)
    return "".join(parts)


def text_of(html: str | bytes | None) -> str:
    """A page's text; bytes are UTF-8, what is malformed in them becomes U+FFFD."""
    return html.decode("utf-8", "replace") if isinstance(html, bytes) else html or ""


def parse(html: str | bytes | None, base: str | None = None) -> tuple[str, list[dict]]:
    """Title and anchors; with a base, each anchor has the url that it leads to."""
    found = tokens(text_of(html))
    anchors = anchors_of(found)
    for a in anchors:
        place = None if base is None else urls.link_address(base, a["href"])
        a["resolved_url"] = place and place.normal()
        # a numbered host of many parts has no place in a url without its brackets
        a["hostname"] = place.host if place and ":" not in place.host else ""
    return title_of(found).strip(), anchors


def raw_title(html: str | bytes | None) -> str | None:
    """The title as it stands in the page: character references are not decoded, white space stays; null of no page."""
    return None if html is None else title_of(tokens(text_of(html).replace("&", "&amp;")))


def parsed(pages: DataFrame, html: str, keep: list[str], base: str | None = None, anchors: bool = True, raw: bool = False) -> DataFrame:
    """The kept columns of pages, with ``title`` and the array ``anchors``; their urls if a base column is named. The
    page is a column of text or of bytes. raw: titles alone, as they stand in the page (``raw_title``)."""
    anchors = anchors and not raw
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("title", T.StringType())])
    if anchors:
        schema = schema.add(T.StructField("anchors", T.ArrayType(T.StructType.fromDDL(f"a {LINK}")["a"].dataType)))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
            at = 0
            while at < batch.num_rows:  # few pages at once, and few bytes
                end, held = at + 1, size[at]
                while end < min(batch.num_rows, at + 500) and held + size[end] <= MOST_BYTES:
                    held += size[end]
                    end += 1
                part, at = batch.slice(at, end - at), end
                texts, bases = part.column(part.num_columns - 1).to_pylist(), part.column(part.num_columns - 2).to_pylist()
                found = [(raw_title(t), None) for t in texts] if raw else list(map(parse, texts, bases))
                columns = [c.cast(f.type) for c, f in zip(part.columns[:-2], arrow, strict=False)]
                columns.append(pa.array([f[0] for f in found], pa.string()))
                if anchors:
                    columns.append(pa.array([f[1] for f in found], arrow.field("anchors").type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    if pages.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MOST_BYTES))
    return pages.select(*keep, F.lit(None).cast("string").alias("_base") if base is None else F.col(base).alias("_base_url"), F.col(html).alias("_html")).mapInArrow(run, schema)


def page_links(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each link that resolves: the kept columns, position, href, url, host, text, alt, rel, type."""
    rows = parsed(pages, html, list(dict.fromkeys((*keep, url))), base=url)
    rows = rows.select("*", F.inline("anchors")).drop("anchors").where("resolved_url is not null and hostname <> ''")
    return rows.withColumn("link_type", classify_rel(F.col("rel")))
