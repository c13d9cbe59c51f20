"""Benchmark decontamination: windows of words from test items, found in training texts.

The windows go to every executor as sorted hashes with the items' word ids; a text's words become ids of the
same vocabulary, candidate windows are looked up by hash and then compared word by word. The benchmark is
measured first: beyond ``BLOCK_BYTES`` it is cut into blocks of about that size. The hashes alone of the windows of many
blocks, up to ``FILTER_BYTES``, then go to every executor first; the texts that have one of them, which are few, are
written to a table, and only they are held against the blocks, one block at a time, word by word. The blocks' findings
meet by text. An item that is larger than a block stays whole.

Defined cases: a null or empty text has no words and is clean; an item without words or with a null id has no
windows; items that share an id count once; an empty benchmark leaves everything clean; repeated documents
each get their row; columns of the input other than ``doc_id`` and ``text`` are ignored by the report and kept
by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm._common import ITEM_WORDS, WordHashes, edit_rows, item_words, kept_in_worker, map_batches, mix, stored, utf8, window_hashes

#: Bytes of item texts that are broadcast at once; a block's words and windows take about ten times this.
BLOCK_BYTES = 8 << 20
#: Bytes of window hashes that are broadcast at once, eight for each window.
FILTER_BYTES = 64 << 20

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Windows:
    """The windows of some items: ``words[i:i+n]`` for each sorted hash of each length n."""

    def __init__(self, items: list[tuple[object, str | None]], n: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({str(i) for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.items)}
        stream: list[int] = []
        starts: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = item_words(text)
            if item_id is None or not words:
                continue
            size = min(n, len(words))
            for k in range(len(words) - size + 1):
                starts.setdefault(size, []).append((len(stream) + k, number[str(item_id)]))
            stream += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
        self.stream = np.array(stream, np.int32)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, pairs in starts.items():
            at, item = np.array(pairs).T
            h = self._hash(self.stream, at, size)
            order = np.argsort(h, kind="stable")
            h, at, item = h[order], at[order], item[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            self.lengths[size] = (h[first], np.r_[first, len(h)], at, item)

    @staticmethod
    def _hash(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        whole = window_hashes(mix(ids.astype(np.uint64)), size)
        return whole[at]

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of words by text, where each text's words start, whether each word is hit (texts end to end,
        one gap after each), and the distinct pairs (text, item)."""
        get = self.vocabulary.get
        parts, sizes = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = item_words(text)
            sizes[k] = len(words)
            ids = np.zeros(len(words) + 1, np.int32)
            ids[:-1] = np.fromiter(map(get, words, _zeros()), np.int32, len(words))
            parts.append(ids)
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        begin = np.r_[0, np.cumsum(sizes + 1)]
        cover = np.zeros(len(ids) + 1, np.int32)
        found: list[np.ndarray] = []
        gaps = np.flatnonzero(ids == 0)
        ahead = (np.repeat(gaps, np.diff(np.r_[-1, gaps])) - np.arange(len(ids))) if len(ids) else ids
        for size, (hashes, group, at, item) in self.lengths.items():
            here = np.flatnonzero(ahead >= size)  # known words only from here on
            if not len(here):
                continue
            h = self._hash(ids, here, size)
            near = np.searchsorted(hashes, h)
            near[near == len(hashes)] = 0
            match = hashes[near] == h
            here, near = here[match], near[match]
            span = np.arange(size)
            true = np.ones(len(here), bool)
            for k in range(0, len(here), 100_000):  # word by word
                part = slice(k, k + 100_000)
                true[part] = (ids[here[part, None] + span] == self.stream[at[group[near[part]]][:, None] + span]).all(1)
            here, near = here[true], near[true]
            np.add.at(cover, here, 1)
            np.add.at(cover, here + size, -1)
            text = np.searchsorted(begin, here, "right") - 1
            for t, w in np.unique(np.stack([text, near], 1), axis=0) if len(here) else ():
                who = np.unique(item[group[w] : group[w + 1]])
                found.append(np.stack([np.full(len(who), t), who], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return sizes, begin, np.cumsum(cover[:-1]) > 0, pairs


def _zeros():
    while True:
        yield 0


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _hits(windows: Windows, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """By text: number of words, positions of hit words, ids of items."""
    sizes, begin, hit, pairs = windows.find(texts)
    places = [np.flatnonzero(hit[a : a + n]) for a, n in zip(begin, sizes, strict=False)]
    items: list[list[str]] = [[] for _ in texts]
    for t, i in pairs:
        items[t].append(windows.items[i])
    return sizes, places, items


Rows = list[tuple[object, str | None]]


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Callable[[int], Rows]]:
    """The number of blocks of bounded size, and what gives a block's items."""
    sized = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    count = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))

    def items(b: int) -> Rows:
        return [(r[0], r[1]) for r in (sized.where(block == b) if count > 1 else sized).collect()]

    return count, items


class Suspects:
    """Hashes of windows by their length, over words' own hashes; says which texts have one of them."""

    def __init__(self, n: int) -> None:
        self.n, self.hashes = n, {}

    def add(self, items: Rows) -> Suspects:
        known, found = WordHashes(), {}
        for item_id, text in items:
            h = known.of(item_words(text)) if item_id is not None else ()
            if len(h):
                found.setdefault(min(self.n, len(h)), []).append(window_hashes(h, min(self.n, len(h))))
        for size, parts in found.items():
            self.hashes[size] = np.unique(np.concatenate([*parts, self.hashes.get(size, np.empty(0, np.uint64))]))
        return self

    @property
    def bytes(self) -> int:
        return sum(h.nbytes for h in self.hashes.values())

    def among(self, texts: list[str | None]) -> np.ndarray:
        known = kept_in_worker("words", WordHashes)
        out = np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            h = known.of(item_words(text))
            for size, hashes in self.hashes.items():
                w = window_hashes(h, size)
                out[k] |= bool(len(w)) and bool((hashes[np.minimum(np.searchsorted(hashes, w), len(hashes) - 1)] == w).any())
        return out


def _groups(count: int, items: Callable[[int], Rows], n: int) -> Iterator[tuple[Suspects, list[int]]]:
    """Blocks whose windows' hashes are broadcast together."""
    suspects, blocks = Suspects(n), []
    for b in range(count):
        suspects.add(items(b))
        blocks.append(b)
        if suspects.bytes >= FILTER_BYTES:
            yield suspects, blocks
            suspects, blocks = Suspects(n), []
    if blocks:
        yield suspects, blocks


def _found(docs: DataFrame, count: int, items_of: Callable[[int], Rows], n: int) -> DataFrame:
    """(key, places, items) of each different text that a window of some block hits: a row of places for each block."""
    spark, texts, sources = docs.sparkSession, docs.select("text").where("text is not null"), []
    for suspects, blocks in _groups(count, items_of, n):
        shared = spark.sparkContext.broadcast(suspects)
        some = edit_rows(texts, "text", lambda t, shared=shared: (shared.value.among(t), {})).distinct()
        some = stored(some.withColumn("key", F.sha2("text", 256)), "suspects")
        for block in blocks:
            windows = spark.sparkContext.broadcast(Windows(items_of(block), n))

            def partial(cols, windows=windows):
                _, places, items = _hits(windows.value, cols["text"])
                hit = [k for k, p in enumerate(places) if len(p)]
                yield {
                    "key": [cols["key"][k] for k in hit], "places": [places[k].astype("<i4").tobytes() for k in hit],
                    "items": [items[k] for k in hit],
                }

            sources.append(stored(map_batches(some, partial, "key string, places binary, items array<string>"), "hits"))
    hits = sources[0]
    for more in sources[1:]:
        hits = hits.unionByName(more)
    return hits.groupBy("key").agg(F.collect_list("places").alias("places"), F.flatten(F.collect_list("items")).alias("items"))


def _places(parts: list[bytes] | None) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(b, "<i4") for b in parts])) if parts else np.empty(0, np.int32)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: its words, how many are hit, and a digest of the items that hit it."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count, items_of = _blocks(benchmark, block_bytes)
    if count == 1:
        shared = spark.sparkContext.broadcast(Windows(items_of(0), n))

        def report(cols):
            sizes, places, items = _hits(shared.value, cols["text"])
            yield {
                "doc_id": cols["doc_id"], "n_words": sizes, "n_hit": [len(p) for p in places],
                "n_items": [len(x) for x in items], "items_sha256": [_digest(x) for x in items],
                "contaminated": [len(p) > 0 for p in places],
            }

        return map_batches(docs, report, REPORT)
    merged = _found(docs, count, items_of, n)

    def joined(cols):
        places = [_places(p) for p in cols["places"]]
        items = [sorted(set(x or ())) for x in cols["items"]]
        yield {
            "doc_id": cols["doc_id"], "n_words": [len(item_words(t)) for t in cols["text"]],
            "n_hit": [len(p) for p in places], "n_items": [len(x) for x in items],
            "items_sha256": [_digest(x) for x in items], "contaminated": [len(p) > 0 for p in places],
        }

    found = docs.withColumn("key", F.sha2("text", 256)).join(merged, "key", "left")
    return map_batches(found.select("doc_id", "text", "places", "items"), joined, REPORT)


def _cut(text: str, places: np.ndarray) -> str:
    """text without its words at these places and what stands between neighbours among them."""
    raw = utf8(text)
    spans = [m.span() for m in _WORD.finditer(raw.translate(ITEM_WORDS))]
    out, at = [], 0
    for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
        out.append(raw[at : spans[run[0]][0]])
        at = spans[run[-1]][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents with all their columns, without those that hold a window (``remove="documents"``) or with
    the hit words cut from the text (``remove="spans"``)."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    count, items_of = _blocks(benchmark, block_bytes)
    if count == 1:  # narrow: no shuffle
        shared = docs.sparkSession.sparkContext.broadcast(Windows(items_of(0), n))

        def edit(texts):
            return _edited(texts, _hits(shared.value, texts)[1], remove)

        return edit_rows(docs, "text", edit)
    names = docs.columns
    own = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names of the input cannot clash with ours
    text = F.col(f"c{names.index('text')}")
    found = _found(own.select(text.cast("string").alias("text")), count, items_of, n)
    own = own.withColumn("_key", F.sha2(text.cast("string"), 256)).join(found.select(F.col("key").alias("_key"), "places"), "_key", "left")
    if remove == "documents":
        own = own.where("places is null")
    else:
        own = own.withColumn(f"c{names.index('text')}", F.when(F.col("places").isNull(), text).otherwise(_cut_all(text, F.col("places"))))
    return own.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))


@F.pandas_udf(T.StringType())
def _cut_all(texts: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([t if p is None else _cut(t, _places(list(p))) for t, p in zip(texts, places, strict=True)], dtype="object")


def _edited(texts: list[str | None], places: list[np.ndarray], remove: str) -> tuple[np.ndarray | None, dict[str, list]]:
    if remove == "documents":
        return np.array([len(p) == 0 for p in places], bool), {}
    return None, {"text": [_cut(t, p) if len(p) else t for t, p in zip(texts, places, strict=True)]}
