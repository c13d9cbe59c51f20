"""Stupid-backoff scores, computed relationally.

Documents are gathered into chunks of bounded size, in a written table: a chunk has its texts' words as numbers
of its own vocabulary. Each chunk asks for the n-grams that it holds, each once with its count there: that is the
exploded n-grams, summed before any shuffle, so that the most frequent n-gram of the corpus is one entry a chunk.
The entries are partitioned by the n-gram's hash, where the chunks' counts sum up to the corpus's count table,
and go back to their chunks; there a document's scores are summed. Counts are over all documents.

S(w | context) is count(context w) / count(context) where that count reaches ``min_count``, else ``BACKOFF`` times
S with a context shorter by one word, down to count(w) / words of the corpus. Each text is preceded by order - 1
start marks and has no end mark; its score is the mean of log S over its words.

Defined cases: a null or empty text has no words, no score (null) and adds nothing to the counts; repeated
documents count each time and get a row each; an empty table gives an empty result; a text larger than a chunk
is cut into pieces, each with the words before it as context, whose sums meet at the end; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from linkloom.llm._common import WordHashes, kept_in_worker, map_arrow, mix, stored, utf8

ORDER, MIN_COUNT, BACKOFF = 2, 2, 0.4
#: Words in a chunk; its arrays take about 100 bytes a word while it is scored.
CHUNK_WORDS = 1 << 20
#: Entries that one task of the count table holds.
PART_ENTRIES = 2 << 20
#: An entry's hash is its place among 256 classes of its part, and this many bytes.
LOW_BYTES = 6

CHUNKS = "chunk long, doc_ids array<long>, pieces binary, vocabulary binary, words binary, n long"
SCORES = "piece long, doc_id long, n long, log double"


def _squeeze(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    width = 4 if not len(numbers) or numbers.max() < 1 << 32 else 8
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unsqueeze(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel().astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


#: A piece of a text: its row's number, words of context, words of its own, the place of its first own word.
PIECE = np.dtype([("row", "<i8"), ("context", "<u4"), ("own", "<u4"), ("start", "<i8")])


def chunks(docs: DataFrame, context: int, chunk_words: int | None = None) -> DataFrame:
    """Documents by the chunk: ids, pieces, word hashes, and the words as numbers of these. A text's further pieces begin
    with ``context`` words of the one before."""
    arrow, most = to_arrow_schema(T.StructType.fromDDL(CHUNKS)), chunk_words or CHUNK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        number, row, ids, hashes, pieces, held = first, first, [], [], [], 0
        known = kept_in_worker("words", WordHashes)

        def close() -> pa.RecordBatch:
            vocabulary, words, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            often = np.argsort(-count, kind="stable")  # frequent words get small numbers, which take little room
            vocabulary, words = vocabulary[often], np.argsort(often)[words]
            own = np.array(pieces, PIECE)
            out = [number], [ids], [own.tobytes()], [vocabulary.tobytes()], [_squeeze(words)], [int(own["own"].sum())]
            return pa.RecordBatch.from_pydict(dict(zip(arrow.names, out, strict=True)), schema=arrow)

        for batch in batches:
            for k in range(batch.num_rows):
                h = known.of(words_of(batch.column(1)[k].as_py()))
                for at in range(0, max(1, len(h)), most):
                    before, size = min(at, context), min(len(h) - at, most)
                    if held and held + size > most:
                        yield close()
                        number, ids, hashes, pieces, held = number + 1, [], [], [], 0
                    ids.append(batch.column(0)[k].as_py())
                    hashes.append(h[at - before : at + size])
                    pieces.append((row, before, size, at))
                    held += size
                row += 1
        if ids:
            yield close()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, run, CHUNKS)


class Chunk:
    """The n-grams of a chunk: for each order their hashes, sorted, and where each word's n-gram is among them."""

    def __init__(self, pieces: bytes, vocabulary: bytes, words: bytes, order: int) -> None:
        self.pieces = np.frombuffer(pieces, PIECE)
        context, own = self.pieces["context"].astype(np.int64), self.pieces["own"].astype(np.int64)
        vocabulary, words, size = np.frombuffer(vocabulary, np.uint64), _unsqueeze(words), context + own
        inside = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
        self.piece = np.repeat(np.arange(len(size)), size)
        self.own = inside >= np.repeat(context, size)  # others are context alone
        self.place = inside + np.repeat(self.pieces["start"] - context, size)  # in its text
        h = mix(vocabulary ^ np.uint64(0x5DEECE66D))[words]
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        whole = np.zeros(len(h), np.uint64)
        start = mix(np.array([0xABCDEF], np.uint64))[0]
        times = np.uint64(0x9E3779B97F4A7C15)
        for n in range(order):  # the word n places back, or a start mark
            back = np.full(len(h), start, np.uint64)
            if n < len(h):
                back[n:] = np.where(self.place[n:] >= n, h[: len(h) - n] if n else h, start)
            whole = mix(whole * times + back + np.uint64(n))
            keys, at = np.unique(whole, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.at[n], weights=self.own, minlength=len(self.keys[n])).astype(np.int64)


def _batch(arrow: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    values = zip(*rows, strict=True) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)


ASKED = "part int, chunk long, n int, keys binary, counts binary"
TOLD = "chunk long, n int, part int, counts binary"


def score(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """A row for each document: its words, and the mean and the sum of log S over them."""
    if order < 1 or min_count < 1:
        raise ValueError("order and min_count are 1 at least")
    held = stored(chunks(docs, order - 1), "chunks")
    total = held.agg(F.sum("n")).head()[0] or 0
    parts = max(1, -(-total * order // PART_ENTRIES))
    asked_arrow, told_arrow = (to_arrow_schema(T.StructType.fromDDL(s)) for s in (ASKED, TOLD))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk = Chunk(*body, order)
                for n in range(order):
                    keys, count = chunk.keys[n], chunk.counts(n)
                    place = ((keys >> np.uint64(32)) * np.uint64(parts * 256) >> np.uint64(32)).astype(np.int64)
                    ends = np.searchsorted(place, np.arange(parts + 1) * 256)
                    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES]
                    for p in np.flatnonzero(np.diff(ends)):
                        own = slice(ends[p], ends[p + 1])
                        classes = np.bincount(place[own] - 256 * p, minlength=256).astype("<u4")
                        yield _batch(asked_arrow, [(int(p), number, n, classes.tobytes() + low[own].tobytes(), _squeeze(count[own]))])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of counts by n-gram, for each entry; rows come sorted by part and order."""
        last, rows = None, []

        def answer() -> Iterator[pa.RecordBatch]:
            keys = []
            for _, k, _ in rows:
                low = np.frombuffer(k, np.uint8, offset=1024).reshape(-1, LOW_BYTES)
                wide = np.zeros((len(low), 8), np.uint8)
                wide[:, :LOW_BYTES] = low
                wide[:, LOW_BYTES] = np.repeat(np.arange(256), np.frombuffer(k, "<u4", 256))
                keys.append(wide.view("<u8").ravel())
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.concatenate([_unsqueeze(c) for _, _, c in rows])
            sums = np.bincount(at, weights=count).astype(np.int64)[at]
            ends = np.cumsum([len(k) for k in keys])
            for (chunk, _, _), own in zip(rows, np.split(sums, ends[:-1]), strict=True):
                yield _batch(told_arrow, [(chunk, last[1], last[0], _squeeze(own))])

        for batch in batches:
            for part, chunk, n, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, n) != last:
                    if rows:
                        yield from answer()
                    last, rows = (part, n), []
                rows.append((chunk, keys, counts))
        if rows:
            yield from answer()

    body = held.select("chunk", "pieces", "vocabulary", "words")
    asked = map_arrow(body, ask, ASKED)
    told = map_arrow(asked.repartition(parts, "part").sortWithinPartitions("part", "n", "chunk"), tell, TOLD)
    answers = told.groupBy("chunk").agg(F.collect_list(F.struct("n", "part", "counts")).alias("answers"))
    scored_arrow = to_arrow_schema(T.StructType.fromDDL(SCORES))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                chunk = Chunk(row["pieces"], row["vocabulary"], row["words"], order)
                found: list[np.ndarray] = []
                for n in range(order):
                    own = sorted((a["part"], a["counts"]) for a in row["answers"] or () if a["n"] == n)
                    parts_ = [_unsqueeze(c).astype(np.float64) for _, c in own]
                    found.append(np.concatenate([*parts_, np.empty(0)])[chunk.at[n]])
                logs = np.log(found[0] / max(total, 1))
                for n in range(1, order):
                    # the context's count: that of the n-gram that ends one word earlier; before a text's first
                    # word stand start marks alone, as often as there are texts with a word
                    context = np.r_[0.0, found[n - 1][:-1]]
                    context[chunk.place == 0] = starts
                    hit = found[n] >= min_count
                    with np.errstate(divide="ignore"):
                        own = np.log(found[n]) - np.log(context)
                    logs = np.where(hit, own, np.log(backoff) + logs)
                summed = np.bincount(chunk.piece, weights=np.where(chunk.own, logs, 0.0), minlength=len(chunk.pieces))
                own = chunk.pieces
                yield _batch(scored_arrow, list(zip(own["row"].tolist(), row["doc_ids"], own["own"].tolist(), summed.tolist(), strict=True)))

    starts = _texts_with_words(held)
    body = held.select("chunk", "doc_ids", "pieces", "vocabulary", "words")
    scored = map_arrow(body.join(answers, "chunk", "left"), sums, SCORES)
    scored = scored.groupBy("piece").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_words"), F.sum("log").alias("log"))
    some = F.col("n_words") > 0
    return scored.select("doc_id", "n_words", F.when(some, F.col("log") / F.col("n_words")).alias("score"), F.when(some, F.col("log")).alias("log_score"))


def _texts_with_words(held: DataFrame) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = (np.frombuffer(b, PIECE) for b in batch.column(0).to_pylist())
            n = sum(int(((p["own"] > 0) & (p["start"] == 0)).sum()) for p in pieces)
            yield pa.RecordBatch.from_pydict({"n": [n]}, schema=pa.schema([("n", pa.int64())]))

    return held.select("pieces").mapInArrow(count, "n long").agg(F.sum("n")).head()[0] or 0
