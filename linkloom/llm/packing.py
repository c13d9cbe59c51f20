"""Packing documents into training sequences of one window, by non-negative least squares.

Texts become token ids once, in a written table. A document's whole windows stand alone; what is left of it has
a length below the window. Those lengths' histogram, over all documents, is solved for: shallow combinations of
length classes that fill a window are enumerated, non-negative least squares finds how often to use each, and
every task realises its share of that plan on the documents it holds, in buffers of bounded size: repeat counts
are rounded down to what the buffer has, the rest is packed greedily, whole where it fits and cut where it does
not. What is still open passes to the task's next buffer; at its end the last tokens go into sequences whose
lengths are powers of two. So no sequence needs padding.

Defined cases: a null text is an empty one, which is the end id alone; repeated documents, null ids among them,
are packed once for each row; a document longer than the window is cut; an empty table gives no pieces; other
columns are ignored, whatever their names. A sequence lies within one task, so its id does too: the task's number
times 2**33, and a count.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from linkloom.llm._common import kept_in_worker, map_arrow, slices, stored

WINDOW, END = 4096, 2
CLASSES, DEPTH = 32, 6
#: Tokens that a task holds before it packs them.
BUFFER = 4 << 20
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)

SEQUENCES = "sequence_id long, input_ids array<int>, doc_ids array<long>, lengths array<long>"
#: Tokens of pieces that a task gives at once.
BATCH_TOKENS = 1 << 20

#: A chunk of letters below U+0180, each with one lower case and its own normal form, and of marks behind them.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = rf"^(?P<word>[{_LETTERS}]+)(?P<marks>[!-/:-@\[-`{{-~]*)$"
# fixed values: how a tokenizer must be defined for its texts to be cut at spaces and its words to be encoded apart
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_WORDS = [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _by_word(definition: dict) -> bool:
    """Whether the tokenizer drops white space, never looks across it, ignores case and encodes each of the words
    that ``_SPLIT`` finds alone, by merges of bytes up to a last token with an ending of its own."""
    model, steps = definition["model"], definition.get("normalizer") or {}
    return (
        steps.get("normalizers") == _NORMAL
        and (definition.get("pre_tokenizer") or {}).get("pretokenizers") == _WORDS
        and model["type"] == "BPE"
        and bool(model.get("end_of_word_suffix"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        and not any(definition.get(k) for k in ("truncation", "padding"))
        and all(t["special"] and t["content"].startswith("<|") for t in definition["added_tokens"])
    )


def _byte_letters() -> np.ndarray:
    """By byte the letter that stands for it in a byte-level vocabulary: itself if it can be shown, else the next
    from U+0100 on. The space stays, as words are parted by it."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, following = np.arange(256, dtype="<u2"), 0x100
    for b in range(256):
        if b not in shown:
            letters[b], following = following, following + 1
    letters[0x20] = 0x20
    return letters


class Encoder:
    """Texts to ids, a batch at a time. A chunk is what stands between two spaces; where the definition allows it,
    a batch's different chunks are looked up in a table that the worker keeps, the words of new ones are encoded many at
    a time, and the batch's ids are gathered from the table. Other tokenizers encode whole texts."""

    #: Chunks that the table holds, or those of one batch if these are more; about 40 bytes each.
    LIMIT = 400_000
    #: Words that are encoded as one text.
    GROUP = 200

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.whole = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        self.kind = np.dtype("<u2" if (size := self.whole.get_vocab_size()) <= 1 << 16 else "<u4")
        self.words = None
        if _by_word(parts):
            model, suffix = parts["model"], parts["model"]["end_of_word_suffix"]
            merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
            bare = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix, cache_capacity=0)
            self.words = Tokenizer(bare)
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.letters = _byte_letters()
            self.last = np.zeros(size, bool)
            for token, number in model["vocab"].items():
                self.last[number] = token.endswith(suffix)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat = np.empty(0, self.kind)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and the number of them, of words without spaces."""
        length = pc.binary_length(words).to_numpy()
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_buffer()
        shown = self.letters[np.frombuffer(text, np.uint8)]
        edges = np.r_[0, np.cumsum(length + 1)][:: self.GROUP].tolist() + [len(shown) + 1]
        groups = [shown[a : b - 1].tobytes().decode("utf-16-le") for a, b in pairwise(edges)]
        ids = []
        for k in range(0, len(groups), 100):
            found = self.words.encode_batch_fast(groups[k : k + 100], add_special_tokens=False)
            ids.append(np.fromiter(chain.from_iterable(e.ids for e in found), self.kind))
        ids = np.concatenate([*ids, np.empty(0, self.kind)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not end each word with a token of its own")
        return ids, np.diff(ends, prepend=0)

    def _learn(self, chunks: pa.Array) -> None:
        """Puts new chunks in the table: a word and marks each, or what the whole tokenizer makes of them."""
        parts = pc.extract_regex(chunks, _PLAIN)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        parts = parts.filter(pa.array(plain))
        words = pc.utf8_lower(parts.field("word")).dictionary_encode()
        marks = parts.field("marks").dictionary_encode()
        some = pc.not_equal(marks.dictionary, "")
        ids, count = self._encoded(pa.concat_arrays([words.dictionary, marks.dictionary.filter(some)]))
        others = chunks.filter(pa.array(~plain)).to_pylist()
        found = [e.ids for e in self.whole.encode_batch_fast(others, add_special_tokens=False)] if others else []
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), self.kind)])
        count = np.concatenate([count, np.fromiter(map(len, found), np.int64, len(found)), [0]])
        some = some.to_numpy(zero_copy_only=False)
        mark = np.where(some, len(words.dictionary) + np.cumsum(some) - 1, len(count) - 1)
        part = np.full((len(chunks), 2), len(count) - 1)
        part[plain, 0] = words.indices.to_numpy()
        part[plain, 1] = mark[marks.indices.to_numpy()]
        part[~plain, 0] = len(count) - 1 - len(others) + np.arange(len(others))
        own, n = _gathered(ids, np.cumsum(count) - count, count, part.ravel())
        n = n.reshape(-1, 2).sum(1)
        self.known = pa.concat_arrays([self.known, chunks])
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(n) - n])
        self.count = np.concatenate([self.count, n.astype(np.int32)])
        self.flat = np.concatenate([self.flat, own])

    def _places(self, chunks: pa.Array) -> np.ndarray:
        at = pc.index_in(chunks, value_set=self.known)
        new = chunks.filter(pc.is_null(at))
        if not len(new):
            return at.to_numpy()
        if len(self.known) + len(new) > self.LIMIT:
            self._forget()
            self._learn(chunks)
            return np.arange(len(chunks))
        at, before = pc.fill_null(at, -1).to_numpy().copy(), len(self.known)
        self._learn(new)
        at[at < 0] = before + np.arange(len(new))
        return at

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids end to end, and each text's number of them; null is the empty text."""
        texts = pc.fill_null(texts, "")
        if self.words is None:
            found = [e.ids for e in self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), self.kind), np.array([len(x) for x in found], np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        codes = split.flatten().dictionary_encode()
        at = self._places(codes.dictionary)[codes.indices.to_numpy()]
        ids, n = _gathered(self.flat, self.first, self.count, at)
        ends = np.r_[0, np.cumsum(n)][np.cumsum(pc.list_value_length(split).to_numpy())]
        return ids, np.diff(ends, prepend=0)


def _gathered(flat: np.ndarray, first: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[first[k] : first[k] + count[k]]`` for each k of at, end to end, and their lengths."""
    n = count[at]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - ends + n, n)], n


def tokens(docs: DataFrame, tokenizer_path: str, end: int = END) -> DataFrame:
    """doc_id, ids (little-endian, two or four bytes each, with the end id), n, width."""
    with open(tokenizer_path, encoding="utf-8") as f:  # a file of the driver's machine, of a few MB
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, ids binary, n long, width int"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(("encoder", hash(shared.value)), lambda: Encoder(shared.value))
        for batch in batches:
            for part in slices(batch, "text"):
                ids, n = encoder.ids(part.column("text"))
                ids = np.insert(ids, np.cumsum(n), np.array(end, ids.dtype))
                n, width = n + 1, ids.itemsize
                edges = np.r_[0, np.cumsum(n * width)].astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                columns = [part.column("doc_id"), binary, pa.array(n), pa.array(np.full(len(n), width, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(docs, run, schema)


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 500) -> np.ndarray:
    """The x >= 0 that makes |ax - b| least, by active sets."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(steps):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        if not len(slope) or slope.max() <= 1e-9 * scale:
            break
        active[slope.argmax()] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (s[active] > 0).all():
                x = s
                break
            below = active & (s <= 0)
            step = float((x[below] / np.maximum(x[below] - s[below], 1e-300)).min())
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


def combinations(classes: int = CLASSES, depth: int = DEPTH) -> np.ndarray:
    """How many items of each class 1..classes, in all at most depth, fill a window of that many classes."""
    found = []

    def extend(left: int, most: int, chosen: list[int]) -> None:
        if left == 0:
            found.append(np.bincount(chosen, minlength=classes + 1)[1:])
        elif len(chosen) < depth:
            for c in range(min(left, most), -(-left // (depth - len(chosen))) - 1, -1):
                extend(left - c, c, [*chosen, c])

    extend(classes, classes, [])
    return np.array(found)


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[tuple[int, ...], float]], float]:
    """Combinations with repeat counts, most used first, and the number of documents that the counts are for."""
    width = window / CLASSES
    b = np.zeros(CLASSES)
    for length, count in histogram.items():
        if 0 < length < window:
            b[int(np.ceil(length / width)) - 1] += count
    patterns = combinations()
    x = nnls(patterns.T.astype(float), b / max(1.0, b.sum()))
    order = [k for k in np.argsort(-x, kind="stable") if x[k] > 0]
    return [(tuple(np.repeat(np.arange(CLASSES), patterns[k]).tolist()), float(x[k])) for k in order], float(b.sum())


class Packer:
    """Packs one task's documents; a piece is (doc, start, length) with doc = (doc_id, ids, n). Gives pieces as (doc_id,
    start, length, the piece's ids, n, sequence, offset), those of a sequence one after the other."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], float]], window: int, task: int) -> None:
        self.patterns, self.window, self.next = patterns, window, task << 33
        self.open: list[tuple[tuple, int, int]] = []
        self.held = 0

    def _emit(self, pieces: list[tuple[tuple, int, int]]) -> Iterator[tuple]:
        offset, sequence = 0, self.next
        self.next += 1
        for (doc_id, ids, n), start, length in pieces:
            yield doc_id, start, length, ids[start : start + length], n, sequence, offset
            offset += length

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        doc, w = (doc_id, ids, len(ids)), self.window
        for start in range(0, len(ids) - w + 1, w):
            yield from self._emit([(doc, start, w)])
        if rest := len(ids) % w:
            self.open.append((doc, len(ids) - rest, rest))
            self.held += len(ids)
            if self.held >= BUFFER:
                yield from self._pack()

    def _pack(self) -> Iterator[tuple]:
        """All that is open goes into full sequences, but for less than one window."""
        w, width = self.window, self.window / CLASSES
        classes: list[list] = [[] for _ in range(CLASSES)]
        for piece in self.open:
            classes[int(np.ceil(piece[2] / width)) - 1].append(piece)
        share, bins = len(self.open), []
        for pattern, times in self.patterns:
            need = {c: pattern.count(c) for c in pattern}
            for _ in range(min(int(times * share), *(len(classes[c]) // k for c, k in need.items()))):
                bins.append([classes[c].pop() for c in pattern])
        rest = sorted((p for c in classes for p in c), key=lambda p: -p[2])
        gaps = sorted((w - sum(p[2] for p in b), k) for k, b in enumerate(bins))
        cut = []
        for piece in rest:  # whole into the tightest gap that takes it
            at = bisect_left(gaps, (piece[2], -1))
            if at == len(gaps):
                cut.append(piece)
                continue
            gap, k = gaps.pop(at)
            bins[k].append(piece)
            insort(gaps, (gap - piece[2], k))
        full = {k for g, k in gaps if g == 0}
        for k in sorted(full):
            yield from self._emit(bins[k])
        gaps = [g for g in gaps if g[0]]  # smallest last: the widest are taken apart to fill the others
        gaps.reverse()
        while gaps:
            gap, k = gaps.pop()
            while gap:
                if not cut:
                    if not gaps:
                        break
                    cut += bins[gaps.pop(0)[1]]
                doc, start, length = cut.pop()
                take = min(gap, length)
                bins[k].append((doc, start, take))
                gap -= take
                if length > take:
                    cut.append((doc, start + take, length - take))
            if gap:
                cut = bins[k]
            else:
                yield from self._emit(bins[k])
        total, one = sum(p[2] for p in cut), []
        while total >= w:
            one, gap = [], w
            while gap:
                doc, start, length = cut.pop()
                take = min(gap, length)
                one.append((doc, start, take))
                gap -= take
                if length > take:
                    cut.append((doc, start + take, length - take))
            yield from self._emit(one)
            total -= w
        self.open, self.held = cut, sum(p[0][2] for p in cut)

    def close(self) -> Iterator[tuple]:
        if self.open:
            yield from self._pack()
        total = sum(p[2] for p in self.open)
        while total:
            gap, one = 1 << (total.bit_length() - 1), []
            total -= gap
            while gap:
                doc, start, length = self.open.pop()
                take = min(gap, length)
                one.append((doc, start, take))
                gap -= take
                if length > take:
                    self.open.append((doc, start + take, length - take))
            yield from self._emit(one)


def _packed(docs: DataFrame, tokenizer_path: str, window: int, end: int, schema: str, shown) -> DataFrame:
    """What ``shown`` makes of the pieces of each task, a list of them at a time that ends with a sequence."""
    table = stored(tokens(docs, tokenizer_path, end), "tokens")
    left = F.col("n") % window
    histogram = {r[0]: r[1] for r in table.groupBy(left.alias("left")).count().collect()}  # at most window rows
    shared = table.sparkSession.sparkContext.broadcast(plan(histogram, window)[0])
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch(pieces: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*shown(pieces), strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out, held = Packer(shared.value, window, TaskContext.get().partitionId()), [], 0
        for b in batches:
            for doc_id, ids, width in zip(*(b.column(c) for c in ("doc_id", "ids", "width")), strict=True):
                for piece in packer.add(doc_id.as_py(), np.frombuffer(ids.as_py(), f"<u{width.as_py()}")):
                    if held >= BATCH_TOKENS and piece[6] == 0:
                        yield batch(out)
                        out, held = [], 0
                    out.append(piece)
                    held += piece[2]
        out += packer.close()
        yield batch(out)

    return map_arrow(table.select("doc_id", "ids", "width"), run, schema)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each piece of a document: where it lies in the document and in its sequence, and a checksum."""

    def shown(pieces):
        return [(d, start, n, zlib.crc32(ids.astype("<u4").tobytes()), whole, s, at) for d, start, n, ids, whole, s, at in pieces]

    return _packed(docs, tokenizer_path, window, end, PIECES, shown)


def sequences(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each sequence, to be written and trained on: its ids, and the documents and lengths of its pieces in
    their order. A sequence has window ids, or fewer by a power of two at the end of a task."""

    def shown(pieces):
        for number, group in groupby(pieces, key=lambda p: p[5]):
            own = list(group)
            yield number, np.concatenate([p[3] for p in own]).astype(np.int32), [p[0] for p in own], [p[2] for p in own]

    return _packed(docs, tokenizer_path, window, end, SEQUENCES, shown)
