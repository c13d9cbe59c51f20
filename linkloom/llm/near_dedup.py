"""MinHash near-dedup: a chosen-path set similarity join, then components of the links that it confirms.

Each different text has ``VALUES`` minhash values. A tree starts with all texts at its root. A node chooses, by a hash of
its own path, one of the values, or now and then two, so that ``1 / threshold`` are chosen on average; a text goes to the child
that its own value there names. So a pair at the threshold stays together on one path on average, and dissimilar texts
soon part. The first ``START`` levels need nothing but a text's own values, and so no shuffle. Nodes that are small then are compared
exhaustively, on full sets of shingles, in blocks of ``BLOCK_WEIGHT``, each with each. Of a node of more than ``NODE_BLOCKS`` blocks
each block is compared alone; if its texts are still in several components, it branches again, ``STEP`` levels at once, and what is
large at level ``DEEPEST`` is compared exhaustively too. Trees are independent; there are as many as it takes to find the ``TARGET`` share of pairs
exactly at the threshold, at the deepest level that was reached (``needed``).

Only components are wanted, so texts that are in one already are not compared again: within a task by union and find,
and between trees by components of all links so far: a node whose texts are all in one component is left out, as is one with
the same texts as another. Of the links that it confirmed a task hands on a star for each new component, between the roots of
those that it joins. Equal texts are one node.

Defined cases: null is the empty text; a text without words has no shingles, is linked with nothing and is its own
component; one of one to four words has one shingle, all its words; copies of a text with words are linked; a component's id
is its least doc_id, null if it has none; repeated rows are kept alike; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm._common import (
    WordHashes, discard, hashed, kept_in_worker, map_arrow, map_batches, mix, stored, utf8, window_hashes,
)
from linkloom.llm.near_duplicates import _shared, components, text_key

WORDS, THRESHOLD = 5, (17, 20)
VALUES, START, STEP, DEEPEST, TARGET = 128, 4, 3, 10, 0.9999
#: Trees whose links are looked for before components are first known.
FIRST = 4
#: Shingles in a block, each text counting TEXT_WEIGHT more.
BLOCK_WEIGHT, TEXT_WEIGHT = 400_000, 400
#: Blocks of a node that is small.
NODE_BLOCKS = 8
#: A node chooses a second value with this chance of 2^20.
SECOND = round((THRESHOLD[1] / THRESHOLD[0] - 1) * (1 << 20))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; words are parted by ASCII white space, A-Z is lower-cased."""
    h = kept_in_worker("words", WordHashes).of(utf8(text).lower().split())
    return np.unique(window_hashes(h, min(n, len(h)))) if len(h) else h


class Signatures:
    """Two bytes of each of a set's minhash values, end to end."""

    def __init__(self) -> None:
        rng = np.random.default_rng(12)
        self.flip, self.times = rng.integers(0, 1 << 32, (2, VALUES, 1), np.uint32)
        self.times |= np.uint32(1)

    def of(self, h: np.ndarray) -> bytes:
        h = (h >> np.uint64(32)).astype(np.uint32)
        least = np.full(VALUES, np.iinfo(np.uint32).max)
        for k in range(0, len(h), 1000):
            values = h[None, k : k + 1000] ^ self.flip
            values *= self.times
            np.minimum(least, values.min(1), out=least)
        return mix(least.astype(np.uint64)).astype("<u2").tobytes()


def together(share: float, depth: int) -> float:
    """The chance that two texts that share this share of values are at a node of this depth together."""
    out, more = 1.0, SECOND / (1 << 20)
    for _ in range(depth):
        both = share * out
        out = (1 - more) * both + more * (1 - (1 - both) ** 2)
    return out


def needed(depth: int, target: float = TARGET) -> int:
    """Trees that find this share of the pairs at the threshold, if they go so deep."""
    least = THRESHOLD[0] / THRESHOLD[1]
    shares = [(comb(VALUES, k) * least**k * (1 - least) ** (VALUES - k), 1 - together(k / VALUES, depth)) for k in range(VALUES + 1)]
    trees = 1
    while sum(p * miss**trees for p, miss in shares) > 1 - target:
        trees += 1
    return trees


def branched(members: DataFrame) -> DataFrame:
    """Members (.., node, sig) of nodes at those nodes' children."""
    draw = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(VALUES)).cast("int")
    second = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(1 << 20)) < SECOND
    at = F.explode(F.when(second, F.array_distinct(F.array(draw(1), draw(2)))).otherwise(F.array(draw(1)))).alias("_at")
    rows = members.select("*", at)
    return rows.withColumn("node", F.xxhash64("node", "_at", F.substring("sig", 2 * F.col("_at") + 1, F.lit(2)))).drop("_at")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text) of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), text.alias("text"))


def _texts(docs: DataFrame) -> DataFrame:
    """(key, doc_id, n_shingles, sig) of each different text; one without words has no signature."""
    signatures = Signatures()

    def sign(cols):
        sets = [shingles(t) for t in cols["text"]]
        yield {
            "doc_id": cols["doc_id"], "key": cols["key"], "n_shingles": [len(s) for s in sets],
            "sig": [signatures.of(s) if len(s) else None for s in sets],
        }

    rows = map_batches(_rows(docs), sign, "doc_id long, key binary, n_shingles long, sig binary")
    return stored(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "texts")


def _planted(texts: DataFrame, trees: range) -> DataFrame:
    """(tree, node, key, weight) of texts at level ``START`` of these trees."""
    rows = texts.where("sig is not null").select("key", (F.col("n_shingles") + TEXT_WEIGHT).alias("weight"), "sig", F.explode(F.array(*map(F.lit, trees))).alias("tree"))
    rows = rows.withColumn("node", F.xxhash64(F.lit("root"), "tree"))
    for _ in range(START):
        rows = branched(rows)
    return rows.select("tree", "node", "key", "weight")


def _shared_nodes(members: DataFrame) -> DataFrame:
    """Members (tree, node, key, weight) with the node's total weight, of nodes of more than one text; of nodes with the same
    texts one is left. Written."""
    of = [F.count("*").alias("n"), F.sum("weight").alias("total"), *(F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"x{k}") for k in (1, 2))]
    nodes = members.groupBy("tree", "node").agg(*of).where("n > 1")
    nodes = nodes.groupBy("n", "total", "x1", "x2").agg(F.min(F.struct("tree", "node")).alias("f")).select("f.*", "total")
    nodes = stored(nodes, "nodes")
    out = stored(members.join(nodes, ["tree", "node"]).select("tree", "node", "key", "weight", "total"), "members")
    discard(nodes)
    return out


def _apart(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members with their component, of nodes whose texts are in several."""
    if roots is None:
        return members.withColumn("root", F.col("key"))
    members = members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    nodes = members.groupBy("tree", "node").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return members.join(stored(nodes.select("tree", "node"), "several"), ["tree", "node"], "left_semi")


GROUP = ["tree", "node", "i", "j"]
MEMBER = [*GROUP, "key", "root", "block", "text"]
_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _links(i: int, j: int, members: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
    """What the links of one block's texts, or between two blocks, join: (root, least root) of components. members: (key, root of its
    component, block, text)."""
    num, den = THRESHOLD
    members = list({m[0]: m for m in members}.values())  # a text that came more than once
    sets = [shingles(m[3]) for m in members]
    size = np.array([len(s) for s in sets], np.int64)
    block = np.array([m[2] for m in members])
    first: dict[bytes, int] = {}
    top = np.array([first.setdefault(m[1], k) for k, m in enumerate(members)])  # of each text's component
    before = top.copy()
    left, right = (b[np.argsort(size[b], kind="stable")] for b in (np.flatnonzero(block == i), np.flatnonzero(block == j)))
    for at in range(0, len(left), 64):
        a = left[at : at + 64]
        for to in range(at if i == j else 0, len(right), 512):
            b = right[to : to + 512]
            if num * size[b[0]] > den * size[a[-1]] or num * size[a[0]] > den * size[b[-1]]:
                continue
            less, more = np.minimum(size[a][:, None], size[b][None, :]), np.maximum(size[a][:, None], size[b][None, :])
            new = (den * less >= num * more) & (top[a][:, None] != top[b][None, :])
            some_a, some_b = new.any(1), new.any(0)
            if not some_a.any():
                continue
            a_, b_ = a[some_a], b[some_b]
            both, either = _shared(sets, a_, b_)
            linked = new[some_a][:, some_b] & (den * both >= num * either)
            for x, y in zip(*np.nonzero(linked), strict=True):
                p, q = top[a_[x]], top[b_[y]]
                if p != q:
                    top[top == q] = p
    for p in np.unique(top):
        joined = [members[k][1] for k in np.unique(before[top == p])]
        least = min(joined)
        yield from ((root, least) for root in joined if root != least)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, compared group by group."""
    last, held, out = None, [], []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], schema=_EDGES)

    for b in batches:
        for at in range(0, b.num_rows, 500):
            for row in zip(*(c.to_pylist() for c in b.slice(at, 500).select(MEMBER).columns), strict=True):
                if row[:4] != last:
                    if held:
                        out += _links(last[2], last[3], held)
                    last, held = row[:4], []
                held.append(row[4:])
            if len(out) >= 1000:
                yield batch(out)
                out = []
    if held:
        out += _links(last[2], last[3], held)
    yield batch(out)


def _found(whole: DataFrame, members: DataFrame, across: bool = False) -> DataFrame:
    """Links (a, b) within these members' nodes, of large ones within blocks alone; or between the blocks of large ones. Written."""
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_WEIGHT), F.lit(1)).cast("int")
    members = members.withColumns({"blocks": blocks}).withColumn("block", F.pmod(F.xxhash64("key", "node"), F.col("blocks")).cast("int"))
    small, all_of = F.col("blocks") <= NODE_BLOCKS, F.sequence(F.lit(0), F.col("blocks") - 1)
    if across:
        members = members.where(~small).withColumn("other", F.explode(all_of)).where("other <> block")
    else:
        members = members.withColumn("other", F.explode(F.when(small, all_of).otherwise(F.array("block"))))
    picked = members.select("tree", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "root", "block")
    dealt = whole.join(hashed(picked), "key").select(*MEMBER).repartition(*GROUP).sortWithinPartitions(*GROUP)
    return stored(map_arrow(dealt, _compared, "a binary, b binary"), "links")


def _joined(found: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(key, root) of texts in components: those before, joined by new links between their roots. Written."""
    new = stored(components(found).withColumnRenamed("node", "key"), "joined")
    if roots is None:
        return new
    moved = roots.join(new.select(F.col("key").alias("root"), F.col("root").alias("to")), "root", "left").select("key", F.coalesce("to", "root").alias("root"))
    return stored(moved.unionByName(new.join(roots.select("key"), "key", "left_anti").select("key", "root")), "roots")


def _deeper(texts: DataFrame, whole: DataFrame, members: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """Components with the links of large nodes whose texts were still apart, and how deep these went."""
    level, large = START, members.where(F.col("total") > NODE_BLOCKS * BLOCK_WEIGHT)
    while True:
        apart = stored(_apart(large.drop("root"), roots), "apart")
        if apart.isEmpty():
            return roots, level
        if level == DEEPEST:
            return _joined(_found(whole, apart, across=True), roots), level
        children = apart.select("tree", "node", "key", "weight").join(hashed(texts.select("key", "sig")), "key")
        for _ in range(min(STEP, DEEPEST - level)):
            children, level = branched(children), level + 1
        children = _shared_nodes(children.drop("sig"))
        roots = _joined(_found(whole, _apart(children, roots)), roots)
        large = children.where(F.col("total") > NODE_BLOCKS * BLOCK_WEIGHT)


def linked(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """(key, doc_id, n_shingles, root) of each different text: root is alike for the texts of a component."""
    texts = _texts(docs)
    done, deepest, roots = 0, START, None
    while done < (wanted := needed(deepest, target)):
        members = _shared_nodes(_planted(texts, range(done, wanted)))
        own = texts.join(members.select("key").distinct(), "key", "left_semi").select("key", F.col("doc_id").alias("own_id"))
        whole = _rows(docs).join(hashed(own), "key").where(F.col("own_id").eqNullSafe(F.col("doc_id")))
        whole = stored(whole.select("key", "text"), "whole")
        for part in (F.col("tree") < FIRST, F.col("tree") >= FIRST):
            trees = stored(_apart(members.where(part), roots), "apart")
            found = _found(whole, trees)
            roots = _joined(found, roots)
            roots, level = _deeper(texts, whole, trees, roots)
            deepest = max(deepest, level)
            discard(trees, found)
        discard(members, whole)
        done = wanted
    out = texts.drop("sig").join(roots, "key", "left")
    return out.withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "key")))


def near_dedup(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """A row for each document: the size of its set, its component, and whether it is the one of it that stays."""
    texts = stored(linked(docs, target), "linked")
    ids = texts.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    texts = stored(texts.join(ids, "root", "left").select("key", "n_shingles", "component_id"), "components")
    out = _rows(docs).drop("text").join(texts, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
