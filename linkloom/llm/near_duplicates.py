"""N-gram Jaccard join: a MinHash LSH forest over shingles of five words, then exact verification.

Each different text has ``DEPTH`` minhash values in each of ``TREES`` tries: its label there, a string of bytes in which
the texts that share the first values share a prefix. Texts that meet at a node of some trie, by a common prefix of
that length, are candidates. Prefixes start at full length. The similar pairs found so, each counted as one in so many as
its own similarity lets be found at that length, say how many there are in the corpus, and so which share of them is
found; the prefixes are shortened to the longest at which that share reaches ``TARGET``, and the pairs that meet
only then are verified too. ``UNSEEN`` more pairs, exactly at the threshold, are always reckoned with, so little evidence
shortens prefixes as far as any pair needs: to ``floor()``, 4 values. Each pair is verified once: in the round
that first has it, in the first trie there. A node whose texts all met before is left out.

Verification is exact, on sets of shingles. A large node's texts are parted by the size of their sets, as similar ones
differ by a factor of 1.25 at most, and into blocks of ``BLOCK_WEIGHT``; pairs of blocks of the same or the next size
are tasks of their own. No pair leaves its task, only a text's number of links and a spanning forest of them. Classes
are the connected components, by alternating stars.

Equal texts are one node with a number of copies, found by 16 bytes of SHA-256 before anything else.

Defined cases: null is the empty text; a text without words is linked to its exact copies alone; a text of one
to four words has one shingle, all its words; repeated rows count as copies; a class's id is its least doc_id,
null if it has none; an empty table gives an empty result; other columns are ignored by the join and kept by
``one_of_each``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm._common import (
    WordHashes, discard, hashed, item_words, kept_in_worker, map_arrow, map_batches, mix, stored, window_hashes,
)

WORDS, THRESHOLD = 5, (4, 5)
TREES, DEPTH, TARGET = 20, 8, 0.9999
#: Pairs at the threshold that are taken to be there besides those that are found.
UNSEEN = 10
#: Bytes of a label: four of its first value, two of each further one.
FIRST, NEXT = 4, 2
LABEL = FIRST + NEXT * (DEPTH - 1)
#: Shingles in a block, each text counting NODE_WEIGHT more.
BLOCK_WEIGHT, NODE_WEIGHT = 400_000, 400
#: A node that has more than one in so many rows of a join in the component search is a hub.
HUBS = 200
#: Classes of similarity, from the threshold to 1, by which found pairs are counted.
BINS = 40


def _words() -> WordHashes:
    return kept_in_worker("words", WordHashes)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    h = _words().of(item_words(text))
    return np.unique(window_hashes(h, min(n, len(h)))) if len(h) else h


def found_share(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray:
    """The share of pairs of a similarity that share a prefix of this length in some trie."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def floor(trees: int = TREES, target: float = TARGET, threshold=THRESHOLD) -> int:
    """The longest prefix at which even pairs at the threshold are found to the target's share."""
    least = threshold[0] / threshold[1]
    return next((d for d in range(DEPTH, 1, -1) if found_share(least, d, trees) >= target), 1)


def shortened(pairs: np.ndarray, depth: int, trees: int = TREES, target: float = TARGET, threshold=THRESHOLD) -> int:
    """The longest prefix, up to depth, at which the target's share of all pairs is found. pairs: by class of
    similarity, those that were found at this depth."""
    least = threshold[0] / threshold[1]
    similarity = least + (1 - least) * np.arange(len(pairs)) / len(pairs)
    there = pairs / found_share(similarity, depth, trees)
    there[0] += UNSEEN
    for d in range(depth, floor(trees, target, threshold), -1):
        if (there * (1 - found_share(similarity, d, trees))).sum() <= (1 - target) * there.sum():
            return d
    return min(depth, floor(trees, target, threshold))


class Labels:
    """A text's label in each trie, end to end."""

    def __init__(self, trees: int) -> None:
        rng = np.random.default_rng(11)
        self.flip, self.times = rng.integers(0, 1 << 32, (2, trees * DEPTH, 1), np.uint32)
        self.times |= np.uint32(1)
        self.trees = trees

    def of(self, h: np.ndarray) -> bytes:
        h = (h >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.trees * DEPTH, np.iinfo(np.uint32).max)
        for k in range(0, len(h), 1000):
            hashed = h[None, k : k + 1000] ^ self.flip
            hashed *= self.times
            np.minimum(least, hashed.min(1), out=least)
        values = mix(least.astype(np.uint64)).astype("<u8").view(np.uint8).reshape(self.trees, DEPTH, 8)
        parts = [values[:, 0, :FIRST], *(values[:, k, :NEXT] for k in range(1, DEPTH))]
        return np.concatenate(parts, axis=1).tobytes()


def prefixes(labels: Column, depth: int, trees: int = TREES) -> Column:
    """By trie a number for the node that a text's prefix of this length leads to."""
    size = FIRST + NEXT * (depth - 1)
    return F.array(*(F.xxhash64(F.substring(labels, LABEL * t + 1, size)) for t in range(trees)))


def text_key(text: Column) -> Column:
    """A text's identity: 16 bytes; null is the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256), 1, 32))


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of rows and columns the size of the sets' intersection and of their union."""
    size = np.array([len(s) for s in sets], np.int64)
    need = size[a][:, None] + size[b][None, :]
    if len(a) * len(b) <= 16:
        shared = np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in b] for i in a])
    else:
        rows = np.concatenate([a, b])
        flat = np.concatenate([sets[i] for i in rows])
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[column] > 1
        number = np.cumsum(count > 1) - 1
        row = np.repeat(np.arange(len(rows)), size[rows])[keep]
        column = number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((len(a), len(b)), np.float64)
        width = max(64, (4 << 20) // len(rows))
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [at, at + width])
            m = np.zeros((len(rows), width), np.float32)
            m[row[lo:hi], column[lo:hi] - at] = 1
            shared += m[: len(a)] @ m[len(a) :].T
        shared = np.rint(shared).astype(np.int64)
    return shared, need - shared


def _verify(tree: int, i: int, j: int, nodes: list[tuple]) -> Iterator[tuple]:
    """One node of a trie, or a pair of its blocks. nodes: (key, copies, prefixes, earlier prefixes, block, text)."""
    num, den = THRESHOLD
    nodes = list({n[0]: n for n in nodes}.values())  # a text that came more than once
    sets = [shingles(n[5]) for n in nodes]
    size = np.array([len(s) for s in sets], np.int64)
    labels = np.array([n[2] for n in nodes], np.int64)
    before = np.array([n[3] for n in nodes], np.int64).reshape(len(nodes), -1)
    copies = np.array([n[1] for n in nodes], np.int64)
    block = np.array([n[4] for n in nodes])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    left, right = left[np.argsort(size[left], kind="stable")], right[np.argsort(size[right], kind="stable")]
    links, root, pairs = np.zeros(len(nodes), np.int64), list(range(len(nodes))), np.zeros(BINS, np.int64)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for at in range(0, len(left), 512):
        a = left[at : at + 512]
        for to in range(0, len(right), 512):
            b = right[to : to + 512]
            if i == j and to < at or num * size[b[0]] > den * size[a[-1]] or num * size[a[0]] > den * size[b[-1]]:
                continue
            less, more = np.minimum(size[a][:, None], size[b][None, :]), np.maximum(size[a][:, None], size[b][None, :])
            new = den * less >= num * more
            for t in range(before.shape[1]):  # pairs that no earlier round has
                new &= before[a, t][:, None] != before[b, t][None, :]
            for t in range(tree):  # nor an earlier trie
                new &= labels[a, t][:, None] != labels[b, t][None, :]
            if i == j and to == at:
                new &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
            some_a, some_b = new.any(1), new.any(0)
            if not some_a.any():
                continue
            a_, b_, new = a[some_a], b[some_b], new[some_a][:, some_b]
            both, either = _shared(sets, a_, b_)
            new &= both * den >= num * either
            links[a_] += new @ copies[b_]
            links[b_] += copies[a_] @ new
            x, y = np.nonzero(new)
            place = (both[x, y] * den - num * either[x, y]) * BINS // ((den - num) * either[x, y])
            pairs += np.bincount(np.minimum(place, BINS - 1), minlength=BINS)
            for p, q in zip(a_[x].tolist(), b_[y].tolist(), strict=True):
                if (p := top(p)) != (q := top(q)):
                    root[max(p, q)] = min(p, q)
    for k, n in enumerate(nodes):
        if links[k]:
            yield n[0], int(links[k]), nodes[top(k)][0], None
    if pairs.any():
        yield None, 0, None, pairs.tolist()


GROUP = ["tree", "node", "i", "j"]
NODE = [*GROUP, "key", "copies", "labels", "before", "block", "text"]
FOUND = "key binary, links long, root binary, pairs array<long>"


_FOUND = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary()), ("pairs", pa.list_(pa.int64()))])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, verified group by group."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        values = zip(*rows, strict=True) if rows else [()] * len(_FOUND)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _FOUND, strict=True)], schema=_FOUND)

    last, held, out = None, [], []
    for b in batches:
        for at in range(0, b.num_rows, 500):
            for row in zip(*(c.to_pylist() for c in b.slice(at, 500).select(NODE).columns), strict=True):
                if row[:4] != last:
                    if held:
                        out += _verify(last[0], last[2], last[3], held)
                    last, held = row[:4], []
                held.append(row[4:])
            if len(out) >= 1000:
                yield batch(out)
                out = []
    if held:
        out += _verify(last[0], last[2], last[3], held)
    yield batch(out)


def _with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """The n rows (a, b) with the m of their a. least: (a, m, d) with d the number of rows of a, or more. Hubs, fewer
    than 2 * ``HUBS`` as their d sum up to 2 * n at most, are broadcast, so that no task gets all rows of one."""
    hub = F.col("d") * HUBS > n
    hubs, others = least.where(hub).select("a", "m"), least.where(~hub).select("a", "m")
    cold = rows.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(others, "a")
    return rows.join(F.broadcast(hubs), "a").unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node that it is connected with. Stars
    shrink alternately, each step by minima that are summed before the shuffle; ends when nothing changes."""
    pair = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    seen = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    edges = stored(edges.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct(), "edges", edges.count())
    before = seen(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("d"))
        large = _with_least(both.where("b > a"), least, before[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large", before[0])
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d"))
        small = _with_least(large, least, large.count()).where("b <> m").select(*pair(F.col("b"), F.col("m")))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")
        new = stored(small.distinct(), "small", 2 * before[0])
        discard(edges, large)
        edges, last, before = new, before, seen(new)
        if last == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text) of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), text.alias("text"))


def _nodes(docs: DataFrame, trees: int) -> DataFrame:
    """(key, doc_id, copies, weight, labels) of each different text; one without words has no labels."""
    labels = Labels(trees)

    def label(cols):
        sets = [shingles(t) for t in cols["text"]]
        yield {
            "doc_id": cols["doc_id"], "key": cols["key"], "weight": [len(s) for s in sets],
            "labels": [labels.of(s) if len(s) else None for s in sets],
        }

    rows = map_batches(_rows(docs), label, "doc_id long, key binary, weight int, labels binary")
    nodes = rows.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("labels").alias("labels")
    )
    return stored(nodes, "nodes")


def _candidates(docs: DataFrame, nodes: DataFrame, depth: int, trees: int) -> DataFrame:
    """Texts that meet another by a prefix of this length: (key, copies, weight, labels, text)."""
    placed = nodes.where("labels is not null").select("key", F.posexplode(prefixes(F.col("labels"), depth, trees)).alias("tree", "node"))
    shared = placed.groupBy("tree", "node").agg(F.count("*").alias("members")).where("members > 1")
    wanted = placed.join(hashed(shared), ["tree", "node"], "left_semi").select("key").distinct()
    wanted = nodes.join(wanted, "key", "left_semi").withColumnRenamed("doc_id", "own_id")
    wanted = stored(wanted, "wanted", nodes.count())
    texts = _rows(docs).join(hashed(wanted), "key").where(F.col("own_id").eqNullSafe(F.col("doc_id")))
    out = stored(texts.select("key", "copies", "weight", "labels", "text"), "candidates")
    discard(wanted)
    return out


def _met(candidates: DataFrame, count: int, depth: int, deeper: int | None, trees: int) -> DataFrame:
    """(key, links, root, pairs) of the similar ones of count texts that meet at this depth, but at none of the deeper round."""
    own = prefixes(F.col("labels"), depth, trees)
    before = prefixes(F.col("labels"), deeper, trees) if deeper else F.array().cast("array<long>")
    texts = candidates.select("key", "copies", own.alias("labels"), before.alias("before"), "text")
    weight = (F.col("weight") + NODE_WEIGHT).alias("weight")
    sizes = F.floor(F.log(F.greatest(F.col("weight"), F.lit(1))) / F.log(F.lit(THRESHOLD[1] / THRESHOLD[0]))).cast("long")
    members = candidates.select("key", weight, sizes.alias("size"), F.posexplode(own).alias("tree", "node"))
    # nodes of more than one text, but of those with the same texts the first
    texts_of = [F.count("*").alias("n"), F.sum("weight").alias("total"), *(F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"x{k}") for k in (1, 2))]
    nodes = members.groupBy("tree", "node").agg(*texts_of).where("n > 1")
    nodes = nodes.groupBy("n", "total", "x1", "x2").agg(F.min(F.struct("tree", "node")).alias("f")).select("f.*", "total")
    places = stored(members.join(nodes, ["tree", "node"]), "places", trees * count)
    # nor those whose texts all met before, at an earlier node of this round or in the one before
    arrays = candidates.select("key", own.alias("labels"), before.alias("before"))
    alike = lambda c, t: F.min(F.col(c)[t]) == F.max(F.col(c)[t])
    same = [alike("labels", t) for t in range(trees)]
    old = F.greatest(*(alike("before", t) for t in range(trees))) if deeper else F.lit(False)
    nodes = places.select("tree", "node", "key").join(arrays, "key").groupBy("tree", "node").agg(F.array(*same).alias("same"), old.alias("old"))
    nodes = nodes.where(~F.col("old") & (F.array_position("same", True) - 1 == F.col("tree"))).select("tree", "node")
    members = places.join(nodes, ["tree", "node"]).withColumn("size", F.when(F.col("total") > BLOCK_WEIGHT, F.col("size")).otherwise(-1))
    members = stored(members, "members", trees * count)
    discard(places)
    blocks = members.groupBy("tree", "node", "size").agg(F.ceil(F.sum("weight") / BLOCK_WEIGHT).cast("int").alias("blocks"))
    picked = members.join(hashed(blocks), ["tree", "node", "size"])
    number = lambda size, block: size * (1 << 32) + block
    block = number(F.col("size"), F.pmod(F.xxhash64("key"), F.col("blocks")))
    near = F.when(F.col("size") < 0, F.array("size")).otherwise(F.array(*(F.col("size") + k for k in (-1, 0, 1))))
    picked = picked.select("tree", "node", "key", block.alias("block"), F.explode(near).alias("size"))
    picked = picked.join(hashed(blocks), ["tree", "node", "size"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    picked = picked.select("tree", "node", "key", "block", "size", other).withColumn("other", number(F.col("size"), F.col("other")))
    picked = picked.select("tree", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "block")
    dealt = texts.join(hashed(picked), "key").select(*NODE).repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = stored(map_arrow(dealt, _verified, FOUND), "found")
    discard(members)
    return found


def _joined(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """(key, doc_id, copies, n_links, root) of each different text."""
    nodes = _nodes(docs, trees)
    candidates = _candidates(docs, nodes, floor(trees), trees)
    depth, deeper, found, pairs, count = DEPTH, None, [], np.zeros(BINS), candidates.count()
    while depth != deeper:
        found.append(_met(candidates, count, depth, deeper, trees))
        bins = found[-1].where("pairs is not null").select(F.posexplode("pairs").alias("bin", "n")).groupBy("bin").agg(F.sum("n"))
        for k, n in bins.collect():  # one row a class of similarity
            pairs[k] += n
        deeper, depth = depth, shortened(pairs.copy(), depth, trees)
    met = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    for more in found[2:]:
        met = met.unionByName(more)
    met = met.where("key is not null")
    links = met.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("key").alias("a"), F.col("root").alias("b")))
    out = nodes.select("key", "doc_id", "copies").join(links, "key", "left")
    out = out.join(roots.withColumnRenamed("node", "key"), "key", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    discard(candidates)
    return out.select("key", "doc_id", "copies", n_links.alias("n_links"), F.coalesce("root", "key").alias("root"))


def jaccard_join(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """A row for each document: its class, and how many other documents its text is linked to."""
    nodes = _joined(docs, trees)
    classes = nodes.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    nodes = nodes.where("n_links > 0").join(classes, "root").select("key", "class_id", "n_links", "class_size")
    out = _rows(docs).drop("text").join(hashed(stored(nodes, "classes")), "key", "left")
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def one_of_each(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """The documents with all their columns, one of each class: that with the least doc_id (null last)."""
    nodes = _joined(docs, trees)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    kept = nodes.groupBy("root").agg(best).select(F.col("best.key").alias("_key"), F.col("best.doc_id").alias("_doc_id"))
    names = docs.columns
    own = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names of the input cannot clash with ours
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    own = own.withColumn("_key", text_key(text)).join(stored(kept, "kept"), "_key")
    own = own.where(doc_id.cast("long").eqNullSafe(F.col("_doc_id")))
    return own.dropDuplicates(["_key"]).select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))
