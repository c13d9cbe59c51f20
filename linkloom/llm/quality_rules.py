"""Quality rules: fixed rules on counts, and an isolation forest on rule statistics.

The statistics of every document are written once; labels are joined to these, and equal texts count once. A tree of the forest
is grown from ``SAMPLE`` rows, as the method has it; those that the trees draw are chosen by a hash among all labelled
good, with a few labelled junk (so that frequent kinds of junk do not pass for normal, yet their statistics get
splits), and put in order by a hash of their text, so the same documents give the same forest however they are dealt over
partitions. Its threshold is set on all labelled texts that pass the base rules, by counts of their scores; statistics,
scores and verdicts cover every document. A document is anomalous if random splits isolate it in few steps. The
threshold is the score that best parts the labelled rows, among those that keep at least ``KEEP`` of the good ones; without
labels of both kinds nothing is anomalous.

Defined cases: a null or empty text has no words, so the base rules fail it; repeated documents each get their
row; a null doc_id never counts as labelled; of several labels of one document the lowest holds; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm._common import discard, map_batches, sampled, stored, utf8
from linkloom.llm.stats import NAMES, measured

TREES, SAMPLE = 300, 256
#: Rows that trees are grown from, in all: each could have rows of its own. Of more labelled texts each has the same chance.
DRAWN = TREES * SAMPLE
KEEP = 0.995
#: Scores are counted in classes of this width; a threshold is the largest score of a class.
STEP = 1e-5
#: Rows labelled junk that the forest is fitted on, for each row labelled good.
JUNK = 0.03
STATISTICS = "doc_id long, key long, base array<long>, x array<double>, failed boolean"
RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, anomaly double"
)


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows of a random tree."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays: a node's statistic (-1 at a leaf), its cut, its left child, its path length."""

    def __init__(self, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(x))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], rng) for _ in range(trees)] if len(x) else []

    def _grow(self, x: np.ndarray, rng: np.random.Generator):
        limit = int(np.ceil(np.log2(max(2, len(x)))))
        feature, cut, left, path = [], [], [], []
        todo = [(np.arange(len(x)), 0)]
        for rows, depth in todo:  # grows while it is read: nodes in breadth-first order
            low, high = x[rows].min(0), x[rows].max(0)
            choice = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(choice):
                feature.append(-1), cut.append(0.0), left.append(0), path.append(depth + float(_mean_path(len(rows))))
                continue
            f = int(rng.choice(choice))
            c = rng.uniform(low[f], high[f])
            feature.append(f), cut.append(c), left.append(len(todo)), path.append(0.0)
            below = x[rows, f] < c
            todo += [(rows[below], depth + 1), (rows[~below], depth + 1)]
        return np.array(feature), np.array(cut), np.array(left), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher is easier to isolate."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, path in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                go = node[inner]
                node[inner] = left[go] + (x[rows[inner], feature[go]] >= cut[go])
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(float(_mean_path(self.size)), 1e-9))


def threshold(score: np.ndarray, good: np.ndarray, junk: np.ndarray, keep: float = KEEP) -> float:
    """Scores above it are anomalous: the best difference of rates that keeps this share of the good rows. good and junk: how many of
    each have these scores, or less than that and more than the one before."""
    if not good.sum() or not junk.sum():
        return float("inf")
    order = np.argsort(score)
    kept, caught = np.cumsum(good[order]) / good.sum(), 1 - np.cumsum(junk[order]) / junk.sum()
    gain = np.where(kept >= keep, kept + caught - 1, 0)
    return float(score[order[gain.argmax()]]) if gain.max() > 0 else float("inf")


def statistics(docs: DataFrame) -> DataFrame:
    """Of every document the id, a hash of its text, the base counts, the statistics, and whether the base rules fail it."""

    def stats(cols):
        base, x = measured(cols["text"])
        key = [xxhash.xxh3_64_intdigest(utf8(t)) >> 1 for t in cols["text"]]
        yield {"doc_id": cols["doc_id"], "key": key, "base": base.tolist(), "x": [row.tolist() for row in x], "failed": base_failed(base)}

    return stored(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), stats, STATISTICS), "statistics")


def fitted(docs: DataFrame, labels: DataFrame, label_rows: int = DRAWN):
    """The forest, from rows that are drawn for its trees, and its threshold, from all that are labelled."""
    return _fitted(statistics(docs), labels, label_rows)


def _fitted(known: DataFrame, labels: DataFrame, label_rows: int = DRAWN):
    """Only the drawn rows and counts by score reach the driver."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    marks = labels.where(F.col("quality").isNotNull()).groupBy(doc_id).agg((F.min("quality") > 0).alias("good"))
    texts = known.join(marks, "doc_id").groupBy("key", "x", "failed").agg(F.min("good").alias("good"))
    texts = stored(texts, "marked")
    found = texts.where(sampled(F.col("key"), label_rows / max(1, texts.count()))).select("key", "x", "good").collect()
    found.sort(key=lambda r: (r["key"], r["x"]))
    x = np.array([r["x"] for r in found]).reshape(-1, len(NAMES))
    good = np.array([r["good"] for r in found], bool)
    junk = np.flatnonzero(~good)[: int(JUNK * good.sum())]  # in the order of a hash
    forest = Forest(np.concatenate([x[good], x[junk]]))
    shared = known.sparkSession.sparkContext.broadcast(forest)

    def scores(cols):
        yield {"score": shared.value.score(np.array(cols["x"]).reshape(-1, len(NAMES))), "good": cols["good"]}

    rows = map_batches(texts.where("not failed").select("x", "good"), scores, "score double, good boolean")
    by = rows.groupBy(F.floor(F.col("score") / STEP)).agg(F.max("score").alias("score"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("junk"))
    counts = np.array([tuple(r) for r in by.select("score", "good", "junk").collect()], float).reshape(-1, 3)  # no more than 1 / STEP
    discard(texts)
    return forest, threshold(*counts.T)


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])


def quality_rules(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """A row for each document: counts, whether the fixed rules fail it, and whether it is kept."""
    known = statistics(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    forest, limit = _fitted(known, labels)
    shared = docs.sparkSession.sparkContext.broadcast((forest, limit))

    def judge(cols):
        forest, limit = shared.value
        base, score = np.array(cols["base"]), forest.score(np.array(cols["x"]).reshape(-1, len(NAMES)))
        failed = np.array(cols["failed"], bool)
        yield {
            "doc_id": cols["doc_id"], "n_words": base[:, 0], "word_chars": base[:, 1], "n_symbols": base[:, 2],
            "n_dup_lines": base[:, 3], "n_repeat_words": base[:, 4], "base_failed": failed,
            "kept": ~failed & (score <= limit), "anomaly": score,
        }

    return map_batches(known.drop("key"), judge, RESULT)
