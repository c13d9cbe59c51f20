"""Quality classifier by positive-unlabelled learning.

Trusted positives are training documents labelled good; unlabelled are documents of the whole table; labels of bad ones
are not used. On the statistics of a text, each cut into at most ``BINS`` classes at the unlabelled documents' quantiles,
an additive model is fitted that makes the non-negative unbiased risk least: prior * R+(positives) + max(0,
R-(unlabelled) - prior * R-(positives)). The class prior is the least share of unlabelled to positive mass above a score,
on scores of a half of the rows by a model of the other half. The cut that becomes 0.5 leaves that prior's share of the
unlabelled documents above it.

All different texts take part. Where they are more than ``FIT_ROWS``, a hash deals them into shards of about so many; each task
fits one shard, and the model is the mean of the shards' weights. Quantiles, the class prior and the cut are counted over all
texts: of statistics by classes of nearly equal values, of scores by classes of width ``STEP``. Rows of a shard are put in order by a
hash, so the fit does not depend on how rows are dealt over partitions. Labels come from the rows that the caller names;
labels, lang, source and ids are no inputs.

Defined cases: a null or empty text has zero statistics and the score of these; without trusted positives every
score is 1; a null doc_id is not held out and has no label; of several labels of one document the lowest holds;
repeated documents get a row each; an empty table gives an empty result; other columns are ignored by the report
and kept by ``good_documents``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm._common import discard, edit_rows, fold, map_arrow, map_batches, slices, stored, utf8
from linkloom.llm.linear import Adam, sigmoid
from linkloom.llm.stats import NAMES, measured

FIT_ROWS, BINS = 20_000, 24
#: Positives for each class at least; with few, classes are wide.
ROWS_A_BIN = 40
#: Scores are counted in classes of this width, and in the fit are between -BOUND and BOUND.
STEP, BOUND = 1e-3, 40.0
#: Rounds of the class prior: a fit with a rough prior ranks well enough to estimate it.
ROUNDS = 3
RESULT = "doc_id long, held_out boolean, score double, predicted int"


class Model:
    """An additive model on binned statistics."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> None:
        quantiles = np.linspace(0, 1, _bins(len(positive)) + 1)[1:-1]
        self._cut([np.unique(np.quantile(unlabelled[:, j], quantiles)) for j in range(len(NAMES))], prior)
        self.weights, self.bias = self._fit(self._rows(positive), self._rows(unlabelled))

    @classmethod
    def of(cls, edges: list[np.ndarray], prior: float, weights: np.ndarray | None = None, bias: float = 0.0) -> Model:
        """A model with these classes, and weights that are known or to come."""
        model = cls.__new__(cls)
        model._cut(edges, prior)
        model.weights, model.bias = weights, bias
        return model

    def _cut(self, edges: list[np.ndarray], prior: float) -> None:
        self.edges, self.prior = edges, prior
        self.first = np.cumsum([0, *(len(e) + 1 for e in edges)])

    def _rows(self, x: np.ndarray) -> np.ndarray:
        at = [np.searchsorted(e, x[:, j], "left") + self.first[j] for j, e in enumerate(self.edges)]
        return np.stack(at, 1) if len(x) else np.empty((0, len(NAMES)), np.int64)

    def _z(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[rows].sum(1) + self.bias

    def _fit(self, p: np.ndarray, u: np.ndarray, steps: int = 250) -> tuple[np.ndarray, float]:
        size = int(self.first[-1])
        w, adam = np.zeros(size + 1), Adam(size + 1, 0.05)

        def back(rows: np.ndarray, g: np.ndarray) -> np.ndarray:
            return np.r_[np.bincount(rows.ravel(), weights=np.repeat(g, rows.shape[1]), minlength=size), g.sum()]

        for _ in range(steps):
            zp, zu = w[p].sum(1) + w[-1], w[u].sum(1) + w[-1]
            sp, su = sigmoid(zp), sigmoid(zu)
            negative = np.log1p(np.exp(np.clip(zu, -40, 40))).mean() - self.prior * np.log1p(np.exp(np.clip(zp, -40, 40))).mean()
            away = back(u, su / len(u)) - self.prior * back(p, sp / len(p))
            toward = self.prior * back(p, (sp - 1) / len(p))
            grad = toward + away if negative >= 0 else -away
            w = adam.step(w, grad + 1e-4 * np.r_[w[:-1], 0])
        return w[:-1], float(w[-1])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._z(self._rows(x))


def _bins(positives: int) -> int:
    return int(np.clip(positives // ROWS_A_BIN, 4, BINS))


def _least_share(p: np.ndarray, u: np.ndarray, positives: int, unlabelled: int) -> float:
    """The least ratio of unlabelled to positive mass, each with half its standard error."""
    error = np.sqrt((1 - u) / np.maximum(u * unlabelled, 1e-9) + (1 - p) / (p * positives))
    return float(np.clip((u / p * (1 + error / 2)).min(), 0.05, 0.98))


#: Shares of the positives below the scores at which mass is compared.
_BELOW = np.linspace(0.02, 0.5, 49)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled. Each half of the rows is scored by a model of the other half; of
    the ratios of unlabelled to positive mass above a score the least counts, each with half its standard error."""
    prior = 0.5
    if min(len(positive), len(unlabelled)) < 4:
        return prior
    for _ in range(ROUNDS):
        zp, zu = np.empty(len(positive)), np.empty(len(unlabelled))
        for half in (0, 1):
            model = Model(positive[1 - half :: 2], unlabelled[1 - half :: 2], prior)
            zp[half::2], zu[half::2] = model.logit(positive[half::2]), model.logit(unlabelled[half::2])
        cuts = np.quantile(zp, _BELOW)
        p, u = ((z[:, None] >= cuts).mean(0) for z in (zp, zu))
        prior = _least_share(p, u, len(zp), len(zu))
    return prior


def trained(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    model = Model(positive, unlabelled, class_prior(positive, unlabelled))
    model.bias -= float(np.quantile(model.logit(unlabelled), 1 - model.prior))
    return model


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))

    def stats(cols):
        _, x = measured(cols["text"])
        key = [xxhash.xxh3_64_intdigest(utf8(t)) >> 1 for t in cols["text"]]
        yield {"doc_id": cols["doc_id"], "key": key, "x": [v.tolist() for v in x]}

    rows = map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), stats, "doc_id long, key long, x array<double>")
    texts = stored(rows.join(marks, "doc_id", "left").groupBy("key", "x").agg(F.coalesce(F.min("good"), F.lit(False)).alias("good")), "texts")
    try:
        total, positives = texts.agg(F.count("*"), F.count_if("good")).head()
        if not positives:
            return None
        if total > FIT_ROWS:
            return _trained_in_shards(texts, total, positives)
        found = sorted(texts.collect())  # no more than FIT_ROWS
        x, good = np.array([r["x"] for r in found]).reshape(-1, len(NAMES)), np.array([r["good"] for r in found], bool)
        return trained(x[good], x)
    finally:
        discard(texts)


def _quantiles(texts: DataFrame, at: np.ndarray) -> list[np.ndarray]:
    """Of each statistic its quantiles over all texts, by counts of values that agree in their first 10 bits or so."""
    names = ["name", "class", "value", "n"]

    def run(batches):
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, len(NAMES))
            for j in range(len(NAMES)):
                kind = np.ascontiguousarray(x[:, j], np.float32).view(np.int32) >> 13
                classes, of, n = np.unique(kind, return_inverse=True, return_counts=True)
                most = np.full(len(classes), -np.inf)
                np.maximum.at(most, of, x[:, j])
                for c, v, k in zip(classes.tolist(), most.tolist(), n.tolist(), strict=True):
                    old = found.get((j, c), (v, 0))
                    found[j, c] = (max(v, old[0]), old[1] + k)
        for part in slices(pa.RecordBatch.from_pydict(dict(zip(names, ([*x] for x in zip(*((j, c, v, n) for (j, c), (v, n) in found.items()), strict=True)), strict=True)))) if found else ():
            yield part

    counts = map_arrow(texts.select("x"), run, "name long, class long, value double, n long")
    counts = counts.groupBy("name", "class").agg(F.max("value").alias("value"), F.sum("n").alias("n")).collect()  # some hundred an octave of a statistic
    out = []
    for j in range(len(NAMES)):
        value, n = np.array(sorted((r["value"], r["n"]) for r in counts if r["name"] == j)).T
        below = np.cumsum(n)
        out.append(np.unique(value[np.searchsorted(below, at * below[-1])]))
    return out


def _trained_in_shards(texts: DataFrame, total: int, positives: int) -> Model:
    """A model of all texts: the mean of models of shards, an even number of them, so that each half is scored by the other."""
    spark, shards = texts.sparkSession, 2 * -(-total // (2 * FIT_ROWS))
    model = Model.of(_quantiles(texts, np.linspace(0, 1, _bins(positives) + 1)[1:-1]), 0.5)

    def classes(cols):
        at = model._rows(np.array(cols["x"]).reshape(-1, len(NAMES))) - model.first[:-1]
        yield {"shard": cols["shard"], "key": cols["key"], "good": cols["good"], "at": [bytes(r) for r in at.astype(np.uint8)]}

    shard = F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)).cast("int").alias("shard")
    binned = stored(map_batches(texts.select(shard, "key", "good", "x"), classes, "shard int, key long, good boolean, at binary"), "binned")

    def rows_of(at: list) -> np.ndarray:
        return np.frombuffer(b"".join(at), np.uint8).reshape(-1, len(NAMES)) + model.first[:-1]

    def fits(prior: float) -> dict[int, np.ndarray]:
        """Weights and bias of each half's shards, in the mean; a shard without positives has none."""

        def fit(table: pa.Table) -> pa.Table:
            table = table.sort_by("key")
            at, good = rows_of(table["at"].to_pylist()), table["good"].to_numpy()
            if not good.any():
                return pa.table({"shard": pa.array([], pa.int32()), "w": pa.array([], pa.list_(pa.float64()))})
            weights, bias = Model.of(model.edges, prior)._fit(at[good], at)
            return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "w": pa.array([[*weights.tolist(), bias]], pa.list_(pa.float64()))})

        made = sorted(binned.groupBy("shard").applyInArrow(fit, "shard int, w array<double>").collect())  # a row a shard
        every = [np.array(r["w"]) for r in made]
        half = {h: [w for r, w in zip(made, every, strict=True) if r["shard"] % 2 == h] or every for h in (0, 1)}
        return {h: np.mean(w, 0) for h, w in half.items()} | {2: np.mean(every, 0)}

    def counted(by: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all texts in classes, and how many texts and positives have them. by: weights for texts of each half."""

        def score(cols):
            at, odd = rows_of(cols["at"]), np.array(cols["shard"]) % 2
            z = np.where(odd, by[1][at].sum(1) + by[1][-1], by[0][at].sum(1) + by[0][-1])
            yield {"class": np.floor(np.clip(z, -BOUND, BOUND) / STEP).astype(np.int64), "good": cols["good"]}

        found = map_batches(binned.select("shard", "good", "at"), score, "class long, good boolean").groupBy("class")
        found = sorted(found.agg(F.count("*").alias("n"), F.count_if("good").alias("good")).collect())  # no more than 2 * BOUND / STEP
        z, n, good = np.array(found).T
        return z * STEP, n, good

    def above(n: np.ndarray) -> np.ndarray:
        return np.cumsum(n[::-1])[::-1] / n.sum()

    prior = 0.5
    for _ in range(ROUNDS):
        half = fits(prior)
        z, n, good = counted({0: half[1], 1: half[0]})
        cuts = np.searchsorted(np.cumsum(good), _BELOW * good.sum())
        prior = _least_share(above(good)[cuts], above(n)[cuts], int(good.sum()), int(n.sum()))
    w = fits(prior)[2]
    z, n, _ = counted({0: w, 1: w})
    discard(binned)
    cut = z[np.abs(above(n) - prior).argmin()]
    return Model.of(model.edges, prior, w[:-1], float(w[-1] - cut))


def _scores(model: Model | None, texts: list[str | None]) -> np.ndarray:
    return np.ones(len(texts)) if model is None else sigmoid(model.logit(measured(texts)[1]))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """A row for each document: whether it is held out, its score and the class. Labels of rows whose crc32 of
    the id as text is ``held`` modulo ``folds`` are never read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels.where(fold(F.col("doc_id"), folds) != held)))

    def judge(cols):
        score = _scores(shared.value, cols["text"])
        yield {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return map_batches(docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) == held).alias("held_out")), judge, RESULT)


def good_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """The documents with all their columns whose score is 0.5 or more."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted(slim, labels.where(fold(F.col("doc_id"), folds) != held)))
    return edit_rows(docs, "text", lambda texts: (_scores(shared.value, texts) >= 0.5, {}))
