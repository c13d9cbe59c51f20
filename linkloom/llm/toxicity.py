"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters: words and word beginnings (lexicons), and shapes of texts (patterns), mined from about ``MINE_ROWS``
labelled training documents, equal texts once, as those that tell toxic ones apart; each votes on the documents that have it and
abstains on others. Votes are gathered on about ``MODEL_ROWS`` different texts, labelled or not, chosen by a hash. The label model is
fitted by expectation and maximisation without labels, from the voters' mined accuracies on: it estimates each
voter's rate of voting on toxic and on other documents, and the correlation of voters given the class, by which
those that repeat each other share one vote. Its posteriors train a linear classifier on the presence of words and
beginnings, which scores every whole text. The bias is set on the labelled training documents that were mined, however
many documents there are, so that 0.5 parts them best.

Labels come from the rows that the caller names as training rows; labels, lang, source and ids are no inputs.

Defined cases: a null or empty text has no features and the bias's score; without toxic training rows every
score is 0; a null doc_id is not held out and has no label; of several labels of one document the highest holds; repeated documents get a
row each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm._common import fold, item_words, map_batches, sampled, utf8
from linkloom.llm.linear import Rows, logistic, sigmoid

MINE_ROWS, MODEL_ROWS = 20_000, 20_000
VOTERS, FEATURES, LEAST_ROWS, LEAST_GAIN = 400, 4000, 5, 4.0
BEGINNINGS = (4, 5, 6)
#: Documents that a voter's mined rate counts as beside those that the label model sees: its prior, for rare voters.
MINED_AS = 200.0
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def features(text: str | None) -> set[str]:
    """Words, beginnings of longer words (with a star), and patterns (with a colon)."""
    words = {w.decode("utf-8", "replace") for w in set(item_words(text))}
    found = set(words)
    for n in BEGINNINGS:
        found.update([w[:n] + "*" for w in words if len(w) > n])
    raw = utf8(text)
    letters = len(raw.translate(None, bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))))
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    if letters and upper > letters / 2:
        found.add("shouting:")
    if raw.count(b"!") > 3:
        found.add("exclaiming:")
    if b"@" in raw:
        found.add("addressing:")
    return found


def mined(train: DataFrame, toxic: int, clean: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The features that tell most: names, rates among toxic and among clean training texts."""

    def tally(cols):
        counts = Counter(), Counter()
        for text, mark in zip(cols["text"], cols["toxic"], strict=True):
            counts[mark > 0].update(features(text))
        names = list(counts[0].keys() | counts[1].keys())
        yield {"name": names, "toxic": [counts[1][x] for x in names], "clean": [counts[0][x] for x in names]}

    found = map_batches(train, tally, "name string, toxic long, clean long").groupBy("name").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    p, q = F.col("t") / toxic, F.col("c") / clean
    found = found.where((F.col("t") + F.col("c") >= LEAST_ROWS) & (F.col("t") + F.col("c") < 0.9 * (toxic + clean)))
    gain = F.abs(p - q) / F.sqrt((p + q) * (1 / toxic + 1 / clean) / 2 + 1e-12)
    rows = found.where(gain >= LEAST_GAIN).orderBy(gain.desc(), "name").limit(FEATURES).collect()
    rates = [np.array([(r[k] + 0.5) / (n + 1) for r in rows]) for k, n in ((1, toxic), (2, clean))]
    return [r[0] for r in rows], rates[0], rates[1]


def label_model(votes: Rows, on_toxic: np.ndarray, on_clean: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
    """Posterior of being toxic for each document. A voter that abstains says nothing, but documents on which all
    abstain do; voters that vote together more than their class explains divide one vote among them."""
    n, m = votes.height, votes.width
    if not n or not m:
        return np.full(n, prior)
    a, b = on_toxic.copy(), on_clean.copy()
    dense = np.zeros((n, m), np.float32)
    dense[votes.row, votes.column] = 1
    silent = dense.sum(1) == 0
    quiet, mute = 0.1, 0.9  # rates of silence on toxic and on other documents
    share = np.ones(m)
    post = np.full(n, prior)
    for k in range(rounds):
        a, b = np.clip(a, 1e-4, 1 - 1e-4), np.clip(b, 1e-4, 1 - 1e-4)
        quiet, mute = np.clip(quiet, 0.01, 0.99), np.clip(mute, 0.01, 0.99)
        if k % 5 == 1:  # correlations of what the classes leave unexplained
            left = dense - (np.outer(post, a) + np.outer(1 - post, b)).astype(np.float32)
            spread = np.sqrt((left**2).sum(0) + 1e-6)
            near = np.abs(left.T @ left) / np.outer(spread, spread)
            np.fill_diagonal(near, 1)
            share = 1 / np.where(near > 0.6, near, 0).sum(1)
        evidence = dense @ (share * np.log(a / b))
        evidence += np.where(silent, np.log(quiet / mute), np.log((1 - quiet) / (1 - mute)))
        post = sigmoid(evidence + np.log(prior / (1 - prior)))
        a = (dense.T @ post + MINED_AS * on_toxic) / (post.sum() + MINED_AS)
        b = (dense.T @ (1 - post) + MINED_AS * on_clean) / ((1 - post).sum() + MINED_AS)
        quiet = (post[silent].sum() + 1) / (post.sum() + 2)
        mute = ((1 - post)[silent].sum() + 1) / ((1 - post).sum() + 2)
        prior = float(np.clip(post.mean(), 1e-3, 0.5))
    return post


def fitted(docs: DataFrame, labels: DataFrame):
    """Feature numbers by name, weights and bias; None without toxic and clean training rows."""
    marks = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n_docs, n_labels = docs.count(), marks.count()
    train = docs.where(sampled(F.col("doc_id"), MINE_ROWS / max(1, n_labels))).join(marks, "doc_id").select("text", "toxic")
    texts = train.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic"))  # a group of copies counts once
    counts = dict(texts.groupBy(F.col("toxic") > 0).count().collect())
    toxic, clean = counts.get(True, 0), counts.get(False, 0)
    if not toxic or not clean:
        return None
    names, p, q = mined(texts, toxic, clean)
    number = {x: k for k, x in enumerate(names)}
    voters = [k for k in range(len(names)) if p[k] > 5 * q[k]][:VOTERS]
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def found(cols):
        get = shared.value.get
        has = [sorted(k for k in map(get, features(t)) if k is not None) for t in cols["text"]]
        yield {"has": has, "key": [xxhash.xxh3_64_intdigest(utf8(t)) >> 1 for t in cols["text"]], "toxic": cols["toxic"]}

    def gathered(rows):  # in the order of a hash, whatever the partitions
        return sorted(map_batches(rows, found, "has array<int>, key long, toxic int").collect(), key=lambda r: (r["key"], r["has"]))

    text = F.coalesce("text", F.lit(""))
    sample = docs.where(sampled(F.xxhash64(text, F.lit("m")), MODEL_ROWS / max(1, n_docs)))
    rows = gathered(sample.select(text.alias("text")).distinct().select("text", F.lit(None).cast("int").alias("toxic")))
    has = [np.array(r[0], np.int64) for r in rows]
    place = np.full(len(names), -1)
    place[voters] = np.arange(len(voters))
    votes = Rows([v[v >= 0] for v in (place[h] for h in has)], len(voters))
    post = label_model(votes, p[voters], q[voters], toxic / (toxic + clean))
    data = Rows(has, len(names))
    weights, bias = logistic(data, post, np.ones(len(has)))
    known = gathered(texts)
    z = Rows([np.array(r["has"], np.int64) for r in known], len(names)).dot(weights) + bias
    return number, weights, bias - _cut(z, np.array([r["toxic"] > 0 for r in known]))


def _cut(z: np.ndarray, true: np.ndarray) -> float:
    """Where the classes part best: the highest F1, in the middle of the gap beside it."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(true[order])
    if not hit[-1]:
        return 0.0
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + hit[-1])
    k = int(f1.argmax())
    return float((z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """A row for each document: whether it is held out, its score and the class. Labels of rows whose crc32 of
    the id as text is ``held`` modulo ``folds`` are never read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fitted(docs, labels.where(fold(F.col("doc_id"), folds) != held))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(cols):
        scores = np.zeros(len(cols["text"]))
        if shared.value is not None:
            number, weights, bias = shared.value
            for k, text in enumerate(cols["text"]):
                scores[k] = bias + sum(weights[i] for i in map(number.get, features(text)) if i is not None)
            scores = sigmoid(scores)
        yield {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

    return map_batches(docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) == held).alias("held_out")), judge, RESULT)
