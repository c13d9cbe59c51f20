"""The label model against loops in plain Python, the PU risk's gradient against finite differences, and all links of a
near-duplicate join against an exact search."""

import math
import random

import numpy as np

from linkloom.llm import near_duplicates, quality_pu, toxicity
from linkloom.llm._common import item_words
from linkloom.llm.linear import Rows


def by_loops(votes, n, m, on_toxic, on_clean, prior, rounds):
    """The same model, one number at a time: rates of each voter, of silence, and one vote for voters that go together."""
    a, b, share, post = list(on_toxic), list(on_clean), [1.0] * m, [prior] * n
    quiet, mute = 0.1, 0.9
    clip = lambda x, low, high: min(max(x, low), high)
    for k in range(rounds):
        a, b = [clip(x, 1e-4, 1 - 1e-4) for x in a], [clip(x, 1e-4, 1 - 1e-4) for x in b]
        quiet, mute = clip(quiet, 0.01, 0.99), clip(mute, 0.01, 0.99)
        if k % 5 == 1:
            left = [[(j in votes[i]) - post[i] * a[j] - (1 - post[i]) * b[j] for j in range(m)] for i in range(n)]
            spread = [math.sqrt(sum(left[i][j] ** 2 for i in range(n)) + 1e-6) for j in range(m)]
            for j in range(m):
                near = [1.0 if i == j else abs(sum(left[r][i] * left[r][j] for r in range(n))) / (spread[i] * spread[j]) for i in range(m)]
                share[j] = 1 / sum(x for x in near if x > 0.6)
        new = []
        for i in range(n):
            evidence = sum(share[j] * math.log(a[j] / b[j]) for j in votes[i])
            evidence += math.log(quiet / mute) if not votes[i] else math.log((1 - quiet) / (1 - mute))
            new.append(1 / (1 + math.exp(-(evidence + math.log(prior / (1 - prior))))))
        post, total = new, sum(new)
        a = [(sum(post[i] for i in range(n) if j in votes[i]) + toxicity.MINED_AS * on_toxic[j]) / (total + toxicity.MINED_AS) for j in range(m)]
        b = [(sum(1 - post[i] for i in range(n) if j in votes[i]) + toxicity.MINED_AS * on_clean[j]) / (n - total + toxicity.MINED_AS) for j in range(m)]
        quiet = (sum(post[i] for i in range(n) if not votes[i]) + 1) / (total + 2)
        mute = (sum(1 - post[i] for i in range(n) if not votes[i]) + 1) / (n - total + 2)
        prior = clip(total / n, 1e-3, 0.5)
    return post


def test_label_model_against_loops():
    rng = random.Random(3)
    n, m = 140, 9
    votes = []
    for i in range(n):
        toxic = i % 4 == 0
        own = {j for j in range(m - 2) if rng.random() < (0.5 if toxic else 0.01)}
        own |= {m - 2, m - 1} if 0 in own and rng.random() < 0.95 else set()  # two that follow the first
        votes.append(own)
    p, q = np.full(m, 0.5), np.full(m, 0.01)
    rows = Rows([np.array(sorted(v), np.int64) for v in votes], m)
    for rounds in (1, 2, 7, 25):
        got = toxicity.label_model(rows, p, q, 0.25, rounds)
        assert np.allclose(got, by_loops(votes, n, m, p.tolist(), q.tolist(), 0.25, rounds), atol=2e-4)
    assert np.mean([(got[i] > 0.5) == (i % 4 == 0) for i in range(n)]) > 0.8
    assert toxicity.label_model(Rows([np.empty(0, np.int64)] * 3, 0), np.empty(0), np.empty(0), 0.2).tolist() == [0.2] * 3


def test_gradient_of_the_risk(monkeypatch):
    seen = []

    class Recorder(quality_pu.Adam):
        def step(self, w, grad):
            seen.append((w.copy(), grad.copy()))
            return super().step(w, grad)

    monkeypatch.setattr(quality_pu, "Adam", Recorder)
    rng = np.random.default_rng(4)
    positive, unlabelled, prior = rng.normal(1, 1, (60, len(quality_pu.NAMES))), rng.normal(0, 1, (150, len(quality_pu.NAMES))), 0.6
    model = quality_pu.Model(positive, unlabelled, prior)
    p, u = model._rows(positive), model._rows(unlabelled)

    def parts(w):
        zp, zu = w[p].sum(1) + w[-1], w[u].sum(1) + w[-1]
        return prior * np.log1p(np.exp(-zp)).mean(), np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()

    signs = set()
    for w, grad in seen[::10]:
        negative = parts(w)[1]
        signs.add(negative >= 0)
        risk = (lambda v: sum(parts(v))) if negative >= 0 else (lambda v: -parts(v)[1])  # below zero the negative part is driven up alone
        for k in [*rng.choice(len(w), 12, replace=False), len(w) - 1]:
            step = np.zeros(len(w))
            step[k] = 1e-5
            slope = (risk(w + step) - risk(w - step)) / 2e-5
            assert abs(slope + (1e-4 * w[k] if k < len(w) - 1 else 0) - grad[k]) < 1e-6
    assert signs == {True, False}  # both cases are met


def test_quality_model_sees_all_rows(spark, monkeypatch):
    """With few rows a fit: classes, the prior and the cut are counted over all texts, however these are dealt out."""
    monkeypatch.setattr(quality_pu, "FIT_ROWS", 300)
    rng = random.Random(8)
    text = lambda good: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + (rng.choice(".,;!?#|") if rng.random() > good else "") for _ in range(rng.randint(30, 200)))
    rows = [(k, text(0.95 if k % 2 else rng.uniform(0.2, 0.8))) for k in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 1400) if k % 3], "doc_id long, quality int")
    model = quality_pu.fitted(docs, labels)
    x = quality_pu.measured([t for _, t in rows])[1]
    z = model.logit(x)
    assert abs((z >= 0).mean() - model.prior) < 0.004
    assert 0.4 < model.prior < 0.62 and (z[1::2] >= 0).mean() > 0.9 > 0.15 > (z[::2] >= 0).mean()
    for j, name in enumerate(quality_pu.NAMES):
        if name in ("log_words", "mean_word"):  # of many values, few of them equal
            shares = (x[:, j][:, None] <= model.edges[j]).mean(0)
            assert np.abs(shares - np.linspace(0, 1, len(shares) + 2)[1:-1]).max() < 0.01, name
    again = quality_pu.fitted(docs.repartition(7), labels)
    assert np.allclose(again.weights, model.weights) and abs(again.bias - model.bias) < 1e-9


def test_all_links_of_an_exact_search(spark):
    """Near copies around the threshold; an index of rare shingles finds every pair that can be similar."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = []
    for _ in range(260):
        base = [word() for _ in range(rng.randint(5, 90))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    texts = sorted({t for _, t in rows})
    sets = []
    for t in texts:
        w = item_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    count = {}
    for s in sets:
        for g in s:
            count[g] = count.get(g, 0) + 1
    where, similar = {}, {}
    for k, s in enumerate(sets):
        first = sorted(s, key=lambda g: (count[g], g))[: len(s) - -(-4 * len(s) // 5) + 1]  # a similar set shares one of these
        for j in {j for g in first for j in where.get(g, ())}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                similar.setdefault(texts[k], []).append(texts[j])
                similar.setdefault(texts[j], []).append(texts[k])
        for g in first:
            where.setdefault(g, []).append(k)
    copies = {}
    for _, t in rows:
        copies[t] = copies.get(t, 0) + 1
    wanted = {i: copies[t] - 1 + sum(copies[x] for x in similar.get(t, ())) for i, t in rows}
    got = {r["doc_id"]: r["n_links"] for r in near_duplicates.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == wanted and sum(wanted.values()) > 500
