"""The filter audit, near-dedup and source divergence against brute force, also of odd rows and empty tables."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from linkloom.llm import divergence, filter_audit, near_dedup

CLASHING = ("key", "part", "mask", "first", "n", "good", "toxic", "quality", "node", "tree", "root", "sig", "weight", "total", "own_id", "component_id", "kept", "term", "terms", "item", "value", "rank", "p", "q", "v", "zero", "docs")


def clashing(frame):
    return frame.withColumns({c: F.lit(f"x{k}") if k % 2 else F.lit(None).cast("int") for k, c in enumerate(CLASHING)})


def audited(rows, labels):
    """By hand: (part, order, step) to counts. rows: (doc_id, text, source)."""
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {x for x, f in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t)), strict=True) if f}
        fails.append((s or "", bad | ({"E"} if i is not None and least[t] < i else set()), i in good, i in toxic))
    out, removed_by = {}, Counter()
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {f[0] for f in fails}:
        for order in orders:
            left = [f for f in fails if f[0] == part]
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                failing = sum(x in f[1] for f in fails if f[0] == part)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(f[1] == {x} for f in fails if f[0] == part), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                removed_by[part, x] += len(gone)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "A" * 500_000, "a b " * 100_000, "#", *(" ".join(rng.choice(["w%d" % rng.randrange(400), "WORD", "|", "é"]) if rng.random() < 0.3 else f"t{rng.randrange(900)}" for _ in range(rng.choice([50, 199, 200, 300]))) for _ in range(12))]
    rows = [(k, rng.choice(texts), rng.choice(["hot", "hot", "hot", "b", "", None])) for k in range(150)] + [(None, texts[8], "hot"), (None, None, None), (3, texts[9], "b"), (3, texts[9], "b"), (-5, texts[10], "only here")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0), (9999, 1, 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"key": F.lit(1), "mask": F.lit("m"), "part": F.lit(2)})
    got = filter_audit.filter_audit(docs, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == audited(rows, labels)
    assert got.count() == 4 * 600
    assert filter_audit.filter_audit(docs.limit(0), marks).count() == 0
    none = filter_audit.filter_audit(docs, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).head()
    assert tuple(none) == (0, 0)


def diverged(rows, least=30):
    words = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for la, s, t in rows]
    out = set()
    for lang in {w[0] for w in words}:
        own = [w for w in words if w[0] == lang]
        kept = {t for t, n in Counter(t for _, _, ws in own for t in set(ws)).items() if n >= least}
        counts = {s: Counter(t for _, s2, ws in own if s2 == s for t in ws if t in kept) for s in {w[1] for w in own}}
        of_all = sum(counts.values(), Counter())
        price = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: B023, E731
        for s, c in counts.items():
            pair = [(-sum(abs(price(c, t) - price(d, t)) for t in kept), o.encode(), o) for o, d in counts.items() if o != s]
            term = [(price(of_all, t) - price(c, t), t.encode(), t) for t in kept if c[t] and price(c, t) > price(of_all, t)]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pair), 1)} | {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(term)[:50], 1)}
    return out


@pytest.mark.parametrize("held", [divergence.HELD, 40])
def test_source_divergence(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("tÉ", "Wo", "xy", "ñ", "日本") for b in ("a", "B", "cc", "ü", "é" * 3)] + [f"x{''.join(rng.choice('abcdef') for _ in range(4))}" for _ in range(90)]
    rows = []
    for k in range(400):
        source = rng.choice(["hot", "hot", "s1", "s2", "é", "", None])
        rows.append((rng.choice(["en", "en", "de", None]), source, rng.choice(["-", " ", "7", "_"]).join(rng.choices(vocabulary, [1 + (hash((source, w)) + k) % 7 for w in vocabulary], k=rng.randint(0, 60)))))
    rows += [("en", "hot", None), ("en", "no words", "12 3"), ("xx", "alone", "few words"), ("yy", "a", ""), ("yy", "b", None), ("en", "s1", "Wo " * 200_000), ("en", "s1", rows[0][2]), ("en", "s1", rows[0][2])]
    docs = clashing(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string"))
    got = divergence.divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == diverged(rows)
    assert {r[5] for r in found if r[:3] == ("yy", "a", "pair")} == {1} and [r[4] for r in found if r[0] == "yy"] == [0, 0]
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_prices_are_exact(spark):
    rows = [(10**13 + 7, 10**15 + 3, 10**6), (0, 0, 1), (9 * 10**17, 10**18, 10**7)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.price(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in rows]


def components_of(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 20 * min(len(sets[i]), len(sets[j])) >= 17 * max(len(sets[i]), len(sets[j])) > 0 and 20 * len(sets[i] & sets[j]) >= 17 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    ids = [least.get(top(k)) if sets[k] else i for k, (i, _) in enumerate(rows)]
    return sorted(((i, len(sets[k]), ids[k], ids[k] == i) for k, (i, _) in enumerate(rows)), key=str)


def similar_texts(families, seed=2):
    """Texts in families whose similarities lie on both sides of the threshold, in chains."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(1, 150))]
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.8:
                base = list(base)
                for _ in range(rng.choice([0, 1, 1, 2, 3])):
                    base[rng.randrange(len(base))] = word()
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(w.upper() if rng.random() < 0.2 else w for w in base)))
    return rows


def test_near_dedup(spark):
    rows = similar_texts(70)
    long = " ".join(str(k) for k in range(200_000))
    rows += [(900, None), (901, ""), (902, "\n\t "), (903, "É"), (904, "é"), (905, "One Two"), (906, "one\x0btwo"), (3, rows[3][1]), (None, rows[0][1]), (None, None), (None, "by itself alone"), (907, "x " * 300_000), (908, "x y"), (910, long), (909, long + " end"), (5, rows[6][1])]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = near_dedup.near_dedup(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == components_of(rows)
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("deepest", [4, 6, 8])
def test_large_nodes_are_branched_and_compared_by_blocks(spark, monkeypatch, deepest):
    """Blocks of very few texts, so that nodes are large, and a limit of depth at which blocks meet each other."""
    monkeypatch.setattr(near_dedup, "BLOCK_WEIGHT", 1200)
    monkeypatch.setattr(near_dedup, "DEEPEST", deepest)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(60):  # one passage that all share, and ends that part them into near copies and others
        end = [f"e{k // 12}_{j}" for j in range(rng.choice([4, 12, 30]))]
        rows.append((k, " ".join(words + end)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == components_of(rows)


def test_links_within_and_between_blocks():
    rows = similar_texts(40, 4)
    texts = [(bytes([k // 256, k % 256]), bytes([k // 256, k % 256]), k % 2, t) for k, (_, t) in enumerate(rows)]
    root = {m[0]: m[0] for m in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    edges = [e for i, j in ((0, 0), (1, 1), (0, 1)) for e in near_dedup._links(i, j, [m for m in texts if m[2] in (i, j)])]
    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    wanted = {i: c for i, _, c, _ in components_of(rows)}
    assert {int.from_bytes(m[0]): int.from_bytes(top(m[0])) for m in texts} == wanted
    assert sum(len(list(near_dedup._links(i, i, [m for m in texts if m[2] == i]))) for i in (0, 1)) < len(rows)  # stars


def test_trees_that_are_needed():
    rng = random.Random(1)
    assert near_dedup.together(1.0, 9) == 1 and near_dedup.together(0.0, 1) == 0
    assert near_dedup.needed(4) <= near_dedup.needed(8) and near_dedup.needed(4, 0.9) < near_dedup.needed(4)
    more, share, depth, met = near_dedup.SECOND / (1 << 20), 0.85, 4, 0
    for _ in range(20_000):
        paths = 1
        for _ in range(depth):
            paths = sum(sum(rng.random() < share for _ in range(1 + (rng.random() < more))) for _ in range(paths))
        met += paths > 0
    assert abs(met / 20_000 - near_dedup.together(share, depth)) < 0.02
