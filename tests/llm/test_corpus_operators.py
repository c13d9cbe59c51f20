"""Operators that look at many texts at once, against brute force, round trips and held-out labels."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm import chat_format, lm_score, near_duplicates, packing, quality_pu, toxicity, url_filter
from linkloom.llm._common import item_words, numbered

DOCS = "doc_id long, text string, lang string, key string, n_words int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", 1) for i, t in rows], DOCS)


def near_copies():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, "!!"), (3, rows[3][1]), (None, rows[0][1]), (n + 3, "One two")]


def brute_classes(rows):
    sets = []
    for _, text in rows:
        w = item_words(text)
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    n = len(rows)
    near = [[i != j and ((rows[i][1] or "") == (rows[j][1] or "") or bool(sets[i] & sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for j in range(n)] for i in range(n)]
    cls = list(range(n))
    for _ in range(n):
        new = [min([cls[i], *(cls[j] for j in range(n) if near[i][j])]) for i in range(n)]
        if new == cls:
            break
        cls = new
    least = {c: min((r[0] for r, k in zip(rows, cls, strict=True) if k == c and r[0] is not None), default=None) for c in set(cls)}
    return sorted(((r[0], least[c], sum(near[i])) for i, (r, c) in enumerate(zip(rows, cls, strict=True))), key=str)


@pytest.mark.parametrize("block", [near_duplicates.BLOCK_WEIGHT, 900])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK_WEIGHT", block)
    rows = near_copies()
    got = near_duplicates.jaccard_join(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute_classes(rows)


def test_one_of_each(spark):
    rows = near_copies()
    kept = near_duplicates.one_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "key", "n_words"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({c for _, c, _ in brute_classes(rows)}, key=str)
    assert near_duplicates.one_of_each(frame(spark, rows).limit(0)).count() == 0
    assert near_duplicates.floor() == 4


def test_prefixes_shorten_by_what_is_found():
    none, many = np.zeros(near_duplicates.BINS), np.zeros(near_duplicates.BINS)
    assert near_duplicates.shortened(none, near_duplicates.DEPTH) == near_duplicates.floor() == 4
    many[-2:] = 10_000_000  # nearly equal texts are found at full length
    assert near_duplicates.shortened(many, near_duplicates.DEPTH) > 4
    many[0] = 10_000_000  # and those at the threshold only by short prefixes
    assert near_duplicates.shortened(many, near_duplicates.DEPTH) == 4
    labels = near_duplicates.Labels(near_duplicates.TREES)
    rng = np.random.default_rng(1)
    found = np.zeros(near_duplicates.DEPTH + 1)
    for _ in range(400):  # a pair with similarity 0.8 in as many tries as the formula says
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (160, 20, 20))
        x, y = (np.frombuffer(labels.of(np.r_[both, z]), np.uint8).reshape(near_duplicates.TREES, -1) for z in (a, b))
        same = (x == y).cumprod(1)
        for d in range(1, near_duplicates.DEPTH + 1):
            found[d] += same[:, near_duplicates.FIRST + near_duplicates.NEXT * (d - 1) - 1].mean() / 400
    assert np.abs(found[1:] - 0.8 ** np.arange(1, near_duplicates.DEPTH + 1)).max() < 0.03


PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "Hello, WORLD! it's 3.14...", "a" * 3000, "Éé ÀB İx ſ ß don't 'tis <|endoftext|> x<|startoftext|>", "é ́a   z\x85y\x1cq", "word " * 9000, "\n\n tabs\tand  spaces \n"]


@pytest.mark.parametrize("buffer", [packing.BUFFER, 5000])
def test_packing_round_trip(spark, monkeypatch, buffer):
    monkeypatch.setattr(packing, "BUFFER", buffer)
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice(["Alpha", "beta,", "gamma.", "δ", "e5", "(x)"]) for _ in range(rng.randint(0, 1500))) for _ in range(60)]
    rows = list(enumerate(texts))
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    got = packing.pack(frame(spark, rows), PATH).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    for pieces, whole in [*((by_doc[i], len(ids[i])) for i in ids), *((p, None) for p in by_sequence.values())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert whole in (None, at) and (whole is not None or at <= 4096 and at & (at - 1) == 0)
    assert packing.pack(frame(spark, rows).limit(0), PATH).count() == 0


def test_sequences_hold_the_ids(spark):
    rows = list(enumerate(TEXTS))
    tokenizer = Tokenizer.from_file(PATH)
    parts = {}
    for r in packing.sequences(frame(spark, rows), PATH).collect():
        assert len(r["input_ids"]) == sum(r["lengths"])
        at = 0
        for doc_id, n in zip(r["doc_ids"], r["lengths"], strict=True):
            parts.setdefault(doc_id, []).append(r["input_ids"][at : at + n])
            at += n
    for i, t in rows:
        wanted = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert sorted(x for p in parts[i] for x in p) == sorted(wanted) and (len(parts[i]) > 1 or parts[i][0] == wanted)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_matches_the_tokenizer(name):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    assert (encoder.words is not None) == name.startswith("word")
    encoder.LIMIT = 40  # forgets often
    rng = random.Random(7)
    pieces = ["İx", "ΣΑΣ", "naïve's", "it's", "'S", "<|endoftext|>", "x<|startoftext|>y", "don't!!", "\t", "\x85", "\u00a0", "²½", "12ab", "\n", "  ", "é", "e\u0301", "ﬁ", "ŉ", "ſt", "\u00ad", "日本語", "ẞ", "K", "\x00", "Word,", "word", "WORD..."]
    for _ in range(150):
        texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 12))) for _ in range(4)] + [None]
        ids, n = encoder.ids(pa.array(texts, pa.string()))
        wanted = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(wanted, []) and n.tolist() == list(map(len, wanted)), texts


def test_least_squares():
    rng = np.random.default_rng(0)
    a = rng.random((12, 40))
    x = packing.nnls(a, a @ np.where(rng.random(40) < 0.1, rng.random(40), 0))
    b = rng.random(12)
    y = packing.nnls(a, b)
    slope = a.T @ (b - a @ y)
    assert (x >= 0).all() and (y >= 0).all() and slope.max() < 1e-6 and np.abs(slope[y > 0]).max(initial=0) < 1e-6
    assert (packing.combinations() @ np.arange(1, packing.CLASSES + 1) == packing.CLASSES).all()


@pytest.mark.parametrize(("order", "chunk_words"), [(1, 1 << 20), (2, 1 << 20), (3, 1 << 20), (2, 7), (3, 2), (1, 1)])
def test_lm_scores_match_brute_force(spark, monkeypatch, order, chunk_words):
    monkeypatch.setattr(lm_score, "PART_ENTRIES", 100)
    monkeypatch.setattr(lm_score, "CHUNK_WORDS", chunk_words)
    rng = random.Random(order)
    texts = [" ".join(rng.choice(["the", "The", "cat", "sat", "é", "on"]) for _ in range(rng.randint(0, 25))) for _ in range(40)] + [None, "", "the cat " * 200]
    rows = [*enumerate(texts), (3, texts[3]), (None, "the cat")]
    padded = [[None] * (order - 1) + (t or "").encode().lower().split() for _, t in rows]
    counts = Counter(tuple(p[k : k + n]) for p in padded for n in range(1, order + 1) for k in range(order - n, len(p) - n + 1) if k + n > order - 1)
    for p in padded:  # contexts of start marks alone
        for n in range(1, order):
            counts[(None,) * n] += len(p) >= order
    total = sum(v for k, v in counts.items() if len(k) == 1 and k != (None,))

    def s(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        return math.log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= 2 else math.log(0.4) + s(gram[1:])

    expected = [(i, sum(s(tuple(p[k : k + order])) for k in range(len(p) - order + 1)) if len(p) >= order else None) for (i, _), p in zip(rows, padded, strict=True)]
    got = [(r["doc_id"], r["log_score"]) for r in lm_score.score(frame(spark, rows), order=order).collect()]
    key = lambda x: (str(x[0]), x[1] is None, x[1])
    for (i, a), (j, b) in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert i == j and (a is b is None or a == pytest.approx(b, abs=1e-6))
    assert lm_score.score(frame(spark, []), order=order).count() == 0


PIECES = st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "\\\\", " ", "\n", "]", "x", "é", "[", "</s>\n", " [/INST]\n"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "a]\\b", ""]), PIECES), max_size=5))
def test_chat_round_trip(turns):
    text, mask = chat_format.format_turns(turns)
    assert chat_format.read_turns(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("text", ["[INST] abc", "abc", "[INST] a [/INST]\n[ANS] b", "[ROLE:x] y", "[ROLE:x"])
def test_what_is_no_conversation_is_an_error(text):
    with pytest.raises(ValueError):
        chat_format.read_turns(text)


def test_reply_trees(spark):
    long = [("long", k, k - 1 if k else None, "user", str(k), 1.0) for k in range(70)]
    tree = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "thanks", 0.5), ("t", 9, 8, None, None, None), ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0)]
    messages = spark.createDataFrame([*long, *tree, tree[0]], "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["rank"]): r["formatted"] for r in chat_format.conversations(messages).collect()}
    key = lambda t: f'{{"tree":"{t}"}}'
    assert got[key("t"), 1] == chat_format.format_turns([("user", "q"), ("assistant", "good"), ("user", "thanks")])[0]
    assert got[key("t"), 2] == chat_format.format_turns([("user", "q"), ("assistant", "bad")])[0]
    assert [t for _, t in chat_format.read_turns(got[key("long"), 1])] == [str(k) for k in range(70)]
    assert len(got) == 4
    assert chat_format.conversations(messages, best=1).count() == 2
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.conversations(chat_format.linear(empty))).count() == 0


def test_numbers_within_large_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(40), rng.randrange(1000)) for _ in range(3000)]
    got = numbered(spark.createDataFrame(rows, "g string, x long, y long").repartition(5), "g", [F.desc("x")], ["y"], "n", len(rows)).collect()
    assert sorted(map(str, ((r["g"], r["x"], r["y"]) for r in got))) == sorted(map(str, rows))
    for g in ("hot", "a", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["n"])
        assert [r["n"] for r in own] == list(range(1, len(own) + 1))
        assert [(r["x"], r["y"]) for r in own] == sorted(((r["x"], r["y"]) for r in own), key=lambda t: (-t[0], t[1]))


def test_linear_conversations(spark):
    rows = [(1, 1, "assistant", "</s>"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, "user", "x"), (2, None, None, "y")]
    got = chat_format.digests(chat_format.conversations(chat_format.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    by = {r["conv_id"]: r for r in got}
    assert by[1]["n_turns"] == 3 and by[1]["loss_chars"] == 4
    assert by[1]["turns_sha256"] == hashlib.sha256(b"user\n\nuser\n\nassistant\n</s>\n").hexdigest()
    assert by[None]["n_turns"] == by[2]["n_turns"] == 1


def test_url_rules_and_spread(spark):
    link = lambda *urls: "".join(f'<a class=x href="{u}">' for u in urls)
    pages = [
        (1, "http://Spam.NET/x?q", None), (2, "https://a.example.net/en/1", link("http://good.com/")), (3, "https://b.example.com/de/1", None), (4, "http://x.org/fr/", link("//friend.com/x", "/own")),
        (5, "http://farm.com/", link("http://spam.net/", "http://spam.net/2", "http://evil.net/")), (6, "http://friend.com", None), (7, None, None), (8, "nothing", "<a href"), (9, "http://notexample.com/de/", None), (1, "http://Spam.NET/x?q", None), (10, "http://alone.com/#a", None),
    ]
    frame_ = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(frame_, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert got == {
        (1, "spam.net", "/x", "net/", "block"), (2, "a.example.net", "/en/1", "example.net/en/", "allow"), (3, "b.example.com", "/de/1", "example.com/de/", "block"), (4, "x.org", "/fr/", "org/fr/", "allow"),
        (5, "farm.com", "/", None, "block"), (6, "friend.com", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "notexample.com", "/de/", None, "allow"), (10, "alone.com", "/", None, "allow"),
    }
    assert url_filter.url_filter(frame_.limit(0), url_filter.rule_table(spark, [])).count() == 0


def test_rank_matches_dense_pagerank(spark):
    rng = np.random.default_rng(3)
    n, kinds = 60, ("allow", "block")
    edges, seeds, wanted = [], [], {}
    for kind in kinds:
        w = np.where(rng.random((n, n)) < 0.08, rng.integers(1, 9, (n, n)), 0) * (1 - np.eye(n))
        w[rng.choice(n, 12, replace=False)] = 0  # hosts without links
        w[:, 7] += 50 * (w[:, 7] > 0)  # a hot host
        v = np.where(rng.random(n) < 0.1, rng.random(n), 0)
        v /= v.sum()
        edges += [(kind, f"h{i}", f"h{j}", float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)]
        seeds += [(kind, f"h{i}", float(v[i])) for i in np.flatnonzero(v)]
        p = np.divide(w, w.sum(1, keepdims=True), out=np.tile(v, (n, 1)), where=w.sum(1, keepdims=True) > 0)
        rank = v
        for _ in range(300):
            rank = 0.85 * rank @ p + 0.15 * v
        wanted |= {(kind, f"h{i}"): rank[i] for i in range(n) if rank[i] > 0}
    frames = spark.createDataFrame(edges, "kind string, source string, target string, weight double"), spark.createDataFrame(seeds, "kind string, host string, seed double")
    got = {(r["kind"], r["host"]): r["rank"] for r in url_filter.spread(*frames).collect()}
    assert got.keys() >= {k for k, r in wanted.items() if r > 1e-6} and sum(abs(got.get(k, 0) - r) for k, r in wanted.items()) < 2e-5
    assert max(abs(got.get(k, 0) - r) for k, r in wanted.items()) < 1e-6


def test_rules_of_one_length_and_clashing_columns(spark):
    rules = url_filter.rule_table(spark, [("b.com/", "allow"), ("b.com/", "block"), ("a.b.com/x", "block"), ("b.com/xab", "allow")])
    pages = [(1, "http://b.com/q", "", "h", 1.0), (2, "http://a.b.com/xabc", "", "h", 1.0), (3, "http://www.b.com/xab", None, None, None)]
    pages += [(4, "http://c.com/", "<a " * 50_000 + "<a href=" * 20_000, "x", 2.0)]
    frame_ = spark.createDataFrame(pages, "page_id long, url string, html string, host string, rank double")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(frame_, rules).collect()}
    assert got == {1: ("b.com/", "block"), 2: ("a.b.com/x", "block"), 3: ("b.com/xab", "allow"), 4: (None, "allow")}
    assert url_filter.url_filter(frame_.limit(0), rules).count() == 0


def test_distrust_of_small_hosts(spark):
    hot = [(k, f"http://hot.net/{k}", None) for k in range(60)]
    small = [(100 + k, f"http://s{k // 2}.com/{'bad' if k % 2 else 'other'}/", None) for k in range(40)]
    farms = [(200 + k, f"http://farm{k}.org/", '<a href="http://hot.net/1">') for k in range(50)]
    rules = url_filter.rule_table(spark, [("hot.net/", "block"), ("com/bad/", "block"), ("good.io/", "allow")])
    pages = [*hot, *small, *farms, (300, "http://good.io/", '<a href="http://friend.io/">'), (301, "http://friend.io/", None), (302, "http://alone.io/", None)]
    got = url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "allow"} == {300, 301, 302}
    # and without a hot host: farms around one blocked host
    pages = [(0, "http://hot.net/", None), *farms, *pages[-3:]]
    got = url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "allow"} == {300, 301, 302}


def test_rules_of_any_number_of_lengths(spark):
    rules = url_filter.rule_table(spark, [("a.com/" + "x" * k, "block") for k in range(4200)])
    urls = spark.createDataFrame([("www.a.com", "/" + "x" * k) for k in range(4190, 4200)], "host string, path string")
    assert {len(r["rule"]) - len("a.com/") for r in url_filter.decided(urls, rules).collect()} == set(range(4190, 4200))
    assert url_filter.ROUNDS >= np.log(url_filter.TOLERANCE / 2) / np.log(url_filter.DAMPING)  # ends by its tolerance


def labelled(kind):
    rng = random.Random(6)
    rows, marks = [], []
    for k in range(900):
        bad = k % 6 == 0
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(30, 120))]
        if bad and kind == "toxic":
            words[5:5] = rng.sample(["zagro", "vilex", "murkish", "dregg"], 2)
        text = " ".join(words)
        rows.append((k, text.upper() + "!! ## ||" * 30 if bad and kind == "quality" else text))
        marks.append((k, int(bad) if kind == "toxic" else int(not bad)))
    return [*rows, (2000, None), (2001, ""), (None, "x"), (1, rows[1][1])], marks


@pytest.mark.parametrize(("kind", "run", "folds", "held"), [("toxic", toxicity.toxicity, 5, 0), ("quality", quality_pu.quality, 3, 1)])
def test_classifiers_on_held_out_labels(spark, kind, run, folds, held):
    rows, marks = labelled(kind)
    truth = dict(marks)
    marks = [(i, v if zlib.crc32(str(i).encode()) % folds != held else 1 - v) for i, v in marks] + [(None, 1), (5, None)]
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, f"doc_id long, {kind} int")
    got = run(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in got)
    out = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean(out) > 0.97  # and held-out labels, here turned round, were not read
    assert run(docs.limit(0), labels.limit(0)).count() == 0
    assert run(docs, labels.limit(0)).count() == len(rows)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_class_prior(share):
    rng = np.random.default_rng(2)
    width = len(quality_pu.NAMES)
    draw = lambda n, at: rng.normal(at, 1, (n, width))
    n = 6000
    good = rng.random(n) < share
    unlabelled = np.where(good[:, None], draw(n, 0.6), draw(n, -0.6))
    model = quality_pu.trained(draw(2000, 0.6), unlabelled)
    assert model.prior == pytest.approx(share, abs=0.05)
    assert ((model.logit(unlabelled) >= 0) == good).mean() > 0.93


def test_classifiers_do_not_depend_on_partitions(spark):
    for kind, run in (("toxic", toxicity.toxicity), ("quality", quality_pu.quality)):
        rows, marks = labelled(kind)
        docs, labels = frame(spark, rows), spark.createDataFrame(marks, f"doc_id long, {kind} int")
        first, again = ({(r[0], r[1]): r["score"] for r in run(docs.repartition(n), labels.repartition(n)).collect()} for n in (2, 5))
        assert first.keys() == again.keys() and all(first[k] == pytest.approx(again[k], abs=1e-9) for k in first)


def test_toxicity_cut_does_not_depend_on_the_document_sample(spark, monkeypatch):
    rows, marks = labelled("toxic")
    few, truth = marks[:450], dict(marks)
    docs, labels = frame(spark, rows), spark.createDataFrame(few, "doc_id long, toxic int")
    seen, cut = [], toxicity._cut
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 100)
    monkeypatch.setattr(toxicity, "_cut", lambda z, true: seen.append((len(true), int(true.sum()))) or cut(z, true))
    number, weights, bias = toxicity.fitted(docs.select("doc_id", "text"), labels)
    assert seen == [(len(few), sum(v for _, v in few))]  # row 1 is there twice, and counts once
    right = [(bias + sum(weights[number[x]] for x in toxicity.features(t) if x in number) >= 0) == truth[i] for i, t in rows[450:900]]
    assert np.mean(right) > 0.97


def test_rare_toxic_terms_are_mined(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    terms = ["".join(rng.choice("zqxjkvwy") for _ in range(7)) for _ in range(80)]  # each in 15 of 1200 toxic texts
    rows = [(k, " ".join([*(word() for _ in range(20)), *([terms[k % 80]] if k < 1200 else [])])) for k in range(4000)]
    copies = [(10_000 + k, "once copied often") for k in range(300)]
    docs = frame(spark, rows + copies).select("doc_id", "text")
    labels = spark.createDataFrame([(i, int(i < 1200 or i >= 10_000)) for i, _ in rows + copies], "doc_id long, toxic int")
    number, weights, bias = toxicity.fitted(docs, labels)
    assert set(terms) <= number.keys() and not {"copied", "often"} & number.keys()
    assert all(bias + weights[number[t]] > bias for t in terms)


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
    ids = {r[0] for r in kept.select("doc_id").collect()}
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert packed == ids and 0.4 * docs.count() < len(ids) < docs.count()
