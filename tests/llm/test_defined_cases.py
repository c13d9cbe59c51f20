"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator; the pipeline
against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from linkloom.llm import chat_format, decontaminate, lm_score, near_duplicates, packing, pii, quality_pu, quality_rules, toxicity, url_filter
from tests.llm.test_corpus_operators import brute_classes
from tests.llm.test_text_operators import brute

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use inside, as columns of the input.
CLASHING = ("key", "labels", "before", "node", "tree", "weight", "copies", "good", "whole", "marked", "quality", "toxic", "chunk", "part", "n", "ids", "width", "host", "path", "rule", "rank", "n_words", "score", "class_id", "own_id", "size", "block", "c0", "_key")


def clashing(frame):
    return frame.withColumns({c: F.lit(f"x{k}") if k % 2 else F.lit(None).cast("int") for k, c in enumerate(CLASHING)})


def documents(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    long = " ".join(word() for _ in range(300_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "a" * 1_200_000), (6, "x " * 400_000), (7, "\n" * 300_000), (8, "same text here, of seven words"), (8, "same text here, of seven words"), (None, "same text here, of seven words"), (None, None), (9, "é ü 日本 \x00  ")]
    rows += [(20 + k, " ".join(word() for _ in range(40))) for k in range(60)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string")), rows


def labels(spark, kind):
    rows = [(20 + k, int(k % 4 > 0)) for k in range(60)] + [(None, 1), (4, None), (20, 1), (4, 1), (5, 0)]
    return spark.createDataFrame(rows, f"doc_id long, {kind} int").withColumns({"text": F.lit("label"), "whole": F.lit(1), "good": F.lit("g")})


OPERATORS = {
    "decontaminate": lambda s, d: decontaminate.contamination(d, clashing(s.createDataFrame([(1, "same text here"), (None, "a"), (2, None)], "item_id long, text string"))),
    "near_duplicates": lambda s, d: near_duplicates.jaccard_join(d),
    "quality_rules": lambda s, d: quality_rules.quality_rules(d, labels(s, "quality")),
    "pii": lambda s, d: pii.personal_data(d),
    "lm_score": lambda s, d: lm_score.score(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s, "toxic")),
    "quality": lambda s, d: quality_pu.quality(d, labels(s, "quality")),
}
KEEPING = {
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([(1, "nowhere to be found")], "item_id long, text string")),
    "spans": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([(1, "same text here")], "item_id long, text string"), remove="spans"),
    "redact": lambda s, d: pii.redact(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(spark, name):
    docs, rows = documents(spark)
    got = OPERATORS[name](spark, docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", KEEPING)
def test_all_columns_of_the_input_are_kept(spark, name):
    docs, rows = documents(spark)
    got = KEEPING[name](spark, docs)
    assert got.schema == docs.schema and got.count() == len(rows)
    assert {r["key"] for r in got.collect()} == {r["key"] for r in docs.collect()}
    assert KEEPING[name](spark, docs.limit(0)).count() == 0


def test_filters_keep_their_columns(spark):
    docs, rows = documents(spark)
    one = near_duplicates.one_of_each(docs)
    assert one.schema == docs.schema and one.count() == len({t or "" for _, t in rows})
    good = quality_pu.good_documents(docs, labels(spark, "quality"))
    assert good.schema == docs.schema and 0 < good.count() <= len(rows)
    assert near_duplicates.one_of_each(docs.limit(0)).count() == quality_pu.good_documents(docs.limit(0), labels(spark, "quality")).count() == 0


def test_packing_of_odd_documents(spark):
    docs, rows = documents(spark)
    tokenizer = Tokenizer.from_file(PATH)
    tokens = {}
    for r in packing.pack(docs, PATH).collect():
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    for i, _ in rows:
        assert tokens[i] == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for j, t in rows if j == i)


def test_conversations_with_clashing_columns(spark):
    rows = [(1, 0, "user", "x" * 1_500_000), (1, 1, "assistant", "[/INST]" * 100_000), (2, 0, None, None), (2, 0, None, None), (None, None, "tool", "t")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({c: F.lit("c") for c in ("tree", "node", "parent", "score", "leaf", "rank", "mask", "m", "known", "up", "total", "steps")})
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.conversations(chat_format.linear(frame))).collect()}
    assert got[1]["loss_chars"] == 700_000 and got[2]["n_turns"] == 2 and got[None]["n_turns"] == 1


def test_pages_of_any_kind(spark):
    rows = [(1, None, None), (2, "http://a.com/" + "p" * 300_000, "<a href=http://b.com/>" * 20_000), (2, "http://a.com/", ""), (None, "://", "<a href=//>")]
    frame = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = url_filter.url_filter(frame, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert sorted(str(r["page_id"]) for r in got) == ["1", "2", "2", "None"] and {r["verdict"] for r in got} == {"allow"}


def corpus(spark, folder):
    """A small corpus with copies, near copies, benchmark passages, personal data and junk, and odd rows."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(5)] + [(9, None), (None, "a b")]
    rows, marks = [], []
    for k in range(160):
        words = [word() for _ in range(rng.randint(40, 120))]
        if k % 9 == 0:
            words[10:10] = items[k % 5][1].split()[3:16]
        if k % 7 == 0:
            words[5:5] = ["call", "me@x.org", "10.1.2.3"]
        text = " ".join(words)
        bad = k % 8 == 0
        rows.append((k, text.upper().replace(" ", "!!## ") if bad else text))
        marks.append((k, int(not bad)))
        if k % 5 == 0:
            rows.append((1000 + k, rows[-1][1]))
        if k % 6 == 0:
            words[-1] = word()
            rows.append((2000 + k, " ".join(words)))
    rows += [(3000, None), (3001, ""), (None, rows[3][1]), (3, rows[4][1]), (3002, "word " * 200_000)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*marks, (None, 1), (2, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = corpus(spark, str(tmp_path))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    slim = read("documents").select("doc_id", "text")
    fold = [r for r in read("labels").collect() if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    model = quality_pu.fitted(slim, spark.createDataFrame(fold, "doc_id long, quality int"))
    kept = [(i, t) for i, t in rows if model.logit(quality_pu.measured([t])[1])[0] >= 0]
    assert 0.7 * len(rows) < len(kept) < len(rows)
    key = lambda x: (x is None, x or 0)
    classes = dict(zip(range(len(kept)), [r[1] for r in sorted(brute_classes([(n, t) for n, (_, t) in enumerate(kept)]), key=lambda r: r[0])], strict=True))
    groups = {}
    for n, c in classes.items():
        groups.setdefault(c, []).append(n)
    assert len(groups) < len(kept)
    chosen = [min((kept[n] for n in g), key=lambda r: key(r[0])) for g in groups.values()]
    hits = brute([(n, t) for n, (_, t) in enumerate(chosen)], items)
    clean = [r for n, r in enumerate(chosen) if not hits[n][0][4]]
    assert len(clean) < len(chosen)
    tokenizer = Tokenizer.from_file(PATH)
    wanted = {i: len(tokenizer.encode(pii.masked(t) or "", add_special_tokens=False).ids) + 1 for i, t in clean}
    got = {}
    docs = read("documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == read("documents").columns, name
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert {i: p[0][3] for i, p in got.items()} == wanted and all(sum(x[1] for x in p) == wanted[i] for i, p in got.items())
    for i, t in clean[::5]:
        whole = np.array([*tokenizer.encode(pii.masked(t) or "", add_special_tokens=False).ids, 2], "<u4")
        assert all(zlib.crc32(whole[s : s + n].tobytes()) == c for s, n, c, _ in got[i])
    assert {i for i, _ in clean} == got.keys()


def test_pipeline_on_empty_tables(spark, tmp_path):
    corpus(spark, f"{tmp_path}/full")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
        spark.read.parquet(f"{tmp_path}/{'full' if name == 'documents' else 'empty'}/{name}.parquet").write.parquet(f"{tmp_path}/plain/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/plain").count() > 0  # no labels reject nothing, no benchmark hits nothing
