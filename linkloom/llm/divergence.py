"""Source divergence audit: how far the term frequencies of the sources of a language lie apart.

A term's price in a group is ``1 + floor(SCALE * (count + 5) / (N + 5 * V))``, in whole numbers throughout. The distance of
two groups of a language is the sum of the differences of prices over its kept terms, by inclusion and exclusion over the
terms that each group has:

* terms of the one group against the price of zero of the other, from the first one's histogram of counts;
* the same for the other;
* for terms that both have, what these two sums have wrong: a join of postings, so only of terms that occur in both;
* terms that neither has: one constant difference for each.

So no group is ever filled up with the terms that it lacks. Terms are counted in bounded tables in each task, then by
group and term in Spark; the top terms of a group are cut to ``TOP`` before they meet.

Defined cases: null text, language and source are empty strings; a group without terms has the price of zero for
every term; a language that keeps no term has distances of 0 and no terms; repeated rows count as documents each; a
language of one source has no pairs; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm._common import discard, map_arrow, slices, stored, utf8

SCALE, PSEUDO = 1_000_000_000, 5
LEAST_DOCUMENTS, TOP = 30, 50
#: Maps the bytes of a UTF-8 text so that bytes.split() gives its terms: A-Z to lower case, what is no letter and not
#: beyond ASCII to a space.
TERMS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Entries of a task's table of counts; a full one is handed over.
HELD = 200_000
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by group and term; each group also with the empty term, which no text has."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def table() -> pa.RecordBatch:
        rows = [(*group, term, n, docs[term]) for group, (counts, docs) in held.items() for term, n in counts.items()]
        columns = zip(*rows, strict=True) if rows else [()] * len(COUNTED)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTED, strict=True)], schema=COUNTED)

    for batch in batches:
        for part in slices(batch):
            for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = utf8(text).translate(TERMS).split()
                if (lang, source) not in held:
                    held[lang, source] = (Counter({b"": 0}), Counter())
                counts, docs = held[lang, source]
                before = len(counts)
                counts.update(words)
                docs.update(set(words))
                entries += len(counts) - before + 1
                if entries > HELD:
                    yield table()
                    held.clear()
                    entries = 0
    yield table()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), the empty term for each group that occurs."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = map_arrow(docs.select(text("lang"), text("source"), text("text")), _counted, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: Column, n: Column, v: Column) -> Column:
    """Exact: decimals hold what a product of longs may not."""
    whole = lambda x, digits: x.cast(f"decimal({digits},0)")
    over = whole(F.lit(SCALE), 10) * whole(count + PSEUDO, 19)
    return F.call_function("div", over, whole(n + PSEUDO * v, 19)) + 1


def _postings(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept terms of groups that have them, with prices: (lang, source, term, n, p, q, zero), and groups: (lang, source, zero, v, terms)."""
    terms = counts.where("term <> x''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs"))
    terms = stored(terms.where(F.col("lang_docs") >= LEAST_DOCUMENTS).drop("lang_docs"), "terms")
    kept = stored(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    of_lang = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("v"))
    groups = counts.where("term = x''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.na.fill(0, ["total", "terms", "lang_total", "v"])
    zero = F.when(F.col("v") > 0, price(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(0)
    groups = stored(groups.withColumn("zero", zero), "groups")
    priced = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", price(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        price(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"), "zero",
    )
    priced = stored(priced, "priced")
    discard(terms, kept)
    return priced, groups


def distances(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each source and each other one of its language."""
    own = groups.select("lang", "source", "zero", "terms", "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.col("terms").alias("item_terms"))
    pairs = own.join(other, "lang").where("source <> item")
    # one side: the histogram of a group against the price of zero of the other
    histogram = priced.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("terms_of"))
    zeros = pairs.select("lang", "source", "item", "item_zero")
    one = histogram.join(zeros, ["lang", "source"]).groupBy("lang", "source", "item")
    one = one.agg(F.sum(F.col("terms_of") * F.abs(F.col("p") - F.col("item_zero"))).alias("one"))
    back = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("one").alias("back"))
    # both sides: each pair of groups once, by terms that both have
    a = priced.select("lang", "term", "source", "p", "zero")
    b = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("zero").alias("item_zero"))
    wrong = F.expr("abs(p - item_p) - abs(p - item_zero) - abs(zero - item_p)")
    met = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item")
    met = stored(met.agg(F.sum(wrong).alias("wrong"), F.count("*").alias("both")), "overlaps")
    met = met.unionByName(met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "wrong", "both"))
    key = ["lang", "source", "item"]
    out = pairs.join(one, key, "left").join(back, key, "left").join(met, key, "left").na.fill(0, ["one", "back", "wrong", "both"])
    neither = F.expr("(v - terms - item_terms + both) * abs(zero - item_zero)")
    return out.select(*key, (F.col("one") + F.col("back") + F.col("wrong") + neither).alias("value"))


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): a group's distances to the other sources, and the terms it has too many of."""
    counts = stored(term_counts(docs), "counts")
    priced, groups = _postings(counts)
    discard(counts)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = distances(priced, groups).withColumn("rank", F.row_number().over(order))
    more = priced.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    row = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return row(pair, "pair").unionByName(row(term, "term"))
