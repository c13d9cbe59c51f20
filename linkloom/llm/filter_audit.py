"""Filter interaction audit: what five filters remove, in every order in which they can be applied.

Native expressions give each document a mask, a bit for each filter that it fails. Four bits follow from its text; the
fifth, of repeated texts, from a group by text that has the least doc_id. Documents are then counted by part and mask: 32
cells a part, summed before their shuffle, so neither a hot part nor a hot text gathers in one task. All orders come from
the cells: what is left after a set of filters is the sum of the cells without their bits.

The least doc_id of a text is joined back by text and doc_id together, so copies of one text are spread.

Defined cases: a null text is the empty text, and equal to it; a null part is the part of the empty string; a document
without doc_id fails no filter for its copies and makes none fail; rows that repeat both text and doc_id are no copies of
each other; a document is good (or toxic) if any row of labels says so of its doc_id; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm._common import discard, stored
from linkloom.llm.near_duplicates import text_key

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
SYMBOLS = "[#$%&*|]"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("n", "good", "toxic")


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D, which see one text alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    length = F.length(text).cast("long")
    capitals = length - F.length(F.regexp_replace(text, "[A-Z]+", "")).cast("long")
    fails = {"A": n < MIN_WORDS, "B": 100 * distinct < MIN_DISTINCT * n, "C": 100 * capitals > MAX_CAPITALS * length, "D": text.rlike(SYMBOLS)}
    return sum((F.when(failed, bit(x)).otherwise(0) for x, failed in fails.items()), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters that they fail, written."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"),
    )
    rows = stored(rows, "masks")
    first = rows.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    rows_ = rows.join(first, ["key", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    counted = rows_.groupBy("part", (F.col("mask") + F.when(copy, bit("E")).otherwise(0)).alias("mask")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    out = stored(counted, "cells")
    discard(rows)
    return out


def _left(count: str) -> Column:
    """By set of filters, as a number of bits, the count of the documents that fail none of them."""
    return F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, F.col(count)).otherwise(0)) for s in range(CELLS)))


def audit(counted: DataFrame) -> DataFrame:
    """From cells, for each part and order a row for each step: what is kept and removed there, and by each filter alone."""
    sole = F.array(*(F.sum(F.when(F.col("mask") == bit(x), F.col("n")).otherwise(0)) for x in FILTERS))
    parts = counted.groupBy("part").agg(*(_left(c).alias(f"left_{c}") for c in COUNTS), sole.alias("sole"))
    orders = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), bit(x)).otherwise(0) for x in FILTERS), F.lit(0))
    steps = steps.withColumns({
        "before": bits(F.expr("substring(filter_order, 1, step - 1)")), "after": bits(F.expr("substring(filter_order, 1, step)")),
        "letter": F.expr("substring(filter_order, step, 1)"),
    })
    gone = lambda c: F.col(f"left_{c}")[F.col("before")] - F.col(f"left_{c}")[F.col("after")]
    own = F.col("after") - F.col("before")
    failing = F.col("left_n")[0] - F.col("left_n")[own]
    return steps.select(
        "part", "filter_order", "step", F.col("left_n")[F.col("after")].alias("kept"), gone("n").alias("removed"),
        (failing - gone("n")).alias("redundant"), F.col("sole")[F.instr(F.lit(FILTERS), F.col("letter")) - 1].alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), _shapley(own).alias("shapley"),
    )


def _shapley(own: Column) -> Column:
    """What the filter of this bit removes, summed over all orders: each set of others stands before it in as many orders
    as there are orders of the set times orders of the rest."""
    ways = {s: _factorial(s.bit_count()) * _factorial(len(FILTERS) - 1 - s.bit_count()) for s in range(CELLS - 1)}
    by_filter = [
        sum((F.lit(w) * (F.col("left_n")[s] - F.col("left_n")[s | bit(x)]) for s, w in ways.items() if not s & bit(x)), F.lit(0)) for x in FILTERS
    ]
    out = F.when(own == bit(FILTERS[0]), by_filter[0])
    for x, value in zip(FILTERS[1:], by_filter[1:], strict=True):
        out = out.when(own == bit(x), value)
    return out.cast("long")


def _factorial(n: int) -> int:
    return 1 if n < 2 else n * _factorial(n - 1)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of documents by their source."""
    return audit(cells(docs, labels))
