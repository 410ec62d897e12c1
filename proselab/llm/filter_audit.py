"""How filters that drop documents interact, whatever the order in which they are applied.

A document's failures are one bit a filter. Documents are first counted by part and failure mask, labels beside; from
then on only these cells are worked on. Every cell is laid out in long form against the steps of every order; a running
bit-or over the steps says whether an earlier filter has removed the cell already. Conditional sums over the cells of
a step give its counts, and a total over a filter's own rows, whatever the order, its share of all removals.

A null text is empty; a null part is the empty part. A document is a repeat where a smaller doc_id anywhere in the
table has the same text (SHA-256 and length), so copies that also share the doc_id are no repeats of each other, and a
row without doc_id neither is a repeat nor makes one. Repeated rows each count. A document whose labels are repeated
is good (or toxic) if any of them says so; labels without doc_id or with null values say nothing. An empty table
gives an empty result. Only the named columns are read, so that no other column can clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselab.llm.common import dealt, materialise

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = r"[#$%&*|]"
#: A name for each filter, one letter; E looks at the other documents, the others at the text alone.
NAMES = "ABCDE"


def failures(text: Column, words: Column) -> dict[str, Column]:
    """Conditions under which a text, of the given words, fails the filters that look at it alone."""
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 10 * F.length(text),
        "D": text.rlike(SIGNS),
    }


def bit(name: str) -> int:
    return 1 << NAMES.index(name)


def masks(df: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask: the filters that each document fails, as bits in the order of NAMES."""
    texts = dealt(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")))
    split = texts.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    own = sum((F.when(c, bit(k)).otherwise(0) for k, c in failures(F.col("text"), F.col("words")).items()), F.lit(0))
    rows = materialise(split.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("n")), "failures")
    firsts = rows.groupBy("digest", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # a table on both sides: plain exchanges, which Spark splits where copies of one text are a large share of rows
    joined = rows.join(materialise(firsts.select("digest", "n", "first"), "repeated"), ["digest", "n"], "left")
    repeat = F.when(F.col("doc_id") > F.col("first"), bit("E")).otherwise(0)
    return joined.select("doc_id", "part", (F.col("own") + repeat).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part and failure mask, and how many of them have either label."""
    says = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic")).where("quality = 1 OR toxic = 1")
    # rows without doc_id have no labels, and would all go to one task
    some = masked.where("doc_id IS NOT NULL").join(materialise(known, "labelled"), "doc_id", "left").select("part", "mask", "quality", "toxic")
    none = masked.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return some.unionAll(none).groupBy("part", "mask").agg(F.count("*").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def interaction(counted: DataFrame, orders: Sequence[str]) -> DataFrame:
    """part, filter_order, step and the counts of each step, from the cells of ``cells``."""
    steps = counted.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "(?<=.)(?=.)")).alias("at", "filter"))
    bits = F.create_map(*(F.lit(x) for name in NAMES for x in (name, bit(name))))
    long = steps.withColumn("fails", F.col("mask").bitwiseAND(bits[F.col("filter")]))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, first = F.col("fails") != 0, F.col("earlier") == 0
    total = lambda condition, c="n": F.sum(F.when(condition, F.col(c)).otherwise(0)).cast("long")
    counts = seen.groupBy("part", "filter_order", "at", "filter").agg(
        total(first & ~fails).alias("kept"),
        total(first & fails).alias("removed"),
        total(~first & fails).alias("redundant"),
        total(fails & (F.col("mask") == F.col("fails"))).alias("unique_fails"),
        total(first & fails, "good").alias("good_lost"),
        total(first & fails, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return counts.select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", orders: Sequence[str] | None = None) -> DataFrame:
    """The interaction of the filters over ``docs``; ``orders``: those looked at, else all permutations of NAMES."""
    orders = orders or ["".join(o) for o in itertools.permutations(NAMES)]
    return interaction(materialise(cells(masks(docs, part), labels), "cells"), orders)
