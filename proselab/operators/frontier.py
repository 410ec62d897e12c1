"""Q-04 with rounds made on demand: candidates are asked for only where no round has passed yet.

A round is one table in a folder: for every document that was open its attempts, judge calls and choice. The next
round's documents are those whose choice did not pass; when there are none, no further round is made. A run that
ended early goes on behind the last round that is whole, without asking for anything again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselab.sources import readers

ROUND = "doc_id long, round int, attempts long, calls long, cand_idx int, p_ai double, output string, passed boolean"
LAST = 2**31 - 1


def judged(kept: DataFrame, judge: Callable[[str], float], early: float, concurrent: bool = False) -> DataFrame:
    """``kept`` with p_ai: each document's candidates in order until one is under ``early``, the rest null; all if ``concurrent``.

    A document's candidates of a round, a bounded number, are read one after another from the shuffle.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", p_ai double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, over = None, False
        for b in batches:
            scores = []
            for i, t, ok in zip(b["doc_id"], b["output"], b["kept"]):
                if i != now:
                    now, over = i, False
                p = float(judge(t)) if ok and not over else None
                over = over or (not concurrent and p is not None and p < early)
                scores.append(p)
            yield b.assign(p_ai=pd.Series(scores, b.index, float))

    return kept.repartition("doc_id").sortWithinPartitions("doc_id", "cand_idx").mapInPandas(run, kind)


def _choice(cand: DataFrame, early: float, concurrent: bool) -> DataFrame:
    """One row a document: attempts, calls and the candidate that its round chooses, from rows with kept and p_ai."""
    fit = F.col("kept") & F.col("p_ai").isNotNull()
    hit = F.lit(LAST) if concurrent else F.coalesce(F.min(F.when(fit & (F.col("p_ai") < early), F.col("cand_idx"))), F.lit(LAST))
    each = F.collect_list(F.when(fit, F.struct("p_ai", "cand_idx", "output")))
    rows = cand.groupBy("doc_id").agg(F.count("*").alias("attempts"), hit.alias("hit"), each.alias("each"))
    scored = rows.withColumn("scored", F.filter("each", lambda x: x["cand_idx"] <= F.col("hit")))
    at_hit = F.try_element_at(F.filter("scored", lambda x: x["cand_idx"] == F.col("hit")), F.lit(1))
    best = F.coalesce(at_hit, F.array_min("scored"))
    return scored.select("doc_id", "attempts", F.size("scored").cast("long").alias("calls"), best.alias("best"))


def rounds_of(
    docs: DataFrame, propose: Callable[[DataFrame, int], DataFrame], path: str, threshold: float = 0.2, early: float = 0.05, floor: float = 0.78, facts: float = 0.0, rounds: int = 4,
    concurrent: bool = False, judge: Callable[[str], float] | None = None,
) -> DataFrame:
    """The rounds' tables, made where ``path`` does not have them yet.

    ``propose(open documents, round)`` gives rows doc_id, cand_idx, output, sim, overlap of the documents that it is
    handed, and p_ai unless ``judge(output)`` is to score them, which is then called no more often than needed. A
    document for which nothing is proposed stays open.
    """
    spark = docs.sparkSession
    now, done = docs, []
    for r in range(rounds):
        at = f"{path}/round={r}"
        if not readers.there(spark, f"{at}/_SUCCESS"):
            cand = propose(now, r).withColumn("kept", F.coalesce((F.col("sim") >= floor) & ((F.lit(facts) <= 0) | (F.col("overlap") >= facts)), F.lit(False)))
            chosen = _choice(judged(cand, judge, early, concurrent) if judge else cand, early, concurrent)
            rows = now.select("doc_id").distinct().join(chosen, "doc_id", "left").select(
                F.col("doc_id").cast("long").alias("doc_id"), F.lit(r).alias("round"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), F.coalesce("calls", F.lit(0)).cast("long").alias("calls"),
                F.col("best.cand_idx").cast("int").alias("cand_idx"), F.col("best.p_ai").cast("double").alias("p_ai"), F.col("best.output").alias("output"), F.coalesce(F.col("best.p_ai") < threshold, F.lit(False)).alias("passed"),
            )
            rows.write.mode("overwrite").parquet(at)
        made = spark.read.schema(ROUND).parquet(at)
        done.append(made)
        left = made.where(~F.col("passed")).select("doc_id")
        if left.isEmpty():
            break
        now = docs.join(left, "doc_id", "left_semi")
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def outcome(docs: DataFrame, made: DataFrame, rounds: int = 4) -> DataFrame:
    """doc_id, passed, rounds_used, attempts, judge_calls, round, cand_idx, p_ai, output of every row of ``docs``.

    The choice that passed, else the lowest under 1; without either the original stays, which costs one call more.
    """
    able = (F.col("p_ai") < 1.0) | F.col("passed")
    order = F.struct((~F.coalesce(able, F.lit(False))).alias("out"), (~F.col("passed")).alias("open"), "p_ai", "round", "cand_idx", "output")
    total = made.groupBy("doc_id").agg(F.min(order).alias("best"), F.max("round").alias("last"), F.sum("attempts").alias("attempts"), F.sum("calls").alias("calls"))
    found = F.coalesce(~F.col("best.out"), F.lit(False))
    passed = F.coalesce(~F.col("best.open"), F.lit(False))
    pick = lambda c: F.when(found, F.col(f"best.{c}")).alias(c)
    return docs.select("doc_id").join(total, "doc_id", "left").select(
        "doc_id", passed.alias("passed"), F.when(passed, F.col("last") + 1).otherwise(rounds).cast("int").alias("rounds_used"),
        F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), (F.coalesce("calls", F.lit(0)) + F.when(found, 0).otherwise(1)).cast("long").alias("judge_calls"),
        pick("round"), pick("cand_idx"), pick("p_ai"), pick("output"),
    )


def costs(made: DataFrame) -> DataFrame:
    """By round its documents, candidates, judge calls and passes."""
    return made.groupBy("round").agg(F.count("*").alias("open"), F.sum("attempts").alias("attempts"), F.sum("calls").alias("calls"), F.count_if("passed").alias("passed"))


def thinned(df: DataFrame, step: int, n: int, similarity: Callable[[Callable[[str], Column]], Column], p_ai: Callable[[Callable[[str], Column]], Column], sents: str = "sents") -> DataFrame:
    """A proposer without a provider: n candidates a document, each without every ``step``-th sentence, from another one on.

    ``similarity`` and ``p_ai`` get a function that gives of an array of something by sentence what belongs to the sentences
    that stay, so that a document's sentences are read once for all its candidates; overlap is the share of those that stay.
    """
    each = df.withColumn("cand_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = lambda c: F.filter(c, lambda _, i: (i + F.col("cand_idx")) % step != 0)
    share = F.size(left(sents)) / F.nullif(F.size(sents), F.lit(0))
    return each.select("doc_id", "cand_idx", F.array_join(left(sents), " ").alias("output"), similarity(left).alias("sim"), share.alias("overlap"), p_ai(left).alias("p_ai"))
