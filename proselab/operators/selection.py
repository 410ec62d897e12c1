"""Candidate selection as window queries (Q-*, J-08, W-03 to W-05, L-01, L-02, P-04 to P-06).

Candidates are rows (doc_id, round, cand_idx, sim, overlap, p_ai).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.sources.readers import settled

LAST = 1_000_000


def best_of_n(cand: DataFrame, floor: float = 0.78, by=("doc_id",), score: Column | None = None) -> DataFrame:
    """Q-03, Q-06, Q-12: of the candidates with enough similarity, or of all where none has, the best; ties to the first."""
    score = F.col("p_ai") if score is None else score
    order = Window.partitionBy(*by).orderBy(F.col("passes").desc(), score, "cand_idx")
    ranked = cand.withColumn("passes", (F.col("sim") >= floor).cast("int")).withColumn("place", F.row_number().over(order))
    return ranked.where("place = 1").drop("place")


def rejection(cand: DataFrame, docs: DataFrame, threshold: float, early: float, floor: float = 0.78, facts: float = 0.0, rounds: int = 4, concurrent: bool = False) -> DataFrame:
    """Q-04: doc_id, passed, rounds_used, attempts, judge_calls, round, cand_idx, p_ai of every row of ``docs``.

    Rounds go on until a round's choice passes. A round scores its survivors in order until one is under
    ``early`` (all of them if ``concurrent``); its choice is that one or the lowest. Without a pass the lowest
    choice under 1 of all rounds is taken, or the original text, which costs one call more.
    """
    by_round = Window.partitionBy("doc_id", "round")
    kept = cand.where((F.col("sim") >= floor) & ((F.lit(facts) <= 0) | (F.col("overlap") >= facts)))
    hit = F.lit(None).cast("int") if concurrent else F.min(F.when(F.col("p_ai") < early, F.col("cand_idx"))).over(by_round)
    scored = kept.withColumn("hit", hit).where(F.col("cand_idx") <= F.coalesce("hit", F.lit(LAST)))
    first = F.row_number().over(by_round.orderBy(F.when(F.col("cand_idx") == F.col("hit"), 0).otherwise(1), "p_ai", "cand_idx"))
    calls = F.count("*").over(by_round)
    chosen = scored.withColumn("place", first).withColumn("calls", calls).where("place = 1")
    by_doc = Window.partitionBy("doc_id")
    stopped = chosen.withColumn("stop", F.min(F.when(F.col("p_ai") < threshold, F.col("round"))).over(by_doc)).where(F.col("round") <= F.coalesce("stop", F.lit(LAST)))
    at_stop = F.coalesce(F.col("round") == F.col("stop"), F.lit(False))
    able = (F.col("p_ai") < 1.0) | at_stop
    order = F.struct((~able).cast("int").alias("a"), F.when(at_stop, 0).otherwise(1).alias("b"), "p_ai", "round", "cand_idx")
    final = stopped.groupBy("doc_id").agg(F.min(order).alias("best"), F.max("stop").alias("stop"), F.sum("calls").alias("calls"))
    tried = cand.groupBy("doc_id", "round").agg(F.count("*").alias("n"))
    out = docs.select("doc_id").join(final, "doc_id", "left")
    attempts = tried.join(final.select("doc_id", F.col("stop").alias("last")), "doc_id", "left").where(F.col("round") <= F.coalesce("last", F.lit(LAST))).groupBy("doc_id").agg(F.sum("n").alias("attempts"))
    found = F.col("best.a") == 0
    return out.join(attempts, "doc_id", "left").select(
        "doc_id",
        F.col("stop").isNotNull().alias("passed"),
        F.coalesce(F.col("stop") + 1, F.lit(rounds)).cast("int").alias("rounds_used"),
        F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"),
        (F.coalesce("calls", F.lit(0)) + F.when(F.coalesce(found, F.lit(False)), 0).otherwise(1)).cast("long").alias("judge_calls"),
        F.when(found, F.col("best.round")).alias("round"),
        F.when(found, F.col("best.cand_idx")).alias("cand_idx"),
        F.when(found, F.col("best.p_ai")).alias("p_ai"),
    )


def with_strategy(cand: DataFrame, strategies: DataFrame) -> DataFrame:
    """J-08, Q-05: the strategy (round, name, temperature) of each candidate's round; the last one goes on.

    Spark does not know the size of a table made of local rows: without the hint it sends all candidates to the strategies.
    """
    last = strategies.agg(F.max("round")).first()[0]
    return cand.withColumn("_r", F.least("round", F.lit(last))).join(F.broadcast(strategies.withColumnRenamed("round", "_r")), "_r").drop("_r")


def qa_gate(stages: Column, floor: float = 0.70) -> Column:
    """Q-09: of an array of stages with a field sim, the last one that reaches the floor, else the last."""
    return F.coalesce(F.try_element_at(F.filter(F.reverse(stages), lambda s: s["sim"] >= floor), F.lit(1)), F.element_at(stages, -1))


def refine(df: DataFrame, step, finished: Column, passes: int = 3) -> DataFrame:
    """Q-07, Q-03's passes: ``step`` on the rows that are not finished, at most ``passes`` times; all rows come back.

    Each pass is written before it is read by the next and by the result, so that a provider in ``step`` is called
    once for each row and pass.
    """
    done, rest = [], df
    for _ in range(passes):
        rest = settled(step(rest))
        done.append(rest.where(finished))
        rest = rest.where(~F.coalesce(finished, F.lit(False)))
    out = rest
    for d in done:
        out = out.unionByName(d)
    return out


def guidance(flagged: Column, advice: dict[str, str]) -> Column:
    """Q-08: the instruction lines of the flagged signals."""
    table = F.create_map(*(F.lit(x) for name, line in advice.items() for x in (name, "- " + line)))
    return F.concat_ws("\n", F.filter(F.transform(flagged, lambda f: F.try_element_at(table, f)), lambda x: x.isNotNull()))


def refine_input(flagged: Column, text: Column, advice: dict[str, str]) -> Column:
    """Q-08: the prompt of a refining pass; the text alone where nothing is flagged."""
    return F.when(F.size(flagged) == 0, text).otherwise(F.concat(F.lit(lx.REFINE), guidance(flagged, advice), F.lit("\n\nDraft:\n"), text))
