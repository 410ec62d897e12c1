"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power of an exponent, normalised. The exponent is bisected to
the largest flattening that keeps within a repetition limit, or to a target entropy of the weights. The weights
become budgets of tokens; a source meets its budget by whole passes over its documents and one partial pass,
each in a permutation of its own: documents fall into blocks by a hash of pass and doc_id, blocks and the
documents in them are taken in hash order, and the partial pass stops before the document that would exceed the
budget. Without a total the budget is the smallest at which no source loses a document.

Prefix sums run over the tokens of a source's blocks, whose number is fixed, and within the one block in which
the budget ends; no task holds a source.

A null text counts as empty; a source without tokens gets one pass. A null source is one source with the empty
name. Rows that repeat doc_id, source and text are one unit with all their tokens and are placed together; a
null doc_id is hashed as an empty string. An empty table gives an empty result. Only doc_id, source and text are
read; ``realise`` returns all columns of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselab.llm.common import materialise

#: Exponents are whole multiples of 1 / GRID, so that engines agree on them.
GRID = 10_000
#: Blocks of a source's pass: the first three hexadecimal digits of the hash.
BLOCK_DIGITS = 3


def units(df: DataFrame) -> DataFrame:
    """doc_id, source, print (of the text), n_tokens."""
    text = F.coalesce("text", F.lit(""))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64(text).alias("print"), F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n_tokens"))
    return rows.groupBy("doc_id", "source", "print").agg(F.sum("n_tokens").alias("n_tokens"))


def _bisected(fits) -> float:
    """The smallest exponent on the grid for which ``fits`` holds, which holds for 1."""
    low, high = -1, GRID
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid / GRID) else (mid, high)
    return high / GRID


def _bisected_over(held: DataFrame, measure) -> float:
    """The smallest exponent on the grid at which ``measure``, an aggregate that does not grow, is at most 0; else 1."""
    return _bisected(lambda x: x == 1 or held.agg(measure(F.lit(x)).alias("m")).first().m <= 0)


def exponent(sources: DataFrame, repetition: float | None, entropy: float | None, total: int | None) -> float:
    """The exponent for ``sources`` (source, n), which must be written already."""
    held = sources.where("n > 0")
    least, most, every = held.agg(F.min("n"), F.max("n"), F.sum("n")).first()
    if not every:
        return 1.0
    n = F.col("n").cast("double")
    if entropy is not None:

        def over(x: Column) -> Column:
            p = F.pow(n / every, x)
            return F.log(F.sum(p)) - F.sum(p * F.log(p)) / F.sum(p) - entropy

        # the entropy falls as the exponent grows: the largest exponent that reaches the target
        return max(0.0, _bisected_over(held, lambda x: F.when(over(x) >= 0, 1.0).otherwise(-1.0)) - 1 / GRID) if held.agg(over(F.lit(1.0)).alias("m")).first().m < 0 else 1.0
    if total is None:
        return _bisected(lambda x: x == 1 or (most / least) ** (1 - x) <= repetition)
    return _bisected_over(held, lambda x: F.lit(float(total)) * F.pow(F.lit(float(least)), x - 1) / F.sum(F.pow(n, x)) - repetition)


def shares(sources: DataFrame, repetition: float | None = 1.5, entropy: float | None = None, total: int | None = None) -> DataFrame:
    """source, n, weight, budget, passes (whole ones), rest (tokens of the partial pass)."""
    x = exponent(sources, repetition, entropy, total)
    held = sources.where("n > 0").agg(F.max("n"), F.sum(F.pow(F.col("n").cast("double"), F.lit(x)))).first()
    most, z = held[0] or 1, held[1] or 1.0
    n = F.col("n").cast("double")
    budget = n * F.pow(F.lit(float(most)) / n, F.lit(1 - x)) if total is None else F.lit(float(total)) * F.pow(n, F.lit(x)) / z
    out = sources.withColumn("weight", F.when(F.col("n") > 0, F.pow(n, F.lit(x)) / z).otherwise(0.0)).withColumn("budget", F.when(F.col("n") > 0, F.round(budget)).otherwise(0).cast("long"))
    out = out.withColumn("passes", F.when(F.col("n") > 0, F.floor(F.col("budget") / F.col("n"))).otherwise(1).cast("long"))
    return out.withColumn("rest", F.col("budget") - F.col("passes") * F.col("n"))


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def plan(df: DataFrame, repetition: float | None = 1.5, entropy: float | None = None, total: int | None = None, seed: int = 0) -> DataFrame:
    """doc_id, source, print, n_tokens, epoch, block, place: one row for each time a unit is taken.

    The mix is the order of epoch, block and place within a source.
    """
    base = materialise(units(df), "units")
    sources = materialise(base.groupBy("source").agg(F.sum("n_tokens").alias("n")), "sources")
    share = materialise(shares(sources, repetition, entropy, total), "shares")
    joined = base.join(share.select("source", "passes", "rest"), "source")
    whole = joined.where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    part = materialise(joined.where("rest > 0").withColumn("place", _key(seed, F.col("passes"))).withColumn("block", F.substring("place", 1, BLOCK_DIGITS)), "part")
    blocks = part.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    placed = materialise(blocks.withColumn("before", upto - F.col("tokens")).where("before <= rest").select("source", "block", "tokens", "before"), "blocks")
    near = part.join(placed, ["source", "block"])
    full = near.where("before + tokens <= rest")
    last = near.where("before + tokens > rest")
    order = Window.partitionBy("source", "block").orderBy("place", "n_tokens", "print").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.col("before") + F.sum("n_tokens").over(order)).where("upto <= rest")
    names = ["doc_id", "source", "print", "n_tokens", "epoch", "place"]
    taken = [whole.withColumn("place", _key(seed, F.col("epoch"))).select(names), *(x.withColumn("epoch", F.col("passes")).select(names) for x in (full, last))]
    rows = taken[0].unionByName(taken[1]).unionByName(taken[2])
    return rows.withColumn("block", F.conv(F.substring("place", 1, BLOCK_DIGITS), 16, 10).cast("int"))


def realise(df: DataFrame, **how) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, with all their columns."""
    # names of our own would clash with the input's
    taken = plan(df, **how).select("doc_id", "source", "print").toDF(*(f"{c} of the mix" for c in ("doc_id", "source", "print")))
    names = [taken[f"`{c}`"] for c in taken.columns]
    same = df["doc_id"].cast("long").eqNullSafe(names[0]) & (F.coalesce(df["source"], F.lit("")) == names[1]) & (F.xxhash64(F.coalesce(df["text"], F.lit(""))) == names[2])
    return df.join(taken, same).select(*(df[f"`{c}`"] for c in df.columns))
