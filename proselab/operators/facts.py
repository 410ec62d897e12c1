"""Facts of a text and how well a rewrite keeps them (X-*).

Kinds are found by falling priority; what a match covers is masked by characters that no later kind matches, so
that a kind's matches never overlap those of a higher one. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselab.functions import lexicon as lx
from proselab.functions import text as tx

KINDS = tuple(k for k, _ in lx.FACTS)
NUMERIC = KINDS[:-1]
#: A letter to word bounds, as what it covers was, but none that a kind looks for.
MASK = "ª"


def _pattern(kind: str) -> str:
    # digits and letters of the patterns are ASCII; word bounds follow Unicode
    return ("(?iU)" if kind != "proper_noun" else "(?U)") + dict(lx.FACTS)[kind].replace(r"\d", "[0-9]")


def extract(df: DataFrame, text: str = "text", out: str = "facts") -> DataFrame:
    """X-01, X-03: ``df`` with a struct of arrays of distinct facts, one for each kind."""
    rest, names = F.coalesce(F.col(text), F.lit("")), []
    df = df.withColumn("_rest", rest)
    for kind in KINDS:
        found = F.regexp_extract_all("_rest", F.lit(_pattern(kind)), F.lit(0))
        if kind != "proper_noun":
            found = F.transform(found, tx.plain_number)
        names.append(f"_{kind}")
        df = df.withColumn(f"_{kind}", F.array_sort(F.array_distinct(found)))
        if kind != "proper_noun":
            df = df.withColumn("_rest", F.regexp_replace("_rest", _pattern(kind), MASK))
    return df.withColumn(out, F.struct(*(F.col(n).alias(n[1:]) for n in names))).drop("_rest", *names)


def counts(facts: str = "facts") -> Column:
    """X-09: the number of facts, by kinds."""
    total = F.lit(0)
    for k in KINDS:
        total = total + F.size(F.col(f"{facts}.{k}"))
    return total


def overlap(source: str, candidate: str, text: Column) -> Column:
    """X-04: share of the source's facts that the candidate has, as facts or in its ``text``; 1 without facts."""
    # named: else both are made again for every fact that is looked for
    return tx.let(F.lower(text), lambda low: tx.let(tx.joined_digits(low), lambda digits: _overlap(source, candidate, low, digits)))


def _overlap(source: str, candidate: str, low: Column, digits: Column) -> Column:
    kept = F.lit(0)
    for k in KINDS:
        there = F.col(f"{candidate}.{k}")

        def has(f, k=k, there=there):
            ok = F.array_contains(there, f)
            if k in ("currency", "number", "year", "pct"):
                bare = F.regexp_replace(f, r"[^0-9.]+", "")
                ok = ok | ((bare != "") & F.contains(digits, bare))
            return ok | F.contains(low, F.lower(f)) if k == "proper_noun" else ok

        kept = kept + F.size(F.filter(F.col(f"{source}.{k}"), _one(has)))
    every = F.size(F.array_distinct(F.concat(*(F.col(f"{source}.{k}") for k in KINDS))))
    return F.when(every == 0, 1.0).otherwise(kept / F.greatest(every, F.lit(1)))


def _one(has):
    """A function of one argument, as Spark passes an index to those of two."""
    return lambda f: has(f)


#: X-06: lower edges of the histogram's bins.
EDGES = (0.0, 0.3, 0.5, 0.7, 0.8, 0.9)


def histogram_bin(share: Column) -> Column:
    out = F.lit(EDGES[0])
    for e in EDGES[1:]:
        out = F.when(share >= e, e).otherwise(out)
    return out
