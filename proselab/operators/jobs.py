"""Whole jobs over the operators: requests, sampling, evaluation of rewrites, pair generation (V-*, E-*, C-02, A-05, A-16, A-23, A-26, J-10, M-05, M-12, P-09, Q-10, Q-11, Q-13).

Detectors of texts are native stand-ins over the fingerprint's features, all scored in one pass; scores of external
services come from ``sources.readers.provided`` as rows of the same shape.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from proselab.functions import text as tx
from proselab.operators import corpus, fingerprint, logs, registry, scoring, selection
from proselab.sources import readers

MAX_CHARS = 20_000


def validated(requests: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """P-09: requests (text, candidates, max_rounds, threshold) with status and detail; a null option is the default's.

    422 for an empty text or an option out of its range, then 413 for a text that is too long, else 200.
    """
    outside = lambda c, low, high: F.coalesce(~F.col(c).between(low, high), F.lit(False))
    wrong = (
        F.when(F.coalesce(F.length("text"), F.lit(0)) < 1, "text").when(outside("max_rounds", 1, 8), "max_rounds")
        .when(outside("candidates", 1, 16), "candidates").when(outside("threshold", 0.0, 1.0), "threshold")
    )
    long = F.length("text") > max_chars
    detail = F.when(wrong.isNotNull(), F.concat(F.lit("out of range: "), wrong)).when(long, F.concat(F.lit(f"text exceeds max_chars={max_chars} (got "), F.length("text").cast("string"), F.lit(")")))
    return requests.withColumn("status", F.when(wrong.isNotNull(), 422).when(long, 413).otherwise(200)).withColumn("detail", detail)


def responses(requests: DataFrame, cand: DataFrame, threshold: float = 0.2, early: float = 0.05, max_chars: int = MAX_CHARS) -> DataFrame:
    """V-01: doc_id, status, detail, passed, score, attempts, judge_calls, cost of each request, by rejection over its candidates."""
    checked = validated(requests, max_chars).select("doc_id", "status", "detail")
    good = checked.where("status = 200").select("doc_id")
    # written first: the selection reads the candidates twice, and a provider is to be called once
    found = selection.rejection(readers.settled(cand.join(good, "doc_id", "left_semi")), good, threshold, early)
    cost = logs.path_cost(F.lit("/humanize"), F.col("attempts"), F.col("judge_calls"))
    return checked.join(found.select("doc_id", "passed", F.col("p_ai").alias("score"), "attempts", "judge_calls", cost.alias("cost")), "doc_id", "left")


def samples(cand: DataFrame, n: int, strategies: DataFrame | None = None) -> DataFrame:
    """V-03, Q-02: the first n candidates of each request's first round, without a threshold, with their strategy if there are any."""
    first = cand.where((F.col("round") == 0) & (F.col("cand_idx") < n))
    return selection.with_strategy(first, strategies) if strategies is not None else first


def scores(df: DataFrame, text: str = "text", lite: bool = False, more: dict[str, Column] | None = None) -> DataFrame:
    """D-01, D-07: ``df`` with the detectors' scores of a text as columns p_<name>, and ``more`` over the fingerprint's features."""
    f = fingerprint.with_features(df, text)
    held = f.withColumns({f"_{k}": v for k, v in fingerprint.signals().items()})
    parts = {
        "pattern": sum((F.col(f"_{n}") * w for n, w in fingerprint.lx.WEIGHTS), F.lit(0.0)) / sum(w for _, w in fingerprint.lx.WEIGHTS),
        "reduced": fingerprint.reduced_aggregate(),
        "evenness": F.col("_burstiness"),
    }
    return held.withColumns({f"p_{n}": parts[n] for n, _ in registry.ensemble(lite)} | (more or {})).drop(*fingerprint.FEATURES, *(f"_{k}" for k in fingerprint.signals()))


def p_ai(lite: bool = False) -> Column:
    """A-01 over the columns of ``scores``."""
    members = registry.ensemble(lite)
    return sum((F.col(f"p_{n}") * w for n, w in members), F.lit(0.0)) / sum(w for _, w in members)


def shared_words(a: Column, b: Column) -> Column:
    """A native stand-in for the similarity of two texts: twice the distinct tokens in both over those of each; 1 for two empty texts."""
    return _dice(a, b)


@F.pandas_udf(DoubleType())
def _dice(a: pd.Series, b: pd.Series) -> pd.Series:
    def share(x: str | None, y: str | None) -> float:
        if x is None or y is None or x == y:
            return 1.0
        x, y = x.lower(), y.lower()
        if x == y:
            return 1.0
        x, y = (set(fingerprint.tokens(t)) for t in (x, y))
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0

    return pd.Series([share(*pair) for pair in zip(a, b)], dtype=float)


def evaluated(df: DataFrame, rewrite: Callable[[Column], Column], text: str = "text", perplexity: Column | None = None, lite: bool = False) -> DataFrame:
    """E-01, Q-10: ``df`` with rewrite, the detectors' scores of it, p_ai, similarity, cv and perplexity (null without one)."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("rewrite", rewrite(body))
    out = scores(out, "rewrite", lite, {"cv": fingerprint.sentence_spread()}).withColumn("p_ai", p_ai(lite)).withColumn("similarity", shared_words(F.col("rewrite"), body))
    return out.withColumn("perplexity", perplexity if perplexity is not None else F.lit(None).cast("double"))


def summary(rows: DataFrame, lite: bool = False, *by: str) -> DataFrame:
    """A-02, A-03, A-05: n, the share under 0.5 of the ensemble and each detector, and the means; zeros without rows. A perplexity of NaN, of an empty text, does not count."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    each = [F.coalesce(scoring.success_rate(f"p_{n}"), F.lit(0.0)).alias(f"asr_{n}") for n, _ in registry.ensemble(lite)]
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), mean("p_ai").alias("mean_p_ai"), F.coalesce(scoring.success_rate("p_ai"), F.lit(0.0)).alias("asr_ensemble"), *each,
        mean("similarity").alias("mean_similarity"), mean(F.nanvl("perplexity", F.lit(None).cast("double"))).alias("mean_perplexity"), mean("cv").alias("mean_cv"),
    )


def summary_text(lite: bool = False) -> Column:
    """M-05 over the columns of ``summary``."""
    percent = lambda c: F.concat(F.format_string("%.2f", F.col(c) * 100), F.lit("%"))
    lines = [F.concat(F.lit("n="), F.col("n").cast("string")), F.format_string("mean_p_ai=%.3f", "mean_p_ai"), F.concat(F.lit("asr_ensemble="), percent("asr_ensemble")), F.lit("asr_per_detector:")]
    lines += [F.concat(F.lit("  "), F.rpad(F.lit(n), 50, " "), F.lit(" "), percent(f"asr_{n}")) for n, _ in registry.ensemble(lite)]
    lines += [F.format_string("mean_similarity=%.3f", "mean_similarity"), F.format_string("mean_perplexity=%.1f", "mean_perplexity"), F.format_string("mean_burstiness_cv=%.2f", "mean_cv")]
    return F.concat_ws("\n", *lines)


def benchmark(df: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]], text: str = "text", lite: bool = False) -> DataFrame:
    """E-02: by strategy its prompts, those that failed, means of p_ai, pattern and similarity, success rate and seconds.

    A strategy gets the rows, with the scores of their texts, and gives them back with ``output``; it runs once, over all rows,
    and is timed until its outputs are written. They are scored, where they are not the text itself, and deleted before the next
    strategy runs, so that no two strategies' outputs take disk at a time. A prompt without an output has the empty one
    and counts in the means. Without rows all means are 0.
    """
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    known = {"_text_p_ai": "p_ai", "_text_p_pattern": "p_pattern"}
    given = scores(df.withColumn("_text", F.coalesce(text, F.lit(""))), "_text", lite).withColumn("p_ai", p_ai(lite))
    given = readers.settled(given.select(*df.columns, *(F.col(c).alias(k) for k, c in known.items())), "zstd")
    made = []
    for name, run in strategies.items():
        began = time.monotonic()
        rows = run(given)
        # a strategy that makes rows of its own has all its outputs scored
        kept = set(known) <= set(rows.columns)
        rows = rows.select(F.coalesce(F.col(text), F.lit("")).alias("source"), F.coalesce("output", F.lit("")).alias("output"), F.col("output").isNull().alias("failed"), *(F.col(k) if kept else F.lit(None).cast("double").alias(k) for k in known))
        same = (F.col("source") == F.col("output")) & F.lit(kept)
        rows = rows.select("failed", *known, same.alias("same"), *(F.when(~same, F.col(c)).alias(c) for c in ("source", "output")))
        out = readers.settled(rows, "zstd")
        seconds = time.monotonic() - began
        scored = scores(out.where("not same"), "output", lite).withColumn("p_ai", p_ai(lite)).withColumn("similarity", shared_words(F.col("output"), F.col("source")))
        every = scored.select("failed", *known.values(), "similarity").unionAll(out.where("same").select("failed", *known, F.lit(1.0)))
        found = every.agg(
            F.count("*").alias("n"), F.count_if("failed").alias("failed"), mean("p_ai").alias("mean_p_ai"), mean("p_pattern").alias("mean_pattern"),
            mean("similarity").alias("mean_similarity"), F.coalesce(scoring.success_rate("p_ai"), F.lit(0.0)).alias("asr"),
        ).first()
        made.append((name, *found, seconds))
        readers.discard(out)
    readers.discard(given)
    return df.sparkSession.createDataFrame(made, "strategy string, n long, failed long, mean_p_ai double, mean_pattern double, mean_similarity double, asr double, seconds double")


VARIANTS = ("base", "base_scrub", "trained", "trained_scrub")


def variants(df: DataFrame, trained: Callable[[Column], Column], scrub: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """M-12, J-10: ``df`` four times: base, base_scrub, trained and trained_scrub, with the column variant and that variant's text."""
    t = F.col(text)
    named = lambda *forms: F.array(*(F.struct(F.lit(n).alias("variant"), x.alias("text")) for n, x in zip(VARIANTS, forms)))
    each = F.explode(tx.let(trained(t), lambda x: named(t, scrub(t), x, scrub(x))))
    return df.withColumn("_v", each).withColumn("variant", F.col("_v.variant")).withColumn(text, F.col("_v.text")).drop("_v")


def variant_scores(df: DataFrame, trained: Callable[[Column], Column], scrub: Callable[[Column], Column], text: str = "text", lite: bool = False) -> DataFrame:
    """D-01 over ``variants``, without their texts: variants of a row with the same text are scored once."""
    t = F.col(text)
    forms = tx.let(trained(t), lambda x: F.array(t, scrub(t), x, scrub(x)))
    each = df.withColumn("_f", forms).select(*(c for c in df.columns if c != text), "_f", F.explode(F.array_distinct("_f")).alias("_t"))
    names = F.array(*map(F.lit, VARIANTS))
    named = each.withColumn("_n", F.filter(names, lambda _, i: F.get("_f", i).eqNullSafe(F.col("_t")))).drop("_f")
    return scores(named, "_t", lite).withColumn("p_ai", p_ai(lite)).withColumn("variant", F.explode("_n")).drop("_t", "_n")


def held_out_summary(rows: DataFrame, variant: str = "variant", base: str = "base", trained: str = "trained") -> DataFrame:
    """A-16: means and success shares of two variants by a held-out ensemble's p_ai, and their differences; one row."""
    part = lambda v, x: F.avg(F.when(F.col(variant) == v, x))
    good = (F.col("p_ai") < 0.5).cast("double")
    s = rows.agg(F.count_if(F.col(variant) == base).alias("n"), *(part(v, x).alias(f"{v}_{k}") for v in (base, trained) for k, x in (("p_ai", F.col("p_ai")), ("asr", good))))
    return s.withColumns({f"delta_{k}": F.col(f"{trained}_{k}") - F.col(f"{base}_{k}") for k in ("p_ai", "asr")})


def head_to_head(rows: DataFrame, n: int, order: str = "doc_id", variant: str = "variant", base: str = "base", trained: str = "trained") -> DataFrame:
    """A-26: mean p_ai and number under 0.5 of two variants over the first n documents; the first n are the feature."""
    wide = rows.groupBy(order).pivot(variant, [base, trained]).agg(F.first("p_ai")).orderBy(order).limit(n)
    out = wide.agg(F.count("*").alias("n"), *(a for v in (base, trained) for a in (F.avg(v).alias(f"{v}_mean"), F.count_if(F.col(v) < 0.5).alias(f"{v}_hits"))))
    return out.withColumn("delta", F.col(f"{trained}_mean") - F.col(f"{base}_mean"))


def best_of_n_gain(cand: DataFrame, floor: float = 0.55) -> DataFrame:
    """Q-13: over all documents, means of the first candidate and of the least p_ai among those at the floor (else among all)."""
    keep = (F.col("sim") >= floor).cast("int")
    best = F.min(F.struct((1 - keep).alias("below"), "p_ai", "cand_idx"))
    one = cand.groupBy("doc_id", "round").agg(F.min(F.when(F.col("cand_idx") == 0, F.col("p_ai"))).alias("first"), best["p_ai"].alias("best"))
    return one.agg(F.count("*").alias("n"), F.avg("first").alias("mean_first"), F.avg("best").alias("mean_best"), F.avg(F.col("best") - F.col("first")).alias("gain"))


def token_plan(humans: Column, rewrites: int, limit_cost: float, per_call: int = 350, per_token: float = 4.5e-7) -> Column:
    """A-23: struct of calls, tokens, cost and whether the plan is within ``limit_cost``."""
    calls = humans * rewrites
    return F.struct(calls.alias("calls"), (calls * per_call).alias("tokens"), (calls * per_call * per_token).alias("cost"), (calls * per_call * per_token <= limit_cost).alias("allowed"))


def within_budget(plan: Column) -> Column:
    """A-23's guard: the number of calls, or an error when the plan costs too much."""
    return F.when(plan["allowed"], plan["calls"]).otherwise(F.raise_error(F.concat(F.lit("over the limit: $"), plan["cost"].cast("string"))).cast("long"))


def pair_rows(docs: DataFrame, prompts: int, answered: Callable[[DataFrame], DataFrame], done: DataFrame | None = None) -> DataFrame:
    """C-02: ai, human, prompt_idx, human_idx of every document and prompt that is not done and whose answer is none of the failed ones."""
    rows = docs.select(F.col("doc_id").alias("human_idx"), F.col("text").alias("human"))
    if done is None:
        left = corpus.pair_grid(rows, prompts)
    else:
        # a text meets its done prompts once, before it is there for each prompt
        did = done.groupBy("human_idx").agg(F.collect_set("prompt_idx").alias("_did"))
        every = F.sequence(F.lit(0), F.lit(prompts - 1))
        open_ = F.when(F.col("_did").isNull(), every).otherwise(F.filter(every, lambda p: ~F.array_contains("_did", p)))
        left = rows.join(did, "human_idx", "left").withColumn("prompt_idx", F.explode(open_)).drop("_did")
    return readers.succeeded(answered(left), "ai").select("ai", "human", "prompt_idx", "human_idx")


def generate_pairs(docs: DataFrame, prompts: int, answered: Callable[[DataFrame], DataFrame], path: str, compression: str | None = None) -> None:
    """C-02, S-14: the pairs that ``path`` does not have yet, appended to it as JSON lines; a run that ended early goes on.

    The files that are there are listed before any is added, and answers go straight to their file. A line has its text
    twice: a ``compression`` such as gzip finds the second one.
    """
    spark = docs.sparkSession
    done = readers.pairs(spark, path) if readers.there(spark, path) else None
    readers.write_jsonl(pair_rows(docs, prompts, answered, done), path, "append", compression=compression)


def stages(text: Column, named: dict[str, Callable[[Column], Column]]) -> Column:
    """Q-11: array of (stage, words, changed) as a text goes from one stage to the next."""

    def behind(now: Column, rest: list[tuple[str, Callable[[Column], Column]]]) -> Column:
        name, change = rest[0]

        def of(then: Column) -> Column:
            done = F.array(F.struct(F.lit(name).alias("stage"), tx.word_count(then).alias("words"), (then != now).alias("changed")))
            return F.concat(done, behind(then, rest[1:])) if rest[1:] else done

        return tx.let(change(now), of)

    return tx.let(text, lambda t: behind(t, list(named.items())))


def unigram_perplexity(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """D-13's native stand-in: exp of the mean of -log(count / total) of a text's tokens in the corpus; null without tokens.

    Tokens are counted within a text, by the runs of its sorted ones, so that a common token costs one row a document, and
    the counts of the corpus are written, so that Spark knows whether they can be sent to the texts instead.
    """
    each = df.select(key, F.explode_outer(_counted(tx.tokens(F.coalesce(F.col(text), F.lit(""))))).alias("x")).select(key, "x.token", "x.n")
    counts = readers.settled(each.where("token is not null").groupBy("token").agg(F.sum("n").alias("c")))
    total = counts.agg(F.sum("c").alias("total"))
    logs_ = each.join(counts, "token", "left").groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("c")).alias("s"))
    return logs_.select(key, F.when(F.col("n") > 0, F.exp(F.log(total.scalar().cast("double")) - F.col("s") / F.col("n"))).alias("perplexity"))


def _counted(tokens: Column) -> Column:
    """Array of (token, n) of the distinct tokens."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    run = lambda s, p, at, k: F.struct(F.get(s, at).alias("token"), (F.coalesce(F.get(p, k + 1), F.size(s)) - at).cast("long").alias("n"))
    runs = lambda s: tx.let(starts(s), lambda p: F.transform(p, lambda at, k: run(s, p, at, k)))
    return tx.let(F.sort_array(tokens), lambda s: F.when(F.size(s) > 0, runs(s)))
