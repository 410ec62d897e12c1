"""Ensembles, rewards, payload parsing and evaluation roll-ups (A-*, D-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensemble(scores: DataFrame, *keys: str) -> DataFrame:
    """A-01, A-24, M-03: weighted mean of (detector, weight, p_ai) by keys, 1 where weights sum to 0, and the scores by name."""
    w = F.sum("weight")
    mean = F.coalesce(F.sum(F.col("weight") * F.col("p_ai")) / F.nullif(w, F.lit(0.0)), F.lit(1.0))
    return scores.groupBy(*keys).agg(mean.alias("aggregate"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("detector", "p_ai")))).alias("by_name"))


def success_rate(p: Column | str, threshold: float = 0.5) -> Column:
    """A-02, A-03, A-11, P-08: share of scores under the threshold."""
    return F.avg(((F.col(p) if isinstance(p, str) else p) < threshold).cast("double"))


def best_of_n(rate: Column, n: Column) -> Column:
    """A-12, M-07: chance that one of n independent tries passes."""
    return 1 - F.pow(1 - rate, n)


def length_penalty(ratio: Column, low: float = 0.55, high: float = 1.65) -> Column:
    """D-15."""
    return F.when(ratio < low, -0.5 * (low - ratio) / low).when(ratio > high, -0.3 * (ratio - high) / high).otherwise(0.0)


def perplexity_reward(p: Column) -> Column:
    """D-14: perplexity, at most 1e4 and 1000 where it is missing, as a reward."""
    return 1 / (1 + F.least(F.coalesce(p, F.lit(1000.0)), F.lit(1e4)) / 50)


def reward(p_ai: Column, sim: Column, pattern: Column, penalty: Column, perplexity: Column | None = None, weights=(1.5, 0.3, 0.3, 0.5), floor: float = 0.65) -> Column:
    """D-16, P-07: weighted sum, or -1 under the similarity floor."""
    total = weights[0] * (1 - p_ai) + weights[1] * sim + weights[2] * (1 - pattern) + penalty
    if perplexity is not None:
        total = total + weights[3] * perplexity_reward(perplexity)
    return F.when(sim < floor, -1.0).otherwise(total)


def first_reward(p_ai: Column, pattern: Column) -> Column:
    """D-17: the reward of the first runs."""
    return (1 - p_ai) + 0.5 * (1 - pattern)


def reduction(before: Column, after: Column) -> Column:
    """A-07: how much less ``after`` is, as a share of ``before``; null where that is 0."""
    return (before - after) / F.nullif(before, F.lit(0.0))


def pairwise(p_ai: Column, pattern: Column, sim: Column) -> Column:
    """D-18; without a detector's score only pattern and similarity count."""
    return F.coalesce(0.6 * (1 - p_ai), F.lit(0.0)) + 0.3 * (1 - pattern) + 0.1 * sim


def ratio_score(observer: Column, performer: Column) -> Column:
    """D-03: logistic of the ratio of two models' cross-entropies; null where the performer's is 0, as there is no ratio."""
    return 1 / (1 + F.exp(-25 * (0.9015 - observer / F.nullif(performer, F.lit(0)))))


def advantage(r: Column, window) -> Column:
    """A-17: reward against its group, by the sample standard deviation."""
    return (r - F.avg(r).over(window)) / (F.stddev_samp(r).over(window) + 1e-6)


# Parts of a label's name that mark the class of machine-made texts.
MADE_LABELS = ("fake", "ai", "machine", "generated", "llm", "label_1")


def made_label(labels: list[str]) -> int:
    """D-02: the place of the first label that names machine-made texts, else of the last one."""
    return next((k for k, label in enumerate(labels) if any(part in label.lower() for part in MADE_LABELS)), len(labels) - 1)


def softmax(logits: Column) -> Column:
    """D-02: probabilities of an array of logits, from the largest down, so that none overflows; null if a logit is."""
    top = F.array_max(logits)
    odds = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.when(total.isNotNull(), F.transform(logits, lambda x: F.exp(x - top) / total))


def classified(logits: Column, labels: list[str]) -> Column:
    """D-02: the probability that a classifier with these labels gives to machine-made."""
    return F.get(softmax(logits), F.lit(made_label(labels)))


def _unit(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def _num(raw: Column, path: str) -> Column:
    return F.get_json_object(raw, path).try_cast("double")


def payload_a(raw: Column, mixed_weight: float = 0.5) -> Column:
    """D-04: share of AI plus a share of mixed, or one of two older fields; null (an error) without any."""
    ai = _num(raw, "$.documents[0].class_probabilities.ai")
    mixed = F.coalesce(_num(raw, "$.documents[0].class_probabilities.mixed"), F.lit(0.0))
    return F.coalesce(_unit(ai + mixed_weight * mixed), _num(raw, "$.documents[0].completely_generated_prob"), _num(raw, "$.documents[0].average_generated_prob"))


def payload_b(raw: Column) -> Column:
    """D-05; null where the call did not succeed."""
    failed = F.get_json_object(raw, "$.success") == "false"
    return F.when(~F.coalesce(failed, F.lit(False)), F.coalesce(_num(raw, "$.score.ai"), _num(raw, "$.ai_score")))


def payload_c(raw: Column, assisted_weight: float = 0.5) -> Column:
    """D-06: fractions, older scalars, class probabilities, then the predicted class by its confidence."""
    fraction = _unit(_num(raw, "$.fraction_ai") + assisted_weight * F.coalesce(_num(raw, "$.fraction_ai_assisted"), F.lit(0.0)))
    kind, sure = F.lower(F.get_json_object(raw, "$.predicted_class")), F.coalesce(_num(raw, "$.confidence"), F.lit(1.0))
    by_class = F.when(kind == "mixed", 0.5).when(kind == "ai", sure).when(kind == "human", 1 - sure)
    return F.coalesce(fraction, _num(raw, "$.ai_likelihood"), _num(raw, "$.class_probabilities.ai"), by_class)


def cosine(a: Column, b: Column) -> Column:
    """D-11; vectors of doubles. A vector of zeros is similar to none (0); null where the lengths differ or an element is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.when(F.size(a) == F.size(b), 0.0)).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))
