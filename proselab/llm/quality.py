"""Quality classifier from weak labels.

Heuristic labellers each vote good, bad or nothing on a document. Expectation-maximisation over the counts of
vote patterns estimates every labeller's accuracies in both classes and the share of good documents, without
any label; a pattern's posterior labels its documents. The posteriors of a bounded sample train a linear scorer
on hashed token shapes, which then scores every document, also where the labellers say nothing.

The counts of patterns cover all documents; there are at most 3 to the number of labellers. The sample that
trains the scorer has at most ``SAMPLE`` different pairs of doc_id and text, those whose hashes are smallest; a
row that others repeat in both is drawn once.

A null or empty text has no token: it scores 0 and is rejected. Null and repeated doc_ids and repeated rows are
documents like others. Texts are read whole. An empty table gives an empty result and a scorer that keeps what
the labellers' thresholds would. Only doc_id and text are read; other columns stay as they are in ``keep``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselab.llm.common import dealt, documents

SAMPLE, DIMENSIONS = 10_000, 1 << 14
GOOD, BAD, NONE = "+", "-", "0"
_SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\[\]{}<>/@|-]{2,}")
_WORD = re.compile(r"""["'(\[«„“¿¡]*[^\W\d_](?:[^\W\d_]|[-'’](?=[^\W\d_]))*[.,;:!?"')\]»“”]*\Z""")
#: (name, bad from, good to): shares at or over the first are bad, at or under the second good; None: never says good.
LABELLERS = (
    ("symbols", 0.10, None),
    ("capitals", 0.40, None),
    ("bars", 0.08, None),
    ("stutter", 0.20, None),
    ("shouts", 0.20, None),
    ("redundant", 0.80, 0.70),
    ("commonest", 0.30, None),
    ("malformed", 0.25, 0.10),
)


def measures(text: str, words: list[str], counts: Counter) -> list[float]:
    n, raw = len(words), text.encode()
    symbols = capitals = formed = plain = 0
    for w, c in counts.items():
        upper = len(w) > 1 and w.isupper()
        capitals += c * upper
        if not upper and _WORD.match(w):
            formed += c
        elif _SYMBOLS.search(w):
            symbols += c
        elif w != "|" and not any(map(str.isalpha, w)):
            plain += c  # numbers and the like are neither well nor badly formed
    return [
        symbols / n,
        capitals / n,
        counts["|"] / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        text.count("!") / n,
        1 - len(zlib.compress(raw, 1)) / len(raw),
        max(counts.values()) / n if n >= 20 else 0.0,
        1 - (formed + plain) / n,
    ]


def votes(text: str) -> str:
    words = text.split()
    if not words:
        return BAD * len(LABELLERS)
    found = measures(text, words, Counter(words))
    return "".join(BAD if x >= bad else GOOD if good is not None and x <= good else NONE for x, (_, bad, good) in zip(found, LABELLERS))


class _Kinds(dict):
    """For str.translate: letters by case, digits, other signs as they are."""

    def __missing__(self, code):
        c = chr(code)
        self[code] = k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return k


class _Slots(dict):
    def __missing__(self, kinds):
        self[kinds] = k = zlib.crc32(kinds.encode()) % DIMENSIONS
        return k


_KINDS, _SLOTS = _Kinds(), _Slots()


def shape(word: str) -> int:
    """A token's feature: the kinds of its first two and last four signs, and whether there are more."""
    if len(_SLOTS) > 1 << 18:
        _SLOTS.clear()
    return _SLOTS[(word[:2] + "~" * (len(word) > 6) + word[2:][-4:]).translate(_KINDS)]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features, of a length under one that grows with the number of words."""
    words = text.split()
    counts = Counter(words)
    bag: Counter = Counter()
    for w, c in counts.items():
        bag[shape(w)] += c
    bag[zlib.crc32(b"\0again") % DIMENSIONS] += sum(map(str.__eq__, words, words[1:]))
    bag[zlib.crc32(b"\0commonest %d" % (10 * max(counts.values(), default=0) // max(len(words), 1))) % DIMENSIONS] += len(words) / 4
    at = np.fromiter(bag, np.int32, len(bag))
    value = np.sqrt(np.fromiter(bag.values(), float, len(bag)))
    # few words say little either way
    return at, value / max(np.sqrt((value**2).sum()), 1e-12) * len(words) / (len(words) + 10)


def learn_labellers(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, float]:
    """Each pattern's posterior of good, the labellers' vote probabilities (class, labeller, vote), the share of good."""
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    hot = np.array([[[v == k for k in (GOOD, BAD, NONE)] for v in p] for p in names], float).reshape(len(names), len(names[0]) if names else len(LABELLERS), 3)
    post = np.array([0.1 if p.count(BAD) > 1 or p.count(GOOD) == 0 else 0.9 for p in names])
    table, prior = np.full((2, hot.shape[1], 3), 1 / 3), 0.5
    for _ in range(rounds if len(names) else 0):
        for c, w in ((0, n * post), (1, n * (1 - post))):
            table[c] = (np.einsum("i,ijk->jk", w, hot) + 0.5) / (w.sum() + 1.5)
        prior = (float((n * post).sum()) + 1) / (n.sum() + 2)
        like = np.einsum("ijk,cjk->ci", hot, np.log(table)) + np.log([[prior], [1 - prior]])
        post = 1 / (1 + np.exp(np.clip(like[1] - like[0], -500, 500)))
    return dict(zip(names, post.tolist())), table, prior


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 400, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels by full-batch Adam."""
    weight, bias = np.zeros(DIMENSIONS), 0.0
    if not rows:
        return weight, bias
    lens = [len(a) for a, _ in rows]
    row = np.repeat(np.arange(len(rows)), lens)
    at, value = (np.concatenate(x) for x in zip(*rows))
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weight[at] * value, len(rows)) + bias, -50, 50)))
        err = (p - target) / len(rows)
        g = np.append(np.bincount(at, value * err[row], DIMENSIONS) + decay * weight, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weight, bias = weight - step[:-1], bias - step[-1]
    return weight, bias


class Scorer:
    """The trained model: the patterns' posteriors and the linear scorer."""

    def __init__(self, posterior: dict[str, float], weight: np.ndarray, bias: float):
        self.posterior, self.weight, self.bias = posterior, weight.astype(np.float32), float(bias)

    def score(self, text: str | None) -> float:
        if not text or not text.strip():
            return 0.0
        at, value = features(text)
        return float(1 / (1 + np.exp(-np.clip(float((self.weight[at] * value).sum()) + self.bias, -50, 50))))


def train(df: DataFrame, sample: int = SAMPLE) -> Scorer:
    docs = dealt(documents(df))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = Counter(map(votes, b["text"]))
            yield pd.DataFrame({"votes": list(found), "n": list(found.values())})

    counted = docs.select("text").mapInPandas(vote, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    patterns = {r["votes"]: r["n"] for r in counted.collect()}
    posterior, _, _ = learn_labellers(patterns)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            b = b.drop_duplicates("place")
            b = b[~b["place"].isin(seen)]
            seen.update(b["place"])
            found = [features(t) for t in b["text"]]
            yield pd.DataFrame({"place": b["place"].to_numpy(), "votes": [votes(t) for t in b["text"]], "at": [a for a, _ in found], "value": [v for _, v in found]})

    placed = docs.select("text", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text", F.lit(8)).alias("place"))
    # the bound is on hashes alone, so that no text is sorted or sent
    last = placed.select("place").distinct().orderBy("place").limit(sample).agg(F.max("place")).first()[0]
    chosen = placed.where(F.col("place") <= F.lit(last).cast("long")).mapInPandas(describe, "place long, votes string, at array<int>, value array<double>")
    rows = chosen.dropDuplicates(["place"]).toPandas()
    rows = rows.sort_values(["votes", "place"])
    pairs = [(np.asarray(a, np.int64), np.asarray(v)) for a, v in zip(rows["at"], rows["value"])]
    weight, bias = train_scorer(pairs, np.array([posterior[v] for v in rows["votes"]]))
    return Scorer(posterior, weight, bias)


def scored(df: DataFrame, model: Scorer) -> DataFrame:
    """doc_id, score, votes, posterior, kept for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = np.array([model.score(t) for t in b["text"]], float)
            v = [votes(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": s, "votes": v, "posterior": [model.posterior.get(x, 0.5) for x in v], "kept": s >= 0.5})

    return dealt(documents(df)).mapInPandas(run, "doc_id long, score double, votes string, posterior double, kept boolean")


def keep(df: DataFrame, model: Scorer, least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose text scores ``least`` or more, with all their columns."""

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) >= least for t in text], dtype=bool)

    return dealt(df).where(good("text"))
