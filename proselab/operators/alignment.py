"""D-12: how well two texts' words can be aligned, each with its most similar one (precision, recall, F1).

A word is the set of its three-character pieces with a sign before and behind; two words are as similar as these
sets' cosine. Every word is aligned with the most similar one of the other text. A word that the other text has
too is aligned with itself, so only the others look for a partner, by the pieces that they share. Two texts of a row
meet where the row is: nothing is shuffled, and what is held is one text's words.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselab.functions import text as tx
from proselab.sources import readers

SIGNS = "abcdefghijklmnopqrstuvwxyz'-<>"
_NUMBER = np.zeros(128, np.int64)
_NUMBER[list(SIGNS.encode())] = np.arange(len(SIGNS))
_END, _ALL = len(SIGNS) - 1, len(SIGNS) ** 3
#: Other words that look for their shared pieces at a time.
STEP = 2048


def pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, piece as a number) of the distinct pieces of three characters of each token between a sign before and one behind."""
    x = _NUMBER[np.frombuffer(f"<{'><'.join(words)}>".encode(), np.uint8)]
    inside = (x[:-2] != _END) & (x[1:-1] != _END)
    place = np.cumsum(x[:-2] == _END - 1) - 1
    found = np.sort((place * _ALL + (x[:-2] * len(SIGNS) + x[1:-1]) * len(SIGNS) + x[2:])[inside])
    found = found[np.diff(found, prepend=-1) > 0]
    return found // _ALL, found % _ALL


def _table(place: np.ndarray, at: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """Which of n columns the pieces of each word fall on."""
    table = np.zeros((n_words, n), np.float32)
    table[place[at >= 0], at[at >= 0]] = 1
    return table


def lost(words: Counter, others: Counter) -> float:
    """What the words lack of being all aligned with equal ones: 1 less the best cosine, over the words that ``others`` has not."""
    lone = [w for w in words if w not in others]
    if not lone or not others:
        return float(sum(words[w] for w in lone))
    place, piece = pieces(lone)
    known = np.unique(piece)
    column = np.full(_ALL, -1, np.int32)
    column[known] = np.arange(len(known))
    mine, size = _table(place, column[piece], len(lone), len(known)), np.bincount(place)
    best, rest = np.zeros(len(lone)), list(others)
    for a in range(0, len(rest), STEP):
        part = rest[a : a + STEP]
        place, piece = pieces(part)
        shared = _table(place, column[piece], len(part), len(known)) @ mine.T
        best = np.maximum(best, (shared / np.sqrt(np.bincount(place))[:, None]).max(0))
    return math.fsum(words[w] * (1 - b) for w, b in zip(lone, (best / np.sqrt(size)).tolist()))


def aligned(df: DataFrame, candidate: str, reference: str) -> DataFrame:
    """``df`` with precision, recall and f1 of the words of ``candidate`` against those of ``reference``.

    Two texts without words are alike (1), one without words is like no other (0). A null text has no words.
    """
    readers.few_rows(df.sparkSession)

    @F.pandas_udf("p double, q double, c int, r int")
    def both(c: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(c, r):
            x, y = Counter(a), Counter(b)
            rows.append((lost(x, y), lost(y, x), len(a), len(b)))
        return pd.DataFrame(rows, columns=["p", "q", "c", "r"])

    words = lambda c: tx.tokens(F.coalesce(F.col(c), F.lit("")))
    share = lambda a, b, x: F.when(a == 0, (b == 0).cast("double")).otherwise(1 - x / F.nullif(a, F.lit(0)))
    x = F.col("_x")
    out = df.withColumn("_x", both(words(candidate), words(reference))).withColumns({"precision": share(x["c"], x["r"], x["p"]), "recall": share(x["r"], x["c"], x["q"])})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))).select(*df.columns, "precision", "recall", "f1")
