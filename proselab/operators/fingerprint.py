"""The stylometric fingerprint: thirteen signals from 0 to 1, their weighted mean and flags (F-01 to F-18).

``with_features`` adds what the signals share once; every signal is an expression over those columns, so a
fingerprint is one scan and one projection without a shuffle. Tokens, their runs, plain pieces and sentences are counted by
one Arrow function, as Spark interprets such folds item by item, and so are patterns, on a plain form of the
text that has letters, white space and parts of words beyond ASCII as ASCII signs of their kind.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from proselab.functions import lexicon as lx
from proselab.functions import text as tx
from proselab.sources import readers

#: Pieces of which every match of a signal's pattern has one.
_MODAL = ("must", "should", "ought to", "need to", "needs to", "have to", "has to")
_SHAPES = ("but", "whether", "from", "about")

FEATURES = ("body", "low", "wc", "tok", "sents", "sent_words", "_counts")
#: T-04 of lower-cased texts: what is no part of a token is a space.
_TOKEN = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz'-" else 32 for c in range(256))
COUNTS = (
    "tokens", "types", "repeats", "favourites", "transitions", "hedges", "contracted", "expanded", "shapes", "modals",
    "reduced_favourites", "reduced_transitions", "reduced_hedges", "reduced_contracted", "reduced_expanded",
    "sentences", "words", "squares", "starts", "abstract", "dashes", "tricolons",
)


def tokens(low: str) -> list[bytes]:
    """T-04 of a lower-cased text: runs of letters, apostrophes and hyphens from their first letter on."""
    runs = low.encode(errors="replace").translate(_TOKEN)
    if b" '" in runs or b" -" in runs or runs[:1] in (b"'", b"-"):
        return [t for t in (r.lstrip(b"'-") for r in runs.split()) if t]
    return runs.split()


@lru_cache(1 << 16)
def _kind(sign: str) -> str:
    """What a sign beyond ASCII is to a pattern in any case: a letter, white space but no blank, part of a word, or neither."""
    kind, code = unicodedata.category(sign), ord(sign)
    word = kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or code in (0x200C, 0x200D) or 0x24B6 <= code <= 0x24E9 or 0x1F130 <= code <= 0x1F189
    return _FOLDED.get(sign) or ("\t" if sign in tx.SPACES else "_" if word else "\x01")


_FOLDED = dict(zip("\u017f\u212a\u0131\u0130", "skii"))
_BEYOND = re.compile(r"[^\x00-\x7f]")


def _ascii(text: str) -> str:
    """A text with its signs beyond ASCII as ASCII ones of their kind, each in its place."""
    if text.isascii():
        return text
    signs = set(_BEYOND.findall(text))
    if len(signs) > 32:
        return _BEYOND.sub(lambda m: _kind(m[0]), text)
    for sign in signs:
        text = text.replace(sign, _kind(sign))
    return text


def plain(text: str) -> str:
    """A text in lower case with its signs beyond ASCII as ASCII ones of their kind."""
    return _ascii(text).lower()


def _pattern(p: str) -> Callable[[str], int]:
    """How often a pattern, which is in ASCII, is in the lower-cased plain form of a text.

    The bound before its first words is looked at behind them, as a search for plain letters costs far less.
    """
    head = re.match(r"\\b(?:\(\?:([a-z |]+)\)|([a-z]+))", p)
    if head:
        p = f"(?:{'|'.join(rf'{w}(?<!\w{w})' for w in (head[1] or head[2]).split('|'))}){p[head.end() :]}"
    found = re.compile(p, re.ASCII).finditer
    return lambda t: sum(1 for _ in found(t))


_modals = _pattern(lx.MODALS)
_shapes = [(word, _pattern(p)) for word, p in zip(_SHAPES, lx.ENUMERATIONS, strict=True)]


def _lists(p: str) -> list[list[str]]:
    """The words of a pattern's groups, in lower case."""
    return [g.lower().split("|") for g in re.findall(r"\(([^()]*)\)", p)]


_CONTRACTED, _REDUCED_CONTRACTED = (frozenset(_lists(p)[0]) for p in (lx.CONTRACTED, lx.REDUCED_CONTRACTED))
_EXPANDED, _REDUCED_EXPANDED = ([frozenset(g) for g in _lists(p)] for p in (lx.EXPANDED, lx.REDUCED_EXPANDED))
_FIRSTS, _SECONDS = tuple(_EXPANDED[0]), [f" {w}" for w in _EXPANDED[1]]
_short = re.compile(r"'(?:t|s|re|m|ve|d|ll)\b", re.ASCII).finditer
_is_word = re.compile(r"\w", re.ASCII).match
_last_word = re.compile(r"\w+\Z", re.ASCII).search


def _word_before(t: str, at: int) -> str:
    """The word that ends at a place; of a long one its end, which is none of those looked for."""
    found = _last_word(t[max(0, at - 12) : at])
    return found[0] if found else ""


def _contractions(t: str) -> tuple[int, int]:
    """Matches of ``CONTRACTED`` and its reduced form in the lower-cased plain form of a text: all of them have one of ``_short``."""
    found = [_word_before(t, m.start()) + m[0] for m in _short(t)] if "'" in t else []
    return sum(map(_CONTRACTED.__contains__, found)), sum(map(_REDUCED_CONTRACTED.__contains__, found))


def _expansions(t: str) -> tuple[int, int]:
    """The same for ``EXPANDED``, whose matches do not overlap: they are found by their second words."""
    found = []
    for piece in _SECONDS:
        at = t.find(piece)
        while at >= 0:
            to = at + len(piece)
            if t[max(0, at - 8) : at].endswith(_FIRSTS) and not _is_word(t, to):
                found.append((at, to, _word_before(t, at), piece[1:]))
            at = t.find(piece, to)
    found.sort()

    def among(firsts: frozenset, seconds: frozenset) -> int:
        n = end = 0
        for at, to, first, second in found:
            if first in firsts and second in seconds and at - len(first) >= end:
                n, end = n + 1, to
        return n

    return (among(*_EXPANDED), among(*_REDUCED_EXPANDED)) if found else (0, 0)


_last_of_three = re.compile(r",\s+(?:and|or)\s+\w+", re.ASCII).finditer
_one_word = re.compile(r"\s+\w+", re.ASCII).fullmatch


def _tricolons(t: str) -> int:
    """Matches of ``TRICOLON`` in the plain form of a text in its case, found by their last word."""
    n = end = 0
    for m in _last_of_three(t):
        comma = t.rfind(",", end, m.start())
        if comma > end and _is_word(t, comma - 1) and _one_word(t, comma + 1, m.start()):
            n, end = n + 1, m.end()
    return n


_bound = re.compile(r"[.!?] (?=[A-Z\"'(])").finditer
#: What is white space to Python alone.
_CONTROLS = dict(zip(range(0x1C, 0x20), range(0xFDD0, 0xFDD4)))


def _sentences(body: str, ascii_: str) -> tuple[int, int, int, int, int]:
    """T-01 to T-03: a text's sentences, their words, the sum of the squares of those, the most sentences with the same first two words, and those that begin with an abstract subject."""
    if any(chr(c) in body for c in _CONTROLS):
        body, ascii_ = body.translate(_CONTROLS), ascii_.translate(dict.fromkeys(_CONTROLS, "\x01"))
    # bounds and words are the same with one space for any white space, and words are counted by their spaces
    single = " ".join(body.split())
    if not single:
        return 0, 0, 0, 0, 0
    cuts = [m.start() + 1 for m in _bound(single if single.isascii() else " ".join(ascii_.split()))]
    words = squares = abstract = begin = 0
    starts: dict[str, int] = {}
    for end in (*cuts, len(single)):
        k = single.count(" ", begin, end) + 1
        words, squares = words + k, squares + k * k
        second = single.find(" ", single.find(" ", begin, end) + 1, end) if k > 2 else end
        start = single[begin:second]
        starts[start] = starts.get(start, 0) + 1
        if start[:4].lower() == "the ":
            abstract += single[begin : min(end, begin + _LONGEST)].lower().startswith(lx.ABSTRACT_SUBJECTS)
        begin = end + 1
    if abstract and single != body:  # a subject's words have one space between them
        ends = [m.span() for m in _any_bound(ascii_)]
        begins, ends = [0, *(b for _, b in ends)], [*(a + 1 for a, _ in ends), len(body)]
        abstract = sum(body[a:b].lstrip()[:_LONGEST].lower().startswith(lx.ABSTRACT_SUBJECTS) for a, b in zip(begins, ends))
    return len(cuts) + 1, words, squares, max(starts.values()), abstract


_any_bound = re.compile(r"[.!?]\s+(?=[A-Z\"'(])", re.ASCII).finditer
_LONGEST = max(map(len, lx.ABSTRACT_SUBJECTS))


def repeats(tok: list[bytes], types: set[bytes], n: int = 4) -> int:
    """How many of the runs of n tokens equal another one; a run's numbers of tokens are one number where they fit."""
    bits = max(1, len(types).bit_length())
    if len(tok) <= n:
        return 0
    if n * bits > 64:
        return sum(c for c in Counter(zip(*(tok[k:] for k in range(n)))).values() if c > 1)
    number = dict(zip(types, range(len(types))))
    ids = np.fromiter(map(number.__getitem__, tok), np.uint64, len(tok))
    runs = ids[: 1 - n]
    for k in range(1, n):
        runs = (runs << np.uint64(bits)) | ids[k : len(ids) - n + 1 + k]
    runs.sort()
    same = runs[1:] == runs[:-1]
    return int(np.count_nonzero(same) + np.count_nonzero(same[:1]) + np.count_nonzero(same[1:] > same[:-1]))


_FAVOURITES, _REDUCED = (frozenset(w.encode() for w in words) for words in (lx.FAVOURITES, lx.REDUCED_FAVOURITES))
_TRANSITIONS = {*lx.TRANSITIONS, *lx.REDUCED_TRANSITIONS}


def _inner(piece: str) -> list[bytes]:
    """The words of a lower-cased piece that have a blank on both sides, so that they are tokens of every text with it."""
    return [w.encode() for w in re.findall(r"(?<= )[a-z][a-z'-]*(?= )", piece)]


_HEDGES = [(p, max(_inner(p), key=len, default=None)) for p in {*lx.HEDGES, *lx.REDUCED_HEDGES}]


def _counts(body: str) -> tuple[int, ...]:
    """What ``COUNTS`` names, of a text."""
    low, ascii_ = body.lower(), _ascii(body)
    any_case = ascii_.lower()
    tok = tokens(low)
    types = set(tok)
    favourites = {w: tok.count(w) for w in (_FAVOURITES | _REDUCED) & types}
    # pieces of the reduced lists are mostly in the others as well
    transitions, hedges = {p: body.count(p) for p in _TRANSITIONS}, {p: low.count(p) if w is None or w in types else 0 for p, w in _HEDGES}
    (contracted, reduced_contracted), (expanded, reduced_expanded) = _contractions(any_case), _expansions(any_case)
    return (
        len(tok), len(types), repeats(tok, types), sum(n for w, n in favourites.items() if w in _FAVOURITES), sum(map(transitions.__getitem__, lx.TRANSITIONS)), sum(map(hedges.__getitem__, lx.HEDGES)),
        contracted, expanded, sum(n(any_case) for word, n in _shapes if word in any_case), _modals(any_case) if any(map(any_case.__contains__, _MODAL)) else 0,
        sum(n for w, n in favourites.items() if w in _REDUCED), sum(map(transitions.__getitem__, lx.REDUCED_TRANSITIONS)), sum(map(hedges.__getitem__, lx.REDUCED_HEDGES)), reduced_contracted, reduced_expanded,
        *_sentences(body, ascii_), body.count("—") + body.count("--"), _tricolons(ascii_),
    )


@F.pandas_udf(StructType([StructField(n, LongType() if n == "squares" else IntegerType()) for n in COUNTS]))
def _counted(bodies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_counts(b) for b in bodies], columns=COUNTS)


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with body, low, wc (at least 1), tok, sents, sent_words and _counts; a null text counts as empty."""
    readers.few_rows(df.sparkSession)
    body = df.withColumn("body", F.coalesce(F.col(text), F.lit("")))
    return body.withColumns({
        "low": F.lower("body"), "tok": tx.tokens("body"), "sents": tx.sentences("body"),
    }).withColumn("sent_words", F.transform("sents", tx.word_count)).withColumn("_counts", _counted("body")).withColumn("wc", F.greatest(F.col("_counts.words"), F.lit(1)))


def _mean(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x) / F.greatest(F.size(counts), F.lit(1))


def spread(counts: Column) -> Column:
    """Population standard deviation over the mean; 0 for an empty or all-zero array. Sums of whole numbers are exact."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x * x)
    return _spread(F.size(counts), total, squares)


def _spread(n: Column, total: Column, squares: Column) -> Column:
    return F.coalesce(F.sqrt((n * squares - total * total).cast("double")) / F.nullif(total, F.lit(0)), F.lit(0.0))


def sentence_spread() -> Column:
    """``spread`` of the words of a text's sentences, over the columns of ``with_features``."""
    c = F.col("_counts")
    return _spread(c["sentences"], c["words"].cast("long"), c["squares"])


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _per_100(hits: Column, n: Column) -> Column:
    return hits * F.lit(100.0) / n


def signals() -> dict[str, Column]:
    """The signals by name, over the columns of ``with_features``."""
    c = {k: F.col(k) for k in FEATURES}
    n_sents, n_tok = c["_counts"]["sentences"], c["_counts"]["tokens"]
    some = F.greatest(n_tok, F.lit(1))
    contracted, expanded = c["_counts"]["contracted"], c["_counts"]["expanded"]
    grams = F.greatest(n_tok - 3, F.lit(1))
    return {
        "burstiness": F.when(n_sents < 3, 0.5).otherwise(_unit(1 - sentence_spread() / 0.7)),
        "stiff_transitions": tx.logistic(_per_100(c["_counts"]["transitions"], c["wc"]), 0.8),
        "favorite_words": F.when(n_tok == 0, 0.0).otherwise(tx.logistic(_per_100(c["_counts"]["favourites"], some), 1.0)),
        "em_dash_density": tx.logistic(_per_100(c["_counts"]["dashes"], c["wc"]), 0.7),
        "hedging": tx.logistic(_per_100(c["_counts"]["hedges"], c["wc"]), 0.4),
        "tricolons": tx.logistic(_per_100(c["_counts"]["tricolons"], c["wc"]), 0.8),
        "contraction_deficit": F.when(contracted + expanded < 2, 0.0).otherwise(expanded / F.greatest(contracted + expanded, F.lit(1))),
        "ngram_repetition": F.when(n_tok < 9, 0.0).otherwise(F.least(F.lit(1.0), c["_counts"]["repeats"] / grams / F.lit(0.15))),
        "type_token": F.when(n_tok < 50, 0.5).otherwise(_unit((F.lit(0.65) - c["_counts"]["types"] / some) / 0.25)),
        "sentence_start_uniformity": F.when(n_sents < 4, 0.0).otherwise(F.least(F.lit(1.0), (c["_counts"]["starts"] - 1) / F.greatest(n_sents - 1, F.lit(1)))),
        "abstract_subject": F.when(n_sents < 3, 0.0).otherwise(tx.logistic(c["_counts"]["abstract"] / F.greatest(n_sents, F.lit(1)), 0.20, 10.0)),
        "enumeration_shape": tx.logistic(_per_100(c["_counts"]["shapes"], c["wc"]), 0.7),
        "modality_overload": tx.logistic(_per_100(c["_counts"]["modals"], c["wc"]), 2.0, 4.0),
    }


def aggregate(weights=lx.WEIGHTS) -> Column:
    """F-14 over the signals' columns."""
    total = F.lit(0.0)
    for name, w in weights:
        total = total + F.col(name) * w
    return total / sum(w for _, w in weights)


def flagged(least: float = lx.FLAG_FROM) -> Column:
    """F-15: names of the signals at ``least`` or more, in the order of the weights."""
    names = F.array(*(F.when(F.col(name) >= least, F.lit(name)) for name, _ in lx.WEIGHTS))
    return F.filter(names, lambda x: x.isNotNull())


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with all signals, aggregate and flagged."""
    out = with_features(df, text).withColumns(signals()).drop(*FEATURES)
    return out.withColumns({"aggregate": aggregate(), "flagged": flagged()})


def explain(df: DataFrame) -> DataFrame:
    """F-16: a fingerprint's report as text: aggregate, a line a signal with its bar, and the flags if there are any."""
    lines = [F.concat(F.lit("  "), F.format_number(F.col(name), 2), F.lit(" "), F.rpad(tx.bar(name), 20, " "), F.lit("  " + lx.SIGNAL_NOTES[name])) for name, _ in lx.WEIGHTS]
    head = F.concat(F.lit("Aggregate AI-likeness: "), F.format_number("aggregate", 2))
    tail = F.when(F.size("flagged") > 0, F.concat(F.lit("Flagged: "), F.array_join("flagged", ", ")))
    return df.withColumn("report", F.concat_ws("\n", head, *lines, tail))


#: F-17: the five signals of training runs and their weights.
REDUCED = (("burstiness", 1.5), ("stiff_transitions", 1.3), ("favorite_words", 1.6), ("hedging", 1.2), ("contraction_deficit", 1.0))


def reduced_signals(text: str = "text") -> dict[str, Column]:
    """F-17's signals over the columns of ``with_features``: smaller word lists, and no least number of contractions."""
    c = {k: F.col(k) for k in FEATURES}
    contracted, expanded = c["_counts"]["reduced_contracted"], c["_counts"]["reduced_expanded"]
    return {
        "burstiness": F.when(c["_counts"]["sentences"] < 3, 0.5).otherwise(_unit(1 - sentence_spread() / 0.7)),
        "stiff_transitions": tx.logistic(_per_100(c["_counts"]["reduced_transitions"], c["wc"]), 0.8),
        "favorite_words": tx.logistic(_per_100(c["_counts"]["reduced_favourites"], F.greatest(c["_counts"]["tokens"], F.lit(1))), 1.0),
        "hedging": tx.logistic(_per_100(c["_counts"]["reduced_hedges"], c["wc"]), 0.4),
        "contraction_deficit": F.coalesce(expanded / F.nullif(contracted + expanded, F.lit(0)), F.lit(0.0)),
    }


def reduced_aggregate(text: str = "text") -> Column:
    """F-17 over the columns of ``with_features``; an empty text scores 1."""
    found, total = reduced_signals(text), F.lit(0.0)
    for name, w in REDUCED:
        total = total + found[name] * w
    return F.when(tx.strip("body") == "", 1.0).otherwise(total / sum(w for _, w in REDUCED))


def sentence_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """F-18: n_sentences, mean_words, std_words, cv_words, min_words, max_words; zeros without a sentence."""
    f = with_features(df, text)
    w = F.col("sent_words")
    mean, cv = _mean(w), spread(w)
    return f.withColumns({
        "n_sentences": F.size(w), "mean_words": mean, "std_words": cv * mean, "cv_words": cv,
        "min_words": F.coalesce(F.array_min(w), F.lit(0)), "max_words": F.coalesce(F.array_max(w), F.lit(0)),
    }).drop(*FEATURES)


def vocabularies(df: DataFrame, *by: str, text: str = "text", precision: int = 14) -> DataFrame:
    """A-21, mergeable: ``by`` and sketch, the distinct tokens of each group's texts; sketches of parts can be united later."""
    each = df.select(*by, F.explode(tx.tokens(F.coalesce(F.col(text), F.lit("")))).alias("token"))
    return each.groupBy(*by).agg(F.hll_sketch_agg("token", F.lit(precision)).alias("sketch"))


def distinct_by(sketches: DataFrame, *by: str) -> DataFrame:
    """A-21: ``by`` and estimate, the number of distinct tokens of the united sketches, within about a hundredth at the default precision."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(False))).alias("estimate"))
