"""D-13: perplexity under a back-off bigram model of other documents' texts.

Documents fall into folds by a hash of their id, and a document is scored by the counts of all other folds, so that no
text is its own model. The chance of a word is its share behind the word before it, mixed with its add-one share of all words,
which stands alone where the word before is unknown; a text begins behind an empty word.

Documents are read in blocks (``blocks``). A block sends each of its distinct words and pairs of words once, with how
often each fold has it there; an owner sums them over the corpus and answers with the other folds' counts, for
the folds that ask. Tokens themselves never move: a block keeps them as places in its list of words. Words are known by 64-bit
hashes, pairs by 64-bit mixtures of two of them.

A text's perplexity is exp of its whole surprise over its number of tokens, NaN without any. The sliding one is the
highest of its windows of ``window`` tokens that begin every ``stride`` tokens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselab import blocks
from proselab.functions import text as tx
from proselab.packing import U64, mix64, pack, planes, unpack, unplanes
from proselab.sources import readers

#: What stands before a text's first word.
START = U64(0)


def fold_of(key: Column, folds: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int")


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and which of them each one is."""
    order = np.argsort(x)
    new = np.diff(x[order], prepend=~x[order[:1]]) != 0
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return x[order][new], at


class Block:
    """Documents' tokens as places in the block's words; word 0 is START."""

    def __init__(self, keys: list, folds: np.ndarray, lens: np.ndarray, words: np.ndarray, word: np.ndarray):
        self.keys, self.folds, self.lens, self.words, self.word = keys, folds, lens, words, word
        self.doc = np.repeat(np.arange(len(lens)), lens)
        self.fold = folds[self.doc]
        first = (np.cumsum(lens) - lens)[lens > 0]
        self.before = np.concatenate([np.zeros(min(1, len(word)), word.dtype), word[:-1]])
        self.before[first] = 0
        self.pairs, self.pair = _distinct(mix64(mix64(words[self.before]) + words[self.word]))

    @classmethod
    def of(cls, keys: list, folds: list[int], tokens: list[np.ndarray]) -> Block:
        lens = np.array([len(t) for t in tokens], np.int64)
        # no word is START, which so comes first
        words, word = _distinct(np.concatenate([np.array([START]), *(np.maximum(t, START + U64(1)) for t in tokens)]))
        # then by falling frequency: the high bytes of places compress away
        by_use = np.concatenate([[0], 1 + np.argsort(-np.bincount(word[1:], minlength=len(words))[1:], kind="stable")])
        place = np.empty(len(by_use), np.int64)
        place[by_use] = np.arange(len(by_use))
        return cls(keys, np.array(folds, np.int64), lens, words[by_use], place[word[1:]])

    def packed(self) -> bytes:
        return pack((self.keys, self.folds, self.lens, self.words, planes(self.word.astype(np.uint32))))

    @classmethod
    def read(cls, data: bytes) -> Block:
        keys, folds, lens, words, word = unpack(data)
        return cls(keys, folds, lens, words, unplanes(word).astype(np.int64))

    def counted(self, at: np.ndarray, n: int, folds: int) -> list[np.ndarray]:
        """By fold, how often each of n things stands at the block's tokens."""
        return list(_narrow(np.bincount(self.fold * n + at, minlength=folds * n)).reshape(folds, n))


def _part(x: blocks.Exchange, keys: np.ndarray) -> np.ndarray:
    return (mix64(keys + U64(1)) % U64(x.parts)).astype(np.uint32)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes each as the largest one needs: mostly one, which is packed several times faster than four."""
    most = counts.max(initial=0)
    return counts.astype(next(k for k in (np.uint8, np.uint16, np.uint32, U64) if most <= np.iinfo(k).max))


def _flag(yes: bool, n: int) -> np.ndarray:
    return np.full(n, yes, np.uint8)


def _sums(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which sum each key has, and the columns' sums by key."""
    found, at = _distinct(keys)
    return at, [np.bincount(at, c, len(found)).astype(np.int64) for c in columns]


def _others(at: np.ndarray, sums: list[np.ndarray], wanted: list[np.ndarray]) -> list[np.ndarray]:
    """By fold, what the other folds have of each key, 0 where nobody asks."""
    total = sum(sums)
    return [_narrow(np.where(w, (total - s)[at], 0)) for s, w in zip(sums, wanted)]


def _answer(folds: int):
    """An owner's answers: words and pairs come with counts by fold (words also with those as the word before), whether they teach, and whether they ask."""

    def answer(channels):
        (key, *n), (pair, *m) = channels
        as_word, as_before, tell, ask = n[:folds], n[folds : 2 * folds], n[-2] > 0, n[-1] > 0
        at, sums = _sums(key, [c * tell for c in (*as_word, *as_before)])
        words, before = sums[:folds], sums[folds:]
        stats = [(f, (all_ := sum(words) - words[f]).sum(), (all_ > 0).sum(), 0) for f in range(folds)]
        out = [_others(at, words, [ask & (c > 0) for c in as_word]) + _others(at, before, [ask & (c > 0) for c in as_before])]
        m_tell, m_ask = m[-2] > 0, m[-1] > 0
        at, sums = _sums(pair, [c * m_tell for c in m[:folds]])
        return [*out, _others(at, sums, [m_ask & (c > 0) for c in m[:folds]])], stats

    return answer


def _windows(nll: np.ndarray, n: np.ndarray, most: int) -> float:
    """The highest perplexity of ``most`` neighbouring stretches, fewer at the beginning."""
    total, size = nll.copy(), n.astype(float)
    for k in range(1, min(most, len(nll))):
        total[k:] += nll[:-k]
        size[k:] += n[:-k]
    return float(np.exp(total / size).max())


def perplexity(df: DataFrame, fit: DataFrame | None = None, key: str = "doc_id", text: str = "text", folds: int = 5, share: float = 0.7, window: int = 1024, stride: int = 512) -> DataFrame:
    """``key``, tokens, perplexity, worst of every row of ``df``, by the texts of ``fit`` (``df`` itself without it).

    ``worst`` is the sliding form. Repeated rows each get their own. Rows without a key are one fold. Rows that do not
    come in the same order again, as they do from a scan, are to be written first.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = sum(d.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0 for d in (df, fit) if d is not None)
    x = blocks.exchange(size)

    def built(d: DataFrame, tells: bool, asks: bool) -> DataFrame:
        def make(ids, tokens):
            b = Block.of([i["key"] for i in ids], [i["fold"] for i in ids], [np.array(t, np.int64).view(U64) for t in tokens])
            if asks:
                yield None, blocks.PAYLOAD, b.packed()
            n, m = len(b.words), len(b.pairs)
            words = [b.words, *b.counted(b.word, n, folds), *b.counted(b.before, n, folds), _flag(tells, n), _flag(asks, n)]
            pairs = [b.pairs, *b.counted(b.pair, m, folds), _flag(tells, m), _flag(asks, m)]
            yield from blocks.asked(x, [(_part(x, b.words), words), (_part(x, b.pairs), pairs)])

        row = F.struct(F.col(key).alias("key"), fold_of(F.col(key), folds).alias("fold")).alias("id")
        hashes = F.transform(tx.tokens(body), lambda w: F.xxhash64(w)).alias("hashes")
        return blocks.build(x, d.select(row, hashes), make, ("id", "hashes"), blocks.BLOCK_CHARS // 6)

    rows = built(df, fit is None, True)
    if fit is not None:
        rows = rows.unionAll(built(fit, True, False))
    rows = readers.settled(blocks.own(x, rows, _answer(folds)))
    stats = {r[0]: r[1:] for r in rows.where(F.col("kind") == blocks.STATS).groupBy("n1").agg(F.sum("n2"), F.sum("n3")).collect()}
    one_of = np.array([float(sum(stats.get(f, (0, 0))) + 1) for f in range(folds)])

    def done(kept, replies):
        if blocks.PAYLOAD not in kept:  # texts that only teach
            return pd.DataFrame(columns=["key", "tokens", "perplexity", "worst"])
        b = Block.read(kept[blocks.PAYLOAD])
        words, pairs = blocks.answered(x, [_part(x, b.words), _part(x, b.pairs)], replies)
        at = lambda columns, i: np.stack(columns)[b.fold, i].astype(float)
        word, context, c = at(words[:folds], b.word), at(words[folds:], b.before), at(pairs, b.pair)
        one = (word + 1) / one_of[b.fold]
        nll = -np.log(np.where(context > 0, share * c / np.maximum(context, 1) + (1 - share) * one, one))
        out, ends = [], np.cumsum(b.lens)
        for k, z, n in zip(b.keys, ends.tolist(), b.lens.tolist()):
            mine = nll[z - n : z]
            if not n:
                out.append((k, 0, np.nan, np.nan))
                continue
            cuts = np.arange(0, n, stride)
            worst = _windows(np.add.reduceat(mine, cuts), np.diff(cuts, append=n), max(1, window // stride))
            out.append((k, n, float(np.exp(mine.sum() / n)), worst))
        frame = pd.DataFrame(out, columns=["key", "tokens", "perplexity", "worst"])
        return frame.assign(key=pd.Series([r[0] for r in out], dtype=object))

    kind = df.schema[key].dataType.simpleString()
    found = blocks.finish(rows, done, f"key {kind}, tokens long, perplexity double, worst double")
    nan = F.lit(float("nan"))  # which is null behind pandas
    return found.select(F.col("key").alias(key), "tokens", F.coalesce("perplexity", nan).alias("perplexity"), F.coalesce("worst", nan).alias("worst"))
