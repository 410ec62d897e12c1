"""Language-model scoring by deleted interpolation.

A trigram model over ASCII-lower-cased words that end at white space, with one end token a text. The probability
of a word mixes the trigram, bigram and unigram maximum-likelihood estimates and a uniform share over the known
words and one unknown word. Where the pair of words before is unknown, and at a
text's first word, the bigram is the highest estimate. The weights depend on a bucket of the context's frequency
(its binary logarithm, apart for pairs and single words) and are learned by expectation-maximisation: one fold of
the training documents is held out of the counts, and the weights maximise the likelihood of its counts, and of one more token for each estimate, under the
estimates from the other folds, so that none is ever 0. The scores then use the counts of all training documents with these weights.

Counts cover every training document. Words are told apart by 64-bit hashes, bigrams and trigrams by 40 bits
beside the slice that owns them, which holds about a million. The expectation-maximisation reads the held-out tokens' estimates grouped
in steps of a half in their binary logarithms, a table whose size the steps bound.

Blocks of documents ask the owners of words and bigrams first, and then those of the trigrams whose contexts occur
twice or more. A pair that occurs once has one trigram, which its own document knows; it is sent only where a document
that teaches nothing asks for the pair, which the pair's owner tells.

A null or empty text has its end token alone. A null doc_id counts as training. Repeated rows each count;
texts may have any length; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselab import blocks
from proselab.llm.common import U64, discard, documents, materialise, mix64, pack, planes, text_bytes, unpack, unplanes

#: Stand-ins that no word can equal, as words hold no white space; the start is a context only.
END, START = b" ", b"\t"
TEST, DEVELOPMENT, TRAIN = 2, 1, 0
#: Steps for a factor of two in the estimates that the expectation-maximisation sees.
STEPS = 2
#: Buckets of pairs start here; those of single words are below.
PAIRS = 64
NO_ESTIMATE = -1_000_000
#: Bits of a bigram's or trigram's hash that tell it apart within its slice.
KEY_BITS = 40
BLOCK_CHARS = 6 << 20
#: Beside the kinds of rows that all exchanges have: answers about trigrams.
TRIGRAMS = 4


def fold_of(doc_id, folds: int, held_out: int, development: int) -> int:
    """TEST documents teach nothing, DEVELOPMENT ones are held out of the counts behind the weights."""
    k = -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds
    return TEST if k == held_out else DEVELOPMENT if k == development else TRAIN


def words(text: str) -> list[bytes]:
    """bytes.split() without an argument cuts at exactly the bytes 0x20 and 0x09 to 0x0D."""
    return text.encode().lower().split()


def _sequences(texts):
    class Numbers(dict):
        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    numbers, seqs = Numbers({START: 0, END: 1}), []
    for text in texts:
        found = words(text)
        seq = np.empty(len(found) + 2, np.uint32)
        seq[0], seq[-1] = 0, 1
        seq[1:-1] = np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))
        seqs.append(seq)
    return numbers, seqs


def _slices(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts by the high bits of hashes, so that sorted keys have sorted parts."""
    return ((keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


class Block:
    """A block's documents as numbers of its words, its distinct bigrams, and the hashes of both."""

    def __init__(self, ids: list, folds: np.ndarray, lens: np.ndarray, flat: np.ndarray, short: np.ndarray):
        self.ids, self.folds, self.lens, self.flat, self.short = ids, folds, lens, flat, short
        n = len(short)
        #: The places of all contexts; a text's start is one, its end is none.
        self.at = np.flatnonzero(flat != 1)
        self.fold = np.repeat(folds, lens)
        self.word = flat[self.at + 1]
        codes, pair = np.unique(flat[self.at].astype(np.int64) * n + self.word, return_inverse=True)
        self.pair = pair.astype(np.int32)
        self.pair_key = mix64(short[codes // n] * U64(0x9E3779B97F4A7C15) + short[codes % n])

    @classmethod
    def read(cls, payload: bytes) -> Block:
        ids, folds, lens, flat, short = unpack(payload)
        return cls(ids, folds, lens, unplanes(flat), np.frombuffer(short, U64))

    def payload(self) -> bytes:
        return pack((self.ids, self.folds, self.lens, planes(self.flat), self.short.tobytes()))

    def trigrams(self, pair_count: np.ndarray, wanted: np.ndarray, least: int):
        """Which places have a pair as context, their distinct trigrams, and the hashes of these.

        A training document's pair that occurs nowhere else has its one trigram for certain, which is left out unless
        a document that teaches nothing has the pair: in another block, where ``wanted`` says so, or in this one.
        """
        some = np.flatnonzero(self.flat[self.at] != 0)
        pair = self.pair[some - 1]
        test = self.fold[self.at[some]] == TEST
        met = wanted.astype(bool)
        met[pair[test]] = True
        some = some[(pair_count[pair] >= least) & ((pair_count[pair] > 1) | test | met[pair])]
        n = len(self.short)
        codes, which = np.unique(self.pair[some - 1].astype(np.int64) * n + self.word[some], return_inverse=True)
        return some, which.astype(np.int32), mix64(self.pair_key[codes // n] * U64(0xC2B2AE3D27D4EB4F) + self.short[codes % n])


def _by_fold(which: np.ndarray, fold: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.bincount(which[fold == f], minlength=n) for f in (TRAIN, DEVELOPMENT)]


def _channel(x: blocks.Exchange, keys: np.ndarray, counts: list[np.ndarray], bits: int = KEY_BITS):
    """A channel of counted keys in the order of their hashes, cut to ``bits`` beside those that name the slice."""
    order = np.argsort(keys)
    return _slices(keys[order], x.parts), [keys[order] >> U64(max(0, 64 - bits - (x.parts - 1).bit_length())), *(c[order].astype(U64) for c in counts)]


def _answers(x: blocks.Exchange, keys: list[np.ndarray], replies: dict[int, bytes]) -> list[tuple[np.ndarray, ...]]:
    """By channel, the counts of keys in all training documents and in those without the development fold, and what else was told."""
    orders = [np.argsort(k) for k in keys]
    out = []
    for order, columns in zip(orders, blocks.answered(x, [_slices(k[o], x.parts) for k, o in zip(keys, orders)], replies)):
        both, dev, more = (np.zeros(len(order), np.int64) for _ in range(3))
        for c, column in zip((both, dev, more), columns or ()):
            c[order] = column.astype(np.int64)
        out.append((both, both - dev, more))
    return out


def _count(ids, texts, x: blocks.Exchange, fold):
    numbers, seqs = _sequences(texts)
    short = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), U64, len(numbers))
    lens = np.array([len(s) for s in seqs], np.int64)
    b = Block(ids, np.array([fold(i) for i in ids], np.int8), lens, np.concatenate(seqs), short)
    yield None, blocks.PAYLOAD, b.payload()
    words = _channel(x, b.short, _by_fold(b.flat, b.fold, len(b.short)), 64)
    yield from blocks.asked(x, [words, _channel(x, b.pair_key, _by_fold(b.pair, b.fold[b.at], len(b.pair_key)))])


def _total(keys: np.ndarray, train: np.ndarray, dev: np.ndarray):
    """The distinct keys, the place of each key among them, and their counts in training and in development."""
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, which, *(np.bincount(which, c, len(distinct)).astype(U64) for c in (train, dev))


def _merge(channels):
    """The owner adds up the counts of its words and bigrams."""
    words, pairs = channels
    distinct, which, train, dev = _total(*words)
    both, token = train + dev, distinct != U64(xxhash.xxh3_64_intdigest(START))
    stats = (both[token].sum(), (both[token] > 0).sum(), train[token].sum(), (train[token] > 0).sum())
    return [[both[which], dev[which]], _merge_pairs(*pairs)], [stats]


def _merge_pairs(keys: np.ndarray, train: np.ndarray, dev: np.ndarray) -> list[np.ndarray]:
    """Counts of pairs, and for one that occurs once whether another block asks for it that has it in no training document."""
    _, which, all_train, all_dev = _total(keys, train, dev)
    every, asks = all_train + all_dev, (train + dev) == 0
    wanted = np.bincount(which[asks], minlength=len(every)) > 0
    return [every[which], all_dev[which], ((every == 1) & wanted)[which].astype(U64)]


def _merge_keys(channels):
    _, which, train, dev = _total(*channels[0])
    return [[(train + dev)[which], dev[which]]], []


class Counts:
    """What a block knows of its tokens: numbers of contexts, and estimates, by all training or without development."""

    def __init__(self, x: blocks.Exchange, payload: bytes, replies: dict[int, bytes], more: dict[int, bytes], least: int):
        self.least = least
        self.block = b = Block.read(payload)
        self.words, self.pairs = _answers(x, [b.short, b.pair_key], replies)
        self.some, self.which, keys = b.trigrams(self.pairs[0], self.pairs[2], least)
        self.triples = _answers(x, [keys], more)[0] if len(keys) else (np.zeros(0, np.int64),) * 2
        places = np.flatnonzero(b.flat[b.at] != 0)
        #: Places in training documents whose pair occurs there alone: what follows it is certain.
        self.sure = places[(self.pairs[0][b.pair[places - 1]] == 1) & (b.fold[b.at[places]] != TEST)] if least < 2 else places[:0]

    def estimates(self, version: int, n_tokens: int):
        """bucket, trigram, bigram and unigram estimate of each token; version 0: of all training documents, 1: without development."""
        b, words, pairs = self.block, self.words[version], self.pairs[version]
        context, word = words[b.flat[b.at]], words[b.word]
        two = pairs[b.pair] / np.maximum(context, 1)
        three, bucket = np.zeros(len(b.at)), _bucket(context)
        pair = pairs[b.pair[self.some - 1]]
        used = pair >= self.least
        some = self.some[used]
        three[some] = self.triples[version][self.which][used] / pair[used]
        bucket[some] = PAIRS + _bucket(pair[used])
        # without its development document such a pair is unknown
        some = self.sure[self.pairs[version][b.pair[self.sure - 1]] == 1]
        three[some], bucket[some] = 1.0, PAIRS + _bucket(np.ones(1))[0]
        return bucket, three, two, word / max(n_tokens, 1)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def _step(x: np.ndarray, base: float) -> np.ndarray:
    """Estimates in steps of their logarithm against the uniform share."""
    return np.where(x > 0, np.round(STEPS * np.log2(np.maximum(x, 1e-300) / base)), NO_ESTIMATE).astype(np.int64)


CELL = ["bucket", "tri", "bi", "uni"]


def _held_out(counts: Counts, n_tokens: int, n_words: int) -> pd.DataFrame:
    """How often the development fold's tokens have each (bucket, trigram, bigram and unigram estimate)."""
    b = counts.block
    dev = b.fold[b.at] == DEVELOPMENT
    bucket, *found = (v[dev] for v in counts.estimates(1, n_tokens))
    cells, n = np.unique(np.stack([bucket, *(_step(v, 1 / (n_words + 1)) for v in found)]), axis=1, return_counts=True)
    return pd.DataFrame(dict(zip(CELL, cells))).assign(n=n)


def learn_weights(cells: pd.DataFrame, rounds: int = 60, least: int = 100) -> dict[int, tuple[float, ...]]:
    """(trigram, bigram, unigram, uniform) weights by expectation-maximisation for each bucket; -1 and -2 are for
    buckets of pairs and of words with fewer than ``least`` held-out tokens, whose weights come from all of their kind."""
    out, pairs = {}, cells["bucket"] >= PAIRS
    groups = {-1: cells[pairs], -2: cells[~pairs]} | {int(k): g for k, g in cells.groupby("bucket") if k > 0 and g["n"].sum() >= least}
    for k, g in groups.items():
        n = g["n"].to_numpy(float)
        odds = np.stack([np.where(g[c] > NO_ESTIMATE, 2.0 ** (np.maximum(g[c], -4000) / STEPS), 0.0) for c in CELL[1:]] + [np.ones(len(g))])
        w = np.full(4, 1 / 4)
        for _ in range(rounds if len(g) else 0):
            share = w[:, None] * odds
            # one token more for each estimate: no weight, and so no probability, ever falls to 0
            w = (share / share.sum(0) * n).sum(1) + 1
            w /= w.sum()
        out[k] = tuple(map(float, w))
    return out


def _weight_table(weights: dict[int, tuple[float, ...]], most: int) -> np.ndarray:
    """The weights of all buckets; an estimate that a kind of bucket does not have gives its weight to the others."""
    table = np.array([weights.get(k, weights[-1 if k >= PAIRS else -2]) for k in range(max(most, PAIRS) + 1)])
    table[:PAIRS, 0] = 0.0
    table[0, 1] = 0.0
    return table / np.maximum(table.sum(1, keepdims=True), 1e-300)


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, development: int = 6, least_context: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Documents teach the model unless crc32 of their doc_id's decimal digits is ``held_out`` modulo ``folds``;
    those at ``development`` are held out of the counts behind the mixture weights. A pair of words that occurs
    ``least_context`` times or more in them is a trigram's context. base_score is the add-one
    unigram log10 probability of all tokens, score that of the interpolated model.
    """
    docs = documents(docs)
    x = blocks.exchange(text_bytes(docs), block_chars=BLOCK_CHARS)

    def make(ids, texts):
        return _count(ids, texts, x, lambda i: fold_of(i, folds, held_out, development))

    rows = materialise(blocks.own(x, blocks.build(x, docs, make, block_chars=BLOCK_CHARS), _merge), "lm")
    total = rows.where(F.col("kind") == blocks.STATS).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2", "n3", "n4"))).first()
    n_all, v_all, n_kept, v_kept = map(int, total)
    rows = rows.where(F.col("kind") != blocks.STATS)

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        own, replies = blocks.gathered(pdf)
        b = Block.read(own[blocks.PAYLOAD])
        count, _, wanted = _answers(x, [b.short, b.pair_key], replies)[1]
        some, which, keys = b.trigrams(count, wanted, least_context)
        asked = blocks.asked(x, [_channel(x, keys, _by_fold(which, b.fold[b.at[some]], len(keys)))])
        return pd.DataFrame(list(blocks.sent(x, int(pdf["dest"].iloc[0]), asked)), columns=blocks.FIELDS)

    more = materialise(blocks.own(x, rows.groupBy("dest").applyInPandas(ask, blocks.ROW), _merge_keys).withColumn("kind", F.lit(TRIGRAMS)), "trigrams")

    def finish(done, schema: str) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            third = pdf["kind"] == TRIGRAMS
            own, replies = blocks.gathered(pdf[~third])
            return done(Counts(x, own[blocks.PAYLOAD], replies, {int(g): d for g, d in zip(pdf["n1"][third], pdf["data"][third])}, least_context))

        return rows.unionByName(more).groupBy("dest").applyInPandas(run, schema)

    cells = finish(lambda counts: _held_out(counts, n_kept, v_kept), "bucket long, tri long, bi long, uni long, n long").groupBy(*CELL).agg(F.sum("n").alias("n"))
    cells = materialise(cells, "cells")
    weights = learn_weights(cells.toPandas())
    discard(cells)

    def done(counts: Counts) -> pd.DataFrame:
        b, (bucket, three, two, one) = counts.block, counts.estimates(0, n_all)
        table = _weight_table(weights, int(bucket.max(initial=0)))
        p = table[:, 3][bucket] / (v_all + 1)
        for k, found in enumerate((three, two, one)):
            p += table[:, k][bucket] * found
        word, n = counts.words[0][b.word], b.lens - 1
        first = np.cumsum(n) - n
        base = np.log10((word + 1) / (n_all + v_all + 1))
        return pd.DataFrame({
            "doc_id": pd.array(b.ids, "Int64"), "held_out": b.folds == TEST, "n_tokens": n, "n_known": np.add.reduceat((word > 0).astype(np.int64), first),
            "train_tokens": n_all, "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(p), first),
        })

    return finish(done, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
