"""Suffix-array dedup: removal of byte strings that an earlier document has, by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.
Strings never cross documents and are judged on the input.

Every string of that length is named by its minimiser, the least hash of the ``GRAM``-byte pieces inside it,
so that equal strings have equal names wherever they stand; neighbouring strings mostly share a name, and a
run of them is one snippet of text. Blocks of documents tell the owners of the names which they hold; names
that only one document holds need nothing more. Of the others each block sends every distinct snippet once,
with the smallest doc_id that has it. The owner sorts the suffixes of its snippets (to the length that
counts), finds in suffix order the nearest neighbours from smaller documents before and behind, and with them
the longest previous factor of each suffix. What it answers says which strings an earlier document has; the
block marks what they cover in all its documents. A passage that very many documents share costs one snippet a
block. A phrase with ever new text around it would bring one owner as many snippets: the owners of the names see
how many different snippets a name has (by the highest rank of their hashes, which blocks need only send once a
name), and strings under a name with hundreds of them go one by one to owners by a hash of the whole string.

A null text counts as empty. A null doc_id counts as smaller than any. Rows with the same doc_id are one
document's, so they never remove each other's bytes. Texts may have any length; an empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselab import blocks
from proselab.llm.common import U64, discard, documents, materialise, mix64, pack, planes, spread, text_bytes, unpack, unplanes

LENGTH, GRAM = 50, 28
WINDOW = LENGTH - GRAM + 1
#: Strings whose hashes are computed at a time.
CHUNK = 1 << 19
NO_ID = -(2**63)
#: A name is common from this rank of its snippets' hashes on, which means some 2^9 different snippets.
COMMON = 9
#: Beside the kinds of rows that all exchanges have: a block's runs whose names others share.
RUNS = 4


def _words(buf: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on as a number; no copy."""
    return np.ndarray((max(len(buf) - np.dtype(order).itemsize + 1, 0),), order, buf, strides=(1,))


def _hash(words: np.ndarray, at) -> np.ndarray:
    """Hashes of the GRAM bytes at ``at``: a slice, or positions."""
    shift = (lambda k: slice(at.start + k, at.stop + k)) if isinstance(at, slice) else (lambda k: at + k)
    h = words[shift(0)] * U64(0x9E3779B97F4A7C15)
    for k, m in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (GRAM - 8, 0xD6E8FEB86659FD93)):
        h ^= h >> U64(32)
        h += words[shift(k)]
        h *= U64(m)
    h ^= h >> U64(29)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values."""
    n, done = len(h) - width + 1, 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[:n], h[width - done : width - done + n]) if done < width else h[:n]


def _inside(lens: np.ndarray) -> np.ndarray:
    """Which places of the joined texts start a string that ends in the same text."""
    ok = np.ones(int(lens.sum()), bool)
    end = 0
    for n in lens.tolist():
        end += n
        ok[end - min(n, LENGTH - 1) : end] = False
    return ok


def _runs(buf: np.ndarray, ok: np.ndarray):
    """First places, numbers of strings and places of the minimiser of the runs of strings with one name."""
    firsts, counts, anchors = [], [], []
    words = _words(buf)
    for a in range(0, len(buf) - LENGTH + 1, CHUNK):
        b = min(a + CHUNK, len(buf) - LENGTH + 1)
        h = _hash(words, slice(a, b + WINDOW - 1))
        least, own = _least(h, WINDOW), ok[a:b]
        edge = np.empty(b - a + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(edge)
        n, at = np.diff(at), at[:-1]
        n, at = n[own[at]], at[own[at]]
        off = np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        for k in range(WINDOW):
            hit = h[at[todo] + k] == least[at[todo]]
            off[todo[hit]] = k
            todo = todo[~hit]
        firsts.append(at + a)
        counts.append(n)
        anchors.append(at + a + off)
    none = [np.zeros(0, np.int64)]
    return [np.concatenate(x or none) for x in (firsts, counts, anchors)]


def _names(buf: np.ndarray, anchors: np.ndarray, parts: int):
    h = _hash(_words(buf), anchors)
    part = (mix64(h ^ U64(0x2545F4914F6CDD1D)) % U64(parts)).astype(np.uint64)
    return np.unique(part << U64(32) | h >> U64(32), return_inverse=True)


def _ranks(buf: np.ndarray, firsts: np.ndarray, counts: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """For each name the most trailing zeros of its runs' hashes, by their first and last GRAM bytes."""
    words, out = _words(buf), np.zeros(n, np.uint8)
    h = mix64(_hash(words, firsts) * U64(0x9E3779B97F4A7C15) + _hash(words, firsts + counts + WINDOW - 2))
    np.maximum.at(out, which, np.bitwise_count((h & (~h + U64(1))) - U64(1)).astype(np.uint8))
    return out


def _apart(buf: np.ndarray, firsts: np.ndarray, counts: np.ndarray, part: np.ndarray, common: np.ndarray, parts: int):
    """The runs with each common one cut into its strings, whose parts come from all their bytes."""
    each = np.where(common, counts, 1)
    firsts = spread(firsts, each)
    common = np.repeat(common, each)
    words, at = _words(buf), firsts[common]
    part = np.repeat(part, each)
    part[common] = mix64(_hash(words, at) * U64(0x9E3779B97F4A7C15) + _hash(words, at + LENGTH - GRAM)) % U64(parts)
    return firsts, np.where(common, 1, np.repeat(counts, each)), part


def _held(ids: list, texts: list[str]):
    """A block's documents in the order of their ids."""
    order = sorted(range(len(ids)), key=lambda i: NO_ID if ids[i] is None else ids[i])
    ids, datas = [ids[i] for i in order], [texts[i].encode() for i in order]
    yield None, blocks.PAYLOAD, pack((ids, np.array([len(d) for d in datas], np.int64), b"".join(datas)))


def _keys(ids: list) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in ids], np.int64)


def _named(payload: bytes, x: blocks.Exchange):
    """A block's names for their owners, marked where two of its documents hold them."""
    ids, lens, joined = unpack(payload)
    buf = np.frombuffer(joined, np.uint8)
    firsts, counts, anchors = _runs(buf, _inside(lens))
    names, which = _names(buf, anchors, x.parts)
    key = _keys(ids)[np.searchsorted(np.cumsum(lens), firsts, side="right")] if len(firsts) else np.zeros(0, np.int64)
    low, high = np.full(len(names), 2**63 - 1), np.full(len(names), NO_ID)
    np.minimum.at(low, which, key)
    np.maximum.at(high, which, key)
    ranks = _ranks(buf, firsts, counts, which, len(names))
    yield from blocks.asked(x, [((names >> U64(32)).astype(np.int64), [(names & U64(0xFFFFFFFF)).astype(np.uint32), low < high, ranks])])


def _declare(ids: list, texts: list[str], x: blocks.Exchange):
    """A block's documents, and its names for their owners."""
    for held in _held(ids, texts):
        yield held
        yield from _named(held[-1], x)


def _shared(keys: np.ndarray, several: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For each name 1 if another document holds it, and 2 more if it is common."""
    names, which, uses = np.unique(keys, return_inverse=True, return_counts=True)
    shared = (uses > 1) | (np.bincount(which, several, len(names)) > 0)
    rank = np.zeros(len(names), np.uint8)
    np.maximum.at(rank, which, ranks)
    return (shared + 2 * (shared & (rank >= COMMON))).astype(np.uint8)[which]


def _send(payload: bytes, replies: dict[int, bytes], x: blocks.Exchange):
    """The block's runs whose names others share, and each distinct snippet for its owner."""
    ids, lens, joined = unpack(payload)
    buf = np.frombuffer(joined, np.uint8)
    # found again, as they take more room than they take time
    firsts, counts, anchors = _runs(buf, _inside(lens))
    names, which = _names(buf, anchors, x.parts)
    state = blocks.answered(x, [(names >> U64(32)).astype(np.int64)], replies)[0][0] if len(names) else np.zeros(0, np.uint8)
    shared, common = state > 0, state > 1
    own = np.flatnonzero(shared[which])
    which = which[own]
    firsts, counts, part = _apart(buf, firsts[own], counts[own], (names[which] >> U64(32)).astype(np.uint32), common[which], x.parts)
    doc = _keys(ids)[np.searchsorted(np.cumsum(lens), firsts, side="right")] if len(firsts) else np.zeros(0, np.int64)
    number: dict[bytes, int] = {}
    snippet = np.empty(len(firsts), np.uint32)
    for i, (a, n) in enumerate(zip(firsts.tolist(), (counts + LENGTH - 1).tolist())):
        snippet[i] = number.setdefault(joined[a : a + n], len(number))
    # documents stand in the order of their ids, so a snippet's first run has the smallest
    _, first = np.unique(snippet, return_index=True)
    low, part = doc[first], part[first].astype(np.uint32)
    yield None, RUNS, pack((planes(np.diff(firsts, prepend=0).astype(np.uint32)), planes(counts.astype(np.uint32)), planes(snippet), low, planes(part)))
    yield from blocks.asked(x, [(part.astype(np.int64), [low, list(number)])])


def suffix_order(buf: np.ndarray, starts: np.ndarray, length: int = LENGTH):
    """The starts in the order of the ``length`` bytes from them on, and which of them equal the one before.

    Equal ones keep their order. buf must reach ``length`` bytes behind each start.
    """
    keys, at = [], 0
    for width, order in ((8, ">u8"), (4, ">u4"), (2, ">u2"), (1, ">u1")):
        while at + width <= length:
            keys.append(_words(buf, order)[starts + at].astype(order[1:]))
            at += width
    sa = np.lexsort(keys[::-1])
    same = np.zeros(len(sa), bool)
    if len(sa):
        same[1:] = np.logical_and.reduce([k[sa[1:]] == k[sa[:-1]] for k in keys])
    return sa, same


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1; places skip along earlier answers."""
    out = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(out >= 0)
    while len(todo):
        todo = todo[(out[todo] >= 0) & (values[out[todo]] >= values[todo])]
        out[todo] = out[out[todo]]
    return out


def previous_factors(buf: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether the longest factor that a start shares with a smaller document has LENGTH bytes or more."""
    sa, same = suffix_order(buf, starts)
    run, by = np.cumsum(~same), docs[sa]
    back = nearest_smaller(by)
    ahead = len(by) - 1 - nearest_smaller(by[::-1])[::-1]
    found = (back >= 0) & (run[back] == run)
    found |= (ahead < len(by)) & (run[np.minimum(ahead, max(len(by) - 1, 0))] == run)
    out = np.zeros(len(starts), bool)
    out[sa] = found
    return out


def _judge(low: np.ndarray, snippets: blocks.Ragged) -> blocks.Ragged:
    """For each string of each snippet whether an earlier document has it."""
    windows = snippets.lens - LENGTH + 1
    starts = spread(snippets.starts, windows)
    return blocks.Ragged.of(windows, previous_factors(snippets.data, starts, np.repeat(low, windows)).astype(np.uint8))


def _marked(payload: bytes, shared: bytes, replies: dict[int, bytes], x: blocks.Exchange):
    """doc_id, bytes, and mask of the removed ones, of each document."""
    ids, lens, joined = unpack(payload)
    *runs, low, part = unpack(shared)
    firsts, counts, snippet = (unplanes(r).astype(np.int64) for r in runs)
    firsts = np.cumsum(firsts)
    none = np.zeros(0, np.int64)
    _, bits, begins = blocks.answered(x, [unplanes(part).astype(np.int64)], replies)[0][0] if len(low) else (none, none, none)
    bits = bits.astype(bool)
    ends = np.cumsum(lens)
    doc = _keys(ids)[np.searchsorted(ends, firsts, side="right")] if len(firsts) else np.zeros(0, np.int64)
    hit = bits[spread(begins[snippet], counts)] | np.repeat(doc > low[snippet], counts)
    starts = spread(firsts, counts)[hit]
    step = np.zeros(len(joined) + LENGTH + 1, np.int32)
    step[starts] += 1
    step[starts + LENGTH] -= 1
    gone = np.cumsum(step, dtype=np.int32)[: len(joined)] > 0
    buf = np.frombuffer(joined, np.uint8)
    for doc_id, a, b in zip(ids, (ends - lens).tolist(), ends.tolist()):
        yield doc_id, buf[a:b], gone[a:b]


def remove(docs: DataFrame, digest: bool = False) -> DataFrame:
    """What is left of each document: doc_id, kept binary and spans array of removed (start, end) bytes.

    With ``digest``, doc_id, n_bytes, n_removed, n_spans and kept_sha256 instead, so that texts do not move again.
    """
    docs = documents(docs)
    x = blocks.exchange(text_bytes(docs))

    def shared(channels):
        return [[_shared(*channels[0])]], []

    def judge(channels):
        return [[_judge(*channels[0])]], []

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        (one, replies), block = blocks.gathered(pdf), int(pdf["dest"].iloc[0])
        return pd.DataFrame(list(blocks.sent(x, block, _send(one[blocks.PAYLOAD], replies, x))), columns=blocks.FIELDS)

    def done(one: dict[int, bytes], replies: dict[int, bytes]) -> pd.DataFrame:
        out = []
        for doc_id, data, gone in _marked(one[blocks.PAYLOAD], one[RUNS], replies, x):
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            kept = data[~gone].tobytes()
            if digest:
                out.append((doc_id, len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
            else:
                out.append((doc_id, kept, [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["doc_id", "kept", "spans"]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "doc_id long, kept binary, spans array<struct<start:long,end:long>>"
    # texts stand in a table of their own and move only to meet answers, not with the names and snippets
    held = materialise(blocks.build(x, docs, _held), "blocks")
    names = materialise(blocks.own(x, blocks.ask(x, held, lambda payload: _named(payload, x)), shared), "names")
    judged = materialise(blocks.own(x, held.unionByName(names).groupBy("dest").applyInPandas(send, blocks.ROW), judge), "factors")
    discard(names)
    return blocks.finish(held.unionByName(judged), done, schema)
