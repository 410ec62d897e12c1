"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

Documents are cut into pre-tokens with positions. Each block of documents sends each distinct pre-token once
to the owner of its hash; the owner encodes every distinct pre-token of the corpus once, and the ids join back
to the blocks, where the stored positions put the documents together again. Decoding joins the ids with the
token-byte table, which has one row for each of the vocabulary's entries, whatever the corpus.

A null text counts as empty and gives no ids; a row whose doc_id is null, repeated rows and texts of any
length are encoded like all others; an empty table gives an empty result. Columns other than the two named
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from proselab import blocks
from proselab.llm.common import documents, pack, planes, spread, text_bytes, unpack, unplanes

#: Larger blocks than elsewhere: a block holds little beside its positions, and fewer blocks repeat fewer words.
BLOCK_CHARS = 16 << 20
#: The pattern of byte-level vocabularies, and the same over texts whose characters all lie below U+0100, with its
#: classes written out for the standard library's matcher, which is several times as fast; other texts, and other
#: patterns, take the pattern given.
COMMON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN1 = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


@lru_cache(2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def pretokens(text: str, pattern: str) -> list[str]:
    if pattern == COMMON:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            return LATIN1.findall(text)
    return _splitter(pattern).findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes by id in a row, and each one's start and length."""
    ranks = read_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        by_id[k] = token
    lens = np.array([len(t) for t in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(lens) - lens, lens


def _positions(ids: list, texts: list[str], pattern: str, x: blocks.Exchange):
    """A block's positions (its own payload) and its distinct words for their owners."""

    class Numbers(dict):
        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    numbers = Numbers()
    docs = []
    for text in texts:
        found = pretokens(text, pattern)
        docs.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
    # numbers by falling frequency, whose high bytes compress away
    flat = np.concatenate(docs)
    by_use = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
    rank = np.empty(len(numbers), np.uint32)
    rank[by_use] = np.arange(len(numbers), dtype=np.uint32)
    found = list(numbers)
    words = [found[i].encode() for i in by_use.tolist()]
    part = np.fromiter((zlib.crc32(w) % x.parts for w in words), np.uint32, len(words))
    yield None, blocks.PAYLOAD, pack((ids, np.array([len(d) for d in docs], np.int64), planes(rank[flat]), planes(part)))
    yield from blocks.asked(x, [(part, [words])])


def _encode(words: blocks.Ragged, path: str, pattern: str) -> blocks.Ragged:
    """The owner of some words: encodes each distinct one once."""
    encode, known = _encoding(path, pattern).encode_ordinary, {}
    flat, found = words.data.tobytes(), []
    for a, n in zip(words.starts.tolist(), words.lens.tolist()):
        word = flat[a : a + n]
        ids = known.get(word)
        if ids is None:
            ids = known[word] = encode(word.decode())
        found.append(ids)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return blocks.Ragged.of(sizes, np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())))


def _block_ids(x: blocks.Exchange, payload: bytes, replies: dict[int, bytes]):
    """(doc_id, ids) of each document of a block, put together by position."""
    doc_ids, counts, positions, part = unpack(payload)
    positions, part = unplanes(positions), unplanes(part)
    none = np.zeros(0, np.uint32)
    sizes, flat, starts = blocks.answered(x, [part], replies)[0][0] if len(part) else (none, none, none)
    ends = np.cumsum(counts)
    for doc_id, a, b in zip(doc_ids, (ends - counts).tolist(), ends.tolist()):
        own = positions[a:b]
        yield doc_id, flat[spread(starts[own], sizes[own])]


def encode(docs: DataFrame, vocabulary: str, pattern: str, digest: bool = False) -> DataFrame:
    """Ids and decoded text of every document.

    ``vocabulary`` is the path of a rank file that all executors can read. Returns doc_id, ids array<int>,
    decoded binary; with ``digest``, doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 instead, so that long documents do not move again.
    """
    docs = documents(docs)
    x = blocks.exchange(text_bytes(docs), block_chars=BLOCK_CHARS)

    def make(ids, texts):
        return _positions(ids, texts, pattern, x)

    def answer(channels):
        return [[_encode(channels[0][0], vocabulary, pattern)]], []

    def done(kept, replies):
        table, starts, lens = token_bytes(vocabulary)
        out = []
        for doc_id, ids in _block_ids(x, kept[blocks.PAYLOAD], replies):
            decoded = table[spread(starts[ids], lens[ids])].tobytes()
            if digest:
                out.append((doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            else:
                out.append((doc_id, ids.astype(np.int32), decoded))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids", "decoded"]
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded binary"
    return blocks.finish(blocks.own(x, blocks.build(x, docs, make, block_chars=BLOCK_CHARS), answer), done, schema)
