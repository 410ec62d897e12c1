"""Exchange of the distinct keys of document blocks.

Documents are read in blocks of bounded size. A block asks about each of its distinct keys (words, n-grams,
anchors) once, by sending it to its owner, a slice of the key space; the owner answers what it knows of the key
over the whole corpus, and the block is put together again with the answers. A key costs one entry a block however
often it occurs, so that a word which a third of all tokens share moves once a block, and no group holds more
than a block or a slice.

Slices are gathered in at most ``GROUPS`` groups, and a block sends one message a group, its keys in the order of
their slices. Where groups have more than one slice, messages go by relays: a relay takes the messages of one
batch of about ``BATCH`` blocks for one group, hands each slice one message, and takes the answers apart again. So
the messages that a block sends or gets number at most ``GROUPS``, and a relay's at most the slices of a group, for
any size of input. Keys and answers travel as packed columns.

Blocks are numbered by task and order; a task that is run again makes the same blocks as long as its input
rows come in the same order, as they do from a file scan. Materialise other inputs first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselab.packing import U64, mix64, pack, planes, spread, unpack, unplanes

ROW = "dest long, block long, kind int, n1 long, n2 long, n3 long, n4 long, data binary"
FIELDS = ["dest", "block", "kind", "n1", "n2", "n3", "n4", "data"]
#: A block ends with the document that takes it to so many characters.
BLOCK_CHARS = 6 << 20
PAYLOAD, KEYS, REPLY, STATS = 0, 1, 2, 3
GROUPS, BATCH = 256, 256
#: Destinations: blocks from 0 up, owners from -1 down, relays from here down.
RELAY = -(1 << 50)


class Exchange(NamedTuple):
    groups: int
    slices: int
    batches: int

    @property
    def parts(self) -> int:
        return self.groups * self.slices


def exchange(n_bytes: int, each: int = 4 << 20, block_chars: int = BLOCK_CHARS) -> Exchange:
    """About one owner for every ``each`` bytes of text, so that an owner's keys fit a worker at any size."""
    return Exchange(GROUPS, max(1, -(-int(n_bytes) // (each * GROUPS))), max(1, -(-int(n_bytes) // (block_chars * BATCH))))


class Ragged(NamedTuple):
    """A column of runs: their lengths, all their items, and where each run starts."""

    lens: np.ndarray
    data: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, lens: np.ndarray, data: np.ndarray) -> Ragged:
        lens = lens.astype(np.int64)
        return cls(lens, data, np.cumsum(lens) - lens)

    @classmethod
    def from_bytes(cls, items: list[bytes]) -> Ragged:
        return cls.of(np.fromiter(map(len, items), np.int64, len(items)), np.frombuffer(b"".join(items), np.uint8))


def _packed(column):
    if isinstance(column, Ragged):
        return "r", planes(column.lens.astype(np.uint32)), column.data.tobytes() if column.data.itemsize == 1 else planes(column.data), column.data.dtype.str
    if column.dtype.kind == "S":
        return "s", column.dtype.str, column.tobytes()
    if len(column) and column.dtype.kind == "u" and (column[1:] >= column[:-1]).all():
        return "d", planes(np.diff(column, prepend=column.dtype.type(0)))
    return "p", planes(column)


def _unpacked(x):
    if x[0] == "r":
        return Ragged.of(unplanes(x[1]), np.frombuffer(x[2], x[3]) if isinstance(x[2], bytes) else unplanes(x[2]))
    if x[0] == "s":
        return np.frombuffer(x[2], x[1])
    values = unplanes(x[1])
    return np.cumsum(values, dtype=values.dtype) if x[0] == "d" else values


def _part(column, a: int, b: int):
    if isinstance(column, Ragged):
        first = int(column.starts[a]) if a < len(column.lens) else len(column.data)
        return Ragged.of(column.lens[a:b], column.data[first : first + int(column.lens[a:b].sum())])
    return column[a:b]


def _joined(columns: list):
    if isinstance(columns[0], Ragged):
        return Ragged.of(np.concatenate([c.lens for c in columns]), np.concatenate([c.data for c in columns]))
    return np.concatenate(columns)


def _ordered(column, order: np.ndarray):
    if isinstance(column, list):
        return Ragged.from_bytes([column[i] for i in order.tolist()])
    return column[order]


def _message(channels: list[tuple[np.ndarray, list]]) -> bytes:
    """A channel is the numbers of its keys by slice or sender, and its columns."""
    return pack([(counts.astype(np.uint32), [_packed(c) for c in columns]) for counts, columns in channels])


def _read(data: bytes) -> list[tuple[np.ndarray, list]]:
    return [(counts.astype(np.int64), [_unpacked(c) for c in columns]) for counts, columns in unpack(data)]


def _merged(messages: list[list[tuple[np.ndarray, list]]]) -> list[tuple[np.ndarray, list]]:
    """By channel, the matrix of counts of the messages and their columns joined."""
    return [(np.stack([c for c, _ in channel]), [_joined(list(x)) for x in zip(*(columns for _, columns in channel))]) for channel in zip(*messages)]


def asked(x: Exchange, channels: list[tuple[np.ndarray, list]]) -> Iterator[tuple[int, int, bytes]]:
    """(group, KEYS, message) of a block's channels, each the parts of its keys and their columns (arrays, or lists of bytes)."""
    ready = []
    for part, columns in channels:
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=x.parts).astype(np.int64).reshape(x.groups, x.slices)
        ready.append((sizes, np.concatenate([[0], np.cumsum(sizes.sum(1))]), [_ordered(c, order) for c in columns]))
    for g in range(x.groups):
        if any(sizes[g].any() for sizes, _, _ in ready):
            yield -1 - g, KEYS, _message([(sizes[g], [_part(c, int(cuts[g]), int(cuts[g + 1])) for c in columns]) for sizes, cuts, columns in ready])


def answered(x: Exchange, parts: list[np.ndarray], replies: dict[int, bytes]) -> list[list]:
    """By channel, the columns of answers in the order of the keys that were asked; a Ragged one's items stay in that of the parts."""
    got = [_read(replies[g]) for g in sorted(replies)]
    out = []
    for k, part in enumerate(parts):
        order, columns = np.argsort(part, kind="stable"), []
        for pieces in zip(*(m[k][1] for m in got)):
            joined = _joined(list(pieces))
            if isinstance(joined, Ragged):
                lens, starts = np.empty_like(joined.lens), np.empty_like(joined.starts)
                lens[order], starts[order] = joined.lens, joined.starts
                columns.append(Ragged(lens, joined.data, starts))
            else:
                column = np.empty_like(joined)
                column[order] = joined
                columns.append(column)
        out.append(columns)
    return out


def row(dest, block, kind, data, n=(0, 0, 0, 0)):
    return (dest, block, kind, *map(int, n), data)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=FIELDS)


def sent(x: Exchange, block: int, made: Iterable[tuple[int | None, int, bytes]]) -> Iterator[tuple]:
    """Rows of ROW of a block: what is for itself, and messages, straight to the owner of a group of one slice."""
    batch = int(mix64(np.array([block], U64))[0]) % x.batches
    for dest, kind, data in made:
        if dest is None:
            yield row(block, block, kind, data)
        else:
            yield row(dest if x.slices == 1 else RELAY - ((-1 - dest) * x.batches + batch), block, kind, data)


def build(x: Exchange, docs: DataFrame, make: Callable[[list, list], Iterable[tuple[int | None, int, bytes]]], columns=("doc_id", "text"), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ROW. ``make(ids, texts)`` gives what ``asked`` gives of a block, and (None, kind, data) for the block itself."""
    first, text = columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def flush():
            out, held = [], 0
            for r in sent(x, base + n, make(ids, texts)):
                out.append(r)
                held += len(r[-1])
                if held > 8 << 20:
                    yield _arrow(out)
                    out, held = [], 0
            if out:
                yield _arrow(out)

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                # numbers stay in their batch's memory
                t = t.values.to_numpy() if isinstance(t, pa.ListScalar) and t.is_valid and not t.values.null_count else t.as_py()
                ids.append(i.as_py())
                texts.append(t)
                size += len(t)
                if size >= block_chars:
                    yield from flush()
                    n += 1
                    ids, texts, size = [], [], 0
        if ids:
            yield from flush()

    return docs.select(first, text).mapInArrow(run, ROW)


def ask(x: Exchange, held: DataFrame, make: Callable[[bytes], Iterable[tuple[int | None, int, bytes]]]) -> DataFrame:
    """Rows of ROW that ``make(payload)`` gives of each block of a written table, which then stays where it is.

    So blocks' payloads take no part in the shuffles to owners and relays, which else carry them along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for made in make(data.as_py()):
                    yield _arrow(list(sent(x, block, [made])))

    return held.where(F.col("kind") == PAYLOAD).select("block", "data").mapInArrow(run, ROW)


def _each(rows: DataFrame, wanted: Callable[[int], bool], work: Callable[[int, pd.DataFrame], Iterable[tuple]]) -> DataFrame:
    """``work(dest, rows)`` for the destinations that are wanted; what is meant for others passes through."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(work(int(key[0]), pdf)), columns=FIELDS) if wanted(int(key[0])) else pdf

    return rows.groupBy("dest").applyInPandas(run, ROW)


def _is_relay(dest: int) -> bool:
    return dest <= RELAY


def _relayed(x: Exchange):
    """A relay's messages to the slices of its group, and a note to itself of what they are made of."""

    def work(dest: int, pdf: pd.DataFrame) -> Iterator[tuple]:
        group, messages = (RELAY - dest) // x.batches, [_read(d) for d in pdf["data"]]
        yield row(dest, dest, PAYLOAD, pack((pdf["block"].tolist(), [np.stack([m[k][0] for m in messages]) for k in range(len(messages[0]))])))
        ends = [[np.cumsum(counts) for counts, _ in m] for m in messages]
        for s in range(x.slices):
            cut = [[(c[s : s + 1], [_part(v, int(e[s] - c[s]), int(e[s])) for v in columns]) for (c, columns), e in zip(m, ends[i])] for i, m in enumerate(messages)]
            merged = _merged(cut)
            if any(c.any() for c, _ in merged):
                yield row(-1 - (group * x.slices + s), dest, KEYS, _message([(c.sum(0), columns) for c, columns in merged]))

    return work


def _returned(x: Exchange):
    """A relay's answers, taken apart for its blocks."""

    def work(dest: int, pdf: pd.DataFrame) -> Iterator[tuple]:
        kinds = pdf["kind"].tolist()
        senders, counts = unpack(pdf["data"].iloc[kinds.index(PAYLOAD)])
        replies = {int(p) % x.slices: _read(d) for k, p, d in zip(kinds, pdf["n1"], pdf["data"]) if k == REPLY}
        group = (RELAY - dest) // x.batches
        for i, block in enumerate(senders):
            channels = []
            for k, c in enumerate(counts):
                before = c[:i].sum(0)
                pieces = [[_part(v, int(before[s]), int(before[s] + c[i, s])) for v in replies[s][k][1]] for s in sorted(replies)]
                channels.append((c[i], [_joined(list(p)) for p in zip(*pieces)]))
            yield row(block, dest, REPLY, _message(channels), (group, 0, 0, 0))

    return work


def own(x: Exchange, rows: DataFrame, answer: Callable[[list[list]], tuple[list[list], list[tuple]]]) -> DataFrame:
    """The rows for blocks, with the owners' answers.

    ``answer(columns by channel)`` gives the columns of answers by channel, in the order of the keys, and the
    numbers of STATS rows. Every channel of every message has its columns, be they empty.
    """

    def work(dest: int, pdf: pd.DataFrame) -> Iterator[tuple]:
        part, merged = -1 - dest, _merged([_read(d) for d in pdf["data"]])
        answers, stats = answer([columns for _, columns in merged])
        for n in stats:
            yield row(-1, -1, STATS, b"", n)
        ends = [np.cumsum(counts.sum(1)) for counts, _ in merged]
        for i, sender in enumerate(pdf["block"].tolist()):
            channels = []
            for (counts, _), e, columns in zip(merged, ends, answers):
                n = int(counts[i].sum())
                channels.append((np.array([n]), [_part(c, int(e[i]) - n, int(e[i])) for c in columns]))
            yield row(sender, dest, REPLY, _message(channels), (part, 0, 0, 0))

    def is_owner(dest: int) -> bool:
        return RELAY < dest < 0

    if x.slices == 1:
        return _each(rows, is_owner, work)
    return _each(_each(_each(rows, _is_relay, _relayed(x)), is_owner, work), _is_relay, _returned(x))


def gathered(pdf: pd.DataFrame) -> tuple[dict[int, bytes], dict[int, bytes]]:
    """A block's own rows by kind, and its replies by group."""
    kinds = pdf["kind"].tolist()
    return {k: d for k, d in zip(kinds, pdf["data"]) if k != REPLY}, {int(p): d for k, p, d in zip(kinds, pdf["n1"], pdf["data"]) if k == REPLY}


def finish(rows: DataFrame, done: Callable[[dict[int, bytes], dict[int, bytes]], pd.DataFrame], schema: str) -> DataFrame:
    """``done(own rows by kind, replies by group)`` gives the result rows of each block."""
    return rows.where(F.col("kind") != STATS).groupBy("dest").applyInPandas(lambda pdf: done(*gathered(pdf)), schema)


__all__ = ["BLOCK_CHARS", "KEYS", "PAYLOAD", "REPLY", "ROW", "STATS", "Exchange", "Ragged", "answered", "ask", "asked", "build", "exchange", "finish", "gathered", "own", "sent", "spread"]
