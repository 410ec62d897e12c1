"""MinHash near-dedup by BagMinHash signatures of weighted word shingles.

A document is the bag of its five-word shingles (lower-cased words between white space; one shingle of all
words where there are fewer). Each shingle runs Poisson processes of points over its weight: one over the
first unit and one over each further doubling of the weight, [1, 2), [2, 4), [4, 8) and so on, a hierarchy in
which a whole interval is one process of its length's rate and an interval that the weight covers in part keeps
the points that fall below the weight. A point has a time and a component; a component's signature is its
first point. Two bags agree in a component with the probability of their weighted Jaccard similarity, without
bias, as weights are whole numbers, and the work follows the number of distinct shingles and components, not
the weights.

Bands of the signature propose pairs; pairs are verified on the shingles themselves, so no false pair stays.
Documents with equal bags are one node. A band is ``ROWS`` components that a fixed rule draws; each component
serves several bands. All nodes of a bucket meet its smallest node (a star). A bucket whose nodes are not all
linked to that one is compared whole: its nodes come together in cells of bounded size, a cell finds the multiset
overlap of all its nodes at once as a product of matrices over the shingles that two or more of them have, and
gives a spanning forest of its links. So no proposed pair goes uncompared, and what leaves a bucket is at most one
link a node, whatever the number of its pairs. A bucket that a cell cannot hold is dealt to blocks by a hash, and
each two blocks meet in a cell.

A pair at similarity 0.8 is proposed with probability 0.9997, at 0.85 with 1 - 1e-6, at 0.5 with 0.3. Nodes whose
weights differ by more than the wanted similarity allows are not compared with a star's centre, as they cannot
reach it. Shingles are told apart by 48-bit hashes when two bags are compared, by 64 bits within a bag.

A null text counts as empty; all documents without a word are one class. Null and repeated doc_ids and repeated
rows each get a row; of a class the row with the smallest doc_id stays (a null one is the smallest), one row
where that is repeated. Texts may have any length; an empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselab.llm.common import U64, dealt, discard, documents, materialise, mix64, runs, spread
from proselab.llm.graphs import components

WORDS = 5
#: Components of a signature; bands, and components of a band.
SIZE, BANDS, ROWS = 128, 48, 7
#: A star or a cell has about so many nodes and so many shingles at most.
CELL_NODES, CELL_SHINGLES = 512, 1 << 19
#: Documents are taken in groups of about so many characters.
GROUP_CHARS = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x27D4EB2F165667C5], U64)


def bags(texts: list[str], width: int = WORDS):
    """(document, shingle, weight) of the distinct shingles, in the order of documents and shingles."""

    class Hashes(dict):
        def __missing__(self, word):
            self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
            return h

    hashes, shingles, counts = Hashes(), [], []
    for text in texts:
        found = text.lower().split()
        h = np.fromiter(map(hashes.__getitem__, found), U64, len(found))
        k = min(width, len(h))
        n = len(h) - k + 1 if k else 0
        s = np.zeros(n, U64)
        for i in range(k):
            s = mix64(s + h[i : i + n] * _MULTIPLIERS[i % len(_MULTIPLIERS)])
        shingles.append(s)
        counts.append(n)
    doc, flat = np.repeat(np.arange(len(texts)), counts), np.concatenate(shingles) if shingles else np.zeros(0, U64)
    order = np.lexsort((flat, doc))
    doc, flat = doc[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (flat[1:] != flat[:-1])
    at = np.flatnonzero(new)
    return doc[at], flat[at], np.diff(at, append=len(flat))


def _uniform(seed: np.ndarray, k: int) -> np.ndarray:
    """Uniform numbers in (0, 1)."""
    return ((mix64(seed + U64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U64(11)).astype(float) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """First times of the components, one row a document; infinite for documents without a shingle."""
    best = np.full((n, size), np.inf)
    total = np.bincount(doc, weight, n)
    # the time by which all components have a point but for one document in fifty, which runs again to twice that
    limit = np.where(total > 0, size / np.maximum(total, 1) * (np.log(size) + 4), 0.0)
    # the processes: rate, lowest weight and seed of each interval that a weight reaches into
    owner, low, seed = [np.arange(len(doc))], [np.zeros(len(doc), np.int64)], [mix64(shingle ^ U64(0xA0761D6478BD642F))]
    level = 1
    while len(doc) and int(weight.max()) > 1 << (level - 1):
        own = np.flatnonzero(weight > 1 << (level - 1))
        owner.append(own)
        low.append(np.full(len(own), 1 << (level - 1)))
        seed.append(mix64(shingle[own] + U64(level * 0xE7037ED1A0B428DB & (2**64 - 1))))
        level += 1
    owner, low, seed = map(np.concatenate, (owner, low, seed))
    rate = np.maximum(low, 1)
    todo_docs = np.flatnonzero(total > 0)
    active = np.arange(len(owner))
    while len(todo_docs):
        now, time, turn = active, np.zeros(len(active)), 0
        while len(now):
            s = seed[now]
            time = time - np.log(_uniform(s, 3 * turn + 1)) / rate[now]
            early = time < limit[doc[owner[now]]]
            now, time, s = now[early], time[early], s[early]
            o = owner[now]
            component = (mix64(s + U64((3 * turn + 2) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % U64(size)).astype(np.int64)
            inside = low[now] + _uniform(s, 3 * turn + 3) * rate[now] < weight[o]
            np.minimum.at(best, (doc[o[inside]], component[inside]), time[inside])
            turn += 1
        todo_docs = todo_docs[np.isinf(best[todo_docs]).any(1)]
        limit[todo_docs] *= 2
        again = np.zeros(n, bool)
        again[todo_docs] = True
        active = np.flatnonzero(again[doc[owner]]) if len(todo_docs) else active[:0]
    return best


def band_rows(size: int = SIZE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The components of each band: as many permutations as needed, each cut into bands without a common component."""
    each = size // rows
    found = []
    for k in range(-(-bands // each)):
        order = np.argsort(mix64(np.arange(1, size + 1, dtype=U64) + U64((k + 1) << 32)), kind="stable")
        found.append(order[: each * rows].reshape(each, rows))
    return np.concatenate(found)[:bands]


def band_keys(best: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    bits = best.view(U64)
    key = np.broadcast_to(np.arange(1, len(chosen) + 1, dtype=U64), (len(best), len(chosen))) * U64(0x9E3779B97F4A7C15)
    for r in range(chosen.shape[1]):
        key = mix64(key + bits[:, chosen[:, r]])
    return key.view(np.int64)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        size = b["text"].str.len().cumsum() // GROUP_CHARS
        for _, part in b.groupby(size):
            yield part


def signed(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """row, doc_id, print (of the text), bag (a hash of it), total (weight), n (distinct shingles), keys: the band keys."""
    chosen = band_rows()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 33
        for b in _groups(batches):
            doc, shingle, weight = bags(b["text"].tolist(), width)
            best = signatures(doc, shingle, weight, len(b))
            cuts = np.searchsorted(doc, np.arange(len(b) + 1))
            names = [xxhash.xxh3_128_digest(shingle[i:j].tobytes() + weight[i:j].astype("<i8").tobytes()) for i, j in zip(cuts, cuts[1:])]
            keys = [k if i < j else [] for k, i, j in zip(band_keys(best, chosen), cuts, cuts[1:])]
            total = np.bincount(doc, weight, len(b)).astype(np.int64)
            yield pd.DataFrame({"row": row + np.arange(len(b)), "doc_id": b["doc_id"].astype("Int64"), "print": b["print"], "bag": names, "total": total, "n": np.diff(cuts), "keys": keys})
            row += len(b)

    return docs.withColumn("print", F.xxhash64("text")).mapInPandas(run, "row long, doc_id long, print long, bag binary, total long, n long, keys array<long>")


def packed(shingle: np.ndarray, weight: np.ndarray) -> tuple[bytes, bytes]:
    """A bag as the first 48 bits of its shingles, and its weights, none where all are 1."""
    six = np.ascontiguousarray((shingle >> U64(16)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
    return six.tobytes(), b"" if (weight == 1).all() else weight.astype("<u4").tobytes()


def unpacked(shingles: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    six = np.frombuffer(shingles, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, :6] = six
    return wide.view("<u8").reshape(-1), np.frombuffer(weights, "<u4").astype(np.int64) if weights else np.ones(len(six), np.int64)


def _bag_table(texts: DataFrame, width: int) -> DataFrame:
    """node, its bag of each row (node, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _groups(batches):
            doc, shingle, weight = bags(b["text"].tolist(), width)
            cuts = np.searchsorted(doc, np.arange(len(b) + 1))
            both = [packed(shingle[i:j], weight[i:j]) for i, j in zip(cuts, cuts[1:])]
            yield pd.DataFrame({"node": b["node"], "shingles": [x for x, _ in both], "weights": [x for _, x in both]})

    return texts.mapInPandas(run, "node long, shingles binary, weights binary")


def star_overlaps(centre: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The multiset overlap of one bag with each of others, none of which is empty."""
    shingle, weight = (np.concatenate(x) for x in zip(*others))
    at = np.minimum(np.searchsorted(centre[0], shingle), len(centre[0]) - 1)
    common = np.where(centre[0][at] == shingle, np.minimum(centre[1][at], weight), 0)
    return np.add.reduceat(common, np.cumsum([0] + [len(s) for s, _ in others[:-1]]))


def cell_overlaps(found: list[tuple[np.ndarray, np.ndarray]], room: int = 1 << 22) -> np.ndarray:
    """The multiset overlaps of all bags with each other.

    A shingle of weight w is w elements, so that the overlap is the number of common elements: a product of
    the matrix of bags and elements with itself, over ``room`` of its places at a time.
    """
    k = len(found)
    shingle, weight = (np.concatenate(x) for x in zip(*found))
    bag = np.repeat(np.repeat(np.arange(k), [len(s) for s, _ in found]), weight)
    level = spread(np.zeros(len(weight), np.int64), weight).astype(U64)
    _, element, holders = np.unique(mix64(np.repeat(shingle, weight) + level * U64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    wanted = holders > 1
    place = np.cumsum(wanted) - 1
    keep = wanted[element]
    element, bag = place[element[keep]], bag[keep]
    order = np.argsort(element, kind="stable")
    element, bag = element[order], bag[order]
    out, width = np.zeros((k, k)), max(room // k, 1)
    for first in range(0, int(wanted.sum()), width):
        a, b = np.searchsorted(element, (first, first + width))
        m = np.zeros((k, min(width, int(wanted.sum()) - first)), np.float32)
        m[bag[a:b], element[a:b] - first] = 1
        out += m @ m.T
    np.fill_diagonal(out, [w.sum() for _, w in found])
    return out


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph that a symmetric matrix of links gives."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        todo = [root] if left[root] else []
        left[root] = False
        while todo:
            a = todo.pop()
            found = np.flatnonzero(linked[a] & left)
            left[found] = False
            out += [(a, b) for b in found.tolist()]
            todo += found.tolist()
    return out


_LINKS = "a long, b long"
_CELL = ["c1", "c2", "c3"]


def _gathered(cells: DataFrame, bag_table: DataFrame) -> DataFrame:
    """Rows (c1, c2, c3, side, node) with their bags, one cell after another."""
    return cells.join(bag_table, "node").repartition(*_CELL).sortWithinPartitions(*_CELL, "side", "node")


def _star_links(cells: DataFrame, bag_table: DataFrame, least: float) -> DataFrame:
    """Links of each cell's node on side 0 with those on side 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, c in runs(batches, _CELL):
            found = [unpacked(*x) for x in zip(c["shingles"], c["weights"])]
            total = np.array([int(w.sum()) for _, w in found])
            common = star_overlaps(found[0], found[1:])
            good = np.flatnonzero(common / (total[0] + total[1:] - common) >= least) + 1
            if len(good):
                yield pd.DataFrame({"a": c["node"][0], "b": np.array(c["node"])[good]})

    return _gathered(cells, bag_table).mapInPandas(run, _LINKS)


def _cell_links(cells: DataFrame, bag_table: DataFrame, least: float) -> DataFrame:
    """A spanning forest of the links of each cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, c in runs(batches, _CELL):
            found = [unpacked(*x) for x in zip(c["shingles"], c["weights"])]
            total = np.array([int(w.sum()) for _, w in found])
            common = cell_overlaps(found)
            linked = common / (total[:, None] + total - common) >= least
            np.fill_diagonal(linked, False)
            tree = spanning(linked)
            if tree:
                yield pd.DataFrame([(c["node"][a], c["node"][b]) for a, b in tree], columns=["a", "b"])

    return _gathered(cells, bag_table).mapInPandas(run, _LINKS)


def _pieces(count: Column, volume: Column) -> Column:
    return F.greatest(F.ceil(count / CELL_NODES), F.ceil(volume / CELL_SHINGLES)).cast("long")


def classes(df: DataFrame, least: float = 0.8, width: int = WORDS) -> DataFrame:
    """doc_id, print (xxhash64 of the text), class_id (the smallest doc_id of the class), class_size, kept for every row."""
    docs = documents(df)
    rows = materialise(signed(dealt(docs), width), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("id_known"), "doc_id", "row"))
    nodes = materialise(rows.groupBy("bag").agg(F.min("row").alias("node"), first.alias("first"), F.count("*").alias("size")), "nodes")
    own = materialise(rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "total", "n", "keys"), "own")
    banded = own.select("node", "total", "n", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min(F.struct("node", "total")).alias("c"), F.count("*").alias("held")).where("held > 1")
    buckets = materialise(buckets.select("key", F.col("c.node").alias("centre"), F.col("c.total").alias("centre_total")), "buckets")
    shared = materialise(banded.join(buckets, "key").select("key", "centre", "centre_total", "node", "total", "n"), "shared")
    discard(own, buckets)
    wanted = rows.join(shared.select(F.col("node").alias("row")).distinct(), "row", "left_semi").select(F.col("row").alias("node"), F.col("doc_id").alias("_id"), F.col("print").alias("_print"))
    # rows that repeat an id and a text have one bag, and so one node
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_print"))).select("node", "text")
    bag_table = materialise(_bag_table(texts, width).dropDuplicates(["node"]), "bags")

    # every node of a bucket with its smallest one
    light, heavy = F.least("total", "centre_total"), F.greatest("total", "centre_total")
    spokes = materialise(shared.where((F.col("node") != F.col("centre")) & (light >= F.lit(least) * heavy)).select("centre", "node", "n").distinct(), "spokes")
    stars = spokes.groupBy("centre").agg(_pieces(F.count("*"), F.sum("n")).alias("pieces"))
    placed_spokes = spokes.join(stars, "centre").select(F.col("centre").alias("c1"), F.pmod(F.xxhash64("node"), F.col("pieces")).alias("c2"), F.lit(0).cast("long").alias("c3"), F.lit(1).alias("side"), "node")
    cells = materialise(placed_spokes.unionByName(placed_spokes.select("c1", "c2", "c3", F.lit(0).alias("side"), F.col("c1").alias("node")).distinct()), "stars")
    links = materialise(_star_links(cells, bag_table, least), "links")

    # the rest of each bucket whose nodes are not all linked to that one, whole
    joined = links.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.lit(1).alias("linked"))
    rest = materialise(shared.where("node != centre").join(joined, ["centre", "node"], "left").select("key", "node", "n", "linked"), "rest")
    opened = rest.groupBy("key").agg(F.count("*").alias("held"), F.count("linked").alias("linked"), _pieces(F.count("*"), F.sum("n")).alias("pieces")).where("linked < held and held > 1")
    placed = rest.select("key", "node").join(opened.select("key", "pieces"), "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("pieces")))
    # with two blocks or more each meets every other one, also those of its own, which are in all its cells
    other = F.when(F.col("pieces") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda x: x != F.col("block")))
    whole = placed.select("key", "node", "block", F.explode(other).alias("other"))
    cells2 = materialise(whole.select(F.col("key").alias("c1"), F.least("block", "other").alias("c2"), F.greatest("block", "other").alias("c3"), F.lit(0).alias("side"), "node"), "cells")
    more = materialise(_cell_links(cells2, bag_table, least), "links")
    discard(shared, spokes, cells, rest, cells2, bag_table)
    label = components(links.unionByName(more))

    classed = materialise(nodes.join(label, "node", "left").select("bag", "first", "size", F.coalesce("label", "node").alias("class")), "classed")
    heads = materialise(classed.groupBy("class").agg(F.min("first").alias("head"), F.sum("size").alias("class_size")), "heads")
    named = materialise(classed.select("bag", "class").join(heads, "class").select("bag", "head", "class_size"), "named")
    discard(links, more, nodes, classed, heads)
    return rows.select("row", "doc_id", "print", "bag").join(named, "bag").select("doc_id", "print", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("kept"))
