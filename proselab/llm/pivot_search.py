"""Exact top-k inner-product search by a pivot-distance index.

Components become floor(scale * x) as whole numbers. The index keys each vector by its nearest pivot and its
distance to it, sorts by that key, and cuts the order into annuli of bounded size, some annuli to a slab. A query
first sees its own annulus, which gives it a k-th best score; it then goes only to slabs, and within
them, most promising annuli first, only to annuli whose bound reaches that score, which rises on the way. The bound is the least of three: the
triangle inequality says how near a vector of the annulus can come to the query, and an inner product is half of what
the squared lengths have more than the squared distance; the score of the pivot and the query's length times
the annulus's outer radius; the product of both lengths. Scores are exact whole numbers; bounds have a margin for rounding. Vectors
in clusters are found after a small share of the comparisons; where all directions are alike, as in noise of many
components, no bound can tell annuli apart and all are compared.

Pivots, about an eighth of the root of the number of vectors, are spread over a bounded sample by farthest-first
choice; they only steer the order, so the sample never costs a result. All vectors are indexed. A vector that very
many rows repeat fills several annuli, as the sort goes on by a hash of its id and its row. The summaries of the
slabs are a table in blocks; batches of queries meet every block. Queries move to slabs; a slab that many batches
want is served by several tasks, each with a bounded number of batches, so that copies of slabs grow with the
batches sent.

Vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an id. Vectors
of different length have no inner product and are not paired. Rows that repeat an id each count, as candidates
and as queries, whose results share one ranking. Rows with a query's own id are not its candidates; equal scores
go to the smaller id. With
fewer candidates than k all are returned. An empty table gives an empty result. Scores are exact over the whole
range of long: by products of doubles where all stay below 2^53, else of 64-bit, else of unbounded whole numbers.
A component or a score beyond the range counts as the nearest number in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselab.llm.common import materialise, pack, unpack

#: At least and at most so many pivots, and vectors of the sample for each.
PIVOTS, MOST_PIVOTS, SAMPLE = 32, 1024, 16
LEAST_SAMPLE = 2048
#: Vectors of an annulus, annuli of a slab.
ANNULUS, SLAB = 2048, 16
#: Summaries of a block, batches of queries that a block or a slab meets in one task.
SUMMARIES, BATCHES = 65_536, 64
RINGS = "slab long, kind int, size int, pivot int, low double, high double, most double, data binary"
RING = [c.split()[0] for c in RINGS.split(", ")]
LONG = 2**63 - 1
NONE = -(2**63)


def quantised(df: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: array of whole numbers, sq: squared length as a double, of the vectors that take part."""
    x = F.col("embedding")
    fit = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(fit, F.lit(False)))
    v = F.transform("embedding", lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    return rows.select("vec_id", v.alias("v")).withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))


def _spread_pivots(sample: list, most: int) -> dict[int, np.ndarray]:
    """By vector length, up to ``most`` vectors of the sample, each the farthest from those before it."""
    out = {}
    for size in {len(v) for v in sample}:
        m = np.array([v for v in sample if len(v) == size], float).reshape(-1, size)
        chosen, far = [0], ((m - m[0]) ** 2).sum(1)
        while len(chosen) < most and far.max(initial=0) > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((m - m[chosen[-1]]) ** 2).sum(1))
        out[size] = m[chosen]
    return out


def _pivot_distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((m**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (m @ pivots.T), 0))


def _products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, none above ``most``, as longs."""
    if most < 2**52:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.array([[max(-LONG, min(LONG, x)) for x in row] for row in (a.astype(object) @ b.T.astype(object)).tolist()], np.int64).reshape(len(a), len(b))


def _highest(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """The k best (score, id) of each row of ``scores``; ``ids`` ascend, so that equal scores go to the first."""
    scores = np.where(own[:, None] == ids, NONE, scores)
    bits = len(ids).bit_length()
    if len(ids) > k:
        usable = scores[scores > NONE]
        if not len(usable) or max(abs(int(usable.min())), abs(int(usable.max()))) < 1 << (62 - bits):
            # score and place fit one number; the query's own rows come last
            key = np.where(scores > NONE, scores, -(1 << (62 - bits))) * (1 << bits) + (len(ids) - 1 - np.arange(len(ids)))
            at = np.argpartition(-key, k - 1, axis=1)[:, :k]
        else:
            at = np.argsort(~scores, axis=1, kind="stable")[:, :k]
    else:
        at = np.broadcast_to(np.arange(len(ids)), scores.shape)
    return np.take_along_axis(scores, at, 1), ids[at]


class _Asked:
    """Queries, and the upper bounds of their inner products with annuli."""

    def __init__(self, m: np.ndarray, pivots: np.ndarray | None):
        self.sq = (m.astype(float) ** 2).sum(1)
        self.long = np.sqrt(self.sq)
        self.scores = m.astype(float) @ pivots.T if pivots is not None else None
        self.dist = _pivot_distances(m.astype(float), pivots) if pivots is not None else None

    def bounds(self, pivot: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray) -> np.ndarray:
        """A row for each query, a column for each annulus: its pivot, radii and largest squared length of a vector."""
        out = self.long[:, None] * np.sqrt(most)
        if self.dist is not None:
            d, at = self.dist[:, pivot], pivot >= 0
            far = np.maximum(np.maximum(low - d, d - high) - 1e-6 * (1 + d + high), 0)
            near = np.minimum((self.sq[:, None] + most - far**2) / 2, self.scores[:, pivot] + self.long[:, None] * high)
            out = np.where(at, np.minimum(out, near), out)
        return out + 1e-6 * (1 + self.sq[:, None] + most)


def search(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, compared=None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query. ``is_query`` is a condition on vec_id.

    ``compared``, an accumulator, gets the number of pairs of query and vector whose score was computed.
    """
    rows = materialise(quantised(df, scale).withColumn("copy", F.monotonically_increasing_id()), "vectors")
    n, most = rows.agg(F.count("*"), F.max("sq")).first()
    most = float(most or 0) * (1 + 1e-9)
    count = compared.add if compared is not None else lambda n: None
    wanted = min(MOST_PIVOTS, max(PIVOTS, math.isqrt(n) // 8))

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"data": [np.asarray(v, np.int64).tobytes() for v in b["v"]]})

    drawn = rows.orderBy(F.xxhash64("vec_id", "copy"), "vec_id").limit(max(LEAST_SAMPLE, SAMPLE * wanted)).select("v")
    pivots = _spread_pivots([np.frombuffer(r.data, np.int64) for r in drawn.mapInPandas(flat, "data binary").collect()], wanted)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["v"].map(len).to_numpy()
            near, dist = np.full(len(b), -1), np.zeros(len(b))
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                if s in pivots:
                    d = _pivot_distances(np.array(b["v"].iloc[own].tolist(), float).reshape(len(own), s), pivots[s])
                    near[own], dist[own] = d.argmin(1), d.min(1)
            yield b[["vec_id", "copy", "v", "query"]].assign(size=size, pivot=near, dist=dist)

    keyed = rows.select("vec_id", "copy", "v", is_query.alias("query")).mapInPandas(key, "vec_id long, copy long, v array<long>, query boolean, size int, pivot int, dist double")
    slabs = max(1, -(-n // (ANNULUS * SLAB)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Annuli of a slab, and its queries with the k-th best score of their own annulus."""
        slab, held = TaskContext.get().partitionId(), []

        def annulus(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("vec_id")
            m, ids = np.array(part["v"].tolist(), np.int64).reshape(len(part), int(part["size"].iloc[0])), part["vec_id"].to_numpy()
            s, p = int(part["size"].iloc[0]), int(part["pivot"].iloc[0])
            longest = float((m.astype(float) ** 2).sum(1).max())
            out = [(slab, 0, s, p, float(part["dist"].min()), float(part["dist"].max()), longest, pack((ids, m)))]
            asks = np.flatnonzero(part["query"].to_numpy(bool))
            if len(asks):
                count(len(asks) * len(m))
                scores, _ = _highest(_products(m[asks], m, most), ids, ids[asks], k)
                kth = scores.min(1) if scores.shape[1] >= k else np.full(len(asks), NONE)
                out.append((slab, 1, s, p, 0.0, 0.0, 0.0, pack((ids[asks], m[asks], kth))))
            return pd.DataFrame(out, columns=RING)

        for b in batches:
            held = pd.concat([held, b]) if len(held) else b
            while len(held):
                same = (held["size"].to_numpy() == held["size"].iloc[0]) & (held["pivot"].to_numpy() == held["pivot"].iloc[0])
                run = len(held) if same.all() else int((~same).argmax())
                if run == len(held) and run < ANNULUS:
                    break
                run = min(run, ANNULUS)
                yield annulus(held.iloc[:run])
                held = held.iloc[run:]
        if len(held):
            yield annulus(held)

    sorted_rows = keyed.repartitionByRange(slabs, "size", "pivot", "dist", F.xxhash64("vec_id", "copy")).sortWithinPartitions("size", "pivot", "dist")
    index = materialise(sorted_rows.mapInPandas(cut, RINGS), "annuli")

    # each batch of queries meets every block of summaries; a task has one block and some batches
    summary = materialise(index.where("kind = 0").groupBy("slab", "size", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("most").alias("most")), "summaries")
    asking = index.where("kind = 1").select("size", "data")
    n_blocks, n_salts = max(1, -(-summary.count() // SUMMARIES)), max(1, -(-asking.count() // BATCHES))

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    blocked = summary.withColumn("part", F.pmod(F.xxhash64("slab"), F.lit(n_blocks)).cast("int")).withColumn("salt", every(n_salts))
    batched = asking.withColumn("salt", F.pmod(F.xxhash64("data"), F.lit(n_salts)).cast("int")).withColumn("part", every(n_blocks))

    def route(batches: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """The queries that each slab may serve better than their own annulus did."""
        out = []
        for size, data in zip(batches["size"], batches["data"]):
            ids, m, kth = unpack(data)
            fit = known[known["size"] == size]
            slab, ring = fit["slab"].to_numpy(), [fit[c].to_numpy() for c in ("pivot", "low", "high", "most")]
            hit = _Asked(m, pivots.get(size)).bounds(*ring) >= kth[:, None]
            for to in np.unique(slab[hit.any(0)]).tolist():
                some = hit[:, slab == to].any(1)
                out.append((to, 1, size, 0, 0.0, 0.0, 0.0, pack((ids[some], m[some], kth[some]))))
        return pd.DataFrame(out, columns=RING)

    routed = batched.groupBy("part", "salt").cogroup(blocked.groupBy("part", "salt")).applyInPandas(route, RINGS)
    asked = materialise(routed, "asked")
    pieces = materialise(asked.groupBy("slab").agg(F.ceil(F.count("*") / BATCHES).cast("int").alias("pieces")), "pieces")
    dealt = asked.join(pieces, "slab").withColumn("piece", F.pmod(F.xxhash64("data"), F.col("pieces")).cast("int")).drop("pieces")
    served = index.where("kind = 0").join(pieces, "slab").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A slab's annuli against the batches of queries sent to it, nearest annuli first for each batch."""
        rings, now = [], None
        for b in batches:
            for slab, piece, kind, size, p, low, high, longest, data in b[["slab", "piece", "kind", "size", "pivot", "low", "high", "most", "data"]].itertuples(index=False):
                if (slab, piece) != now:
                    rings, now = [], (slab, piece)
                if kind == 0:
                    rings.append((size, p, low, high, longest, unpack(data)))
                    continue
                ids, m, kth = unpack(data)
                own = [ring for ring in rings if ring[0] == size]
                every = _Asked(m, pivots.get(size)).bounds(*(np.array([ring[c] for ring in own]) for c in (1, 2, 3, 4))) if own else np.zeros((len(ids), 0))
                bounds = [(every[:, j], ring[5]) for j, ring in enumerate(own)]
                best, names = np.full((len(ids), k), NONE), np.full((len(ids), k), LONG)
                for bound, (vec_ids, vectors) in sorted(bounds, key=lambda x: -x[0].max()):
                    ask = np.flatnonzero(bound >= np.maximum(kth, best[:, -1]))
                    if not len(ask):
                        continue
                    count(len(ask) * len(vectors))
                    s, i = _highest(_products(m[ask], vectors, most), vec_ids, ids[ask], k)
                    s, i = np.concatenate([best[ask], s], 1), np.concatenate([names[ask], i], 1)
                    order = np.lexsort((i, ~s), axis=1)[:, :k]
                    best[ask], names[ask] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                q, j = np.nonzero(best > NONE)
                yield pd.DataFrame({"query_id": ids[q], "vec_id": names[q, j], "score": best[q, j]})

    met = served.unionByName(dealt).repartition("slab", "piece").sortWithinPartitions("slab", "piece", "kind")
    found = met.mapInPandas(serve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
