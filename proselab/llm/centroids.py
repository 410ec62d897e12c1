"""K-means over whole-number vectors with Hamerly's bounds: exact, and most vectors are not looked at again.

Every vector keeps its cluster, an upper bound of the distance to its own centroid and a lower bound of the distance to
any other. When centroids move, the bounds are loosened by how far they moved. A vector whose upper bound stays
under its lower one, or under half the way from its centroid to the next, keeps its cluster without any distance
being computed. Another one first gets its own distance; only if that does not settle it, all centroids are scanned in
whole numbers. Bounds have a margin for rounding, so that they settle no tie: equal distances are always
scanned, and go to the smaller number.

Each round is one pass over a table of vectors and bounds, without a shuffle, which writes the next table; the sums
of the vectors that changed their cluster ride on it, one row a task, are added by Spark and give the driver the new
centroids (``k`` vectors, the only thing that it holds). A lost executor costs its tasks of one round.

Components become floor(scale * x); a component beyond the range of long counts as the nearest number in it, as do
distances and sums of distances. Vectors that are null, of another length, or hold null, NaN or infinite
components take no part. The first centroids are the vectors with the smallest SHA-256 of "<seed>:<vec_id>"; a null
vec_id counts as empty there, and of rows that share an id the smaller vector comes first. Repeated rows
each count. With fewer vectors than ``k`` all are centroids; a centroid without vectors stays where it is. An
empty table gives an empty result. Only vec_id and embedding are read, so that no other column can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselab.llm.common import dealt, discard, materialise

LONG = 2**63 - 1
#: Components below this have squared distances that doubles hold exactly, up to 2048 of them.
SMALL = 1 << 20
STATE = "vec_id long, v array<long>, cluster int, upper double, lower double, scanned boolean, distance long, sums array<struct<cluster:int,n:long,high:array<long>,low:array<long>>>"


def quantised(df: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id, v: array of whole numbers, of the vectors that take part."""
    x = F.col("embedding")
    fit = (F.size(x) == size) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.coalesce(fit, F.lit(False)))
    return dealt(rows).select("vec_id", F.transform("embedding", lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"))


def squared(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two matrices of whole numbers: of longs where they fit, else unbounded ones."""
    if not m.size or not c.size or max(int(m.max()), -int(m.min()), int(c.max()), -int(c.min())) < SMALL:
        a, b = m.astype(float), c.astype(float)
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)).astype(np.int64)
    a, b = m.astype(object), c.astype(object)
    return (a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)


def roots(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(float))


def advance(m: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray):
    """cluster, upper, lower after the centroids moved by ``drift``, and which vectors met all centroids."""
    k = len(centroids)
    first = cluster < 0
    own = np.where(first, 0, cluster)
    gap = squared(centroids, centroids)
    np.fill_diagonal(gap, gap.max() + 1)
    half = roots(gap.min(1)) / 2 if k > 1 else np.full(1, np.inf)
    # what any other centroid may have come nearer: the largest drift but the own
    order = np.argsort(drift)
    most = np.where(own == order[-1], drift[order[-2]] if k > 1 else 0.0, drift[order[-1]])
    upper, lower = np.where(first, np.inf, upper + drift[own]), np.where(first, 0.0, lower - most)
    safe = np.maximum(lower, half[own])
    margin = 1e-9 * (1 + np.where(np.isfinite(safe), np.abs(safe), 0))
    doubt = np.flatnonzero(first | (upper + margin >= safe))
    known = doubt[~first[doubt]]
    if len(known):
        upper[known] = own_roots(m[known], centroids[own[known]])
        doubt = doubt[first[doubt] | (upper[doubt] + margin[doubt] >= safe[doubt])]
    cluster, scanned = own.copy(), np.zeros(len(m), bool)
    if len(doubt):
        scanned[doubt] = True
        d = squared(m[doubt], centroids)
        near = d.argmin(1)
        cluster[doubt], upper[doubt] = near, roots(d[np.arange(len(doubt)), near])
        if k > 1:
            d[np.arange(len(doubt)), near] = d.max() + 1
            lower[doubt] = roots(d.min(1))
        else:
            lower[doubt] = np.inf
    return cluster, upper, lower, scanned


def own_squared(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``m`` to the same row of ``c``."""
    if not m.size or max(int(m.max()), -int(m.min()), int(c.max()), -int(c.min())) < SMALL:
        return ((m - c) ** 2).sum(1)
    return ((m.astype(object) - c.astype(object)) ** 2).sum(1)


def own_roots(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return roots(own_squared(m, c))


def _moved(m: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each cluster gains: number of vectors, and sums of their components in two halves of 32 bits."""
    n, high, low = np.zeros(k, np.int64), np.zeros((k, m.shape[1]), np.int64), np.zeros((k, m.shape[1]), np.int64)
    at = np.flatnonzero(before != after)
    for cluster, sign in ((after[at], 1), (before[at], -1)):
        use = cluster >= 0
        np.add.at(n, cluster[use], sign)
        np.add.at(high, cluster[use], sign * (m[at][use] >> 32))
        np.add.at(low, cluster[use], sign * (m[at][use] & 0xFFFFFFFF))
    return n, high, low


def _round(state: DataFrame, centroids: np.ndarray, drift: np.ndarray, last: bool) -> DataFrame:
    k, size = centroids.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, high, low = None, np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros((k, size), np.int64)
        column = lambda b, name, kind: b.column(name).to_numpy(zero_copy_only=False).astype(kind)

        def out(b, cluster, upper, lower, scanned, sums=None):
            m = _matrix(b, size)
            distance = pa.array([min(int(d), LONG) for d in own_squared(m, centroids[cluster])] if last else [None] * len(m), pa.int64())
            carried = pa.array([sums] + [None] * (len(m) - 1), SUMS)
            return pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scanned), distance, carried], schema=ARROW
            )

        for b in batches:
            if not b.num_rows:
                continue
            if held:
                yield out(*held)
            m, before = _matrix(b, size), column(b, "cluster", np.int64)
            after, upper, lower, scanned = advance(m, before, column(b, "upper", float), column(b, "lower", float), centroids, drift)
            for total, gain in zip((n, high, low), _moved(m, before, after, k)):
                total += gain
            held = (b, after, upper, lower, scanned)
        if held:
            changed = np.flatnonzero((n != 0) | high.any(1) | low.any(1)).tolist()
            yield out(*held, [{"cluster": j, "n": int(n[j]), "high": high[j].tolist(), "low": low[j].tolist()} for j in changed])

    return state.mapInArrow(step, STATE)


SUMS = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))
ARROW = pa.schema(
    [("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("scanned", pa.bool_()), ("distance", pa.int64()), ("sums", SUMS)]
)


def _matrix(b: pa.RecordBatch, size: int) -> np.ndarray:
    return b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, size)


def _gains(state: DataFrame) -> dict[int, tuple[int, dict[int, int]]]:
    """cluster -> (vectors gained, component -> sum gained) of a round; at most k rows a component come back."""
    moved = state.where("sums IS NOT NULL").select(F.explode("sums").alias("s"))
    parts = moved.select("s.cluster", "s.n", F.posexplode(F.arrays_zip("s.high", "s.low")).alias("at", "x"))
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    out = {}
    for r in parts.groupBy("cluster", "at").agg(whole("n").alias("n"), whole("x.high").alias("high"), whole("x.low").alias("low")).collect():
        out.setdefault(r.cluster, (int(r.n), {}))[1][r.at] = (int(r.high) << 32) + int(r.low)
    return out


def seeds(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The first centroids: vectors with the smallest hash of their id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in vectors.withColumn("name", name).orderBy("name", "v").limit(k).select("v").collect()]


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: str = "2", trace: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    ``trace``, if given, gets one (vectors, vectors that met all centroids) for each assignment.
    """
    state = materialise(
        quantised(df, size, scale).select(
            "vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(False).alias("scanned"), F.lit(None).cast("long").alias("distance")
        ),
        "vectors",
    )
    start = seeds(state, k, seed)
    spark = df.sparkSession
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array(start, np.int64).reshape(-1, size)
    drift, count, sums = np.zeros(len(centroids)), [0] * len(centroids), [[0] * size for _ in centroids]
    for at in range(rounds + 1):
        after = materialise(_round(state, centroids, drift, at == rounds), "bounds")
        discard(state)
        state = after
        if trace is not None:
            trace.append(tuple(state.agg(F.count("*"), F.count_if("scanned")).first()))
        if at == rounds:
            break
        for j, (n, gained) in _gains(state).items():
            count[j] += n
            for i, x in gained.items():
                sums[j][i] += x
        moved = np.array([[x // n for x in s] if n else c for n, s, c in zip(count, sums, centroids.tolist())], np.int64)
        drift, centroids = own_roots(moved, centroids), moved

    found = {r.cluster: int(r.total) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    inertia = min(sum(found.values()), LONG)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    # one row a centroid: small enough to be sent to every task
    named = spark.createDataFrame([(j, min(t, LONG), inertia, digest(centroids[j].tolist())) for j, t in sorted(found.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
