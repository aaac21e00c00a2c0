"""Clustering around centroids over integer vectors, with centroids filtered by n-simplex projection.

A few pivots are fixed for all rounds. The distances of a vector to the pivots are taken once and stored; together with
the pivots' own distances they give the vector's apex: its coordinates over the simplex that the pivots span, and its
altitude above it. Between two apexes, the distance with both altitudes on the same side is a lower bound of the
vectors' distance, that with them on opposite sides an upper bound. In every round a centroid whose lower bound exceeds
the least upper bound of a vector is left out; the others are compared by exact integer distance, so the result is that
of comparing all. Each round reads the stored rows once and sends sums by cluster, never vectors, to the driver.

Defined cases: vectors of another length, null ones and such with a null, NaN or infinite component are left out; a null
vec_id is kept and is a first centroid only when too few other rows are left; of equal vec_ids the smaller vector comes
first; with fewer rows than centroids every row is one; equal vectors share their cluster; an empty cluster keeps its
centroid; an empty table gives an empty result; a component whose magnitude reaches 2^26 after scaling is an error, as
squared distances would not fit 64 bits; only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

CLUSTERS, ROUNDS, DIMS, SCALE, SEED, PIVOTS = 40, 5, 64, 256, 2, 12
LIMIT = 1 << 26
#: Rows that are compared with the centroids at once.
BLOCK = 4096


class Simplex:
    """Pivots in general position, with their simplex in triangular coordinates."""

    def __init__(self, pivots: np.ndarray):
        """pivots: integer rows; those that add no dimension to the ones before are left out."""
        self.pivots, self.base = pivots[:1], np.zeros((0, 0))
        for p in pivots[1:]:
            apex = self.apexes(self.squares(p[None]))[0]
            if apex[-1] ** 2 > 1e-4 * max(1.0, float(apex @ apex)):  # it stands well above the simplex so far, or rounding would grow
                n = len(self.base)
                grown = np.zeros((n + 1, n + 1))
                grown[:n, :n] = self.base
                grown[n] = apex
                self.base, self.pivots = grown, np.vstack((self.pivots, p[None]))

    def squares(self, rows: np.ndarray) -> np.ndarray:
        """Exact squared distances of integer rows to the pivots."""
        return np.stack([((rows - p) ** 2).sum(1) for p in self.pivots], 1)

    def apexes(self, squares: np.ndarray) -> np.ndarray:
        """Apexes from squared distances to the pivots: a coordinate for each edge from the first pivot, then the altitude."""
        d = squares.astype(float)
        place = np.zeros((len(d), len(self.base)))
        for k, corner in enumerate(self.base):  # corner k has no coordinates after k
            inner = (d[:, 0] - d[:, k + 1] + corner @ corner) / 2
            place[:, k] = (inner - place[:, :k] @ corner[:k]) / corner[k]
        height = np.sqrt(np.maximum(0.0, d[:, 0] - (place**2).sum(1)))
        return np.column_stack((place, height))


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of the distances between rows with apexes a and rows with apexes b."""
    low = np.zeros((len(a), len(b)))
    for k in range(a.shape[1] - 1):
        low += (a[:, k, None] - b[None, :, k]) ** 2
    side = low.copy()
    low += (a[:, -1, None] - b[None, :, -1]) ** 2
    side += (a[:, -1, None] + b[None, :, -1]) ** 2
    return low, side


def nearest(rows: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each integer row (of equally near ones the first), and the squared distance."""
    low, high = bounds(apexes, tops)
    best = high.min(1)
    # an altitude near 0 is a root of a difference, so its rounding may reach a millionth of the vector's length
    slack = 1e-5 * ((apexes**2).sum(1) + (tops**2).sum(1).max()) + 1e-6
    row, cand = np.nonzero(low <= (best + slack)[:, None])
    exact = ((rows[row] - centroids[cand]) ** 2).sum(1)
    begin = np.searchsorted(row, np.arange(len(rows)))
    least = np.minimum.reduceat(exact, begin) if len(rows) else exact
    hit = np.flatnonzero(exact == least[row])
    first = hit[np.searchsorted(row[hit], np.arange(len(rows)))]
    return cand[first], least


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components times `scale` rounded down, of all rows with `dims` finite components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = F.coalesce((F.size("embedding") == dims) & F.forall("embedding", lambda c: F.coalesce(finite(c.cast("double")), F.lit(False))), F.lit(False))

    def step(c: Column) -> Column:
        big = F.abs(c * scale) >= LIMIT
        return F.when(big, F.raise_error(F.lit("a component is too large for exact distances")).cast("long")).otherwise(F.floor(c * scale))

    return vectors.where(whole).select("vec_id", F.transform(x, step).alias("v"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The rows with the smallest SHA-256 of `seed:vec_id`."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = kept.select(rank.alias("rank"), "v").orderBy(F.col("rank").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in chosen], np.int64)


def spread(rows: np.ndarray, many: int) -> np.ndarray:
    """Rows that lie far from each other: the first, then always the one farthest from those taken."""
    taken = [0]
    far = ((rows - rows[0]) ** 2).sum(1)
    while len(taken) < min(many, len(rows)) and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[taken[-1]]) ** 2).sum(1))
    return rows[taken]


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, pivots: int = PIVOTS
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector after the last round, and the final centroids."""
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, dims, scale)
    centroids = first_centroids(kept, clusters, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), centroids
    simplex = Simplex(spread(centroids, pivots))

    def project(parts):
        for b in parts:
            rows = _matrix(b.column("v"), np.int64)
            near = simplex.squares(rows)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), flat], ["vec_id", "v", "pivot_squares"])

    stored = materialise(kept.mapInArrow(project, f"vec_id {kind}, v array<bigint>, pivot_squares array<bigint>"))

    def assigned(parts, now: np.ndarray, tops: np.ndarray):
        for b in parts:
            rows, near = _matrix(b.column("v"), np.int64), _matrix(b.column("pivot_squares"), np.int64)
            for at in range(0, len(rows), BLOCK):
                some = rows[at : at + BLOCK]
                yield b.column("vec_id").slice(at, len(some)), some, *nearest(some, simplex.apexes(near[at : at + BLOCK]), now, tops)

    for _ in range(rounds):
        now, tops = centroids, simplex.apexes(simplex.squares(centroids))

        def sums(parts, now=now, tops=tops):
            total, n = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
            for _, rows, cluster, _ in assigned(parts, now, tops):
                order = np.argsort(cluster, kind="stable")
                cut = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                total[cluster[order][cut]] += np.add.reduceat(rows[order], cut, axis=0)
                n += np.bincount(cluster, minlength=len(now))
            for k in np.flatnonzero(n).tolist():
                yield pd.DataFrame({"cluster": np.int32(k), "axis": np.arange(total.shape[1], dtype=np.int32), "total": total[k], "n": n[k]})

        def parts_of(batches, sums=sums):
            for pdf in sums(batches):
                yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

        made = stored.mapInArrow(parts_of, "cluster int, axis int, total bigint, n bigint").groupBy("cluster", "axis").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in made.collect():  # a row for each cluster and axis
            centroids[r["cluster"], r["axis"]] = r["total"] // r["n"]

    now, tops = centroids, simplex.apexes(simplex.squares(centroids))

    def label(parts):
        for ids, _, cluster, distance in assigned(parts, now, tops):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return stored.mapInArrow(label, f"vec_id {kind}, cluster int, distance bigint"), centroids


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the digest of the cluster's centroid."""
    spark = vectors.sparkSession
    labelled, centroids = cluster_vectors(vectors, **options)
    digests = [(k, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    if digests:
        labelled = materialise(labelled)
    sums = {r["cluster"]: r["s"] for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    facts = spark.createDataFrame([(k, sums.get(k, 0), sum(sums.values()), d) for k, d in digests], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return labelled.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
