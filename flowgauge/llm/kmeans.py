"""Exact k-means by Yinyang filtering.

Centroids are clustered into groups once. A vector keeps an upper bound of the
distance to its own centroid and, for each group, one lower bound of the
distance to that group's other centroids. When centroids move, bounds give way
by as much; a vector whose upper bound lies below all lower bounds keeps its
centroid (the global filter), otherwise only groups whose bound isn't above it
are looked at (the group filter), and all of their centroids exactly.

Components are whole numbers, and all that decides is computed exactly: bounds
are floating-point numbers, moved outwards by more than their rounding.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import written

#: Below this, squared distances of up to 2,048 dimensions are exact in doubles; larger components are taken as Python integers.
EXACT = 2.0**20
#: Rows handled at once.
ROWS = 8192
STATE = "vec_id long, x binary, cluster int, upper double, lower binary"
OUT = "vec_id long, cluster int, distance long"
LONGEST = (1 << 63) - 1


def _whole(x: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Arrays of whole numbers in which sums of squares are exact."""
    if all(np.abs(a).max(initial=0) < EXACT for a in (x, *others)):
        return [a.astype(np.float64) for a in (x, *others)]
    return [np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) for a in (x, *others)]


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``x`` from rows ``c``."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]


def _roots(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above the square roots of exact squares."""
    if d.dtype == object:
        root = np.array([float(math.isqrt(v)) for v in d.ravel()]).reshape(d.shape)
        return root * (1 - 1e-12), (root + 1) * (1 + 1e-12)
    root = np.sqrt(d)
    return root * (1 - 1e-12), root * (1 + 1e-12)


def group_centroids(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: seeds chosen farthest first, then five rounds of k-means over the centroids."""
    c = centroids.astype(np.float64)
    c = c / max(1.0, np.abs(c).max(initial=0))  # huge components must not overflow: groups decide on cost alone
    seeds = [0]
    while len(seeds) < min(groups, len(c)):
        seeds.append(int(_square(c, c[seeds]).min(axis=1).argmax()))
    means = c[seeds]
    for _ in range(5):
        of = _square(c, means).argmin(axis=1)
        means = np.array([c[of == g].mean(axis=0) if (of == g).any() else means[g] for g in range(len(means))])
    return np.unique(_square(c, means).argmin(axis=1), return_inverse=True)[1]


def assign(
    x: np.ndarray, centroids: np.ndarray, group_of: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New (cluster, upper, lower) of each row, and the number of distances that were computed.

    ``upper`` and ``lower`` must hold for ``centroids`` already. Of centroids
    that are equally near that with the smallest number counts.
    """
    x, c = _whole(x, centroids)
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    least = lower.min(axis=1)
    rows = np.nonzero(~(least > upper))[0]  # the global filter
    own = ((x[rows] - c[cluster[rows]]) ** 2).sum(axis=1)
    upper[rows] = _roots(own)[1]
    computed = len(rows)
    left = ~(least[rows] > upper[rows])  # again, with the upper bound made exact
    rows, own = rows[left], own[left]
    best, best_d = cluster[rows].copy(), own.copy()
    seen = []
    for g in range(lower.shape[1]):
        at = np.nonzero(~(lower[rows, g] > _roots(best_d)[1]))[0]  # the group filter
        members = np.nonzero(group_of == g)[0]
        d = _square(x[rows[at]], c[members])
        computed += d.size
        first = d.argmin(axis=1) if len(at) else np.zeros(0, np.int64)
        each = np.arange(len(at))
        near = d[each, first]
        if len(members) > 1:
            rest = d.copy()
            rest[each, first] = d.max(initial=0)  # no smaller than any other of the row
            second_low = _roots(rest.min(axis=1))[0]
        else:
            second_low = np.full(len(at), np.inf)
        number = members[first]
        better = (near < best_d[at]) | ((near == best_d[at]) & (number < best[at]))
        best[at[better]], best_d[at[better]] = number[better], near[better]
        seen.append((g, at, number, _roots(near)[0], second_low))
    old = cluster[rows]
    own_low = _roots(own)[0]
    moved = best != old
    # the centroid that was left joins the others of its group
    places = rows[moved], group_of[old[moved]]
    lower[places] = np.minimum(lower[places], own_low[moved])
    for g, at, number, near_low, second_low in seen:
        lower[rows[at], g] = np.where(number == best[at], second_low, near_low)
    cluster[rows], upper[rows] = best, _roots(best_d)[1]
    return cluster, upper, lower, computed


def _rows(b: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(b.schema.get_field_index(name)).to_pylist()), np.float64).reshape(b.num_rows, width)


def _moves(old: np.ndarray, new: np.ndarray, group_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and the farthest of each group."""
    a, b = _whole(old, new)
    far = _roots(((a - b) ** 2).sum(axis=1))[1]
    return far, np.array([far[group_of == g].max() for g in range(group_of.max() + 1)])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def _packed(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in m.astype(np.float64)], pa.binary())


def kmeans(
    table: DataFrame,
    k: int = 16,
    rounds: int = 3,
    scale: float = 64,
    dim: int = 64,
    seed: str = "1",
    groups: int | None = None,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, a row for each vector of ``dim`` components.

    Components x count as floor(``scale`` * x). The first centroids are the
    ``k`` vectors with the smallest hex SHA-256 of ``<seed>:<id>``, in that order
    (of equal ids the smaller vector first); fewer vectors give fewer centroids.
    Each of ``rounds`` rounds assigns every vector to its nearest centroid, the
    smaller number at ties, and moves each centroid that has vectors to the
    floor of their mean, exactly; then all are assigned once more. Vectors that
    are null, of another length, or with null or non-finite components have no
    row; a null id is kept, but starts no centroid unless ids run out. Repeated
    rows count each. Distances and inertias beyond 64 bits are given as the
    largest long; sums of components beyond 38 digits raise. An empty table has
    no rows. Other columns are not read.

    Only centroids (``k`` rows) and their sums pass through the driver; sums are
    formed in each task and added up by Spark. Bounds travel with the vectors in
    a table that each round writes anew, so that a lost executor costs its tasks.
    """
    spark = table.sparkSession
    x = F.col(vector).cast("array<double>")
    grown = lambda e: e * F.lit(float(scale))
    # beyond 2^52 a double is whole as it stands, and floor would leave the range of longs
    scaled = F.transform("x", lambda e: F.when(F.abs(grown(e)) < 2.0**52, F.floor(grown(e)).cast("double")).otherwise(grown(e)))
    kept = (
        table.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))
        .filter((F.size("x") == dim) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
        .select("vec_id", scaled.alias("x"))
    )
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(name.asc_nulls_last(), "x").limit(k).select("x").collect()
    if not first:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    centroids = np.array([[int(v) for v in r["x"]] for r in first], object)
    group_of = group_centroids(centroids, groups or -(-len(centroids) // 4))
    n_groups = int(group_of.max()) + 1

    def step(now: np.ndarray, before: np.ndarray | None, last: bool):
        """A pass that assigns every vector to the centroids ``now``; bounds hold for those ``before``."""
        far, farthest = (None, None) if before is None else _moves(before, now, group_of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                if before is None:
                    flat = b.column(b.schema.get_field_index("x")).flatten()
                    v = flat.to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
                    cluster, upper, lower = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, np.inf), np.full((b.num_rows, n_groups), -np.inf)
                else:
                    v = _rows(b, "x", dim)
                    cluster = b.column(b.schema.get_field_index("cluster")).to_numpy().astype(np.int32)
                    upper = b.column(b.schema.get_field_index("upper")).to_numpy() + far[cluster]
                    lower = _rows(b, "lower", n_groups) - farthest
                    upper, lower = upper * (1 + 1e-12), lower - 1e-12 * np.abs(np.where(np.isfinite(lower), lower, 0))
                cluster, upper, lower, _ = assign(v, now, group_of, cluster, upper, lower)
                ids = b.column(b.schema.get_field_index("vec_id"))
                if last:
                    a, c = _whole(v, now)
                    d = [min(int(e), LONGEST) for e in ((a - c[cluster]) ** 2).sum(axis=1)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])
                else:
                    new = [ids, _packed(v), pa.array(cluster, pa.int32()), pa.array(upper), _packed(lower)]
                    yield pa.RecordBatch.from_arrays(new, names=["vec_id", "x", "cluster", "upper", "lower"])

        return run

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This task's number of vectors and sums of components of each centroid."""
        sums, counts = np.zeros((len(first), dim), object), np.zeros(len(first), np.int64)
        for b in _slices(batches):
            (v,) = _whole(_rows(b, "x", dim))
            cluster = b.column(b.schema.get_field_index("cluster")).to_numpy()
            for c in np.unique(cluster).tolist():
                some = v[cluster == c]
                sums[c] += np.array([int(s) for s in some.sum(axis=0)], object)
                counts[c] += len(some)
        at = np.nonzero(counts)[0]
        text = pa.array([[str(s) for s in sums[c]] for c in at], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at]), text], names=["cluster", "n", "sums"])

    state, before = kept, None
    for _ in range(rounds):
        state = written(state.mapInArrow(step(centroids, before, False), STATE), "assigned")
        parts = state.select("x", "cluster").mapInArrow(add, "cluster int, n long, sums array<string>")
        added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)])
        before, centroids = centroids, centroids.copy()
        for r in added.collect():  # a row for each centroid
            centroids[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dim)]
    found = written(state.mapInArrow(step(centroids, before, True), OUT), "clusters")
    each = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    hashes = [hashlib.sha256(",".join(str(v) for v in c).encode()).hexdigest() for c in centroids]
    rows = [(c, min(d, LONGEST), min(sum(each.values()), LONGEST), hashes[c]) for c, d in sorted(each.items())]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row for each centroid: bounded by k
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
