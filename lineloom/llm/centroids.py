"""Centroid clustering with PCA-rotated filtering, exact in integers.

A vector's components become integers, floor(SCALE * x). The principal axes come from sums of products over all vectors: each
batch gives one square matrix, added up by Spark, so the driver sees one matrix of the dimension's size. A written table then
holds, per vector, its integers, its first LEAD rotated coordinates and the norm of the rest. For a vector v and a centroid c
the rotation keeps distances, so

    |v - c|^2  >=  |lead(v) - lead(c)|^2 + (rest(v) - rest(c))^2,

as the rests are vectors of which only the norms are known. An assignment takes the centroid with the smallest such bound,
finds its true distance in integers, and verifies in integers every other centroid whose bound, less a margin for floating
point, isn't above it. The result is therefore exact and doesn't depend on the rotation. A round's sums are exact integers:
per batch and cluster first, then added by Spark, so the driver sees one row a cluster and component.

Defined results: vectors that are null, of another length than `dim`, or hold a null or non-finite component take no part,
nor do those with an integer of 2^27 or more in size, whose squared distances a long couldn't hold. A null id counts as the
empty text in the choice of the first centroids; vectors whose ids share a hash are ordered by their components. With fewer
vectors than `k` each is a centroid. Repeated rows count as often as they stand; equal centroids: the smaller number wins.
Sums of distances beyond a long are null. Columns beyond id and vector are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, saved, table

DIM, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Rotated coordinates that are stored.
LEAD = 16
#: Integers are smaller than this, so that 64 squared differences fit a long.
MOST = 1 << 27
#: Share of the squared norms that floating point may be off by.
MARGIN = 1e-9


def integers(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    x = F.col(vec_col).cast("array<double>")
    good = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST / scale - 1))
    return df.select(F.col(id_col).alias("vec_id"), x.alias("x")).filter(good).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def axes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the principal axes, as columns, largest first."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            m = np.hstack([np.ones((b.num_rows, 1)), matrix(b.column(0), dim)])
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["p"])

    parts = vectors.select("v").mapInArrow(products, "p array<double>").select(F.posexplode("p").alias("at", "x"))
    # (dim + 1)^2 rows; the order of adding moves the axes by rounding alone, which no result depends on
    total = np.zeros((dim + 1) ** 2)
    for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect():
        total[r["at"]] = r["x"]
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    _, turned = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    return mean, turned[:, ::-1].copy()


def rotate(v: np.ndarray, mean: np.ndarray, turned: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading rotated coordinates and the norm of the others."""
    y = (v - mean) @ turned
    return y[:, :lead], np.sqrt(np.square(y[:, lead:]).sum(1))


def stored(vectors: DataFrame, dim: int, lead: int, mean: np.ndarray, turned: np.ndarray) -> DataFrame:
    """vectors with `lead` and `rest`, written once for all rounds."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, rest = rotate(matrix(b.column("v"), dim), mean, turned, lead)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), flat, pa.array(rest)], names=["vec_id", "v", "lead", "rest"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return saved(vectors.mapInArrow(turn, f"vec_id {kind}, v array<int>, lead array<double>, rest double"), "centroid-vectors")


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, c: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each vector, and how many distances were taken in full."""
    bound = np.square(lead[:, None, :] - c_lead[None]).sum(2) + np.square(rest[:, None] - c_rest[None])
    # the squared norms about the mean bound every term that was rounded
    size = (np.square(lead).sum(1) + np.square(rest))[:, None] + (np.square(c_lead).sum(1) + np.square(c_rest))[None]
    bound -= MARGIN * (size + 1)
    guess = bound.argmin(1)
    d = np.square(v - c[guess]).sum(1)
    open_ = bound <= d[:, None]
    open_[np.arange(len(v)), guess] = True
    at, which = np.nonzero(open_)
    full = np.full(bound.shape, np.iinfo(np.int64).max)
    full[at, which] = np.square(v[at] - c[which]).sum(1)
    best = full.argmin(1)  # the first of equals: the smaller number
    return best, full[np.arange(len(v)), best], len(at)


def assigner(dim: int, lead: int, mean: np.ndarray, turned: np.ndarray, c: np.ndarray) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    c_lead, c_rest = rotate(c, mean, turned, lead)

    def assign(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = matrix(b.column("v"), dim)
        at = b.column("lead").flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        best, d, _ = nearest(v, at, b.column("rest").to_numpy(zero_copy_only=False), c, c_lead, c_rest)
        return v, best, d

    return assign


def update(table_: DataFrame, dim: int, k: int, assign: Callable, c: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of exact means."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, best, _ = assign(b)
            total = np.zeros((k, dim + 1), np.int64)
            for j in np.unique(best):
                total[j, 0], total[j, 1:] = (best == j).sum(), v[best == j].sum(0)
            j, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(at), pa.array(total[j, at])], names=["j", "at", "x"])

    parts = table_.mapInArrow(sums, "j long, at long, x long")
    total = [[0] * (dim + 1) for _ in range(k)]
    # a row a cluster and component
    for r in parts.groupBy("j", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        total[r["j"]][r["at"]] = int(r["x"])
    return np.array([[x // t[0] for x in t[1:]] if t[0] else old for t, old in zip(total, c.tolist())], np.int64).reshape(-1, dim)


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, lead: int = LEAD) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) as a written table, and the centroids."""
    spark = df.sparkSession
    batch_rows(spark)
    vectors = saved(integers(df, id_col, vec_col, dim, scale), "centroid-integers")
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(key, "v").limit(k).select("v").collect()  # k rows
    c = np.array([r["v"] for r in first], np.int64).reshape(-1, dim)
    if not len(c):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c
    mean, turned = axes(vectors, dim)
    lead = min(lead, dim)
    rotated = stored(vectors, dim, lead, mean, turned)
    for _ in range(rounds):
        c = update(rotated, dim, len(c), assigner(dim, lead, mean, turned, c), c)
    assign = assigner(dim, lead, mean, turned, c)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, best, d = assign(b)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return saved(rotated.mapInArrow(last, f"vec_id {kind}, cluster int, distance long"), "centroid-clusters"), c


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, c = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    total = sum(sums.values())
    shas = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    fits = lambda x: F.lit(x if abs(x) < 1 << 63 else None).cast("long")
    own = F.array(*(fits(sums.get(j, 0)) for j in range(max(len(c), 1))))
    names = F.array(*(F.lit(s) for s in shas or [""]))
    at = F.col("cluster") + 1
    return found.select("vec_id", "cluster", "distance", F.element_at(own, at).alias("cluster_inertia"), fits(total).alias("inertia"), F.element_at(names, at).alias("centroid_sha256"))
