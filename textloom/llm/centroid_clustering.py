"""Centroid clustering: rounds of Lloyd over ball trees.

Every task cuts its rows into blocks and builds a metric tree over each block. A
ball has an integer centre (the floor of its mean), the largest distance from there
(its radius), its count and its sum. Trees are built once and written; a round walks
them, all balls of a level at a time. By the triangle inequality a centroid that lies
over two radii further from the centre than the nearest one is nearer to no row of
the ball; a ball with one centroid left goes to it whole, by its cached sum and count, and
a leaf that still has several is compared row by row in integers. Roots are only
used with a margin far above their rounding, so no bound is ever too tight.

Data movement: the written trees are about as large as the vectors and are read
once a round; a round shuffles one row per (task, cluster, component), summed before
it reaches the driver, which sees ``clusters * dims`` numbers.

Cases: vectors that are null, of another length than ``dims``, or hold null or
non-finite components take no part. The first centroids are the rows of least
``(sha256('1:' || id), id, vector)``; null ids have no hash and come last. With fewer rows
than clusters there are as many clusters as rows. Rows that repeat an id are rows of
their own. Scaled components must lie below 2**26 in size, else the job fails with a
message. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import discard, materialize
from textloom.llm.vectors import finite, halved, int_blocks, joined_digits, pack, pack_table, places, unpack, unpack_table

DIMS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Vectors of a block, and of a leaf.
BLOCK = 4096
LEAF = 8

_TREE = "carry binary, n long, points binary, centres binary, radii binary, sums binary"
_FAR = np.iinfo(np.int64).max


def _first_of_each(group: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The first place of every group at which ``hit`` holds; groups are runs and each has one."""
    at = np.flatnonzero(hit)
    return at[np.unique(group[at], return_index=True)[1]]


class BallTree:
    def __init__(self, points: np.ndarray, centres: np.ndarray, radii: np.ndarray, sums: np.ndarray):
        self.points, self.centres, self.radii, self.sums = points, centres, radii, sums
        self.bounds = halved(len(points), LEAF)

    @classmethod
    def build(cls, vectors: np.ndarray) -> tuple[BallTree, np.ndarray]:
        """The tree, and the places that its rows had."""
        n = len(vectors)
        order, balls = np.arange(n), []
        bounds = halved(n, LEAF)
        for level, b in enumerate(bounds):
            starts, sizes = b[:-1], np.diff(b)
            ball = np.repeat(np.arange(len(starts)), sizes)
            held = vectors[order]
            sums = np.add.reduceat(held, starts, axis=0)
            centres = sums // sizes[:, None]
            far = ((held - centres[ball]) ** 2).sum(axis=1)
            radii = np.maximum.reduceat(far, starts)
            balls.append((centres, radii, sums))
            if level + 1 < len(bounds):
                one = held[_first_of_each(ball, far == radii[ball])]
                far = ((held - one[ball]) ** 2).sum(axis=1)
                other = held[_first_of_each(ball, far == np.maximum.reduceat(far, starts)[ball])]
                along = (held * (other - one)[ball]).sum(axis=1)
                order = order[np.lexsort((along, ball))]
        return cls(vectors[order], *(np.concatenate(x) for x in zip(*balls))), order

    def row(self, carry: pa.Table) -> dict:
        return {"carry": pack_table(carry), "n": len(self.points), "points": pack(self.points, "<i4"), "centres": pack(self.centres, "<i4"), "radii": pack(self.radii, "<i8"), "sums": pack(self.sums, "<i8")}

    @classmethod
    def from_row(cls, row: dict, dims: int) -> BallTree:
        wide = lambda name, kind: unpack(row[name], kind, -1, dims).astype(np.int64)
        return cls(wide("points", "<i4"), wide("centres", "<i4"), unpack(row["radii"], "<i8", -1), wide("sums", "<i8"))

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster of every row in tree order, and count and sum of every cluster."""
        k = len(centroids)
        chosen = np.zeros(len(self.points), dtype=np.int64)
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        node, left = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        base = 0
        for level, b in enumerate(self.bounds):
            at, starts, sizes = base + node, b[node], np.diff(b)[node]
            away = np.where(left, np.sqrt(squares(self.centres[at], centroids).astype(np.float64)), np.inf)
            star = away.argmin(axis=1)
            nearest = away[np.arange(len(star)), star][:, None]
            reach = 2 * np.sqrt(self.radii[at].astype(np.float64))[:, None]
            with np.errstate(invalid="ignore"):
                left &= away - nearest <= reach + 1e-9 * (1 + np.where(left, away, 0) + nearest + reach)
            left[np.arange(len(star)), star] = True
            whole = left.sum(axis=1) == 1
            np.add.at(counts, star[whole], sizes[whole])
            np.add.at(sums, star[whole], self.sums[at[whole]])
            chosen[places(starts[whole], sizes[whole])] = np.repeat(star[whole], sizes[whole])
            base += len(b) - 1
            starts, sizes, node, left = starts[~whole], sizes[~whole], node[~whole], left[~whole]
            if level + 1 < len(self.bounds):
                node, left = np.repeat(2 * node, 2) + np.tile([0, 1], len(node)), np.repeat(left, 2, axis=0)
            else:
                rows = places(starts, sizes)
                points = self.points[rows]
                picked = np.where(np.repeat(left, sizes, axis=0), squares(points, centroids), _FAR).argmin(axis=1)
                chosen[rows] = picked
                np.add.at(counts, picked, 1)
                np.add.at(sums, picked, points)
        return chosen, counts, sums


def squares(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to integer centroids, exactly."""
    most = max((int(np.abs(x).max()) for x in (rows, centroids) if x.size), default=0)
    if 4 * most * most * rows.shape[1] < 1 << 53:  # all sums are integers that doubles hold
        rows, centroids = rows.astype(np.float64), centroids.astype(np.float64)
    return ((rows**2).sum(axis=1)[:, None] - 2 * (rows @ centroids.T) + (centroids**2).sum(axis=1)).astype(np.int64)


def _trees(vectors: DataFrame, vector_col: str, dims: int, scale: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for carry, ints in int_blocks(batches, vector_col, dims, scale, BLOCK):
            tree, order = BallTree.build(ints)
            yield pa.RecordBatch.from_pylist([tree.row(carry.take(pa.array(order)))])

    return vectors.mapInArrow(build, _TREE)


def _walked(trees: DataFrame, centroids: np.ndarray) -> list:
    """Counts and sums of every (cluster, component) over all trees."""
    k, dims = centroids.shape

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                _, n, s = BallTree.from_row(row, dims).assign(centroids)
                counts, sums = counts + n, sums + s
        cluster, place = np.argwhere(np.repeat(counts[:, None] > 0, dims, axis=1)).T
        yield pa.RecordBatch.from_pydict({"cluster": cluster.astype(np.int32), "place": place.astype(np.int32), "n": counts[cluster], "s": sums[cluster, place]})

    summed = trees.select("n", "points", "centres", "radii", "sums").mapInArrow(walk, "cluster int, place int, n long, s long")
    return summed.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()


def fit(vectors: DataFrame, id_col: str, vector_col: str, trees: DataFrame, dims: int, clusters: int, rounds: int, scale: int) -> np.ndarray:
    """Integer centroids after ``rounds`` of Lloyd."""
    kept = vectors.where(finite(F.col(vector_col)) & (F.size(vector_col) == dims))
    key = F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")), 256)
    first = kept.orderBy(key.asc_nulls_last(), F.col(id_col).asc_nulls_last(), vector_col).select(F.col(vector_col).alias("v")).limit(clusters).collect()
    centroids = np.floor(np.array([r["v"] for r in first], dtype=np.float64).reshape(len(first), dims) * scale).astype(np.int64)
    for _ in range(rounds if first else 0):
        for r in _walked(trees, centroids):
            centroids[r["cluster"], r["place"]] = int(r["s"]) // r["n"]
    return centroids


def assign(trees: DataFrame, centroids: np.ndarray, carried: str) -> DataFrame:
    """Carried columns, ``cluster`` and ``distance`` of every vector."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = BallTree.from_row(row, centroids.shape[1])
                chosen, _, _ = tree.assign(centroids)
                distance = ((tree.points - centroids[chosen]) ** 2).sum(axis=1)
                out = unpack_table(row["carry"])
                yield from out.append_column("cluster", pa.array(chosen.astype(np.int32))).append_column("distance", pa.array(distance)).to_batches()

    return trees.mapInArrow(walk, f"{carried}, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    carried = f"id {dict(rows.dtypes)['id']}"
    trees = materialize(_trees(rows, "v", dims, scale), "ball-trees")
    centroids = fit(rows, "id", "v", trees, dims, clusters, rounds, scale)
    placed = materialize(assign(trees, centroids, carried), "clusters")
    discard(trees)
    inertia = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [(k, inertia.get(k, 0), sum(inertia.values()), hashlib.sha256(joined_digits(c).encode()).hexdigest()) for k, c in enumerate(centroids)]
    known = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
