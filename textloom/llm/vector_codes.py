"""Vector code compression: product quantisation fitted by filtering Lloyd.

Vectors are cut into equal parts and each part position has a codebook of
integer entries. Every task cuts its rows into blocks and builds a kd-tree per part
position over each block: a node has its bounding box, its count and its sum. The
trees are built once and written; each round of Lloyd only walks them, all nodes of
a level at a time. At a node the entry nearest to the middle of the box beats
another one where it is nearer to the corner that lies furthest in the other's
direction (exact integers; on a tie the lower index wins). A node with one entry
left goes to it whole, by its cached sum and count; leaves that still have several
are compared part by part.

Data movement: the written trees are about as large as the vectors and are read
once a round; a round shuffles one row per (task, part, entry, place), summed before
it reaches the driver, which sees ``parts * entries * width`` numbers. Errors by
label are pre-aggregated; their join is broadcast by Spark only below its own
threshold on the written size of the sums.

Cases: vectors that are null, empty or hold null or non-finite components are
dropped, and so are vectors of another length than the most frequent one that the
number of parts divides. Entries start from the rows of least ``(id, vector)``, null
ids last; with fewer rows than entries there are as many entries as rows. Rows that
repeat an id are rows of their own. Scaled components must lie below 2**26 in size,
else the job fails with a message. Null labels form one group. An empty table gives
an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import discard, materialize
from textloom.llm.vectors import common_length, finite, halved, int_blocks, joined_digits, pack, pack_table, places, unpack, unpack_table

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Vectors of a block, and parts of a leaf.
BLOCK = 4096
LEAF = 16

_TREE = "carry binary, n long, places binary, points binary, low binary, high binary, sums binary"
_FAR = np.iinfo(np.int64).max


class KdTrees:
    """One kd-tree for each part position over the same vectors; nodes of a level lie side by side, tree after tree."""

    def __init__(self, n: int, order: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.n, self.order, self.points, self.low, self.high, self.sums = n, order, points, low, high, sums
        self.bounds = halved(n, LEAF)

    @classmethod
    def build(cls, vectors: np.ndarray, parts: int) -> KdTrees:
        n, dims = vectors.shape
        points = vectors.reshape(n, parts, dims // parts).swapaxes(0, 1).reshape(parts * n, dims // parts)
        order = np.arange(parts * n)
        boxes = []
        bounds = halved(n, LEAF)
        for level, b in enumerate(bounds):
            starts = (np.arange(parts)[:, None] * n + b[:-1]).ravel()
            sizes = np.tile(np.diff(b), parts)
            held = points[order]
            low, high = np.minimum.reduceat(held, starts, axis=0), np.maximum.reduceat(held, starts, axis=0)
            boxes.append((low, high, np.add.reduceat(held, starts, axis=0)))
            if level + 1 < len(bounds):
                widest = np.repeat((high - low).argmax(axis=1), sizes)
                order = order[np.lexsort((held[np.arange(len(held)), widest], np.repeat(np.arange(len(starts)), sizes)))]
        return cls(n, order, points[order], *(np.concatenate(x) for x in zip(*boxes)))

    def row(self, carry: pa.Table) -> dict:
        return {"carry": pack_table(carry), "n": self.n, "places": pack(self.order % self.n, "<i4"), "points": pack(self.points, "<i4"), "low": pack(self.low, "<i4"), "high": pack(self.high, "<i4"), "sums": pack(self.sums, "<i8")}

    @classmethod
    def from_row(cls, row: dict, parts: int, width: int) -> KdTrees:
        n = row["n"]
        order = unpack(row["places"], "<i4", parts, n) + np.arange(parts)[:, None] * n
        wide = lambda name, kind: unpack(row[name], kind, -1, width).astype(np.int64)
        return cls(n, order.ravel(), wide("points", "<i4"), wide("low", "<i4"), wide("high", "<i4"), wide("sums", "<i8"))

    def assign(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry of every part (by tree, in tree order), and counts and sums of every (part, entry)."""
        parts, entries, width = books.shape
        chosen = np.zeros(parts * self.n, dtype=np.int64)
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        tree, node = np.arange(parts), np.zeros(parts, dtype=np.int64)
        left = np.ones((parts, entries), dtype=bool)
        base = 0
        for level, b in enumerate(self.bounds):
            at = base + tree * (len(b) - 1) + node
            starts, sizes = tree * self.n + b[node], np.diff(b)[node]
            low, high, book = self.low[at], self.high[at], books[tree]
            middle = ((2 * book - (low + high)[:, None]) ** 2).sum(axis=2)
            star = np.where(left, middle, _FAR).argmin(axis=1)
            best = book[np.arange(len(star)), star][:, None]
            corner = np.where(book > best, high[:, None], low[:, None])
            behind = ((book - corner) ** 2 - (best - corner) ** 2).sum(axis=2)
            left &= ~((behind > 0) | ((behind == 0) & (np.arange(entries) > star[:, None])))
            left[np.arange(len(star)), star] = True
            whole = left.sum(axis=1) == 1
            np.add.at(counts, (tree[whole], star[whole]), sizes[whole])
            np.add.at(sums, (tree[whole], star[whole]), self.sums[at[whole]])
            chosen[places(starts[whole], sizes[whole])] = np.repeat(star[whole], sizes[whole])
            base += parts * (len(b) - 1)
            tree, node, left = tree[~whole], node[~whole], left[~whole]
            if level + 1 < len(self.bounds):
                tree, left = np.repeat(tree, 2), np.repeat(left, 2, axis=0)
                node = np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
            else:
                self._leaves(places(starts[~whole], sizes[~whole]), np.repeat(left, sizes[~whole], axis=0), books, chosen, counts, sums)
        return chosen, counts, sums

    def _leaves(self, at: np.ndarray, left: np.ndarray, books: np.ndarray, chosen: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        tree, points = at // self.n, self.points[at]
        least, star = np.full(len(at), _FAR), np.zeros(len(at), dtype=np.int64)
        for entry in range(books.shape[1]):
            of = np.flatnonzero(left[:, entry])
            far = ((points[of] - books[tree[of], entry]) ** 2).sum(axis=1)
            nearer = far < least[of]
            least[of[nearer]], star[of[nearer]] = far[nearer], entry
        chosen[at] = star
        np.add.at(counts, (tree, star), 1)
        np.add.at(sums, (tree, star), points)


def _trees(vectors: DataFrame, vector_col: str, dims: int, parts: int, scale: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for carry, ints in int_blocks(batches, vector_col, dims, scale, BLOCK):
            yield pa.RecordBatch.from_pylist([KdTrees.build(ints, parts).row(carry)])

    return vectors.mapInArrow(build, _TREE)


def _walked(trees: DataFrame, books: np.ndarray) -> list:
    """Counts and sums of every (part, entry, place) over all trees."""
    parts, entries, width = books.shape

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                _, n, s = KdTrees.from_row(row, parts, width).assign(books)
                counts, sums = counts + n, sums + s
        used = np.argwhere(np.repeat(counts[:, :, None] > 0, width, axis=2))
        part, entry, place = used.T
        yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "place": place.astype(np.int32), "n": counts[part, entry], "s": sums[part, entry, place]})

    summed = trees.select("n", "places", "points", "low", "high", "sums").mapInArrow(walk, "part int, entry int, place int, n long, s long")
    return summed.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()


def fit(vectors: DataFrame, id_col: str, vector_col: str, trees: DataFrame, dims: int, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """Codebooks ``[part, entry, place]`` after ``rounds`` of Lloyd from the rows of least id."""
    first = vectors.where(finite(F.col(vector_col)) & (F.size(vector_col) == dims)).orderBy(F.col(id_col).asc_nulls_last(), vector_col).select(F.col(vector_col).alias("v")).limit(entries).collect()
    seeds = np.floor(np.array([r["v"] for r in first], dtype=np.float64) * scale).astype(np.int64)
    books = seeds.reshape(len(seeds), parts, dims // parts).swapaxes(0, 1).copy()
    for _ in range(rounds):
        for r in _walked(trees, books):
            books[r["part"], r["entry"], r["place"]] = int(r["s"]) // r["n"]
    return books


def encode(trees: DataFrame, books: np.ndarray, carried: str, code_format: str = "02x") -> DataFrame:
    """Carried columns, ``code`` and ``error`` of every vector."""
    parts, _, width = books.shape
    schema = f"{carried}, code string, error long"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([format(k, code_format) for k in range(books.shape[1])])
        for batch in batches:
            for row in batch.to_pylist():
                kd = KdTrees.from_row(row, parts, width)
                chosen, _, _ = kd.assign(books)
                tree = np.repeat(np.arange(parts), kd.n)
                codes, errors = np.empty(parts * kd.n, dtype=np.int64), np.empty(parts * kd.n, dtype=np.int64)
                codes[kd.order] = chosen
                errors[kd.order] = ((kd.points - books[tree, chosen]) ** 2).sum(axis=1)
                code = ["".join(x) for x in digits[codes.reshape(parts, kd.n).T]]
                out = unpack_table(row["carry"])
                out = out.append_column("code", pa.array(code, pa.string())).append_column("error", pa.array(errors.reshape(parts, kd.n).sum(axis=0)))
                yield from out.to_batches()

    return trees.mapInArrow(walk, schema)


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of every usable vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    kinds = dict(rows.dtypes)
    carried = f"id {kinds['id']}, label {kinds['label']}"
    dims = common_length(rows, "v", parts)
    if not dims:
        coded = spark.createDataFrame([], f"{carried}, code string, error long")
        digest = ""
    else:
        trees = materialize(_trees(rows, "v", dims, parts, scale), "kd-trees")
        books = fit(rows, "id", "v", trees, dims, parts, entries, rounds, scale)
        digest = hashlib.sha256(joined_digits(books).encode()).hexdigest()
        coded = materialize(encode(trees, books, carried), "codes")
        discard(trees)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = materialize(by_label, "label-errors") if dims else by_label
    joined = coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return joined.select(F.col("c.id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
