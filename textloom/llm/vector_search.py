"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

The largest inner product becomes the least Euclidean distance by one more
component: within a band of similar lengths with longest ``M``, a row is hashed as
``(x / M, sqrt(1 - |x|^2 / M^2))`` and a query as ``(q / |q|, 0)``. Each of ``TABLES``
tables has ``K`` functions ``floor((a . x + b) / W)`` with Gaussian ``a``. The first
functions name a cell, which is the unit of work, the others a bucket within it.

A query visits buckets in falling order of the estimated probability that a
neighbour lies in them: given the query's projection, a neighbour's is normal around
``rho`` times it, so a bucket's estimate is a product of slot probabilities, and the
best products are found by a beam that is exact (every prefix of a best product is a
best prefix). It stops when the visited estimates sum to ``tau``. ``rho`` and ``tau`` are fitted
on ``SAMPLE_QUERIES`` rows (those of least hash) and their true neighbours, found among all
rows: ``tau`` is the least with which ``TARGET`` of them lie in a visited bucket of some table.
Where neighbours are hardly nearer than other rows, ``tau`` gets large and most buckets are
visited; recall is kept, not speed. Candidates are ranked by matrix products within
their bucket; scores are then added up again in the order of the components, so that
equal rows tie exactly.

Data movement: a row is sent once a table, a query once a cell that it visits. Cells are cut
to ``CELL_ROWS`` rows by ``CELL_QUERIES`` queries by their counts (rows of a hot cell are dealt out,
queries repeated, and the other way round), so no task holds more, whatever the skew. Each
block returns ``k`` rows a query; they are merged by pre-aggregated maximum and rank.
A query that found fewer than ``k``, or whose beam grew beyond ``MOST_PROBES``, is compared with all
rows in the same blocks. The driver sees the sample and counts by band of length.

Cases: vectors that are null, zero, of another length than the most frequent one, or
hold null or non-finite components take no part, nor do rows without an id. Rows that
repeat an id are one item: its score is the best of its vectors', and it is never its own
neighbour. Ties go to the smaller id. With fewer than ``k`` other items all are
returned. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erf, log2, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.scratch import discard, materialize
from textloom.llm.vectors import common_length, finite, rows_of

TABLES = 4
#: Width of a slot, in standard deviations of the rows' projections, and about how many bits such a slot tells.
WIDTH = 1.4
SLOT_BITS = 1.5
#: Rows that a bucket and a cell should hold, and what a block holds at most (about, as rows are dealt by chance).
BUCKET_ROWS = 256
CELL_ROWS = 32_768
CELL_QUERIES = 8_192
#: Sample for the fit: rows for the spread, and of these some as queries.
SAMPLE = 2_048
SAMPLE_QUERIES = 256
#: Part of the sample's neighbours that the fit must reach.
TARGET = 0.95
#: Beam of the fit, and of a query before it is searched exactly.
FIT_PROBES = 4_096
MOST_PROBES = 16_384

_GRID = np.linspace(-6, 6, 2401)
_NORMAL = np.array([(1 + erf(x / sqrt(2))) / 2 for x in _GRID])


@dataclass
class Tables:
    """The hash functions, and the order in which a query visits buckets."""

    tops: dict[int, float]  #: longest row of each band of lengths
    planes: np.ndarray  #: [table, dims + 1, function]
    shifts: np.ndarray  #: [table, function]
    width: float
    coarse: int  #: functions that name a cell
    rho: float = 0.0
    tau: float = 1.0

    def lifted(self, rows: np.ndarray, band: np.ndarray) -> np.ndarray:
        top = np.array([self.tops[b] for b in band.tolist()]).reshape(-1, 1)
        rows = rows / top
        return np.hstack([rows, np.sqrt(np.clip(1 - (rows**2).sum(axis=1, keepdims=True), 0, None))])

    def slots(self, table: int, lifted: np.ndarray) -> np.ndarray:
        return np.floor((lifted @ self.planes[table] + self.shifts[table]) / self.width).astype(np.int64)

    def keys(self, table: int, band: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and bucket as integers. Cells that share one are searched together, which loses nothing."""
        cell = _mixed(np.full(len(slots), table), band, *slots[:, : self.coarse].T)
        return cell, _mixed(np.zeros(len(slots), dtype=np.int64), *slots[:, self.coarse :].T)

    def visits(self, table: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For unit queries: slots of the ``beam`` likeliest buckets in falling order, their estimates, and all listed buckets' sum."""
        planes = self.planes[table][:-1]
        mean = self.rho * (queries @ planes) + self.shifts[table]
        spread = sqrt(max(1 - self.rho**2, 1e-6)) * np.sqrt((self.planes[table] ** 2).mean(axis=0))
        mass, path = np.ones((len(queries), 1)), np.zeros((len(queries), 1, 0), dtype=np.int64)
        everything = np.ones(len(queries))
        for f in range(planes.shape[1]):
            count = ceil(9 * spread[f] / self.width) + 1
            slot = np.floor((mean[:, f, None] - 4.5 * spread[f]) / self.width).astype(np.int64) + np.arange(count)
            edge = np.append(slot, slot[:, -1:] + 1, axis=1) * self.width
            p = np.diff(np.interp((edge - mean[:, f, None]) / spread[f], _GRID, _NORMAL), axis=1)
            everything *= p.sum(axis=1)
            grown = (mass[:, :, None] * p[:, None, :]).reshape(len(queries), -1)
            best = np.argsort(-grown, axis=1, kind="stable")[:, :beam]
            mass = np.take_along_axis(grown, best, axis=1)
            path = np.concatenate([np.take_along_axis(path, (best // count)[:, :, None], axis=1), np.take_along_axis(slot, best % count, axis=1)[:, :, None]], axis=2)
        return path, mass, everything


def _mixed(*parts: np.ndarray) -> np.ndarray:
    key = np.full(len(parts[0]), 0x243F6A8885A308D3, dtype=np.uint64)
    for part in parts:
        key = (key ^ part.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _unit(queries: np.ndarray) -> np.ndarray:
    return queries / np.linalg.norm(queries, axis=1, keepdims=True)


def _bands(rows: np.ndarray) -> np.ndarray:
    return np.floor(np.log2((rows**2).sum(axis=1)) / 2 + 0.5).astype(np.int64)


def _neighbours(usable: DataFrame, queries: np.ndarray, ids: list, dims: int, k: int) -> list:
    """The ``k`` nearest rows of each of a bounded set of queries, by one pass over all rows."""
    names = list(dict.fromkeys(ids))
    askers = {name: [q for q, x in enumerate(ids) if x == name] for name in names}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            keep, rows = rows_of(batch.column(1), dims)
            if not len(keep):
                continue
            scores = queries @ rows.T
            at = pc.index_in(batch.column(0).take(pa.array(keep)), value_set=pa.array(names, batch.column(0).type))
            for row in np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False)):
                scores[askers[names[at[int(row)].as_py()]], row] = -np.inf
            if best is not None:
                scores, rows = np.hstack([best[0], scores]), np.concatenate([best[1], rows])
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            used = np.unique(top)
            # Held: every query's scores of all rows that are among the best of some query.
            best = scores[:, used], rows[used]
        if best is not None:
            top = np.argsort(-best[0], axis=1, kind="stable")[:, :k]
            for q in range(len(queries)):
                hits = [i for i in top[q] if np.isfinite(best[0][q, i])]
                yield pa.RecordBatch.from_pydict({"q": pa.array([q] * len(hits), pa.int32()), "score": best[0][q, hits], "v": pa.array(list(best[1][hits]), pa.list_(pa.float64()))})

    found = usable.select("id", "v").mapInArrow(search, "q int, score double, v array<double>")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("q", "v").collect()


def fit(usable: DataFrame, dims: int, k: int, tables: int = TABLES, target: float = TARGET) -> Tables:
    """Hash functions for ``usable (id, v)``; see the module's head for what is fitted."""
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    bands = usable.groupBy(F.floor(F.log2(squared) / 2 + 0.5).alias("band")).agg(F.count("*").alias("n"), F.max(squared).alias("top")).collect()
    total = sum(r["n"] for r in bands)
    tops = {r["band"]: sqrt(r["top"]) for r in bands}
    sample = usable.orderBy(F.xxhash64("id"), "v").limit(SAMPLE).collect()
    rows = np.array([r["v"] for r in sample], dtype=np.float64).reshape(-1, dims)
    rng = np.random.default_rng(11)
    shape = Tables(tops, rng.normal(size=(tables, dims + 1, 24)), np.zeros((tables, 24)), 1.0, 0)
    lifted = shape.lifted(rows, _bands(rows))
    shape.width = WIDTH * max(float(np.sqrt((lifted @ shape.planes).var(axis=1).mean())), 1e-6)
    shape.shifts = rng.uniform(0, shape.width, size=shape.shifts.shape)

    queries = rows[:SAMPLE_QUERIES]
    near = _neighbours(usable, queries, [r["id"] for r in sample[:SAMPLE_QUERIES]], dims, k)
    unit, of = _unit(queries), np.array([r["q"] for r in near], dtype=np.int64)
    hits = np.array([r["v"] for r in near], dtype=np.float64).reshape(-1, dims)
    hits = shape.lifted(hits, _bands(hits))
    rho = float(np.median((unit[of] * hits[:, :-1]).sum(axis=1))) if len(hits) else 0.0
    planes, shifts = shape.planes, shape.shifts
    functions = max(1, min(24, round(log2(max(total / BUCKET_ROWS, 1)) / SLOT_BITS)))
    while True:
        coarse = min(functions, round(log2(max(total / CELL_ROWS, 1)) / SLOT_BITS))
        made = Tables(tops, planes[:, :, :functions], shifts[:, :functions], shape.width, coarse, min(max(rho, 0.0), 0.999))
        before = np.full((tables, len(hits)), np.inf)
        for t in range(tables):
            slots = made.slots(t, hits)
            for q in range(len(unit)):
                mine = np.flatnonzero(of == q)
                path, mass, _ = made.visits(t, unit[q : q + 1], FIT_PROBES)
                same = (path[0][None] == slots[mine][:, None]).all(axis=2)
                ahead = np.cumsum(mass[0]) - mass[0]
                before[t, mine] = np.where(same.any(axis=1), ahead[same.argmax(axis=1)], np.inf)
        least = np.sort(before.min(axis=0))
        need = float(least[min(len(least) - 1, int(target * len(least)))]) if len(least) else 0.0
        if np.isfinite(need) or functions == 1:
            made.tau = need + 1e-9 if np.isfinite(need) else np.inf
            return made
        functions -= 1  # neighbours are too far apart for buckets as small as these


def _hashed(usable: DataFrame, made: Tables, dims: int, id_type: str, v_type: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, values = rows_of(batch.column(1), dims)
            if not len(keep):
                continue
            own = batch.take(pa.array(keep))
            band = _bands(values)
            lifted = made.lifted(values, band)
            for t in range(len(made.planes)):
                cell, bucket = made.keys(t, band, made.slots(t, lifted))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(bucket), own.column(0), own.column(1)], names=["cell", "bucket", "id", "v"])

    return usable.select("id", "v").mapInArrow(rows, f"cell long, bucket long, id {id_type}, v {v_type}")


def _probes(queries: DataFrame, made: Tables, dims: int, id_type: str, v_type: str) -> DataFrame:
    """One row for each query and cell that it visits, with its buckets there; none for a query beyond ``MOST_PROBES``."""

    def visited(unit: np.ndarray, t: int) -> Iterator[tuple[int, np.ndarray]]:
        waiting, beam = np.arange(len(unit)), 256
        while len(waiting) and beam <= MOST_PROBES:
            short = []
            step = max(1, (1 << 19) // beam)
            for some in (waiting[i : i + step] for i in range(0, len(waiting), step)):
                path, mass, everything = made.visits(t, unit[some], beam)
                reached = np.cumsum(mass, axis=1)
                enough = (reached[:, -1] >= made.tau) | (reached[:, -1] >= everything - 1e-9)
                for i in np.flatnonzero(enough):
                    yield some[i], path[i][reached[i] - mass[i] < made.tau]
                short.append(some[~enough])
            waiting, beam = np.concatenate(short), 4 * beam
        yield from ((q, None) for q in waiting)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, values = rows_of(batch.column(1), dims)
            if not len(keep):
                continue
            unit, own = _unit(values), batch.take(pa.array(keep))
            lost, out = set(), []
            for t in range(len(made.planes)):
                for q, slots in visited(unit, t):
                    if slots is None:
                        lost.add(q)
                        continue
                    for band in made.tops:
                        cell, bucket = made.keys(t, np.full(len(slots), band), slots)
                        order = np.argsort(cell, kind="stable")
                        cuts = np.flatnonzero(np.diff(cell[order])) + 1
                        out += [(q, int(cell[part[0]]), bucket[part]) for part in np.split(order, cuts)]
            out = [x for x in out if x[0] not in lost]
            if out:
                at = pa.array([x[0] for x in out])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[1] for x in out]), pa.array([x[2] for x in out], pa.list_(pa.int64())), own.column(0).take(at), own.column(1).take(at)], names=["cell", "buckets", "id", "v"]
                )

    return queries.select("id", "v").mapInArrow(probe, f"cell long, buckets array<long>, id {id_type}, v {v_type}")


def _thinned(ids: np.ndarray, rows: np.ndarray, bucket: np.ndarray, k: int) -> np.ndarray:
    """Places to keep: of equal rows of a bucket the ``k + 1`` of least id, which is all that any query can return; repeats of a row go."""
    whole = np.ascontiguousarray(np.hstack([rows, bucket[:, None].view(np.float64)])).view(np.dtype((np.void, 8 * (rows.shape[1] + 1)))).ravel()
    alike = np.unique(whole, return_inverse=True)[1]
    order = np.lexsort((ids, alike))
    new = np.append(True, (np.diff(alike[order]) != 0) | (ids[order][1:] != ids[order][:-1]))
    order = order[new]
    runs = np.flatnonzero(np.append(True, np.diff(alike[order]) != 0))
    place = np.arange(len(order)) - np.repeat(runs, np.diff(np.append(runs, len(order))))
    return np.sort(order[place <= k])


def best_of_block(rows: tuple, queries: tuple, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(query place, row place, score)`` of the ``k`` best rows of each query among the buckets that it visits."""
    ids, x, bucket = rows
    own, q, visits = queries
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    out = []
    longest = np.linalg.norm(x, axis=1).max()
    for block in range(0, len(own), 256):
        some = np.arange(block, min(block + 256, len(own)))
        who = np.repeat(some, [len(visits[i]) for i in some])
        wanted = np.concatenate([visits[i] for i in some])
        at = np.clip(np.searchsorted(names, wanted), 0, len(names) - 1)
        there = names[at] == wanted
        who, at = who[there], at[there]
        sorted_by = np.argsort(at, kind="stable")
        who, at = who[sorted_by], at[sorted_by]
        slack = 1e-10 * longest * np.linalg.norm(q[some], axis=1)
        tops = np.full((len(some), k), -np.inf)
        kept = []
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else []:
            members, seekers = order[starts[at[part[0]]] : ends[at[part[0]]]], np.unique(who[part])
            for cut in range(0, len(members), 4096):
                some_rows = members[cut : cut + 4096]
                scores = q[seekers] @ x[some_rows].T
                scores[own[seekers][:, None] == ids[some_rows][None]] = -np.inf
                mine = seekers - block
                joined = np.hstack([tops[mine], scores])
                tops[mine] = np.partition(joined, joined.shape[1] - k, axis=1)[:, -k:]
                a, b = np.nonzero((scores >= (tops[mine].min(axis=1) - slack[mine])[:, None]) & (scores > -np.inf))
                kept.append((seekers[a], some_rows[b], scores[a, b]))
        if not kept:
            continue
        qi, xi, score = (np.concatenate(c) for c in zip(*kept))
        still = score >= tops[qi - block].min(axis=1) - slack[qi - block]
        qi, xi = qi[still], xi[still]
        score = np.zeros(len(qi))
        for d in range(q.shape[1]):
            score += q[qi, d] * x[xi, d]
        order_by = np.lexsort((ids[xi], -score, qi))
        qi, xi, score = qi[order_by], xi[order_by], score[order_by]
        # Rows that repeat an id: the first, which is the best, stays.
        _, first = np.unique(np.array([qi, np.unique(ids[xi], return_inverse=True)[1]]), axis=1, return_index=True)
        first.sort()
        qi, xi, score = qi[first], xi[first], score[first]
        runs = np.flatnonzero(np.append(True, np.diff(qi) != 0)) if len(qi) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(qi)) - np.repeat(runs, np.diff(np.append(runs, len(qi))))
        out.append((qi[place < k], xi[place < k], score[place < k]))
    return out


def _searched(rows: DataFrame, probes: DataFrame, dims: int, k: int, id_type: str) -> DataFrame:
    """``(query_id, id, score)``, the ``k`` best of each query among the rows of its buckets.

    ``rows`` are ``(cell, bucket, id, v)``, ``probes`` are ``(cell, buckets, id, v)``.
    """
    cells = rows.groupBy("cell").agg(F.count("*").alias("n")).join(probes.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    cells = materialize(cells.select("cell", F.ceil(F.col("n") / CELL_ROWS).alias("across"), F.ceil(F.col("m") / CELL_QUERIES).alias("down")), "cells")
    # The draw comes first, straight from the scan, so that a repeated task deals its rows alike.
    dealt = rows.withColumn("draw", F.rand(7)).join(cells, "cell").select(
        "cell", F.floor(F.col("draw") * F.col("across")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("block"), F.lit(False).alias("seeks"), "id", "v", F.array("bucket").alias("buckets")
    )
    asked = probes.join(cells, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("part"), F.pmod(F.xxhash64("id", "v"), F.col("down")).alias("block"), F.lit(True).alias("seeks"), "id", "v", "buckets"
    )

    def search(table: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": table["id"].slice(0, 0), "id": table["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        seeks = table["seeks"].to_numpy()
        if seeks.all() or not seeks.any():
            return empty
        held = [table.filter(pa.array(side)) for side in (~seeks, seeks)]
        (_, x), (_, q) = (rows_of(t["v"], dims) for t in held)
        # Numbers in the order of the ids, whatever their type.
        order = np.unique(np.concatenate([t["id"].to_numpy() for t in held]), return_inverse=True)[1]
        ids, own = order[: len(x)], order[len(x) :]
        bucket = held[0]["buckets"].combine_chunks().flatten().to_numpy()
        keep = _thinned(ids, x, bucket, k)
        found = best_of_block((ids[keep], x[keep], bucket[keep]), (own, q, held[1]["buckets"].to_pylist()), k)
        if not found:
            return empty
        qi, xi, score = (np.concatenate(c) for c in zip(*found))
        return pa.table({"query_id": held[1]["id"].take(pa.array(qi)), "id": held[0]["id"].take(pa.array(keep[xi])), "score": score})

    found = dealt.unionByName(asked).groupBy("cell", "part", "block").applyInArrow(search, f"query_id {id_type}, id {id_type}, score double")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def search_vectors(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, made: Tables | None = None) -> DataFrame:
    """``query_id, rank, id_col, score`` of the ``k`` nearest found for every row of ``vectors`` for which ``queries`` is true."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("seeks")).where("id IS NOT NULL")
    kinds = dict(rows.dtypes)
    dims = common_length(rows, "v")
    usable = rows.where(finite(F.col("v")) & (F.size("v") == dims) & F.exists("v", lambda x: x != 0)) if dims else rows.where("false")
    out = ["query_id", "rank", F.col("id").alias(id_col), "score"]
    if usable.isEmpty():
        return usable.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score")).select(*out)
    asking = usable.where("seeks")
    made = made or fit(usable.select("id", "v"), dims, k)
    hashed = _hashed(usable, made, dims, kinds["id"], kinds["v"])
    probes = materialize(_probes(asking, made, dims, kinds["id"], kinds["v"]), "probes")
    found = materialize(_searched(hashed, probes, dims, k, kinds["id"]), "found")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") == k)
    short = materialize(asking.join(full.select(F.col("query_id").alias("id")), "id", "left_anti").select("id", "v"), "short")
    discard(probes)
    if short.isEmpty():
        return found.select(*out)
    everywhere = usable.select(F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("bucket"), "id", "v")
    rest = _searched(everywhere, short.select(F.lit(0).cast("long").alias("cell"), F.array(F.lit(0).cast("long")).alias("buckets"), "id", "v"), dims, k, kinds["id"])
    kept = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
    return kept.select(*out).unionByName(rest.select(*out))
