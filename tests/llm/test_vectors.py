"""The three vector operators against plain numpy, with hostile rows."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import centroid_clustering, vector_codes, vector_search
from textloom.llm.centroid_clustering import BallTree, cluster_vectors
from textloom.llm.vector_codes import KdTrees, compress_vectors
from textloom.llm.vector_search import best_of_block, search_vectors
from textloom.llm.vectors import halved, int_blocks

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, cluster string, error string"
BAD = [
    (900, None, 1), (901, [], 1), (902, [1.0] * 63 + [None], 1), (903, [1.0] * 63 + [float("nan")], 2), (904, [float("inf")] + [1.0] * 63, None), (905, [1.0] * 63, 3),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA).repartition(3)


def sample(n=400, seed=0, copies=120, grid=None):
    """Unit vectors in groups; every third row is the same vector; ids are not in order."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64)) + 2 * rng.normal(size=(5, 64))[rng.integers(0, 5, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:copies] = x[0]
    if grid:
        x = np.round(x * grid) / grid
    ids = rng.permutation(n)
    return [(int(i), row.astype(np.float32).tolist(), None if i % 7 == 0 else int(i % 3)) for i, row in zip(ids, x)]


# --- what the operators share


@given(st.integers(1, 300), st.integers(2, 9))
@settings(max_examples=80, deadline=None)
def test_halves_are_never_empty(n, leaf):
    for b in halved(n, leaf):
        assert b[0] == 0 and b[-1] == n and np.diff(b).min() >= 1
    assert np.diff(halved(n, leaf)[-1]).max() <= leaf


def test_blocks_hold_whole_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"id": list(range(a, b)), "v": pa.array([[float(i), None if i == 5 else -0.5] for i in range(a, b)], pa.list_(pa.float32()))}) for a, b in ((0, 4), (4, 4), (4, 11))]
    got = list(int_blocks(iter(batches), "v", 2, 4, 3))
    assert [len(m) for _, m in got] == [3, 3, 3, 1]
    assert [i for c, _ in got for i in c["id"].to_pylist()] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert got[0][1].tolist() == [[0, -2], [4, -2], [8, -2]]
    with pytest.raises(ValueError, match="not below"):
        list(int_blocks(iter([pa.RecordBatch.from_pydict({"id": [1], "v": [[1e9, 0.0]]})]), "v", 2, 4, 3))


# --- trees against all distances


def _ints(draw_from, n, dims, seed):
    return np.random.default_rng(seed).integers(-draw_from, draw_from + 1, size=(n, dims))


@given(st.integers(1, 200), st.sampled_from([1, 3, 4000]), st.integers(1, 16), st.integers(0, 50))
@settings(max_examples=60, deadline=None)
def test_kd_trees_assign_as_all_distances_do(n, spread, entries, seed):
    x, books = _ints(spread, n, 12, seed), _ints(spread, 3 * entries, 4, seed + 1).reshape(3, entries, 4)
    kd = KdTrees.build(x, 3)
    kd = KdTrees.from_row(kd.row(pa.table({"i": list(range(n))})), 3, 4)
    chosen, counts, sums = kd.assign(books)
    parts = x.reshape(n, 3, 4).swapaxes(0, 1)
    want = ((parts[:, :, None] - books[:, None]) ** 2).sum(axis=3).argmin(axis=2)
    got = np.empty(3 * n, dtype=int)
    got[kd.order] = chosen
    assert (got.reshape(3, n) == want).all()
    for p in range(3):
        for e in range(entries):
            assert counts[p, e] == (want[p] == e).sum() and (sums[p, e] == parts[p][want[p] == e].sum(axis=0)).all()


@given(st.integers(1, 200), st.sampled_from([1, 3, 60, 1 << 25]), st.integers(1, 16), st.integers(0, 50))
@settings(max_examples=60, deadline=None)
def test_ball_trees_assign_as_all_distances_do(n, spread, k, seed):
    x, centroids = _ints(spread, n, 6, seed), _ints(spread, k, 6, seed + 1)
    tree, order = BallTree.build(x)
    chosen, counts, sums = BallTree.from_row(tree.row(pa.table({"i": order})), 6).assign(centroids)
    want = ((x[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (chosen == want[order]).all()
    assert (counts == np.bincount(want, minlength=k)).all()
    assert all((sums[c] == x[want == c].sum(axis=0)).all() for c in range(k))


def test_whole_subtrees_are_assigned_at_once(monkeypatch):
    """Groups far apart: no leaf is looked into."""
    centres = np.array([[0] * 8, [4000] * 8])
    x = np.repeat(centres, 500, axis=0) + _ints(20, 1000, 8, 3)
    monkeypatch.setattr(KdTrees, "_leaves", lambda self, at, *rest: pytest.fail("a leaf was reached") if len(at) else None)
    assert np.bincount(KdTrees.build(x, 1).assign(centres[None])[0]).tolist() == [500, 500]
    looked = []
    monkeypatch.setattr(centroid_clustering, "squares", lambda rows, c, real=centroid_clustering.squares: looked.append(len(rows)) or real(rows, c))
    assert np.bincount(BallTree.build(x)[0].assign(centres)[0]).tolist() == [500, 500]
    assert sum(looked) <= 5


# --- whole operators


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in rows], dtype=np.float64) * scale).astype(np.int64).reshape(len(rows), parts, -1).swapaxes(0, 1)
    books = x[:, :entries].copy()
    for _ in range(rounds):
        at = ((x[:, :, None] - books[:, None]) ** 2).sum(axis=3).argmin(axis=2)
        for p, e in np.ndindex(books.shape[:2]):
            if (at[p] == e).any():
                books[p, e] = x[p][at[p] == e].sum(axis=0) // (at[p] == e).sum()
    far = ((x[:, :, None] - books[:, None]) ** 2).sum(axis=3)
    error = far.min(axis=2).sum(axis=0)
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code), int(e), by_label[r[2]], digest) for r, code, e in zip(rows, far.argmin(axis=2).T, error)]


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def test_codes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    rows = sample() + [(17, [0.5] * 64, None), (17, [0.5] * 64, None), (None, [-0.25] * 64, 5)]
    got = compress_vectors(table(spark, rows + BAD)).collect()
    assert _sorted(got) == _sorted(brute_codes(rows))


@pytest.mark.parametrize("n", [1, 5])
def test_few_vectors(spark, n):
    rows = sample(n, copies=0)
    assert _sorted(compress_vectors(table(spark, rows)).collect()) == _sorted(brute_codes(rows))
    got = cluster_vectors(table(spark, rows)).collect()
    assert len({r["cluster"] for r in got}) == n and all(r["distance"] == 0 for r in got)
    found = search_vectors(table(spark, rows), F.lit(True)).collect()
    assert len(found) == n * (n - 1)


def test_empty_tables(spark):
    for rows in ([], BAD[:2]):
        t = table(spark, rows)
        assert compress_vectors(t).collect() == [] and cluster_vectors(t).collect() == [] and search_vectors(t, F.lit(True)).collect() == []
    assert compress_vectors(t).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert search_vectors(t, F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]


def brute_clusters(rows, k=16, rounds=3):
    def key(r):
        return (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])

    rows = sorted(rows, key=key)
    x = np.floor(np.array([r[1] for r in rows], dtype=np.float64) * 64).astype(np.int64)
    c = x[:k].copy()
    for _ in range(rounds):
        at = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = x[at == j].sum(axis=0) // (at == j).sum()
    far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    at, d = far.argmin(axis=1), far.min(axis=1)
    return [(r[0], int(a), int(e), int(d[at == a].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[a].tolist())).encode()).hexdigest()) for r, a, e in zip(rows, at, d)]


@pytest.mark.parametrize("grid", [None, 4])
def test_clusters_against_brute_force(spark, monkeypatch, grid):
    monkeypatch.setattr(centroid_clustering, "BLOCK", 64)
    rows = sample(grid=grid) + [(17, [0.5] * 64, None), (17, [0.5] * 64, None), (None, [-0.25] * 64, 5)]
    assert _sorted(cluster_vectors(table(spark, rows + BAD)).collect()) == _sorted(brute_clusters(rows))


def brute_neighbours(rows, seeks, k):
    """Scores added up in the order of the components."""
    x = np.array([r[1] for r in rows], dtype=np.float64)
    scores = np.zeros((len(x), len(x)))
    for d in range(x.shape[1]):
        scores += x[:, d, None] * x[None, :, d]
    ids, out = np.array([r[0] for r in rows]), {}
    for q in sorted(set(ids.tolist())):
        if seeks(q):
            best = {}
            for i, s in zip(ids.tolist(), scores[ids == q].max(axis=0)):
                if i != q:
                    best[i] = max(best.get(i, -np.inf), s)
            out[q] = sorted(((i, s) for i, s in best.items()), key=lambda z: (-z[1], z[0]))[:k]
    return out


def _found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_search_recall_and_exact_scores(spark):
    rows = sample(3000, copies=300)
    want = brute_neighbours(rows, lambda i: i % 20 == 0, 20)
    got = _found(search_vectors(table(spark, rows + BAD + [(20 * 77777, [0.0] * 64, 1)]), F.col("vec_id") % 20 == 0))
    assert got.keys() == want.keys()
    scores = {q: dict(best) for q, best in brute_neighbours(rows, lambda i: i % 20 == 0, 3000).items()}
    assert all(len(v) == 20 and v == sorted(v, key=lambda z: (-z[1], z[0])) and all(scores[q][i] == s for i, s in v) for q, v in got.items())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_search_by_inner_product_of_uneven_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.array(v) * 4 ** rng.uniform(-1, 1)).astype(np.float32).tolist(), n) for i, v, n in sample(2000, seed=3, copies=0)]
    want = brute_neighbours(rows, lambda i: i % 20 == 0, 20)
    got = _found(search_vectors(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_hot_cells_are_cut_and_short_queries_searched_exactly(spark, monkeypatch):
    """One vector in a third of all rows, blocks of few rows, repeated ids, ties; every query falls back to all rows."""
    monkeypatch.setattr(vector_search, "CELL_ROWS", 50)
    monkeypatch.setattr(vector_search, "CELL_QUERIES", 10)
    monkeypatch.setattr(vector_search, "MOST_PROBES", 0)
    rows = sample(300, copies=100, grid=8)
    rows += [(7, rows[5][1], None), (7, rows[9][1], None), rows[0]]
    got = _found(search_vectors(table(spark, rows), F.col("vec_id") % 2 == 0, k=5))
    assert got == brute_neighbours(rows, lambda i: i % 2 == 0, 5)


def test_ids_may_be_texts(spark):
    rows = [(f"v{i:03d}", v, n) for i, v, n in sample(120, copies=30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "name string, e array<double>, label int, id string")
    got = _found(search_vectors(df, F.col("name").endswith("0"), "name", "e", k=5).withColumnRenamed("name", "vec_id"))
    want = brute_neighbours(rows, lambda i: i.endswith("0"), 5)
    assert got.keys() == want.keys() and np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9
    assert {len(r["code"]) for r in compress_vectors(df, "name", "e").collect()} == {16} and cluster_vectors(df, "name", "e").count() == 120


def test_blocks_rank_only_the_buckets_asked_for():
    x = np.eye(4)[[0, 0, 1, 2, 3]]
    found = best_of_block((np.arange(5), x, np.array([8, 9, 9, 9, 7])), (np.array([4]), np.ones((1, 4)), [[9, 1]]), 2)
    assert [f.tolist() for f in found[0]] == [[0, 0], [1, 2], [1.0, 1.0]]


def test_estimates_fall_and_cover_every_bucket():
    rng = np.random.default_rng(2)
    made = vector_search.Tables({0: 1.0}, rng.normal(size=(1, 9, 3)), rng.uniform(0, 1, (1, 3)), 1.4, 1, 0.5)
    q = rng.normal(size=(4, 8))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    path, mass, everything = made.visits(0, q, 10_000)
    assert (np.diff(mass, axis=1) <= 0).all() and np.allclose(mass.sum(axis=1), everything) and (everything > 0.999).all()
    short, least, _ = made.visits(0, q, 7)
    assert np.allclose(least, mass[:, :7])
    assert all(len({tuple(p) for p in one}) == len(one) for one in path)
