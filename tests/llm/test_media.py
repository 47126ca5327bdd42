import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import media as M


def brute(prints, queries):
    """Best offset by trying them all, over those that some equal integers vote for."""
    out = {}
    for q in queries:
        for k, other in prints.items():
            if k == q or not len(other) or prints[q].tobytes() == other.tobytes():
                continue
            votes = {}
            for i, x in enumerate(prints[q]):
                for j in np.flatnonzero(other == x):
                    votes[int(j) - i] = votes.get(int(j) - i, 0) + 1
            if found := M.best_offset(prints[q], other, votes):
                out[q, k] = found
    return out


@pytest.mark.parametrize("block", [10_000, 2])
def test_search_against_brute_force(spark, block):
    r = np.random.default_rng(3)
    base = [r.normal(size=90) for _ in range(6)]
    vectors = {}
    for i in range(40):
        v = base[i % 6]
        at = int(r.integers(0, 20))
        v = v[at : at + 64].copy()
        if i % 4 == 1:
            v[int(r.integers(0, 64))] += 3
        vectors[i] = v
    vectors[40] = vectors[20]
    rows = [(i, [float(x) for x in v], 1) for i, v in vectors.items()] + [(41, None, 1), (42, [], 1), (43, [1.0, None], 1), (0, [float(x) for x in vectors[0]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, class_id int").repartition(3)
    prints = M.fingerprints(df, "vec_id", "embedding")
    own = {x["vec_id"]: np.frombuffer(bytes(x["print"]), "<u4") for x in prints.collect()}
    least = {}
    for k in sorted(own):
        least.setdefault(own[k].tobytes(), k)
    cls = {k: least[p.tobytes()] for k, p in own.items()}
    want = brute(own, [k for k in own if k % 20 == 0 and len(own[k])])
    got = M.search(prints, "vec_id", F.col("vec_id") % 20 == 0, block).collect()
    assert len(got) == len(rows)
    pairs = 0
    for x in got:
        assert x.class_id == cls[x.vec_id]
        if x.vec_id % 20:
            assert x.matches is None
        else:
            expected = sorted((cls[k], *f) for (q, k), f in want.items() if q == x.vec_id and cls[k] == k)
            assert [tuple(m) for m in x.matches] == expected
            pairs += len(expected)
    assert pairs > 3


def test_shift_and_noise_are_aligned():
    r = np.random.default_rng(5)
    pcm = M.render(r.normal(size=120)).astype(float)
    shift = 10 * M.HOP
    a, b = M.fingerprint(pcm), M.fingerprint(pcm[shift:] + r.normal(scale=200, size=len(pcm) - shift))
    votes = {}
    for i, x in enumerate(a):
        for j in np.flatnonzero(b == x):
            votes[int(j) - i] = votes.get(int(j) - i, 0) + 1
    offset, _, error = M.best_offset(a, b, votes)
    assert offset == -10 and error < 0.1
    assert np.bitwise_count(a[:60] ^ M.fingerprint(M.render(r.normal(size=120)).astype(float))[:60]).sum() / (32 * 60) > 0.25


def every_offset(query, other):
    """Best offset by trying them all, none left out for want of votes."""
    found = []
    for offset in range(M.OVERLAP - len(query), len(other) - M.OVERLAP + 1):
        a, b = max(0, -offset), max(0, offset)
        m = min(len(query) - a, len(other) - b)
        if m < M.OVERLAP:
            continue
        wrong = int(np.bitwise_count(query[a : a + m] ^ other[b : b + m]).sum())
        if wrong <= M.BIT_ERRORS * 32 * m:
            found.append((wrong - M.BIT_ERRORS * 32 * m, abs(offset), offset, m, wrong / (32 * m)))
    return min(found)[2:] if found else None


def test_pauses_do_not_hide_the_offset():
    for seed in range(12):
        r = np.random.default_rng(seed)
        tune = M.render(r.normal(size=64)).astype(float)
        a = M.fingerprint(np.concatenate((tune, np.zeros(60 * M.HOP))))
        b = M.fingerprint(np.concatenate((np.zeros(40 * M.HOP), tune + r.normal(scale=6000, size=len(tune)))))
        votes = {}
        for i, x in enumerate(a):
            for j in np.flatnonzero(b == x):
                votes[int(j) - i] = votes.get(int(j) - i, 0) + 1
        found = M.best_offset(a, b, votes)
        assert found == every_offset(a, b) and found[0] == 40


def equal_at_best(query, other, found):
    a, b = max(0, -found[0]), max(0, found[0])
    return int((query[a : a + found[1]] == other[b : b + found[1]]).sum())


def test_noisy_copies_are_found_without_equal_integers(spark):
    r = np.random.default_rng(7)
    vectors = [r.normal(size=64) for _ in range(12)]
    vectors += [v + r.normal(scale=0.3, size=64) for v in vectors]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    prints = M.fingerprints(df, "vec_id", "embedding")
    own = {x["vec_id"]: np.frombuffer(bytes(x["print"]), "<u4") for x in prints.collect()}
    want = {(q, k): f for q in own if q < 12 for k in own if k != q and (f := every_offset(own[q], own[k]))}
    got = {(x.vec_id, m.class_id): tuple(m)[1:] for x in M.search(prints, "vec_id", F.col("vec_id") < 12).collect() for m in x.matches or ()}
    assert got == want
    assert sum(equal_at_best(own[q], own[k], f) < 3 for (q, k), f in want.items()) > 3


def test_alignment_of_all_lengths_against_every_offset():
    r = np.random.default_rng(11)
    tune = r.integers(0, 1 << 32, 3400, dtype=np.uint32)
    cuts = [(0, 24), (10, 60), (5, 115), (30, 200), (0, 23), (0, 700), (400, 3300), (200, 3400), (0, 0)]
    noise = lambda n: np.packbits(r.random((n, 32)) < 0.1, axis=1).view(np.uint32).ravel()
    prints = [tune[a:b] ^ noise(b - a) for a, b in cuts] + [np.zeros(90, np.uint32), np.zeros(40, np.uint32)]
    prints += [tune[k : k + 60 + k] ^ noise(60 + k) for k in range(90)]
    own = list(range(len(prints)))
    want = {(q, k): f for q in own[:30] for k in own if k != q and (f := every_offset(prints[q], prints[k]))}
    got = {(q, k): (offset, m, e) for q, k, offset, m, e in zip(*(x.tolist() for x in M.Queries(own[:30], prints[:30]).matches(own, prints)))}
    assert got == want and want[6, 7][:2] == (200, 2900)


def test_integral_image_filters_are_rectangle_sums():
    pcm = M.render(np.random.default_rng(1).normal(size=40)).astype(float)
    image = M.chroma(pcm)
    kind, y, h, w = next(f for f in M.FILTERS if f[0] == 2)
    k = M.FILTERS.index((kind, y, h, w))
    prints = M.fingerprint(pcm)
    for x in range(len(prints)):
        a, b = image[x : x + w // 2, y : y + h].sum(), image[x + w // 2 : x + w, y : y + h].sum()
        code = M._GRAY[np.searchsorted(M.STEPS, np.log((1 + a) / (1 + b)))]
        assert (int(prints[x]) >> (2 * (len(M.FILTERS) - 1 - k))) & 3 == code


def test_pcm_and_empty(spark):
    pcm = M.render(np.random.default_rng(2).normal(size=64)).tobytes()
    df = spark.createDataFrame([(20, pcm), (21, pcm), (22, b"\x00"), (23, None)], "id long, media binary")
    out = {r.id: (r.class_id, r.n_frames) for r in M.search(M.fingerprints(df, "id", "media"), "id", F.col("id") % 20 == 0).collect()}
    assert out[20] == out[21] and out[20][1] > 50 and out[22] == out[23] == (22, 0)
    assert M.search(M.fingerprints(df.limit(0), "id", "media"), "id", F.lit(True)).count() == 0
