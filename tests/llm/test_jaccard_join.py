import random
import re

import numpy as np
import pytest

from textloom.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, n long, sid long, root string"


def brute(rows):
    sets = []
    for _, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, longest, vocab, edits, groups=25, copies=8):
    r = random.Random(seed)
    word = lambda: r.choice(["É", "B", "x"]) + str(r.randint(0, vocab))
    rows = []
    passage = [word() for _ in range(60)]
    for g in range(groups):
        base = [word() for _ in range(r.randint(1, longest))]
        if g % 4 == 0:
            base = base[:15] + passage
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randint(0, 1)] = [word()] if r.random() < 0.8 else []
            rows.append((1000 - len(rows), r.choice([" ", "\n\t"]).join(w)))
    r.shuffle(rows)
    return rows + [(2000, None), (2001, ""), (None, rows[0][1]), (None, "only one"), (3, "a b c"), (4, "A  b\nC"), (5, "a b d"), rows[1], (2002, " ")]


@pytest.mark.parametrize("seed,longest,vocab,edits,light", [(1, 120, 5000, 4, None), (2, 18, 5000, 2, None), (3, 24, 300, 1, 16), (4, 40, 3, 2, 0), (5, 16, 900, 1, 8)])
def test_against_brute_force(spark, monkeypatch, seed, longest, vocab, edits, light):
    if light is not None:
        monkeypatch.setattr(J, "boundary", lambda histogram: light)
    rows = corpus(seed, longest, vocab, edits)
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in J.jaccard_join(df).collect()), key=repr)
    assert got == brute(rows)


def test_lists_do_not_depend_on_batches():
    import pyarrow as pa

    r = np.random.default_rng(0)
    rows = sorted((int(t), int(s), int(20 + s % 7), int(s % 4)) for t, s in zip(r.integers(0, 40, 300), r.integers(0, 30, 300)))
    cols = [np.array(c) for c in zip(*rows)]
    batch = J._posting_batch(*cols)
    one = pa.Table.from_batches(J._lists([batch])).to_pydict()
    want = sorted({(t, s) for t, s, *_ in rows if len({b for a, b, *_ in rows if a == t}) > 1})
    assert sorted(zip(one["tok"], one["sid"])) == want
    for size in (1, 2, 7):
        out = pa.Table.from_batches(J._lists([batch.slice(i, size) for i in range(0, 300, size)])).to_pydict()
        assert {(t, s, l, st) for t, s, l, st in zip(out["tok"], out["sid"], out["lead"], out["state"]) if s != l} == {(t, s, l, st) for t, s, l, st in zip(one["tok"], one["sid"], one["lead"], one["state"]) if s != l}
        assert sorted(zip(out["tok"], out["sid"])) == want


def test_sketch_never_exceeds_difference():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 2 * n, n)).astype(np.uint64) for n in (1, 5, 30, 200, 220, 300, 900, 1000)]
    flat, words = J.sketches(np.concatenate(sets), np.array([len(x) for x in sets]))
    seen = 0
    for m, (places, marks) in J.folded(flat, words).items():
        for i, a in zip(places, marks):
            for j, b in zip(places, marks):
                if min(words[i], words[j]) == m:
                    seen += 1
                    assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(sets[i], sets[j]))
    assert seen > 20


@pytest.mark.parametrize("head_bytes,rows,few", [(1 << 23, 4096, 64), (2000, 7, 0), (500, 30, 10_000)])
def test_a_large_group_of_near_copies(spark, monkeypatch, head_bytes, rows, few):
    monkeypatch.setattr(J, "HEAD_BYTES", head_bytes)
    monkeypatch.setattr(J, "ROWS", rows)
    monkeypatch.setattr(J, "FEW", few)
    r = random.Random(9)
    base = [f"w{r.randint(0, 9999)}" for _ in range(150)]
    texts = []
    for i in range(160):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(150)] = f"n{r.randint(0, 9999)}"
        if i % 9 == 0:
            w += [f"x{r.randint(0, 9999)}" for _ in range(r.randint(0, 60))]
        texts.append((i, " ".join(w)))
    made = []
    real = J._across
    monkeypatch.setattr(J, "_across", lambda *a: made.append(J.materialize(real(*a), "made")) or made[0])
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = brute(texts)
    assert 2 < len({c for _, _, c in want}) < 120
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in J.jaccard_join(df).collect()), key=repr) == want
    assert 0 < made[0].count() < 2000  # 12,720 pairs


def test_long_texts(spark):
    r = random.Random(4)
    base = [f"w{r.randint(0, 99999)}" for _ in range(30_000)]
    other = list(base)
    for k in range(0, 30_000, 60):
        other[k] = "y"
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:25_000])), (4, " ".join(base[8_000:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in J.jaccard_join(df).collect()), key=repr) == brute(rows)


def test_empty(spark):
    assert J.jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0
