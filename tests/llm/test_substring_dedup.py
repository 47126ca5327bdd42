import random
import re
from collections import Counter

import pytest

from textloom.llm.substring_dedup import dedup_substrings

SCHEMA = "doc_id long, text string, lang string, g long"


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def corpus(seed, vocab, n, longest):
    r = random.Random(seed)
    word = lambda: r.choice(["é", "B", "x" * 9, " ", "q."]) + str(r.randint(0, vocab))
    base = [[word() for _ in range(r.randint(0, longest))] for _ in range(n)]
    rows = []
    for i in range(n * 2):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            if w:
                w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w = w + list(r.choice(base))[:60] + w[:50]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(w)))
    return rows + [(1, rows[1][1]), (None, None), (7, ""), (8, "  \n"), (None, "one two")]


@pytest.mark.parametrize("window,prefix,subtree,vocab,longest", [(35, 6, 100_000, 4000, 150), (35, 6, 100_000, 2, 90), (5, 3, 100_000, 6, 40), (35, 6, 5, 3, 120), (35, 6, 1, 2, 90), (20, 4, 2, 2, 60), (2, 6, 3, 5, 12), (3, 1, 1, 4, 20), (1, 6, 100_000, 60, 6)])
def test_against_brute_force(spark, window, prefix, subtree, vocab, longest):
    rows = corpus(vocab, vocab, 60, longest)
    df = spark.createDataFrame([(i, t, "xx", 5) for i, t in rows], SCHEMA).repartition(3)
    got = dedup_substrings(df, window=window, prefix=prefix, subtree=subtree).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute(rows, window)


def test_over_full_prefix_is_split(spark):
    r = random.Random(3)
    tail = [f"t{k}" for k in range(8)]
    rows = []
    for i in range(26_000):
        side = [f"a{r.randrange(60)}" for _ in range(2)]
        rows.append((i, " ".join(side + tail)))
    df = spark.createDataFrame([(i, t, "xx", 5) for i, t in rows], SCHEMA).repartition(2)
    got = dedup_substrings(df, window=10, prefix=6, subtree=50).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got), key=repr) == brute(rows, 10)


def test_long_texts(spark):
    r = random.Random(8)
    part = [f"w{r.randint(0, 9999)}" for _ in range(20_000)]
    rows = [(1, " ".join(part + ["x"] + part[100:5000])), (2, " ".join(part[3000:4000])), (3, "y " * 50_000), (4, "z" * 300_000)]
    df = spark.createDataFrame([(i, t, "xx", 5) for i, t in rows], SCHEMA)
    got = dedup_substrings(df).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got), key=repr) == brute(rows, 35)


def test_empty_and_carry(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedup_substrings(df, carry=["lang"]).columns == ["doc_id", "lang", "n_words", "n_removed", "kept_text"]
    assert dedup_substrings(df).count() == 0


def test_words_of_alike_codes_are_other_words(spark):
    """Numbers whose 32 high bits of the hash are equal, each in the middle and at the end of texts that are otherwise one: windows without them repeat, those with them do not."""
    import numpy as np

    from textloom.llm.scan import hash_bytes

    numbers = [b"%d" % n for n in range(1_000_000, 1_400_000)]
    high = hash_bytes(numbers) >> np.uint64(32)
    order = np.argsort(high, kind="stable")
    pairs = [(order[k], order[k + 1]) for k in np.flatnonzero(high[order][1:] == high[order][:-1])][:8]
    assert len(pairs) == 8
    rows = []
    for p, pair in enumerate(pairs):
        for place in (0, 17, 34):
            for n in pair:
                words = [f"p{p}x{place}w{k}" for k in range(35)]
                words[place] = numbers[n].decode()
                rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame([(i, t, "xx", 5) for i, t in rows], SCHEMA).repartition(2)
    assert all(r.n_removed == 0 and r.kept_text == dict(rows)[r.doc_id] for r in dedup_substrings(df).collect())
