import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm.decontamination import cut_spans, decontaminate
from textloom.llm.fm_index import FMIndex, suffix_array

SCHEMA = "doc_id long, text string, spans string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, window):
    phrases = []
    for item, t in items:
        w = WORD.findall(lower(t))
        n = min(window, len(w))
        phrases += [(item, w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for item, p in phrases:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    if item is not None:
                        found.add(str(item))
        out.append((d, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,sigma", [(0, 3), (1, 9), (2, 60)])
def test_fm_index(seed, sigma):
    r = np.random.default_rng(seed)
    text = r.integers(1, sigma, 700)
    text[300:420] = text[:120]
    whole = np.concatenate((text, [0]))
    assert suffix_array(whole).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:].tolist())
    index = FMIndex(text, sigma, sample=5)
    lengths = r.integers(1, 6, 80)
    patterns = np.zeros((80, 6), np.int64)
    for k, n in enumerate(lengths):
        at = r.integers(0, 690)
        patterns[k, :n] = text[at : at + n] if k % 3 else r.integers(1, sigma, n)
    for k, (lo, hi) in enumerate(zip(*index.search(patterns, lengths))):
        p = patterns[k, : lengths[k]].tolist()
        assert sorted(index.locate(np.arange(lo, hi)).tolist()) == [i for i in range(700) if text[i : i + len(p)].tolist() == p]


@pytest.mark.parametrize("seed,vocab,window,block", [(1, 40, 10, 500_000), (2, 3, 4, 500_000), (3, 12, 3, 20), (4, 2, 10, 30)])
def test_against_brute_force(spark, seed, vocab, window, block):
    r = random.Random(seed)
    word = lambda: r.choice(["É", "B", "b", "7"]) + str(r.randint(0, vocab))
    text = lambda n: "".join(word() + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(r.randint(0, 24))) for i in range(20)] + [(20, None), (21, ""), (None, text(12)), (22, "!!"), (3, text(11))]
    docs = []
    for i in range(60):
        t = text(r.randint(0, 60))
        if r.random() < 0.6:
            t += " " + (r.choice(items)[1] or "").upper() + " " + text(r.randint(0, 9))
        docs.append((i, t))
    docs += [(1, docs[1][1]), (70, None), (71, ""), (None, items[5][1]), (72, items[0][1] + " " + items[1][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate(df, bench, window=window, block_words=block).collect()
    rows = [(x.doc_id, x.n_words, [j for s in x.spans for j in range(s.begin, s.end)], list(x["items"])) for x in got]
    assert sorted(rows, key=repr) == brute(docs, items, window)
    assert all(a.end < b.begin for x in got for a, b in zip(x.spans, x.spans[1:]))


def test_cut_and_empty(spark):
    df = spark.createDataFrame([(1, "Keep, one two THREE. and ü"), (2, "one two three"), (3, None), (4, "clean  text ")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "One two three")], "item_id long, text string")
    out = decontaminate(df, bench, carry=["text"]).select("doc_id", cut_spans("text", "spans").alias("t")).collect()
    assert {x.doc_id: x.t for x in out} == {1: "Keep, . and ü", 2: "", 3: None, 4: "clean  text "}
    assert decontaminate(df.limit(0), bench).count() == 0
    assert {tuple(x.spans) for x in decontaminate(df, bench.limit(0)).collect()} == {()}


def test_index_answers_phrases_outside_the_benchmark():
    import pyarrow as pa

    from textloom.llm.decontamination import Shard
    from textloom.llm.scan import NON_ALNUM, hash_bytes, scan

    r = random.Random(6)
    texts = [" ".join(f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 80))) for _ in range(40)]
    words = next(scan(pa.array(texts), NON_ALNUM, lower=True))
    shard = Shard(words.hash, words.first)
    every = [w for t in texts for w in t.split()]
    for _ in range(60):
        phrase = [f"w{r.randint(0, 31)}" for _ in range(r.randint(1, 3))]
        symbols = shard.symbols(hash_bytes([w.encode() for w in phrase]))
        got = sorted(shard.find(symbols[None, :], np.array([len(phrase)]))[0].tolist()) if symbols.all() else []
        ends = {int(x) for x in words.first}
        assert got == [i for i in range(len(every)) if every[i : i + len(phrase)] == phrase and not any(i < e < i + len(phrase) for e in ends)]


def test_long_texts(spark):
    r = random.Random(2)
    long = [f"w{r.randint(0, 5000)}" for _ in range(60_000)]
    items = [(1, " ".join(long[40_000:40_030])), (2, " ".join(long[5:9])), (3, "y " * 12)]
    docs = [(1, " ".join(long)), (2, "y " * 30_000), (3, "z" * 400_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, [tuple(s) for s in x.spans], list(x["items"])) for x in decontaminate(df, bench).collect()}
    assert got[2] == (30_000, [(0, 30_000)], ["3"]) and got[3] == (1, [], [])
    assert got[1][0] == 60_000 and (40_000, 40_030) in got[1][1] and (5, 9) in got[1][1] and set(got[1][2]) == {"1", "2"}
