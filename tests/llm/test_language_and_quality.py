import itertools
import math
import random
import tracemalloc
import zlib
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest

from textloom.llm import language_id as L
from textloom.llm import quality as Q

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"bb"]
    p = np.random.default_rng(0).random((6, 2))
    words = [b"ababba", b"a", b"bbb"]
    got = L.Lattice(words, L.index_of(pieces), 3).likelihood(p)
    for w, row in zip(words, got):
        want = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(w)]
            parts = [w[a:b] for a, b in zip(at, at[1:])]
            if all(x in pieces for x in parts):
                want += math.prod((p[pieces.index(x)] for x in parts), start=np.ones(2))
        assert np.allclose(row, want)


def test_expectation_matches_enumeration():
    pieces = L.index_of([b"a", b"b", b"ab"])
    p = np.array([[0.5], [0.3], [0.2]])
    uses = L.Lattice([b"ab"], pieces, 2).expected(p, np.array([[4.0]]))
    whole = 0.5 * 0.3 + 0.2
    assert np.allclose(uses[:, 0], [4 * 0.15 / whole, 4 * 0.15 / whole, 4 * 0.2 / whole])


def exact_log(word, model, language):
    """Logarithm of the sum over all segmentations, by decimals that neither overflow nor vanish."""
    sums = [Decimal(1)]
    for j in range(1, len(word) + 1):
        ids = ((i, model.pieces.get(word[i:j], -1)) for i in range(j))
        sums.append(sum((sums[i] * Decimal(float(model.p[k, language])) for i, k in ids if k >= 0), Decimal(0)))
    return float(sums[-1].ln())


def test_every_piece_and_whole_words_are_scored():
    pieces = L.read_pieces(PATH)
    texts = [("en", "internationalization of the understandings and misunderstandings"), ("de", "die donaudampfschifffahrtsgesellschaftskapitänswitwenrentenanspruchsberechtigung und der hund")]
    model = L.fit_texts(texts, pieces)
    assert all(model.pieces[p] >= 0 for p in pieces) and model.longest == max(map(len, pieces)) > 12
    for word in ("responsibilities", "internationalization" * 4, "donaudampfschifffahrt" * 9, "x" * 900, "日本語" * 30):
        model.score([word])
        assert np.allclose(model.log[model.known[word]], [exact_log((" " + word).encode(), model, c) for c in range(2)], rtol=1e-9)


def test_logarithms_give_the_same_expectation():
    pieces = L.index_of([b"a", b"b", b"ab", b"ba", b"aba", b"bb"])
    r = np.random.default_rng(2)
    p, words, counts = r.random((6, 2)), [b"ababba", b"a", b"bbb", b"abab"], r.random((4, 2))
    lattice = L.Lattice(words, pieces, 3)
    assert np.allclose(lattice.log_expected(np.log(p), counts), lattice.expected(p, counts))
    assert np.allclose(lattice.log_likelihood(np.log(p)), np.log(lattice.likelihood(p)))


def test_ties_go_to_the_first_language():
    model = L.fit_texts([("b", "one two"), ("a", "one two")], [b"on", b"one"])
    assert model.score(["one two", "² ½", ""]) == (["a", "und", "und"], [0.5, 0.0, 0.0])


def test_held_out_accuracy_and_edges(spark, monkeypatch):
    docs = spark.read.parquet(SF + "/documents.parquet")
    model = L.fit(docs.where(L.fold(docs.doc_id, 4) != 2), PATH, rows=60)
    out = L.predict(docs, model, carry=["lang"]).toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert out.score.between(0, 1).all()
    edge = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 --", "x"), (None, "the and of", "x"), (3, "x" * 500, "x")], "doc_id long, text string, lang_pred string")
    got = sorted(((r.doc_id, r.lang_pred) for r in L.predict(edge, model).collect()), key=repr)
    assert [g for g in got if g[1] == "und"] == [(1, "und"), (2, "und"), (3, "und")]
    assert len(got) == 5
    assert L.predict(edge.limit(0), model).count() == 0
    none = L.fit(edge.withColumnRenamed("lang_pred", "lang").limit(0), PATH)
    assert {r.lang_pred for r in L.predict(edge, none).collect()} == {"und"}


def test_only_letters_make_words():
    import unicodedata

    assert L.words_of("² ½ Ⅷ ٣ 12_x2é Ünï²b") == ["x", "é", "ünï", "b"]
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        assert bool(L.words_of(c)) == unicodedata.category(c).startswith("L"), hex(ord(c))


def test_unlearnt_languages_and_noise_are_not_typical(spark):
    pieces = L.read_pieces(PATH)
    docs = [(r.lang, r.text) for r in spark.read.parquet(SF + "/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").collect()]
    names = sorted({k for k, _ in docs})
    whole = L.fit_texts(docs[::2], pieces)
    clean = [t for _, t in docs[1::2] if len(t) > 300]
    judged = whole.judge(clean)[2]
    assert sum(judged) >= 0.99 * len(judged)
    r = random.Random(5)
    noise = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(120)) for _ in range(20)]
    assert not any(whole.judge(noise)[2])
    for name in names:
        rest = L.fit_texts([(k, t) for k, t in docs[::2] if k != name], pieces)
        other = [t for k, t in docs[1::2] if k == name and len(t) > 300]
        assert sum(rest.judge(other)[2]) <= 0.1 * len(other), name
    assert whole.judge(["x"])[2] == [True] and whole.judge(["", "12"])[2] == [False, False]


def test_word_memory_does_not_change_scores(monkeypatch):
    texts = ["the cat and dog", "le chat et le chien", "el perro y gato"] * 3
    model = L.fit_texts(list(zip(["en", "fr", "es"] * 3, texts)), L.read_pieces(PATH))
    want = model.score(texts)
    monkeypatch.setattr(L, "WORDS_KEPT", 3)
    model.known.clear()
    assert [model.score([t])[0][0] for t in texts] == want[0]


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    both = docs.join(labels, "doc_id")
    model = Q.fit(docs, labels.where(L.fold(labels.doc_id, 5) != 0), rows=600)
    out = Q.score(both.where(L.fold(both.doc_id, 5) == 0), model, carry=["quality"]).toPandas()
    good, bad = (out[out.quality == y].score.values for y in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.85
    assert ((out.score >= 0.3) == (out.quality == 1)).mean() > 0.9


def test_quality_edges(spark):
    r = random.Random(1)
    texts = [(y, " ".join(r.choice(["alpha", "beta"] if y else ["###", "%%%"]) for _ in range(40))) for y in (0, 1) for _ in range(30)]
    model = Q.fit_texts(texts)
    df = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (None, "alpha beta" * 9000, 2.0), (4, "### %%%", 2.0), (4, "### %%%", 2.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in Q.score(df, model).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values()) and got[None] > got[4]
    assert Q.score(df.limit(0), model).count() == 0
    assert {r.score for r in Q.score(df, Q.fit_texts([])).collect()} == {0.5}


def test_a_fit_holds_few_bytes_an_arc():
    """Arcs are packed numbers, while they are gathered and after."""
    pieces = L.index_of([bytes(p) for k in (1, 2, 3) for p in itertools.product(b"abcde", repeat=k)])
    words = [bytes(w) for w in itertools.product(b"abcde", repeat=6)]
    tracemalloc.start()
    lattice = L.Lattice(words, pieces, 3)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(lattice.word) == 15 * len(words)
    assert held < 16 * len(lattice.word) and peak < 60 * len(lattice.word)
