import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_decontamination as D
from tests.llm import test_jaccard_join as J
from tests.llm import test_substring_dedup as S

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34 --", "en", "s", 8), (9003, bench[0][1], "en", "s", len(bench[0][1]))], docs.schema)
    docs = docs.unionByName(extra)
    rows = {r.doc_id: r for r in docs.collect()}
    stages = corpus_pipeline.STAGES
    assert [name for name, _ in stages] == ["language ID", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]

    kept = corpus_pipeline.materialize(stages[0][1](spark, docs, SF), "t")
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(rows) - set(texts) == {9001, 9002} and all(rows[d].text == t for d, t in texts.items())

    kept = corpus_pipeline.materialize(stages[1][1](spark, kept, SF), "t")
    want = {d for d, _, c in J.brute(sorted(texts.items())) if d == c}
    texts = {d: t for d, t in texts.items() if d in want}
    assert {r.doc_id: r.text for r in kept.collect()} == texts

    kept = corpus_pipeline.materialize(stages[2][1](spark, kept, SF), "t")
    cut = {d: texts[d] if not n else k for d, _, n, k in S.brute(sorted(texts.items()), 35)}
    texts = {d: t for d, t in cut.items() if t}
    got = kept.collect()
    assert {r.doc_id: r.text for r in got} == texts and all(r.n_chars == len(r.text) for r in got)

    kept = corpus_pipeline.materialize(stages[3][1](spark, kept, SF), "t")
    dirty = {d for d, _, hit, _ in D.brute(sorted(texts.items()), bench, 10) if hit}
    got = {r.doc_id: r.text for r in kept.collect()}
    assert dirty and {d: t for d, t in got.items() if d not in dirty} == {d: t for d, t in texts.items() if d not in dirty}
    for d in dirty & set(got):
        words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", D.lower(t))
        n_hit = len(next(hit for x, _, hit, _ in D.brute([(d, texts[d])], bench, 10)))
        assert len(words(got[d])) == len(words(texts[d])) - n_hit

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in stages[4][1](spark, kept, SF).collect():
        ids = library.encode(got[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_repeated_and_null_ids_in_groups(spark):
    long = lambda k: " ".join(f"w{k}{i}" for i in range(60))
    near = long("b").replace("wb30 ", "x ")
    rows = [(5, long("a")), (5, near), (2, long("b")), (2, near), (None, long("c")), (None, long("c")), (None, long("a")), (9, long("d")), (9, long("d")), (7, "one")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert len(got) == len(set(got)) == 5
    assert {(5, long("a")), (9, long("d")), (7, "one"), (None, long("c"))} <= set(got)
    assert len({t for i, t in got if i == 2} & {long("b"), near}) == 1


def test_empty_table(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "t")
        assert docs.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
