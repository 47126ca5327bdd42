"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept. All but the last return the columns of ``documents``; ``n_chars`` follows the
text. The last returns each document's tokens.

Cases: null and letterless texts are rejected by the first stage, so later ones
see only texts with words. Documents whose text is used up by a removing stage go.
Rows with an id in common are told apart by their texts. An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import language_id
from textloom.llm.bpe import encode_and_decode
from textloom.llm.decontamination import cut_spans, decontaminate
from textloom.llm.jaccard_join import jaccard_join, row_keys
from textloom.llm.scratch import discard, materialize, shrink_heaps
from textloom.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text) -> DataFrame:
    """Documents with a new text; those left without one go."""
    out = docs.withColumn("text", text).where("length(text) > 0")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learnt languages; texts without letters, between languages or in none of them go."""
    shrink_heaps(spark)
    model = language_id.fit(docs.where(language_id.fold(F.col("doc_id"), 4) != 2), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    judged = language_id.predict(docs, model, carry=COLUMNS[1:])
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= language_id.KEEP) & F.col("typical")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents one row with the least id; rows of groups without any id stay, one for each text."""
    shrink_heaps(spark)
    groups = jaccard_join(docs, keyed_rows=True)
    least = groups.where("component_id = doc_id").groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("k"), F.count("*").alias("n")).select("k.k1", "k.k2", "n")
    unnamed = groups.where("component_id IS NULL").groupBy("k1", "k2").agg(F.count("*").alias("n"))
    kept = materialize(least.unionByName(unnamed), "kept")
    rows = docs.select(*row_keys("doc_id", "text"), *COLUMNS).join(kept.select("k1", "k2"), ["k1", "k2"], "left_semi")
    if not kept.where("n > 1").isEmpty():  # rows that repeat an id and a text are one document
        rows = rows.dropDuplicates(["k1", "k2"])
    return rows.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every word under a repeated window; documents without a word left go."""
    shrink_heaps(spark)
    kept = dedup_substrings(docs, carry=[c for c in COLUMNS[1:]])
    return _with_text(kept, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words of benchmark phrases; documents without a character left go."""
    shrink_heaps(spark)
    # Written first: searching and cutting in one task would need two Python workers a core.
    found = materialize(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS[1:]), "spans")
    return _with_text(found, cut_spans("text", "spans"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text; decoding must give the tokens' own text."""
    shrink_heaps(spark)
    out = encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["lang", "source"])
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding and decoding", tokens),
]

#: Language identification and the encoder cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs, before = materialize(stage(spark, docs, sf_dir), "stage"), docs
        if k:
            discard(before)
    return docs
