"""The registered queries of the training-data operators, one for each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import language_id, media, quality
from textloom.llm.bpe import encode_and_decode
from textloom.llm.centroid_clustering import cluster_vectors
from textloom.llm.decontamination import decontaminate
from textloom.llm.html_extract import extract_text
from textloom.llm.jaccard_join import jaccard_join
from textloom.llm.sharding import assign_shards
from textloom.llm.substring_dedup import dedup_substrings
from textloom.llm.url_filter import GLOBS, RULES, filter_urls
from textloom.llm.vector_codes import compress_vectors
from textloom.llm.vector_search import search_vectors


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_model(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) -> language_id.Model:
    docs = _read(spark, sf_dir, "documents")
    return language_id.fit(docs.where(language_id.fold(F.col("doc_id"), 4) != 2), path)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.predict(_read(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return out.select("doc_id", (language_id.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def op3_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_read(spark, sf_dir, "documents"))


def op6_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = media.fingerprints(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return media.search(prints, "vec_id", F.col("vec_id") % 20 == 0)


def op7_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    out = encode_and_decode(_read(spark, sf_dir, "documents"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").where(language_id.fold(F.col("doc_id"), 5) != 0)
    out = quality.score(docs, quality.fit(docs, labels))
    return out.select("doc_id", (language_id.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_vectors(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_ball_tree_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_read(spark, sf_dir, "embeddings"))


def op13_filtering_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _glob_to_regex(glob: str) -> str:
    out = "".join({"\0": ".*", "*": "[^/]*"}.get(c, c if c.isalnum() or c in "/-_" else "\\" + c) for c in glob.replace("**", "\0"))
    return f"(?s)^{out}$"


def _op8_sql() -> str:
    ranked = sorted(RULES, key=lambda r: (len(r[1] + r[2]), len(r[1])), reverse=True)
    fits = [f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))" for _, h, p in ranked]
    globs = " OR ".join(f"regexp_matches('.' || host || path, '{_glob_to_regex(g)}')" for g in GLOBS)
    rule = " ".join(f"WHEN {fit} THEN '{h}{p}'" for fit, (_, h, p) in zip(fits, ranked))
    verdict = " ".join(f"WHEN {fit} THEN '{v}'" for fit, (v, _, _) in zip(fits, ranked))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda k: f"coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', {k}), '')"
    return f"""
WITH parts AS (SELECT page_id, translate({part(1)}, '{upper}', '{lower}') AS host, {part(2)} AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


#: Windows of benchmark words, joined with those of documents as strings.
_OP2_SQL = """
WITH rx AS (SELECT '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+' AS p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents, rx),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark, rx),
q AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS s FROM (
  SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM q),
w AS (SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS s FROM (
  SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
occ AS (SELECT w.doc_id, q.item_id, w.i, w.k FROM w JOIN q ON w.k = q.k AND w.s = q.s),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM occ) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

#: Sets of shingles, pairs by shared shingles, components by reachability.
_OP5_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.v) AS component_id
FROM w JOIN reach r ON r.u = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id"""

#: Words, and windows of 35 as strings; a window goes if its string occurs twice.
_OP9_SQL = """
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, list_aggregate(list_slice(ws, i, i + 34), 'string_agg', ' ') AS s
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT md5(s) AS h FROM win GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM win WHERE md5(s) IN (SELECT h FROM rep))),
gone AS (SELECT r, list(j) AS js FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, k: NOT list_contains(coalesce(js, []), k)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (r)"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _squared(a: str, b: str, width: int) -> str:
    return f"list_sum(list_transform(range(1, {width + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))::BIGINT"


def _floor_mean(s: str, n: str) -> str:
    """Integer division that rounds down."""
    return f"(({s} - ((({s} % {n}) + {n}) % {n})) // {n})::BIGINT"


def _op12_sql(dims: int = 64, clusters: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds, one after the other, over all distances."""
    steps = [
        f"e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND {_FINITE})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM e ORDER BY h LIMIT {clusters}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, e.v, c, {_squared('e.v', 'k.v', dims)} AS d FROM e, c{r} k) GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT c, i, {_floor_mean('sum(x)', 'count(*)')} AS x FROM (SELECT c, unnest(range(1, {dims + 1})) AS i, unnest(v) AS x FROM a{r}) GROUP BY c, i)")
            steps.append(f"c{r + 1} AS (SELECT k.c, coalesce(n.v, k.v) AS v FROM c{r} k LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM m{r} GROUP BY c) n USING (c))")
    return "WITH " + ",\n".join(f"{s.split(' ', 1)[0]} AS MATERIALIZED{s.split(' AS', 1)[1]}" for s in steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k USING (c)"""


def _op13_sql(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds for every part position, over all distances."""
    steps = [
        f"e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_FINITE})",
        f"p AS (SELECT vec_id, q, list_slice(v, {width} * q + 1, {width} * q + {width}) AS v FROM (SELECT vec_id, v, unnest(range(0, {parts})) AS q FROM e))",
        f"c0 AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS c, v FROM p WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {entries}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, q, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, p.q, p.v, c, {_squared('p.v', 'k.v', width)} AS d FROM p JOIN c{r} k USING (q)) GROUP BY vec_id, q)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT q, c, i, {_floor_mean('sum(x)', 'count(*)')} AS x FROM (SELECT q, c, unnest(range(1, {width + 1})) AS i, unnest(v) AS x FROM a{r}) GROUP BY q, c, i)")
            steps.append(f"c{r + 1} AS (SELECT k.q, k.c, coalesce(n.v, k.v) AS v FROM c{r} k LEFT JOIN (SELECT q, c, list(x ORDER BY i) AS v FROM m{r} GROUP BY q, c) n USING (q, c))")
    return "WITH " + ",\n".join(f"{s.split(' ', 1)[0]} AS MATERIALIZED{s.split(' AS', 1)[1]}" for s in steps) + f""",
coded AS (SELECT vec_id, string_agg(printf('%02x', c), '' ORDER BY q) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY q, c)) AS h FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM books) AS codebooks_sha256
FROM coded JOIN e USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": _OP2_SQL,
        "op5_jaccard_join": _OP5_SQL,
        "op9_substring_dedup": _OP9_SQL,
        "op8_url_filters": _op8_sql(),
        "op12_ball_tree_clustering": _op12_sql(),
        "op13_filtering_codes": _op13_sql()}
