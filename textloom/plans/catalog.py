"""All queries outside the training-data subpackage, with their SQL twins.

Each entry applies one or a few operators to whole tables. Keys begin with the
operators' ids; ``QUERIES`` maps a key to (query, SQL or None).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import hashing as H
from textloom.functions import text as T
from textloom.operators import audit as A
from textloom.operators import bibliography as B
from textloom.operators import coverage as C
from textloom.operators import evidence as E
from textloom.operators import resolve as R
from textloom.operators import selection as S
from textloom.operators import store as V
from textloom.session import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _counts(sql: str) -> str:
    """``count_if(x)`` as a filtered count, whose type is a plain 64-bit integer in DuckDB."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if(') : end - 1]}){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, _counts(sql) if sql else None)
        return f

    return add


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each lower-cased word of a-z and non-ASCII letters."""
    return docs.select(*keep, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z\x{80}-\x{10FFFF}]+"), F.lit(0))).alias("w"))


_WORDS = r"unnest(regexp_extract_all(lower(text), '[a-z\x{80}-\x{10FFFF}]+')) AS w"


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark as a lookup table."""
    return _words(table(spark, sf_dir, "benchmark")).select("w").distinct()


# Text and hashing


@query("txt1_normalize", r"""SELECT doc_id, regexp_replace(translate(nfc_normalize(text), chr(1610) || chr(1609) || chr(1603) || chr(1749) || chr(8205), chr(1740) || chr(1740) || chr(1705) || chr(1607) || chr(8204)), '[ \t\r\n]+', ' ', 'g') AS normalized FROM documents""")
def txt1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@query("txt2_token_classes", r"""SELECT doc_id, len(regexp_extract_all(text, '\p{Nd}+'))::INT AS numbers, len(regexp_extract_all(text, '\p{Latin}[\p{Latin}\p{M}]*'))::INT AS latin, len(regexp_extract_all(text, '\p{P}'))::INT AS punctuation FROM documents""")
def txt2(spark, sf_dir):
    tokens = F.transform(T.tokens(F.col("text")), lambda t: T.token_class(t))
    count = lambda c: F.size(F.filter("cs", lambda x: x == c))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("cs")).select("doc_id", count("number").alias("numbers"), count("latin").alias("latin"), count("punctuation").alias("punctuation"))


@query("txt18_script_counts", r"""SELECT doc_id, len(regexp_extract_all(text, '\p{Arabic}'))::INT AS arabic, len(regexp_extract_all(text, '\p{Latin}'))::INT AS latin FROM documents""")
def txt18(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.script_counts(F.col("text")).alias("s")).select("doc_id", "s.arabic", "s.latin")


@query("txt9_without_diacritics", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def txt9(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.without_diacritics(F.col("text")).alias("plain"))


@query("txt14_header_keys", r"SELECT p_partkey, regexp_replace(lower(p_type), '[\s\-_]+', '', 'g') AS k FROM part")
def txt14(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.header_key(F.col("p_type")).alias("k"))


@query("hsh5_content_ids", """SELECT o_orderkey, 'o-' || left(sha256(o_orderkey::VARCHAR || chr(0) || coalesce(o_orderstatus, '') || chr(0) || coalesce(o_orderpriority, '')), 16) AS id FROM orders""")
def hsh5(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", H.content_id(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), prefix="o-").alias("id"))


@query("hsh8_manifest_checksum", r"""WITH l AS (SELECT o_orderstatus AS s, o_orderkey::VARCHAR || ':' || o_orderpriority AS line FROM orders), b AS (SELECT s, left(sha256(line), 2) AS b, sha256(left(sha256(line), 2) || chr(10) || string_agg(line, chr(10) ORDER BY line)) AS h, count(*) AS n FROM l GROUP BY s, left(sha256(line), 2))
SELECT s AS o_orderstatus, sha256(s || chr(10) || string_agg(b || ':' || h, chr(10) ORDER BY b || ':' || h)) AS checksum, sum(n)::BIGINT AS n FROM b GROUP BY 1""")
def hsh8(spark, sf_dir):
    line = F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderpriority")
    return H.bucketed_checksum(table(spark, sf_dir, "orders"), ["o_orderstatus"], line)


# Joins and coverage


def _covered(spark, sf_dir, *more):
    words = _words(table(spark, sf_dir, "documents"), "doc_id", "source", *more)
    lexicon = R.small(_lexicon(spark, sf_dir).withColumn("known", F.lit(True)))
    return words.join(lexicon, "w", "left").withColumn("covered", F.coalesce("known", F.lit(False)))


_COVERED = f"""WITH d AS (SELECT doc_id, source, {_WORDS} FROM documents), l AS (SELECT DISTINCT w FROM (SELECT {_WORDS} FROM benchmark)),
t AS (SELECT d.*, l.w IS NOT NULL AS covered FROM d LEFT JOIN l USING (w))"""


@query("lexicon_coverage_by_source", _COVERED + """, f AS (SELECT source, w, count(*) n, bool_or(covered) c, count_if(covered) k FROM t GROUP BY 1, 2),
a AS (SELECT source, sum(n)::BIGINT tokens, sum(k)::BIGINT covered_tokens, count(*) forms, count_if(c) covered_forms FROM f GROUP BY 1),
c AS (SELECT source, count(*) cases, count_if(c) covered_cases FROM (SELECT source, doc_id, bool_and(covered) c FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT source, tokens, covered_tokens, forms, covered_forms, cases, covered_cases::BIGINT AS covered_cases, round(covered_tokens / tokens * 100, 6) AS token_rate, round(covered_forms / forms * 100, 6) AS form_rate, round(covered_cases / cases * 100, 6) AS case_rate FROM a JOIN c USING (source)""")  # fmt: skip
def coverage(spark, sf_dir):
    return C.token_coverage(_covered(spark, sf_dir), ["source"], "w", "covered", "doc_id")


@query("agg16_miss_recovery", _COVERED + """, e AS (SELECT DISTINCT w FROM d WHERE length(w) <= 4), m AS (SELECT w, count(*) n, count_if(length(w) <= 4) r FROM t WHERE NOT covered GROUP BY 1)
SELECT sum(n)::BIGINT AS missed_tokens, sum(r)::BIGINT AS recovered_tokens, count(*) AS missed_forms, count_if(r > 0) AS recovered_forms FROM m""")  # fmt: skip
def recovery(spark, sf_dir):
    base = _covered(spark, sf_dir)
    now = base.select("doc_id", "w", (F.col("covered") | (F.length("w") <= 4)).alias("covered"))
    return C.miss_recovery(base, now, ["doc_id", "w"], "w")


@query("agg17_length_buckets", f"""WITH t AS (SELECT doc_id, count(*) n FROM (SELECT doc_id, {_WORDS} FROM documents) GROUP BY 1)
SELECT CASE WHEN n <= 1 THEN '0-1' WHEN n <= 4 THEN '2-4' WHEN n <= 8 THEN '5-8' WHEN n <= 15 THEN '9-15' ELSE '16+' END AS bucket, count(*) AS docs, sum(n)::BIGINT AS words FROM t GROUP BY 1""")
def buckets(spark, sf_dir):
    n = _words(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.groupBy(C.length_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("docs"), F.sum("n").alias("words"))


@query("flt1_eligibility", r"""WITH t AS (SELECT doc_id, lang, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS x FROM documents)
SELECT CASE WHEN x = '' THEN 'EMPTY_TITLE' WHEN lang <> 'fr' THEN 'NOT_LANGUAGE_FA' ELSE 'ONLY_PUNCTUATION_OR_NUMBERS' END AS reason, count(*) AS n FROM t GROUP BY 1""")
def eligibility(spark, sf_dir):
    return C.title_eligibility(table(spark, sf_dir, "documents"), "text", "lang", ["doc_id"], "fr").groupBy("reason").agg(F.count("*").alias("n"))


#: Names as titles: in Persian letters, in Latin ones, in both, cut, or gone.
_TITLES = """t AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'en' ELSE 'fa' END AS lang, CASE p_size % 6 WHEN 0 THEN '  ' WHEN 1 THEN p_name WHEN 2 THEN fa WHEN 3 THEN split_part(fa, ' ', 1) || ' ' || p_name WHEN 4 THEN left(fa, p_size % 5 + 1) ELSE split_part(fa, ' ', 1) || ' ' || CASE WHEN p_size > 30 THEN '' ELSE 'x ' || fa END END AS title
FROM (SELECT *, translate(lower(p_name), 'abcdefghijklmnopqrstuvwxyz', 'ابپتثجچحخدذرزژسشصضطظعغفقکگ') AS fa FROM part))"""


@query("flt1_all_reasons", f"""WITH {_TITLES}, n AS (SELECT *, trim(regexp_replace(title, ' +', ' ', 'g')) AS x FROM t),
c AS (SELECT *, len(regexp_extract_all(x, '\\p{{Arabic}}')) AS a, len(regexp_extract_all(x, '\\p{{Latin}}')) AS l, len(regexp_extract_all(x, '\\p{{Arabic}}+')) AS w FROM n),
r AS (SELECT *, CASE WHEN x = '' THEN 'EMPTY_TITLE' WHEN lang <> 'fa' THEN 'NOT_LANGUAGE_FA' WHEN a = 0 THEN 'ONLY_PUNCTUATION_OR_NUMBERS' WHEN l > a * 0.5 THEN 'PRIMARY_LATIN_METADATA' WHEN a < 4 THEN 'INSUFFICIENT_ARABIC_SCRIPT' WHEN w < 2 THEN 'FEWER_THAN_TWO_PERSIAN_TOKENS' END AS reason FROM c)
SELECT p_partkey, coalesce(reason, CASE WHEN p_partkey <> min(p_partkey) FILTER (WHERE reason IS NULL) OVER (PARTITION BY x) THEN 'DUPLICATE_NORMALIZED_TITLE' END) AS reason FROM r""")
def all_reasons(spark, sf_dir):
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    fa = F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz", "ابپتثجچحخدذرزژسشصضطظعغفقکگ")
    first = F.concat(F.split_part(fa, F.lit(" "), F.lit(1)), F.lit(" "))
    mixed = F.concat(first, F.when(size > 30, "").otherwise(F.concat(F.lit("x "), fa)))
    title = F.when(size % 6 == 0, "  ").when(size % 6 == 1, F.col("p_name")).when(size % 6 == 2, fa).when(size % 6 == 3, F.concat(first, "p_name")).when(size % 6 == 4, F.left(fa, (size % 5 + 1).cast("int"))).otherwise(mixed)
    rows = part.select("p_partkey", F.when(size % 7 == 0, "en").otherwise("fa").alias("lang"), title.alias("title"))
    return C.title_eligibility(rows, "title", "lang", ["p_partkey"]).select("p_partkey", "reason")


@query("jon5_cascade", f"""WITH w AS (SELECT doc_id, {_WORDS} FROM documents), a AS (SELECT lower(c_mktsegment) AS w FROM customer GROUP BY 1), n AS (SELECT w FROM w GROUP BY 1 HAVING count(*) > 20)
SELECT CASE WHEN a.w IS NOT NULL THEN 'SEGMENT' WHEN n.w IS NOT NULL THEN 'FREQUENT' END AS source, CASE WHEN a.w IS NOT NULL OR n.w IS NOT NULL THEN 'LEXICON_RESOLVED' ELSE 'UNRESOLVED' END AS state, count(*) AS n FROM w LEFT JOIN a USING (w) LEFT JOIN n USING (w) GROUP BY 1, 2""")
def cascade(spark, sf_dir):
    words = _words(table(spark, sf_dir, "documents"), "doc_id")
    segments = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("form")).distinct()
    frequent = words.groupBy(F.col("w").alias("form")).agg(F.count("*").alias("n")).where("n > 20").drop("n")
    sources = [(name, df.select("form", F.array("form").alias("canonicals"))) for name, df in (("SEGMENT", segments), ("FREQUENT", frequent))]
    return R.cascade(words, "w", sources).groupBy("source", "state").agg(F.count("*").alias("n"))


@query("jon6_next_turn", """SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations QUALIFY next_role IS NOT NULL""")
def next_turn(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), F.col("role").alias("surface"), F.lit("persian-word").alias("class"))
    return R.next_word(turns, "conv_id").select("conv_id", F.col("src_idx").alias("turn"), F.col("surface").alias("role"), F.col("next_surface").alias("next_role"))


@query("jon15_blocked_pairs", r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '/(\d+)', 1) AS num FROM pages),
k AS (SELECT page_id, host AS k, 'SAME_HOST' AS relation, 2 AS pr FROM p UNION ALL SELECT page_id, num, 'SAME_NUMBER', 1 FROM p WHERE num <> ''),
l AS (SELECT relation, k, min(page_id) AS a FROM k GROUP BY 1, 2)
SELECT a, page_id AS b, arg_min(relation, pr) AS relation FROM k JOIN l USING (relation, k) WHERE page_id <> a GROUP BY 1, 2""")
def blocked(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.nullif(F.regexp_extract("url", r"/(\d+)", 1), F.lit("")).alias("num"))
    return E.blocked_pairs(pages, "page_id", [("host", "SAME_HOST", 2), ("num", "SAME_NUMBER", 1)])


@query("jon17_pack_union", """WITH a AS (SELECT p_brand AS k, max(p_size)::BIGINT AS v FROM part WHERE p_size <= 25 GROUP BY 1), b AS (SELECT p_brand AS k, max(p_size)::BIGINT AS v FROM part WHERE p_size > 15 GROUP BY 1)
SELECT k, CASE WHEN b.v IS NULL THEN 'LEFT_ONLY' WHEN a.v IS NULL THEN 'RIGHT_ONLY' WHEN a.v = b.v THEN 'EQUAL' ELSE 'CONFLICT' END AS action, CASE WHEN a.v IS NULL OR b.v IS NULL OR a.v = b.v THEN coalesce(a.v, b.v) END AS v FROM a FULL JOIN b USING (k)""")
def pack_union(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    top = lambda df: df.groupBy(F.col("p_brand").alias("k")).agg(F.max("p_size").cast("long").alias("v"))
    return E.pack_union(top(part.where("p_size <= 25")), top(part.where("p_size > 15")), "k", "v")


def _cuts(spark, sf_dir):
    """The orders before 1998 and those from 1995 on, with dear ones changed: every row is in one of them."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderdate < timestamp '1998-01-01'").withColumn("h", F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256))
    status = F.when(F.col("o_totalprice") > 300000, "X").otherwise(F.col("o_orderstatus"))
    new = orders.where("o_orderdate >= timestamp '1995-01-01'").withColumn("h", F.sha2(F.concat_ws("|", status, "o_orderpriority"), 256))
    return old, new


@query("jon18_snapshot_diff", """WITH o AS (SELECT o_orderkey, sha256(o_orderstatus || '|' || o_orderpriority) h FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
n AS (SELECT o_orderkey, sha256(CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END || '|' || o_orderpriority) h FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01')
SELECT n.o_orderkey, CASE WHEN o.h IS NULL THEN 'NEW' WHEN o.h = n.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS change FROM n LEFT JOIN o USING (o_orderkey)""")
def diff(spark, sf_dir):
    old, new = _cuts(spark, sf_dir)
    return V.snapshot_diff(old, new, ["o_orderkey"], "h").select("o_orderkey", "change")


@query("jon19_incremental_retain", """WITH o AS (SELECT o_orderkey, 'old' AS side FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), n AS (SELECT o_orderkey, 'new' AS side FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01')
SELECT * FROM n UNION ALL SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)""")
def retained(spark, sf_dir):
    old, new = _cuts(spark, sf_dir)
    return V.retain(old.select("o_orderkey", F.lit("old").alias("side")), new.select("o_orderkey", F.lit("new").alias("side")), ["o_orderkey"])


@query("jon21_latest_event", """SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest(spark, sf_dir):
    return S.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


# Aggregates


@query("agg2_collisions", r"""SELECT lower(regexp_replace(p_name, '[^A-Za-z]+', '', 'g')) AS normalized, count(DISTINCT p_name) AS raw_forms FROM part GROUP BY 1 HAVING count(DISTINCT p_name) > 1""")
def collisions(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lower(F.regexp_replace("p_name", "[^A-Za-z]+", "")).alias("normalized"), "p_name")
    return E.collisions(rows, "normalized", "p_name").select("normalized", F.size("raw_forms").cast("long").alias("raw_forms"))


@query("agg5_scheme_conflicts", """WITH s AS (SELECT l_partkey, CASE WHEN l_linestatus = 'O' THEN 'IJMES' ELSE 'OTHER' END AS scheme, list_sort(list_distinct(list(l_returnflag))) AS v, count(*) n FROM (SELECT DISTINCT l_partkey, l_linestatus, l_returnflag, l_orderkey, l_linenumber FROM lineitem) GROUP BY 1, 2)
SELECT l_partkey, sum(n)::BIGINT AS evidence_count, count(*) AS schemes, count_if(len(v) > 1 AND scheme = 'IJMES') AS conflicting_schemes, array_to_string(list_sort(list_distinct(flatten(list(v)))), ',') AS variants FROM s GROUP BY 1""")
def scheme_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_linestatus") == "O", "IJMES").otherwise("OTHER").alias("scheme"), "l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_partkey").alias("ident"))
    return E.candidates(rows, "l_partkey", "scheme", "l_returnflag", "ident").withColumn("variants", F.array_join("variants", ","))


@query("agg7_consensus", """SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END))), ',') AS hypotheses, count(*) AS evidence_count,
CASE WHEN count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) > 1 THEN 'CONFLICTING_DETERMINISTIC' WHEN count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) = 0 THEN 'BLOCKED' WHEN count_if(l_returnflag = 'N') > 0 THEN 'PARTIAL' ELSE 'UNANIMOUS_DETERMINISTIC' END AS consensus FROM lineitem GROUP BY 1""")
def consensus(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("hypothesis"), F.when(F.col("l_returnflag") == "N", "OPEN").alias("blocker"))
    return E.consensus(rows, "l_suppkey").select("l_suppkey", F.array_join("hypotheses", ",").alias("hypotheses"), "evidence_count", "consensus")


@query("agg14_category_shares", f"""WITH w AS (SELECT lang, {_WORDS} FROM documents), c AS (SELECT CASE WHEN length(w) <= 3 THEN 'SHORT' WHEN length(w) <= 7 THEN 'MIDDLE' ELSE 'LONG' END AS category, w, count(*) n FROM w GROUP BY 1, 2),
a AS (SELECT category, sum(n)::BIGINT AS tokens, count(*) AS forms FROM c GROUP BY 1) SELECT category, tokens, forms, round(tokens / sum(tokens) OVER (), 9) AS share FROM a""")
def shares(spark, sf_dir):
    n = F.length("w")
    words = _words(table(spark, sf_dir, "documents")).withColumn("category", F.when(n <= 3, "SHORT").when(n <= 7, "MIDDLE").otherwise("LONG"))
    return C.blocker_shares(words, "category", "w").withColumn("share", F.round("share", 9))


def _cases(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    guess = (F.col("n_chars") > 600) & ~F.col("text").contains("|")
    return both.withColumn("expected", F.when(F.col("quality") == 1, "FINAL").otherwise("REVIEW_REQUIRED")).withColumn("outcome", C.classify_case(
        F.col("expected"), F.when(guess, "FINAL").otherwise("REVIEW_REQUIRED"), F.col("toxic") == 0, F.array().cast("array<string>"), F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit(True)))


_CASES = """WITH c AS (SELECT lang, source, quality, CASE WHEN quality = 1 AND g THEN CASE WHEN toxic = 0 THEN 'CORRECT_AUTHORITATIVE' ELSE 'FALSE_AUTHORITATIVE' END WHEN quality = 1 THEN 'OVER_BLOCKED' WHEN g THEN 'UNDER_BLOCKED' ELSE 'CORRECT_REVIEW_REQUIRED' END AS o
FROM (SELECT d.lang, d.source, l.quality, l.toxic, d.n_chars > 600 AND NOT contains(d.text, '|') AS g FROM documents d JOIN labels l USING (doc_id)))"""


@query("agg19_confusion_metrics", _CASES + """ SELECT lang, count(*) AS total, count_if(quality = 1) AS authoritative_cases, count_if(o IN ('CORRECT_AUTHORITATIVE', 'CORRECT_REVIEW_REQUIRED', 'OVER_BLOCKED')) AS safe,
count_if(o = 'CORRECT_AUTHORITATIVE') AS correct_authoritative, count_if(o = 'FALSE_AUTHORITATIVE') AS false_authoritative, count_if(o = 'CORRECT_REVIEW_REQUIRED') AS correct_review_required, 0::BIGINT AS correct_unresolved, count_if(o = 'OVER_BLOCKED') AS over_blocked,
count_if(o = 'UNDER_BLOCKED') AS under_blocked, 0::BIGINT AS issue_type_mismatch, 0::BIGINT AS invalid_gold_case, round(safe / total, 9) AS safe_rate, CASE WHEN authoritative_cases > 0 THEN round(correct_authoritative / authoritative_cases, 9) END AS exact_rate FROM c GROUP BY 1""")  # fmt: skip
def confusion(spark, sf_dir):
    return C.confusion_metrics(_cases(spark, sf_dir), ["lang"], "outcome", F.col("expected") == "FINAL")


@query("agg19_metric_views", _CASES + """ SELECT lang, source, count(*) AS total, count_if(o IN ('CORRECT_AUTHORITATIVE', 'CORRECT_REVIEW_REQUIRED', 'OVER_BLOCKED')) AS safe, count_if(quality = 1) AS authoritative_cases FROM c GROUP BY GROUPING SETS ((), (lang), (source))""")
def views(spark, sf_dir):
    return C.metric_views(_cases(spark, sf_dir), ["lang", "source"], "outcome", F.col("expected") == "FINAL")


@query("agg25_wilson_rates", """WITH r AS (SELECT source, count_if(quality = 1)::DOUBLE AS k, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), z AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM r)
SELECT source, round(p, 9) AS estimate, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS low, round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) AS high FROM z""")
def wilson(spark, sf_dir):
    rates = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    return rates.select("source", C.wilson(F.col("k"), F.col("n")).alias("i")).select("source", *(F.round(f"i.{c}", 9).alias(c) for c in ("estimate", "low", "high")))


@query("agg32_order_readiness", """WITH s AS (SELECT l_orderkey AS record_id, count_if(l_returnflag = 'R') AS issues, bool_or(l_linestatus = 'O') AS open FROM lineitem GROUP BY 1)
SELECT CASE WHEN o_totalprice < 1000 THEN 'INVALID' WHEN coalesce(open, FALSE) OR coalesce(issues, 0) > 0 THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS readiness, count(*) AS n FROM orders LEFT JOIN s ON record_id = o_orderkey GROUP BY 1""")
def order_readiness(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.when(F.col("o_totalprice") >= 1000, "t").alias("title"))
    fields = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("record_id"), F.when(F.col("l_linestatus") == "O", "UNRESOLVED").otherwise("PASSTHROUGH").alias("status"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("issues"))
    return B.readiness(records, fields).groupBy("readiness").agg(F.count("*").alias("n"))


@query("agg34_ordered_render", """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY 1""")
def rendered(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("idx", F.col("turn")).withColumn("piece", F.concat(F.when(F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id")), "").otherwise("\n"), F.col("role"), F.lit(": "), F.col("text")))
    return R.render_documents(rows, "conv_id", "piece")


@query("agg35_split_leakage", """SELECT source, min(s) AS a, max(s) AS b, count(*) AS n FROM (SELECT source, CASE WHEN ('0x' || left(sha256('"phase8c-split-v1:' || doc_id || '"'), 8))::BIGINT % 5 = 0 THEN 'LOCKED' ELSE 'OPEN' END AS s FROM documents) GROUP BY 1 HAVING min(s) <> max(s)""")
def leakage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("split", H.deterministic_split(F.col("doc_id").cast("string")))
    return C.split_leakage(docs, "source", "split")


@query("agg36_zero_filled", """SELECT v AS o_orderstatus, coalesce(n, 0) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) v) LEFT JOIN (SELECT o_orderstatus s, count(*) n FROM orders GROUP BY 1) ON s = v""")
def filled(spark, sf_dir):
    return C.zero_filled(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"], "X")


# Windows, sorts, sets


@query("win5_running_offsets", """SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text))::BIGINT AS start FROM conversations""")
def offsets(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    ordered = S.running(turns, ["conv_id", "turn"], F.col("n").cast("double"))
    first = ordered.groupBy("conv_id").agg(F.min("before").alias("b"))
    return ordered.join(first, "conv_id").select("conv_id", "turn", (F.col("before") - F.col("b")).cast("long").alias("start"))


@query("win6_occurrence_ids", """SELECT o_orderkey, 'record:' || o_orderpriority || ':' || row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS record_id FROM orders""")
def occurrences(spark, sf_dir):
    return S.occurrence_ids(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "record_id")


@query("win9_cumulative_goal", """SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, coalesce(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) WHERE b < 100000""")
def goal(spark, sf_dir):
    return S.select_until(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], F.col("o_custkey").cast("double"), 100000).select("o_orderkey", "o_custkey")


@query("srt10_batches", """SELECT s_suppkey, (row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1) // 40 AS batch FROM supplier""")
def batches(spark, sf_dir):
    return S.batches(table(spark, sf_dir, "supplier"), ["s_acctbal", "s_suppkey"]).select("s_suppkey", "batch")


@query("srt1_hash_ranked_split", """WITH c AS (SELECT doc_id FROM documents ORDER BY sha256('select:' || doc_id), doc_id LIMIT 500), r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('split:' || doc_id), doc_id) k, count(*) OVER () n FROM c)
SELECT doc_id, CASE WHEN k <= round(n * 0.8) THEN 'DIAGNOSTIC' ELSE 'LOCKED_HOLDOUT' END AS split FROM r""")
def ranked_split(spark, sf_dir):
    return S.hash_ranked_split(table(spark, sf_dir, "documents"), "doc_id", 500).select("doc_id", "split")


@query("srt2_deterministic_split", """SELECT doc_id, CASE WHEN ('0x' || left(sha256('"phase8c-split-v1:' || source || '"'), 8))::BIGINT % 5 = 0 THEN 'LOCKED' ELSE 'OPEN' END AS split FROM documents""")
def split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.deterministic_split(F.col("source")).alias("split"))


@query("srt3_sample_per_pool", """SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('audit:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 25""")
def pools(spark, sf_dir):
    return S.sample_per_pool(table(spark, sf_dir, "documents"), "lang", "doc_id", 25, "audit:").select("lang", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("srt5_worklist", f"""SELECT w, n, row_number() OVER (ORDER BY n DESC, w) AS rank FROM (SELECT w, count(*) n FROM (SELECT {_WORDS} FROM documents) GROUP BY 1) ORDER BY n DESC, w LIMIT 100""")
def worklist(spark, sf_dir):
    return C.worklist(_words(table(spark, sf_dir, "documents")), "w").select("w", "n", F.col("rank").cast("long").alias("rank"))


@query("srt8_paged_search", """SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name), '00') AND c_mktsegment NOT IN ('BUILDING') ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50""")
def paged(spark, sf_dir):
    nations = R.small(table(spark, sf_dir, "nation"))
    rows = table(spark, sf_dir, "customer").where(S.search_any(["c_name"], "00") & S.in_or_not("c_mktsegment", ["BUILDING"], True)).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return S.page(rows, [F.desc("c_acctbal"), F.asc("c_custkey")], 3, 25).select("c_custkey", "c_name", "n_name")


@query("set2_first_wins", """SELECT md5(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("h"), "doc_id")
    return S.first_wins(docs, ["h"], ["doc_id"]).join(docs.groupBy("h").agg(F.count("*").alias("copies")), "h")


@query("set6_difference", """(SELECT c_nationkey AS k, 'LEFT' AS side FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)) UNION ALL (SELECT s_nationkey, 'RIGHT' FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer))""")
def difference(spark, sf_dir):
    return V.same_rows(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


# Store, JSON, exports


@query("sto4_record_versions", """WITH v AS (SELECT user_id, event_type AS checksum, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events GROUP BY 1, 2)
SELECT user_id, checksum, epoch_us(first_seen_at) AS first_seen, epoch_us(last_seen_at) AS last_seen, row_number() OVER (PARTITION BY user_id ORDER BY last_seen_at DESC, checksum DESC) = 1 AS is_current FROM v""")
def versions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("checksum"), "ts")
    out = V.record_versions(rows, ["user_id"], "ts")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if dict(out.dtypes)[c] == "timestamp" else F.unix_micros(F.col(c).cast("string").cast("timestamp"))
    return out.select("user_id", "checksum", micros("first_seen_at").alias("first_seen"), micros("last_seen_at").alias("last_seen"), "is_current")


@query("sto8_ledger_projection", """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def ledger(spark, sf_dir):
    basis = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return V.project_ledger(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", basis).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("sto13_conflicting_accepts", """SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS canonicals FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1""")
def accepts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("disposition", F.when(F.col("o_orderstatus") == "F", "ACCEPT"))
    return V.conflicting_accepts(rows, "o_custkey", "o_orderpriority").select("o_custkey", F.array_join("canonicals", ",").alias("canonicals"))


@query("sto10_integrity", """SELECT 'ORDER_WITHOUT_CUSTOMER' AS violation, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'LINE_WITHOUT_ORDER', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'DUPLICATE_LINE', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'DISCOUNT_RANGE', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.05)""")
def integrity(spark, sf_dir):
    orders, lines, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")
    rules = V.violations(lines, [("DISCOUNT_RANGE", F.col("l_discount").between(0, 0.05))], ["l_orderkey", "l_linenumber"])
    return (
        count(V.missing_parents(orders, customers, "o_custkey", "c_custkey"), "ORDER_WITHOUT_CUSTOMER").unionByName(count(V.missing_parents(lines, orders, "l_orderkey", "o_orderkey"), "LINE_WITHOUT_ORDER"))
        .unionByName(count(V.duplicate_keys(lines, ["l_orderkey", "l_linenumber"]), "DUPLICATE_LINE")).unionByName(count(rules, "DISCOUNT_RANGE"))
    )


@query("json_event_props", """SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, max((props->>'$.k')::BIGINT) AS k_max FROM events GROUP BY 1""")
def props(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def _bibliography(spark, sf_dir):
    none = F.lit(None).cast("string")
    part = table(spark, sf_dir, "part")
    records = part.select(
        F.col("p_partkey").cast("string").alias("record_id"), F.when(F.col("p_size") % 2 == 0, "BOOK").otherwise("JOURNAL_ARTICLE").alias("type"), F.col("p_name").alias("title"), F.col("p_type").alias("containerTitle"),
        F.array(F.col("p_brand"), F.lit("A & B")).alias("authors"), F.array().cast("array<string>").alias("editors"), F.array().cast("array<string>").alias("translators"), F.col("p_size").cast("string").alias("year"),
        none.alias("publisher"), none.alias("place"), *(none.alias(c) for c in ("volume", "issue", "doi", "url", "isbn", "issn", "language", "notes")), F.lit("1").alias("pageStart"), F.lit("9").alias("pageEnd"),
    )
    fields = B.long_fields(records).select("record_id", "path", "source_text", F.lit("PASSTHROUGH").alias("status"), F.col("source_text").alias("final_text"), F.lit(0).alias("issues"))
    return records, fields


@query("snk3_ris", """SELECT p_partkey::VARCHAR AS record_id, 'TY  - ' || CASE WHEN p_size % 2 = 0 THEN 'BOOK' ELSE 'JOUR' END || e || 'TI  - ' || p_name || e || 'T2  - ' || p_type || e || 'AU  - ' || p_brand || e || 'AU  - A & B' || e || 'PY  - ' || p_size || e || 'SP  - 1' || e || 'EP  - 9' || e || 'ER  - ' AS block FROM part, (SELECT chr(13) || chr(10) AS e)""")
def ris(spark, sf_dir):
    return B.ris(*_bibliography(spark, sf_dir))


@query("snk4_bibtex", r"""SELECT p_partkey::VARCHAR AS record_id, 'pst_' || p_partkey AS key, '@' || CASE WHEN p_size % 2 = 0 THEN 'book' ELSE 'article' END || '{pst_' || p_partkey || e || '  title = {' || regexp_replace(p_name, '([{}%$&#])', '\\\1', 'g') || '}' || e || '  author = {' || regexp_replace(p_brand, '([{}%$&#])', '\\\1', 'g') || ' and A \& B}' || e
|| CASE WHEN p_size % 2 = 0 THEN '  booktitle = {' ELSE '  journal = {' END || regexp_replace(p_type, '([{}%$&#])', '\\\1', 'g') || '}' || e || '  year = {' || p_size || '}' || e || '  pages = {1--9}' || chr(10) || '}' AS entry, FALSE AS collision FROM part, (SELECT ',' || chr(10) AS e)""")
def bibtex(spark, sf_dir):
    return B.bibtex(*_bibliography(spark, sf_dir))


@query("snk6_csv_cells", """SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM documents""")
def csv_cells(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.csv_cell(F.col("text")).alias("cell"))


@query("json_lines_etl", r"""WITH e AS (SELECT user_id, event_type, ('{"w": "' || event_type || '", "k": ' || (props->>'$.k') || '}') AS j FROM events)
SELECT event_type AS w, count(*) AS observations, count(DISTINCT (j->>'$.k')) AS variants, CASE WHEN count(DISTINCT (j->>'$.k')) > 1 THEN 'CONFLICTING' ELSE 'UNANIMOUS' END AS consensus FROM e GROUP BY 1""")
def etl(spark, sf_dir):
    """Events as dictionary lines: written, read with malformed lines kept, taken apart, grouped."""
    from textloom.shared import shared_path
    from textloom.sources import records

    form = F.struct(F.get_json_object("props", "$.k").alias("form"), F.array(F.lit("romanization")).alias("tags"))
    lines = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_type").alias("word"), F.lit("fa").alias("lang_code"), F.array(form).alias("forms"), F.col("event_id").cast("string").alias("etymology_number"))))
    path = shared_path(spark, "lines")
    lines.write.text(path)
    rows = E.observations(records.dictionary(spark, path).where("_corrupt_record IS NULL")).groupBy(F.col("word").alias("w"), "romanization").agg(F.count("*").alias("n"))
    return rows.groupBy("w").agg(F.sum("n").alias("observations"), F.count("*").alias("variants")).withColumn("consensus", F.when(F.col("variants") > 1, "CONFLICTING").otherwise("UNANIMOUS"))


# Audits


@query("jon25_membership_audit", """WITH k AS (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS f, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS l, c_custkey IN (SELECT user_id FROM events) AS e FROM customer)
SELECT count(*) AS rows, count_if(f) AS finished, count_if(l) AS large, count_if(e) AS active, count_if(NOT (f OR l OR e)) AS outside, round(count_if(NOT (f OR l OR e)) / count(*) * 100, 1) AS outside_percent FROM k""")
def membership(spark, sf_dir):
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    sets = {"finished": orders.where("o_orderstatus = 'F'").select("o_custkey"), "large": orders.where("o_totalprice > 200000").select("o_custkey"), "active": events.select("user_id")}
    return A.membership_audit(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", sets)


@query("agg27_family_duplicates", """WITH k AS (SELECT p_partkey, p_type, 'NAME' AS family, p_name AS k FROM part UNION ALL SELECT p_partkey, p_type, 'BRAND_SIZE', p_brand || ':' || p_size FROM part), f AS (SELECT family, k, min(p_partkey) AS first, arg_min(p_type, p_partkey) AS s FROM k GROUP BY 1, 2)
SELECT p_partkey, first, family FROM k JOIN f USING (family, k) WHERE p_partkey <> first AND p_type = s""")
def families(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return A.family_duplicates(part, "p_partkey", {"NAME": F.col("p_name"), "BRAND_SIZE": F.concat_ws(":", "p_brand", F.col("p_size").cast("string"))}, "p_partkey", "p_type")


@query("agg3_multiplicity", """SELECT CASE WHEN n = 0 THEN 'NONE' WHEN n = 1 THEN 'ONE' ELSE 'MANY' END AS bucket, count(*) AS keys FROM (SELECT o_custkey, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END) n FROM orders GROUP BY 1) GROUP BY 1""")
def multiplicity(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("v"))
    return A.multiplicity(rows, "o_custkey", "v")


@query("agg38_table_counts", """SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lineitem, (SELECT count(*) FROM part) AS part, (SELECT count(*) FROM documents) AS documents""")
def table_counts(spark, sf_dir):
    return A.table_counts({t: table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "documents")})


@query("agg41_field_presence", """SELECT field, present, rows FROM (SELECT count(*) AS rows, count_if(length(text) > 0) AS text, count_if(length(lang) > 0) AS lang, count_if(length(source) > 0) AS source FROM documents) UNPIVOT (present FOR field IN (text, lang, source))""")
def presence(spark, sf_dir):
    return A.field_presence(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query("msc10_intercepted", """WITH b AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'LEXICON_RESOLVED' WHEN o_orderstatus = 'P' THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS s FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'), e AS (SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'LEXICON_RESOLVED' ELSE 'UNRESOLVED' END AS s FROM orders)
SELECT CASE WHEN b.s IS NULL OR e.s IS NULL THEN 'UNALIGNED' WHEN b.s = e.s THEN 'SAME' WHEN e.s = 'LEXICON_RESOLVED' THEN 'GAINED' WHEN b.s = 'LEXICON_RESOLVED' THEN 'LOST' ELSE 'MOVED' END AS change, count(*) AS n FROM b FULL JOIN e USING (o_orderkey) GROUP BY 1""")
def intercepted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "LEXICON_RESOLVED").when(F.col("o_orderstatus") == "P", "AMBIGUOUS").otherwise("UNRESOLVED")
    now = F.when(F.col("o_totalprice") > 150000, "LEXICON_RESOLVED").otherwise("UNRESOLVED")
    return A.intercepted(orders.where("o_orderdate < timestamp '1999-01-01'").select("o_orderkey", status.alias("state")), orders.select("o_orderkey", now.alias("state")), ["o_orderkey"])


# The other modules of queries register themselves.
from textloom.plans import texts, records, files  # noqa: E402, F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
