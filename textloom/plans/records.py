"""Registered queries of the evidence, bibliography, window, store and audit operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import hashing as H
from textloom.operators import ledger, relations, seals
from textloom.operators import audit as A
from textloom.operators import bibliography as B
from textloom.operators import coverage as C
from textloom.operators import evidence as E
from textloom.operators import selection as S
from textloom.operators import store as V
from textloom.plans.catalog import _bibliography, _cases, _CASES, _covered, _COVERED, query
from textloom.plans.texts import _FIRST, _NAME, _part, _TURNS, _turns
from textloom.session import table
from textloom.shared import shared_path

# Joins


@query("jon10_positional_words", _TURNS + " SELECT conv_id, turn, count(*) AS n, count(y) AS aligned FROM (SELECT conv_id, turn, unnest(CASE WHEN len(x) = len(y) AND len(x) > 0 THEN y ELSE [NULL] END) AS y FROM p) GROUP BY 1, 2")
def jon10(spark, sf_dir):
    return E.positional_alignment(_turns(spark, sf_dir), "fa", "roman").groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.count("roman_word").alias("aligned"))


@query("dom10_alignment_batch", _TURNS + " SELECT CASE WHEN len(x) = len(y) THEN 'ELIGIBLE' ELSE 'COUNT_MISMATCH' END AS eligibility, sum(CASE WHEN len(x) = len(y) THEN greatest(len(x), 1) ELSE 1 END)::BIGINT AS segments FROM p GROUP BY 1")
def dom10(spark, sf_dir):
    return E.positional_alignment(_turns(spark, sf_dir), "fa", "roman").groupBy("eligibility").agg(F.count("*").alias("segments"))


def _derived(spark, sf_dir):
    """Documents as evidence, and a child for each: by length a true span, a wrong one, or one without a parent."""
    docs = table(spark, sf_dir, "documents")
    whole = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("evidence_id"), F.lit(None).cast("string").alias("parent_id"), "text", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    k = F.length("text") % 3
    parent = F.concat(F.when(k == 2, "none").otherwise("d"), F.col("doc_id").cast("string"))
    child = docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("evidence_id"), parent.alias("parent_id"), F.when(k == 1, "never so").otherwise(F.substring("text", 3, 5)).alias("text"), F.lit(2).alias("start"), F.lit(7).alias("end"))
    return whole.unionByName(child)


@query("jon11_derivation_breaks", "SELECT 'c' || doc_id AS evidence_id, CASE length(text) % 3 WHEN 1 THEN 'SPAN_MISMATCH' ELSE 'MISSING_PARENT' END AS finding FROM documents WHERE length(text) % 3 > 0")
def jon11(spark, sf_dir):
    return E.derivation_breaks(_derived(spark, sf_dir))


@query("jon12_closure_breaks", """SELECT o_custkey::VARCHAR AS candidate_id, count(*) FILTER (WHERE o_orderstatus = 'O') AS missing, count(*) FILTER (WHERE o_orderstatus = 'P') AS extra FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus <> 'F') > 0""")
def jon12(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("candidate_id"), F.col("o_orderkey").cast("string").alias("evidence_id"), "o_orderstatus")
    stated = rows.where("o_orderstatus <> 'P'").groupBy("candidate_id").agg(F.collect_set("evidence_id").alias("evidence_ids"))
    out = E.closure_breaks(stated, rows.where("o_orderstatus <> 'O'"))
    return out.select("candidate_id", F.size("missing").cast("long").alias("missing"), F.size("extra").cast("long").alias("extra"))


@query("jon13_lexicon_overlap", """SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 'NEW_FORM' WHEN c_nationkey < 15 THEN 'EXACT_MATCH' ELSE 'DIVERGENT' END AS overlap FROM customer""")
def jon13(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    lexicon = table(spark, sf_dir, "nation").where("n_nationkey >= 10").select(F.col("n_name").alias("normalized"), F.array(F.col("n_name"), F.lit("x")).alias("canonicals"))
    forms = customer.select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("normalized"), F.when(F.col("c_nationkey") < 15, F.array(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")))).otherwise(F.array(F.lit("other"))).alias("romanizations"))
    return E.overlap_with_lexicon(forms, lexicon).select("c_custkey", "overlap")


def _marc(spark, sf_dir):
    """Order lines as a record's fields: even places regular, odd ones 880, linked by the half of their number."""
    rows = table(spark, sf_dir, "lineitem")
    half = F.lpad(F.floor((F.col("l_linenumber") + 1) / 2).cast("string"), 2, "0")
    regular = F.col("l_linenumber") % 2 == 0
    return rows.select(F.col("l_orderkey").alias("record_id"), F.when(regular, "245").otherwise("880").alias("tag"), F.concat(F.when(regular, "880-").otherwise("245-"), half).alias("linkage"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("value"))


_MARC = """WITH f AS (SELECT l_orderkey AS r, (l_linenumber + 1) // 2 AS o, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS a, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS b FROM lineitem GROUP BY 1, 2)"""


@query("jon14_linked_fields", _MARC + " SELECT r AS record_id, lpad(o::VARCHAR, 2, '0') AS occurrence, CASE WHEN a > 1 OR b > 1 THEN 'AMBIGUOUS_DUPLICATE' WHEN b = 0 THEN 'UNMATCHED_NONZERO' ELSE 'MATCHED' END AS status FROM f WHERE a > 0")
def jon14(spark, sf_dir):
    return E.linked_fields(_marc(spark, sf_dir)).select("record_id", "occurrence", "status")


@query("dom18_matched_pairs", """WITH f AS (SELECT o_orderkey AS record_id, o_orderstatus AS s FROM orders) SELECT record_id, CASE s WHEN 'F' THEN 'MATCHED' WHEN 'O' THEN 'OCCURRENCE_00' ELSE 'MALFORMED_LINKAGE' END AS status FROM f""")
def dom18(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    regular = orders.select(F.col("o_orderkey").alias("record_id"), F.lit("100").alias("tag"), F.lit("880-01").alias("linkage"), F.col("o_orderpriority").alias("value"))
    code = F.when(F.col("o_orderstatus") == "F", "100-01/(3/r").when(F.col("o_orderstatus") == "O", "100-00").otherwise("one")
    other = orders.select(F.col("o_orderkey").alias("record_id"), F.lit("880").alias("tag"), code.alias("linkage"), F.col("o_orderpriority").alias("value"))
    return E.linked_fields(regular.unionByName(other)).select("record_id", "status")


def _dates(spark, sf_dir):
    """The orders up to 1998 and those from 1995 on: two overlapping cuts that leave no row out."""
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderdate < timestamp '1998-01-01'"), orders.where("o_orderdate >= timestamp '1995-01-01'")


_OLD, _NEW = "o_orderdate < TIMESTAMP '1998-01-01'", "o_orderdate >= TIMESTAMP '1995-01-01'"


@query("jon20_lateral_items", """SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS item FROM orders""")
def jon20(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.array("o_orderstatus", "o_orderpriority")).alias("items"))
    return V.lateral_items(rows, "items", "item")


@query("jon22_latest_decision", """SELECT c_custkey, o_orderkey AS event_id FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def jon22(spark, sf_dir):
    last = V.project_ledger(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("event_id"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")


@query("jon23_guarded_insert", """SELECT o_custkey, max(o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE') GROUP BY 1""")
def jon23(spark, sf_dir):
    basis = table(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("o_custkey"))
    return V.project_ledger(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderkey", basis).select("o_custkey", F.col("o_orderkey").alias("n"))


@query("jon24_manifest_rows", "SELECT o_orderkey, n AS total FROM orders, (SELECT count(*) AS n FROM lineitem)")
def jon24(spark, sf_dir):
    manifest = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("total"))
    return V.with_manifest(table(spark, sf_dir, "orders").select("o_orderkey"), manifest)


@query("jon27_provenance", """WITH r AS (SELECT l_orderkey, l_linenumber, arg_max(l_returnflag, (l_shipdate, l_quantity)) AS f FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS candidate_id, unnest(list_filter([CASE WHEN f IS NULL THEN 'MISSING_RECEIPT' END, CASE WHEN f IS NULL OR f = 'R' THEN 'CONTRADICTED' END], lambda x: x IS NOT NULL)) AS violation FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND l_linenumber = 1""")
def jon27(spark, sf_dir):
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.lit(1).alias("source_index"))
    # The latest receipt stands, an unknown date or quantity being the greatest; of equal ones the first in the table, by file and row. One without a flag verifies nothing.
    greatest = [e for c in ("l_shipdate", "l_quantity") for e in (F.col(c).isNull(), F.col(c))]
    ord_ = F.struct(*greatest, S.descending(F.col("_metadata.file_path")), -F.col("_metadata.row_index")).alias("ord")
    receipts = table(spark, sf_dir, "lineitem").where("l_returnflag IS NOT NULL").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_linenumber").alias("source_index"), ord_, F.col("l_returnflag").alias("verified"))
    return E.provenance_findings(claims, receipts, [("CONTRADICTED", F.col("verified") != "R")]).select("candidate_id", "violation")


@query("jon28_position_join", _COVERED + " SELECT count(*) AS missed_tokens, count(DISTINCT w) AS missed_forms FROM t WHERE NOT covered")
def jon28(spark, sf_dir):
    base = _covered(spark, sf_dir).select("doc_id", "w", "covered")
    return C.miss_recovery(base, base, ["doc_id", "w"], "w").select("missed_tokens", "missed_forms")


# Observations: parts as dictionary entries


def _entries(spark, sf_dir):
    """A part as a dictionary entry: its type tells the tags of its romanisation."""
    tags = F.when(F.col("p_size") < 20, F.array(F.lit("romanization"), F.lit("Iran"))).when(F.col("p_size") < 35, F.array(F.lit("romanization"), F.lit("Dari"))).otherwise(F.array(F.lit("other")))
    none = F.lit(None)
    form = F.struct(F.lower("p_type").alias("form"), tags.alias("tags"), none.cast("string").alias("romanization"))
    link = "array<struct<word:string,extra:string>>"
    sense = F.struct(F.when(F.col("p_size") % 5 == 0, F.array(F.lit("form-of"))).otherwise(F.array(F.lit("x"))).alias("tags"), none.cast(link).alias("form_of"), none.cast(link).alias("alt_of"))
    return _part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("entry_id"), F.col("first").alias("word"), F.col("p_brand").alias("pos"), F.array(form).alias("forms"), F.array(sense).alias("senses"))


_OBS = f"""WITH o AS (SELECT p_partkey::VARCHAR AS entry_id, {_FIRST} AS word, p_brand AS pos, CASE WHEN p_size < 35 THEN lower(p_type) END AS r, CASE WHEN p_size % 5 = 0 THEN 'NON_LEMMA_FORM' ELSE 'LEMMA' END AS lemma FROM part)"""


@query("dom17_observations", _OBS + " SELECT entry_id, word AS normalized, r AS romanization, lemma FROM o")
def dom17(spark, sf_dir):
    return E.observations(_entries(spark, sf_dir)).select("entry_id", "normalized", "romanization", "lemma")


@query("agg1_acquisition", _OBS + " SELECT count(*) AS observations, count(DISTINCT entry_id) AS entries, count(DISTINCT word) AS raw_forms, count(DISTINCT r) AS romanizations FROM o")
def agg1(spark, sf_dir):
    return A.acquisition_summary(E.observations(_entries(spark, sf_dir))).select("observations", "entries", "raw_forms", "romanizations")


@query("agg4_entry_counters", _OBS + " SELECT count(DISTINCT entry_id) AS entries, count(*) AS unique_observations FROM o")
def agg4(spark, sf_dir):
    rows = E.observations(_entries(spark, sf_dir))
    return A.acquisition_summary(rows.unionByName(rows)).select("entries", "unique_observations")


@query("agg11_funnel_duplicates", _OBS + " SELECT 2 * count(*) AS observations, count(*) AS duplicates FROM o")
def agg11(spark, sf_dir):
    rows = E.observations(_entries(spark, sf_dir))
    return A.acquisition_summary(rows.unionByName(rows)).select("observations", "duplicates")


@query("agg11_scale_funnel", """WITH l AS (SELECT l_returnflag AS f, l_linestatus AS s, l_partkey AS p, l_suppkey AS u, l_orderkey AS o, CASE WHEN l_discount > 0.05 THEN l_suppkey END AS d FROM lineitem)
SELECT 'share' AS part, 'flag' AS name, f AS value, count(*) AS n FROM l GROUP BY f UNION ALL SELECT 'share', 'status', s, count(*) FROM l GROUP BY s
UNION ALL SELECT 'distinct', name, unnest(['TOTAL', 'DISTINCT', 'REPEATED', 'SURPLUS']), unnest([sum(n), count(*), count_if(n > 1), sum(n) - count(*)])::BIGINT FROM (SELECT 'part' AS name, p AS k, count(*) AS n FROM l GROUP BY p UNION ALL SELECT 'discounted', d, count(*) FROM l WHERE d IS NOT NULL GROUP BY d) GROUP BY name
UNION ALL SELECT 'variants', name, v::VARCHAR, count(*) FROM (SELECT 'flags_of_order' AS name, o AS k, count(DISTINCT f) AS v FROM l GROUP BY o UNION ALL SELECT 'suppliers_of_part', p, count(DISTINCT d) FROM l GROUP BY p) GROUP BY name, v""")
def agg11_funnel(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    discounted = F.when(F.col("l_discount") > 0.05, F.col("l_suppkey"))
    return A.funnel(line, {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus")}, {"part": F.col("l_partkey"), "discounted": discounted}, {"flags_of_order": (F.col("l_orderkey"), F.col("l_returnflag")), "suppliers_of_part": (F.col("l_partkey"), discounted)})


@query("agg12_diagnostic_index", _OBS + " SELECT word AS normalized, bool_or(r IS NOT NULL) AS romanized, bool_or(lemma = 'LEMMA') AS lemma, count(*) AS n, array_to_string(list_sort(list_distinct(list(pos))), ',') AS parts_of_speech FROM o GROUP BY 1")
def agg12(spark, sf_dir):
    return A.diagnostic_index(E.observations(_entries(spark, sf_dir))).select("normalized", "romanized", "lemma", "n", F.array_join("parts_of_speech", ",").alias("parts_of_speech"))


@query("agg13_surface_shapes", f"SELECT count(*) AS tokens, count_if(p_size < 10) AS joined, count_if(p_size < 10) AS plural, count_if(p_size BETWEEN 10 AND 19) AS plural_izafat, count_if(p_size BETWEEN 20 AND 29) AS possessive FROM part WHERE {_FIRST} IS NOT NULL")
def agg13(spark, sf_dir):
    size = F.col("p_size")
    words = _part(spark, sf_dir).select(F.concat(F.lit("ب"), F.when(size < 10, "‌ها").when(size < 20, "های").when(size < 30, "مان").otherwise("ب")).alias("w"))
    return A.surface_shapes(words, "w").select("tokens", "joined", "plural", "plural_izafat", "possessive")


def _hypotheses(spark, sf_dir):
    """Order lines as interpreted evidence of their order."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("normalized"), F.when(flag != "N", F.lower(flag)).alias("hypothesis"), F.when(flag == "N", F.when(F.col("l_linestatus") == "O", "NO_ROMANIZATION").otherwise("OPEN")).alias("blocker"),
        F.when(F.col("l_linestatus") == "O", "IRANIAN").otherwise("CLASSICAL_DARI").alias("profile"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_linestatus", F.col("l_quantity").cast("string")).alias("evidence_id"))


_HYP = """WITH h AS (SELECT l_orderkey::VARCHAR AS normalized, CASE WHEN l_returnflag <> 'N' THEN lower(l_returnflag) END AS h, l_returnflag = 'N' AND l_linestatus = 'O' AS silent, l_returnflag = 'N' AS blocked, CASE WHEN l_linestatus = 'O' THEN 'IRANIAN' ELSE 'CLASSICAL_DARI' END AS profile FROM lineitem),
g AS (SELECT normalized, count(DISTINCT h) AS k, min(h) AS one, count(*) AS n, count_if(blocked) AS b, count_if(silent) AS s, count(DISTINCT CASE WHEN h IS NOT NULL THEN profile END) AS profiles FROM h GROUP BY 1)"""
_STATUS = "CASE WHEN k > 1 THEN 'CONFLICTING_DETERMINISTIC' WHEN k = 1 AND {failed} = 0 THEN 'UNANIMOUS_DETERMINISTIC' WHEN k = 1 THEN 'PARTIAL' WHEN s = n THEN 'NO_INTERPRETABLE_EVIDENCE' ELSE 'BLOCKED' END"


@query("agg8_lenient_consensus", _HYP + f" SELECT normalized, {_STATUS.format(failed='(b - s)')} AS consensus FROM g")
def agg8(spark, sf_dir):
    return E.consensus(_hypotheses(spark, sf_dir), "normalized", strict=False).select("normalized", "consensus")


@query("agg9_confidence_tiers", _HYP + " SELECT normalized, CASE WHEN profiles > 1 THEN 'CROSS_PROFILE_CONSENSUS' WHEN n >= 2 THEN 'MULTI_OBSERVATION_CONSENSUS' ELSE 'SINGLE_OBSERVATION_DETERMINISTIC' END AS tier FROM g WHERE k = 1 AND b = 0")
def agg9(spark, sf_dir):
    return E.fallback_pack(_hypotheses(spark, sf_dir)).select("normalized", "tier")


@query("agg10_fallback_pack", _HYP + " SELECT normalized, one AS hypothesis, n AS evidence_count FROM g WHERE k = 1 AND b = 0")
def agg10(spark, sf_dir):
    return E.fallback_pack(_hypotheses(spark, sf_dir)).select("normalized", "hypothesis", "evidence_count")


@query("snk9_pack_hashes", """WITH h AS (SELECT l_suppkey::VARCHAR AS normalized, list_sort(list_distinct(list(l_orderkey || '-' || l_linenumber || '-' || l_returnflag))) AS ids FROM lineitem GROUP BY 1)
SELECT normalized, sha256('{"normalized":"' || normalized || '","hypothesis":"h","evidence_ids":["' || array_to_string(ids, '","') || '"]}') AS entry_hash FROM h""")
def snk9(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("normalized"), F.lit("h").alias("hypothesis"), F.lit(None).cast("string").alias("blocker"), F.lit("IRANIAN").alias("profile"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag").alias("evidence_id"))
    return E.fallback_pack(rows).select("normalized", "entry_hash")


@query("agg6_eligible_groups", """SELECT l_partkey, count(*) AS evidence_count, count(DISTINCT l_linestatus) AS schemes FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, l_linestatus FROM lineitem) GROUP BY 1""")
def agg6(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linestatus").alias("scheme"), F.lit("v").alias("value"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_linestatus").alias("ident"))
    return E.candidates(rows.unionByName(rows), "l_partkey", "scheme", "value", "ident").select("l_partkey", "evidence_count", "schemes")


@query("agg29_merged_candidates", """WITH l AS (SELECT o_custkey, o_orderpriority AS value, o_orderstatus AS source, arg_max(CASE WHEN o_totalprice > 100000 THEN 'HIGH' ELSE 'LOW' END, o_orderkey) AS class FROM orders GROUP BY 1, 2, 3),
v AS (SELECT o_custkey, value, count(DISTINCT class) AS k FROM l GROUP BY 1, 2) SELECT o_custkey, count(*)::INT AS variants, bool_or(k > 1) AS conflict FROM v GROUP BY 1""")
def agg29(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("source"), F.when(F.col("o_totalprice") > 100000, "HIGH").otherwise("LOW").alias("class"), F.col("o_orderkey").alias("ord"))
    return E.merged_candidates(rows, "o_custkey").select("o_custkey", F.size("variants").alias("variants"), "conflict")


@query("dom11_scheme_blockers", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'DIGITS' WHEN 'O' THEN '' ELSE 'BRACKETS,MAJHUL_VOWEL' END AS blockers, CASE o_orderstatus WHEN 'F' THEN 'k ' || o_orderkey WHEN 'O' THEN 'ʿilm-yi x' ELSE '[ē]' END AS hypothesis FROM orders""")
def dom11(spark, sf_dir):
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("k "), F.col("o_orderkey").cast("string"))).when(F.col("o_orderstatus") == "O", "ʻilm-ʼi x").otherwise("[ē]")
    return table(spark, sf_dir, "orders").select("o_orderkey", E.interpret_scheme(raw).alias("s")).select("o_orderkey", F.array_join("s.blockers", ",").alias("blockers"), "s.hypothesis")


@query("dom13_interpretation", """SELECT o_orderkey::VARCHAR AS entry_id, CASE WHEN o_orderstatus = 'F' THEN 'NO_ROMANIZATION' WHEN o_orderstatus = 'O' THEN 'NON_LEMMA_SOURCE_FORM' ELSE 'UNCLASSIFIED_PROFILE' END AS blocker, CASE WHEN o_orderstatus = 'F' THEN 'UNSUPPORTED' ELSE 'CONTEXT_REQUIRED' END AS status FROM orders""")
def dom13(spark, sf_dir):
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("entry_id"), F.lit("باد").alias("normalized"), F.when(status != "F", "bād").alias("romanization"), F.when(status == "O", "NON_LEMMA_FORM").otherwise("LEMMA").alias("lemma"), F.lit("UNCLASSIFIED").alias("profile"))
    return E.interpret(rows).select("entry_id", "blocker", "status")


@query("dom19_title_pairs", """SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'LATIN_ONLY' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 1 THEN 'UNCERTAIN_LANGUAGE_OR_PAIRING' WHEN count(*) FILTER (WHERE o_orderstatus <> 'F') = 0 THEN 'PERSIAN_ONLY'
WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 1 THEN 'MULTIPLE_ROMANIZATION_VARIANTS' WHEN count(*) FILTER (WHERE o_orderstatus = 'O') = 1 THEN 'PERSIAN_WITH_OBSERVED_ROMANIZATION' ELSE 'UNCERTAIN_LANGUAGE_OR_PAIRING' END AS state FROM orders GROUP BY 1""")
def dom19(spark, sf_dir):
    titles = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "گل").otherwise("gul").alias("title"), F.when(F.col("o_orderstatus") == "O", "ROMANIZATION").alias("relationship"), F.col("o_orderkey").alias("ord"))
    return A.pair_titles(titles, "o_custkey").select("o_custkey", "state")


@query("dom23_index_search", """SELECT o_orderpriority AS normalized, count(*) AS n, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'REVIEWED' WHEN bool_or(o_orderstatus = 'F') THEN 'PARTLY_REVIEWED' ELSE 'UNREVIEWED' END AS status FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1""")
def dom23(spark, sf_dir):
    return E.search_index(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("normalized"), (F.col("o_orderstatus") == "F").alias("reviewed")), "1-URGENT")


@query("msc4_policy_audit", """SELECT p_partkey AS letter, CASE WHEN p_size < 10 THEN 'NOT_COMPARABLE' WHEN p_size < 30 THEN 'MATCH' ELSE 'MISMATCH' END AS outcome FROM part""")
def msc4(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    runtime = part.where("p_size >= 10").select(F.col("p_partkey").alias("letter"), F.when(F.col("p_size") < 30, F.col("p_brand")).otherwise(F.col("p_type")).alias("rendering"))
    return E.policy_audit(part.select(F.col("p_partkey").alias("letter"), F.col("p_brand").alias("rendering")), runtime).select("letter", "outcome")


# Coverage and metrics


@query("agg15_cohort_metrics", _COVERED + " SELECT lang, count(*) AS tokens, count_if(covered) AS covered_tokens FROM t JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY 1")
def agg15(spark, sf_dir):
    """The language comes with a document's words, so that they need not meet their documents again."""
    return C.token_coverage(_covered(spark, sf_dir, "lang"), ["lang"], "w", "covered", "doc_id").select("lang", "tokens", "covered_tokens")


_SPLIT = "CASE WHEN ('0x' || left(sha256('\"phase8c-split-v1:' || doc_id || '\"'), 8))::BIGINT % 5 = 0 THEN 'LOCKED' ELSE 'OPEN' END"


@query("agg18_split_metrics", _COVERED + f" SELECT split, count(*) AS tokens, count_if(covered) AS covered_tokens, count(DISTINCT doc_id) AS cases FROM (SELECT *, {_SPLIT} AS split FROM t) GROUP BY 1")
def agg18(spark, sf_dir):
    rows = _covered(spark, sf_dir).withColumn("split", H.deterministic_split(F.col("doc_id").cast("string")))
    return C.token_coverage(rows, ["split"], "w", "covered", "doc_id").select("split", "tokens", "covered_tokens", "cases")


@query("agg20_combined_metrics", _CASES + " SELECT count(*) AS total, count_if(quality = 1) AS authoritative_cases, count_if(o = 'CORRECT_AUTHORITATIVE') AS correct_authoritative FROM c")
def agg20(spark, sf_dir):
    return C.confusion_metrics(_cases(spark, sf_dir), [], "outcome", F.col("expected") == "FINAL").select("total", "authoritative_cases", "correct_authoritative")


@query("agg21_case_classes", _CASES + " SELECT o AS outcome, count(*) AS n FROM c GROUP BY 1")
def agg21(spark, sf_dir):
    return _cases(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query("agg22_expected_fields", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'MISSING' WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_totalprice < 50000 THEN 'OVER_BLOCKED' WHEN o_orderstatus = 'F' THEN 'CORRECT' ELSE 'FALSE' END WHEN o_totalprice >= 50000 THEN 'UNDER_BLOCKED' ELSE 'CORRECT' END AS outcome FROM orders""")
def agg22(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    expected = orders.select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "FINAL").otherwise("REVIEW").alias("expected_state"), F.lit("F").alias("expected_text"))
    actual = orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.when(F.col("o_totalprice") >= 50000, "FINAL").otherwise("REVIEW").alias("actual_state"), F.col("o_orderstatus").alias("actual_text"))
    return A.expected_fields(expected, actual, ["o_orderkey"]).select("o_orderkey", "outcome")


@query("agg23_gates", "SELECT 'finished' AS gate, count_if(o_orderstatus = 'F') / count(*) >= 0.2 AS met FROM orders UNION ALL SELECT 'cheap', count_if(o_totalprice < 1000) / count(*) >= 0.9 FROM orders")
def agg23(spark, sf_dir):
    m = table(spark, sf_dir, "orders").agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("finished"), (F.count_if(F.col("o_totalprice") < 1000) / F.count("*")).alias("cheap"))
    return C.release_gate(m, {"finished": 0.2, "cheap": 0.9}).select("gate", "met")


@query("agg26_category_counts", "SELECT v AS source, coalesce(n, 0) AS n FROM (SELECT DISTINCT source AS v FROM documents UNION ALL SELECT 'none such') LEFT JOIN (SELECT source AS s, count(*) AS n FROM documents GROUP BY 1) ON s = v")
def agg26(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = sorted(r[0] for r in docs.select("source").distinct().where("source IS NOT NULL").collect())
    return C.zero_filled(docs.where("source IS NOT NULL"), "source", [*known, "none such"])


@query("agg28_quality_summary", "SELECT field, present FROM (SELECT count(url) FILTER (WHERE url <> '') AS url, count(html) FILTER (WHERE html <> '') AS html FROM pages) UNPIVOT (present FOR field IN (url, html))")
def agg28(spark, sf_dir):
    return A.field_presence(table(spark, sf_dir, "pages"), ["url", "html"]).select("field", "present")


@query("agg30_duplicate_ids", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def agg30(spark, sf_dir):
    return V.duplicate_keys(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("agg31_batch_summary", """WITH r AS (SELECT CASE WHEN p_partkey % 97 = 0 THEN 'same' ELSE p_partkey::VARCHAR END AS id, p_size % 9 = 0 AS untitled, p_retailprice > 1500 OR p_size % 4 = 1 AS open FROM part),
g AS (SELECT id, count(*) AS n, bool_or(open) AS open FROM r GROUP BY 1), s AS (SELECT CASE WHEN g.n > 1 OR untitled THEN 'I' WHEN g.open THEN 'Q' ELSE 'R' END AS s FROM r JOIN g USING (id))
SELECT count(*) AS total, count_if(s = 'R') AS ready, count_if(s = 'Q') AS review_required, count_if(s = 'I') AS invalid FROM s""")
def agg31(spark, sf_dir):
    """Parts as records: some share an id, some have no title, some have a field with issues or an open one."""
    records, _ = _bibliography(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("record_id"), "p_partkey", "p_size", "p_retailprice")
    joined = records.join(part, "record_id").withColumn("title", F.when(F.col("p_size") % 9 != 0, F.col("title"))).withColumn("record_id", F.when(F.col("p_partkey") % 97 == 0, "same").otherwise(F.col("record_id")))
    fields = joined.select("record_id", F.when(F.col("p_size") % 4 == 1, "UNRESOLVED").otherwise("LEXICON_RESOLVED").alias("status"), (F.col("p_retailprice") > 1500).cast("int").alias("issues"))
    return B.batch_summary(B.readiness(joined.drop("p_partkey", "p_size", "p_retailprice"), fields))


@query("agg37_json_lists", """SELECT l_orderkey, '[' || string_agg('{"n":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS lines FROM lineitem GROUP BY 1""")
def agg37(spark, sf_dir):
    return A.ordered_json(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part")), "l_orderkey", ["n", "part"]).withColumnRenamed("items", "lines")


@query("agg39_pilot_metrics", _MARC.replace("(l_linenumber + 1) // 2", "l_linenumber // 2 + 1") + " SELECT CASE WHEN a > 1 OR b > 1 THEN 'AMBIGUOUS_DUPLICATE' WHEN b = 0 THEN 'UNMATCHED_NONZERO' ELSE 'MATCHED' END AS status, count(*) AS fields, count(DISTINCT r) AS records FROM f WHERE a > 0 GROUP BY 1")
def agg39(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    pair = F.lpad((F.floor(F.col("l_linenumber") / 2) + 1).cast("string"), 2, "0")
    regular = F.col("l_linenumber") % 2 == 0
    fields = rows.select(F.col("l_orderkey").alias("record_id"), F.when(regular, "245").otherwise("880").alias("tag"), F.concat(F.when(regular, "880-").otherwise("245-"), pair).alias("linkage"), F.col("l_returnflag").alias("value"))
    return A.pilot_metrics(E.linked_fields(fields))


@query("agg40_interpretation_report", _HYP + f" SELECT {_STATUS.format(failed='b')} AS consensus, count(*) AS forms, sum(n)::BIGINT AS evidence FROM g GROUP BY 1")
def agg40(spark, sf_dir):
    return A.interpretation_report(E.consensus(_hypotheses(spark, sf_dir), "normalized"))


@query("agg40_reviewed_agreement", """WITH f AS (SELECT o_custkey AS n, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS h, count(*) AS e FROM orders GROUP BY 1), l AS (SELECT c_custkey AS n, c_nationkey FROM customer WHERE c_nationkey < 12),
r AS (SELECT CASE WHEN l.n IS NULL THEN 'NOT_REVIEWED' WHEN h IS NULL THEN 'NO_HYPOTHESIS' WHEN h = 'F' OR h = 'O' AND c_nationkey % 2 = 0 THEN 'AGREES' ELSE 'DISAGREES' END AS outcome, e FROM f LEFT JOIN l USING (n)),
g AS (SELECT outcome, count(*) AS forms, sum(e)::BIGINT AS evidence FROM r GROUP BY 1) SELECT outcome, forms, evidence, CASE WHEN outcome IN ('AGREES', 'DISAGREES') THEN round(forms / sum(forms) FILTER (WHERE outcome IN ('AGREES', 'DISAGREES')) OVER (), 6) END AS share FROM g""")
def agg40_agreement(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_nationkey < 12")
    forms = orders.groupBy(F.col("o_custkey").alias("normalized")).agg(F.when(F.min("o_orderstatus") == F.max("o_orderstatus"), F.min("o_orderstatus")).alias("hypothesis"), F.count("*").alias("evidence_count"))
    return A.reviewed_agreement(forms, customer.select(F.col("c_custkey").alias("normalized"), F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("F"), F.lit("O"))).otherwise(F.array(F.lit("F"))).alias("canonicals")))


@query("agg41_nested_fields", """WITH l AS (SELECT l_orderkey AS o, l_quantity > 25 AS tagged, l_discount > 0.05 AS noted FROM lineitem), g AS (SELECT o_orderkey AS o, o_orderstatus = 'P' AS bare, count(l.o) AS n, count_if(tagged) AS t, count_if(noted) AS d FROM orders LEFT JOIN l ON l.o = o_orderkey GROUP BY 1, 2)
SELECT unnest(['id', 'who', 'who.name', 'lines', 'lines[]', 'lines[].tags', 'lines[].tags[]', 'lines[].note']) AS path,
unnest([count(*), count_if(NOT bare), count_if(NOT bare), count_if(n > 0), count_if(n > 0), count_if(t > 0), count_if(t > 0), count_if(d > 0)]) AS rows,
unnest([count(*), count(*), count(*), count(*), sum(n), sum(n), 2 * sum(t), sum(n)])::BIGINT AS places, unnest([count(*), count_if(NOT bare), count_if(NOT bare), count_if(n > 0), sum(n), sum(t), 2 * sum(t), sum(d)])::BIGINT AS present FROM g""")
def agg41_nested(spark, sf_dir):
    """Orders with their lines: a struct that may be null, and arrays of structs with arrays and empty texts."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tags = F.when(F.col("l_quantity") > 25, F.array("l_returnflag", "l_linestatus")).otherwise(F.array().cast("array<string>"))
    lines = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(tags.alias("tags"), F.when(F.col("l_discount") > 0.05, "x").otherwise("").alias("note"))).alias("lines"))
    who = F.when(F.col("o_orderstatus") != "P", F.struct(F.col("o_orderpriority").alias("name")))
    return A.observability(orders.join(lines, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), who.alias("who"), "lines"))


@query("agg42_dominant_category", """SELECT c_mktsegment AS category, n AS tokens FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) ORDER BY n DESC, category LIMIT 1""")
def agg42(spark, sf_dir):
    counts = C.blocker_shares(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_name").alias("form")), "category", "form")
    return C.dominant(counts, "category", "tokens")


# Windows, sorts and sets


@query("win1_latest_rows", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def win1(spark, sf_dir):
    return S.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("win2_superseded", """SELECT a.o_orderkey::VARCHAR AS event_id, 'SUPERSEDED' AS finding FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey > a.o_orderkey)""")
def win2(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderkey").alias("decided_at"), F.lit("b").alias("basis_sha256"))
    candidates = events.select("candidate_id", "basis_sha256").distinct()
    return A.verify_sources(events.select("candidate_id", "event_id"), events, candidates).select("event_id", "finding")


@query("win3_first_status", "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def win3(spark, sf_dir):
    return S.latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"]).select("user_id", F.col("event_type").alias("status"))


@query("win5_running_lengths", """SELECT doc_id, (sum(n_chars) OVER (ORDER BY doc_id) - n_chars)::BIGINT AS start FROM documents""")
def win5(spark, sf_dir):
    return S.running(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], F.col("n_chars").cast("double")).select("doc_id", F.col("before").cast("long").alias("start"))


@query("win7_ranks", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank FROM customer")
def win7(spark, sf_dir):
    return S.running(table(spark, sf_dir, "customer"), ["c_acctbal", "c_custkey"]).select("c_custkey", "rank")


@query("win10_shares", "SELECT event_type, n, round(n / sum(n) OVER (), 9) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def win10(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return S.with_share(counts, "n").withColumn("share", F.round("share", 9))


@query("srt4_salted_pilot", "SELECT doc_id, row_number() OVER (ORDER BY sha256('pilot:' || doc_id), doc_id) AS rank FROM documents QUALIFY rank <= 100")
def srt4(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").select("doc_id", F.lit("all").alias("pool"))
    return S.sample_per_pool(pool, "pool", "doc_id", 100, "pilot:").select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("srt7_deterministic_order", "SELECT o_orderpriority, o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS place FROM orders")
def srt7(spark, sf_dir):
    return S.running(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderkey"]).select("o_orderpriority", "o_orderkey", F.col("rank").alias("place"))


@query("srt9_bounded_retrieval", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def srt9(spark, sf_dir):
    return V.bounded(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100).select("o_orderkey")


@query("srt11_valid_range", "SELECT entry_id FROM (SELECT o_orderkey::VARCHAR AS entry_id, row_number() OVER (ORDER BY o_orderkey::VARCHAR) AS k FROM orders WHERE o_orderstatus <> 'P') WHERE k BETWEEN 11 AND 60")
def srt11(spark, sf_dir):
    from textloom.sources import records

    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("entry_id"), F.when(F.col("o_orderstatus") == "P", "NOT_PERSIAN").alias("reason"))
    return records.valid_range(entries, 10, 50).select("entry_id")


@query("set1_last_wins", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def set1(spark, sf_dir):
    return S.last_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("set3_union_retained", f"WITH n AS (SELECT DISTINCT o_custkey FROM orders WHERE {_NEW}) SELECT o_orderkey FROM orders WHERE {_NEW} UNION ALL SELECT o_orderkey FROM orders WHERE {_OLD} AND o_custkey NOT IN (SELECT o_custkey FROM n)")
def set3(spark, sf_dir):
    return V.retain(*_dates(spark, sf_dir), ["o_custkey"]).select("o_orderkey")


@query("set4_conflict_free_union", """WITH a AS (SELECT l_partkey AS k, max(l_returnflag) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_partkey AS k, max(l_returnflag) AS v FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 1)
SELECT k, coalesce(a.v, b.v) AS v FROM a FULL JOIN b USING (k) WHERE a.v IS NULL OR b.v IS NULL OR a.v = b.v""")
def set4(spark, sf_dir):
    side = lambda test: table(spark, sf_dir, "lineitem").where(test).groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_returnflag").alias("v"))
    return E.pack_union(side("l_linestatus = 'O'"), side("l_linestatus <> 'O'"), "k", "v").where("action <> 'CONFLICT'").select("k", "v")


@query("set5_upsert", f"SELECT o_orderkey, CASE WHEN {_NEW} THEN 'new' ELSE 'old' END AS side FROM orders")
def set5(spark, sf_dir):
    old, new = _dates(spark, sf_dir)
    return V.upsert(old.select("o_orderkey", F.lit("old").alias("side")), new.select("o_orderkey", F.lit("new").alias("side")), ["o_orderkey"])


# Store


@query("sto1_composed_snapshot", f"SELECT count(*) AS candidate_count FROM orders WHERE {_OLD} OR {_NEW}")
def sto1(spark, sf_dir):
    old, new = (df.withColumn("h", F.sha2("o_orderpriority", 256)) for df in _dates(spark, sf_dir))
    return V.build_snapshot(V.retain(old, new, ["o_orderkey"]), "s2", ["o_orderkey"], "h").select("candidate_count")


@query("sto2_memory_store", f"SELECT o_orderkey FROM orders WHERE {_OLD} OR {_NEW}")
def sto2(spark, sf_dir):
    old, new = (df.withColumn("h", F.sha2("o_orderpriority", 256)) for df in _dates(spark, sf_dir))
    store = V.MemoryStore()
    store.publish(old, "s1", ["o_orderkey"], "h", ["o_orderkey"])
    store.publish(new, "s2", ["o_orderkey"], "h", ["o_orderkey"], expected="s1")
    return store.active().select("o_orderkey")


@query("sto3_manifest", r"""WITH l AS (SELECT o_orderkey::VARCHAR || chr(0) || sha256(o_orderpriority) AS line FROM orders), b AS (SELECT left(sha256(line), 3) AS b, sha256(left(sha256(line), 3) || chr(10) || string_agg(line, chr(10) ORDER BY line)) AS h, count(*) AS n FROM l GROUP BY 1)
SELECT 's1' AS snapshot_id, sum(n)::BIGINT AS candidate_count, sha256('s1' || chr(10) || string_agg(b || ':' || h, chr(10) ORDER BY b || ':' || h)) AS manifest_checksum FROM b""".replace("GROUP BY 1)", "GROUP BY left(sha256(line), 3))"))
def sto3(spark, sf_dir):
    return V.build_snapshot(table(spark, sf_dir, "orders").withColumn("h", F.sha2("o_orderpriority", 256)), "s1", ["o_orderkey"], "h")


@query("msc8_authority_manifest", "SELECT count(*) AS candidate_count FROM part")
def msc8(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("h", F.sha2("p_brand", 256))
    manifest = V.build_snapshot(rows, "a1", ["p_partkey"], "h")
    broken = V.verify_snapshot(rows, manifest, ["p_partkey"], "h").agg(F.count("*").alias("_bad"))
    return manifest.crossJoin(F.broadcast(broken)).where("_bad = 0").select("candidate_count")


@query("sto6_publication_state", """SELECT o_custkey FROM orders GROUP BY 1 HAVING arg_max(o_orderstatus, o_orderkey) IN ('F', 'P')""")
def sto6(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "PUBLISH").when(F.col("o_orderstatus") == "P", "ROLLBACK").otherwise("WITHDRAW")
    return V.authority_fold(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", kind.alias("event_kind")), "o_custkey", "o_orderkey").select("o_custkey")


@query("sto6_publication_findings", """WITH e AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'PUBLISH' WHEN 'P' THEN 'ROLLBACK' ELSE 'WITHDRAW' END AS k FROM orders), l AS (SELECT *, lag(k) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM e)
SELECT o_orderkey, CASE WHEN k = 'PUBLISH' THEN 'ALREADY_PUBLISHED' WHEN k = 'WITHDRAW' THEN 'NOT_PUBLISHED' ELSE 'NOTHING_TO_ROLL_BACK' END AS finding FROM l WHERE k = 'PUBLISH' AND b IN ('PUBLISH', 'ROLLBACK') OR k = 'WITHDRAW' AND (b IS NULL OR b = 'WITHDRAW') OR k = 'ROLLBACK' AND b IS NULL""")
def sto6_findings(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "PUBLISH").when(F.col("o_orderstatus") == "P", "ROLLBACK").otherwise("WITHDRAW")
    return V.publication_findings(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", kind.alias("event_kind")), "o_custkey", "o_orderkey").select("o_orderkey", "finding")


@query("sto7_source_verification", """SELECT o_orderkey::VARCHAR AS event_id, CASE WHEN o_orderkey <> m THEN 'SUPERSEDED' ELSE 'BASIS_CHANGED' END AS finding FROM orders JOIN (SELECT o_custkey AS c, max(o_orderkey) AS m FROM orders GROUP BY 1) ON c = o_custkey WHERE o_orderkey <> m OR o_orderstatus = 'P'""")
def sto7(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderkey").alias("decided_at"), F.when(F.col("o_orderstatus") == "P", "stale").otherwise("now").alias("basis_sha256"))
    return A.verify_sources(events.select("candidate_id", "event_id"), events, events.select("candidate_id", F.lit("now").alias("basis_sha256")).distinct()).select("event_id", "finding")


@query("sto9_immutability", f"SELECT o_orderkey, CASE WHEN {_NEW} THEN 'UPDATED' ELSE 'DELETED' END AS finding FROM orders WHERE {_OLD} AND (o_orderstatus = 'P' OR NOT {_NEW})")
def sto9(spark, sf_dir):
    old, new = _dates(spark, sf_dir)
    changed = new.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.col("o_orderstatus")))
    return V.immutable_breaks(old, changed, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("sto11_evidence_insert", f"SELECT o_orderkey, CASE WHEN NOT {_OLD} THEN 'INSERT' WHEN o_orderstatus = 'P' THEN 'VIOLATION' ELSE 'IDEMPOTENT' END AS outcome FROM orders WHERE {_NEW}")
def sto11(spark, sf_dir):
    old, new = _dates(spark, sf_dir)
    stored = old.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", None).otherwise(F.col("o_orderstatus")).alias("content"))
    coming = new.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "other").when(F.col("o_orderstatus") == "F", "F").alias("content"))
    return V.insert_evidence(stored, coming, "o_orderkey", "content").select("o_orderkey", "outcome")


@query("sto12_promotion_plan", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'CREATE_ENTRY' WHEN o_orderpriority = '1-URGENT' THEN 'ALREADY_PRESENT' ELSE 'ADD_READING' END AS action FROM orders""")
def sto12(spark, sf_dir):
    accepted = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("normalized"), F.col("o_orderpriority").alias("canonical"))
    lexicon = spark.createDataFrame([("F", ["1-URGENT", "x"]), ("O", ["1-URGENT"])], "normalized string, canonicals array<string>")
    return V.promotion_plan(accepted, lexicon).select("o_orderkey", "action")


@query("msc6_category_mapping", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'proper-noun' WHEN '2-HIGH' THEN 'noun' ELSE 'unmapped' END AS category FROM orders")
def msc6(spark, sf_dir):
    kinds = F.when(F.col("o_orderpriority") == "1-URGENT", "PERSON").when(F.col("o_orderpriority") == "2-HIGH", "WORD").otherwise("THING")
    return table(spark, sf_dir, "orders").select("o_orderkey", A.entity_category(kinds).alias("category"))


@query("sto14_package_verify", """SELECT 'p/' || p_partkey AS path, CASE WHEN p_size < 5 THEN 'MISSING' WHEN p_size < 10 THEN 'EXTRA' ELSE 'CHANGED' END AS finding FROM part WHERE p_size < 15""")
def sto14(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("p/"), F.col("p_partkey").cast("string")))
    files = part.where("p_size >= 5").select("path", F.when(F.col("p_size") < 15, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).cast("binary").alias("content"))
    manifest = part.where("p_size < 5 OR p_size >= 10").select("path", F.sha2("p_name", 256).alias("sha256"))
    return A.verify_package(files, manifest)


def _requests(spark, sf_dir):
    """Orders as requests to decide on their customer's reading; customers as packets; some requests are stale, incomplete or come twice."""
    orders, key, status = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderstatus")
    text = lambda c: F.col(c).cast("string")
    customers = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    packets = customers.select(text("o_custkey").alias("candidate_id"), F.concat(F.lit("p"), text("o_custkey")).alias("packet_id"), F.concat(F.lit("b"), text("o_custkey")).alias("basis"), F.concat(F.lit("n"), (F.col("o_custkey") % 300).cast("string")).alias("normalized"), F.array(F.lit("h1"), F.lit("h2")).alias("hypotheses"))
    accepted = status != "P"
    made = orders.select(
        key.cast("long").alias("seq"), F.concat(F.when(key % 17 == 0, "old").otherwise("p"), text("o_custkey")).alias("packet_id"), F.concat(F.lit("b"), text("o_custkey")).alias("basis"), text("o_custkey").alias("candidate_id"),
        F.when(accepted, "ACCEPT").otherwise("DEFER").alias("disposition"), F.when(accepted | (key % 5 == 0), "SELECT_SCHEME_HYPOTHESIS").alias("kind"), F.when(accepted, F.when(key % 7 == 0, "h3").when(F.col("o_custkey") % 2 == 0, "h1").otherwise(F.concat(F.lit("h"), (key % 2 + 1).cast("string")))).alias("canonical"),
        F.when(key % 19 == 0, " ").otherwise(F.col("o_orderpriority")).alias("reviewer"), F.when(key % 23 == 0, "other").otherwise("r").alias("rationale"), F.year("o_orderdate").cast("string").alias("decided_at"))
    return made, packets, spark.createDataFrame([], "decision_id string, packet_id string, basis string, candidate_id string, normalized string, disposition string, kind string, canonical string, reviewer string, rationale string, decided_at string")


_REQUESTED = """WITH q AS (SELECT o_orderkey AS seq, o_custkey AS c, o_orderstatus <> 'P' AS ok, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'h3' WHEN o_custkey % 2 = 0 THEN 'h1' ELSE 'h' || (o_orderkey % 2 + 1) END END AS canonical, o_orderpriority AS reviewer, CASE WHEN o_orderkey % 23 = 0 THEN 'other' ELSE 'r' END AS rationale, year(o_orderdate) AS y, o_orderkey FROM orders),
j AS (SELECT *, CASE WHEN o_orderkey % 19 = 0 THEN 'MISSING_REVIEWER' WHEN o_orderkey % 17 = 0 THEN 'STALE_PACKET' WHEN NOT ok AND o_orderkey % 5 = 0 THEN 'SELECTION_NOT_ALLOWED' WHEN canonical = 'h3' THEN 'NOT_A_HYPOTHESIS' END AS reason FROM q),
f AS (SELECT c, reviewer, ok, canonical, y, min(seq) AS first, arg_min(rationale, seq) AS stood FROM j WHERE reason IS NULL GROUP BY ALL),
d AS (SELECT j.*, CASE WHEN reason IS NOT NULL THEN 'REFUSED' WHEN seq = first THEN 'RECORDED' WHEN rationale = stood THEN 'IDEMPOTENT' ELSE 'VIOLATION' END AS outcome FROM j LEFT JOIN f ON reason IS NULL AND f.c = j.c AND f.reviewer = j.reviewer AND f.ok = j.ok AND f.canonical IS NOT DISTINCT FROM j.canonical AND f.y = j.y)"""


@query("sto12_ledger_outcomes", f"{_REQUESTED} SELECT seq, outcome, reason FROM d")
def sto12_ledger(spark, sf_dir):
    made, packets, empty = _requests(spark, sf_dir)
    return ledger.record_decisions(empty, made, packets)[1].select("seq", "outcome", "reason")


@query("sto12_promotions", f"""{_REQUESTED}, a AS (SELECT c, c % 300 AS n, canonical, y FROM d WHERE outcome = 'RECORDED' AND ok), t AS (SELECT c FROM a GROUP BY 1 HAVING min(canonical) <> max(canonical)),
p AS (SELECT n, canonical FROM a WHERE c NOT IN (SELECT c FROM t)), g AS (SELECT n, count(*) AS promoted, list_sort(list_distinct(list(canonical))) AS new FROM p GROUP BY 1)
SELECT 'n' || n AS normalized, promoted, len(list_filter(new, lambda x: n % 3 > 0 OR x <> 'h1'))::BIGINT AS added, array_to_string(list_sort(list_distinct(list_concat(new, CASE WHEN n % 3 = 0 THEN ['h1'] ELSE [] END))), ',') AS canonicals FROM g""")
def sto12_promotions(spark, sf_dir):
    """A third of the forms are in the lexicon with one reading; what is promoted, what that adds, and the readings after it."""
    made, packets, empty = _requests(spark, sf_dir)
    decided = ledger.record_decisions(empty, made, packets)[0]
    lexicon = spark.range(0, 300, 3).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("normalized"), F.array(F.lit("h1")).alias("canonicals"))
    receipts, after = ledger.promote(decided, spark.createDataFrame([], "decision_id string"), lexicon, "me", "2024")
    told = receipts.groupBy("normalized").agg(F.count("*").alias("promoted"), F.count_if(F.col("action") != "ALREADY_PRESENT").alias("added"))
    return told.join(after, "normalized").select("normalized", "promoted", "added", F.array_join("canonicals", ",").alias("canonicals"))


@query("sto14_located_changes", """SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 0 THEN 'MISSING' WHEN o_orderkey % 991 = 1 THEN 'ADDED' ELSE 'CHANGED' END AS finding, CASE WHEN o_orderkey % 997 <> 0 AND o_orderkey % 991 <> 1 THEN CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'X' THEN 'o_orderstatus' ELSE 'o_totalprice' END END AS fields
FROM orders WHERE NOT (o_orderkey % 997 = 0 AND o_orderkey % 991 = 1) AND (o_orderkey % 997 = 0 OR o_orderkey % 991 = 1 OR o_orderkey % 983 = 2)""")
def sto14_located(spark, sf_dir):
    """Two sealed packages; of the second a few rows are gone, new or other."""
    orders, key = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    hit = key % 983 == 2
    other = orders.where(key % 997 != 0).withColumns({"o_orderstatus": F.when(hit & (key % 2 == 0), "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(hit & (key % 2 != 0), -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))})
    before, after = shared_path(spark, "sealed"), shared_path(spark, "sealed")
    seals.seal(orders.where(key % 991 != 1), before, ["o_orderkey"])
    seals.seal(other, after, ["o_orderkey"])
    return seals.located(spark, before, after, ["o_orderkey"]).select("o_orderkey", "finding", F.array_join("fields", ",").alias("fields"))


@query("sto15_consolidation_equality", f"SELECT o_orderkey, 'LEFT' AS side FROM orders WHERE {_OLD} AND NOT {_NEW} UNION ALL SELECT o_orderkey, 'RIGHT' FROM orders WHERE {_NEW} AND NOT {_OLD}")
def sto15(spark, sf_dir):
    old, new = _dates(spark, sf_dir)
    return V.same_rows(old.select("o_orderkey"), new.select("o_orderkey"))


@query("sto16_lexicon_integrity", "SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def sto16(spark, sf_dir):
    return V.duplicate_keys(table(spark, sf_dir, "part"), ["p_name", "p_brand"])


@query("sto5_snapshot_verify", "SELECT 's1' AS snapshot_id")
def sto5(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("h", F.sha2("o_orderpriority", 256))
    manifest = V.build_snapshot(rows, "s1", ["o_orderkey"], "h")
    return V.verify_snapshot(rows.where("o_orderstatus <> 'P'"), manifest, ["o_orderkey"], "h").select("snapshot_id")


# Exports and audits


@query("snk1_review_lines", """SELECT p_partkey::VARCHAR AS record_id, p_name || ',' || chr(34) || p_brand || ',' || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) || ',' || p_partkey || ',READY,0,' AS line FROM part""")
def snk1(spark, sf_dir):
    processed = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("record_id"), F.array("p_name", F.concat("p_brand", F.lit(',"x"'))).alias("cells"), F.lit("READY").alias("readiness"), F.lit(0).alias("review_issues"), F.array().cast("array<string>").alias("invalid_reasons"))
    return B.review_csv(processed)


def _passing(spark, sf_dir):
    records, fields = _bibliography(spark, sf_dir)
    return records.withColumn("passthrough", F.create_map(F.lit("z"), F.col("year"), F.lit("b"), F.lit("x,y"))), fields


@query("snk2_final_lines", """SELECT p_partkey::VARCHAR AS record_id, p_name || ',' || p_brand || ' | A & B,' || p_size || ',"x,y",' || p_size AS line FROM part""")
def snk2(spark, sf_dir):
    records, fields = _passing(spark, sf_dir)
    return B.final_csv(records, fields, ["title", "authors", "year"])


@query("snk5_export_findings", """SELECT p_partkey::VARCHAR AS record_id, 'title' AS path, CASE WHEN p_size < 10 THEN 'NOT_AUTHORITATIVE' WHEN p_size < 20 THEN 'EMPTY_FINAL_TEXT' ELSE 'PLACEHOLDER' END AS finding FROM part WHERE p_size < 30""")
def snk5(spark, sf_dir):
    records, fields = _bibliography(spark, sf_dir)
    sized = fields.join(records.select("record_id", F.col("year").cast("int").alias("y")), "record_id")
    title = F.col("path") == "title"
    broken = sized.withColumn("status", F.when(title & (F.col("y") < 10), "UNRESOLVED").otherwise(F.col("status")))
    broken = broken.withColumn("final_text", F.when(title & F.col("y").between(10, 19), "").when(title & F.col("y").between(20, 29), "⟦x⟧").otherwise(F.col("final_text"))).drop("y")
    return B.export_findings(records, broken)


@query("dom20_field_states", """SELECT p_partkey::VARCHAR AS record_id, CASE WHEN p_size < 10 THEN 'PASSTHROUGH' WHEN p_size < 20 THEN 'DETERMINISTIC' WHEN p_size < 30 THEN 'REVIEW_REQUIRED' ELSE 'UNRESOLVED' END AS status FROM part""")
def dom20(spark, sf_dir):
    part = _part(spark, sf_dir)
    size = F.col("p_size")
    text = F.when(size < 10, F.col("p_name")).otherwise(F.concat_ws(" ", "fa", F.when(size < 20, "ب").when(size < 30, "پ").otherwise("ت")))
    fields = part.select(F.col("p_partkey").cast("string").alias("record_id"), F.lit("title").alias("path"), text.alias("source_text"))
    resolved = fields.where("source_text LIKE '% ب' OR source_text LIKE '% پ'").select("source_text", F.lit("ijmes_citation_title").alias("profile"), F.when(F.col("source_text").endswith("ب"), "DETERMINISTIC").otherwise("AMBIGUOUS").alias("status"), F.lit("r").alias("rendered"), F.lit(1).alias("issues")).distinct()
    return B.field_states(fields, resolved).select("record_id", "status")


@query("msc5_review_packets", """WITH e AS (SELECT o_custkey, string_agg('{"evidence_id":"' || o_orderkey || '","text":"' || o_orderpriority || '"}', ',' ORDER BY o_orderkey::VARCHAR) AS l FROM orders GROUP BY 1)
SELECT o_custkey::VARCHAR AS candidate_id, sha256('{"candidate_id":"' || o_custkey || '","evidence":[' || l || ']}') AS review_basis_sha256 FROM e""")
def msc5(spark, sf_dir):
    evidence = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("candidate_id"), F.col("o_orderkey").cast("string").alias("evidence_id"), F.col("o_orderpriority").alias("text"))
    return A.review_packet(evidence.select("candidate_id").distinct(), evidence).select("candidate_id", "review_basis_sha256")


@query("msc7_decision_findings", """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'UNKNOWN_CANDIDATE' WHEN 'O' THEN 'STALE' ELSE 'UNKNOWN_DISPOSITION' END AS finding FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority = '5-LOW'""")
def msc7(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    decisions = orders.select(F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderstatus") == "O", "old").otherwise("now").alias("review_basis_sha256"), F.when(F.col("o_orderpriority") == "5-LOW", "LATER").otherwise("ACCEPT").alias("disposition"))
    packets = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("candidate_id"), F.lit("now").alias("review_basis_sha256"))
    return A.decision_findings(decisions, packets).select(F.col("candidate_id").alias("o_orderkey"), "finding")


@query("msc9_frozen_baseline", _CASES + " SELECT o AS outcome, count(*) AS n, array_to_string(list_sort(list(lang || '/' || source)), ',') AS cases FROM c GROUP BY 1")
def msc9(spark, sf_dir):
    return C.frozen_baseline(_cases(spark, sf_dir).withColumn("case_id", F.concat_ws("/", "lang", "source")), "case_id", "outcome").select("outcome", "n", F.array_join("cases", ",").alias("cases"))


@query("msc12_fallback_coverage", _COVERED + " SELECT count(*) AS tokens, count_if(covered) AS before, count_if(covered OR length(w) <= 4) AS after FROM t")
def msc12(spark, sf_dir):
    return C.before_and_after(_covered(spark, sf_dir), "covered", F.col("covered") | (F.length("w") <= 4))


@query("msc13_pack_integrity", _HYP + " SELECT 'MULTIPLE_HYPOTHESES' AS violation, count(*) AS n FROM g WHERE k > 1 HAVING count(*) > 0 UNION ALL SELECT 'NO_HYPOTHESIS', count(*) FROM g WHERE k = 0 HAVING count(*) > 0")
def msc13(spark, sf_dir):
    forms = E.consensus(_hypotheses(spark, sf_dir), "normalized")
    rules = [("MULTIPLE_HYPOTHESES", F.size("hypotheses") <= 1), ("NO_HYPOTHESIS", F.size("hypotheses") > 0)]
    return V.violations(forms, rules, ["normalized"]).groupBy("violation").agg(F.count("*").alias("n"))


_CATALOGUE = """r AS (SELECT o_orderkey AS id, o_custkey || '/' || (o_orderkey % 400) AS source, CASE WHEN o_orderkey % 11 = 0 THEN (floor(o_totalprice)::BIGINT % 5000)::VARCHAR END AS ncid,
  CASE WHEN o_orderkey % 7 = 0 THEN [(floor(o_totalprice)::BIGINT % 9000)::VARCHAR, 'o' || o_orderkey] ELSE [] END AS isbns, o_custkey::VARCHAR AS title,
  CASE WHEN o_orderstatus = 'P' THEN [] WHEN o_orderkey % 3 = 0 THEN [o_orderpriority, o_orderstatus] ELSE [o_orderpriority] END AS authors, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) END AS year, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS publisher FROM orders)"""


def _catalogue(spark, sf_dir):
    """Orders as bibliographic records with keys in common."""
    key, text = F.col("o_orderkey"), lambda c: c.cast("string")
    price = F.floor("o_totalprice").cast("long")
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.concat_ws("/", text(F.col("o_custkey")), text(key % 400)).alias("source"), F.when(key % 11 == 0, text(price % 5000)).alias("ncid"),
        F.when(key % 7 == 0, F.array(text(price % 9000), F.concat(F.lit("o"), text(key)))).otherwise(none).alias("isbns"), text(F.col("o_custkey")).alias("title"),
        F.when(F.col("o_orderstatus") == "P", none).when(key % 3 == 0, F.array("o_orderpriority", "o_orderstatus")).otherwise(F.array("o_orderpriority")).alias("authors"),
        F.when(key % 2 == 0, F.year("o_orderdate")).alias("year"), F.when(key % 5 == 0, F.col("o_orderstatus")).alias("publisher"),
    )


@query("jon15_relations", f"""WITH {_CATALOGUE},
i AS (SELECT id, unnest(isbns) AS isbn FROM r),
p AS (SELECT a.id, b.id AS other FROM r a JOIN r b ON a.source = b.source AND a.id <> b.id UNION SELECT a.id, b.id FROM r a JOIN r b ON a.ncid = b.ncid AND a.id <> b.id
  UNION SELECT a.id, b.id FROM i a JOIN i b ON a.isbn = b.isbn AND a.id <> b.id UNION SELECT a.id, b.id FROM r a JOIN r b ON a.title = b.title AND a.id <> b.id),
j AS (SELECT p.id, CASE WHEN a.source = b.source THEN 1 WHEN a.ncid = b.ncid OR list_has_any(a.isbns, b.isbns) THEN 2
  WHEN list_has_any(a.authors, b.authors) AND (a.year <> b.year OR a.publisher <> b.publisher) THEN 3 WHEN len(a.authors) > 0 AND len(b.authors) > 0 AND NOT list_has_any(a.authors, b.authors) THEN 4 ELSE 5 END AS rule
  FROM p JOIN r a ON a.id = p.id JOIN r b ON b.id = p.other)
SELECT r.id, coalesce(['EXACT_DUPLICATE_RECORD', 'DUPLICATE_MANIFESTATION', 'RELATED_EDITION', 'SIMILAR_TITLE_ONLY', 'UNCERTAIN_RELATIONSHIP'][min(rule)], 'UNIQUE_RECORD') AS status FROM r LEFT JOIN j USING (id) GROUP BY r.id""")
def jon15(spark, sf_dir):
    return relations.relations(_catalogue(spark, sf_dir), "id", "source", ["ncid", "isbns"], "title", "authors", "year", "publisher")


@query("jon15_membership", f"""WITH {_CATALOGUE},
k AS (SELECT id, 'source' AS key, source AS value FROM r UNION SELECT id, 'ncid', ncid FROM r WHERE ncid IS NOT NULL UNION SELECT id, 'isbns', unnest(isbns) FROM r UNION SELECT id, 'title', title FROM r)
SELECT id, key, value, min(id) OVER (PARTITION BY key, value) AS leader, count(*) OVER (PARTITION BY key, value) AS members FROM k QUALIFY members > 1""")
def jon15_members(spark, sf_dir):
    return relations.membership(_catalogue(spark, sf_dir), "id", "source", ["ncid", "isbns"], "title")


@query("msc14_candidate_validation", """SELECT o_orderkey, 'SCHEMA:CHEAP' AS finding FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT o_orderkey, 'DUPLICATE:CUSTOMER' FROM orders WHERE o_orderkey <> (SELECT min(b.o_orderkey) FROM orders b WHERE b.o_custkey = orders.o_custkey) UNION ALL SELECT o_orderkey, 'OVERLAP' FROM orders WHERE o_custkey IN (SELECT user_id FROM events)""")
def msc14(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    known = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey")).distinct()
    return A.validate_candidates(orders, "o_orderkey", [("CHEAP", F.col("o_totalprice") >= 50000)], {"CUSTOMER": F.col("o_custkey")}, "o_orderkey", known, "o_custkey")


@query("msc15_amendments", """SELECT o_orderkey, 'status' AS field, 'F' AS value FROM orders WHERE o_orderstatus <> 'F'""")
def msc15(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cases = orders.select("o_orderkey", F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("fields"))
    return A.amendments_applied(orders.select("o_orderkey", F.lit("status").alias("field"), F.lit("F").alias("value")), cases, "o_orderkey")


@query("msc16_acquisition", """SELECT doc_id, row_number() OVER (ORDER BY sha256('select:' || doc_id), doc_id) <= 200 AS selected FROM documents QUALIFY selected""")
def msc16(spark, sf_dir):
    return S.hash_ranked_split(table(spark, sf_dir, "documents"), "doc_id", 200).select("doc_id", F.lit(True).alias("selected"))


@query("msc17_review_candidates", "SELECT p_partkey AS candidate_id, p_name AS surface FROM part WHERE p_size <= 25")
def msc17(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("surface"), F.when(F.col("p_size") <= 25, "ELIGIBLE").otherwise("REJECTED").alias("eligibility"))
    return A.review_candidates(rows)


@query("dom24_triage", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ROUTINE' WHEN 'O' THEN 'EDITORIAL' ELSE 'UNCLASSIFIED' END AS triage FROM orders")
def dom24(spark, sf_dir):
    rules = spark.createDataFrame([("F", "ROUTINE"), ("O", "EDITORIAL")], "id string, triage string")
    return A.triage(table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderstatus")), rules).select("o_orderkey", "triage")


@query("msc3_rule_registry", f"""SELECT letter, CASE WHEN letter IN ('چ', 'خ', 'ش', 'ژ', 'غ') THEN 'MULTIPLE' WHEN letter IN ('ا', 'آ') THEN 'NO_RULE' ELSE 'SINGLE' END AS status, count(*) AS n
FROM (SELECT unnest(string_split(replace({_NAME}, ' ', ''), '')) AS letter FROM part) GROUP BY 1, 2""")
def msc3(spark, sf_dir):
    """Every letter of all names with the status of its rule."""
    letters = _part(spark, sf_dir).select(F.explode(F.split(F.replace("fa", F.lit(" "), F.lit("")), "")).alias("letter")).where("letter <> ''")
    counted = letters.groupBy("letter").agg(F.count("*").alias("n"))
    return counted.join(A.rule_registry(spark), "letter", "left").select("letter", F.coalesce("status", F.lit("NO_RULE")).alias("status"), "n")
