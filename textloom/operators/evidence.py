"""Lexical evidence: dictionary and catalogue records to observations, candidates and packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.hashing import content_id
from textloom.operators.transduce import profile_of, transduced

# Schemes whose forms are comparable with each other.
COMPARABLE_SCHEMES = ("ALA_LC", "IJMES", "IRANICA", "ISO", "DMG")


def valid_entries(raw: DataFrame) -> DataFrame:
    """FLT2: dictionary rows with the reason against them, if any."""
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "MALFORMED_JSON")
        .when(F.coalesce(F.trim("word"), F.lit("")) == "", "MISSING_WORD")
        .when(~F.col("lang_code").eqNullSafe(F.lit("fa")), "NOT_PERSIAN")
        .when(~T.contains_arabic(F.col("word")), "NO_ARABIC_SCRIPT")
    )
    return raw.withColumn("reason", reason)


def lemma_status(senses: Column) -> Column:
    """DOM17: a form-of, alt-of or inflection sense makes a non-lemma form; no sense is unknown."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    derived = lambda s: yes(F.size(s["form_of"]) > 0) | yes(F.size(s["alt_of"]) > 0) | yes(F.arrays_overlap(s["tags"], F.array(F.lit("form-of"), F.lit("inflection"))))
    return F.when(F.coalesce(F.size(senses), F.lit(0)) <= 0, "UNKNOWN").when(F.exists(senses, derived), "NON_LEMMA_FORM").otherwise("LEMMA")


def observations(entries: DataFrame) -> DataFrame:
    """DOM17: one row for each distinct romanisation of an entry, or one without."""
    romanized = F.filter("forms", lambda f: F.array_contains(F.coalesce(f["tags"], F.array().cast("array<string>")), "romanization"))
    texts = F.array_distinct(F.transform(romanized, lambda f: F.struct(F.coalesce(f["romanization"], f["form"]).alias("romanization"), F.array_sort(F.coalesce(f["tags"], F.array().cast("array<string>"))).alias("tags"))))
    out = entries.withColumn("normalized", T.normalize_text(F.col("word"))).withColumn("lemma", lemma_status(F.col("senses")))
    out = out.select("entry_id", "word", "normalized", "pos", "lemma", F.posexplode_outer(texts).alias("idx", "o"))
    out = out.select("entry_id", "word", "normalized", "pos", "lemma", "idx", "o.romanization", "o.tags")
    return out.withColumn("profile", F.coalesce(profile_of(F.col("tags")), F.lit("UNCLASSIFIED"))).withColumn("evidence_id", content_id(F.col("entry_id"), F.col("idx"), F.col("normalized"), F.col("romanization"), prefix="ev-"))


def interpret(obs: DataFrame) -> DataFrame:
    """DOM13: romanisation, lemma, profile, then alignment; the first blocker holds. Status is one of four."""
    t = transduced(F.col("normalized"), F.col("romanization"), F.col("profile"))
    out = obs.withColumn("_t", t)
    blocker = (
        F.when(F.col("romanization").isNull(), "NO_ROMANIZATION")
        .when(F.col("lemma") == "NON_LEMMA_FORM", "NON_LEMMA_SOURCE_FORM")
        .when(~F.col("profile").isin("IRANIAN", "CLASSICAL_DARI"), "UNCLASSIFIED_PROFILE")
        .when(F.col("_t.canonical").isNull(), F.col("_t.status"))
    )
    return out.withColumn("blocker", blocker).withColumn("hypothesis", F.when(F.col("blocker").isNull(), F.col("_t.canonical"))).withColumn(
        "status", F.when(F.col("blocker").isNull(), F.concat(F.col("_t.status"), F.lit("_EQUIVALENT"))).when(F.col("blocker").isin("NON_LEMMA_SOURCE_FORM", "UNCLASSIFIED_PROFILE"), "CONTEXT_REQUIRED").otherwise("UNSUPPORTED")
    ).drop("_t")


def candidates(evidence: DataFrame, form: str, scheme: str, value: str, ident: str) -> DataFrame:
    """AGG5/6: by form: evidence ids, same-scheme conflicts and cross-scheme variants.

    Two aggregations, by (form, scheme) and by form; conflicts count only for comparable schemes.
    """
    distinct = evidence.dropDuplicates([ident])
    by_scheme = distinct.groupBy(form, scheme).agg(F.array_sort(F.collect_set(value)).alias("values"), F.count("*").alias("n"))
    by_scheme = by_scheme.withColumn("conflict", (F.size("values") > 1) & F.col(scheme).isin(*COMPARABLE_SCHEMES))
    return by_scheme.groupBy(form).agg(
        F.sum("n").alias("evidence_count"), F.count("*").alias("schemes"), F.count_if("conflict").alias("conflicting_schemes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("variants"),
    )


def consensus(interpreted: DataFrame, form: str, strict: bool = True) -> DataFrame:
    """AGG7/8: status of each form's hypotheses.

    ``strict`` (dictionary evidence): agreement is unanimous only if every row has a
    hypothesis; otherwise (catalogue evidence) rows without a romanisation do not count
    against it. Without a hypothesis a form is blocked, or has nothing to interpret.
    """
    silent = F.col("blocker").eqNullSafe(F.lit("NO_ROMANIZATION"))
    failed = F.col("blocker").isNotNull() if strict else F.col("blocker").isNotNull() & ~silent
    out = interpreted.groupBy(form).agg(F.array_sort(F.collect_set("hypothesis")).alias("hypotheses"), F.count("*").alias("evidence_count"), F.count_if(failed).alias("failed"), F.count_if(silent).alias("silent"))
    status = (
        F.when(F.size("hypotheses") > 1, "CONFLICTING_DETERMINISTIC")
        .when((F.size("hypotheses") == 1) & (F.col("failed") == 0), "UNANIMOUS_DETERMINISTIC")
        .when(F.size("hypotheses") == 1, "PARTIAL")
        .when(F.col("silent") == F.col("evidence_count"), "NO_INTERPRETABLE_EVIDENCE")
        .otherwise("BLOCKED")
    )
    return out.withColumn("consensus", status)


def confidence_tier(profiles: Column, evidence: Column) -> Column:
    """AGG9: both profiles agree, several observations do, or there is one."""
    both = F.array_contains(profiles, "IRANIAN") & F.array_contains(profiles, "CLASSICAL_DARI")
    return F.when(both, "CROSS_PROFILE_CONSENSUS").when(evidence >= 2, "MULTI_OBSERVATION_CONSENSUS").otherwise("SINGLE_OBSERVATION_DETERMINISTIC")


def fallback_pack(interpreted: DataFrame) -> DataFrame:
    """AGG10/SNK9: eligible forms with their one hypothesis, and a hash of the entry."""
    agreed = consensus(interpreted, "normalized").where("consensus = 'UNANIMOUS_DETERMINISTIC'")
    profiles = interpreted.where("hypothesis IS NOT NULL").groupBy("normalized").agg(F.array_sort(F.collect_set("profile")).alias("profiles"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    out = agreed.join(profiles, "normalized").withColumn("hypothesis", F.col("hypotheses")[0]).withColumn("tier", confidence_tier(F.col("profiles"), F.col("evidence_count")))
    return out.select("normalized", "hypothesis", "consensus", "tier", "evidence_count", "profiles", "evidence_ids").withColumn("entry_hash", F.sha2(F.to_json(F.struct("normalized", "hypothesis", "evidence_ids")), 256))


def pack_union(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """JON17/SET4: keep what one side has, keep equal values once, drop conflicts; the action says which."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full")
    action = F.when(F.col("_b").isNull(), "LEFT_ONLY").when(F.col("_a").isNull(), "RIGHT_ONLY").when(F.col("_a") == F.col("_b"), "EQUAL").otherwise("CONFLICT")
    return both.withColumn("action", action).withColumn(value, F.when(action != "CONFLICT", F.coalesce("_a", "_b"))).drop("_a", "_b")


def collisions(rows: DataFrame, normalized: str, raw: str) -> DataFrame:
    """AGG2: normalised forms with several raw ones."""
    return rows.groupBy(normalized).agg(F.array_sort(F.collect_set(raw)).alias("raw_forms")).where(F.size("raw_forms") > 1)


def overlap_with_lexicon(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """JON13"""
    lex = lexicon.select("normalized", F.transform("canonicals", lambda c: F.lower(c)).alias("_c"))
    out = forms.join(lex, "normalized", "left")
    return out.withColumn("overlap", F.when(F.col("_c").isNull(), "NEW_FORM").when(F.arrays_overlap(F.transform("romanizations", lambda r: F.lower(r)), "_c"), "EXACT_MATCH").otherwise("DIVERGENT")).drop("_c")


def positional_alignment(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """JON10/DOM10/FLT6: words of two texts by position if there are as many; a hyphen makes a segment ineligible."""
    l, r = T.lexical_words(F.col(left)), T.roman_lexemes(F.col(right))
    out = pairs.withColumn("_l", l).withColumn("_r", r).withColumn("aligned", F.size("_l") == F.size("_r"))
    zipped = F.when(F.col("aligned"), F.arrays_zip("_l", "_r"))
    out = out.select("*", F.posexplode_outer(zipped).alias("place", "_z")).withColumn("source_word", F.col("_z._l")).withColumn("roman_word", F.col("_z._r"))
    blank = F.coalesce(T.unicode_trim(F.col("roman_word")), F.lit("")) == ""
    eligible = F.when(~F.col("aligned"), "COUNT_MISMATCH").when(blank | F.col("roman_word").contains("-"), "CONTEXT_BOUND").otherwise("ELIGIBLE")
    return out.withColumn("eligibility", eligible).drop("_l", "_r", "_z")


def interpret_scheme(value: Column) -> Column:
    """DOM11: rewrites of a catalogue romanisation and what blocks it."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[ʼ’]", "ʾ"), "[ʻ‘]", "ʿ"), "-ʾi ", "-yi ")
    rules = (("EMPTY", F.trim(value) == ""), ("ARABIC_SCRIPT", T.contains_arabic(value)), ("DIGITS", value.rlike(r"\d")), ("BRACKETS", value.rlike(r"[\[\]{}<>]")), ("MAJHUL_VOWEL", value.rlike("[ēōĒŌ]")), ("ABBREVIATION", value.rlike(r"\b\p{L}\.")))
    return F.struct(out.alias("hypothesis"), F.array_compact(F.array(*(F.when(bad, code) for code, bad in rules))).alias("blockers"))


def linked_fields(fields: DataFrame) -> DataFrame:
    """JON14/DOM18: regular fields and their 880 fields by (record, tag, occurrence).

    ``fields``: record_id, tag, linkage ($6), value. An 880 field is MATCHED, UNMATCHED_NONZERO, AMBIGUOUS_DUPLICATE, OCCURRENCE_00
    or MALFORMED_LINKAGE; a regular field that no 880 field answers makes no row.
    """
    parsed = fields.withColumn("_p", T.linkage_subfield(F.col("linkage"))).select("record_id", "tag", F.col("_p.tag").alias("to"), F.col("_p.occurrence").alias("occurrence"), "value")
    is_880, links = F.col("tag") == "880", F.col("to").isNotNull() & (F.col("occurrence") != "00")
    bad = F.when(is_880 & ~F.coalesce(links, F.lit(False)), F.when(F.col("to").isNull(), "MALFORMED_LINKAGE").otherwise("OCCURRENCE_00"))
    parsed = parsed.withColumn("bad", bad).where(is_880 | links & (F.col("tag") != "880") & F.col("record_id").isNotNull())
    # One pass over the fields, which may be costly to make: both sides of a link, and fields without one, are groups of one shuffle.
    side = F.when(is_880, F.coalesce("to", "tag")).otherwise(F.col("tag")).alias("tag")
    one = lambda there: F.first(F.when(there, F.struct("value")), ignorenulls=True)["value"]
    groups = parsed.groupBy("record_id", side, "occurrence", "bad").agg(F.count_if(~is_880).alias("n_regular"), F.count_if(~is_880 & F.col("value").isNotNull()).alias("n_known"), one(~is_880).alias("regular"), F.count_if(is_880).alias("n_alternate"), one(is_880).alias("alternate"))
    status = F.when((F.col("n_regular") > 1) | (F.col("n_alternate") > 1), "AMBIGUOUS_DUPLICATE").when(F.col("n_known") == 0, "UNMATCHED_NONZERO").otherwise("MATCHED")
    keys, no_link = ["record_id", "tag", "occurrence"], F.col("bad").isNotNull()
    rows = groups.where("n_alternate > 0").withColumn("_row", F.explode(F.sequence(F.lit(1), F.when(no_link, F.col("n_alternate")).otherwise(1))))
    return rows.select(*keys, F.coalesce("bad", status).alias("status"), F.when(~no_link, F.col("regular")).alias("regular"), F.when(~no_link, F.col("alternate")).alias("alternate"))


def language_evidence(f041: Column, f008: Column, f546: Column) -> Column:
    """FLT3: the first field that names a language decides."""
    coded = T.marc_languages(F.coalesce(f041, F.lit("")))
    fixed = F.substring(f008, 36, 3)
    return F.when(F.size(coded) > 0, F.when(F.array_contains(coded, "per"), "FIELD_041")).when(fixed.rlike("^[a-z]{3}$"), F.when(fixed == "per", "FIELD_008")).when(F.lower(f546).rlike("persian|farsi"), "FIELD_546")


def pair_scripts(regular: Column, alternate: Column) -> Column:
    """FLT4"""
    ra, aa = T.contains_arabic(regular), T.contains_arabic(alternate)
    return F.when(aa & ~ra, "ROMAN_ARABIC").when(ra & ~aa, "ARABIC_ROMAN").when(ra & aa, "BOTH_ARABIC").otherwise("NO_ARABIC")


def merged_candidates(rows: DataFrame, key: str) -> DataFrame:
    """AGG29: variants of a key, last row of a (value, source) wins, a value with several classes conflicts."""
    from textloom.operators.selection import last_wins

    last = last_wins(rows, [key, "value", "source"], ["ord"])
    values = last.groupBy(key, "value").agg(F.array_sort(F.collect_set("class")).alias("classes"), F.array_sort(F.collect_set("source")).alias("sources"))
    return values.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("value", "classes", "sources"))).alias("variants"), F.bool_or(F.size("classes") > 1).alias("conflict"))


def search_index(index: DataFrame, query: str) -> DataFrame:
    """DOM23: exact match and whether all, some or none of it is reviewed."""
    hits = index.where(F.col("normalized") == F.lit(query))
    return hits.groupBy("normalized").agg(F.count("*").alias("n"), F.when(F.bool_and("reviewed"), "REVIEWED").when(F.bool_or("reviewed"), "PARTLY_REVIEWED").otherwise("UNREVIEWED").alias("status"))


def blocked_pairs(records: DataFrame, ident: str, blocks: list[tuple[str, str, int]]) -> DataFrame:
    """Pairs that share a block key, with the strongest relation; no all-pairs. :mod:`textloom.operators.relations` has the rules of JON15.

    ``blocks``: (column with the key, relation, priority). Each record is compared with
    the first record of its block (star), which links a block of m records by m - 1 pairs.
    """
    parts = None
    for column, relation, priority in blocks:
        keyed = records.where(F.col(column).isNotNull()).select(ident, F.col(column).alias("_k"))
        lead = keyed.groupBy("_k").agg(F.min(ident).alias("a"))
        pairs = keyed.join(lead, "_k").where(F.col(ident) != F.col("a")).select("a", F.col(ident).alias("b"), F.lit(relation).alias("relation"), F.lit(priority).alias("_p"))
        parts = pairs if parts is None else parts.unionByName(pairs)
    return parts.groupBy("a", "b").agg(F.min_by("relation", "_p").alias("relation"))


def provenance_findings(claims: DataFrame, receipts: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """JON27: claims by (candidate, source index) against their latest receipt; missing and contradicted ones."""
    from textloom.operators.selection import last_wins
    from textloom.operators.store import violations

    latest = last_wins(receipts, ["candidate_id", "source_index"], ["ord"])
    both = claims.join(latest.drop("ord"), ["candidate_id", "source_index"], "left")
    return violations(both, [("MISSING_RECEIPT", F.col("verified").isNotNull()), *rules], ["candidate_id", "source_index"])


def derivation_breaks(evidence: DataFrame) -> DataFrame:
    """JON11: children whose parent is absent, is itself derived, or does not hold their text at their span (a null text is the text of null only)."""
    parent = evidence.select(F.col("evidence_id").alias("parent_id"), F.col("text").alias("_pt"), F.col("parent_id").alias("_pp"), F.lit(True).alias("_there"))
    both = evidence.where("parent_id IS NOT NULL").join(parent, "parent_id", "left")
    held = F.substr("_pt", F.col("start") + 1, F.col("end") - F.col("start")).eqNullSafe(F.col("text"))
    finding = F.when(F.col("_there").isNull(), "MISSING_PARENT").when(F.col("_pp").isNotNull(), "NESTED_DERIVATION").when(~held, "SPAN_MISMATCH")
    return both.withColumn("finding", finding).where("finding IS NOT NULL").select("evidence_id", "finding")


def closure_breaks(candidates_df: DataFrame, evidence: DataFrame) -> DataFrame:
    """JON12: candidate evidence lists that differ from the evidence that names the candidate."""
    have = evidence.groupBy("candidate_id").agg(F.collect_set("evidence_id").alias("_have"))
    both = candidates_df.select("candidate_id", F.col("evidence_ids").alias("_want")).join(have, "candidate_id", "full")
    none = F.array().cast("array<string>")
    out = both.withColumn("missing", F.array_except(F.coalesce("_want", none), F.coalesce("_have", none))).withColumn("extra", F.array_except(F.coalesce("_have", none), F.coalesce("_want", none)))
    return out.where((F.size("missing") > 0) | (F.size("extra") > 0)).drop("_want", "_have")


def policy_audit(policy: DataFrame, runtime: DataFrame) -> DataFrame:
    """MSC4"""
    both = policy.join(runtime.select("letter", F.col("rendering").alias("_r")), "letter", "left")
    return both.withColumn("outcome", F.when(F.col("_r").isNull() | F.col("rendering").isNull(), "NOT_COMPARABLE").when(F.col("_r") == F.col("rendering"), "MATCH").otherwise("MISMATCH")).drop("_r")
