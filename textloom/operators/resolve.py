"""Tokens to readings: lookup cascade, relations, suffix analyses, issues, roll-up.

Dimension tables (lexicon, authority, rules) are DataFrames given by the caller;
they are broadcast only if their row count is within ``BROADCAST_ROWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
ZWNJ = T.ZWNJ

# Productive suffixes: surface, type, host categories, rendering, needs a consonant-final host, allowed without a joiner.
SUFFIXES = (
    ("ها", "PLURAL_HA", ("noun", "proper-noun"), "hā", False, False),
    ("ترین", "SUPERLATIVE_TARIN", ("adjective",), "tarīn", False, False),
    ("تر", "COMPARATIVE_TAR", ("adjective",), "tar", False, False),
    ("مان", "POSSESSIVE_1PL", ("noun", "proper-noun"), "imān", True, True),
    ("تان", "POSSESSIVE_2PL", ("noun", "proper-noun"), "itān", True, True),
    ("شان", "POSSESSIVE_3PL", ("noun", "proper-noun"), "ishān", True, True),
    ("م", "POSSESSIVE_1SG", ("noun", "proper-noun"), "am", True, True),
    ("ت", "POSSESSIVE_2SG", ("noun", "proper-noun"), "at", True, True),
    ("ش", "POSSESSIVE_3SG", ("noun", "proper-noun"), "ash", True, True),
)
_RULE = "suffix string, type string, hosts array<string>, rendering string, consonant_host boolean, joinerless boolean"


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint behind a check of the size; beyond it the join is left to shuffle.

    Rows and the bytes of their texts and arrays are counted, of at most one row more than may be broadcast.
    """
    wide = [F.octet_length(F.col(c).cast("string")) for c, kind in df.dtypes if kind == "string"] + [16 * F.size(c) for c, kind in df.dtypes if kind.startswith("array")]
    size = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(8 * len(df.columns)))
    n, total = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def token_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """TXT2/WIN5: a row for each token with its class and UTF-16 offsets.

    Offsets are running sums over the document's own tokens: no shuffle.
    """
    norm = docs.select(F.col(id_col), T.normalize_text(F.col(text_col)).alias("text"))
    cut = norm.withColumn("surfaces", T.tokens(F.col("text"))).withColumn("starts", T.utf16_starts(F.col("surfaces")))
    rows = cut.select(id_col, F.posexplode(F.arrays_zip("surfaces", "starts")).alias("idx", "t"))
    out = rows.select(id_col, "idx", F.col("t.surfaces").alias("surface"), F.col("t.starts").alias("start"))
    return out.withColumn("end", F.col("start") + T.utf16_length(F.col("surface"))).withColumn("class", T.token_class(F.col("surface")))


def next_word(tokens: DataFrame, id_col: str) -> DataFrame:
    """JON6/WIN4: for each word the word that follows after white space only."""
    words = tokens.where("class <> 'whitespace'")
    w = Window.partitionBy(id_col).orderBy("idx")
    out = words.withColumn("next_idx", F.lead("idx").over(w)).withColumn("next_class", F.lead("class").over(w)).withColumn("next_surface", F.lead("surface").over(w))
    return out.where("class = 'persian-word' AND next_class = 'persian-word'").select(id_col, F.col("idx").alias("src_idx"), "next_idx", "surface", "next_surface")


def relations(tokens: DataFrame, lexicon: DataFrame, id_col: str) -> DataFrame:
    """DOM7/JON7: first of four rules that holds between neighbours.

    Plural with izafat on a reviewed stem, written izafat, a curated pair, or (as a
    candidate) a resolved noun before a resolved noun, adjective or proper noun.
    """
    pairs = next_word(tokens, id_col)
    pairs = pairs.withColumn("lookup", T.lookup_form(F.col("surface"))).withColumn("next_lookup", T.lookup_form(F.col("next_surface")))
    pairs = pairs.withColumn("plural_stem", F.nullif(F.regexp_extract("lookup", f"^(.+){ZWNJ}های$", 1), F.lit("")))
    lex = small(lexicon.select("normalized", "category", "canonicals", "izafat_after"))
    own = lex.select(F.col("normalized").alias("lookup"), "izafat_after", F.col("category").alias("_c"), (F.size("canonicals") == 1).alias("_one"))
    following = lex.select(F.col("normalized").alias("next_lookup"), F.col("category").alias("_nc"), (F.size("canonicals") == 1).alias("_none"))
    stems = lex.where(F.col("category").isin("noun", "proper-noun")).select(F.col("normalized").alias("plural_stem"), F.lit(True).alias("_plural"))
    out = pairs.join(own, "lookup", "left").join(following, "next_lookup", "left").join(stems, "plural_stem", "left")
    ortho = T.orthography(F.col("surface"))
    grammatical = (F.col("_c") == "noun") & F.col("_nc").isin("noun", "adjective", "proper-noun") & F.col("_one") & F.col("_none")
    kind = (
        F.when(F.col("_plural"), "EXPLICIT_PLURAL_IZAFAT_YE")
        .when(ortho["izafat"] == "HEH_ORTHOGRAPHY", "EXPLICIT_HEH_ORTHOGRAPHY")
        .when(ortho["izafat"].isNotNull(), "EXPLICIT_FINAL_KASRA")
        .when(F.coalesce(F.array_contains("izafat_after", F.col("next_lookup")), F.lit(False)), "CURATED_LEXICAL_CONTEXT")
        .when(grammatical, "GRAMMATICAL_CANDIDATE")
    )
    out = out.withColumn("relation", kind).where("relation IS NOT NULL")
    return out.select(id_col, "src_idx", "next_idx", "relation", F.when(F.col("relation") == "GRAMMATICAL_CANDIDATE", "CANDIDATE").otherwise("CONFIRMED").alias("status"))


def _final_classes(canonicals: str) -> Column:
    """Classes of the last letters of a stem's readings."""
    low = lambda c: F.lower(c)
    return F.array_distinct(F.transform(canonicals, lambda c: F.when(low(c).rlike("[aāiīuū]$"), "VOWEL_FINAL").when(low(c).rlike("[a-zšžčġḍḥṣṭẓʿʾ]$"), "CONSONANT_FINAL").otherwise("UNKNOWN")))


def suffix_proposals(words: DataFrame, form: str, lexicon: DataFrame, unsupported: Column | None = None) -> DataFrame:
    """DOM1/JON8/WIN8: every suffix a word may end in, judged by its host; the best one first.

    The nine rules are an array literal that each row explodes; no join with rules.
    """
    rules = F.array(*(F.struct(F.lit(s).alias("suffix"), F.lit(t).alias("type"), F.array(*map(F.lit, h)).alias("hosts"), F.lit(r).alias("rendering"), F.lit(c).alias("consonant_host"), F.lit(j).alias("joinerless")) for s, t, h, r, c, j in SUFFIXES))
    word = F.col(form)
    forms = words.select(form).distinct().withColumn("_bad", F.coalesce(unsupported, F.lit(False)) if unsupported is not None else F.lit(False))
    fits = F.filter(rules, lambda r: (word.endswith(r["suffix"]) | word.endswith(F.concat(r["suffix"], F.lit("ی")))) & (F.length(word) > F.length(r["suffix"])))
    out = forms.withColumn("_rules", fits).select(form, "_bad", F.posexplode("_rules").alias("rule_order", "r")).select(form, "_bad", "rule_order", "r.*")
    izafat = ~word.endswith(F.col("suffix"))
    out = out.withColumn("explicit_izafat", izafat).where("NOT explicit_izafat OR suffix = 'ها'")
    tail = F.length("suffix") + F.when(F.col("explicit_izafat"), 1).otherwise(0)
    stem = F.substr(word, F.lit(1), F.length(word) - tail)
    out = out.withColumn("joiner", stem.endswith(ZWNJ)).withColumn("stem", F.regexp_replace(stem, f"{ZWNJ}$", ""))
    out = out.where(F.length("stem") > 0)
    lex = small(lexicon.select("normalized", "category", _final_classes("canonicals").alias("_finals")))
    out = out.join(lex.select(F.col("normalized").alias("stem"), F.col("category").alias("stem_category"), "_finals"), "stem", "left")
    out = out.join(lex.select(F.col("normalized").alias(form), F.lit(True).alias("whole_word")), form, "left").withColumn("whole_word", F.coalesce("whole_word", F.lit(False)))
    ending = F.when(F.coalesce(F.size("_finals"), F.lit(0)) <= 0, "UNKNOWN").when(F.col("stem").endswith("ه"), "HEH_FINAL").when(F.size("_finals") == 1, F.col("_finals")[0]).otherwise("UNKNOWN")
    out = out.withColumn("host_ending", ending)
    known = F.col("stem_category").isNotNull()
    compatible = known & F.array_contains("hosts", F.col("stem_category"))
    realised = ~F.col("consonant_host") | (F.col("host_ending") == "CONSONANT_FINAL")
    confirmed = compatible & realised & (F.col("joiner") | F.col("joinerless")) & ~F.col("_bad") & ~F.col("whole_word")
    status = F.when((known & ~compatible) | F.col("_bad"), "CONFLICT").when(confirmed, "CONFIRMED").otherwise("CANDIDATE")
    out = out.withColumn("status", status).where("NOT (whole_word AND stem_category IS NULL)")
    order = F.when(F.col("status") == "CONFIRMED", 0).when(F.col("status") == "CONFLICT", 1).otherwise(2)
    w = Window.partitionBy(form).orderBy(order, F.desc(F.length("stem")), "rule_order")
    return out.withColumn("rank", F.row_number().over(w)).drop("_bad", "hosts", "_finals")


def morphology_strength(status: Column, known_stem: Column, whole_word: Column, blocked: Column) -> Column:
    """DOM2: ``blocked`` by written evidence (unsupported marks or vowels)."""
    return (
        F.when(status.isNull(), "CANDIDATE_SHAPE_ONLY").when(blocked, "BLOCKED_BY_EXPLICIT_EVIDENCE").when((status == "CONFIRMED") & known_stem, "CONFIRMED_REVIEWED")
        .when(whole_word | (known_stem & (status == "CANDIDATE")), "COMPETING_REVIEWED").when(status == "CONFLICT", "UNSUPPORTED_OR_AMBIGUOUS").when(~known_stem, "CANDIDATE_SHAPE_ONLY").otherwise("UNSUPPORTED_OR_AMBIGUOUS")
    )


def resolve_suffix(best: DataFrame, lexicon: DataFrame) -> DataFrame:
    """DOM3: stem-suffix for a confirmed analysis with one stem reading; ambiguous if the whole word competes."""
    lex = small(lexicon.select(F.col("normalized").alias("stem"), F.col("canonicals").alias("_c")))
    out = best.where("rank = 1").join(lex, "stem", "left")
    state = F.when(F.col("whole_word") & F.col("_c").isNotNull(), "AMBIGUOUS").when((F.col("status") == "CONFIRMED") & (F.size("_c") == 1), "LEXICON_RESOLVED").when(F.size("_c") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    text = F.when(state == "LEXICON_RESOLVED", F.concat(F.col("_c")[0], F.lit("-"), F.col("rendering")))
    return out.withColumn("state", state).withColumn("canonical", text).drop("_c")


def vocalized_outcome(readings: Column, evidence: Column) -> Column:
    """DOM4: readings (array of (canonical, vocalization map place -> vowel)) against written vowels (map)."""
    fits = lambda r: F.forall(F.map_entries(evidence), lambda e: F.coalesce(F.try_element_at(r["vocalization"], e["key"]) == e["value"], F.lit(True)))
    sure = lambda r: (F.cardinality(evidence) > 0) & F.forall(F.map_keys(evidence), lambda k: F.map_contains_key(r["vocalization"], k))
    match = F.filter(readings, lambda r: fits(r) & sure(r))
    unknown = F.filter(readings, lambda r: fits(r) & ~sure(r))
    outcome = (
        F.when((F.size(match) == 1) & (F.size(unknown) == 0), "RESOLVED").when(F.size(match) > 0, "AMBIGUOUS").when(F.size(unknown) > 0, "INSUFFICIENT").otherwise("CONFLICT")
    )
    left = F.when(F.size(match) + F.size(unknown) > 0, F.concat(match, unknown)).otherwise(readings)
    return F.struct(outcome.alias("outcome"), F.transform(left, lambda r: r["canonical"]).alias("canonicals"))


def cascade(tokens: DataFrame, lookup: str, sources: list[tuple[str, DataFrame]], mode: str = "AUTHORITY_FIRST") -> DataFrame:
    """JON1-5/DOM5/DOM6: the first source with a reading decides; several readings are ambiguous, none is unresolved.

    ``sources`` are (name, table of (form, canonicals array)) in order of precedence; ``mode``
    is carried to the result for comparison of routings.
    """
    out = tokens
    for k, (_, table) in enumerate(sources):
        own = small(table.select(F.col("form").alias(lookup), F.col("canonicals").alias(f"_c{k}")))
        out = out.join(own, lookup, "left")
    pick = F.coalesce(*(F.when(F.size(f"_c{k}") > 0, F.struct(F.lit(name).alias("source"), F.col(f"_c{k}").alias("canonicals"))) for k, (name, _) in enumerate(sources)))
    out = out.withColumn("_p", pick)
    state = F.when(F.col("_p").isNull(), "UNRESOLVED").when(F.size("_p.canonicals") > 1, "AMBIGUOUS").otherwise("LEXICON_RESOLVED")
    out = out.withColumn("source", F.col("_p.source")).withColumn("state", state).withColumn("canonical", F.when(state == "LEXICON_RESOLVED", F.col("_p.canonicals")[0])).withColumn("routing", F.lit(mode))
    return out.drop("_p", *(f"_c{k}" for k in range(len(sources))))


def published_authority(phrases: DataFrame, entries: DataFrame) -> DataFrame:
    """JON3/4/MSC1: phrase, profile and context against published entries; the exact context first, then PERSON_NAME."""
    live = entries.where("status = 'PUBLISHED'").select("normalized", "profile", F.col("context").alias("_ctx"), F.col("canonical").alias("_can"))
    both = phrases.join(live, ["normalized", "profile"], "left").withColumn("_rank", F.when(F.col("_ctx") == F.col("context"), 0).when(F.col("_ctx") == "PERSON_NAME", 1))
    keys = ["phrase_id", "normalized", "profile", "context"]
    got = both.groupBy(*keys).agg(F.collect_set(F.when(F.col("_rank") == 0, F.col("_can"))).alias("_a"), F.collect_set(F.when(F.col("_rank") == 1, F.col("_can"))).alias("_b"))
    found = F.when(F.size("_a") > 0, F.array_sort("_a")).otherwise(F.array_sort("_b"))
    state = F.when(F.size(found) == 0, "NONE").when(F.size(found) > 1, "AMBIGUOUS").otherwise("RESOLVED")
    return got.withColumn("state", state).withColumn("canonical", F.when(state == "RESOLVED", found[0])).withColumn("copyable", state == "RESOLVED").drop("_a", "_b")


_SEVERITY = ("DETERMINISTIC", "LEXICON_RESOLVED", "USER_OVERRIDE", "AMBIGUOUS", "UNRESOLVED")


def routed(tokens: DataFrame, policy: str = "CURRENT_PRODUCTION") -> DataFrame:
    """DOM6: which of a token's resolutions holds, by routing policy.

    Tokens carry ``whole_state`` and ``whole_canonical`` (null without a reviewed entry of the
    whole word), ``strength``, ``morph_state`` and ``morph_canonical`` (null without a suffix analysis),
    ``fallback`` (a proposal or null), ``marks`` and ``vowels`` (booleans of the spelling). Production lets any
    suffix analysis go first; SAFE_WHOLE_WORD_EVIDENCE the reviewed whole word, then confirmed
    analyses, and a fallback where the analysis is only a shape.
    """
    if policy not in ("CURRENT_PRODUCTION", "SAFE_WHOLE_WORD_EVIDENCE"):
        raise ValueError(policy)
    safe = policy == "SAFE_WHOLE_WORD_EVIDENCE"
    text = lambda x: F.lit(x).cast("string")
    answer = lambda state, canonical, proposal, blocking: F.struct(state.alias("state"), canonical.alias("canonical"), proposal.alias("proposal"), blocking.alias("blocking"))
    open_ = lambda blocking, proposal=None: answer(text("UNRESOLVED"), text(None), text(None) if proposal is None else proposal, text(blocking))
    whole = F.col("whole_state").isNotNull()
    token = F.when(F.col("marks"), open_("UNSUPPORTED_ORTHOGRAPHIC_EVIDENCE")).when(whole, answer(F.col("whole_state"), F.col("whole_canonical"), text(None), text(None)))
    if safe:
        token = token.when(F.col("vowels"), open_("INSUFFICIENT_VOCALIZATION"))
    token = token.when(F.col("fallback").isNotNull(), open_("NO_LEXICAL_ENTRY", F.col("fallback"))).otherwise(open_("NO_LEXICAL_ENTRY"))
    morph = answer(F.col("morph_state"), F.col("morph_canonical"), text(None), text(None))
    if safe:
        shape = (F.col("strength") == "CANDIDATE_SHAPE_ONLY") & ~F.col("vowels") & ~F.col("marks") & F.col("fallback").isNotNull()
        rival = (F.col("strength") == "COMPETING_REVIEWED") & F.col("fallback").isNotNull()
        chosen = F.when(whole | F.col("strength").isNull(), token).when(rival, open_("WHOLE_WORD_FALLBACK_MORPHOLOGY_COMPETITION", F.col("fallback"))).when(shape, open_("NO_LEXICAL_ENTRY", F.col("fallback"))).otherwise(morph)
    else:
        chosen = F.when(F.col("strength").isNotNull(), morph).otherwise(token)
    return tokens.withColumn("_a", chosen).select(*tokens.columns, "_a.*")


def relation_issues(found: DataFrame, id_col: str) -> DataFrame:
    """DOM8: an issue for every candidate relation that nobody has decided (``disposition``)."""
    open_ = found.where("status = 'CANDIDATE' AND coalesce(disposition, '') NOT IN ('ACCEPTED', 'REJECTED')")
    return open_.select(id_col, F.col("src_idx").alias("idx"), F.lit("IZAFAT_CANDIDATE").alias("issue_type"))


def document_status(tokens: DataFrame, id_col: str, state: str = "state", relations: DataFrame | None = None) -> DataFrame:
    """AGG33: the most severe state of a document's tokens and relations (a candidate relation is ambiguous)."""
    if relations is not None:
        open_ = relations.where("status = 'CANDIDATE'").select(id_col, F.lit("AMBIGUOUS").alias(state))
        tokens = tokens.select(id_col, state).unionByName(open_)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, _SEVERITY)), F.col(state)), F.lit(1))
    return tokens.groupBy(id_col).agg(F.max(rank).alias("_r")).select(id_col, F.element_at(F.array(*map(F.lit, _SEVERITY)), F.col("_r").cast("int")).alias("status"))


def render_documents(tokens: DataFrame, id_col: str, text: str, marks: DataFrame | None = None) -> DataFrame:
    """AGG34/DOM21: texts of a document's tokens in order, with relation marks after their words."""
    piece = F.coalesce(F.col(text), F.lit(""))
    if marks is not None:
        tokens = tokens.join(marks.select(id_col, F.col("src_idx").alias("idx"), F.col("mark").alias("_m")), [id_col, "idx"], "left")
        piece = F.concat(piece, F.coalesce("_m", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("idx", piece.alias("piece"))))
    return tokens.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("rendered"))


def review_issues(tokens: DataFrame, id_col: str) -> DataFrame:
    """DOM8: the first of seven rules that an open token breaks; ``in_order`` sorts them.

    An issue's id names its document's tokens, its place, its surface, its rule and its evidence: documents that differ
    share none, and a decision on other evidence is stale.

    Optional columns: ``whole_word`` (a reviewed whole word competes), ``allomorph`` (the suffix needs a form that is
    not supported), ``blocking`` and ``proposal`` as :func:`routed` gives them.
    """
    has = lambda c: F.col(c) if c in tokens.columns else F.lit(None)
    yes = lambda c: F.coalesce(has(c).cast("boolean"), F.lit(False))
    open_ = ~F.coalesce(F.col("state").isin("DETERMINISTIC", "LEXICON_RESOLVED", "USER_OVERRIDE"), F.lit(False))
    kind = (
        F.when(yes("whole_word") & (F.coalesce("morph_status", F.lit("CONFIRMED")) != "CONFIRMED"), "MORPHOLOGY_AMBIGUITY")
        .when((F.col("morph_status") == "CANDIDATE") & yes("allomorph"), "UNSUPPORTED_ALLOMORPH")
        .when(F.size("unsupported_marks") > 0, "UNSUPPORTED_ORTHOGRAPHIC_EVIDENCE")
        .when(has("blocking") == "INSUFFICIENT_VOCALIZATION", "INSUFFICIENT_VOCALIZATION")
        .when((F.col("state") == "AMBIGUOUS") | (has("blocking") == "LEXICAL_AMBIGUITY"), "LEXICAL_AMBIGUITY")
        .when((F.col("state") == "UNRESOLVED") & has("proposal").isNotNull(), "EVIDENCE_DERIVED_READING")
        .when((F.col("state") == "UNRESOLVED") | has("blocking").isin("NO_LEXICAL_ENTRY", "VOCALIZATION_CONFLICT"), "UNKNOWN_TOKEN")
    )
    kind = F.when(open_, kind)
    # What is to be decided: the same place with other evidence is another issue.
    payload = F.sha2(F.to_json(F.struct(*(has(c).alias(c) for c in PAYLOAD)), {"ignoreNullFields": "false"}), 256)
    texts = fingerprints(tokens, id_col)
    out = tokens.withColumn("issue_type", kind).where("issue_type IS NOT NULL").join(texts, id_col)
    parts = [F.lit("issue"), F.substring("_text", 1, 16), F.concat_ws("-", F.col("idx").cast("string"), F.col("start").cast("string")), "surface", "issue_type", F.substring(payload, 1, 16)]
    return out.withColumn("issue_id", F.concat_ws(":", *parts)).select(id_col, "idx", "start", "issue_id", "issue_type")


#: Columns of a token that are its evidence, as far as they are there.
PAYLOAD = ("morph_status", "whole_word", "allomorph", "unsupported_marks", "blocking", "proposal", "readings", "alternatives")


def fingerprints(tokens: DataFrame, id_col: str) -> DataFrame:
    """``_text``: a hash of each document's tokens and their places; a document is the largest group, of hashes."""
    one = F.sha2(F.concat_ws("\u0000", F.col("idx").cast("string"), F.col("start").cast("string"), "surface"), 256)
    return tokens.groupBy(id_col).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("idx", "start", one.alias("h"))))["h"], ""), 256).alias("_text"))


def in_order(issues: DataFrame, id_col: str) -> DataFrame:
    """SRT6: each document's issues as one list, by place, then id; a document is the largest group."""
    return issues.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "issue_id", "issue_type"))).alias("issues"))


def apply_decisions(tokens: DataFrame, decisions: DataFrame, id_col: str) -> DataFrame:
    """DOM9/JON9: decisions on issues, applied within each document until nothing changes.

    A decision names (issue_id, action ACCEPT/OVERRIDE/REJECT, value). Accepting a reading
    may settle a later ambiguous token of the same lookup form, which is why it is
    repeated, at most once more than there are decisions. Groups are single documents.
    """
    given = decisions.groupBy(id_col).agg(F.collect_list(F.struct("issue_id", "action", "value")).alias("given"))
    held = tokens.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "lookup", "state", "canonical", "issue_id"))).alias("ts"))
    both = held.join(given, id_col, "left")
    schema = f"{id_col} {both.schema[id_col].dataType.simpleString()}, idx int, lookup string, state string, canonical string, issue_id string, applied boolean"

    def solve(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for doc, ts, given_rows in zip(frame[id_col], frame["ts"], frame["given"]):
                ts = [dict(t) | {"applied": False} for t in ts]
                todo = [dict(d) for d in given_rows] if given_rows is not None else []
                for _ in range(len(todo) + 1):
                    changed, settled = False, {}
                    for d in todo:
                        for t in ts:
                            if t["issue_id"] == d["issue_id"] and not t["applied"]:
                                t["applied"] = changed = True
                                if d["action"] != "REJECT":
                                    t["state"], t["canonical"] = "USER_OVERRIDE", d["value"]
                                    settled[t["lookup"]] = d["value"]
                    for t in ts:
                        if t["lookup"] in settled and t["state"] == "AMBIGUOUS" and not t["applied"]:
                            t["state"], t["canonical"], changed = "USER_OVERRIDE", settled[t["lookup"]], True
                    if not changed:
                        break
                rows += [(doc, t["idx"], t["lookup"], t["state"], t["canonical"], t["issue_id"], t["applied"]) for t in ts]
            yield pd.DataFrame(rows, columns=[id_col, "idx", "lookup", "state", "canonical", "issue_id", "applied"])

    return both.mapInPandas(solve, schema)


def stale_decisions(decisions: DataFrame, issues: DataFrame) -> DataFrame:
    """JON9: decisions whose issue is gone."""
    return decisions.join(issues.select("issue_id"), "issue_id", "left_anti")
