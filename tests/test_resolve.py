import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import coverage as C
from textloom.operators import evidence as E
from textloom.operators import resolve as R
from textloom.operators.transduce import recover_profiles, transduce


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [("کتاب", "noun", ["kitāb"], ["خوب"]), ("خوب", "adjective", ["khūb"], []), ("خانه", "noun", ["khānah"], []), ("مادر", "noun", ["mādar"], []), ("ماد", "proper-noun", ["mād"], []), ("سر", "noun", ["sar", "sir"], [])]
    return spark.createDataFrame(rows, "normalized string, category string, canonicals array<string>, izafat_after array<string>")


def test_tokens_and_relations(spark, lexicon):
    docs = spark.createDataFrame([(1, "کتاب خوب, خانۀ بد"), (2, None), (3, "")], "id long, t string")
    tokens = R.token_table(docs, "id", "t").cache()
    rows = {(r.idx): (r.surface, r.start, r.end, r["class"]) for r in tokens.where("id = 1").collect()}
    assert rows[0] == ("کتاب", 0, 4, "persian-word") and rows[2] == ("خوب", 5, 8, "persian-word") and rows[3][3] == "punctuation"
    assert tokens.where("id <> 1").count() == 0
    got = {(r.src_idx, r.next_idx): r.relation for r in R.relations(tokens, lexicon, "id").collect()}
    assert got == {(0, 2): "CURATED_LEXICAL_CONTEXT", (5, 7): "EXPLICIT_HEH_ORTHOGRAPHY"}


def test_suffixes(spark, lexicon):
    words = spark.createDataFrame([(w,) for w in ("کتاب‌ها", "کتابها", "کتابم", "خوب‌تر", "خانه‌ام", "کتاب‌های", "خوب‌ها", "خانهم", "مادر", "سرم", "تر")], "w string")
    got = {(r.w, r.type): (r.stem, r.status, r.explicit_izafat, r["rank"]) for r in R.suffix_proposals(words, "w", lexicon).collect()}
    assert got["کتاب‌ها", "PLURAL_HA"] == ("کتاب", "CONFIRMED", False, 1)
    assert got["کتابها", "PLURAL_HA"] == ("کتاب", "CANDIDATE", False, 1)
    assert got["کتابم", "POSSESSIVE_1SG"] == ("کتاب", "CONFIRMED", False, 1)
    assert got["خوب‌تر", "COMPARATIVE_TAR"] == ("خوب", "CONFIRMED", False, 1)
    assert got["کتاب‌های", "PLURAL_HA"] == ("کتاب", "CONFIRMED", True, 1)
    assert got["خوب‌ها", "PLURAL_HA"][1] == "CONFLICT"
    assert got["خانهم", "POSSESSIVE_1SG"][1] == "CANDIDATE"
    assert not any(w in ("تر", "مادر") for w, _ in got)
    done = {r.w: (r.state, r.canonical) for r in R.resolve_suffix(R.suffix_proposals(words, "w", lexicon), lexicon).collect()}
    assert done["کتاب‌ها"] == ("LEXICON_RESOLVED", "kitāb-hā") and done["سرم"][0] == "AMBIGUOUS"


def test_cascade_and_rollup(spark, lexicon):
    tokens = spark.createDataFrame([(1, 0, "کتاب"), (1, 1, "سر"), (2, 0, "نو"), (3, 0, "خوب")], "id long, idx int, lookup string")
    forms = lexicon.select(F.col("normalized").alias("form"), "canonicals")
    first = spark.createDataFrame([("کتاب", ["KITAB"])], "form string, canonicals array<string>")
    out = R.cascade(tokens, "lookup", [("AUTHORITY", first), ("LEXICON", forms)]).cache()
    got = {(r.id, r.idx): (r.source, r.state, r.canonical) for r in out.collect()}
    assert got == {(1, 0): ("AUTHORITY", "LEXICON_RESOLVED", "KITAB"), (1, 1): ("LEXICON", "AMBIGUOUS", None), (2, 0): (None, "UNRESOLVED", None), (3, 0): ("LEXICON", "LEXICON_RESOLVED", "khūb")}
    assert {r.id: r.status for r in R.document_status(out, "id").collect()} == {1: "AMBIGUOUS", 2: "UNRESOLVED", 3: "LEXICON_RESOLVED"}
    marks = spark.createDataFrame([(1, 0, "-i")], "id long, src_idx int, mark string")
    assert {r.id: r.rendered for r in R.render_documents(out, "id", "canonical", marks).collect()}[1] == "KITAB-i"


def test_published_authority(spark):
    entries = spark.createDataFrame([("a", "p", "TITLE", "A1", "PUBLISHED"), ("a", "p", "PERSON_NAME", "A2", "PUBLISHED"), ("b", "p", "PERSON_NAME", "B", "PUBLISHED"), ("c", "p", "TITLE", "C1", "PUBLISHED"), ("c", "p", "TITLE", "C2", "PUBLISHED"), ("d", "p", "TITLE", "D", "WITHDRAWN")], "normalized string, profile string, context string, canonical string, status string")
    phrases = spark.createDataFrame([(i, x, "p", "TITLE") for i, x in enumerate("abcd")], "phrase_id int, normalized string, profile string, context string")
    assert {r.normalized: (r.state, r.canonical) for r in R.published_authority(phrases, entries).collect()} == {"a": ("RESOLVED", "A1"), "b": ("RESOLVED", "B"), "c": ("AMBIGUOUS", None), "d": ("NONE", None)}


def test_decisions_reach_a_fixpoint(spark):
    tokens = spark.createDataFrame([(1, 0, "x", "AMBIGUOUS", None, "i0"), (1, 1, "x", "AMBIGUOUS", None, "i1"), (1, 2, "y", "UNRESOLVED", None, "i2"), (2, 0, "z", "UNRESOLVED", None, "i3")], "id long, idx int, lookup string, state string, canonical string, issue_id string")
    decisions = spark.createDataFrame([(1, "i0", "ACCEPT", "X"), (1, "i2", "REJECT", None), (1, "gone", "ACCEPT", "Q")], "id long, issue_id string, action string, value string")
    got = {(r.id, r.idx): (r.state, r.canonical, r.applied) for r in R.apply_decisions(tokens, decisions, "id").collect()}
    assert got == {(1, 0): ("USER_OVERRIDE", "X", True), (1, 1): ("USER_OVERRIDE", "X", False), (1, 2): ("UNRESOLVED", None, True), (2, 0): ("UNRESOLVED", None, False)}
    assert [r.issue_id for r in R.stale_decisions(decisions, tokens).collect()] == ["gone"]


@pytest.mark.parametrize("word,roman,profile,want", [
    ("کتاب", "ketâb", "IRANIAN", ("DETERMINISTIC", "kitāb")), ("کتاب", "kitāb", "CLASSICAL_DARI", ("DIRECT", "kitāb")), ("آب", "âb", "IRANIAN", ("DETERMINISTIC", "āb")), ("نو", "now", "IRANIAN", ("DETERMINISTIC", "naw")),
    ("این", "in", "IRANIAN", ("DETERMINISTIC", "īn")), ("او", "u", "IRANIAN", ("DETERMINISTIC", "ū")), ("عدل", "'adl", "IRANIAN", ("DETERMINISTIC", "ʿadl")), ("شیر", "šir", "IRANIAN", ("DETERMINISTIC", "shīr")), ("گل", "gol", "IRANIAN", ("DETERMINISTIC", "gul")),
    ("گل", "gul", "IRANIAN", ("NOT_ALIGNED", None)), ("خانه", "xâne", "IRANIAN", ("SILENT_HEH", None)), ("شیر", "šēr", "IRANIAN", ("MAJHUL_VOWEL", None)), ("کتاب", "ketâbi", "IRANIAN", ("NOT_ALIGNED", None)), ("کتاب", "x", "UNCLASSIFIED", ("PROFILE_NOT_USABLE", None)), ("کتاب", None, "IRANIAN", ("NO_ROMANIZATION", None)),
])
def test_transducer(word, roman, profile, want):
    assert transduce(word, roman, profile) == want


def test_profile_recovery(spark):
    rows = spark.createDataFrame([("r", "گل", 1, None, 0, "gol", "UNCLASSIFIED"), ("r", "گل", 1, None, 1, "gul", "UNCLASSIFIED"), ("s", "بد", 1, None, 0, "bad", "UNCLASSIFIED")], "record_id string, form string, etymology int, head int, idx int, romanization string, profile string")
    assert {(r.record_id, r.idx): r.effective_profile for r in recover_profiles(rows).collect()} == {("r", 0): "IRANIAN", ("r", 1): "CLASSICAL_DARI", ("s", 0): "UNCLASSIFIED"}


def test_tiers_of_profile_recovery(spark):
    """Each row of a record against the rules by hand: tags, then templates, then pairs of what is left."""
    schema = "record_id string, form string, etymology int, head int, idx int, romanization string, profile string, templates array<struct<name:string,args:map<string,string>>>"
    template = lambda *a: [(n, dict(kv)) for n, kv in a]
    rows = [
        ("tags", "گل", 1, None, 0, "gol", "IRANIAN", None), ("tags", "گل", 1, None, 1, "gul", "UNCLASSIFIED", None), ("tags", "گل", 1, None, 2, "gol", "CONFLICTING", None),
        ("templ", "گل", None, None, 0, " gol ", "UNCLASSIFIED", template(("x", [("tr", "gol")]), ("fa", [("tr", "gol"), ("c", "gol")]))), ("templ", "گل", None, None, 1, "gul", "UNCLASSIFIED", template(("fa", [("c", "gul"), ("tr", "gul")]))),
        ("none", "گل", None, None, 0, "-", "UNCLASSIFIED", template(("fa", [("tr", "-")]))), ("none", "گل", None, None, 1, None, "UNCLASSIFIED", None),
        ("wild", "گل", 1, None, 0, "gol", "UNCLASSIFIED", None), ("wild", "گل", None, 2, 1, "gul", "UNCLASSIFIED", None), ("wild", "گل", 2, None, 2, "gul", "UNCLASSIFIED", None), ("wild", "گل", 1, 3, 3, "gul", "UNCLASSIFIED", None),
        ("both", "بد", 1, None, 0, "bad", "UNCLASSIFIED", None), ("both", "بد", 1, None, 1, "bad", "UNCLASSIFIED", None), ("form", "گل", 1, None, 0, "gol", "UNCLASSIFIED", None), ("form", "گلا", 1, None, 1, "gulā", "UNCLASSIFIED", None),
    ]
    df = spark.createDataFrame(rows, schema)
    out = recover_profiles(df, (("fa", "tr", "IRANIAN"), ("fa", "c", "CLASSICAL_DARI"))).collect()
    got = {(r.record_id, r.idx): (r.effective_profile, r.status, (r.tier or "-")[5:6], r.partners) for r in out}
    no = ("UNCLASSIFIED", "UNRECOVERABLE", "", None)
    assert got == {
        ("tags", 0): ("IRANIAN", "EXPLICIT", "A", None), ("tags", 1): no, ("tags", 2): ("CONFLICTING", "CONFLICTING", "A", None),
        ("templ", 0): ("IRANIAN", "RECOVERED", "B", None), ("templ", 1): ("CLASSICAL_DARI", "RECOVERED", "B", None), ("none", 0): no, ("none", 1): no,
        ("wild", 0): ("IRANIAN", "RECOVERED", "C", [1, 3]), ("wild", 1): ("CLASSICAL_DARI", "RECOVERED", "C", [0]), ("wild", 2): no, ("wild", 3): ("CLASSICAL_DARI", "RECOVERED", "C", [0]),
        ("both", 0): no, ("both", 1): no, ("form", 0): no, ("form", 1): no,
    }
    assert len({r.recovery_id for r in out}) == len(out) and {r.recovery_id for r in recover_profiles(df.repartition(1), (("fa", "tr", "IRANIAN"), ("fa", "c", "CLASSICAL_DARI"))).collect()} == {r.recovery_id for r in out}


def test_issue_ids_name_their_document_and_evidence(spark):
    base = [("a", 0, 0, "w", "p"), ("a", 1, 2, "v", "p"), ("b", 0, 0, "w", "p"), ("b", 1, 2, "u", "p"), ("c", 0, 0, "w", "p"), ("c", 1, 2, "v", "other")]
    tokens = lambda rows: spark.createDataFrame(rows, "doc string, idx int, start int, surface string, proposal string").withColumns({"state": F.lit("UNRESOLVED"), "morph_status": F.lit(None).cast("string"), "unsupported_marks": F.array().cast("array<string>")})
    ids = {(r["doc"], r["idx"]): r["issue_id"] for r in R.review_issues(tokens(base), "doc").collect()}
    assert ids["a", 0] != ids["b", 0] and ids["a", 0] == ids["c", 0] and ids["a", 1] != ids["c", 1] and len(set(ids.values())) == 5
    again = {(r["doc"], r["idx"]): r["issue_id"] for r in R.review_issues(tokens(base[::-1]), "doc").collect()}
    assert again == ids
    decisions = spark.createDataFrame([("b", ids["b", 0])], "doc string, issue_id string")
    without = R.review_issues(tokens([r for r in base if r[0] != "b"]), "doc")
    assert R.stale_decisions(decisions, without).count() == 1


def test_accuracy_counters(spark):
    from textloom.operators import accuracy as A

    token = lambda i, s, c: (i, s, c)
    cases = spark.createDataFrame([
        (1, True, "Ab", ["x"], [token(0, "s", "c"), token(1, "t", "d")], [("f", "K", "v"), ("g", "K", "v")], {"STRUCTURAL": True, "IJMES_POLICY": False}), (2, True, "e\u0301", None, [token(0, "s", "c")], [], {"STRUCTURAL": True}),
        (3, True, "z", [], [token(0, "s", "c")], [("f", "L", "v")], {"STRUCTURAL": False}), (4, False, "z", [], [], [], {}), (5, True, "q", [], [], None, None),
    ], "case_id int, scorable boolean, canonical string, alternatives array<string>, tokens array<struct<idx:int,surface:string,canonical:string>>, features array<struct<id:string,kind:string,expected:string>>, truth map<string,boolean>")
    predictions = spark.createDataFrame([
        (1, "ANSWER", True, "aB ", [token(0, "s", "c"), token(1, "other", "d")], {"f": "v"}, [("STRUCTURAL", "BLOCK"), ("IJMES_POLICY", "INFO")]), (2, "ANSWER", True, "é", [token(0, "s", "no")], {}, []), (3, "TIMEOUT", True, "z", [], {}, []), (5, "ANSWER", True, "q", [], None, None),
    ], "case_id int, class string, valid boolean, proposal string, tokens array<struct<idx:int,surface:string,canonical:string>>, features map<string,string>, signals array<struct<layer:string,severity:string>>")
    counts = A.counters(cases, predictions)
    got = {(r.part, r.name, r.measure): r.n for r in counts.collect() if r.part != "validator"}
    assert got == {
        ("flow", "", "excluded"): 1, ("flow", "", "unalignable"): 1, ("flow", "", "evaluated"): 2, ("flow", "", "timeout"): 1, ("phrase", "", "exact"): 1, ("phrase", "", "accepted"): 1, ("phrase", "", "normalized"): 2, ("phrase", "", "case_only"): 2, ("phrase", "", "unicode_only"): 1,
        ("token", "", "eligible"): 4, ("token", "", "correct"): 1, ("token", "", "incorrect"): 1, ("token", "", "unalignable"): 1, ("token", "", "unsuccessful"): 1, ("feature", "K", "correct"): 1, ("feature", "K", "unevaluable"): 1, ("feature", "L", "unevaluable"): 1,
    }
    layers = {r.layer: (r.detected, r.missed, r.false_warning, r.unflagged, r.uncertain, r.measurable, r.precision, r.recall) for r in A.validator_matrices(counts).collect()}
    assert layers["STRUCTURAL"] == (1, 1, 0, 0, 2, True, 1.0, 0.5) and layers["IJMES_POLICY"] == (0, 0, 0, 1, 3, True, None, None) and layers["LINGUISTIC_REVIEW"] == (0, 0, 0, 0, 4, False, None, None)


def test_eligibility_cascade(spark):
    titles = ["", "کتاب خوب من", "کتاب خوب من", "abc", "کتاب abcdefg", "کتب", "کتابخانه", None]
    df = spark.createDataFrame([(i, t, "fa") for i, t in enumerate(titles)] + [(99, "کتاب خوب من", "en")], "id int, t string, lang string")
    got = {r.id: r.reason for r in C.title_eligibility(df, "t", "lang", ["id"]).collect()}
    assert got == {0: "EMPTY_TITLE", 1: None, 2: "DUPLICATE_NORMALIZED_TITLE", 3: "ONLY_PUNCTUATION_OR_NUMBERS", 4: "PRIMARY_LATIN_METADATA", 5: "INSUFFICIENT_ARABIC_SCRIPT", 6: "FEWER_THAN_TWO_PERSIAN_TOKENS", 7: "EMPTY_TITLE", 99: "NOT_LANGUAGE_FA"}


def test_accuracy(spark):
    refs = spark.createDataFrame([(1, "A", ["a"]), (2, "B", ["bb"]), (3, "C", [])], "case_id int, canonical string, alternatives array<string>")
    preds = spark.createDataFrame([(1, "A"), (2, "bb")], "case_id int, proposal string")
    r = C.accuracy(refs, preds).first()
    assert (r.cases, r.answered, r.exact, r.accepted) == (3, 2, 1, 2) and 0 < r.exact_interval.low < r.exact_interval.estimate < r.exact_interval.high


def test_lineage_and_closure(spark):
    ev = spark.createDataFrame([("p", None, "abcdef", None, None), ("c1", "p", "bcd", 1, 4), ("c2", "p", "xx", 0, 2), ("c3", "q", "a", 0, 1), ("c4", "c1", "b", 0, 1)], "evidence_id string, parent_id string, text string, start int, end int")
    assert {r.evidence_id: r.finding for r in E.derivation_breaks(ev).collect()} == {"c2": "SPAN_MISMATCH", "c3": "MISSING_PARENT", "c4": "NESTED_DERIVATION"}
    cands = spark.createDataFrame([("k", ["e1", "e2"]), ("l", ["e3"])], "candidate_id string, evidence_ids array<string>")
    have = spark.createDataFrame([("k", "e1"), ("l", "e3"), ("m", "e9")], "candidate_id string, evidence_id string")
    assert {r.candidate_id: (r.missing, r.extra) for r in E.closure_breaks(cands, have).collect()} == {"k": (["e2"], []), "m": ([], ["e9"])}


def test_routing_policies_differ(spark):
    columns = "id int, whole_state string, whole_canonical string, strength string, morph_state string, morph_canonical string, fallback string, marks boolean, vowels boolean"
    tokens = spark.createDataFrame([
        (1, "LEXICON_RESOLVED", "w", "COMPETING_REVIEWED", "AMBIGUOUS", None, "f", False, False), (2, None, None, "CANDIDATE_SHAPE_ONLY", "UNRESOLVED", None, "f", False, False),
        (3, None, None, "CANDIDATE_SHAPE_ONLY", "UNRESOLVED", None, "f", False, True), (4, None, None, "COMPETING_REVIEWED", "AMBIGUOUS", None, "f", False, False),
        (5, None, None, "CONFIRMED_REVIEWED", "LEXICON_RESOLVED", "s-t", "f", False, False), (6, None, None, None, None, None, "f", False, True), (7, None, None, None, None, None, "f", False, False),
        (8, "LEXICON_RESOLVED", "w", None, None, None, None, True, False)], columns)
    answers = lambda policy: {r.id: (r.state, r.canonical, r.proposal) for r in R.routed(tokens, policy).collect()}
    now, safe = answers("CURRENT_PRODUCTION"), answers("SAFE_WHOLE_WORD_EVIDENCE")
    assert now[1] == ("AMBIGUOUS", None, None) and safe[1] == ("LEXICON_RESOLVED", "w", None)
    assert now[2] == ("UNRESOLVED", None, None) and safe[2] == ("UNRESOLVED", None, "f")
    assert now[3] == safe[3] == ("UNRESOLVED", None, None)
    assert now[4] == ("AMBIGUOUS", None, None) and safe[4] == ("UNRESOLVED", None, "f")
    assert now[5] == safe[5] == ("LEXICON_RESOLVED", "s-t", None)
    assert now[6] == ("UNRESOLVED", None, "f") and safe[6] == ("UNRESOLVED", None, None)
    assert now[7] == safe[7] == ("UNRESOLVED", None, "f") and now[8] == safe[8] == ("UNRESOLVED", None, None)
    with pytest.raises(ValueError):
        R.routed(tokens, "OTHER")


def test_seven_rules_of_review(spark):
    tokens = spark.createDataFrame([
        (1, "UNRESOLVED", "CANDIDATE", True, True, ["x"], None, None), (2, "UNRESOLVED", "CANDIDATE", False, True, ["x"], None, None), (3, "UNRESOLVED", None, None, None, ["x"], "INSUFFICIENT_VOCALIZATION", None),
        (4, "UNRESOLVED", None, None, None, [], "INSUFFICIENT_VOCALIZATION", "p"), (5, "AMBIGUOUS", None, None, None, [], None, "p"), (6, "UNRESOLVED", None, None, None, [], None, "p"),
        (7, "UNRESOLVED", None, None, None, [], None, None), (8, "LEXICON_RESOLVED", "CANDIDATE", True, True, ["x"], None, None)],
        "idx int, state string, morph_status string, whole_word boolean, allomorph boolean, unsupported_marks array<string>, blocking string, proposal string").withColumns({"doc": F.lit(1), "start": F.col("idx"), "surface": F.lit("w")})
    found = R.review_issues(tokens, "doc")
    assert {r.idx: r.issue_type for r in found.collect()} == {
        1: "MORPHOLOGY_AMBIGUITY", 2: "UNSUPPORTED_ALLOMORPH", 3: "UNSUPPORTED_ORTHOGRAPHIC_EVIDENCE", 4: "INSUFFICIENT_VOCALIZATION", 5: "LEXICAL_AMBIGUITY", 6: "EVIDENCE_DERIVED_READING", 7: "UNKNOWN_TOKEN"}
    assert [x.start for x in R.in_order(found, "doc").first()["issues"]] == [1, 2, 3, 4, 5, 6, 7]
    relations = spark.createDataFrame([(1, 0, "CANDIDATE", None), (1, 2, "CANDIDATE", "REJECTED"), (1, 4, "CONFIRMED", None)], "doc int, src_idx int, status string, disposition string")
    assert [(r.idx, r.issue_type) for r in R.relation_issues(relations, "doc").collect()] == [(0, "IZAFAT_CANDIDATE")]
    states = spark.createDataFrame([(1, "LEXICON_RESOLVED")], "doc int, state string")
    assert R.document_status(states, "doc", "state", relations).first()["status"] == "AMBIGUOUS"


def test_small_counts_bytes(spark, monkeypatch):
    df = spark.createDataFrame([("x" * 100,)] * 50, "v string")
    hinted = lambda: "ResolvedHint" in R.small(df)._jdf.queryExecution().analyzed().toString()
    assert hinted()
    monkeypatch.setattr(R, "BROADCAST_BYTES", 5000)
    assert not hinted()
