from pyspark.sql import functions as F

from textloom.operators import audit as A
from textloom.operators.store import violations


def test_reading_alignment(spark):
    rows = [(["a", "b"], [["x", "x y"], ["z", "y z"]], "x z"), (["a", "b"], [["x", "x y"], ["z", "y z"]], "x y z"), (["a"], [["q"]], "w"), (None, None, "w")]
    df = spark.createDataFrame(rows, "w array<string>, r array<array<string>>, t string").select(A.align_readings("w", "r", "t").alias("o"))
    assert [r.o.state for r in df.collect()] == ["UNIQUE", "AMBIGUOUS", "NONE", "NONE"]


def test_title_pairs(spark):
    rows = [(1, 0, "کتاب", None), (1, 1, "Kitab", "ROMANIZATION"), (2, 0, "Kitab", None), (3, 0, "کتاب", None), (3, 1, "پنج", None), (3, 2, "Kitab", None), (4, 0, "کتاب", None), (5, 0, "باب", None), (5, 1, "Bab", None)]
    df = spark.createDataFrame(rows, "r int, ord int, title string, relationship string")
    want = {1: ("PERSIAN_WITH_OBSERVED_ROMANIZATION", "کتاب"), 2: ("LATIN_ONLY", None), 3: ("UNCERTAIN_LANGUAGE_OR_PAIRING", "کتاب"), 4: ("PERSIAN_ONLY", "کتاب"), 5: ("UNCERTAIN_LANGUAGE_OR_PAIRING", None)}
    assert {r.r: (r.state, r.persian_title) for r in A.pair_titles(df, "r").collect()} == want


def test_verification(spark):
    events = spark.createDataFrame([("e1", "c1", 1, "b"), ("e2", "c1", 2, "b"), ("e3", "c2", 1, "b")], "event_id string, candidate_id string, decided_at int, basis_sha256 string")
    cands = spark.createDataFrame([("c1", "b"), ("c2", "new")], "candidate_id string, basis_sha256 string")
    accepted = spark.createDataFrame([("c1", "e1"), ("c1", "e2"), ("c2", "e3"), ("c3", "e9")], "candidate_id string, event_id string")
    assert {(r.candidate_id, r.event_id): r.finding for r in A.verify_sources(accepted, events, cands).collect()} == {("c1", "e1"): "SUPERSEDED", ("c2", "e3"): "BASIS_CHANGED", ("c3", "e9"): "MISSING_EVENT"}


def test_package_and_amendments(spark):
    files = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("x", b"3")], "path string, content binary")
    sha = {r.path: r.h for r in files.select("path", F.sha2("content", 256).alias("h")).collect()}
    manifest = spark.createDataFrame([("a", sha["a"]), ("b", sha["a"]), ("c", "0")], "path string, sha256 string")
    assert {r.path: r.finding for r in A.verify_package(files, manifest).collect()} == {"b": "CHANGED", "c": "MISSING", "x": "EXTRA"}
    cases = spark.createDataFrame([(1, {"f": "v"})], "k int, fields map<string,string>")
    wanted = spark.createDataFrame([(1, "f", "v"), (1, "g", "v"), (2, "f", "v")], "k int, field string, value string")
    assert {(r.k, r.field) for r in A.amendments_applied(wanted, cases, "k").collect()} == {(1, "g"), (2, "f")}


def test_governance_and_fields(spark):
    df = spark.createDataFrame([(1, "ADOPTED", "ACCEPTED", True), (2, "ADOPTED", "PENDING", True), (3, "REJECTED", "REJECTED", True)], "id int, s string, a string, x boolean")
    assert {(r.id, r.violation) for r in violations(df, A.governance(F.col("s"), F.col("a"), F.col("x")), ["id"]).collect()} == {(2, "ADOPTED_WITHOUT_DECISION"), (3, "REJECTED_BUT_ADOPTED")}
    exp = spark.createDataFrame([(1, "FINAL", "a"), (2, "FINAL", "a"), (3, "FINAL", "a"), (4, "BLOCKED", None), (5, "FINAL", "a")], "k int, expected_state string, expected_text string")
    act = spark.createDataFrame([(1, "FINAL", "a"), (2, "FINAL", "b"), (3, "BLOCKED", None), (4, "FINAL", "x")], "k int, actual_state string, actual_text string")
    assert {r.k: r.outcome for r in A.expected_fields(exp, act, ["k"]).collect()} == {1: "CORRECT", 2: "FALSE", 3: "OVER_BLOCKED", 4: "UNDER_BLOCKED", 5: "MISSING"}


def test_review_packets(spark):
    cands = spark.createDataFrame([("c",), ("d",)], "candidate_id string")
    ev = spark.createDataFrame([("c", "2", "b"), ("c", "1", "a")], "candidate_id string, evidence_id string, text string")
    packets = A.review_packet(cands, ev)
    basis = packets.where("candidate_id = 'c'").first()["review_basis_sha256"]
    assert basis == A.review_packet(cands, ev.orderBy("evidence_id")).where("candidate_id = 'c'").first()["review_basis_sha256"]
    decisions = spark.createDataFrame([("c", basis, "ACCEPT"), ("d", "old", "ACCEPT"), ("e", "x", "ACCEPT"), ("c", basis, "MAYBE")], "candidate_id string, review_basis_sha256 string, disposition string")
    assert sorted((r.candidate_id, r.finding) for r in A.decision_findings(decisions, packets).collect()) == [("c", "UNKNOWN_DISPOSITION"), ("d", "STALE"), ("e", "UNKNOWN_CANDIDATE")]
