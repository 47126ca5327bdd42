"""The ledger against one decision after another."""

from pyspark.sql import functions as F

from textloom.operators import ledger as L

REQUEST = "seq long, packet_id string, basis string, candidate_id string, disposition string, kind string, canonical string, reviewer string, rationale string, decided_at string"
PACKET = "candidate_id string, packet_id string, basis string, normalized string, hypotheses array<string>"
KEPT = "decision_id string, packet_id string, basis string, candidate_id string, normalized string, disposition string, kind string, canonical string, reviewer string, rationale string, decided_at string"
S, M = L.KINDS


def requests(spark, rows):
    return spark.createDataFrame(rows, REQUEST)


def packets(spark):
    return spark.createDataFrame([("a", "p", "b", "w", ["x", "y"]), ("c", "q", "d", "w", ["x"]), ("e", "r", "g", "v", None)], PACKET)


def test_outcomes_in_order(spark):
    rows = [
        (1, "p", "b", "a", "ACCEPT", S, "x", "me", "why", "t1"), (2, "p", "b", "a", "ACCEPT", S, "x", "me", "why", "t1"), (3, "p", "b", "a", "ACCEPT", S, "x", "me", "else", "t1"), (4, "p", "b", "a", "ACCEPT", S, "z", "me", "why", "t1"),
        (5, "p", "b", "a", "ACCEPT", M, "z", "me", "why", "t1"), (6, "p", "b", "a", "REJECT", None, "x", "me", "why", "t1"), (7, "p", "b", "a", "REJECT", None, None, "me", "why", "t1"), (8, "old", "b", "a", "DEFER", None, None, "me", "why", "t1"),
        (9, "p", "old", "a", "DEFER", None, None, "me", "why", "t1"), (10, "p", "b", "none", "DEFER", None, None, "me", "why", "t1"), (11, "p", "b", "a", "PERHAPS", None, None, "me", "why", "t1"), (12, "p", "b", "a", "ACCEPT", None, None, "me", "why", "t1"),
        (13, "p", "b", "a", "ACCEPT", "GUESS", "x", "me", "why", "t1"), (14, "p", "b", "a", "DEFER", None, None, None, "why", "t1"), (15, "p", "b", "a", "DEFER", None, None, "me", " ", "t1"), (16, "r", "g", "e", "ACCEPT", S, "x", "me", "why", "t1"),
    ]
    empty = spark.createDataFrame([], KEPT)
    kept, outcomes = L.record_decisions(empty, requests(spark, rows), packets(spark))
    got = {r["seq"]: r["reason"] or r["outcome"] for r in outcomes.collect()}
    assert got == {
        1: "RECORDED", 2: "IDEMPOTENT", 3: "VIOLATION", 4: "NOT_A_HYPOTHESIS", 5: "RECORDED", 6: "SELECTION_NOT_ALLOWED", 7: "RECORDED", 8: "STALE_PACKET", 9: "STALE_BASIS", 10: "NO_CANDIDATE", 11: "UNKNOWN_DISPOSITION",
        12: "SELECTION_MISSING", 13: "UNKNOWN_KIND", 14: "MISSING_REVIEWER", 15: "MISSING_RATIONALE", 16: "NOT_A_HYPOTHESIS",
    }
    kept = spark.createDataFrame(kept.collect(), KEPT)
    assert kept.count() == 3
    again, outcomes = L.record_decisions(kept, requests(spark, [(1, *rows[0][1:]), (2, *rows[2][1:]), (3, "p", "b", "a", "ACCEPT", S, "y", "me", "why", "t2")]), packets(spark))
    assert {r["seq"]: r["outcome"] for r in outcomes.collect()} == {1: "IDEMPOTENT", 2: "VIOLATION", 3: "RECORDED"} and again.count() == 4


def test_promotion_and_its_receipts(spark):
    rows = [
        (1, "p", "b", "a", "ACCEPT", S, "x", "me", "why", "t2"), (2, "q", "d", "c", "ACCEPT", M, "n", "me", "why", "t1"), (3, "q", "d", "c", "ACCEPT", M, "n", "you", "why", "t3"), (4, "r", "g", "e", "ACCEPT", M, "k", "me", "why", "t1"),
        (5, "r", "g", "e", "ACCEPT", M, "l", "you", "why", "t1"), (6, "p", "b", "a", "REJECT", None, None, "you", "why", "t9"),
    ]
    kept, _ = L.record_decisions(spark.createDataFrame([], KEPT), requests(spark, rows), packets(spark))
    none = spark.createDataFrame([], "decision_id string")
    made, after = L.promote(kept, none, spark.createDataFrame([("u", ["1"])], "normalized string, canonicals array<string>"), "me", "now")
    assert [(r["canonical"], r["action"], r["base_readings"], r["result_readings"]) for r in made.join(kept.select("decision_id", "decided_at"), "decision_id").orderBy("decided_at").collect()] == [
        ("n", "CREATE_ENTRY", [], ["n"]), ("x", "ADD_READING", ["n"], ["n", "x"]), ("n", "ALREADY_PRESENT", ["n", "x"], ["n", "x"]),
    ]
    assert {r["normalized"]: r["canonicals"] for r in after.collect()} == {"u": ["1"], "w": ["n", "x"]}  # v has two accepted readings on one basis
    assert L.receipt_findings(made, kept).count() == 0
    assert L.promote(kept, made, after, "me", "later")[0].count() == 0
    one = made.where("canonical = 'x'")
    bad = {
        "INCOMPLETE": one.withColumn("promoter", F.lit("")), "ORPHAN": one.withColumn("decision_id", F.lit("no")), "OTHER_CANONICAL": one.withColumn("canonical", F.lit("z")), "OTHER_CANDIDATE": one.withColumn("basis", F.lit("z")),
        "CHANGED_WITHOUT_ACTION": one.withColumn("action", F.lit("ALREADY_PRESENT")), "OTHER_ID": one.withColumn("promoted_at", F.lit("then")), "PROMOTED_TWICE": one.unionByName(one).limit(2),
        "NOT_ACCEPTED": one.withColumn("decision_id", F.lit(kept.where("disposition = 'REJECT'").first()["decision_id"])),
    }
    for finding, receipts in bad.items():
        assert {r["finding"] for r in L.receipt_findings(receipts, kept).collect()} == {finding}


def test_promotion_gathers_no_decisions(spark):
    """A form with very many decisions: each finds the readings before it, without a window or list over the others."""
    n = 60_000
    decided = spark.range(n).select(
        F.format_string("d%06d", "id").alias("decision_id"), F.format_string("b%d", "id").alias("basis"), F.format_string("c%d", "id").alias("candidate_id"), F.lit("w").alias("normalized"), F.lit("ACCEPT").alias("disposition"),
        F.when(F.col("id") < n // 2, "x").otherwise(F.when(F.col("id") % 2 == 0, "y").otherwise("z")).alias("canonical"), F.lit("t").alias("decided_at"))
    made, after = L.promote(decided, spark.createDataFrame([], "decision_id string"), spark.createDataFrame([("w", ["z"])], "normalized string, canonicals array<string>"), "me", "now")
    got = {(tuple(r["base_readings"]), r["action"]): (r["n"], r["first"]) for r in made.groupBy("base_readings", "action").agg(F.count("*").alias("n"), F.min("decision_id").alias("first")).collect()}
    assert got == {(("z",), "ADD_READING"): (1, "d000000"), (("x", "z"), "ALREADY_PRESENT"): (n // 2 - 1, "d000001"), (("x", "z"), "ADD_READING"): (1, "d030000"), (("x", "y", "z"), "ALREADY_PRESENT"): (n // 2 - 1, "d030001")}
    assert [tuple(r) for r in after.collect()] == [("w", ["x", "y", "z"])]
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
