"""STO12: an append-only ledger of review decisions, and their promotion into a lexicon.

Decisions and receipts are named by their content, so what comes twice is no change, and
what comes otherwise under a name that is taken is a violation; nothing is ever updated. All of a
batch is judged at once, as if its rows came one after the other in the order of ``seq``: the
first of an id stands, later ones are compared with it. Ids and forms are grouped with
map-side minima; no group's decisions are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.hashing import content_id

DISPOSITIONS = ("ACCEPT", "REJECT", "DEFER")
KINDS = ("SELECT_SCHEME_HYPOTHESIS", "MANUAL_CANONICAL")
#: What a decision is; the ledger's columns are these and ``decision_id``.
DECISION = ("packet_id", "basis", "candidate_id", "normalized", "disposition", "kind", "canonical", "reviewer", "rationale", "decided_at")
#: What names a decision.
_NAMED = ("packet_id", "candidate_id", "reviewer", "disposition", "kind", "canonical", "decided_at")
RECEIPT = ("decision_id", "candidate_id", "basis", "normalized", "canonical", "action", "base_readings", "result_readings", "promoter", "promoted_at")


def _named(columns: tuple[str, ...], prefix: str) -> Column:
    return content_id(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns), prefix=prefix)


def _content(columns: tuple[str, ...]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def judged_requests(requests: DataFrame, packets: DataFrame) -> DataFrame:
    """Requests with the first reason against each, if any, by the live packet of its candidate, and their decision id.

    ``requests``: seq and the columns of a decision but ``normalized``; ``packets``: candidate_id, packet_id, basis, normalized, hypotheses.
    """
    live = packets.select("candidate_id", F.col("packet_id").alias("_packet"), F.col("basis").alias("_basis"), "normalized", "hypotheses")
    both = requests.join(live, "candidate_id", "left")
    accepted = F.col("disposition") == "ACCEPT"
    chosen = F.col("kind").isNotNull() | F.col("canonical").isNotNull()
    reason = (
        F.when(_blank("reviewer"), "MISSING_REVIEWER")
        .when(_blank("rationale"), "MISSING_RATIONALE")
        .when(F.col("_packet").isNull(), "NO_CANDIDATE")
        .when(~F.col("packet_id").eqNullSafe(F.col("_packet")), "STALE_PACKET")
        .when(~F.col("basis").eqNullSafe(F.col("_basis")), "STALE_BASIS")
        .when(~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False)), "UNKNOWN_DISPOSITION")
        .when(~accepted & chosen, "SELECTION_NOT_ALLOWED")
        .when(accepted & (F.col("kind").isNull() | _blank("canonical")), "SELECTION_MISSING")
        .when(accepted & ~F.col("kind").isin(*KINDS), "UNKNOWN_KIND")
        .when(accepted & (F.col("kind") == KINDS[0]) & ~F.coalesce(F.array_contains("hypotheses", F.col("canonical")), F.lit(False)), "NOT_A_HYPOTHESIS")
    )
    return both.withColumn("reason", reason).withColumn("decision_id", _named(_NAMED, "decision-")).drop("_packet", "_basis", "hypotheses")


def append(ledger: DataFrame, judged: DataFrame, ident: str, content: tuple[str, ...]) -> DataFrame:
    """``judged`` rows with their ``outcome``: REFUSED (by ``reason``), RECORDED, IDEMPOTENT or VIOLATION. ``seq`` tells rows apart."""
    good = judged.where("reason IS NULL")
    stood = ledger.select(ident, F.lit(None).cast("long").alias("seq"), _content(content).alias("_c")).unionByName(good.select(ident, F.col("seq").cast("long").alias("seq"), _content(content).alias("_c")))
    first = stood.groupBy(ident).agg(F.min_by(F.struct("_c", "seq"), F.coalesce("seq", F.lit(-1))).alias("_first"))
    out = judged.join(first, ident, "left")
    outcome = F.when(F.col("reason").isNotNull(), "REFUSED").when(F.col("_first.seq").eqNullSafe(F.col("seq").cast("long")), "RECORDED").when(F.col("_first._c") == _content(content), "IDEMPOTENT").otherwise("VIOLATION")
    return out.withColumn("outcome", outcome).drop("_first")


def record_decisions(ledger: DataFrame, requests: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger after a batch of requests, and every request's outcome."""
    outcomes = append(ledger, judged_requests(requests, packets), "decision_id", DECISION)
    return ledger.unionByName(outcomes.where("outcome = 'RECORDED'").select("decision_id", *DECISION)), outcomes


def promote(ledger: DataFrame, receipts: DataFrame, lexicon: DataFrame, promoter: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Receipts of all decisions that may be promoted, and the lexicon (normalized, canonicals) after them.

    A decision is promoted if it accepts, has no receipt, and no other decision accepts another reading on the same basis. Those of a
    form take their turns by time and id: the first new reading of an unknown form creates its entry, other new readings are
    added, known ones are there already. What a form had at a turn is known from the first turn of each of its readings, so
    no decisions are gathered, however many a form has; a form's different readings are held together, as in its entry.
    """
    accepts = ledger.where("disposition = 'ACCEPT'")
    torn = accepts.groupBy("basis").agg((F.min("canonical") != F.max("canonical")).alias("_torn")).where("_torn").select("basis")
    todo = accepts.join(torn, "basis", "left_anti").join(receipts.select("decision_id"), "decision_id", "left_anti")
    have = lexicon.select("normalized", F.array_sort("canonicals").alias("_have"))
    none = F.array().cast("array<string>")
    turn = F.struct("decided_at", "decision_id")
    firsts = todo.groupBy("normalized", "canonical").agg(F.min(turn).alias("first")).groupBy("normalized").agg(F.collect_list(F.struct("canonical", "first")).alias("_firsts"))
    forms = firsts.join(have, "normalized", "left").withColumnRenamed("normalized", "_form")
    rows = todo.join(forms, F.col("normalized").eqNullSafe(F.col("_form")), "left").withColumn("_turn", turn)
    earlier = F.transform(F.filter("_firsts", lambda f: f["canonical"].isNotNull() & (f["first"] < F.col("_turn"))), lambda f: f["canonical"])
    rows = rows.withColumn("base_readings", F.array_sort(F.array_distinct(F.concat(F.coalesce("_have", none), F.coalesce(earlier, none)))))
    known = F.array_contains("base_readings", F.col("canonical"))
    action = F.when(known, "ALREADY_PRESENT").when(F.size("base_readings") > 0, "ADD_READING").otherwise("CREATE_ENTRY")
    rows = rows.withColumns({"action": action, "result_readings": F.when(known, F.col("base_readings")).otherwise(F.array_sort(F.array_append("base_readings", F.col("canonical")))), "promoter": F.lit(promoter), "promoted_at": F.lit(at)})
    made = rows.select(_named(RECEIPT, "receipt-").alias("receipt_id"), *RECEIPT)
    grown = firsts.select("normalized", F.transform("_firsts", lambda f: f["canonical"]).alias("_new"))
    after = lexicon.select("normalized", "canonicals").join(grown, "normalized", "full").select("normalized", F.array_sort(F.array_union(F.coalesce("canonicals", none), F.coalesce("_new", none))).alias("canonicals"))
    return made, after


def receipt_findings(receipts: DataFrame, ledger: DataFrame) -> DataFrame:
    """``receipt_id, finding``: receipts that their decision, or their own content, does not bear out; the first reason of each."""
    said = ledger.select("decision_id", *(F.col(c).alias(f"_{c}") for c in ("disposition", "canonical", "candidate_id", "basis", "normalized")))
    twice = receipts.groupBy("decision_id").agg(F.count("*").alias("_n"))
    both = receipts.join(said, "decision_id", "left").join(twice, "decision_id")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    finding = (
        F.when(_blank("promoter") | _blank("promoted_at"), "INCOMPLETE")
        .when(F.col("_disposition").isNull(), "ORPHAN")
        .when(F.col("_disposition") != "ACCEPT", "NOT_ACCEPTED")
        .when(differs("canonical"), "OTHER_CANONICAL")
        .when(differs("candidate_id") | differs("basis") | differs("normalized"), "OTHER_CANDIDATE")
        .when((F.col("action") == "ALREADY_PRESENT") & ~F.col("base_readings").eqNullSafe(F.col("result_readings")), "CHANGED_WITHOUT_ACTION")
        .when(F.col("receipt_id") != _named(RECEIPT, "receipt-"), "OTHER_ID")
        .when(F.col("_n") > 1, "PROMOTED_TWICE")
    )
    return both.select("receipt_id", finding.alias("finding")).where("finding IS NOT NULL")
