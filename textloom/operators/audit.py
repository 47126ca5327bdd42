"""Audits and summaries of acquired evidence, corpora and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from textloom.functions import text as T


def acquisition_summary(obs: DataFrame) -> DataFrame:
    """AGG1/4/11: rows, distinct entries, raw and normalised forms, romanisations and duplicates, in two steps.

    Distinct counts go through one group-by over their joint key first.
    """
    keys = obs.groupBy("entry_id", "word", "normalized", "romanization", "evidence_id").agg(F.count("*").alias("n"))
    return keys.agg(
        F.sum("n").alias("observations"), F.count_distinct("evidence_id").alias("unique_observations"), F.count_distinct("entry_id").alias("entries"),
        F.count_distinct("word").alias("raw_forms"), F.count_distinct("normalized").alias("normalized_forms"), F.count_distinct("romanization").alias("romanizations"),
    ).withColumn("duplicates", F.col("observations") - F.col("unique_observations"))


def funnel(rows: DataFrame, shares: dict[str, Column], distinct: dict[str, Column], variants: dict[str, tuple[Column, Column]]) -> DataFrame:
    """AGG11: many distributions and distinct counts of one scan, as ``part, name, value, n``.

    Every row makes a tagged key for each measure, and tagged keys are counted together, map-side first. ``shares``: rows by value (null
    is a value). ``distinct``: TOTAL rows with the key, DISTINCT keys, REPEATED keys and SURPLUS rows beyond the first of their key.
    ``variants`` (key, value): keys by their number of different values, as a number; null values are none.
    """
    tag = lambda part, name, key, value: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    none = F.lit(None).cast("string")
    tags = [tag("share", n, none, c) for n, c in shares.items()]
    tags += [F.when(c.isNotNull(), tag("distinct", n, c, none)) for n, c in distinct.items()]
    tags += [F.when(k.isNotNull(), tag("variants", n, k, v)) for n, (k, v) in variants.items()]
    counted = rows.select(F.explode(F.array_compact(F.array(*tags))).alias("t")).groupBy("t.part", "t.name", "t.key", "t.value").agg(F.count("*").alias("n"))
    out = counted.where("part = 'share'").select("part", "name", "value", "n")
    facts = {"TOTAL": F.sum("n"), "DISTINCT": F.count("*"), "REPEATED": F.count_if(F.col("n") > 1), "SURPLUS": F.sum(F.col("n") - 1)}
    wide = counted.where("part = 'distinct'").groupBy("name").agg(*(f.cast("long").alias(k) for k, f in facts.items()))
    out = out.unionByName(wide.select(F.lit("distinct").alias("part"), "name", F.explode(F.array(*(F.struct(F.lit(k).alias("value"), F.col(k).alias("n")) for k in facts))).alias("f")).select("part", "name", "f.*"))
    many = counted.where("part = 'variants'").groupBy("name", "key").agg(F.count("value").cast("string").alias("value")).groupBy("name", "value").agg(F.count("*").alias("n"))
    return out.unionByName(many.select(F.lit("variants").alias("part"), "name", "value", "n"))


def multiplicity(rows: DataFrame, key: str, value: str) -> DataFrame:
    """AGG3: keys with no, one or many different values."""
    n = rows.groupBy(key).agg(F.count_distinct(value).alias("n"))
    return n.groupBy(F.when(F.col("n") == 0, "NONE").when(F.col("n") == 1, "ONE").otherwise("MANY").alias("bucket")).agg(F.count("*").alias("keys"))


def diagnostic_index(obs: DataFrame) -> DataFrame:
    """AGG12: what is known of each form."""
    return obs.groupBy("normalized").agg(
        F.bool_or(F.col("romanization").isNotNull()).alias("romanized"), F.bool_or(F.col("lemma") == "LEMMA").alias("lemma"), F.count("*").alias("n"),
        F.array_sort(F.collect_set("pos")).alias("parts_of_speech"), F.array_sort(F.collect_set("profile")).alias("profiles"),
    )


def surface_shapes(words: DataFrame, form: str) -> DataFrame:
    """AGG13: how many tokens have each surface shape."""
    w = F.col(form)
    return words.agg(
        F.count("*").alias("tokens"), F.count_if(w.contains(T.ZWNJ)).alias("joined"), F.count_if(w.endswith("ها")).alias("plural"), F.count_if(w.endswith("های")).alias("plural_izafat"),
        F.count_if(w.rlike("(تر|ترین)$")).alias("compared"), F.count_if(w.rlike("(مان|تان|شان)$")).alias("possessive"), F.count_if(w.rlike("^ن?می")).alias("verbal_prefix"), F.count_if(w.endswith("ی")).alias("final_yeh"),
    )


def membership_audit(rows: DataFrame, key: str, sets: dict[str, DataFrame]) -> DataFrame:
    """JON25: in which of several sets each key is, and the share of rows in none, to one decimal of a percent."""
    out = rows
    for name, df in sets.items():
        out = out.join(df.select(F.col(df.columns[0]).alias(key), F.lit(True).alias(f"in_{name}")).distinct(), key, "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    flags = [F.col(f"in_{name}") for name in sets]
    free = ~F.greatest(*flags) if len(flags) > 1 else ~flags[0]
    return out.agg(F.count("*").alias("rows"), *(F.count_if(f"in_{name}").alias(name) for name in sets), F.count_if(free).alias("outside"), F.round(F.count_if(free) / F.count("*") * 100, 1).alias("outside_percent"))


def family_duplicates(rows: DataFrame, ident: str, families: dict[str, Column], order: str, sense: str | None = None) -> DataFrame:
    """AGG27: by each key family the first row stands; later ones repeat it, unless their sense differs."""
    parts = None
    for name, key in families.items():
        keyed = rows.where(key.isNotNull()).select(ident, order, *([sense] if sense else []), key.alias("_k"))
        lead = keyed.groupBy("_k").agg(F.min_by(F.struct(F.col(ident).alias("i"), *([F.col(sense).alias("s")] if sense else [])), order).alias("_f"))
        again = keyed.join(lead, "_k").where(F.col(ident) != F.col("_f.i"))
        if sense:
            again = again.where(F.col(sense).eqNullSafe(F.col("_f.s")))
        again = again.select(ident, F.col("_f.i").alias("first"), F.lit(name).alias("family"))
        parts = again if parts is None else parts.unionByName(again)
    return parts


def expected_fields(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """AGG22: CORRECT, OVER_BLOCKED, UNDER_BLOCKED, FALSE or MISSING for each expected field."""
    both = expected.join(actual, keys, "left")
    final = F.col("actual_state") == "FINAL"
    return both.withColumn(
        "outcome",
        F.when(F.col("actual_state").isNull(), "MISSING").when((F.col("expected_state") == "FINAL") & final, F.when(F.col("expected_text") == F.col("actual_text"), "CORRECT").otherwise("FALSE"))
        .when(F.col("expected_state") == "FINAL", "OVER_BLOCKED").when(final, "UNDER_BLOCKED").otherwise("CORRECT"),
    )


def governance(status: Column, adjudication: Column, adopted: Column) -> list[tuple[str, Column]]:
    """FLT11: rules between a candidate's status and its adjudication, for ``store.violations``."""
    return [
        ("ADOPTED_WITHOUT_DECISION", (status != "ADOPTED") | (adjudication == "ACCEPTED")),
        ("REJECTED_BUT_ADOPTED", (adjudication != "REJECTED") | ~adopted),
        ("UNKNOWN_STATUS", status.isin("CANDIDATE", "ADOPTED", "REJECTED", "CONFLICT")),
    ]


def pair_titles(titles: DataFrame, record: str) -> DataFrame:
    """DOM19: the Persian title of a record and how its Latin variants (``relationship``) stand to it; ``ord`` is the input order."""
    kind = T.script_class(F.col("title"))
    persian = F.array_sort(F.collect_list(F.when(kind == "PERSIAN_SCRIPT", F.struct("ord", "title"))))
    by = titles.groupBy(record).agg(persian.alias("_p"), F.count("*").alias("_n"), F.count_if(kind == "LATIN_ONLY").alias("_l"), F.count_if((kind == "LATIN_ONLY") & F.col("relationship").eqNullSafe(F.lit("ROMANIZATION"))).alias("_r"))
    n = F.size("_p")
    state = (
        F.when((n == 0) & (F.col("_l") == F.col("_n")), "LATIN_ONLY").when(n != 1, "UNCERTAIN_LANGUAGE_OR_PAIRING").when(F.col("_l") == 0, "PERSIAN_ONLY")
        .when(F.col("_r") > 1, "MULTIPLE_ROMANIZATION_VARIANTS").when(F.col("_r") == 1, "PERSIAN_WITH_OBSERVED_ROMANIZATION").otherwise("UNCERTAIN_LANGUAGE_OR_PAIRING")
    )
    return by.select(record, state.alias("state"), F.get("_p", F.lit(0))["title"].alias("persian_title"))


def _alignments(words: list[str], readings: list[list[str]], target: str, most: int = 2) -> list[list[int]]:
    """Choices of one reading a word that make the target text; at most ``most`` are looked for."""
    found: list[list[int]] = []
    dead: set[tuple[int, int]] = set()

    def walk(k: int, at: int, chosen: list[int]) -> bool:
        if len(found) >= most:
            return True
        if k == len(words):
            if at == len(target):
                found.append(list(chosen))
                return True
            return False
        if (k, at) in dead:
            return False
        any_found = False
        for i, r in enumerate(readings[k]):
            piece = r + (" " if k + 1 < len(words) else "")
            if target.startswith(piece, at):
                any_found |= walk(k + 1, at + len(piece), [*chosen, i])
        if not any_found:
            dead.add((k, at))
        return any_found

    walk(0, 0, [])
    return found


@F.pandas_udf(StructType([StructField("state", StringType()), StructField("choice", ArrayType(IntegerType()))]))
def align_readings(words, readings, target):
    """DOM22: UNIQUE, AMBIGUOUS or NONE for the choice of readings that makes a text."""
    import pandas as pd

    rows = []
    for w, r, t in zip(words, readings, target):
        found = _alignments(list(w), [list(x) for x in r], t) if w is not None and t is not None else []
        rows.append(("NONE", None) if not found else ("UNIQUE", found[0]) if len(found) == 1 else ("AMBIGUOUS", None))
    return pd.DataFrame(rows, columns=["state", "choice"])


def verify_sources(accepted: DataFrame, events: DataFrame, candidates: DataFrame) -> DataFrame:
    """STO7: accepted reviews whose event is missing, is not the latest, or whose basis has changed."""
    from textloom.operators.selection import latest_per_key

    last = latest_per_key(events, ["candidate_id"], ["decided_at", "event_id"]).select("candidate_id", F.col("event_id").alias("_last"))
    own = events.select("event_id", F.col("basis_sha256").alias("_basis"))
    now = candidates.select("candidate_id", F.col("basis_sha256").alias("_now"))
    both = accepted.join(own, "event_id", "left").join(last, "candidate_id", "left").join(now, "candidate_id", "left")
    finding = F.when(F.col("_basis").isNull(), "MISSING_EVENT").when(F.col("event_id") != F.col("_last"), "SUPERSEDED").when(~F.col("_basis").eqNullSafe(F.col("_now")), "BASIS_CHANGED")
    return both.withColumn("finding", finding).where("finding IS NOT NULL").select("candidate_id", "event_id", "finding")


def verify_package(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """STO14/HSH10: files that are missing, extra or changed against a manifest (path, sha256)."""
    have = files.select("path", F.sha2("content", 256).alias("_h"))
    both = manifest.join(have, "path", "full")
    finding = F.when(F.col("_h").isNull(), "MISSING").when(F.col("sha256").isNull(), "EXTRA").when(F.col("_h") != F.col("sha256"), "CHANGED")
    return both.withColumn("finding", finding).where("finding IS NOT NULL").select("path", "finding")


def amendments_applied(amendments: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """MSC15: amendments (key, field, value) that their case does not show (field -> value map)."""
    both = amendments.join(cases.select(key, "fields"), key, "left")
    return both.where(~F.coalesce(F.try_element_at("fields", F.col("field")).eqNullSafe(F.col("value")), F.lit(False))).select(key, "field", "value")


def review_packet(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """MSC5/7: a candidate with its evidence in order and the hash of what a reviewer sees."""
    lists = evidence.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "text"))).alias("evidence"))
    out = candidates.join(lists, "candidate_id", "left")
    return out.withColumn("review_basis_sha256", F.sha2(F.to_json(F.struct("candidate_id", "evidence")), 256))


def decision_findings(decisions: DataFrame, packets: DataFrame) -> DataFrame:
    """MSC7: decisions without a packet, on a stale one, or with an unknown disposition."""
    own = packets.select("candidate_id", F.col("review_basis_sha256").alias("_now"))
    both = decisions.join(own, "candidate_id", "left")
    finding = F.when(F.col("_now").isNull(), "UNKNOWN_CANDIDATE").when(F.col("review_basis_sha256") != F.col("_now"), "STALE").when(~F.col("disposition").isin("ACCEPT", "REJECT", "DEFER"), "UNKNOWN_DISPOSITION")
    return both.withColumn("finding", finding).where("finding IS NOT NULL").select("candidate_id", "finding")


def intercepted(baseline: DataFrame, experiment: DataFrame, keys: list[str]) -> DataFrame:
    """MSC10: tokens by what happened to them between two routings."""
    both = baseline.select(*keys, F.col("state").alias("before")).join(experiment.select(*keys, F.col("state").alias("after")), keys, "full")
    change = F.when(F.col("before").isNull() | F.col("after").isNull(), "UNALIGNED").when(F.col("before") == F.col("after"), "SAME").when(F.col("after") == "LEXICON_RESOLVED", "GAINED").when(F.col("before") == "LEXICON_RESOLVED", "LOST").otherwise("MOVED")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG38: one row with the count of each table."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(F.broadcast(n))
    return out


def field_presence(df: DataFrame, fields: list[str]) -> DataFrame:
    """AGG28/41: how many rows have each field (not null, not empty)."""
    present = lambda c: F.count_if(F.col(c).isNotNull() & (F.length(F.col(c).cast("string")) > 0))
    one = df.agg(F.count("*").alias("rows"), *(present(c).alias(c) for c in fields))
    return one.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in fields))).alias("f")).select("f.field", "f.present", "rows")


def observability(df: DataFrame) -> DataFrame:
    """AGG41: how often every field is there, at any depth of structs and arrays: ``path, rows, places, present``.

    ``rows`` have the field at least once, of ``places`` where it could stand ``present`` hold it (null, and empty texts and arrays, do
    not). A path names struct fields by dots and elements of arrays by ``[]``. The paths come from the schema; one scan, one row.
    """
    found: list[tuple[str, Column]] = []

    def visit(path: str, kind, values: Column) -> None:
        found.append((path, values))
        if isinstance(kind, StructType):
            for field in kind.fields:
                visit(f"{path}.{field.name}", field.dataType, F.transform(values, _field(field.name)))
        elif isinstance(kind, ArrayType):
            visit(f"{path}[]", kind.elementType, F.flatten(F.filter(values, lambda v: v.isNotNull())))

    for field in df.schema.fields:
        visit(field.name, field.dataType, F.array(F.col(field.name)))
    measures = []
    for k, (path, values) in enumerate(found):
        n = F.size(F.filter(values, _held))
        measures.append(F.struct(F.lit(path).alias("path"), F.count_if(n > 0).alias("rows"), F.coalesce(F.sum(F.size(values)), F.lit(0)).alias("places"), F.coalesce(F.sum(n), F.lit(0)).alias("present")).alias(f"m{k}"))
    one = df.agg(*measures)
    return one.select(F.explode(F.array(*one.columns)).alias("m")).select("m.*")


def _field(name: str):
    return lambda v: v[name]


def _held(v: Column) -> Column:
    return v.isNotNull() & ~F.coalesce(F.to_json(F.struct(v.alias("v"))).isin('{"v":""}', '{"v":[]}'), F.lit(False))


def reviewed_agreement(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """AGG40: forms and evidence by what reviewed readings say of them.

    ``forms``: normalized, hypothesis (null without a unanimous one), evidence_count; ``lexicon``: normalized, canonicals. AGREES, DISAGREES or
    NO_HYPOTHESIS where the form is reviewed, NOT_REVIEWED else; with the share of the forms that can be compared.
    """
    both = forms.join(lexicon.select("normalized", "canonicals"), "normalized", "left")
    outcome = F.when(F.col("canonicals").isNull(), "NOT_REVIEWED").when(F.col("hypothesis").isNull(), "NO_HYPOTHESIS").when(F.array_contains("canonicals", F.col("hypothesis")), "AGREES").otherwise("DISAGREES")
    counts = both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("forms"), F.sum("evidence_count").alias("evidence"))
    compared = F.col("outcome").isin("AGREES", "DISAGREES")
    total = counts.where(compared).agg(F.sum("forms").alias("_t"))
    return counts.join(F.broadcast(total)).withColumn("share", F.when(compared, F.round(F.col("forms") / F.col("_t"), 6))).drop("_t")


def ordered_json(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """AGG37: each key's rows as one JSON list, in order of their columns; a key's rows are the largest group."""
    return rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("items"))


def pilot_metrics(linked: DataFrame) -> DataFrame:
    """AGG39: linked fields and records by status."""
    by = linked.groupBy("status", "record_id").agg(F.count("*").alias("n"))
    return by.groupBy("status").agg(F.sum("n").alias("fields"), F.count("*").alias("records"))


def interpretation_report(forms: DataFrame) -> DataFrame:
    """AGG40: forms and evidence by the consensus of their hypotheses."""
    return forms.groupBy("consensus").agg(F.count("*").alias("forms"), F.sum("evidence_count").alias("evidence"))


# Lexicon categories of entity types.
CATEGORIES = {"PERSON": "proper-noun", "PLACE": "proper-noun", "WORD": "noun"}


def entity_category(kind: Column) -> Column:
    """MSC6: the lexicon category of an entity type."""
    out = F.lit("unmapped")
    for k, v in CATEGORIES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def validate_candidates(rows: DataFrame, ident: str, rules: list[tuple[str, Column]], families: dict[str, Column], order: str, known: DataFrame, key: str) -> DataFrame:
    """MSC14: one list of findings of schema rules, duplicates by key family, and overlap with known keys."""
    from textloom.operators.store import violations

    schema = violations(rows, rules, [ident]).select(ident, F.concat(F.lit("SCHEMA:"), "violation").alias("finding"))
    twice = family_duplicates(rows, ident, families, order).select(ident, F.concat(F.lit("DUPLICATE:"), "family").alias("finding"))
    overlap = rows.join(known.select(key).distinct(), key, "left_semi").select(ident, F.lit("OVERLAP").alias("finding"))
    return schema.unionByName(twice).unionByName(overlap)


def review_candidates(rows: DataFrame) -> DataFrame:
    """MSC17: eligible rows as a reviewer's candidates."""
    return rows.where("eligibility = 'ELIGIBLE'").select("candidate_id", "surface")


def triage(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """DOM24: a row's class by its id; ids without a rule are UNCLASSIFIED."""
    from textloom.operators.resolve import small

    return rows.join(small(rules.select("id", F.col("triage").alias("_t"))), "id", "left").withColumn("triage", F.coalesce("_t", F.lit("UNCLASSIFIED"))).drop("_t")


def rule_registry(spark) -> DataFrame:
    """MSC3: the consonant rules as a dimension table: letter, rendering, and whether that is one letter."""
    rows = [(k, v, "SINGLE" if len(v) == 1 else "MULTIPLE") for k, v in T.CONSONANTS.items()]
    return spark.createDataFrame(rows, "letter string, rendering string, status string")
