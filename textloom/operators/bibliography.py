"""Bibliography batches: long-form fields, readiness, export gates, CSV, RIS and BibTeX text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

# Record types in the two formats.
RIS_TYPES = {"BOOK": "BOOK", "JOURNAL_ARTICLE": "JOUR", "BOOK_CHAPTER": "CHAP", "THESIS": "THES"}
BIBTEX_TYPES = {"BOOK": "book", "JOURNAL_ARTICLE": "article", "BOOK_CHAPTER": "incollection", "THESIS": "phdthesis"}
#: Final states of a field.
AUTHORITATIVE = ("PASSTHROUGH", "DETERMINISTIC", "LEXICON_RESOLVED", "USER_OVERRIDE")
AUDIT = ("record_id", "readiness", "review_issues", "invalid_reasons")


def field_profile(path: Column) -> Column:
    """FLT5: profile by which a field is rendered; null for fields that stay as they are."""
    return F.when(path.isin("title", "containerTitle"), "ijmes_citation_title").when(path.rlike(r"^(authors|editors|translators)\.") | path.isin("publisher", "place"), "ijmes_full")


def long_fields(records: DataFrame) -> DataFrame:
    """Rendered fields of records in long form: record_id, path, source_text."""
    single = F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).alias("source_text")) for c in ("title", "containerTitle", "publisher", "place")))

    def names(kind: str) -> Column:
        return F.transform(kind, lambda x, k: F.struct(F.concat(F.lit(f"{kind}."), k.cast("string"), F.lit(".literal")).alias("path"), x.alias("source_text")))

    people = [names(kind) for kind in ("authors", "editors", "translators")]
    every = F.filter(F.concat(single, *people), lambda f: f["source_text"].isNotNull())
    return records.select("record_id", F.explode(every).alias("f")).select("record_id", "f.*")


def field_states(fields: DataFrame, resolved: DataFrame) -> DataFrame:
    """DOM20: PASSTHROUGH for other scripts; else the resolution of the text, by (source text, profile)."""
    out = fields.withColumn("profile", field_profile(F.col("path"))).withColumn("arabic", T.contains_arabic(F.col("source_text")))
    known = resolved.select("source_text", "profile", F.col("status").alias("_s"), F.col("rendered").alias("_r"), F.col("issues").alias("_i"))
    out = out.join(known, ["source_text", "profile"], "left")
    stays = F.col("profile").isNull() | ~F.col("arabic")
    final = F.col("_s").isin("DETERMINISTIC", "LEXICON_RESOLVED", "USER_OVERRIDE")
    status = F.when(stays, "PASSTHROUGH").when(final, F.col("_s")).when(F.col("_s") == "AMBIGUOUS", "REVIEW_REQUIRED").otherwise("UNRESOLVED")
    return out.select("record_id", "path", "source_text", "profile", status.alias("status"), F.when(stays, F.col("source_text")).when(final, F.col("_r")).alias("final_text"), F.when(stays, 0).otherwise(F.coalesce("_i", F.lit(0))).alias("issues"))


def readiness(records: DataFrame, fields: DataFrame) -> DataFrame:
    """AGG30/32: READY, REVIEW_REQUIRED or INVALID by record, with reasons; duplicate ids and missing titles are invalid."""
    state = fields.groupBy("record_id").agg(F.sum("issues").alias("review_issues"), F.bool_or(~F.col("status").isin(*AUTHORITATIVE)).alias("_open"))
    twice = records.groupBy("record_id").agg(F.count("*").alias("_n"))
    out = records.join(state, "record_id", "left").join(twice, "record_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("_n") > 1, "DUPLICATE_RECORD_ID"), F.when(F.coalesce(T.unicode_trim(F.col("title")), F.lit("")) == "", "MISSING_TITLE")))
    out = out.withColumn("invalid_reasons", reasons).withColumn("review_issues", F.coalesce("review_issues", F.lit(0)))
    level = F.when(F.size("invalid_reasons") > 0, "INVALID").when(F.coalesce("_open", F.lit(False)) | (F.col("review_issues") > 0), "REVIEW_REQUIRED").otherwise("READY")
    return out.withColumn("readiness", level).drop("_open", "_n")


def batch_summary(processed: DataFrame) -> DataFrame:
    """AGG31"""
    return processed.agg(F.count("*").alias("total"), *(F.count_if(F.col("readiness") == x).alias(x.lower()) for x in ("READY", "REVIEW_REQUIRED", "INVALID")))


def export_findings(records: DataFrame, fields: DataFrame) -> DataFrame:
    """SNK5: expected fields that are missing, differ from their source, are not final, or hold placeholders."""
    wanted = long_fields(records)
    got = fields.select("record_id", "path", F.col("source_text").alias("_src"), "status", "final_text")
    both = wanted.join(got, ["record_id", "path"], "full")
    finding = (
        F.when(F.col("_src").isNull(), "MISSING_FIELD")
        .when(F.col("source_text").isNull(), "UNEXPECTED_FIELD")
        .when(F.col("_src") != F.col("source_text"), "SOURCE_MISMATCH")
        .when(~F.col("status").isin(*AUTHORITATIVE), "NOT_AUTHORITATIVE")
        .when(F.coalesce(F.col("final_text"), F.lit("")) == "", "EMPTY_FINAL_TEXT")
        .when(F.col("final_text").rlike("⟦|⟧"), "PLACEHOLDER")
    )
    return both.withColumn("finding", finding).where("finding IS NOT NULL").select("record_id", "path", "finding")


def _final(records: DataFrame, fields: DataFrame) -> DataFrame:
    """Records with a map of their fields' final texts."""
    texts = fields.where("final_text IS NOT NULL").groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "final_text"))).alias("final"))
    return records.join(texts, "record_id", "left")


def gate(processed: DataFrame, findings: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Exportable and skipped records. STRICT_ALL exports all or none; READY_ONLY what is ready."""
    broken = findings.groupBy("record_id").agg(F.array_sort(F.collect_set("finding")).alias("findings"))
    out = processed.join(broken, "record_id", "left").withColumn("ok", (F.col("readiness") == "READY") & F.col("findings").isNull())
    if mode == "STRICT_ALL":
        all_ok = out.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("_all"))
        out = out.crossJoin(F.broadcast(all_ok)).withColumn("ok", F.col("_all")).drop("_all")
    elif mode != "READY_ONLY":
        raise ValueError(mode)
    return out.where("ok").drop("ok", "findings"), out.where("NOT ok").select("record_id", "readiness", "invalid_reasons", "review_issues", "findings")


def _people(kind: str) -> Column:
    """Final names of a record's people, in order."""
    names = F.transform(kind, lambda _, k: F.try_element_at("final", F.concat(F.lit(f"{kind}."), k.cast("string"), F.lit(".literal"))))
    return F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")


def ris(records: DataFrame, fields: DataFrame) -> DataFrame:
    """SNK3: one CRLF block for each record."""
    kind = F.lit("GEN")
    for k, v in RIS_TYPES.items():
        kind = F.when(F.col("type") == k, v).otherwise(kind)
    tag = lambda t, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{t}  - "), T.ris_value(c)))
    final = lambda p: F.try_element_at("final", F.lit(p))
    many = lambda t, c: F.transform(_people(c), lambda n: F.concat(F.lit(f"{t}  - "), T.ris_value(n)))
    one = lambda *cols: F.array_compact(F.array(*cols))
    lines = F.concat(
        one(F.concat(F.lit("TY  - "), kind), tag("TI", final("title")), tag("T2", final("containerTitle"))), many("AU", "authors"), many("ED", "editors"),
        one(tag("PY", F.col("year")), tag("PB", final("publisher")), tag("CY", final("place")), tag("VL", F.col("volume")), tag("IS", F.col("issue")), tag("SP", F.col("pageStart")), tag("EP", F.col("pageEnd")),
            tag("DO", F.col("doi")), tag("UR", F.col("url")), tag("SN", F.coalesce("isbn", "issn")), tag("LA", F.col("language")), tag("N1", F.col("notes")), F.lit("ER  - ")),
    )
    return _final(records, fields).select("record_id", F.array_join(lines, "\r\n").alias("block"))


def bibtex(records: DataFrame, fields: DataFrame) -> DataFrame:
    """SNK4: entries with their keys; ``collision`` marks keys that several records share, which must stop an export."""
    kind = F.lit("misc")
    for k, v in BIBTEX_TYPES.items():
        kind = F.when(F.col("type") == k, v).otherwise(kind)
    item = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), T.bibtex_value(c), F.lit("}")))
    final = lambda p: F.try_element_at("final", F.lit(p))
    people = lambda name, c: F.when(F.size(_people(c)) > 0, F.concat(F.lit(f"  {name} = {{"), F.array_join(F.transform(_people(c), T.bibtex_value), " and "), F.lit("}")))
    pages = F.when(F.col("pageStart").isNotNull() & F.col("pageEnd").isNotNull(), F.concat_ws("--", "pageStart", "pageEnd")).otherwise(F.coalesce("pageStart", "pageEnd"))
    container = final("containerTitle")
    lines = F.array_compact(F.array(
        item("title", final("title")), people("author", "authors"), people("editor", "editors"),
        F.when(F.col("type") == "JOURNAL_ARTICLE", item("journal", container)).otherwise(item("booktitle", container)), item("year", F.col("year")), item("publisher", final("publisher")), item("address", final("place")),
        item("volume", F.col("volume")), item("number", F.col("issue")), item("pages", pages), item("doi", F.col("doi")), item("url", F.col("url")), item("isbn", F.col("isbn")), item("issn", F.col("issn")),
        item("language", F.col("language")), item("note", F.col("notes")),
    ))
    out = _final(records, fields).withColumn("key", T.bibtex_key(F.col("record_id")))
    shared = out.groupBy("key").agg((F.count("*") > 1).alias("collision"))
    entry = F.concat(F.lit("@"), kind, F.lit("{"), F.col("key"), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
    return out.join(shared, "key").select("record_id", "key", entry.alias("entry"), "collision")


def review_csv(processed: DataFrame) -> DataFrame:
    """SNK1/7/8: source cells by position and audit columns, one text line for each record."""
    audit = [F.col(c).cast("string") if c != "invalid_reasons" else F.array_join(c, "; ") for c in AUDIT]
    cells = F.concat("cells", F.array(*(F.coalesce(a, F.lit("")) for a in audit)))
    return processed.select("record_id", F.array_join(F.transform(cells, T.csv_cell), ",").alias("line"))


def sheet(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SNK7/8: a review sheet: the given columns as one CSV line for each row."""
    return rows.select(F.array_join(F.transform(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), T.csv_cell), ",").alias("line"))


def final_csv(records: DataFrame, fields: DataFrame, columns: list[str]) -> DataFrame:
    """SNK2: final values in columns, then the sorted union of passthrough headers."""
    heads = [r["h"] for r in records.select(F.explode(F.map_keys("passthrough")).alias("h")).distinct().orderBy("h").collect()]
    final = lambda p: F.try_element_at("final", F.lit(p))
    values = []
    for c in columns:
        if c in ("authors", "editors", "translators"):
            # One open name blanks the whole cell.
            values.append(F.when(F.size(_people(c)) == F.size(c), F.array_join(_people(c), " | ")))
        else:
            values.append(final(c) if c in ("title", "containerTitle", "publisher", "place") else F.col(c))
    values += [F.try_element_at("passthrough", F.lit(h)) for h in heads]
    line = F.array_join(F.transform(F.array(*(F.coalesce(v.cast("string"), F.lit("")) for v in values)), T.csv_cell), ",")
    return _final(records, fields).select("record_id", line.alias("line"))


def creators_cell(fields: DataFrame) -> DataFrame:
    """One open name blanks a record's creators."""
    people = fields.where(F.col("path").rlike(r"^authors\."))
    place = F.regexp_extract("path", r"\.(\d+)\.", 1).cast("int")
    return people.groupBy("record_id").agg(F.when(F.count_if(F.col("final_text").isNull()) == 0, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("k"), "final_text"))), lambda x: x["final_text"]), " | ")).alias("creators"))
