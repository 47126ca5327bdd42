"""SRC5-9, SRC12, SRC14-17: dictionary lines, MARC XML, catalogue JSON, title lists, tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.sources import marc_xml

ENTRY = """word string, lang string, lang_code string, pos string, tags array<string>, etymology_number string, head_nr int,
forms array<struct<form:string,tags:array<string>,raw_tags:array<string>,source:string,ipa:string,romanization:string,head_nr:int>>,
sounds array<struct<ipa:string,tags:array<string>,raw_tags:array<string>,note:string>>,
senses array<struct<id:string,senseid:array<string>,glosses:array<string>,tags:array<string>,form_of:array<struct<word:string,extra:string>>,alt_of:array<struct<word:string,extra:string>>>>,
head_templates array<struct<name:string>>, _corrupt_record string"""

#: Bounds of a collection file: as of a page, but with any number of records that fits its size.
COLLECTION = marc_xml.Bounds(records=1_000_000)

#: Bounds of one record.
MAX_FIELDS, MAX_SUBFIELDS, MAX_VALUE = 1_000, 10_000, 100_000

#: Byte ranges of files that are broadcast as a small table; beyond it lines are dealt by range.
BROADCAST_SPANS = 500_000


def _by_span(rows: DataFrame, spans: DataFrame, scan: DataFrame) -> DataFrame:
    """``rows`` with their span's columns; spans are broadcast where the files cannot have more than ``BROADCAST_SPANS``.

    ``scan`` reads the files and does nothing else, so that asking for its partitions plans it and runs nothing.
    """
    most = scan.rdd.getNumPartitions() + len(scan.inputFiles())  # a partition holds whole files or ranges of them
    return rows.join(F.broadcast(spans) if most <= BROADCAST_SPANS else spans.hint("merge"), ["file", "span"])


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, span, line, value`` of text files: the byte range that Spark read a line in, and its number in the file, from 1.

    Lines are counted range by range (no shuffle of lines) and the counts are added up within each
    file; a line's number does not depend on how files are cut.
    """
    raw = spark.read.text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("span"), F.monotonically_increasing_id().alias("_at"), "value")
    earlier = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = raw.groupBy("file", "span").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    spans = spans.select("file", "span", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")).alias("_shift"))
    return _by_span(raw, spans, raw).select("file", "span", (F.col("_at") + F.col("_shift")).alias("line"), "value")


def dictionary(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """SRC5-7: JSON lines (gzip by name) with malformed lines kept, or refused if ``strict``.

    ``entry_id`` is the file's name and the line's number, so equal lines have different ids and ids do
    not depend on how files are split. Blank lines count but are no rows.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("e", F.from_json("value", ENTRY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    if strict:
        message = F.concat(F.lit("malformed JSON at line "), F.col("line").cast("string"), F.lit(" of "), "file")
        parsed = parsed.withColumn("line", F.when(F.col("e._corrupt_record").isNotNull(), F.raise_error(message).cast("long")).otherwise(F.col("line")))
    name = F.element_at(F.split("file", "/"), -1)
    return parsed.select(F.concat_ws("#", name, F.col("line").cast("string")).alias("entry_id"), "file", "span", "line", "e.*")


def valid_range(entries: DataFrame, offset: int = 0, limit: int | None = None, rejected: bool = False) -> DataFrame:
    """SRC5/SRT11: valid rows (``reason`` is null) from ``offset`` on, at most ``limit``, in order of files and lines; ``rank`` counts valid rows.

    With ``rejected`` the other rows that a reader would meet before it stops come, too. Valid rows are counted
    range by range; only ranges that the window touches are numbered, each for itself. Entries without
    places (``file, span, line``) go in the order of their ids.
    """
    end = None if limit is None else offset + limit
    valid = F.col("reason").isNull()
    if not {"file", "span", "line"} <= set(entries.columns):
        from textloom.operators.selection import running

        ranked = running(entries.where(valid), ["entry_id"]).where(F.col("rank") > offset)
        return (ranked if end is None else ranked.where(F.col("rank") <= end)).drop("rank")
    earlier = Window.orderBy("file", "span").rowsBetween(Window.unboundedPreceding, -1)
    spans = entries.groupBy("file", "span").agg(F.count_if(valid).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    touched = F.lit(True) if end is None else F.col("_before") < end
    spans = spans.where(touched if rejected else touched & (F.col("_before") + F.col("_n") > offset)).select("file", "span", "_before")
    inside = Window.partitionBy("file", "span").orderBy("line")
    ranked = _by_span(entries if rejected else entries.where(valid), spans, entries.sparkSession.read.text(entries.inputFiles()))
    ranked = ranked.withColumn("rank", F.col("_before") + F.sum(valid.cast("long")).over(inside)).drop("_before")
    stops = F.lit(True) if end is None else F.col("rank") < end + valid.cast("int")
    return ranked.where(stops & (~valid | (F.col("rank") > offset)))


def dictionary_range(spark: SparkSession, path: str, judge: Callable[[DataFrame], DataFrame], offset: int, limit: int, rejected: bool = False) -> DataFrame:
    """:func:`valid_range` of files, with an early end: files are counted in the order of their names, twice as many each time, until the window is full.

    ``judge`` adds ``reason``. Later files are never opened.
    """
    names = sorted(spark.read.text(path).inputFiles())
    taken, found, step = 0, 0, 1
    while taken < len(names) and found < offset + limit:
        found += judge(dictionary(spark, names[taken : taken + step])).where("reason IS NULL").count()
        taken, step = taken + step, 2 * step
    return valid_range(judge(dictionary(spark, names[:taken] or path)), offset, limit, rejected)


def marc(spark: SparkSession, path: str, strict: bool = False, xml: bool = True) -> DataFrame:
    """SRC8: MARC records of the good collections below a path, with or without their canonical text; :func:`refused_xml` has the others."""
    return marc_xml.page_records(marc_xml.read_pages(spark, path, "COLLECTION", strict, COLLECTION, xml))


def refused_xml(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Files of a folder whose records :func:`marc` leaves out: ``path, reason``."""
    return marc_xml.refused_pages(marc_xml.read_pages(spark, path, "COLLECTION", strict, COLLECTION))


def bounded_records(records: DataFrame) -> DataFrame:
    """SRC9: MARC records with the bound they break, if any."""
    subfields = F.aggregate("datafield", F.lit(0), lambda n, d: n + F.coalesce(F.size(d["subfield"]), F.lit(0)))
    longest = F.array_max(F.flatten(F.transform("datafield", lambda d: F.transform(d["subfield"], lambda s: F.coalesce(F.length(s["_VALUE"]), F.lit(0))))))
    reason = F.when(F.size("datafield") > MAX_FIELDS, "TOO_MANY_FIELDS").when(subfields > MAX_SUBFIELDS, "TOO_MANY_SUBFIELDS").when(longest > MAX_VALUE, "VALUE_TOO_LONG")
    return records.withColumn("bound", reason)


def marc_fields(records: DataFrame) -> DataFrame:
    """A row for each subfield: record_id, place, tag, code, value."""
    fields = _datafields(records).select("record_id", "place", "tag", F.explode("subfield").alias("s"))
    return fields.select("record_id", "place", "tag", F.col("s._code").alias("code"), F.col("s._VALUE").alias("value"))


def marc_links(records: DataFrame) -> DataFrame:
    """A row for each field with subfields: record_id, place, tag, linkage ($6), value ($a); of repeated subfields the greatest, as text."""
    of = lambda code: F.array_max(F.transform(F.filter("subfield", lambda s: s["_code"] == code), lambda s: s["_VALUE"]))
    return _datafields(records).where(F.size("subfield") > 0).select("record_id", "place", "tag", of("6").alias("linkage"), of("a").alias("value"))


def _datafields(records: DataFrame) -> DataFrame:
    ident = F.filter("controlfield", lambda c: c["_tag"] == "001")[0]["_VALUE"]
    fields = records.select(ident.alias("record_id"), F.posexplode("datafield").alias("place", "d"))
    return fields.select("record_id", "place", F.col("d._tag").alias("tag"), F.col("d.subfield").alias("subfield"))


def deduplicated_records(records: DataFrame, ident: str, checksum: str) -> tuple[DataFrame, DataFrame]:
    """SRC11: one row for each id (that of the least checksum, then of the least other columns), and ids that come with different content."""
    from textloom.operators.selection import first_wins

    conflicts = records.groupBy(ident).agg(F.count_distinct(checksum).alias("n")).where("n > 1")
    return first_wins(records, [ident], [checksum, *(c for c in records.columns if c not in (ident, checksum))]), conflicts


def catalogue_items(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: catalogue JSON whose fields may be a text or a list."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = raw.select(F.explode(F.variant_get("v", "$.items", "array<variant>")).alias("i"))
    many = lambda p: F.coalesce(F.try_variant_get("i", p, "array<string>"), F.array_compact(F.array(F.try_variant_get("i", p, "string"))))
    one = lambda p: F.try_variant_get("i", p, "string")
    return items.select(one("$['@id']").alias("id"), many("$.title").alias("titles"), many("$['dc:creator']").alias("creators"), one("$['dc:publisher']").alias("publisher"), many("$['dc:language']").alias("languages"), one("$['prism:publicationDate']").alias("date"))


def title_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: a private list, one title a line."""
    return spark.read.text(path).select(F.trim("value").alias("title")).where("title <> ''")


def json_document(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """SRC15: documents that are whole files, or one a line."""
    return spark.read.schema(schema).json(path, multiLine=not lines)
