"""SRC1-4: strict CSV, and bibliography rows from it.

Spark's own reader is lenient, so files that need diagnostics are read by ranges
(:mod:`textloom.sources.csv_split`); plain CSV whose lines are rows can go through
``spark.read.csv`` (:func:`plain`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.hashing import record_fingerprint
from textloom.operators.selection import occurrence_ids
from textloom.sources.csv_split import Reader, read_rows, scan_rows

# Limits of an import.
MAX_BYTES, MAX_ROWS, MAX_FIELD = 10 * 1024 * 1024, 5_000, 50_000

# Header keys by field.
ALIASES = {
    "id": ("id", "recordid"),
    "type": ("type", "recordtype", "entrytype"),
    "title": ("title", "articletitle", "chaptertitle"),
    "containerTitle": ("containertitle", "booktitle", "journaltitle", "journal", "publication", "container"),
    "authors": ("authors", "author", "creators", "creator"),
    "editors": ("editors", "editor"),
    "translators": ("translators", "translator"),
    "year": ("year", "date", "publicationyear", "pubyear"),
    "publisher": ("publisher",),
    "place": ("place", "city", "address", "location"),
    "volume": ("volume", "vol"),
    "issue": ("issue", "number", "no"),
    "pageStart": ("pagestart", "startpage", "firstpage", "sp"),
    "pageEnd": ("pageend", "endpage", "lastpage", "ep"),
    "doi": ("doi",),
    "url": ("url", "link"),
    "isbn": ("isbn",),
    "issn": ("issn",),
    "language": ("language", "lang"),
    "notes": ("notes", "note", "abstract"),
}

# Spellings of record types.
TYPES = {
    "BOOK": ("book", "monograph"),
    "JOURNAL_ARTICLE": ("journalarticle", "article", "journal"),
    "BOOK_CHAPTER": ("bookchapter", "chapter", "incollection", "inbook"),
    "THESIS": ("thesis", "phdthesis", "mastersthesis", "dissertation"),
    "OTHER": ("other", "misc", "generic"),
}


def parse_csv(text: str) -> tuple[list[list[str]], list[str]]:
    """Rows and errors of one CSV text (header included); rows without any content are left out."""
    text = text.removeprefix("\ufeff")
    rows, errors, found, reader = [], [], [], Reader(False)
    lines = text.split("\n")
    for one in lines[:-1] if lines[-1] == "" else lines:
        found += reader.feed(one)
    if reader.open is not None:
        found += scan_rows("\n".join(reader.open) + "\n" * (lines[-1] == ""), reader.begin, ended=True)[0]
    for cells, problems in found:
        rows += [cells] if cells else []
        errors += problems
    errors += [f"row {k} has {len(r)} fields, the header {len(rows[0])}" for k, r in enumerate(rows[1:], 2) if len(r) != len(rows[0])]
    return rows, errors


def read_strict(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, max_rows: int = MAX_ROWS, max_field: int = MAX_FIELD) -> DataFrame:
    """``path, row, cells, header, errors`` of all files under a path, each read by as many tasks as it has byte ranges.

    Row 0 is the header and has the errors of the file: its own quotes, and limits that the file
    is beyond, whose rows are there all the same. Rows from 1 have their own errors.
    Spark does not open empty files, so they have no rows. Errors name the line on which they stand.
    """
    rows, files = read_rows(spark, path)
    over = F.array_compact(F.array(
        F.when(F.col("bytes") > max_bytes, F.concat(F.lit("the file has "), F.col("bytes").cast("string"), F.lit(f" bytes, more than {max_bytes}"))),
        F.when(F.col("rows") > max_rows, F.lit(f"more than {max_rows} rows")),
    ))
    heads = files.select("path", F.lit(0).cast("long").alias("row"), F.col("header").alias("cells"), "header", F.concat("problems", over).alias("errors"))
    long = F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(f" has a field of over {max_field} characters"))
    data = rows.join(files.select("path", "header"), "path").withColumn("errors", F.when(F.exists("cells", lambda c: F.length(c) > max_field), F.array_append("errors", long)).otherwise(F.col("errors")))
    columns = ["path", F.col("row").cast("long").alias("row"), "cells", "header", "errors"]
    return data.select(*columns).unionByName(heads.select(*columns))


def csv_errors(rows: DataFrame) -> DataFrame:
    """``path, row, error`` of everything that :func:`read_strict` found."""
    return rows.select("path", "row", F.explode("errors").alias("error"))


def oversized(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> DataFrame:
    """SRC3: files above the limit; only their metadata is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") > limit)


def plain(spark: SparkSession, path: str) -> DataFrame:
    """The distributed reader for well-formed CSV."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def record_type(c: Column) -> Column:
    """SRC4: one of five types; unknown is OTHER."""
    key, out = T.header_key(c), F.lit("OTHER")
    for name, words in TYPES.items():
        out = F.when(key.isin(*words), name).otherwise(out)
    return out


def unknown_type(c: Column) -> Column:
    return (T.unicode_trim(c) != "") & ~T.header_key(c).isin(*(w for words in TYPES.values() for w in words))


def import_records(rows: DataFrame) -> DataFrame:
    """SRC2: typed records of parsed rows (``path, row, cells, header``) with passthrough cells and diagnostics.

    Missing ids are hashes numbered by occurrence; a row of duplicate headers of one field is
    reported; a missing title is an error of the record, not of the import.
    """
    data = rows.where("row > 0")
    key_of = F.create_map(*(F.lit(x) for f, keys in ALIASES.items() for k in keys for x in (k, f)))
    named = data.withColumn("_f", F.transform("header", lambda h: F.try_element_at(key_of, T.header_key(h))))
    pairs = F.arrays_zip(F.col("_f").alias("f"), F.col("header").alias("h"), F.col("cells").alias("c"))
    own = F.filter(pairs, lambda p: p["f"].isNotNull() & p["c"].isNotNull())
    other = F.filter(pairs, lambda p: p["f"].isNull() & p["h"].isNotNull())
    last = lambda name: F.try_element_at(F.transform(F.filter(own, lambda p: p["f"] == name), lambda p: T.unicode_trim(p["c"])), F.lit(1))
    out = named.withColumn("passthrough", F.map_from_entries(F.transform(F.filter(other, lambda p: ~F.exists(F.filter(other, lambda q: q["h"] == p["h"]), lambda q: F.lit(False))), lambda p: F.struct(p["h"], p["c"]))))
    for f in ALIASES:
        value = F.nullif(last(f), F.lit(""))
        out = out.withColumn(f, T.creators(F.coalesce(value, F.lit(""))) if f in ("authors", "editors", "translators") else value)
    raw_type = out["type"]
    doubled = F.size(F.filter("_f", lambda f: f.isNotNull())) > F.size(F.array_distinct(F.filter("_f", lambda f: f.isNotNull())))
    found = F.array_compact(F.array(F.when(F.col("title").isNull(), "MISSING_TITLE"), F.when(unknown_type(raw_type), "UNKNOWN_RECORD_TYPE"), F.when(doubled, "DUPLICATE_FIELD_HEADER"), F.when(F.size("cells") != F.size("header"), "WIDTH_MISMATCH")))
    out = out.withColumn("diagnostics", found).withColumn("type", record_type(F.coalesce(raw_type, F.lit(""))))
    fields = [F.array_join(c, "|") if c in ("authors", "editors", "translators") else F.col(c) for c in ALIASES if c != "id"]
    out = out.withColumn("_fp", record_fingerprint(fields, F.col("passthrough")))
    out = occurrence_ids(out, "_fp", ["path", "row"]).withColumn("record_id", F.coalesce("id", "record_id"))
    return out.drop("_fp", "_f", "id")
