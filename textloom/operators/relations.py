"""JON15: how bibliographic records relate, by ordered rules over keys of several values.

For two records the first rule that holds counts: one source id (EXACT_DUPLICATE_RECORD), a
stable identifier in common (DUPLICATE_MANIFESTATION), one normalised title, which is a
RELATED_EDITION where they have an author in common and differ in a year or publisher that both
have, SIMILAR_TITLE_ONLY where both have authors but none in common, else an
UNCERTAIN_RELATIONSHIP. A record's status is the strongest over all others, UNIQUE_RECORD without any.

No pair is made. A record that shares its source or an identifier has its status from that; for
any other record no pair of its title is taken by an earlier rule, so the title's rules are
questions to its block: are there other years or publishers under one of its authors (least and
greatest value by title and author), and is there a set of authors without one of its own (distinct
sets counted by title, and by title and author: more sets than its authors' counts add
up to leave one over, as many as one author's count do not; only sets between the two are compared).

Members of blocks come as stars: every record of a block with the block's least record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("EXACT_DUPLICATE_RECORD", "DUPLICATE_MANIFESTATION", "RELATED_EDITION", "SIMILAR_TITLE_ONLY", "UNCERTAIN_RELATIONSHIP")


def _values(records: DataFrame, column: str) -> Column:
    """A key's values as distinct texts without null and empty ones."""
    given = F.col(column) if dict(records.dtypes)[column].startswith("array") else F.array(column)
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(given.cast("array<string>"), F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")))


def membership(records: DataFrame, ident: str, source: str, identifiers: list[str], title: str) -> DataFrame:
    """``ident, key, value, leader, members`` of every block of two records or more; ``key`` is the column that they share."""
    named = lambda c: F.transform(_values(records, c), lambda v: F.struct(F.lit(c).alias("key"), v.alias("value")))
    keys = [named(c) for c in (source, *identifiers, title)]
    keyed = records.select(ident, F.explode(F.concat(*keys)).alias("_k")).select(ident, "_k.key", "_k.value")
    blocks = keyed.groupBy("key", "value").agg(F.min(ident).alias("leader"), F.count("*").alias("members")).where("members > 1")
    return keyed.join(blocks, ["key", "value"]).select(ident, "key", "value", "leader", "members")


def _disjoint_sets(works: DataFrame) -> DataFrame:
    """``title, authors, disjoint``: whether the title has a set of authors without any of these."""
    sets = works.select("title", "authors").distinct()
    total = sets.groupBy("title").agg(F.count("*").alias("sets"))
    each = sets.select("title", "authors", F.explode("authors").alias("author"))
    held = each.groupBy("title", "author").agg(F.count("*").alias("n"))
    met = each.join(held, ["title", "author"]).groupBy("title", "authors").agg(F.sum("n").alias("most"), F.max("n").alias("least")).join(total, "title")
    open_ = met.where("sets > least AND sets <= most").select("title", "authors", "sets")
    others = each.select("title", "author", F.col("authors").alias("other"))
    exact = open_.select("title", "authors", "sets", F.explode("authors").alias("author")).join(others, ["title", "author"]).groupBy("title", "authors").agg(F.count_distinct("other").alias("met"), F.first("sets").alias("sets"))
    return met.where("sets > most OR sets = least").select("title", "authors", (F.col("sets") > F.col("most")).alias("disjoint")).unionByName(exact.select("title", "authors", (F.col("sets") > F.col("met")).alias("disjoint")))


def relations(records: DataFrame, ident: str, source: str, identifiers: list[str], title: str, authors: str, year: str, publisher: str) -> DataFrame:
    """``ident, status`` of every record. Identifiers and authors may be arrays; nulls and empty texts are no values."""
    blocks = membership(records, ident, source, identifiers, title).groupBy(ident).agg(
        F.bool_or(F.col("key") == source).alias("_same"), F.bool_or(F.col("key").isin(identifiers)).alias("_stable"), F.bool_or(F.col("key") == title).alias("_titled")
    )
    one = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    works = records.select(ident, one(title).alias("title"), _values(records, authors).alias("authors"), one(year).alias("year"), one(publisher).alias("publisher")).where("title IS NOT NULL AND size(authors) > 0")
    by_author = works.withColumn("author", F.explode("authors"))
    spans = by_author.groupBy("title", "author").agg(*(f(c).alias(f"{name}_{c}") for c in ("year", "publisher") for name, f in (("low", F.min), ("high", F.max))))
    differs = lambda c: F.coalesce((F.col(f"low_{c}") != F.col(c)) | (F.col(f"high_{c}") != F.col(c)), F.lit(False))
    editions = by_author.join(spans, ["title", "author"]).where(differs("year") | differs("publisher")).select(ident, F.lit(True).alias("_edition")).distinct()
    similar = works.join(_disjoint_sets(works).where("disjoint"), ["title", "authors"]).select(ident, F.lit(True).alias("_similar"))
    out = records.select(ident)
    for part in (blocks, editions, similar):
        out = out.join(part, ident, "left")
    status = F.lit("UNIQUE_RECORD")
    for flag, rule in reversed(list(zip(("_same", "_stable", "_edition", "_similar", "_titled"), RULES))):
        status = F.when(F.col(flag), rule).otherwise(status)
    return out.select(ident, status.alias("status"))
