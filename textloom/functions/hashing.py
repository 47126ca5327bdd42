"""Content identities: FNV, delimited SHA-256, stable JSON, manifests, splits."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _fnv(text: str, bits: int) -> str:
    offset, prime = (0x811C9DC5, 0x01000193) if bits == 32 else (0xCBF29CE484222325, 0x100000001B3)
    mask, h = (1 << bits) - 1, offset
    units = text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(units), 2):
        h = ((h ^ (units[k] | units[k + 1] << 8)) * prime) & mask
    return f"{h:0{bits // 4}x}"


@F.pandas_udf(StringType())
def fnv1a_32(s: pd.Series) -> pd.Series:
    """HSH1: FNV-1a over UTF-16 units."""
    return s.map(lambda t: None if t is None else _fnv(t, 32))


@F.pandas_udf(StringType())
def fnv1a_64(s: pd.Series) -> pd.Series:
    """HSH2"""
    return s.map(lambda t: None if t is None else _fnv(t, 64))


def record_fingerprint(fields: list[Column], passthrough: Column | None = None) -> Column:
    """HSH3: fields joined by ``:::`` with sorted passthrough pairs; null is empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in fields]
    if passthrough is not None:
        pairs = F.transform(F.array_sort(F.map_entries(passthrough)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
        parts.append(F.coalesce(F.array_join(pairs, ":::"), F.lit("")))
    return fnv1a_64(F.concat_ws(":::", *parts))


def content_id(*parts: Column, prefix: str = "", length: int = 16) -> Column:
    """HSH5/HSH11: first hex digits of the SHA-256 of NUL-delimited parts; null is empty."""
    joined = F.concat_ws("\u0000", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


@F.pandas_udf(StringType())
def stable_json(s: pd.Series) -> pd.Series:
    """HSH6: JSON text with keys sorted at every level and no spaces."""
    return s.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def quoted_sha256(c: Column) -> Column:
    """HSH6: hash of a string as JSON, quotes and all."""
    return F.sha2(json_string(c), 256)


def json_string(c: Column) -> Column:
    """A string as JSON text: quotes, backslashes and control characters escaped, all else as it is."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    full = plain
    for k in range(32):
        full = F.replace(full, F.lit(chr(k)), F.lit("\\" + short.get(k, f"u{k:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1F]"), full).otherwise(plain), F.lit('"'))


def set_fingerprint(values: Column) -> Column:
    """HSH7: an aggregate that does not depend on row order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(values)), "\n"), 256)


def manifest_checksum(head: list[Column], lines: Column) -> Column:
    """HSH8: header lines, then all rows' lines in order, as one hash (aggregate)."""
    return F.sha2(F.concat_ws("\n", *head, F.array_join(F.array_sort(F.collect_list(lines)), "\n")), 256)


def bucketed_checksum(rows, keys: list[str], line: Column):
    """HSH8 by parts: lines are hashed by the first two digits of their own hash, then the hashes by key.

    No task gathers a key's lines: a bucket is one in 256 of them.
    """
    own = rows.select(*keys, line.alias("_line")).withColumn("_b", F.substring(F.sha2("_line", 256), 1, 2))
    parts = own.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), manifest_checksum([F.first("_b")], F.col("_line")).alias("_h"))
    return parts.groupBy(*keys).agg(manifest_checksum([F.first(F.concat_ws(":", *keys))], F.concat_ws(":", "_b", "_h")).alias("checksum"), F.sum("_n").alias("n"))


def git_blob_sha1(content: Column) -> Column:
    """HSH9"""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")).cast("binary"), F.lit(b"\x00"), raw))


def leading_number(hex_text: Column) -> Column:
    """First eight hex digits as a number."""
    return F.conv(F.substring(hex_text, 1, 8), 16, 10).cast("long")


def deterministic_split(group: Column, salt: str = "phase8c-split-v1", folds: int = 5) -> Column:
    """SRT2: LOCKED for one of ``folds`` hash remainders."""
    return F.when(leading_number(quoted_sha256(F.concat(F.lit(f"{salt}:"), group))) % folds == 0, "LOCKED").otherwise("OPEN")
