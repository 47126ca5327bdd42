"""STO14: sealed packages whose changed rows are found without reading the rest.

Rows are dealt to pages by a hash of their key, so a row that comes or goes touches one
page. A page's hash covers its rows in the order of their keys; the manifest has a row a
page, in order, with a chain of hashes over them, whose last link is the seal. A seal that
is kept elsewhere proves the manifest; the manifest proves each page for itself; two packages differ
in the pages whose hashes differ, and only those are read.

Bounds: a page is hashed in one aggregation, so ``pages`` should leave some 100,000 rows to each. The chain is
fed page by page in one task that holds one link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "page int, n long, page_sha256 string, chain_sha256 string"
START = hashlib.sha256(b"package").hexdigest()


def _content(rows: DataFrame, keys: list[str]):
    columns = [*keys, *sorted(c for c in rows.columns if c not in keys and c != "page")]
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``page, n, page_sha256`` of rows that have their page."""
    lines = rows.select("page", F.to_json(F.struct(*keys)).alias("k"), _content(rows, keys).alias("h"))
    return lines.groupBy("page").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("k", "h")))["h"], ""), 256).alias("page_sha256"))


def _link(before: str, page: int, n: int, page_sha256: str) -> str:
    return hashlib.sha256(f"{before}:{page}:{n}:{page_sha256}".encode()).hexdigest()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    link = START
    for batch in batches:
        links = []
        for page, n, page_sha256 in zip(*(batch[c].to_pylist() for c in ("page", "n", "page_sha256"))):
            link = _link(link, page, n, page_sha256)
            links.append(link)
        yield pa.RecordBatch.from_arrays([batch["page"], batch["n"], batch["page_sha256"], pa.array(links, pa.string())], names=["page", "n", "page_sha256", "chain_sha256"])


def chained(pages: DataFrame) -> DataFrame:
    """``page, n, page_sha256`` with the chain over them in the order of pages."""
    return pages.select(F.col("page").cast("int").alias("page"), "n", "page_sha256").repartition(1).sortWithinPartitions("page").mapInArrow(_chained, _MANIFEST)


def seal(rows: DataFrame, path: str, keys: list[str], pages: int = 64) -> str:
    """Writes rows and manifest; returns the seal. Rows that repeat a key are content of their own."""
    spark = rows.sparkSession
    dealt = rows.withColumn("page", F.pmod(F.xxhash64(*keys), F.lit(pages)).cast("int"))
    dealt.repartition("page").write.mode("error").partitionBy("page").parquet(f"{path}/rows")
    stored = spark.read.schema(dealt.schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    chained(_hashed(stored, keys)).write.mode("error").parquet(f"{path}/manifest")
    return head(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def head(spark: SparkSession, path: str) -> str:
    last = manifest(spark, path).agg(F.max_by("chain_sha256", "page").alias("h")).first()["h"]
    return last or START


def broken_links(spark: SparkSession, path: str, sealed: str) -> DataFrame:
    """``page, finding``: manifest rows whose link does not follow from the rows before (the first one is where it was changed), and the seal if it is another."""
    have = manifest(spark, path)
    again = chained(have).select("page", F.col("chain_sha256").alias("_again"))
    broken = have.join(again, "page").where("chain_sha256 <> _again").select("page", F.lit("LINK").alias("finding"))
    last = have.agg(F.max("page").alias("page"), F.max_by("chain_sha256", "page").alias("h")).where(F.coalesce("h", F.lit(START)) != sealed)
    return broken.unionByName(last.select("page", F.lit("SEAL").alias("finding")))


def changed_pages(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """``page, finding``: pages whose stored rows are not what the manifest says (MISSING, EXTRA, CHANGED). Reads all rows."""
    have = _hashed(spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows"), keys)
    both = manifest(spark, path).select("page", F.col("page_sha256").alias("_want")).join(have, "page", "full")
    finding = F.when(F.col("page_sha256").isNull(), "MISSING").when(F.col("_want").isNull(), "EXTRA").when(F.col("_want") != F.col("page_sha256"), "CHANGED")
    return both.select("page", finding.alias("finding")).where("finding IS NOT NULL")


def reconcile(baseline: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, finding, fields``: rows that are MISSING from ``live``, ADDED by it, or CHANGED in the named fields."""
    fields = [c for c in baseline.columns if c not in keys and c != "page"]
    side = lambda df, name: df.select(*keys, F.struct(*fields).alias(name), F.lit(True).alias(f"in{name}"))
    both = side(baseline, "_a").join(side(live, "_b"), keys, "full")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in fields)))
    finding = F.when(F.col("in_b").isNull(), "MISSING").when(F.col("in_a").isNull(), "ADDED").when(F.size(differ) > 0, "CHANGED")
    return both.select(*keys, finding.alias("finding"), F.when(finding == "CHANGED", differ).alias("fields")).where("finding IS NOT NULL")


def located(spark: SparkSession, before: str, after: str, keys: list[str]) -> DataFrame:
    """:func:`reconcile` of two packages with as many pages; only folders of pages whose hashes differ are read.

    The page numbers that differ reach the driver: one integer a page at most.
    """
    a, b = (manifest(spark, p).select("page", F.col("page_sha256").alias(n)) for p, n in ((before, "_a"), (after, "_b")))
    pages = [r["page"] for r in a.join(b, "page", "full").where("NOT (_a <=> _b)").select("page").collect()]
    read = lambda path: spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").where(F.col("page").isin(pages))
    return reconcile(read(before), read(after), keys)
