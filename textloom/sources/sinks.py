"""SNK2-4, SNK9-12: text files, packs with a size ceiling, content-addressed blobs."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ceiling of a pack.
MAX_PACK_BYTES = 5 * 1024 * 1024


def write_blocks(blocks: DataFrame, column: str, path: str, separator: str = "\r\n") -> None:
    """Text blocks as part files; each executor writes its own."""
    blocks.select(F.col(column).alias("value")).write.mode("error").option("lineSep", separator).text(path)


def pack_hash(entries: DataFrame, key: str) -> DataFrame:
    """SNK9: bytes and semantic hash of a pack, by bucket first, without gathering its entries."""
    line = F.to_json(F.struct(*sorted(entries.columns)))
    rows = entries.select(F.substring(F.sha2(F.col(key), 256), 1, 2).alias("b"), F.col(key).alias("k"), line.alias("j"))
    parts = rows.groupBy("b").agg(F.sum(F.octet_length("j")).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "j"))), lambda e: e["j"]), "\n"), 256).alias("h"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda e: e["h"]), "\n"), 256).alias("semantic_sha256"))


def write_pack(entries: DataFrame, key: str, path: str, ceiling: int = MAX_PACK_BYTES) -> DataFrame:
    head = pack_hash(entries, key)
    size = head.first()["bytes"]
    if size > ceiling:
        raise ValueError(f"pack of {size} bytes; the ceiling is {ceiling}")
    entries.write.mode("error").json(path)
    return head


def put_blob(spark: SparkSession, content: bytes, folder: str) -> str:
    """SNK12: an immutable blob named by its hash; the same content again is no error."""
    name = hashlib.sha256(content).hexdigest()
    path = f"{folder}/sha256={name}"
    df = spark.createDataFrame([(content,)], "content binary")
    df.coalesce(1).write.mode("ignore").parquet(path)
    return path


def put_blobs(rows: DataFrame, column: str, folder: str) -> None:
    """SNK12: a column's contents as blobs in one job, each in the folder of its hash; those that are there are left."""
    spark = rows.sparkSession
    new = rows.select(F.col(column).cast("binary").alias("content")).where("content IS NOT NULL").withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    try:
        there = spark.read.option("basePath", folder).schema("content binary, sha256 string").parquet(folder).select("sha256")
        new = new.join(there, "sha256", "left_anti")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    new.repartition("sha256").write.partitionBy("sha256").mode("append").parquet(folder)


def broken_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """SNK12: blobs whose content does not have the hash they are named by."""
    return spark.read.option("basePath", folder).schema("content binary, sha256 string").parquet(folder).where(F.sha2("content", 256) != F.col("sha256"))


def save_repository(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """SNK11: rows, and with ``keys`` a manifest that they are checked against when loaded."""
    df.write.mode("error").parquet(path)
    if keys:
        stored = df.sparkSession.read.parquet(path)
        pack_hash(stored.withColumn("_k", F.to_json(F.struct(*keys))), "_k").coalesce(1).write.mode("error").json(f"{path}/_manifest")


def load_repository(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """SNK11: the rows, if they still are what the manifest says."""
    rows = spark.read.parquet(path)
    want = spark.read.schema("bytes long, semantic_sha256 string").json(f"{path}/_manifest").first()
    if pack_hash(rows.withColumn("_k", F.to_json(F.struct(*keys))), "_k").first() != want:
        raise ValueError(f"{path} is not what was saved")
    return rows


def report_rows(metrics: DataFrame, title: str, order: list[str]) -> DataFrame:
    """SNK10: a table as Markdown, as ``place, line`` from 0; its lines are made where its rows are, in the given order."""
    from textloom.operators.selection import running

    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in metrics.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(c, F.lit("|"), F.lit("\\|")) for c in cells)), F.lit(" |"))
    body = running(metrics, order).select((F.col("rank") + 3).alias("place"), line.alias("line"))
    head = [f"# {title}", "", "| " + " | ".join(metrics.columns) + " |", "|" + "---|" * len(metrics.columns)]
    return metrics.sparkSession.createDataFrame(list(enumerate(head)), "place long, line string").unionByName(body)


def write_report(metrics: DataFrame, title: str, order: list[str], path: str) -> None:
    """SNK10: the lines of :func:`report_rows` as text, in part files whose names are in their order."""
    report_rows(metrics, title, order).orderBy("place").select(F.col("line").alias("value")).write.mode("error").text(path)
