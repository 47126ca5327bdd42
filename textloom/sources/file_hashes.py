"""HSH10: SHA-256 of files that no task holds whole.

The hash of a file needs its bytes in order, so its lines (as bytes, with the feeds
between them) are dealt by file and sorted by their place, which Spark spills to disk,
and one task feeds them to the hash as they come. Memory is one batch of lines
whatever the file's size; a file is as parallel as it is one hash, many files are hashed
side by side. Names ending in ``.gz`` and the like are hashed as their unpacked content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = b"\xef\xbb\xbf"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, state = None, None

    def done() -> pa.RecordBatch:
        # Readers of lines leave out a mark at the start, and do not tell whether the last line had a feed.
        plain, marked, lines, length, size = state
        marks = length + 3 in (size, size + 1) and length not in (size, size + 1)
        digest = marked if marks else plain
        if length + 3 * marks == size:
            digest.update(b"\n")
        return pa.RecordBatch.from_pydict({"file": [name], "lines": [lines], "sha256": [digest.hexdigest()]})

    for batch in batches:
        for file, size, value in zip(batch["file"].to_pylist(), batch["size"].to_pylist(), batch["value"].to_pylist()):
            if file != name:
                if state:
                    yield done()
                name, state = file, [hashlib.sha256(), hashlib.sha256(BOM), 0, 0, size]
            else:
                value = b"\n" + value
            state[0].update(value)
            state[1].update(value)
            state[2] += 1
            state[3] += len(value) + (state[2] == 1)
    if state:
        yield done()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``file, lines, sha256`` of every file below a path that is not empty."""
    raw = spark.read.text(path, lineSep="\n")
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("span"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"))
    ordered = lines.repartition("file").sortWithinPartitions("file", "span", "at")
    return ordered.select("file", "size", "value").mapInArrow(_hashed, "file string, lines long, sha256 string")
