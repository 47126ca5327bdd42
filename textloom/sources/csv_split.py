"""SRC1: strict CSV of any size, read by all tasks of a splittable file.

Spark hands out lines by byte range, but a line can lie within quotes, and whether
it does is only known from everything before it. So a first pass reads each range
for both cases (at the start of a field, or within quotes) and notes for each of
them how the range ends, how many rows it completes, and the text of the row that
runs on; the two cases mostly meet after a line and are then one. The notes, one small
row a range, are composed file by file, which gives every range its true case, its
first row's and its first line's number, and the rows that cross ranges. A second pass
then reads each range from its true case.

Bounds: notes grow by one row a range (128 MB by default). They are joined to the lines by a
broadcast up to ``BROADCAST_RANGES``; beyond that lines are dealt by range and sorted
within it. A row that crosses ranges may hold ``MAX_CROSSING`` characters, a longer one comes
as an error row without cells. A line, and a row within a range, must fit a worker's memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from textloom.shared import shared_path

BROADCAST_RANGES = 500_000
MAX_CROSSING = 4 * 1024 * 1024

_FIELD = re.compile(r'"(?P<quoted>(?:[^"]|"")*+)(?P<closed>"?)(?P<tail>[^,\r\n]*)|(?P<plain>[^,\r\n]*)')
_BREAK = re.compile(r"\r\n|\r|\n")
_WITHIN = re.compile(r'(?:[^"]|"")*+')

_NOTES = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("lines", pa.int64()), ("bytes", pa.int64()), ("head", pa.string()), ("head_closed", pa.bool_()),
    *((f"{name}{case}", kind) for case in (0, 1) for name, kind in (("ends", pa.int32()), ("rows", pa.int64()), ("tail", pa.string()), ("begin", pa.int64()))),
    ("header", pa.list_(pa.string())), ("problems", pa.list_(pa.string())),
])
_CROSSING = pa.list_(pa.struct([("row", pa.int64()), ("line", pa.int64()), ("text", pa.string()), ("closed", pa.bool_())]))
_RANGES = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("quoted", pa.int32()), ("first_row", pa.int64()), ("first_line", pa.int64()), ("crossing", _CROSSING),
    ("width", pa.int32()), ("header", pa.list_(pa.string())), ("bytes", pa.int64()), ("rows", pa.int64()), ("problems", pa.list_(pa.string())),
])
_ROWS = pa.schema([("path", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string())), ("errors", pa.list_(pa.string()))])


def scan_rows(text: str, line: int, ended: bool = False) -> tuple[list[tuple[list[str], list[str]]], int | None]:
    """Rows of a text with their problems, and where the row starts that its last quote leaves open (None: none, or ``ended``).

    Rows end at ``\\r`` and at the end of the text; line feeds only stand within quotes. A row of one empty field is none
    (with problems it is a row without cells).
    """
    rows, cells, problems, at, begin = [], [], [], 0, 0

    def note(what: str, place: int) -> None:
        problems.append(f"{what} at line {line + len(_BREAK.findall(text[:place]))}")

    while True:
        m = _FIELD.match(text, at)
        if m["plain"] is not None:
            value = m["plain"]
            for k in (k for k, c in enumerate(value) if c == '"'):
                note("unexpected quote", at + k)
        else:
            if not m["closed"]:
                if not ended:
                    return rows, begin
                note("unclosed quote", at)
            value = m["quoted"].replace('""', '"') + m["tail"]
            if m["tail"]:
                note("unexpected character", m.start("tail"))
                for k in (k for k, c in enumerate(m["tail"]) if c == '"'):
                    note("unexpected quote", m.start("tail") + k)
        cells.append(value)
        at = m.end()
        if at < len(text) and text[at] == ",":
            at += 1
            continue
        if len(cells) > 1 or cells[0]:
            rows.append((cells, problems))
        elif problems:  # a lone quote at the very end
            rows.append(([], problems))
        cells, problems = [], []
        at += 1
        begin = at
        if at >= len(text):
            return rows, None


class Reader:
    """Lines of one range, in order, from one of the two cases.

    With ``limit`` an open row of more characters is only known to be longer: a stand-in is held for it.
    """

    def __init__(self, quoted: bool, line: int = 1, limit: int | None = None):
        self.line = self.begin = self.base = line  #: number of the next line; of the open row's first line; of the first line that is held
        self.open: list[str] | None = [] if quoted else None  #: lines of the row that is not over
        self.quote = '"' if quoted else ""  #: stands for what the row that was open at the start had before
        self.head: str | None = None  #: the rest of that row, once it is over
        self.rows = self.held = 0
        self.limit = limit

    def feed(self, text: str) -> list[tuple[list[str], list[str]]]:
        """The rows that end with this line; the one that was open at the start counts, but its cells are not here."""
        at, self.line = self.line, self.line + 1 + text.count("\r", 0, -1)
        if self.open is None:
            if '"' not in text and "\r" not in text:
                self.rows += text != ""
                return [(text.split(","), [])] if text else []
            whole, at_line = text, at
        else:
            self.open.append(text)
            self.held += len(text) + 1
            if _WITHIN.match(text).end() == len(text):
                if self.limit is not None and self.held > self.limit:
                    self.open, self.base, self.held = ["x" * (self.limit + 1) if self.quote else '"' + "x" * (self.limit + 1)], at, 0
                return []
            whole, at_line = self.quote + "\n".join(self.open), self.base
        found, rest = scan_rows(whole, at_line)
        if rest == 0:
            if self.open is None:
                self.open, self.begin, self.base, self.held = [text], at, at, len(text)
            return []
        if self.quote:
            end = _row_end(whole)
            self.head, self.quote = whole[1:end], ""
            self.rows += 1
            if whole[:end] != '""':  # which alone would be no row
                found = found[1:]
        self.rows += len(found)
        self.open = None if rest is None else [whole[rest:]]
        if rest:
            self.begin = self.base = at_line + len(_BREAK.findall(whole[:rest]))
            self.held = len(self.open[0])
        return found

    @property
    def tail(self) -> str | None:
        return None if self.open is None else _clipped("\n".join(self.open))


def _row_end(text: str) -> int:
    at = 0
    while True:
        at = _FIELD.match(text, at).end()
        if text[at : at + 1] != ",":
            return at
        at += 1


def _clipped(text: str | None) -> str | None:
    """Texts beyond the bound are only known to be beyond it."""
    return text if text is None or len(text) <= MAX_CROSSING else text[: MAX_CROSSING + 1]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, lineSep="\n")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[bytes] | list[bytes], bool]]:
    """Runs of lines of one range: its other columns, its lines, and whether it is the range's first run."""
    last = None
    for batch in batches:
        paths, starts, values = batch["path"].to_pylist(), batch["start"].to_pylist(), batch["value"].to_pylist()
        begin = 0
        for k in range(1, len(values) + 1):
            if k == len(values) or starts[k] != starts[begin] or paths[k] != paths[begin]:
                key = (paths[begin], starts[begin])
                yield {n: batch[n][begin].as_py() for n in batch.schema.names if n != "value"}, values[begin:k], key != last
                last, begin = key, k


def _notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: what it is in both cases."""

    def made() -> pa.RecordBatch:
        one, more = (other, 0) if together is None else (plain, together)
        row = {**info, "lines": plain.line - 1, "bytes": size, "head": other.tail if other.head is None else _clipped(other.head), "head_closed": other.head is not None}
        row |= {"ends0": int(plain.open is not None), "rows0": plain.rows, "tail0": plain.tail, "begin0": plain.begin}
        row |= {"ends1": int(one.open is not None), "rows1": one.rows + more, "tail1": one.tail, "begin1": one.begin, "header": header and header[0], "problems": header and header[1]}
        return pa.RecordBatch.from_pylist([row], schema=_NOTES)

    info = None
    for found, values, first in _by_range(batches):
        if first:
            if info:
                yield made()
            info, plain, other, together, size, header = found, Reader(False, limit=MAX_CROSSING), Reader(True, limit=MAX_CROSSING), None, 0, None
        for value in values:
            text = value.decode("utf-8", errors="replace")
            if not size and not info["start"]:
                text = text.removeprefix("\ufeff")
            size += len(value) + 1
            rows = plain.feed(text)
            header = header or (rows[0] if rows else None)
            if together is None:
                other.feed(text)
                if plain.open is None and other.open is None:
                    together = other.rows - plain.rows
    if info:
        yield made()


def _composed(table: pa.Table) -> pa.Table:
    """The ranges of one file in order: each one's case, first row and first line; the rows that cross into other ranges."""
    notes = sorted(table.to_pylist(), key=lambda n: n["start"])
    out, case, row, line, pending, begin = [], 0, 0, 1, None, 1
    header, problems, lone = None, [], []
    for n in notes:
        crossing = []
        out.append({"path": n["path"], "start": n["start"], "quoted": case, "first_row": row, "first_line": line, "crossing": crossing})
        if case:
            pending = _clipped(f"{pending}\n{n['head']}")
            if n["head_closed"]:
                crossing.append({"row": row, "line": begin, "text": pending, "closed": True})
                pending = None
        elif not row and header is None and n["header"] is not None:
            header, problems = n["header"], [re.sub(r"\d+$", lambda m: str(int(m[0]) + line - 1), p) for p in n["problems"]]
        if n[f"ends{case}"] and pending is None:
            pending, begin = n[f"tail{case}"], line + n[f"begin{case}"] - 1
        row, line, case = row + n[f"rows{case}"], line + n["lines"], n[f"ends{case}"]
    if case:  # a quote that is never closed holds the last line feed, too, if there is one
        fed = sum(n["bytes"] for n in notes) in (notes[0]["size"], notes[0]["size"] - 3)
        text = pending + "\n" * fed
        if text == '"':  # a problem without a row
            lone = scan_rows(text, begin, True)[0][0][1]
        else:
            crossing.append({"row": row, "line": begin, "text": text, "closed": False})
            row += 1
    if header is None and row:
        one = next(c for r in out for c in r["crossing"])
        found = scan_rows(one["text"], one["line"], True)[0] if len(one["text"]) <= MAX_CROSSING else []
        header, problems = found[0] if found else ([], [_too_long(one["line"])])
    facts = {"width": len(header or []), "header": header or [], "bytes": notes[0]["size"], "rows": max(row - 1, 0), "problems": problems + lone}
    return pa.Table.from_pylist([{**r, **facts} for r in out], schema=_RANGES)


def _too_long(line: int) -> str:
    return f"a row of over {MAX_CROSSING} characters starts at line {line}"


def _judged(path: str, row: int, found: tuple[list[str], list[str]], width: int) -> dict:
    cells, problems = found
    if len(cells) != width:
        problems = [*problems, f"row {row + 1} has {len(cells)} fields, the header {width}"]
    return {"path": path, "row": row, "cells": cells, "errors": problems}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that start and end within their range, the header left out."""
    out = []
    for info, values, first in _by_range(batches):
        if first:
            reader, row = Reader(bool(info["quoted"]), info["first_line"]), info["first_row"] + info["quoted"]
            begins = info["start"] == 0
        for value in values:
            text = value.decode("utf-8", errors="replace")
            if begins:
                text, begins = text.removeprefix("\ufeff"), False
            for found in reader.feed(text):
                if row:
                    out.append(_judged(info["path"], row, found, info["width"]))
                row += 1
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_pylist(out, schema=_ROWS)
                out = []
    yield pa.RecordBatch.from_pylist(out, schema=_ROWS)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that cross ranges."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            for c in r["crossing"]:
                if c["row"] == 0:
                    continue
                if len(c["text"]) > MAX_CROSSING:
                    out.append({"path": r["path"], "row": c["row"], "cells": None, "errors": [_too_long(c["line"])]})
                else:
                    found = scan_rows(c["text"], c["line"], not c["closed"])[0]
                    out.append(_judged(r["path"], c["row"], found[0], r["width"]))
        yield pa.RecordBatch.from_pylist(out, schema=_ROWS)


def read_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``path, row, cells, errors`` of all rows but the headers, and ``path, header, bytes, rows, problems`` of all files.

    The first pass runs when this is called.
    """
    lines = _lines(spark, path)
    ranges = lines.mapInArrow(_notes, from_arrow_schema(_NOTES)).groupBy("path").applyInArrow(_composed, from_arrow_schema(_RANGES))
    place = shared_path(spark, "csv-ranges")
    ranges.write.parquet(place)
    ranges = spark.read.parquet(place)
    files = ranges.groupBy("path").agg(F.first("header").alias("header"), F.first("bytes").alias("bytes"), F.first("rows").alias("rows"), F.first("problems").alias("problems"))
    cases = ranges.select("path", "start", "quoted", "first_row", "first_line", "width")
    if cases.count() <= BROADCAST_RANGES:
        told = lines.join(F.broadcast(cases), ["path", "start"], "left")
    else:
        numbered = lines.withColumn("place", F.monotonically_increasing_id())
        told = numbered.join(cases.hint("merge"), ["path", "start"], "left").repartition("path", "start").sortWithinPartitions("path", "start", "place").drop("place")
    known = F.coalesce("quoted", F.raise_error(F.lit("the files or their byte ranges are not those of the first pass")).cast("int"))
    told = told.select("path", "start", known.alias("quoted"), "first_row", "first_line", "width", "value")
    rows = told.mapInArrow(_read, from_arrow_schema(_ROWS))
    return rows.unionByName(ranges.select("path", "width", "crossing").where("size(crossing) > 0").mapInArrow(_stitched, from_arrow_schema(_ROWS))), files
