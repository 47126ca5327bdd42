"""Strict CSV by ranges against one pass over characters."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.sources import csv_split
from textloom.sources.csv_strict import csv_errors, parse_csv, read_strict


def by_characters(text):
    """The grammar, one character at a time: rows, and problems as (what, line)."""
    rows, problems, row, field = [], [], [], ""
    state, line, began, i = "start", 1, 1, 0

    def end():
        nonlocal row, field, state
        row.append(field)
        if len(row) > 1 or row[0]:
            rows.append(row)
        row, field, state = [], "", "start"

    while i < len(text):
        c, pair = text[i], text[i : i + 2]
        if state == "quoted":
            if pair == '""':
                field, i = field + '"', i + 2
                continue
            if c == '"':
                state = "closed"
            elif pair == "\r\n":
                field, line, i = field + pair, line + 1, i + 2
                continue
            else:
                field, line = field + c, line + (c in "\r\n")
        elif c == ",":
            row.append(field)
            field, state = "", "start"
        elif c in "\r\n":
            i += pair == "\r\n"
            end()
            line += 1
        elif c == '"' and state == "start":
            state, began = "quoted", line
        else:
            if c == '"' or state == "closed":
                problems.append(f"unexpected {'quote' if c == '"' else 'character'} at line {line}")
            field, state = field + c, "plain"
        i += 1
    if state == "quoted":
        problems.append(f"unclosed quote at line {began}")
    if state != "start" or field or row:
        end()
    problems += [f"row {k} has {len(r)} fields, the header {len(rows[0])}" for k, r in enumerate(rows[1:], 2) if len(r) != len(rows[0])]
    return rows, problems


MESSY = st.text(alphabet='ab",,\n\n\r"x', max_size=60)


@given(MESSY)
@settings(max_examples=500, deadline=None)
def test_one_text(text):
    assert parse_csv(text)[0] == by_characters(text)[0]
    assert sorted(parse_csv(text)[1]) == sorted(by_characters(text)[1])


@given(st.lists(st.lists(st.text(alphabet='ab",\n\r"x', max_size=12).map(lambda t: t.replace("\n", "")), min_size=1, max_size=4), min_size=1, max_size=6), st.booleans())
@settings(max_examples=500, deadline=None)
def test_composed_ranges(ranges, fed):
    """Ranges of lines, noted apart and composed, then read from their cases."""
    lines = [line for r in ranges for line in r]
    text = "\n".join(lines) + "\n" * fed
    if not fed and lines[-1] == "":
        return  # such a file has one line less
    size = len(text.encode())
    batch, at = [], 0
    for r in ranges:
        batch += [{"path": "f", "start": at, "size": size, "value": line.encode()} for line in r]
        at += sum(len(line) + 1 for line in r)
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("value", pa.binary())])
    notes = pa.Table.from_batches(csv_split._notes(iter([pa.RecordBatch.from_pylist(batch[:3], schema=schema), pa.RecordBatch.from_pylist(batch[3:], schema=schema)])))
    cases = csv_split._composed(notes)
    told = {r["start"]: r for r in cases.to_pylist()}
    columns = ("path", "quoted", "first_row", "first_line", "width", "start")
    rows = [b for b in csv_split._read(iter([pa.RecordBatch.from_pylist([{**{k: told[b["start"]][k] for k in columns}, "value": b["value"]} for b in batch])]))]
    rows += csv_split._stitched(iter(cases.to_batches()))
    got = sorted((x for b in rows for x in b.to_pylist()), key=lambda x: x["row"])
    want, problems = by_characters(text)
    assert [x["cells"] for x in got] == want[1:] and [x["row"] for x in got] == list(range(1, len(want)))
    first = cases.to_pylist()[0]
    assert first["header"] == (want[0] if want else []) and first["rows"] == max(len(want) - 1, 0)
    assert sorted([*first["problems"], *(e for x in got for e in x["errors"])]) == sorted(problems)


def _body(n):
    lines = ["id,text,more"]
    for k in range(n):
        lines.append({0: f'{k},"line one\r\nline ""two"", {k}\n\nend",x', 1: f"{k},plain,y", 2: f'{k},"a,b",z', 3: f'{k},bad"quote,w', 4: f'{k},"tail"x,v', 5: f"{k},short"}[k % 6 if k % 50 == 0 or k % 6 < 3 else 1])
    return "\ufeff" + "\n".join(lines) + "\n"


@pytest.mark.parametrize("broadcast", [True, False])
def test_files_of_many_ranges(spark, tmp_path, monkeypatch, broadcast):
    """One file in many tasks; the same rows and problems as one pass over it."""
    if not broadcast:
        monkeypatch.setattr(csv_split, "BROADCAST_RANGES", 0)
    (tmp_path / "a.csv").write_bytes(_body(3000).encode())
    (tmp_path / "b.csv").write_bytes(b'h\n"never closed, \n' + b"x,y\n" * 4000)
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes(b"only,header")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = read_strict(spark, str(tmp_path)).collect()
        assert csv_split._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name in "abcd":
        want, problems = by_characters((tmp_path / f"{name}.csv").read_bytes().decode("utf-8-sig"))
        got = sorted((r for r in out if r["path"].endswith(f"{name}.csv")), key=lambda r: r["row"])
        assert [r["cells"] for r in got] == want and all(r["header"] == (want[0] if want else []) for r in got)
        assert sorted(e for r in got for e in r["errors"]) == sorted(problems)


def test_limits_are_errors_and_no_row_goes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h\n" + "abcdef\n" * 20)
    rows = read_strict(spark, str(tmp_path), max_bytes=100, max_rows=10, max_field=5)
    assert rows.count() == 21
    found = {(r["row"], r["error"]) for r in csv_errors(rows).collect()}
    assert {(0, "the file has 142 bytes, more than 100"), (0, "more than 10 rows"), (7, "row 7 has a field of over 5 characters")} <= found and len(found) == 22


def test_rows_that_cross_and_are_too_long(monkeypatch):
    monkeypatch.setattr(csv_split, "MAX_CROSSING", 50)
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("value", pa.binary())])
    lines = [b"h", b'"' + b"abcdef", *[b"abcdef"] * 19, b'",x', b"last"]
    batch = [{"path": "f", "start": 7 * (k // 4), "size": 153, "value": v} for k, v in enumerate(lines)]
    cases = csv_split._composed(pa.Table.from_batches(csv_split._notes(iter([pa.RecordBatch.from_pylist(batch, schema=schema)]))))
    rows = [x for b in csv_split._stitched(iter(cases.to_batches())) for x in b.to_pylist()]
    assert rows == [{"path": "f", "row": 1, "cells": None, "errors": ["a row of over 50 characters starts at line 2"]}]
    assert cases["rows"][0].as_py() == 2 and cases["first_row"][-1].as_py() == 1


@pytest.mark.parametrize("quoted", [True, False])
def test_a_reader_holds_no_more_than_its_limit(quoted):
    """The wrong case of a range without quotes is one open row: it is not kept, and what follows it is read as before."""
    reader = csv_split.Reader(quoted, limit=100)
    if not quoted:
        assert reader.feed('a,"open') == []
    for _ in range(1000):
        assert reader.feed("abc,def") == []
        assert sum(map(len, reader.open)) <= 2 * 110
    found = reader.feed('x",y\rnext,"more')
    assert len(found) == (not quoted) and reader.rows == 1 and reader.tail == 'next,"more' and (not quoted or len(reader.head) > 100)
    assert reader.begin == 1001 + (not quoted) + 1
    assert reader.feed('and"') == [(["next", "more\nand"], [])] and reader.feed('p"q') == [(['p"q'], [f"unexpected quote at line {1004 + (not quoted)}"])]
