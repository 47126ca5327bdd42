"""Line numbers, windows of valid rows, and ranges of a total order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import evidence as E
from textloom.operators import selection as S
from textloom.sources import records as R


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(folder, files=4, n=150, seed=1):
    """Files of good, repeated, malformed, foreign and blank lines; all lines with their file and number."""
    rng, out = random.Random(seed), []
    folder.mkdir()
    for f in range(files):
        lines = []
        for k in range(n):
            kind = rng.choice(["good", "good", "same", "bad", "foreign", "blank"])
            word = {"lang_code": "ar" if kind == "foreign" else "fa", "word": "کتاب", "pos": "s" if kind == "same" else f"{f}-{k}"}
            lines.append({"bad": '{"word', "blank": "  "}.get(kind, json.dumps(word, ensure_ascii=False)))
            out.append((f"f{f}.jsonl", k + 1, kind))
        (folder / f"f{f}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return out


def one_pass(lines, offset, limit):
    """What a reader of one line after another yields: places of rejected and valid rows."""
    out, valid = [], 0
    for name, line, kind in lines:
        if kind == "blank":
            continue
        if kind in ("bad", "foreign"):
            out.append((f"{name}#{line}", False))
            continue
        valid += 1
        if valid <= offset:
            continue
        out.append((f"{name}#{line}", True))
        if limit is not None and valid == offset + limit:
            break
    return out


@pytest.mark.parametrize("offset,limit,merge", [(10, 50, False), (0, None, False), (130, 120, True), (5000, 10, False)])
def test_windows_are_those_of_one_pass(spark, tmp_path, small_ranges, monkeypatch, offset, limit, merge):
    lines = write(tmp_path / "in")
    monkeypatch.setattr(R, "BROADCAST_SPANS", 0 if merge else 500_000)
    entries = E.valid_entries(R.dictionary(spark, str(tmp_path / "in")))
    assert entries.select("file", "span").distinct().count() > 8
    got = R.valid_range(entries, offset, limit, rejected=True).orderBy("file", "line").collect()
    want = one_pass(lines, offset, limit)
    assert [(r["entry_id"], r["reason"] is None) for r in got] == want
    valid = R.valid_range(entries, offset, limit).orderBy("rank").collect()
    assert [r["entry_id"] for r in valid] == [i for i, ok in want if ok] and [r["rank"] for r in valid] == list(range(offset + 1, offset + 1 + len(valid)))


def test_early_end_opens_no_later_file(spark, tmp_path):
    lines = write(tmp_path / "in", files=9, n=30)
    some = R.dictionary_range(spark, str(tmp_path / "in"), E.valid_entries, 3, 20)
    assert sorted({f.rpartition("/")[2] for f in some.inputFiles()}) == ["f0.jsonl", "f1.jsonl", "f2.jsonl"]
    assert [r["entry_id"] for r in some.orderBy("rank").collect()] == [i for i, ok in one_pass(lines, 3, 20) if ok]


def test_strict_names_the_line(spark, tmp_path):
    lines = write(tmp_path / "in", files=1)
    first = next(line for _, line, kind in lines if kind == "bad")
    with pytest.raises(Exception, match="malformed JSON at line"):
        R.dictionary(spark, str(tmp_path / "in"), strict=True).collect()
    assert first and R.dictionary(spark, str(tmp_path / "in")).where(F.col("_corrupt_record").isNotNull()).agg(F.min("line")).first()[0] == first


@pytest.mark.parametrize("kind", ["string", "int", "date", "decimal(9,2)"])
def test_no_range_is_much_over_its_share(spark, kind):
    """Five values in all, one of them in most rows."""
    value = F.when(F.col("id") % 10 < 7, F.lit(3)).otherwise((F.col("id") % 5).cast("int"))
    value = F.date_add(F.lit("2020-01-01").cast("date"), value) if kind == "date" else value.cast(kind)
    df = spark.range(20_000).select(F.when(F.col("id") % 50 != 0, value).alias("v"), "id").repartition(5)
    sizes = [r["n"] for r in df.withColumn("p", S._bounds(df, ["v", "id"], 20)).groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * 20_000 / 20
    got = S.running(df, ["v", "id"], F.lit(2)).orderBy("rank").collect()
    want = sorted(((r["v"] is not None, r["v"], r["id"]) for r in df.collect()), key=lambda r: (r[0], r[1] if r[0] else 0, r[2]))
    assert [r["id"] for r in got] == [w[2] for w in want]
    assert [r["rank"] for r in got] == list(range(1, 20_001)) and all(r["before"] == 2 * (r["rank"] - 1) for r in got)


def test_conflicting_contents_are_settled_alike(spark):
    rows = spark.createDataFrame([("a", "2", "x"), ("a", "1", "y"), ("a", "1", "w"), ("b", "9", "z")], "id string, sum string, more string")
    for n in (1, 3):
        one, conflicts = R.deduplicated_records(rows.repartition(n), "id", "sum")
        assert sorted(map(tuple, one.collect())) == [("a", "1", "w"), ("b", "9", "z")] and [r["id"] for r in conflicts.collect()] == ["a"]
