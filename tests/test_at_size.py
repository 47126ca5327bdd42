"""Queries on tables that are made for what only larger tables have: many rows a file, several groups a file, ties."""

import datetime as dt
import tracemalloc

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import coverage as C
from textloom.operators import evidence as E
from textloom.plans import catalog


def write(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def wanted(folder, name, *tables):
    """The query's SQL over tables of one thread, so that rows come in the order of their files."""
    con = duckdb.connect(config={"threads": 1})
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    return sorted((tuple(dict(zip(columns, r))[c] for c in sorted(columns)) for r in got.fetchall()), key=repr)


def same(spark, folder, name, *tables):
    have = rows(catalog.queries()[name](spark, folder))
    assert have and have == wanted(folder, name, *tables)


def test_a_file_beyond_both_limits(spark, tmp_path):
    """Over 5,000 rows a file is an error, too, which tells no bytes."""
    write(spark.range(5_500).select(F.col("id").alias("doc_id"), F.lit("web").alias("source"), F.lit("en").alias("lang"), (F.col("id") % 90).alias("n_chars")), tmp_path, "documents")
    same(spark, str(tmp_path), "src3_oversized_files", "documents")


def test_equal_receipts(spark, tmp_path):
    """Of receipts that agree in date and quantity the first in the table stands."""
    write(spark.range(40).select(F.col("id").alias("o_orderkey")), tmp_path, "orders")
    day = F.to_timestamp(F.lit("2024-01-01"))
    line = spark.range(0, 200, 1, 1).select((F.col("id") % 40).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(5.0).alias("l_quantity"), F.element_at(F.array(*map(F.lit, "RAN")), (F.col("id") * 7 % 3 + 1).cast("int")).alias("l_returnflag"), day.alias("l_shipdate"))
    write(line, tmp_path, "lineitem")
    same(spark, str(tmp_path), "jon27_provenance", "orders", "lineitem")


def test_equal_receipts_of_several_files(spark, tmp_path):
    """The first in the table is that of the first file, wherever it stands there; unknown dates and quantities are the greatest, receipts without a flag none."""
    write(spark.range(40).select(F.col("id").alias("o_orderkey")), tmp_path, "orders")
    (tmp_path / "lineitem.parquet").mkdir()
    day, flags = dt.datetime(2024, 1, 1), "RAN"
    for file in range(3):
        lines = [(k, 1, 5.0, flags[(k + file) % 3], day) for k in range(file, 30)]  # a key stands earlier in later files
        odd = [(30 + file, 1, 5.0, "N", day), (30 + file, 1, None, "R", day), (33 + file, 1, 1.0, "R", None), (33 + file, 1, 9.0, "A", day), (36 + file, 1, 9.0, None, day), (36 + file, 1, 1.0, "R", day), (39, 1, 1.0, None, day)]
        names = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]
        pq.write_table(pa.table(dict(zip(names, map(list, zip(*lines, *odd))))), tmp_path / f"lineitem.parquet/part-{file}.parquet")
    same(spark, str(tmp_path), "jon27_provenance", "orders", "lineitem")


def test_hashed_languages_of_any_name(spark, tmp_path):
    """A language may be empty or no name for a file; a document without an id counts, but has no line."""
    docs = [(3, "c\nc", "en"), (1, "a\r\nb", "en"), (2, None, None), (5, "x", "none"), (7, "q", ""), (8, "w", "a/b"), (9, "e", "x=y %"), (10, "u", "EN"), (11, "t", " "), (None, "no id", "en"), (None, "no id", "fr"), (12, "f", "é")]
    write(spark.createDataFrame(docs, "doc_id long, text string, lang string"), tmp_path, "documents")
    same(spark, str(tmp_path), "hsh10_streamed_hashes", "documents")


@pytest.mark.parametrize("name", ["src9_bounded_records", "src9_refused_pages"])
def test_responses_are_few_files(spark, tmp_path, name):
    """However many responses there are; one has 60 records, one 9,930, and orders without a customer are on none."""
    customer = F.when(F.col("id") < 60, 36).when(F.col("id") < 70, None).when(F.col("id") < 10_000, 360_001).otherwise(F.col("id") % 1_500).cast("long")
    write(spark.range(13_000).select(F.col("id").alias("o_orderkey"), customer.alias("o_custkey"), F.concat(F.col("id") % 5, F.lit("-\nLOW")).alias("o_orderpriority")), tmp_path, "orders")
    same(spark, str(tmp_path), name, "orders")
    assert len(catalog.queries()[name](spark, str(tmp_path)).inputFiles()) <= 40


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """More parts than a file holds."""
    folder = str(tmp_path_factory.mktemp("parts"))
    key = F.col("id")
    write(spark.range(1, 12_500).select(key.alias("p_partkey"), F.concat(F.lit("name "), key).alias("p_name"), (key % 50).cast("int").alias("p_size"), F.concat(F.lit("Brand"), key % 7).alias("p_brand"), F.concat(F.lit("type "), key % 9).alias("p_type")), folder, "part")
    return folder


@pytest.mark.parametrize("name", ["src12_catalogue_items", "src1_strict_csv", "src2_imported_records"])
def test_several_files_of_parts(spark, parts, name):
    """A file has one document, or one header."""
    same(spark, parts, name, "part")


def test_a_key_that_is_covered_twice(spark):
    """Tokens are those of the baseline, however often the experiment covers their key."""
    base = spark.createDataFrame([(1, "a", False), (1, "a", False), (1, "b", False), (2, "a", True)], "doc_id long, w string, covered boolean")
    now = spark.createDataFrame([(1, "a", True), (1, "a", True), (1, "b", False), (1, "b", None)], "doc_id long, w string, covered boolean")
    assert tuple(C.miss_recovery(base, now, ["doc_id", "w"], "w").first()) == (3, 2, 2, 1)


def test_words_do_not_meet_their_documents_again(spark):
    plan = catalog.queries()["agg15_cohort_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "doc_id" in line]


@pytest.mark.parametrize("change", [T.nfc, T.without_diacritics])
def test_python_holds_few_texts(change):
    """Of a batch of 20 MB Python holds some texts at a time."""
    texts = pa.array(["é" * 3_000, None, "plain", ""] * 1_000)
    tracemalloc.start()
    got = change.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000
    assert got[:4].to_pylist() == [("é" if change is T.nfc else "e") * 3_000, None, "plain", ""] and len(got) == 4_000


def test_collections_are_parsed_once(spark):
    """Both sides of a link, and fields without one, come from one reading of the files."""
    plan = catalog.queries()["msc2_catalogue_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("MapInArrow" in line for line in plan.splitlines()) == 1


def test_linked_fields_of_every_kind(spark):
    fields = [
        ("a", "245", "880-01", "x"), ("a", "880", "245-01", "y"), ("a", "880", "260-02", "z"), ("a", "100", "880-03", None), ("a", "880", "100-03", "u"), ("a", "880", "100-00", "p"), ("a", "880", "100-00", "q"), ("a", "880", None, "r"),
        ("b", "245", "880-01", "x"), ("b", "245", "880-01", "x"), ("b", "880", "245-01", "y"), ("b", "260", "880-07", "w"), ("b", None, "880-01", "n"), (None, "245", "880-01", "x"), (None, "880", "245-01", "y"),
    ]
    got = E.linked_fields(spark.createDataFrame(fields, "record_id string, tag string, linkage string, value string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([
        ("a", "245", "01", "MATCHED", "x", "y"), ("a", "260", "02", "UNMATCHED_NONZERO", None, "z"), ("a", "100", "03", "UNMATCHED_NONZERO", None, "u"), ("a", "100", "00", "OCCURRENCE_00", None, None), ("a", "100", "00", "OCCURRENCE_00", None, None), ("a", "880", None, "MALFORMED_LINKAGE", None, None),
        ("b", "245", "01", "AMBIGUOUS_DUPLICATE", "x", "y"), (None, "245", "01", "UNMATCHED_NONZERO", None, "y"),
    ], key=repr)
