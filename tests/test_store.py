import pytest
from pyspark.sql import functions as F

from textloom.operators import selection as S
from textloom.operators import store as V
from textloom.streaming import ingest as G


def rows(spark, data):
    return spark.createDataFrame(data, "provider string, source_id string, h string")


def test_publish_verify_restore(spark, tmp_path):
    path, keys = str(tmp_path / "s"), ["provider", "source_id"]
    one, two = rows(spark, [("a", "1", "x"), ("a", "2", "y")]), rows(spark, [("a", "1", "z")])
    V.publish(one, path, "s1", keys, "h")
    merged = V.retain(V.active(spark, path), two, keys)
    V.publish(merged, path, "s2", keys, "h")
    assert sorted(tuple(r) for r in V.active(spark, path).collect()) == [("a", "1", "z"), ("a", "2", "y")]
    V.activate(spark, path, "s1")
    assert V.active(spark, path).count() == 2 and {r.h for r in V.active(spark, path).collect()} == {"x", "y"}
    with pytest.raises(Exception):
        V.publish(one, path, "s1", keys, "h")


def test_manifest_ignores_order_and_sees_changes(spark):
    data = [("a", str(i), str(i * 7)) for i in range(300)]
    first = V.build_snapshot(rows(spark, data).repartition(5), "s", ["provider", "source_id"], "h").first()
    again = V.build_snapshot(rows(spark, data[::-1]).repartition(2), "s", ["provider", "source_id"], "h")
    assert again.first() == first
    assert V.verify_snapshot(rows(spark, data[1:]), again, ["provider", "source_id"], "h").count() == 1


def test_diff_upsert_and_history(spark):
    old, new = rows(spark, [("a", "1", "x"), ("a", "2", "y"), ("a", "3", "p")]), rows(spark, [("a", "1", "x"), ("a", "2", "z"), ("a", "3", "q"), ("a", "4", "n")])
    past = rows(spark, [("a", "3", "q")])
    got = {r.source_id: r.change for r in V.snapshot_diff(old, new, ["provider", "source_id"], "h", past).collect()}
    assert got == {"1": "UNCHANGED", "2": "CHANGED", "3": "HISTORICAL", "4": "NEW"}
    keys = ["provider", "source_id"]
    assert {r.h for r in V.upsert(old, new, keys).collect()} == {"x", "z", "q", "n"}
    assert {r.h for r in V.upsert(old, new, keys, update=False).collect()} == {"x", "y", "p", "n"}
    outcomes = V.insert_evidence(old.where("source_id < '3'").select("source_id", "h"), new.select("source_id", "h"), "source_id", "h")
    assert {r.source_id: r.outcome for r in outcomes.collect()} == {"1": "IDEMPOTENT", "2": "VIOLATION", "3": "INSERT", "4": "INSERT"}


def test_rules_and_guards(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, v int")
    assert sorted((r.id, r.violation) for r in V.violations(df, [("NEGATIVE", F.col("v") >= 0), ("MISSING", F.col("v").isNotNull())], ["id"]).collect()) == [(2, "NEGATIVE"), (3, "MISSING"), (3, "NEGATIVE")]
    assert V.require_rows(df, "none").count() == 3
    with pytest.raises(Exception, match="none"):
        V.require_rows(df.limit(0), "none").collect()
    events = spark.createDataFrame([("e", 1, "PUBLISH"), ("e", 2, "WITHDRAW"), ("f", 1, "PUBLISH")], "entry string, version int, event_kind string")
    assert [r.entry for r in V.authority_fold(events, "entry", "version").collect()] == ["f"]
    lex = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "normalized string, canonicals array<string>")
    acc = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "w")], "normalized string, canonical string")
    assert {r.normalized: r.action for r in V.promotion_plan(acc, lex).collect()} == {"a": "ALREADY_PRESENT", "b": "ADD_READING", "c": "CREATE_ENTRY"}


@pytest.mark.parametrize("parts", [1, 7])
def test_running_does_not_depend_on_partitions(spark, parts):
    df = spark.createDataFrame([(i * 37 % 101, float(i % 5)) for i in range(101)], "k int, v double").repartition(parts)
    got = {r.k: (r["rank"], r.before) for r in S.running(df, ["k"], F.col("v")).collect()}
    value = {r.k: r.v for r in df.collect()}
    total = 0.0
    for n, k in enumerate(sorted(value), 1):
        assert got[k] == (n, total)
        total += value[k]
    with pytest.raises(ValueError):
        S.page(df, [F.asc("k")], 0, 10)


def test_stream_equals_batch(spark, tmp_path):
    source = spark.range(100).select((F.col("id") % 40).alias("k"), F.col("id").alias("v")).repartition(5)
    source.write.parquet(str(tmp_path / "in"))
    stream = G.stream_parquet(spark, str(tmp_path / "in"), 1)
    seen = []
    G.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], lambda df: seen.append(df.count())).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("k").distinct().count() == 40 == sum(seen) == spark.read.parquet(str(tmp_path / "out")).count()
    G.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    G.running_counts(G.stream_parquet(spark, str(tmp_path / "in"), 2), ["k"], "v", "counts", str(tmp_path / "cp2")).awaitTermination()
    batch = source.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    assert {(r.k, r.n, r.total) for r in spark.table("counts").collect()} == {(r.k, r.n, r.total) for r in batch.collect()}


def test_guarded_publication_and_its_memory_twin(spark, tmp_path):
    path, keys = str(tmp_path / "s"), ["provider", "source_id"]
    one, two = rows(spark, [("a", "1", "x"), ("a", "2", "y")]), rows(spark, [("a", "1", "z")])
    memory = V.MemoryStore()
    first = V.publish_incremental(one, path, "s1", keys, "h", keys, None)
    assert first.first() == memory.publish(one, "s1", keys, "h", keys).first()
    for store in (lambda e: V.publish_incremental(two, path, "s2", keys, "h", keys, e), lambda e: memory.publish(two, "s2", keys, "h", keys, e)):
        with pytest.raises(ValueError, match="active snapshot is s1"):
            store(None)
        assert store("s1").first()["candidate_count"] == 2
    want = [("a", "1", "z"), ("a", "2", "y")]
    assert sorted(map(tuple, V.active(spark, path).collect())) == sorted(map(tuple, memory.active().collect())) == want
    V.activate(spark, path, "s1")
    memory.restore("s1")
    assert V.pointed(spark, path) == (3, "s1") and memory.active().count() == 2
    with pytest.raises(ValueError):
        memory.restore("none")
    assert V.pointed(spark, str(tmp_path / "empty")) == (0, None)


def test_append_only_lists_and_manifests(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "k int, v string, n int")
    after = spark.createDataFrame([(1, "a", None), (2, "b", 9), (4, "d", 0)], "k int, v string, n int")
    assert {r.k: r.finding for r in V.immutable_breaks(before, after, "k", ["v", "n"]).collect()} == {2: "UPDATED", 3: "DELETED"}
    lists = spark.createDataFrame([(1, '["a","b"]'), (2, "[]"), (3, None), (4, "no json")], "k int, items string")
    assert sorted((r.k, r.item) for r in V.lateral_items(lists, "items", "item").collect()) == [(1, "a"), (1, "b")]
    with pytest.raises(ValueError):
        V.with_manifest(before, after)
    with pytest.raises(ValueError):
        V.bounded(before, [F.asc("k")], 101)
    null = V.insert_evidence(spark.createDataFrame([(1, None), (2, "x")], "k int, h string"), spark.createDataFrame([(1, None), (2, None), (3, None)], "k int, h string"), "k", "h")
    assert {r.k: r.outcome for r in null.collect()} == {1: "IDEMPOTENT", 2: "VIOLATION", 3: "INSERT"}


def test_numbering_of_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).cast("string").alias("fp"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("a"), F.col("id").alias("b"))
    got = {r.b: r.record_id for r in S.occurrence_ids(df, "fp", ["a", "b"]).collect()}
    seen, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.a is not None, r.a or 0, r.b)):
        seen[r.fp] = seen.get(r.fp, 0) + 1
        want[r.b] = f"record:{r.fp}:{seen[r.fp]}"
    assert got == want


def test_a_target_belongs_to_one_checkpoint(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "k int, v string").write.parquet(str(tmp_path / "in"))
    stream = G.stream_parquet(spark, str(tmp_path / "in"))
    G.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"]).awaitTermination()
    with pytest.raises(Exception, match="another checkpoint"):
        G.ingest(stream, str(tmp_path / "out"), str(tmp_path / "other"), ["k"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
