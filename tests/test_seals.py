"""Sealed packages, and the funnel, against plain Python."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from textloom.operators import audit as A
from textloom.operators import seals as S


def test_changes_are_located_by_their_pages(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("v"), "id")).alias("v"), (F.col("id") % 7).alias("w"))
    other = rows.where("k <> 17").withColumn("v", F.when(F.col("k") == 450, F.lit("now")).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(9999, None, 1)], "k long, v string, w long"))
    a, b, same = (str(tmp_path / n) for n in "abc")
    seal = S.seal(rows, a, ["k"], 40)
    assert S.seal(rows.repartition(7).select("w", "k", "v"), same, ["k"], 40) == seal != S.seal(other, b, ["k"], 40)
    found = S.located(spark, a, b, ["k"])
    assert sorted((r["k"], r["finding"], r["fields"]) for r in found.collect()) == [(17, "MISSING", None), (450, "CHANGED", ["v"]), (9999, "ADDED", None)]
    scans = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scans and "page" in scans
    touched = {r["page"] for r in S.manifest(spark, a).join(S.manifest(spark, b), ["page", "page_sha256"], "left_anti").collect()}
    assert 1 <= len(touched) <= 3
    assert S.located(spark, a, same, ["k"]).count() == 0 and S.broken_links(spark, a, seal).count() == 0 and S.changed_pages(spark, a, ["k"]).count() == 0


def test_tampering_is_seen(spark, tmp_path):
    path, copy = str(tmp_path / "p"), str(tmp_path / "q")
    seal = S.seal(spark.range(500).selectExpr("id k", "id * 2 v"), path, ["k"], 8)
    S.manifest(spark, path).withColumn("page_sha256", F.when(F.col("page") == 5, F.lit("0")).otherwise(F.col("page_sha256"))).write.parquet(f"{copy}/manifest")
    assert {(r["page"], r["finding"]) for r in S.broken_links(spark, copy, seal).collect()} == {(5, "LINK"), (6, "LINK"), (7, "LINK")}
    assert [tuple(r) for r in S.broken_links(spark, path, "other").collect()] == [(7, "SEAL")]
    spark.read.parquet(f"{path}/rows").where("page <> 3").withColumn("v", F.when((F.col("page") == 2) & (F.col("k") % 2 == 0), -1).otherwise(F.col("v"))).write.partitionBy("page").parquet(f"{copy}/rows")
    S.manifest(spark, path).where("page <> 6").write.mode("overwrite").parquet(f"{copy}/manifest")
    assert {(r["page"], r["finding"]) for r in S.changed_pages(spark, copy, ["k"]).collect()} == {(2, "CHANGED"), (3, "MISSING"), (6, "EXTRA")}


def test_funnel(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([None, "x", "y"]), rng.randint(0, 30), rng.choice([None, 1, 2, 3])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, k int, v int")
    got = {(r["part"], r["name"], r["value"]): r["n"] for r in A.funnel(df, {"b": F.col("b")}, {"k": F.col("k"), "b": F.col("b")}, {"v": (F.col("k"), F.col("v"))}).collect()}
    want = {("share", "b", v): n for v, n in Counter(r[1] for r in rows).items()}
    for name, at in (("k", 2), ("b", 1)):
        counts = Counter(r[at] for r in rows if r[at] is not None)
        want |= {("distinct", name, k): n for k, n in {"TOTAL": sum(counts.values()), "DISTINCT": len(counts), "REPEATED": sum(n > 1 for n in counts.values()), "SURPLUS": sum(counts.values()) - len(counts)}.items()}
    values = defaultdict(set)
    for r in rows:
        values[r[2]] |= {r[3]} - {None}
    want |= {("variants", "v", str(n)): c for n, c in Counter(map(len, values.values())).items()}
    assert got == want
    assert A.funnel(df.limit(0), {"b": F.col("b")}, {"k": F.col("k")}, {}).count() == 0


def test_observability_of_nested_fields(spark):
    rows = [(1, ("a", None), [("x", [1, None]), None]), (None, None, []), (2, ("", 3), None)]
    df = spark.createDataFrame(rows, "k int, s struct<t:string,n:int>, l array<struct<c:string,v:array<int>>>")
    got = {r["path"]: (r["rows"], r["places"], r["present"]) for r in A.observability(df).collect()}
    assert got == {"k": (2, 3, 2), "s": (2, 3, 2), "s.t": (1, 3, 1), "s.n": (1, 3, 1), "l": (1, 3, 1), "l[]": (1, 2, 1), "l[].c": (1, 2, 1), "l[].v": (1, 2, 1), "l[].v[]": (1, 2, 1)}
    assert {r["present"] for r in A.observability(df.limit(0)).collect()} == {0}
