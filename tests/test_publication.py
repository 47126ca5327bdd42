"""Writers that race, and hashes of files in many ranges."""

import hashlib
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from textloom.operators import store as V
from textloom.shared import create_if_absent
from textloom.sources.file_hashes import file_hashes

KEYS = ["k"]


def rows(spark, n):
    return spark.range(n).selectExpr("cast(id as string) k", "sha2(cast(id as string), 256) h")


def test_of_many_creators_one_succeeds(spark, tmp_path):
    path = str(tmp_path / "f")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: create_if_absent(spark, path, f"writer {i}"), range(24)))
    assert won.count(True) == 1 and open(path).read() == f"writer {won.index(True)}"
    assert [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["f"]


def test_two_writers_from_one_version(spark, tmp_path):
    path = str(tmp_path / "s")
    V.publish(rows(spark, 3), path, "s1", KEYS, "h")

    def write(i):
        try:
            V.publish(rows(spark, 5 + i), path, f"w{i}", KEYS, "h", version=1)
            return True
        except V.Conflict:
            return False

    with ThreadPoolExecutor(3) as pool:
        won = list(pool.map(write, range(3)))
    assert won.count(True) == 1
    version, name = V.pointed(spark, path)
    assert (version, name) == (2, f"w{won.index(True)}") and V.active(spark, path).count() == 5 + won.index(True)
    assert {r["snapshot_id"] for r in V.snapshots(spark, path).collect()} == {"s1", name}
    assert len(os.listdir(tmp_path / "s" / "snapshots")) == 2  # losers leave no rows
    with pytest.raises(V.Conflict, match="exists"):
        V.publish(rows(spark, 9), path, "s1", KEYS, "h")
    with pytest.raises(ValueError, match="no snapshot"):
        V.activate(spark, path, "never")
    V.activate(spark, path, "s1")
    assert V.pointed(spark, path) == (3, "s1") and V.active(spark, path).count() == 3


def test_a_failed_publication_can_be_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    monkeypatch.setattr(V, "activate", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        V.publish(rows(spark, 3), path, "s1", KEYS, "h")
    monkeypatch.undo()
    assert V.pointed(spark, path) == (0, None)
    assert V.publish(rows(spark, 3), path, "s1", KEYS, "h").first()["candidate_count"] == 3
    with pytest.raises(ValueError, match="no snapshot is active"):
        V.active(spark, str(tmp_path / "none"))


def test_file_hashes_are_those_of_the_bytes(spark, tmp_path):
    bodies = {
        "a": b"one line", "b": b"two\nlines\n", "c": b"\xef\xbb\xbfmarked\r\nx", "d": b"\n\n\n", "e": bytes(range(256)) * 50, "f": b"x" * 5000 + b"\n" + b"y\n" * 9000, "g": b"\xef\xbb\xbf\n", "h": "کتاب\n".encode() * 3000,
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r["file"][-1]: r["sha256"] for r in file_hashes(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {n: hashlib.sha256(b).hexdigest() for n, b in bodies.items()}


def test_ingest_compares_within_its_horizon(spark, tmp_path):
    """A key that comes again within the horizon is dropped, a later one is new; without a time all of the past counts."""
    from datetime import datetime

    from textloom.streaming import ingest as G

    rows = [("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 5)), ("a", datetime(2024, 1, 6)), ("c", datetime(2024, 1, 6)), ("a", datetime(2024, 2, 1)), ("c", datetime(2024, 2, 1))]
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], "k string, t timestamp").coalesce(1).write.parquet(str(tmp_path / f"x{k}"))
        part = next((tmp_path / f"x{k}").glob("part*"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    for name, more, want in (("h", {"at": "t", "horizon": "7 days"}, "aabcc"), ("all", {}, "abc")):
        G.ingest(G.stream_parquet(spark, str(tmp_path / "in"), 1), str(tmp_path / name), str(tmp_path / f"cp-{name}"), ["k"], **more).awaitTermination()
        assert "".join(sorted(r["k"] for r in spark.read.parquet(str(tmp_path / name)).collect())) == want
    with pytest.raises(Exception, match="another checkpoint"):
        G.ingest(G.stream_parquet(spark, str(tmp_path / "in"), 1), str(tmp_path / "h"), str(tmp_path / "cp-other"), ["k"]).awaitTermination()
