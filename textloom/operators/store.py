"""Versioned store: snapshots, retention, diffs, manifests, ledgers, audits.

Spark has no transaction over several tables: a snapshot is written to a folder of its
own and verified; then a file claims its id, and a file of the next version points to
it. Both are created only if absent, so of writers that start from one version one
succeeds and the others get a :class:`Conflict` and leave nothing behind.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.hashing import manifest_checksum
from textloom.operators.selection import latest_per_key
from textloom.shared import create_if_absent, remove


def snapshot_diff(active: DataFrame, incoming: DataFrame, keys: list[str], content: str, history: DataFrame | None = None) -> DataFrame:
    """JON18: NEW, UNCHANGED or CHANGED by key and content hash; HISTORICAL if an older version had that content."""
    old = active.select(*keys, F.col(content).alias("_old"))
    out = incoming.join(old, keys, "left")
    seen = F.lit(False)
    if history is not None:
        past = history.select(*keys, F.col(content).alias("_past")).distinct()
        out = out.join(past, [*(out[k] == past[k] for k in keys), out[content] == past["_past"]], "left").drop(*(past[k] for k in keys))
        seen = F.col("_past").isNotNull()
    state = F.when(F.col("_old") == F.col(content), "UNCHANGED").when(seen, "HISTORICAL").when(F.col("_old").isNull(), "NEW").otherwise("CHANGED")
    return out.withColumn("change", state).drop("_old", "_past")


def retain(previous: DataFrame, incoming: DataFrame, source_keys: list[str], full_rebuild: bool = False) -> DataFrame:
    """JON19/SET3: rows of sources that do not come in again, and all that comes in."""
    if full_rebuild:
        return incoming
    return previous.join(incoming.select(*source_keys).distinct(), source_keys, "left_anti").unionByName(incoming)


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """SET5: incoming rows replace equal keys, or are dropped where the key exists."""
    if update:
        return target.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)
    return target.unionByName(incoming.join(target.select(*keys), keys, "left_anti"))


def build_snapshot(rows: DataFrame, snapshot_id: str, keys: list[str], content: str) -> DataFrame:
    """STO3/HSH8: one manifest row: counts and a checksum that does not depend on row order.

    Lines are hashed by bucket first, so no task or driver gathers all of them.
    """
    line = F.concat_ws("\u0000", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.col(content))
    buckets = rows.withColumn("_b", F.substring(F.sha2(line, 256), 1, 3)).groupBy("_b").agg(F.count("*").alias("n"), manifest_checksum([F.first("_b")], line).alias("h"))
    return buckets.agg(F.sum("n").alias("candidate_count"), manifest_checksum([F.lit(snapshot_id)], F.concat_ws(":", "_b", "h")).alias("manifest_checksum")).select(
        F.lit(snapshot_id).alias("snapshot_id"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), "manifest_checksum"
    )


def verify_snapshot(rows: DataFrame, manifest: DataFrame, keys: list[str], content: str) -> DataFrame:
    """STO5/SNK12: manifest rows that the stored rows do not bear out."""
    wanted = manifest.first()
    again = build_snapshot(rows, wanted["snapshot_id"], keys, content)
    both = manifest.join(again.withColumnsRenamed({"candidate_count": "_n", "manifest_checksum": "_h"}), "snapshot_id")
    return both.where((F.col("candidate_count") != F.col("_n")) | ~F.col("manifest_checksum").eqNullSafe(F.col("_h"))).drop("_n", "_h")


class Conflict(ValueError):
    """Another writer was first."""


def publish(rows: DataFrame, path: str, snapshot_id: str, keys: list[str], content: str, version: int | None = None) -> DataFrame:
    """STO1: write, verify, claim the id, then move the pointer on from ``version`` (None: the one that is there now). Returns the manifest."""
    spark = rows.sparkSession
    version = pointed(spark, path)[0] if version is None else version
    folder = f"snapshots/{uuid.uuid4().hex}"
    claimed = False
    try:
        rows.write.mode("error").parquet(f"{path}/{folder}")
        stored = spark.read.parquet(f"{path}/{folder}")
        # From what was written: a plan that is run again may give other rows.
        manifest = spark.createDataFrame(build_snapshot(stored, snapshot_id, keys, content).collect(), _MANIFEST)
        if not verify_snapshot(stored, manifest, keys, content).isEmpty():
            raise ValueError(f"snapshot {snapshot_id} does not match its manifest")
        claimed = create_if_absent(spark, _claim(path, snapshot_id), json.dumps({**manifest.first().asDict(), "folder": folder}))
        if not claimed:
            raise Conflict(f"snapshot {snapshot_id} exists")
        activate(spark, path, snapshot_id, version)
    except Exception:
        if claimed:
            remove(spark, _claim(path, snapshot_id))
        remove(spark, f"{path}/{folder}")
        raise
    return manifest


_POINTER = "version long, snapshot_id string"
_MANIFEST = "snapshot_id string, candidate_count long, manifest_checksum string"


def _claim(path: str, snapshot_id: str) -> str:
    return f"{path}/_claims/{hashlib.sha256(snapshot_id.encode()).hexdigest()}"


def _read_json(spark, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def snapshots(spark, path: str) -> DataFrame:
    """Manifests and folders of all snapshots that were published and not withdrawn."""
    found = _read_json(spark, f"{path}/_claims", f"{_MANIFEST}, folder string")
    return spark.createDataFrame([], f"{_MANIFEST}, folder string") if found is None else found


def pointed(spark, path: str) -> tuple[int, str | None]:
    """Version and snapshot of the pointer; (0, None) before the first."""
    found = _read_json(spark, f"{path}/_pointer", _POINTER)
    row = None if found is None else found.agg(F.max(F.struct("version", "snapshot_id")).alias("p")).first()["p"]
    return (row["version"], row["snapshot_id"]) if row is not None else (0, None)


def activate(spark, path: str, snapshot_id: str, version: int | None = None) -> None:
    """STO5: point to a snapshot (again) by the version after ``version`` (None: the one that is there now).

    Older versions stay, so readers always find one. If another writer made that version, :class:`Conflict`.
    """
    if _read_json(spark, _claim(path, snapshot_id), _MANIFEST) is None:
        raise ValueError(f"no snapshot {snapshot_id}")
    after = (pointed(spark, path)[0] if version is None else version) + 1
    if not create_if_absent(spark, f"{path}/_pointer/{after:019d}", json.dumps({"version": after, "snapshot_id": snapshot_id})):
        raise Conflict(f"another writer made version {after}")


def active(spark, path: str) -> DataFrame:
    """SRC17: rows of the active snapshot; only its folder is read."""
    name = pointed(spark, path)[1]
    if name is None:
        raise ValueError("no snapshot is active")
    return spark.read.parquet(f"{path}/{_read_json(spark, _claim(path, name), 'folder string').first()['folder']}")


def publish_incremental(rows: DataFrame, path: str, snapshot_id: str, keys: list[str], content: str, source_keys: list[str], expected: str | None, full_rebuild: bool = False) -> DataFrame:
    """STO1: guard, compose, publish. ``expected`` names the snapshot that must be active (None: none yet); rows of sources that do not come in are retained.

    The pointer moves from the version that was composed from, or not at all.
    """
    spark = rows.sparkSession
    version, now = pointed(spark, path)
    if now != expected:
        raise ValueError(f"the active snapshot is {now}, not {expected}")
    composed = rows if now is None else retain(active(spark, path), rows, source_keys, full_rebuild)
    return publish(require_rows(composed, "a snapshot has rows"), path, snapshot_id, keys, content, version)


class MemoryStore:
    """STO2: the same snapshots held as DataFrames: one publication at a time, none half done."""

    def __init__(self):
        self._lock, self._snapshots, self._active = threading.Lock(), {}, None

    def publish(self, rows: DataFrame, snapshot_id: str, keys: list[str], content: str, source_keys: list[str], expected: str | None = None, full_rebuild: bool = False) -> DataFrame:
        with self._lock:
            if self._active != expected:
                raise ValueError(f"the active snapshot is {self._active}, not {expected}")
            if snapshot_id in self._snapshots:
                raise ValueError(f"snapshot {snapshot_id} exists")
            composed = rows if expected is None else retain(self._snapshots[expected][0], rows, source_keys, full_rebuild)
            manifest = build_snapshot(composed, snapshot_id, keys, content)
            self._snapshots[snapshot_id], self._active = (composed, manifest), snapshot_id
            return manifest

    def restore(self, snapshot_id: str) -> None:
        with self._lock:
            if snapshot_id not in self._snapshots:
                raise ValueError(f"no snapshot {snapshot_id}")
            self._active = snapshot_id

    def active(self) -> DataFrame:
        return self._snapshots[self._active][0]


def record_versions(versions: DataFrame, keys: list[str], seen: str) -> DataFrame:
    """STO4: current flag, first and last sighting of each version."""
    spans = versions.groupBy(*keys, "checksum").agg(F.min(seen).alias("first_seen_at"), F.max(seen).alias("last_seen_at"))
    newest = latest_per_key(spans, keys, ["last_seen_at", "checksum"]).select(*keys, F.col("checksum").alias("_c"))
    return spans.join(newest, keys).withColumn("is_current", F.col("checksum") == F.col("_c")).drop("_c")


def project_ledger(events: DataFrame, keys: list[str], at: str, event_id: str, basis: DataFrame | None = None) -> DataFrame:
    """STO8/JON22/23: latest event of each key, of events whose basis still exists."""
    if basis is not None:
        events = events.join(basis.select(*keys).distinct(), keys, "left_semi")
    return latest_per_key(events, keys, [at, event_id])


def authority_fold(events: DataFrame, entry: str, version: str) -> DataFrame:
    """STO6: entries whose last publication event leaves them published."""
    return latest_per_key(events, [entry], [version]).where("event_kind IN ('PUBLISH', 'ROLLBACK')")


def conflicting_accepts(decisions: DataFrame, basis: str, canonical: str) -> DataFrame:
    """STO13"""
    return decisions.where("disposition = 'ACCEPT'").groupBy(basis).agg(F.array_sort(F.collect_set(canonical)).alias("canonicals")).where(F.size("canonicals") > 1)


def promotion_plan(accepted: DataFrame, lexicon: DataFrame) -> DataFrame:
    """STO12/MSC6: create an entry, add a reading, or nothing to do."""
    known = lexicon.select("normalized", F.col("canonicals").alias("_have"))
    out = accepted.join(known, "normalized", "left")
    action = F.when(F.col("_have").isNull(), "CREATE_ENTRY").when(F.array_contains("_have", F.col("canonical")), "ALREADY_PRESENT").otherwise("ADD_READING")
    return out.withColumn("action", action).drop("_have")


def insert_evidence(stored: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """STO11: INSERT, IDEMPOTENT or VIOLATION for every incoming row."""
    out = incoming.join(stored.select(key, F.col(content).alias("_old"), F.lit(True).alias("_there")), key, "left")
    return out.withColumn("outcome", F.when(F.col("_there").isNull(), "INSERT").when(F.col("_old").eqNullSafe(F.col(content)), "IDEMPOTENT").otherwise("VIOLATION")).drop("_old", "_there")


def immutable_breaks(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """STO9: rows of an append-only table that were DELETED or UPDATED between two reads of it."""
    old = before.select(key, F.struct(*columns).alias("_old"))
    new = after.select(key, F.struct(*columns).alias("_new"), F.lit(True).alias("_there"))
    both = old.join(new, key, "left")
    finding = F.when(F.col("_there").isNull(), "DELETED").when(~F.col("_old").eqNullSafe(F.col("_new")), "UPDATED")
    return both.withColumn("finding", finding).where("finding IS NOT NULL").select(key, "finding")


def lateral_items(df: DataFrame, column: str, item: str) -> DataFrame:
    """JON20: a row for each element of a JSON array of texts; rows without elements make none."""
    return df.withColumn(item, F.explode(F.from_json(F.col(column), "array<string>"))).drop(column)


def with_manifest(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """JON24: every row beside the one row of a manifest; more or fewer rows there are an error."""
    if len(manifest.limit(2).take(2)) != 1:
        raise ValueError("a manifest has one row")
    return rows.crossJoin(F.broadcast(manifest))


def bounded(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """SRT9: the first rows, 1 to 100 of them."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1-100")
    return df.orderBy(*order).limit(limit)


def publication_findings(events: DataFrame, entry: str, version: str) -> DataFrame:
    """STO6: events that their entry's state does not allow: publishing what is published, withdrawing what is not, rolling back to nothing."""
    w = Window.partitionBy(entry).orderBy(version)
    before = F.lag("event_kind").over(w)
    live = F.coalesce(before.isin("PUBLISH", "ROLLBACK"), F.lit(False))
    kind = F.col("event_kind")
    finding = F.when((kind == "PUBLISH") & live, "ALREADY_PUBLISHED").when((kind == "WITHDRAW") & ~live, "NOT_PUBLISHED").when((kind == "ROLLBACK") & before.isNull(), "NOTHING_TO_ROLL_BACK")
    return events.withColumn("finding", finding).where("finding IS NOT NULL").select(entry, version, "finding")


def violations(df: DataFrame, rules: Sequence[tuple[str, Column]], ident: list[str]) -> DataFrame:
    """FLT12/STO10/JON27: a row for every (row, broken rule); a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules)))
    return df.select(*ident, F.explode(broken).alias("violation"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """STO16/AGG30: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_parents(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """STO10: child rows without a parent."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """FLT10: fails if ``df`` is empty; reads one row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """STO15/SET6: rows on one side only."""
    return a.exceptAll(b).withColumn("side", F.lit("LEFT")).unionByName(b.exceptAll(a).withColumn("side", F.lit("RIGHT")))
