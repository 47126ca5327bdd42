"""Substring dedup by prefix-partitioned suffix trees over words.

A window of ``WINDOW`` words is repeated if its word sequence starts anywhere
else; every word under a repeated window goes. The suffixes (one for each word)
are never written out. Instead:

1. Prefixes. The least of the word-``PREFIX``-gram hashes in a window is the
   window's branching prefix; the places that hold one (about 1 word in 15) are
   the prefix's suffixes. Prefixes that occur once in the corpus cannot carry a
   repeat and are dropped: this is the only step whose traffic follows all text,
   with some 1.5 bytes of rows a byte of Parquet. A prefix that a task has seen to
   repeat is sent once by it, so a hot one is about a row a map task.
2. Contexts. Each surviving suffix gets its next words and, reversed, the words
   before it, as 48-bit word codes, as far as its windows reach (those in which
   it is the first of the least prefixes, so that each window has one owner). Equal contexts are folded by a pre-aggregated
   group-by, so a text that a third of the rows share is one context a map task.
3. Longer prefixes. The contexts of every prefix are counted, and a prefix with more than
   ``SUBTREE`` of them is made longer by ``e`` words: windows that reach ``e`` words further
   right go under the prefix with those words, the others, which then reach ``e`` words
   further left, under the one with those. ``e`` is half of the words that are free, so
   after at most five rounds a prefix is a whole window, whose suffixes are all the same
   repeat. No task gets more than ``SUBTREE`` suffixes of one prefix.
4. Subtrees. Suffixes are dealt by prefix and put in suffix order by Spark's
   external sort; longest common prefixes of neighbours then give each subtree's
   internal nodes. For every depth ``WINDOW - d`` the leaves below a node are told
   apart by the ``d`` words on their left: a node with two equal leaves is a
   repeat that reaches ``d`` words left and ``WINDOW - d`` right of the prefix.
5. Masks of repeated windows go back to their documents, which are rewritten.

Texts that are dealt by document (twice: to take contexts, and to be rewritten) are
packed by zstandard on the way. Word codes have 48 bits (64 take
over four times the input on disk), so a wrong match needs windows that differ only in words whose codes collide (2**-48 a pair). Documents are dealt by a 96-bit key of id and text.

Cases: null texts have no words (0, 0, empty kept text). Repeated rows (same id
and text) are each other's copies. Empty tables give empty results. Texts of any
length are scanned whole. Ids may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.scan import U64, WHITE, grams, mix, scan, tidy
from textloom.llm.scratch import discard, materialize

WINDOW = 35
PREFIX = 6
#: Bytes of a word's code.
CODE = 6
#: Suffixes (distinct contexts) of one prefix, which are held at once; beyond, the prefix is made longer.
SUBTREE = 2_000
#: Repeated prefixes that a task remembers.
REPEATED_KEPT = 500_000


def _slide(v: np.ndarray, w: int, op) -> np.ndarray:
    """op over every run of w consecutive values."""
    out, span = v, 1
    while span * 2 <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(h: np.ndarray, first: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (word numbers) and hashes of the branching prefixes of all windows of a chunk."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    g = grams(h, prefix) | U64(1)
    span = window - prefix + 1
    least = _slide(g.copy(), span, np.minimum)  # by window
    ends = np.repeat(first[1:], np.diff(first))[: len(least)]
    least[np.arange(len(least)) + window > ends] = 0
    padded = np.concatenate((np.zeros(span - 1, U64), least, np.zeros(span - 1, U64)))
    most = _slide(padded, span, np.maximum)
    places = np.flatnonzero(most[: len(g)] == g)
    return places, g[places]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as a zstandard frame: half the bytes of a shuffle of plain texts."""
    squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            frames = pa.array([squeeze(t or b"") for t in part.columns[-1].cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], frames], names=batch.schema.names)


def _packed(df: DataFrame) -> DataFrame:
    *lead, text = df.columns
    shapes = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in lead)
    return df.mapInArrow(tidy(_pack), f"{shapes}, {text} binary")


def _texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with the packed text column read again."""
    expand = zstandard.ZstdDecompressor().decompress
    k = batch.schema.get_field_index("text")
    for at in range(0, batch.num_rows, 1000):
        part = batch.slice(at, 1000)
        texts = pa.array([expand(t) for t in part.column(k).to_pylist()], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([texts if i == k else c for i, c in enumerate(part.columns)], names=batch.schema.names)


def _anchor_rows(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = np.zeros(0, U64)  # sent by this task with a weight of two or more
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for words in scan(batch.column("text"), WHITE):
                places, g = anchors(words.hash, words.first, window, prefix)
                doc = np.searchsorted(words.first, places, "right") - 1
                row = doc + words.rows.start
                # A prefix that repeats within the chunk is sent once, with its count; its other places here and
                # later, known to be shared, travel under keys of their own, so that no key gathers them all.
                kinds, once, n = np.unique(g, return_index=True, return_counts=True)
                known = np.isin(kinds, repeated, assume_unique=True)
                weight = np.full(len(g), 2, np.int32)
                weight[once[~known]] = n[~known]
                own = np.ones(len(g), bool)
                own[once[~known]] = False
                fresh = kinds[~known & (n > 1)]
                repeated = np.concatenate((repeated, fresh)) if len(repeated) + len(fresh) <= REPEATED_KEPT else fresh
                key = np.where(own, mix(g + places.astype(U64) * U64(0x9E3779B97F4A7C15) + k1[row].view(U64)), g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(key)), pa.array(weight), pa.array(k1[row]), pa.array(k2[row]), pa.array((places - words.first[doc]).astype(np.int32))], names=["g", "weight", "k1", "k2", "pos"]
                )

    return run


def _codes(words) -> np.ndarray:
    """The first ``CODE`` bytes of every word's hash."""
    return words.hash.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :CODE]


def _context_rows(window: int, prefix: int):
    """Each surviving suffix with its words right and (reversed) left of the prefix's start."""
    reach = window - prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for packed in batches for part in _texts(packed)):
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            lists = batch.column("places")
            lofs, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for words in scan(batch.column("text"), WHITE):
                lo, hi = lofs[words.rows.start], lofs[words.rows.stop]
                doc = np.repeat(np.arange(words.rows.stop - words.rows.start), np.diff(lofs[words.rows.start : words.rows.stop + 1]))
                pos = flat[lo:hi].astype(np.int64)
                at, end = words.first[doc] + pos, words.first[doc + 1]
                codes = _codes(words)
                g = grams(words.hash, prefix) | U64(1)
                for part in range(0, len(at), 8192):
                    s = slice(part, part + 8192)
                    rlen, llen = np.minimum(end[s] - at[s], window), np.minimum(pos[s], reach)
                    if reach:  # no further than the windows in which this prefix is the (first) least one
                        own = g[at[s], None]
                        after = g[np.minimum(at[s, None] + np.arange(1, reach + 1), len(g) - 1)] < own
                        before = g[np.maximum(at[s, None] - np.arange(1, reach + 1), 0)] <= own
                        rlen = np.minimum(rlen, np.where(after.any(1), after.argmax(1) + prefix, window))
                        llen = np.minimum(llen, np.where(before.any(1), before.argmax(1), reach))
                    right = _gather(codes, at[s, None] + np.arange(window), rlen)
                    left = _gather(codes, at[s, None] - 1 - np.arange(reach), llen)
                    row = doc[s] + words.rows.start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(g[at[s]])), right, left, pa.array(k1[row]), pa.array(k2[row]), pa.array(pos[s].astype(np.int32))], names=["g", "right", "left", "k1", "k2", "pos"]
                    ).filter(pa.array(rlen + llen >= window))

    return run


def _gather(codes: np.ndarray, index: np.ndarray, length: np.ndarray) -> pa.Array:
    """Rows of codes as binary values of CODE * length bytes."""
    taken = codes[np.clip(index, 0, max(len(codes) - 1, 0))]
    kept = taken[np.arange(index.shape[1]) < length[:, None]]
    ends = np.concatenate(([0], np.cumsum(length * CODE))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(kept.tobytes())])


def _unpack(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as a matrix of codes (0 beyond their ends) and their lengths."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // CODE
    length = np.diff(offsets)
    wide = np.zeros((offsets[-1] - offsets[0], 8), np.uint8)
    if column.buffers()[2] is not None:
        wide[:, 8 - CODE :] = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] * CODE : offsets[-1] * CODE].reshape(-1, CODE)
    out = np.zeros((len(column), width), U64)
    out[np.arange(width) < length[:, None]] = wide.view(">u8").ravel()
    return out, length


def _depth_keys(key: np.ndarray, right: np.ndarray, rlen: np.ndarray, left: np.ndarray, llen: np.ndarray, window: int):
    """For each d: which leaves have d words left and window - d right, and their node with those left words."""
    same = np.concatenate(([False], key[1:] == key[:-1]))
    differ = np.ones((len(key), window), bool)
    differ[1:] = right[1:] != right[:-1]
    common = np.where(differ.any(1), differ.argmax(1), window)  # longest common prefix with the row before
    common[~same] = 0
    label = np.zeros(len(key), U64)
    for d in range(left.shape[1] + 1):
        if d:
            label = mix(label * U64(0xD6E8FEB86659FD93) + left[:, d - 1].astype(U64) + U64(1))
        node = np.cumsum(common < window - d).astype(U64)
        yield d, (llen >= d) & (rlen >= window - d), node, label


def _subtrees(window: int, prefix: int):
    """Rows in suffix order -> (g, cd, mask) of repeated windows with lo to hi words on the left."""
    reach = window - prefix

    def solve(t: pa.Table) -> pa.RecordBatch:
        key, g, cd, n, lo, hi = (t[c].combine_chunks().to_numpy() for c in ("key", "g", "cd", "n", "lo", "hi"))
        right, rlen = _unpack(t["right"].combine_chunks(), window)
        left, llen = _unpack(t["left"].combine_chunks(), reach)
        mask = np.zeros(len(g), np.int64)
        for d, valid, node, label in _depth_keys(key, right, rlen, left, llen, window):
            at = np.flatnonzero(valid & (lo <= d) & (d <= hi))
            leaf = mix(node[at] * U64(0x9E3779B97F4A7C15) + label[at])
            order = np.argsort(leaf, kind="stable")
            equal = leaf[order][1:] == leaf[order][:-1]
            twice = n[at] > 1
            twice[order[1:][equal]] = True
            twice[order[:-1][equal]] = True
            mask[at[twice]] |= 1 << d
        keep = mask != 0
        return pa.RecordBatch.from_arrays([pa.array(g[keep]), pa.array(cd[keep]), pa.array(mask[keep])], names=["g", "cd", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 20_000:
                t = pa.Table.from_batches(held)
                key = t["key"].to_numpy()
                cut = int(np.argmax(key == key[-1]))  # the last prefix may go on
                if cut:
                    yield solve(t.slice(0, cut))
                    t = t.slice(cut)
                held, rows = t.to_batches(), t.num_rows
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def _longer_prefixes(folded: DataFrame, window: int, prefix: int, limit: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """Suffixes under prefixes (``key``) of at most ``limit`` of them, windows that are a prefix with more, and written tables.

    A prefix is ``a`` words before the first one's start and ``b`` from it on; its windows have
    ``lo`` to ``hi`` words before that start.
    """
    free, spent = window - prefix, []
    rows = folded.withColumns({"key": F.col("g"), "a": F.lit(0), "b": F.lit(prefix), "lo": F.lit(0), "hi": F.lit(free)})
    done = None
    while True:
        full = materialize(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("key"), "full-prefixes")
        spent.append(full)
        if full.isEmpty():
            return (rows if done is None else done.unionByName(rows)), None, spent
        fits = rows.join(full, "key", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        over = rows.join(full, "key", "left_semi")
        if not free:
            return done, over.select("g", "cd", F.expr("shiftleft(1L, lo)").alias("mask")), spent
        e = (free + 1) // 2
        turn = F.lit(window) - F.col("b") - e  # most words left of windows that reach e words further right
        further = over.where((F.octet_length("right") >= CODE * (F.col("b") + e)) & (F.col("lo") <= turn))
        further = further.withColumns({"key": F.xxhash64("key", F.lit(1), F.expr(f"substring(right, {CODE} * b + 1, {CODE * e})")), "hi": F.least("hi", turn), "b": F.col("b") + e})
        before = over.where((F.octet_length("left") >= CODE * (F.col("a") + e)) & (F.col("hi") > turn))
        before = before.withColumns({"key": F.xxhash64("key", F.lit(2), F.expr(f"substring(left, {CODE} * a + 1, {CODE * e})")), "lo": F.greatest("lo", turn + 1), "a": F.col("a") + e})
        rows = materialize(further.unionByName(before.select(further.columns)), "longer-prefixes")
        spent.append(rows)
        free -= e


def _rewrite(window: int):
    """Documents with their masks -> kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for packed in batches for part in _texts(packed)):
            lists = batch.column("marks")
            lofs = lists.offsets.to_numpy()
            marks = lists.flatten() if lists.null_count == 0 else lists.values
            mpos = marks.field("pos").to_numpy(zero_copy_only=False).astype(np.int64) if len(marks) else np.zeros(0, np.int64)
            mmask = marks.field("mask").to_numpy(zero_copy_only=False).astype(np.int64) if len(marks) else np.zeros(0, np.int64)
            base = lofs[0] if lists.null_count == 0 else 0
            kept, total, removed = [], [], []
            for words in scan(batch.column("text"), WHITE, hashes=False):
                n = len(words.start)
                lo, hi = lofs[words.rows.start] - base, lofs[words.rows.stop] - base
                doc = np.repeat(np.arange(len(words.first) - 1), np.diff(lofs[words.rows.start : words.rows.stop + 1]))
                pos, mask = mpos[lo:hi] + words.first[doc], mmask[lo:hi]
                change = np.zeros(n + 1, np.int64)
                d = 0
                while len(mask) and (mask >> d).any():
                    begin = pos[(mask >> d) & 1 == 1] - d
                    change += np.bincount(begin, minlength=n + 1) - np.bincount(begin + window, minlength=n + 1)
                    d += 1
                keep = np.cumsum(change[:n]) == 0
                # Kept words, each with the space before it, are copied by one byte mask.
                size = np.where(keep, words.end - words.start + 1, 0)
                ends = np.concatenate(([0], np.cumsum(size)))
                src = np.repeat(words.start - 1 - ends[:-1], size) + np.arange(ends[-1])
                out = words.buf[np.maximum(src, 0)]
                out[ends[:-1][keep]] = 0x20
                data = out.tobytes()
                byte_ends = ends[words.first]
                kept += [data[a + 1 : b] for a, b in zip(byte_ends[:-1], byte_ends[1:])]
                total.append(words.counts)
                gone = np.concatenate(([0], np.cumsum(~keep)))[words.first]
                removed.append(np.diff(gone))
            arrays = [batch.column(i) for i in range(batch.num_columns - 2)]
            whole = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*arrays, whole(total), whole(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=[*batch.schema.names[:-2], "_words", "_removed", "_kept"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: Sequence[str] = (), prefix: int = PREFIX, subtree: int = SUBTREE) -> DataFrame:
    """``id_col, *carry, n_words, n_removed, kept_text`` of every row of ``docs``."""
    prefix = min(prefix, window)
    text, key = F.col(text_col), [F.col(id_col), F.col(text_col)]
    keyed = docs.select(F.xxhash64(*key).alias("k1"), F.hash(*reversed(key)).alias("k2"), F.col(id_col).alias("_id"), *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)), text.alias("text"))
    bodies = keyed.select("k1", "k2", "text")

    found = bodies.mapInArrow(tidy(_anchor_rows(window, prefix)), "g long, weight int, k1 long, k2 int, pos int")
    shared = found.withColumn("n", F.sum("weight").over(Window.partitionBy("g"))).where("n > 1")
    places = shared.groupBy("k1", "k2").agg(F.array_distinct(F.collect_list("pos")).alias("places"))
    contexts = _packed(bodies).join(places, ["k1", "k2"]).mapInArrow(tidy(_context_rows(window, prefix)), "g long, right binary, left binary, k1 long, k2 int, pos int")
    contexts = materialize(contexts.withColumn("cd", F.xxhash64("g", "right", "left")), "suffix-contexts", "zstd")

    folded = materialize(contexts.groupBy("g", "right", "left", "cd").agg(F.count("*").alias("n")), "suffixes", "zstd")
    suffixes, whole, spent = _longer_prefixes(folded, window, prefix, subtree)
    ordered = suffixes.select("key", "g", "right", "left", "cd", "n", "lo", "hi").repartition("key").sortWithinPartitions("key", "right")
    masks = ordered.mapInArrow(tidy(_subtrees(window, prefix)), "g long, cd long, mask long")
    masks = materialize(masks if whole is None else masks.unionByName(whole), "suffix-masks")
    discard(folded, *spent)
    hits = contexts.select("g", "cd", "k1", "k2", "pos").join(masks, ["g", "cd"])
    marks = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "mask")).alias("marks"))

    joined = _packed(keyed).join(marks, ["k1", "k2"], "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<pos:int,mask:bigint>>")))
    lead = ["_id", *(f"_carry{i}" for i in range(len(carry)))]
    shape = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in lead)
    out = joined.select(*lead, "text", "marks").mapInArrow(tidy(_rewrite(window)), f"{shape}, _words long, _removed long, _kept string")
    return out.select(
        F.col("_id").alias(id_col), *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)), F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_kept").alias("kept_text")
    )
