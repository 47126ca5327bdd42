"""Media columns: chroma fingerprints of audio, and their alignment.

*Fingerprint.* PCM is cut into windowed frames; spectral energy is folded to 12
pitch classes and smoothed over time. An integral image over (frame, pitch class)
gives the sum of any rectangle in four look-ups; ``FILTERS`` rectangles-against-
rectangles are taken at every frame, each log ratio is quantised to two bits of a
Gray code, and the codes are packed into one 32-bit integer a frame.

*Alignment.* Every query is held against every recording at every offset that
leaves ``OVERLAP`` frames: no shared integer is asked for. Bits count as 1 and -1,
so the agreement at all offsets of a pair is one correlation, taken for a tile of
pairs by Fourier transforms and one matrix product a frequency. Sums are whole
numbers, and rounding makes them exact. An offset fits if the share of differing
bits over the whole overlap is at most ``BIT_ERRORS``; the best has most bits below
that limit, so that a short overlap of pauses does not stand before a long one of
sound.

The search holds a block of queries (``BLOCK`` fingerprints) on every executor and
streams all recordings past it, block by block: any number of queries is a number
of passes, and nothing broadcast grows with the data. The work is a constant for
each pair of a query and a recording of equal lengths. Equal fingerprints are one
class from the start, so copies neither meet each other nor multiply results: rows
carry their class, matches are between classes. A worker holds 33 transforms of each
recording of a tile.

The tables at hand hold no sound, so :func:`render` turns a vector into a melody:
one note for each component, its pitch class the component's normal quantile.
Real recordings enter as 16-bit PCM through :func:`fingerprints`.

Cases: null or empty media, and media shorter than a filter, have an empty
fingerprint and match nothing; they are one class. Null elements count as 0. Ties
between offsets go to the least shift. Repeated rows are one class. Empty tables
and further columns are handled alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import materialize

RATE, FRAME, HOP = 2000, 512, 128
NOTE = 256
CLASSES = 12
#: Frames that the widest filter spans.
SPAN = 16
#: Largest share of differing bits and least frames of overlap of a match.
BIT_ERRORS, OVERLAP = 0.25, 24
BLOCK = 10_000
#: Most queries or recordings on a side of a tile, its recordings for one set of spectra, and its places over a side.
SIDE, SETS, PLACES = 64, 16, 1 << 14


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width) of the 16 filters, by rule: four kinds over four sizes."""
    return [(kind, (5 * kind + 3 * size) % 7, 3 + size % 3, 4 << (size % 3)) for kind in range(4) for size in range(4)]


FILTERS = filters()
#: Steps of the log ratio between the two bits of a code.
STEPS = (-0.15, 0.0, 0.15)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def render(vector: np.ndarray) -> np.ndarray:
    """A vector as 16-bit PCM: a note with one overtone for each component."""
    v = np.nan_to_num(np.asarray(vector, float))
    z = (v - v.mean()) / (v.std() or 1.0)
    quantile = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z])
    pitch = 220.0 * 2 ** (np.minimum(CLASSES - 1, (CLASSES * quantile).astype(int)) / CLASSES)
    turn = 2 * np.pi * pitch[:, None] * np.arange(NOTE) / RATE
    return (12000 * (np.sin(turn) + 0.5 * np.sin(2 * turn))).astype("<i2").ravel()


_BINS = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = (_BINS >= 110) & (_BINS < 950)
_FOLD = np.zeros((len(_BINS), CLASSES))
_FOLD[np.flatnonzero(_USED), np.round(CLASSES * np.log2(_BINS[_USED] / 220)).astype(int) % CLASSES] = 1
_WINDOW = np.hanning(FRAME)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Pitch-class energies by frame, smoothed over five frames and scaled to unit length."""
    if len(pcm) < FRAME:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME)[::HOP]
    energy = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)) ** 2 @ _FOLD
    padded = np.pad(energy, ((2, 2), (0, 0)), mode="edge")
    smooth = sum(w * padded[k : k + len(energy)] for k, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    return smooth / np.maximum(np.linalg.norm(smooth, axis=1, keepdims=True), 1e-9)


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """One packed 32-bit integer for every frame at which all filters fit."""
    image = chroma(pcm)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    sums = np.zeros((len(image) + 1, CLASSES + 1))
    sums[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return sums[at + x1, y1] - sums[at + x0, y1] - sums[at + x1, y0] + sums[at + x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:  # whole rectangle against the rows around it
            a, b = area(0, w, y, y + h), area(0, w, 0, CLASSES) / 2
        elif kind == 1:  # lower half against upper half
            a, b = area(0, w, y, y + (h + 1) // 2), area(0, w, y + (h + 1) // 2, y + h)
        elif kind == 2:  # earlier half against later half
            a, b = area(0, w // 2, y, y + h), area(w // 2, w, y, y + h)
        else:  # one diagonal against the other
            m, k = w // 2, y + (h + 1) // 2
            a, b = area(0, m, y, k) + area(m, w, k, y + h), area(m, w, y, k) + area(0, m, k, y + h)
        code = np.searchsorted(STEPS, np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0))))
        out = out << np.uint32(2) | _GRAY[code]
    return out


def best_offset(query: np.ndarray, other: np.ndarray, votes: dict[int, int] | None = None) -> tuple[int, int, float] | None:
    """(offset, overlap, bit error) of the best of all offsets; offset is other's place of query's start. ``votes`` is not needed."""
    best, most = None, 0.0
    for offset in sorted(range(OVERLAP - len(query), len(other) - OVERLAP + 1), key=lambda k: (abs(k), k)):
        a, b = max(0, -offset), max(0, offset)
        m = min(len(query) - a, len(other) - b)
        if m < OVERLAP:
            continue
        wrong = int(np.bitwise_count(query[a : a + m] ^ other[b : b + m]).sum())
        margin = BIT_ERRORS * 32 * m - wrong
        if margin >= 0 and (best is None or margin > most):
            best, most = (offset, m, wrong / (32 * m)), margin
    return best


def _smooth(n: int) -> int:
    """The least number from ``n`` on with no prime factor over 5."""
    while True:
        k = n
        for f in (2, 3, 5):
            while k % f == 0:
                k //= f
        if k == 1:
            return n
        n += 1


def _runs(prints: list[np.ndarray]) -> list[np.ndarray]:
    """Places of the prints that can overlap enough, in runs of like lengths."""
    size = np.array([len(p) for p in prints], np.int64)
    order = np.argsort(size, kind="stable")
    order = order[size[order] >= OVERLAP]
    cuts, first = [], None
    for k, n in enumerate(size[order].tolist()):
        if first is None or n > 1.5 * first:
            first = n
            cuts.append(k)
    return np.split(order, cuts[1:]) if cuts else []


#: Weight of a frame: added to the agreement of its bits, the sum is 0 at the limit of bit errors.
_WEIGHT = 32 * (1 - 2 * BIT_ERRORS)


def _spectra(prints: list[np.ndarray], size: int, kind: type, weight: float) -> np.ndarray:
    """Fourier transforms [frequency, print, channel] of the 32 bits as 1 and -1, and of a weight a frame."""
    bits = np.zeros((len(prints), 33, size), kind)
    for i, p in enumerate(prints):
        bits[i, :32, : len(p)] = 2.0 * np.unpackbits(p.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1).T - 1
        bits[i, 32, : len(p)] = weight
    return np.ascontiguousarray(np.fft.rfft(bits).transpose(2, 0, 1))


def align(queries: list[np.ndarray], others: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, other, offset, overlap, differing bits) of the best offset of every pair that has one, as arrays for each tile."""
    nq, no = np.array([len(p) for p in queries]), np.array([len(p) for p in others])
    # Offsets with enough overlap do not fall on others' places round the circle.
    size = _smooth(int(nq.max() + no.max()) - OVERLAP)
    kind = np.float32 if (32 + _WEIGHT) * math.sqrt(int(nq.max()) * int(no.max())) < 1 << 17 else np.float64
    root = math.sqrt(_WEIGHT)
    shift = np.arange(size)
    shift[shift > no.max() - OVERLAP] -= size
    side = max(1, min(SIDE, PLACES // size))
    for begin in range(0, len(others), side * SETS):
        spectra = _spectra(others[begin : begin + side * SETS], size, kind, -root).transpose(0, 2, 1)
        for q in range(0, len(queries), side):
            mine = _spectra(queries[q : q + side], size, kind, root).conj()
            late = shift[:, None] >= OVERLAP - nq[q : q + side]
            for o in range(begin, min(len(others), begin + side * SETS), side):
                value = np.fft.irfft(mine @ spectra[:, :, o - begin : o - begin + side], size, axis=0)
                early = shift[:, None] <= no[o : o + side] - OVERLAP
                place, i, j = np.nonzero((value > -0.5) & late[:, :, None] & early[:, None, :])
                if not len(place):
                    continue
                offset, excess = shift[place], value[place, i, j]
                i, j = i + q, j + o
                overlap = np.minimum(nq[i] - np.maximum(0, -offset), no[j] - np.maximum(0, offset))
                wrong = np.rint((32 * overlap - _WEIGHT * overlap - excess) / 2).astype(np.int64)
                margin = BIT_ERRORS * 32 * overlap - wrong
                fits = (overlap >= OVERLAP) & (margin >= 0)
                found = [x[fits] for x in (i, j, offset, overlap, wrong, margin)]
                order = np.lexsort((found[2], np.abs(found[2]), -found[5], found[1], found[0]))
                found = [x[order] for x in found]
                new = np.ones(len(order), bool)
                new[1:] = (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])
                yield tuple(x[new] for x in found[:5])


class Queries:
    """A block of queries, in runs of like lengths."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        self.ids = np.array(ids, np.int64)
        self.runs = [(at, [prints[k] for k in at]) for at in _runs(prints)]

    def matches(self, ids: list[int], others: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Columns query, class, offset, overlap and bit error of all matches with recordings of other classes."""
        own = np.array(ids, np.int64)
        out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),)]
        for there in _runs(others):
            held = [others[k] for k in there]
            for here, prints in self.runs:
                for i, j, offset, overlap, wrong in align(prints, held):
                    query, other = self.ids[here[i]], own[there[j]]
                    out.append(tuple(x[query != other] for x in (query, other, offset, overlap, wrong / (32 * overlap))))
        return tuple(map(np.concatenate, zip(*out)))


def _prints(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for x in batch.column("media").to_pylist():
                if not x:
                    prints.append(np.zeros(0, np.uint32))
                else:
                    pcm = render(np.array([0.0 if c is None else c for c in x])) if kind == "vector" else np.frombuffer(x[: len(x) // 2 * 2], "<i2")
                    prints.append(fingerprint(pcm.astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([p.astype("<u4").tobytes() for p in prints], pa.binary())], names=["_id", "print"])

    return run


def fingerprints(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """``id_col, print`` (little-endian 32-bit integers) of a column of 16-bit PCM bytes, or of vectors to be rendered."""
    kind = "pcm" if dict(media.dtypes)[media_col] == "binary" else "vector"
    narrow = media.select(F.col(id_col).alias("_id"), F.col(media_col).alias("media"))
    return narrow.mapInArrow(_prints(kind), f"_id {narrow.schema['_id'].dataType.simpleString()}, print binary").select(F.col("_id").alias(id_col), "print")


def search(prints: DataFrame, id_col: str, is_query, block: int = BLOCK) -> DataFrame:
    """``id_col, class_id, n_frames, is_query, matches`` of every row.

    Classes are rows of one fingerprint, named by their least id. ``matches`` of a
    query's class lists every other class that aligns with it: class, offset,
    overlap and share of differing bits. Rows that are no query have null.
    """
    spark = prints.sparkSession
    rows = materialize(prints.select(F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), "print", F.sha2("print", 256).alias("digest")), "prints")
    classes = rows.groupBy("digest").agg(F.min("id").alias("class_id"), F.bool_or("q").alias("q"), F.first("print").alias("print"))
    classes = materialize(classes, "print-classes")
    real = classes.where("length(print) > 0 AND class_id IS NOT NULL")

    def passed(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                prints = [np.frombuffer(p, "<u4") for p in batch.column("print").to_pylist()]
                columns = shared.value.matches(batch.column("class_id").to_pylist(), prints)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["query", "class_id", "offset", "overlap", "bit_error"])

        return run

    found, ids, held = [], [], []

    def flush() -> None:
        shared = spark.sparkContext.broadcast(Queries(list(ids), list(held)))
        found.append(real.select("class_id", "print").mapInArrow(passed(shared), "query long, class_id long, offset int, overlap int, bit_error double"))
        ids.clear()
        held.clear()

    for r in real.where("q").select("class_id", "print").toLocalIterator():
        ids.append(r["class_id"])
        held.append(np.frombuffer(bytes(r["print"]), "<u4"))
        if len(ids) >= block:
            flush()
    flush()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    match = F.struct("class_id", "offset", "overlap", "bit_error")
    lists = every.groupBy("query").agg(F.array_sort(F.collect_list(match)).alias("found")).withColumnRenamed("query", "class_id")
    named = classes.select("digest", "class_id").join(lists, "class_id", "left")
    out = rows.select("id", "q", "digest", F.floor(F.length("print") / 4).alias("n_frames")).join(named, "digest")
    none = F.array().cast("array<struct<class_id:bigint,offset:int,overlap:int,bit_error:double>>")
    return out.select(F.col("id").alias(id_col), "class_id", "n_frames", F.col("q").alias("is_query"), F.when(F.col("q"), F.coalesce("found", none)).alias("matches"))
