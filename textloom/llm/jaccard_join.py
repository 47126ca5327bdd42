"""N-gram Jaccard join: size-aware, with heavy and light sets apart.

A document's set holds the hashes of its distinct word shingles; equal sets are
one set from the start (``sid``), so copies never meet each other. Two sets of
sizes a and b are linked if they share at least ``o(a, b)`` shingles.

*Light sets* (size up to a boundary) enumerate their subsets of the fixed sizes
``o(a, b)`` can take for them. Sets that share a subset of size c overlap by c, so
in each subset's list all partners with ``o <= c`` link to its smallest member;
no pair is looked at, and no link is lost (``o`` grows with both sizes).

*Heavy sets* scan inverted lists, without the longest ones: with an order of
shingles from rare to frequent, a set of n needs only its first
``n - ceil(0.8 n) + 1`` shingles. The order ranks the most frequent shingles
(counted over all documents, in windows of ``COUNT_WINDOW`` shingles; the
``RANKED`` most frequent are broadcast: 16 bytes each, a fixed bound) after all
others; any fixed order is exact, this one keeps the lists short.

The boundary is where the number of subsets first outweighs the postings that the
same sets would put into lists, by the histogram of set sizes.

Links. A list of m sets is not m^2 pairs: first each set is compared only with
its list's leader (least ``sid``, so a group of near copies agrees on few leaders),
then components are formed. What is left are pairs of one leader's sets that are
in different components. Each leader's sets are dealt as tiles: *heads* (sets outside
the leader's largest component, at most about ``HEAD_BYTES``) against *rows* (about
``ROWS`` sets). A first pass tests all pairs of a tile by size and by parity sketches of over
two bits a shingle, whose Hamming distance never exceeds the true difference, and
gives the sets that have a partner left; a second pass deals only those, with their
whole sets, verifies, and joins components as it goes: a pair whose components are
joined is not looked at, and a tile gives fewer links than it has rows. All
pruning is exact, and no pair is ever a row: rows grow with heads times rows over a tile's size.

Only ids, sizes and hashes are shuffled, and of the whole sets those that share a
rare shingle with another. Shingles and ``sid`` have 64 bits: some 25 pairs of 3e10 different
sets would be taken as equal.

Cases: null texts and texts without words have an empty set and stay alone. Texts
with fewer words than a shingle have one, the whole sequence. Repeated rows are
copies. Null ids take part but are never a component's id (null if it has no
other). Empty tables give empty results. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.scan import U64, WHITE, grams, mix, scan, tidy
from textloom.llm.scratch import discard, materialize

SHINGLE = 5
#: Largest number of frequent shingles that are ranked and broadcast (16 bytes each).
RANKED = 200_000
#: Shingles whose frequencies are counted together; one that occurs twice in no window stays unranked.
COUNT_WINDOW = 4_000_000
#: Largest light set that is considered, and what a posting costs against a subset.
LIGHT_MOST, POSTING_COST = 16, 3.0
#: Up to so many sets, the ids of those to fetch are broadcast (24 bytes each); beyond, joined by shuffle.
FETCH_BROADCAST = 250_000
#: Bytes of heads' shingles and number of rows of a tile.
HEAD_BYTES, ROWS = 8 << 20, 4096
#: Pairs of a tile up to which no sketch is made.
FEW = 64


def needed(a: int, b: int) -> int:
    """Least overlap of linked sets: 100 * overlap >= 80 * union."""
    return -(-4 * (a + b) // 9)


def doc_sets(words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a chunk, ascending, with each document's first."""
    n_words, first = words.counts, words.first
    g = grams(words.hash, k)
    sizes = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(begin[-1], U64)
    for i, (a, n) in enumerate(zip(first[:-1].tolist(), n_words.tolist())):
        if n >= k:
            part = out[begin[i] : begin[i + 1]]
            part[:] = g[a : a + n - k + 1]
            part.sort()
        elif n:
            out[begin[i]] = grams(words.hash[a : a + n], n)[0] + U64(n)
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[begin[:-1][sizes > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return out[fresh], kept[begin]


def set_ids(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(tokens ^ U64(0xA0761D6478BD642F)), dtype=U64)))
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U64)).view(np.int64)


def sketches(tokens: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of sets one after the other, and how many words each has: a power of two, from a 32nd of its size."""
    words = 1 << np.ceil(np.log2(np.maximum(size / 32, 1))).astype(np.int64)
    begin = np.cumsum(words) - words
    bit = (mix(tokens ^ U64(0x8EBC6AF09C88C6E3)) & (np.repeat(words, size) * 64 - 1).astype(U64)).astype(np.int64)
    flat = np.zeros(int(words.sum()), U64)
    np.bitwise_xor.at(flat, np.repeat(begin, size) + (bit >> 6), U64(1) << (bit & 63).astype(U64))
    return flat, words


def folded(flat: np.ndarray, words: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of words (and its half) the sets of that many or twice as many with their sketches, the longer ones folded."""
    begin, out = np.cumsum(words) - words, {}
    for m in np.unique(np.concatenate((words, np.maximum(words // 2, 1)))).tolist():
        places = np.flatnonzero((words == m) | (words == 2 * m))
        matrix = flat[begin[places, None] + np.arange(m)]
        twice = words[places] == 2 * m
        matrix[twice] ^= flat[begin[places[twice], None] + m + np.arange(m)]
        out[m] = places, matrix
    return out


class Order:
    """The order of shingles: unranked by hash, then ranked from rare to frequent."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(counts, kind="stable")
        rank = np.empty(len(tokens), np.int64)
        rank[by] = np.arange(1, len(tokens) + 1)
        sort = np.argsort(tokens)
        self.tokens, self.rank = tokens[sort], rank[sort]

    def sort(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of each set in that order; they come ascending by hash."""
        if not len(self.tokens):
            return tokens
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        ranks = np.where(self.tokens[at] == tokens, self.rank[at], 0)
        doc = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
        return tokens[np.argsort(doc * (len(self.tokens) + 1) + ranks, kind="stable")]


def prefix_lengths(n: np.ndarray) -> np.ndarray:
    return n + (-4 * n // 5) + 1  # n - ceil(0.8 n) + 1


def subset_sizes(n: int) -> list[int]:
    """Overlaps at which a set of n links to another set of a permitted size."""
    partners = range(-(-4 * n // 5), 5 * n // 4 + 1)
    return sorted({o for b in partners if b > 0 and (o := needed(n, b)) <= min(n, b) and (n, o) != (b, b)})


def boundary(histogram: dict[int, int]) -> int:
    """Largest size that enumerates subsets: the cheapest, by subsets and postings of all sets up to LIGHT_MOST."""
    best, chosen, subsets = math.inf, 0, 0.0
    for light in range(LIGHT_MOST + 1):
        subsets += histogram.get(light, 0) * sum(math.comb(light, c) for c in subset_sizes(light)) if light else 0
        listed = sum(count * (n + (-4 * n // 5) + 1) for n, count in histogram.items() if -(-4 * (light + 1) // 5) <= n <= 2 * LIGHT_MOST)
        if subsets + POSTING_COST * listed < best:
            best, chosen = subsets + POSTING_COST * listed, light
    return chosen


def _scan_sets(batch: pa.RecordBatch, k: int):
    for words in scan(batch.column("text"), WHITE, lower=True):
        yield words.rows, *doc_sets(words, k)


def _id_rows(k: int):
    """Rows of documents, and of shingles that several different sets of a window hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()

        def counted() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held)) if held else np.zeros(0, U64)
            starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
            counts = np.diff(np.concatenate((starts, [len(tokens)])))
            many = counts > 1
            nothing = pa.nulls(int(many.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([nothing, nothing, pa.array(tokens[starts[many]].view(np.int64)), pa.array(counts[many].astype(np.int64))], names=["k1", "k2", "sid", "n"])

        for batch in batches:
            k1, k2 = batch.column("k1"), batch.column("k2")
            for rows, tokens, first in _scan_sets(batch, k):
                sid, n = set_ids(tokens, first), np.diff(first)
                count = rows.stop - rows.start
                yield pa.RecordBatch.from_arrays([k1.slice(rows.start, count), k2.slice(rows.start, count), pa.array(sid), pa.array(n.astype(np.int64))], names=["k1", "k2", "sid", "n"])
                new = np.array([s not in seen and not seen.add(s) for s in sid.tolist()], bool)
                held.append(tokens[np.repeat(new, n)])
                total += len(held[-1])
                if total >= COUNT_WINDOW:
                    yield counted()
                    held, total = [], 0
                    seen.clear()
        yield counted()

    return run


def _postings(k: int, light: int, order):
    """(tok, sid, at): prefix shingles of heavy sets, subsets of light ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = order.value, set()
        for batch in batches:
            for _, tokens, first in _scan_sets(batch, k):
                if len(seen) > 1_000_000:
                    seen.clear()
                sid, n = set_ids(tokens, first), np.diff(first)
                new = np.array([s not in seen and not seen.add(s) for s in sid.tolist()], bool) & (n > 0)
                listed = new & (5 * n >= 4 * (light + 1))
                some = tokens[np.repeat(listed, n)]
                begin = np.concatenate(([0], np.cumsum(n[listed])))
                some = ranks.sort(some, begin)
                length = prefix_lengths(n[listed])
                doc = np.repeat(np.arange(len(length)), length)
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
                ids = sid[listed][doc]
                yield _posting_batch(some[begin[:-1][doc] + pos].view(np.int64), ids, n[listed][doc], pos)
                tok, ids, size, sub = [], [], [], []
                for i in np.flatnonzero(new & (n <= light)):
                    m = int(n[i])
                    own = mix(tokens[first[i] : first[i + 1]] ^ U64(0xE7037ED1A0B428DB))
                    whole = own.sum(dtype=U64)
                    for c in subset_sizes(m):
                        keys = {int(whole - own[list(out)].sum(dtype=U64)) if out else int(whole) for out in combinations(range(m), m - c)}
                        tok += [(x + c * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for x in keys]
                        ids += [sid[i]] * len(keys)
                        size += [m] * len(keys)
                        sub += [-c] * len(keys)
                if tok:
                    yield _posting_batch(mix(np.array(tok, U64)).view(np.int64), ids, size, sub)

    return run


_POSTING = "tok long, sid long, at long"
#: The leader of a subset's list is its smallest set; that of a shingle's list has the least sid.
_LEADS = "if(at < 0, -at >> 20, sid)"


def _posting_batch(tok, sid, n, pos) -> pa.RecordBatch:
    """A posting's size and place in one number: n * 2**32 + pos, and -(n * 2**20 + c) for a subset of c."""
    n, pos = np.asarray(n, np.int64), np.asarray(pos, np.int64)
    at = np.where(pos >= 0, (n << 32) + pos, -((n << 20) - pos))
    return pa.RecordBatch.from_arrays([pa.array(tok), pa.array(np.asarray(sid, np.int64)), pa.array(at)], names=["tok", "sid", "at"])


def _size_and_place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(at >= 0, at >> 32, -at >> 20), np.where(at >= 0, at & 0xFFFFFFFF, -(-at & 0xFFFFF))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by (tok, lead, sid) -> those of lists with several sets, each with its leader (the first).

    state: 0 cannot link to the leader, 1 may, 2 does (by a subset). One row is carried between batches.
    """
    carry = None  # the last list's leader, whether it has been given out, and the last sid
    for batch in batches:
        if not batch.num_rows:
            continue
        tok, sid, at = (batch.column(c).to_numpy() for c in ("tok", "sid", "at"))
        n, pos = _size_and_place(at)
        given = False
        if carry is not None:
            tok, sid, n, pos = (np.concatenate(([c], x)) for c, x in zip(carry[0], (tok, sid, n, pos)))
            given = carry[1]
        start = np.concatenate(([True], tok[1:] != tok[:-1]))
        again = np.concatenate(([False], (tok[1:] == tok[:-1]) & (sid[1:] == sid[:-1])))
        if carry is not None and carry[2] is not None and len(tok) > 1 and tok[1] == carry[0][0] and sid[1] == carry[2]:
            again[1] = True
        keep = ~again
        last_sid = sid[-1]
        tok, sid, n, pos, start = tok[keep], sid[keep], n[keep], pos[keep], start[keep]
        group = np.cumsum(start) - 1
        lead = np.flatnonzero(start)
        size = np.bincount(group)
        l = lead[group]
        a, b, i, j = n[l], n, pos[l], pos
        subset = j < 0
        fits = np.where(subset, 9 * -j >= 4 * (a + b), 9 * np.minimum(a - i, b - j) >= 4 * (a + b))
        state = np.where(fits, 1 + subset, 0)
        state[lead] = 0
        out = size[group] > 1
        if given:
            out[group == 0] = True
            out[0] = False
        tail = int(group[-1])
        tail_given = bool(size[tail] > 1 or (tail == 0 and given))
        carry = ((tok[lead[tail]], sid[lead[tail]], n[lead[tail]], pos[lead[tail]]), tail_given, last_sid if tok[-1] == tok[lead[tail]] else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tok[out]), pa.array(sid[out]), pa.array(n[out].astype(np.int32)), pa.array(pos[out].astype(np.int32)), pa.array(sid[l][out]), pa.array(state[out].astype(np.int32))], names=["tok", "sid", "n", "pos", "lead", "state"]
        )


def _binary(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs of 64-bit words as binary values."""
    ends = np.concatenate(([0], np.cumsum(8 * size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype("<u8").tobytes())])


def _fetch(k: int):
    """Sets of the documents that carry a wanted set, as 8 bytes a shingle, ascending, with their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array([s not in seen and not seen.add(s) for s in batch.column("sid").to_pylist()], pa.bool_()))
            if len(seen) > 1_000_000:
                seen.clear()
            for rows, tokens, first in _scan_sets(batch, k):
                for a in range(0, len(first) - 1, 2048):
                    b = min(a + 2048, len(first) - 1)
                    some, size = tokens[first[a] : first[b]], np.diff(first[a : b + 1])
                    yield pa.RecordBatch.from_arrays([batch.column("sid").slice(rows.start + a, b - a), pa.array(size.astype(np.int32)), _binary(some, size), _binary(*sketches(some, size))], names=["sid", "n", "tokens", "marks"])

    return run


def _sets(column: pa.Array) -> list[np.ndarray]:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u8") if len(column) and ends[-1] > ends[0] else np.zeros(0, U64)
    return np.split(flat, ((ends[1:-1] - ends[0]) // 8).tolist()) if len(column) else []


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= 80 * (len(both) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array([linked(a, b) for a, b in zip(_sets(batch.column("ta")), _sets(batch.column("tb")))], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], names=["u", "v"])


def near(a: np.ndarray, b: np.ndarray, total: int) -> bool:
    """Whether two sketches leave it open that their sets, of so many shingles together, are linked."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= total


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()).tolist()
        keep = pa.array([near(a, b, n) for a, b, n in zip(_sets(batch.column("ma")), _sets(batch.column("mb")), total)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], names=["u", "v"])


def _with_both(pairs: DataFrame, sets: DataFrame, names: dict[str, str]) -> DataFrame:
    """Pairs (u, v) with columns of either set, named by their initial and a or b."""
    for side, key in (("a", "u"), ("b", "v")):
        pairs = pairs.join(sets.select(F.col("sid").alias(key), *(F.col(c).alias(initial + side) for c, initial in names.items())), key)
    return pairs.select("u", "v", *(initial + side for initial in names.values() for side in "ab"))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) whose sets are as similar as asked: tested by sketches, what is left by whole sets."""
    left = materialize(_with_both(pairs, sets, {"n": "n", "marks": "m"}).mapInArrow(tidy(_near_pairs), "u long, v long"), "near-pairs")
    return _with_both(left, sets, {"tokens": "t"}).mapInArrow(tidy(_verify), "u long, v long")


class Side:
    """Rows of a tile: ids, roots, sizes, sets (in the second pass) and sketches."""

    def __init__(self, batch: pa.RecordBatch):
        self.sid, self.root, self.n = (batch.column(c).to_numpy().astype(np.int64) for c in ("sid", "root", "n"))
        self.other = batch.column("other").to_numpy(zero_copy_only=False)
        self.data = _sets(batch.column("data"))

    def part(self, a: int, b: int) -> Side:
        out = object.__new__(Side)
        out.sid, out.root, out.n, out.other, out.data = self.sid[a:b], self.root[a:b], self.n[a:b], self.other[a:b], self.data[a:b]
        return out

    def add(self, more: Side) -> Side:
        out = object.__new__(Side)
        out.sid, out.root, out.n, out.other = (np.concatenate((getattr(self, c), getattr(more, c))) for c in ("sid", "root", "n", "other"))
        out.data = self.data + more.data
        return out

    def levels(self, whole: bool) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        if not hasattr(self, "_levels"):
            size = np.array([len(x) for x in self.data], np.int64)
            flat = np.concatenate(self.data)
            flat, words = sketches(flat, size) if whole else (flat, size)
            self._levels = words, folded(flat, words)
        return self._levels


def _pairs(heads: Side, rows: Side, whole: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(head, rows) that may be linked, by size and sketch, head by head; ``whole``: sets are given, not sketches."""

    def fits(h: int, at) -> np.ndarray:
        n, m = rows.n[at], heads.n[h]
        # A pair of two heads is looked at once.
        return (rows.root[at] != heads.root[h]) & (9 * np.minimum(n, m) >= 4 * (n + m)) & (~rows.other[at] | (rows.sid[at] > heads.sid[h]))

    if whole and len(heads.sid) * len(rows.sid) <= FEW:
        for h in range(len(heads.sid)):
            yield h, np.flatnonzero(fits(h, slice(None)))
        return
    words_h, levels_h = heads.levels(whole)
    words_r, levels_r = rows.levels(whole)
    for m in sorted(levels_h.keys() & levels_r.keys()):
        at, there = levels_r[m]
        for h, here in zip(levels_h[m][0].tolist(), levels_h[m][1]):
            near = np.flatnonzero((np.minimum(words_r[at], words_h[h]) == m) & fits(h, at))
            if len(near):
                far = np.bitwise_count(there[near] ^ here).sum(1, dtype=np.int64)
                near = near[9 * far <= rows.n[at[near]] + heads.n[h]]
                if len(near):
                    yield h, at[near]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Side, Side, dict]]:
    """(tile, heads, some of its rows, what is kept for the tile) from batches sorted by tile, each tile's heads first."""
    last, heads, kept = None, None, {}
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("lead", "block", "part", "kind")], axis=1)
        cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True]))).tolist() if len(key) else []
        side = Side(batch) if len(key) else None
        for a, b in zip(cuts, cuts[1:]):
            own, part = tuple(key[a, :3].tolist()), side.part(a, b)
            if own != last:
                last, heads, kept = own, None, {}
            if key[a, 3] == 0:
                heads = part if heads is None else heads.add(part)
            elif heads is not None:
                yield own, heads, part, kept


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: the sets of each tile that some other set may be linked to, by their sketches."""
    out, total = [], 0
    names = ["lead", "sid", "n", "root"]

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 4, names=names)

    for tile, heads, rows, _ in _tiles(batches):
        near_h, near_r = np.zeros(len(heads.sid), bool), np.zeros(len(rows.sid), bool)
        for h, at in _pairs(heads, rows, False):
            near_h[h] = True
            near_r[at] = True
        for side, near in ((heads, near_h), (rows, near_r)):
            if near.any():
                out.append((np.full(int(near.sum()), tile[0], np.int64), side.sid[near], side.n[near], side.root[near]))
                total += len(out[-1][0])
        if total > 10_000:
            yield made()
            out, total = [], 0
    yield made()


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass: links of each tile between components that none of its links has joined."""
    found: list[tuple[int, int]] = []
    for _, heads, rows, parent in _tiles(batches):

        def find(root: int, up=parent) -> int:
            while (over := up.get(root, root)) != root:
                up[root] = root = up.get(over, over)
            return root

        for h, at in _pairs(heads, rows, True):
            for r in at.tolist():
                a, b = find(int(heads.root[h])), find(int(rows.root[r]))
                if a != b and linked(heads.data[h], rows.data[r]):
                    parent[a] = b
                    found.append((int(heads.sid[h]), int(rows.sid[r])))
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])


def _deal(marked: DataFrame, data: DataFrame, bits: int) -> DataFrame:
    """Tiles of the sets (lead, sid, n, root) of leaders with several components; ``data`` (sid, data) has so many bits a shingle."""
    same = [F.bit_xor(F.xxhash64("sid", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    parts = marked.groupBy("lead", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"), *same)
    top = F.max(F.struct("c", "w", "root"))
    mixed = parts.groupBy("lead").agg(F.count("*").alias("k"), top.alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"), *(F.bit_xor(f"m{k}").alias(f"m{k}") for k in (1, 2))).where("k > 1")
    # Leaders of the same sets tell the same.
    mixed = mixed.groupBy("c", "m1", "m2").agg(F.min_by(F.struct("lead", F.col("top.root").alias("major"), (F.col("w") - F.col("top.w")).alias("heads")), "lead").alias("g"))
    mixed = mixed.select("g.lead", "g.major", F.ceil(bits * F.col("g.heads") / (8 * HEAD_BYTES)).cast("int").alias("blocks"), F.ceil(F.col("c") / ROWS).cast("int").alias("parts"))
    rows = marked.select("lead", "sid", "n", "root").join(mixed, "lead").withColumn("other", F.col("root") != F.col("major")).join(data, "sid")
    own = lambda c, seed: F.pmod(F.xxhash64("sid", F.lit(seed)), F.col(c)).cast("int").alias(c[:-1])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(c[:-1])
    lead = ["lead", "sid", "n", "root", "other", "data"]
    heads, whole = rows.where("other").select(*lead, own("blocks", 5), every("parts"), F.lit(0).alias("kind")), rows.select(*lead, every("blocks"), own("parts", 7), F.lit(1).alias("kind"))
    tiles = heads.unionByName(whole).repartition("lead", "block", "part").sortWithinPartitions("lead", "block", "part", "kind")
    return tiles.select("lead", "block", "part", "kind", "sid", "n", "root", "other", "data")


def _across(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between components, of sets (lead, sid, n) with a leader in common."""
    marked = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    close = _deal(marked, sets.select("sid", F.col("marks").alias("data")), 8).mapInArrow(tidy(_near_rows), "lead long, sid long, n long, root long")
    close = materialize(close.distinct(), "near-sets")
    return _deal(close, sets.select("sid", F.col("tokens").alias("data")), 64).mapInArrow(tidy(_tile_links), "u long, v long")


def row_keys(id_col: str, text_col: str) -> list:
    """The 96 bits, as ``k1`` and ``k2``, by which rows of an id and a text are told apart."""
    key = [F.col(id_col), F.col(text_col)]
    return [F.xxhash64(*key).alias("k1"), F.hash(*reversed(key)).cast("long").alias("k2")]


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keyed_rows: bool = False) -> DataFrame:
    """``id_col, n_shingles, component_id`` of every row of ``docs``; with ``keyed_rows`` also ``k1, k2``, see :func:`row_keys`."""
    spark = docs.sparkSession
    keyed = docs.select(*row_keys(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bodies = keyed.select("k1", "k2", "text")

    scanned = materialize(bodies.mapInArrow(tidy(_id_rows(shingle)), "k1 long, k2 long, sid long, n long"), "set-ids")
    rows = scanned.where("k1 IS NOT NULL")
    frequent = scanned.where("k1 IS NULL").groupBy("sid").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sid").limit(RANKED).toArrow()
    order = spark.sparkContext.broadcast(Order(frequent["sid"].to_numpy().view(U64), frequent["n"].to_numpy()))
    sizes = rows.where("n > 0").groupBy("sid", "n").agg(F.lit(1).alias("one")).groupBy("n").agg(F.count("*").alias("c"))
    light = boundary({r["n"]: r["c"] for r in sizes.where(F.col("n") <= 2 * LIGHT_MOST).toLocalIterator()})

    postings = bodies.mapInArrow(tidy(_postings(shingle, light, order)), _POSTING)
    lists = postings.repartition("tok").sortWithinPartitions("tok", F.expr(_LEADS), "sid").mapInArrow(tidy(_lists), "tok long, sid long, n int, pos int, lead long, state int")
    lists = materialize(lists, "lists")
    by_subset = lists.where("state = 2").select(F.col("lead").alias("u"), F.col("sid").alias("v")).distinct()
    heavy = lists.where("pos >= 0")

    wanted = heavy.select("sid").distinct()
    carriers = rows.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("k1", "k2")).alias("k")).select("sid", "k.k1", "k.k2")
    carriers = materialize(carriers, "carriers")
    n_carriers = carriers.count()
    fetched = F.broadcast(carriers) if n_carriers <= FETCH_BROADCAST else carriers
    sets = materialize(bodies.join(fetched, ["k1", "k2"]).select("sid", "text").mapInArrow(tidy(_fetch(shingle)), "sid long, n int, tokens binary, marks binary"), "sets")
    if sets.count() > n_carriers:  # rows of one id and text: each gave its set
        sets, old = materialize(sets.dropDuplicates(["sid"]), "sets"), sets
        discard(old)

    stars = heavy.where("state = 1").select(F.col("lead").alias("u"), F.col("sid").alias("v")).distinct()
    links = materialize(_links(stars, sets).unionByName(by_subset), "links")
    roots = components(links)
    more = materialize(_across(heavy.select("lead", "sid", "n").distinct(), roots, sets), "links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    discard(carriers, lists, sets, links, more)

    labelled = rows.where("n > 0").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("k1", "k2", "n", F.coalesce("root", "sid").alias("root"))
    named = keyed.select("k1", "k2", "id").join(labelled.distinct(), ["k1", "k2"], "left")
    named = materialize(named, "named")
    discard(scanned)
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    return named.join(least, "root", "left").select(
        *(["k1", "k2"] if keyed_rows else []), F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id")
    )
