"""Benchmark decontamination with an FM-index per training shard.

Each shard (about ``scan.CHUNK_BYTES`` of text within a task) gets an FM-index of all
its words, with a mark after each document: its symbols are the shard's own
vocabulary, so it can be asked for any phrase. All test phrases whose words the
shard knows are searched backwards at once through wavelet-tree ranks, their
occurrences are located by sampled suffix positions, and the spans of words
below them are merged. Nothing of a shard is left out of its index.

The benchmark is the query set. It is split into blocks of at most
``BLOCK_WORDS`` words, only one of which is sent to the executors at a time; the
usual benchmark is one block, and the plan is then one scan without a shuffle.
With more, each block is a pass over the documents, and spans are merged by
document.

Cases: null texts (and items) have no words. An item with fewer words than a
window is one phrase; one without words is none. Items with a null id match but
are not listed. Repeated items count once by id. Repeated documents, empty tables
and texts of any length are handled alike; further columns are carried on
request.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.llm.fm_index import FMIndex
from textloom.llm.scan import NON_ALNUM, scan, tidy
from textloom.llm.scratch import materialize

WINDOW = 10
#: Words of benchmark items that are searched in one pass.
BLOCK_WORDS = 500_000


class Phrases:
    """Test phrases of a block of items as rows of symbols, with the items that hold each."""

    def __init__(self, ids: list, texts: list, window: int):
        words, owner, rows = [], [], []
        at = 0
        for part in scan(pa.array(texts, pa.string()), NON_ALNUM, lower=True):
            words.append(part.hash)
            for i in range(len(part.first) - 1):
                a, b = int(part.first[i]), int(part.first[i + 1])
                for begin in range(a, max(b - window, a) + 1) if b > a else ():
                    rows.append((at + begin, min(window, b - a)))
                    owner.append(part.rows.start + i)
            at += len(part.hash)
        hashes = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        matrix = np.zeros((len(rows), window), np.int64)
        for r, (begin, n) in enumerate(rows):
            matrix[r, :n] = symbols[begin : begin + n] + 1
        self.patterns, which = np.unique(matrix, axis=0, return_inverse=True) if len(rows) else (matrix, np.zeros(0, np.int64))
        self.lengths = (self.patterns > 0).sum(1)
        self.items: list[set[str]] = [set() for _ in range(len(self.patterns))]
        for r, k in enumerate(which.ravel().tolist()):
            if ids[owner[r]] is not None:
                self.items[k].add(str(ids[owner[r]]))


class Shard:
    """The FM-index of all words of some documents."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        docs = np.diff(first)
        text = np.ones(len(hashes) + len(docs), np.int64)  # 1 stands after each document; 0 ends the shard
        self.to_word = np.arange(len(text)) - np.repeat(np.arange(len(docs)), docs + 1)
        own = np.ones(len(text), bool)
        own[first[1:] + np.arange(len(docs))] = False
        text[own] = symbols.ravel() + 2
        self.index = FMIndex(text, len(self.vocabulary) + 2)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for those that the shard does not hold."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 0)

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence of rows of symbols."""
        lo, hi = self.index.search(patterns, lengths)
        count = hi - lo
        rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return self.to_word[self.index.locate(rows)], np.repeat(np.arange(len(lo)), count)


def _hits(words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence in a chunk."""
    shard = Shard(words.hash, words.first)
    own = np.concatenate(([0], shard.symbols(phrases.vocabulary)))
    known = np.flatnonzero(((own[phrases.patterns] > 0) | (phrases.patterns == 0)).all(1))
    start, which = shard.find(own[phrases.patterns[known]], phrases.lengths[known])
    return start, known[which]


def _search(phrases, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = phrases.value
        for batch in batches:
            for words in scan(batch.column("text"), NON_ALNUM, lower=True):
                start, phrase = _hits(words, block)
                n = len(words.start)
                change = np.bincount(start, minlength=n + 1) - np.bincount(start + block.lengths[phrase], minlength=n + 1)
                hit = np.cumsum(change[:n]) > 0
                doc = np.searchsorted(words.first, start, "right") - 1
                found: dict[int, set[str]] = {}
                for d, k in {*zip(doc.tolist(), phrase.tolist())}:
                    found.setdefault(d, set()).update(block.items[k])
                # Merged spans: runs of hit words of one document.
                edge = np.zeros(n + 1, bool)
                edge[words.first] = True
                begin = np.flatnonzero(hit & (edge[:n] | ~np.concatenate(([False], hit[:-1])))) if n else np.zeros(0, np.int64)
                end = (np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False])))) if n else np.zeros(0, np.int64)) + 1
                by = np.searchsorted(begin, words.first)
                docs = len(words.first) - 1
                owner = np.repeat(np.arange(docs), np.diff(by))
                own = words.first[owner]
                spans = pa.ListArray.from_arrays(pa.array(by.astype(np.int32)), pa.StructArray.from_arrays([pa.array((begin - own).astype(np.int32)), pa.array((end - own).astype(np.int32))], ["begin", "end"]))
                items = [sorted(found.get(d, ())) for d in range(docs)]
                rows = slice(words.rows.start, words.rows.stop)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(rows.start, docs) for c in range(carried)), pa.array(words.counts.astype(np.int64)), spans, pa.array(items, pa.list_(pa.string()))],
                    names=[*batch.schema.names[:carried], "_words", "_spans", "_items"],
                )

    return run


def _scan_block(docs: DataFrame, shapes: str, ids: list, texts: list, window: int) -> DataFrame:
    phrases = docs.sparkSession.sparkContext.broadcast(Phrases(ids, texts, window))
    return docs.mapInArrow(tidy(_search(phrases, len(docs.columns) - 1)), f"{shapes}, _words long, _spans array<struct<begin:int,end:int>>, _items array<string>")


def _merged(spans):
    """Sorted spans with overlapping and touching ones made one."""
    empty = F.array().cast("array<struct<begin:int,end:int>>")

    def step(done, span):
        last = F.element_at(done, -1)
        wider = F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end")))
        joins = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= span["begin"])
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), wider)).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, carry: Sequence[str] = (), block_words: int = BLOCK_WORDS) -> DataFrame:
    """``id_col, *carry, n_words, spans, items`` of every row: merged word spans to remove, and the items found."""
    keys = [F.xxhash64(id_col, text_col).alias("_k1"), F.hash(text_col, id_col).alias("_k2")]
    lead = docs.select(*keys, F.col(id_col).alias("_id"), *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)), F.col(text_col).alias("text"))
    shapes = ", ".join(f"{c} {lead.schema[c].dataType.simpleString()}" for c in lead.columns[:-1])

    passes, ids, texts, words = [], [], [], 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        size = len(row[1]) // 2 + 1 if row[1] else 0  # at most so many words
        if texts and words + size > block_words:
            passes.append(_scan_block(lead, shapes, ids, texts, window))
            ids, texts, words = [], [], 0
        ids.append(row[0])
        texts.append(row[1] or "")
        words += size
    passes.append(_scan_block(lead, shapes, ids, texts, window))

    out = passes[0]
    if len(passes) > 1:
        key = ["_k1", "_k2"]
        found = [materialize(p.where("size(_spans) > 0").select(*key, "_spans", "_items").dropDuplicates(key), "spans") for p in passes]
        union = found[0]
        for more in found[1:]:
            union = union.unionByName(more)
        union = union.groupBy(*key).agg(F.flatten(F.collect_list("_spans")).alias("s"), F.flatten(F.collect_list("_items")).alias("i"))
        out = out.drop("_spans", "_items").join(union, key, "left")
        out = out.withColumn("_spans", F.coalesce(_merged(F.col("s")), F.array().cast("array<struct<begin:int,end:int>>")))
        out = out.withColumn("_items", F.coalesce(F.array_sort(F.array_distinct("i")), F.array().cast("array<string>")))
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)), F.col("_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@F.pandas_udf(StringType())
def cut_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Text without the words of its spans and what stands between them; a space for each span."""

    def cut(t: str, found) -> str:
        words, parts, at = [m.span() for m in _WORD.finditer(t)], [], 0
        for s in found:
            parts.append(t[at : words[s["begin"]][0]].strip(" "))
            at = words[s["end"] - 1][1]
        return " ".join([*parts, t[at:].strip(" ")]).strip()

    return pd.Series([t if t is None or not len(s) else cut(t, s) for t, s in zip(text, spans)], dtype=object)
