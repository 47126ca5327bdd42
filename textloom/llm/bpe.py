"""BPE encoding and decoding: speculate and verify.

For each new word a greedy longest match proposes tokens. A proposal is the true
merge result exactly if every token and every pair of neighbours would come out
of merging unchanged, so all pairs of all proposals are tested together: their
codes are looked up in one vectorised search of the pairs judged so far, and only
unseen pairs are judged (by merging the two tokens' symbols). Words with a failing
pair, and only those, go through exact merging.

Tokens of words are kept by word, so a corpus costs a split and two look-ups a
word. The memories are bounded: they are emptied when they exceed ``WORDS_KEPT``
(or what a single chunk of text needs) and ``PAIRS_KEPT``. The plan is a scan and one
Arrow map, without a shuffle.

The vocabulary is read from a tokenizer file of the public kind "BPE with word
ends": normalisation is NFC, white space to a space, and lower case; words follow
the file's pattern and are mapped to byte characters; special tokens in a text
are recognised as such.

Cases: null and empty texts, and texts of white space only, have no tokens and
decode to the empty text. Very long words are merged with a heap, in n log n.
Repeated rows, empty tables and further columns are handled alike.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scan import chunks, text_buffer, tidy

WORDS_KEPT, PAIRS_KEPT = 250_000, 2_000_000
#: Bytes of text whose words are encoded together.
ENCODE_CHUNK = 1 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


_LETTER = regex.compile(r"[\p{L}\p{N}]")
NEVER = 1 << 40


def _ranges(chars: list[str]) -> str:
    """Characters as the inside of a class."""
    out: list[list[str]] = []
    for c in chars:
        if out and ord(c) == ord(out[-1][1]) + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{a}-{b}" for a, b in out)


# Combining marks that came after Unicode 9, whose tables the library normalises with, and the one later
# second half of a composition. They stand as they are, and nothing is reordered or composed across them.
LATE_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 "
    "11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
# Letters and digits of Unicode 16, which the library's pattern knows and Python's tables do not.
LATE_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D40-10D49 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 116D0-116E3 11BC0-11BE0 11BF0-11BF9 13460-143FA 16100-1611D 16130-16139 16D40-16D6C 16D70-16D79 18CFF "
    "1CCF0-1CCF9 1E5D0-1E5ED 1E5F0 1E5F1-1E5FA"
)
# First and last capital and first small letter of the alphabets that are paired since Unicode 16 and 17.
LATE_CASES = "1C89-1C89-1C8A A7CB-A7CB-264 A7CC-A7CC-A7CD A7CE-A7CE-A7CF A7D2-A7D2-A7D3 A7D4-A7D4-A7D5 A7DA-A7DA-A7DB A7DC-A7DC-19B 10D50-10D65-10D70 16EA0-16EB8-16EBB"


def _inside(ranges: str) -> str:
    return "".join("-".join(chr(int(c, 16)) for c in part.split("-")) for part in ranges.split())


_LATE = re.compile(f"([{_inside(LATE_MARKS)}])")
_LATE_LETTER = re.compile(f"[{_inside(LATE_LETTERS)}]")
_LOWER = {a + k: b + k for part in LATE_CASES.split() for a, z, b in [[int(c, 16) for c in part.split("-")]] for k in range(z - a + 1)}
_LATE_CAPITAL = re.compile("[" + "".join(map(chr, _LOWER)) + "]")


def nfc(text: str) -> str:
    """NFC by the library's tables."""
    if not _LATE.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(part if k % 2 else unicodedata.normalize("NFC", part) for k, part in enumerate(_LATE.split(text)))


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks: dict[int, int] = {}  # of a pair, left << 20 | right
        self.made: list[int] = []  # by rank, the token of the merged pair
        for rank, (a, b) in enumerate(merges):
            self.ranks.setdefault(self.vocab[a] << 20 | self.vocab[b], rank)
            self.made.append(self.vocab[a + b])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        # Letters and digits of later Unicode versions than the library's, which takes them for symbols.
        later = _ranges([c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and _LETTER.match(c) and not _LATE_LETTER.match(c)])
        self.later = re.compile(f"[{later}]") if later else None
        self.split_later = regex.compile("(?V1)" + regex.sub(r"\\p\{[LN]\}", lambda m: f"[{m[0]}--[{later}]]", pattern))
        # The same pattern for texts of Latin-1 characters, whose classes the faster standard engine can state.
        for name, kind in (("L", "L"), ("N", "N")):
            own = _ranges([c for c in map(chr, range(0x100)) if unicodedata.category(c).startswith(kind)])
            pattern = pattern.replace(f"[\\p{{{name}}}]", f"[{own}]").replace(f"\\p{{{name}}}", own)
        self.split_latin = re.compile(pattern.replace(r"\s", "\t-\r \x85\xa0"))
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.to_chars = {b: c for b, c in enumerate(byte_characters())}
        self.longest = max(map(len, self.vocab))
        # Symbols of a token: byte characters, the last with the word end if the token has it.
        self.words: dict[str, tuple[int, ...]] = {}
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.single: dict[int, bool] = {}

    def symbols(self, word: str) -> list[int]:
        """Starting symbols of a word of byte characters; characters without an id are dropped, as in merging."""
        get = self.vocab.get
        out = [get(c) for c in word[:-1]] + [get(word[-1] + self.suffix)]
        return [s for s in out if s is not None]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: always the pair of lowest rank, leftmost first."""
        if len(ids) > 64:
            return self._merge_long(ids)
        ids, rank, made = list(ids), self.ranks.get, self.made
        ranks = [rank(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            ids[i] = new = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | new, NEVER)
            if i < len(ranks):
                ranks[i] = rank(new << 20 | ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        ids, nxt, prv = list(ids), list(range(1, n)) + [-1], list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j < 0 or rank(ids[i] << 20 | ids[j]) != least:
                continue
            ids[i], ids[j] = self.made[least], -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                if (r := rank(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := prv[i]) >= 0 and (r := rank(ids[k] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, k))
        return [t for t in ids if t >= 0]

    def parts(self, token: int) -> list[int]:
        name = self.names[token]
        if self.suffix and name.endswith(self.suffix) and name != self.suffix:
            return self.symbols(name[: -len(self.suffix)])
        return [self.vocab[c] for c in name]

    def stands(self, token: int) -> bool:
        """Whether a token's own symbols merge to it."""
        if token not in self.single:
            self.single[token] = self.merge(self.parts(token)) == [token]
        return self.single[token]

    def propose(self, word: str) -> list[int] | None:
        """Longest match from the left; None where the vocabulary has no match."""
        vocab, out, at, n = self.vocab, [], 0, len(word)
        ended = word + self.suffix
        while at < n:
            token = vocab.get(ended[at:]) if n - at <= self.longest else None
            if token is not None:
                out.append(token)
                return out
            for to in range(min(n - 1, at + self.longest), at, -1):
                token = vocab.get(word[at:to])
                if token is not None:
                    break
            else:
                return None
            out.append(token)
            at = to
        return out

    def learn(self, words: Sequence[str]) -> None:
        """Encode words (as found in normalised text) that are not known yet; :func:`encode` makes room for them."""
        chars = ["".join(map(self.to_chars.__getitem__, w.encode("utf-8", "surrogatepass"))) if not (w.isascii() and w.isprintable()) else w for w in words]
        proposals = [self.propose(c) for c in chars]
        sizes = np.fromiter((len(p) if p else 0 for p in proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(p for p in proposals if p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = sizes == 0
        tokens, where = np.unique(flat, return_inverse=True)
        stands = np.fromiter((self.stands(t) for t in tokens.tolist()), bool, len(tokens))
        bad[owner[~stands[where]]] = True
        inner = owner[1:] == owner[:-1]
        keys = (flat[:-1] << 20 | flat[1:])[inner]
        bad[owner[1:][inner][~self.fits(keys)]] = True
        for w, c, p, wrong in zip(words, chars, proposals, bad.tolist()):
            self.words[w] = tuple(self.merge(self.symbols(c)) if wrong else p)

    def fits(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs of tokens (left << 20 | right) stay as they are when merged together."""
        asked, where = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pair_keys, asked)
        known = at < len(self.pair_keys)
        known[known] = self.pair_keys[at[known]] == asked[known]
        answer = np.zeros(len(asked), bool)
        answer[known] = self.pair_fits[at[known]]
        fresh = asked[~known]
        if len(fresh):
            judged = np.fromiter((self.merge(self.parts(k >> 20) + self.parts(k & 0xFFFFF)) == [k >> 20, k & 0xFFFFF] for k in fresh.tolist()), bool, len(fresh))
            answer[~known] = judged
            if len(self.pair_keys) + len(fresh) > PAIRS_KEPT:
                self.pair_keys, self.pair_fits = fresh, judged
            else:
                to = np.searchsorted(self.pair_keys, fresh)
                self.pair_keys, self.pair_fits = np.insert(self.pair_keys, to, fresh), np.insert(self.pair_fits, to, judged)
        return answer[where]

    def found(self, text: str) -> list[str]:
        """Words of a text; special tokens stand as they are."""
        if self.specials is None or not self.specials.search(text):
            return self._found(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self._found(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._found(text[at:])

    def _found(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.split_latin.findall(text.lower())
        except UnicodeEncodeError:
            text = nfc(text).replace("Σ", "σ")  # lower case letter by letter: no final sigma
            if _LATE_CAPITAL.search(text):
                text = text.translate(_LOWER)
            if self.later is not None and self.later.search(text):
                return self.split_later.findall(text.lower())
        return self.split.findall(text.lower())

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.found(t) for t in texts]
        for token, i in self.special.items():
            self.words[token] = (i,)
        new = list({w for words in split for w in words if w not in self.words})
        if new:
            if len(self.words) + len(new) > WORDS_KEPT:
                self.words.clear()
                self.words.update((t, (i,)) for t, i in self.special.items())
                new = list({w for words in split for w in words if w not in self.words})
            self.learn(new)
        get = self.words.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]

    def decode(self, ids: Sequence[int]) -> str:
        """Tokens joined by a space, as the library does for a file without a decoder; unknown ids are left out."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``id_col, *carry, ids array<int>, decoded string`` of every row. ``path`` is the tokenizer file, there on every executor."""
    lead = [F.col(id_col).alias("_id"), *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            column = batch.column("text")
            _, offsets = text_buffer(column)
            for rows in chunks(offsets, ENCODE_CHUNK):
                count = rows.stop - rows.start
                ids = bpe.encode([t or "" for t in column.slice(rows.start, count).to_pylist()])
                decoded = pa.array([bpe.decode(x) for x in ids], pa.string())
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                values = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(rows.start, count) for c in range(1 + len(carry))), lists, decoded], names=[*batch.schema.names[:-1], "_ids", "_decoded"])
        bpe.words.clear()

    narrow = docs.select(*lead, F.col(text_col).alias("text"))
    shapes = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in narrow.columns[:-1])
    out = narrow.mapInArrow(tidy(run), f"{shapes}, _ids array<int>, _decoded string")
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)), F.col("_ids").alias("ids"), F.col("_decoded").alias("decoded"))
