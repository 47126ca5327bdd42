"""Language identification by segmentation-marginalised unigrams.

Over a fixed public vocabulary of byte pieces each language has piece
probabilities. A word's likelihood is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words. Piece
probabilities are learnt by expectation maximisation over the same lattices.

Fitting is bounded: at most about ``FIT_ROWS`` texts a language, those with the
least hash of the id, picked by one narrow count and one filtered scan. The model
has one number for a piece and language, so its broadcast is bounded by the
vocabulary. Prediction is a scan and one Arrow map; each worker scores a word
once (all new words of a chunk in one vectorised pass over positions) and keeps
at most ``WORDS_KEPT`` words.

Words are runs of letters, lower-cased, with a leading space. Words of over
``LONGEST`` bytes, and words too rare for floating point, take the same pass in
logarithms, as a whole; ``CELLS`` bounds how many at once.

The score tells the learnt languages apart, and says nothing of others. ``typical`` does: a text is not
typical if the logarithm of its likelihood, by byte of its words, is more than ``WORSE`` times (as far below 0
as) the mean of the predicted language's own fit texts; texts that mix languages or hold some junk reach 1.8.
Texts of fewer than ``JUDGED`` bytes of words are always typical.

Cases: a text that is null or has no letter gets ``und`` and score 0. With nothing
to learn from, every text does. Ties go to the first language by name. Repeated
rows, long texts, empty tables and further columns are handled alike.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.scan import chunks, text_buffer, tidy
from textloom.llm.scratch import shrink_driver

FIT_ROWS = 800
ROUNDS = 4
LONGEST = 48
WORDS_KEPT = 200_000
CELLS = 1 << 21
#: How much worse than the fit texts' mean a typical text may be, and bytes of words from which a text is judged.
WORSE, JUDGED = 1.95, 200
#: Texts at least this likely to be in the predicted language are kept by :func:`keep`.
KEEP = 0.5

#: Numbers that are no digits (fractions, superscripts, Roman numerals, ...), which the class below would take for letters.
_NUMBERS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_NUMBER = re.compile(f"[{_NUMBERS}]")
#: A quick test that most texts of Latin script pass: one of those numbers below U+0900, or anything from there on.
_ODD = re.compile("[" + "".join(c for c in _NUMBERS if c < "\u0900") + "\u0900-\U0001ffff]")
_LETTERS = re.compile(r"[^\W\d_]+")


def read_pieces(path: str) -> list[bytes]:
    """Byte pieces of a rank file (base64 piece, rank), in rank order."""
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


def index_of(pieces: Sequence[bytes]) -> dict[bytes, int]:
    """Places of pieces, and -1 for beginnings of pieces that are none themselves."""
    out = {p[:k]: -1 for p in pieces for k in range(1, len(p))}
    out.update((p, i) for i, p in enumerate(pieces))
    return out


class Lattice:
    """All segmentations of a list of words, as arcs in order of their ends; ``pieces`` is made by :func:`index_of`."""

    def __init__(self, words: Sequence[bytes], pieces: dict[bytes, int], longest: int):
        word, begin, end, piece = (array("i") for _ in range(4))  # lists would hold an object for each number
        get = pieces.get
        for w, text in enumerate(words):
            n = len(text)
            for i in range(n):
                for j in range(i + 1, min(n, i + longest) + 1):
                    k = get(text[i:j])
                    if k is None:
                        break  # no piece begins so
                    if k >= 0:
                        word.append(w)
                        begin.append(i)
                        end.append(j)
                        piece.append(k)
        order = np.argsort(np.frombuffer(end, np.int32), kind="stable").astype(np.int32)
        self.word, self.piece = (np.frombuffer(x, np.int32)[order] for x in (word, piece))
        places = np.int16 if max(map(len, words), default=0) < 1 << 15 else np.int32
        self.begin, self.end = (np.frombuffer(x, np.int32)[order].astype(places) for x in (begin, end))
        self.lengths = np.array([len(t) for t in words], np.int64)
        self.steps = np.searchsorted(self.end, np.arange(1, int(self.lengths.max(initial=0)) + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[position, word, language] for piece probabilities p[piece, language]."""
        n, top = len(self.lengths), int(self.lengths.max(initial=0))
        alpha = np.zeros((top + 1, n, p.shape[1]))
        alpha[0] = 1
        for j in range(1, top + 1):
            a, b = self.steps[j - 1], self.steps[j]
            arcs = alpha[self.begin[a:b], self.word[a:b]] * p[self.piece[a:b]]
            for c in range(p.shape[1]):
                alpha[j, :, c] = np.bincount(self.word[a:b], arcs[:, c], minlength=n)
        return alpha

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        return self.forward(p)[self.lengths, np.arange(len(self.lengths))]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece; counts[word, language]."""
        alpha = self.forward(p)
        n, top = len(self.lengths), len(alpha) - 1
        beta = np.zeros_like(alpha)
        beta[self.lengths, np.arange(n)] = 1
        uses = np.zeros_like(p)
        total = np.maximum(alpha[self.lengths, np.arange(n)], 1e-300)
        for j in range(top, 0, -1):
            a, b = self.steps[j - 1], self.steps[j]
            w, i = self.word[a:b], self.begin[a:b]
            arcs = beta[j, w] * p[self.piece[a:b]]
            np.add.at(beta, (i, w), arcs)
            share = alpha[i, w] * arcs / total[w] * counts[w]
            for c in range(p.shape[1]):
                uses[:, c] += np.bincount(self.piece[a:b], share[:, c], minlength=len(p))
        return uses

    def log_forward(self, logp: np.ndarray) -> np.ndarray:
        """Logarithms of alpha[position, word, language]."""
        n, top = len(self.lengths), int(self.lengths.max(initial=0))
        alpha = np.full((top + 1, n, logp.shape[1]), -np.inf)
        alpha[0] = 0
        for j in range(1, top + 1):
            a, b = self.steps[j - 1], self.steps[j]
            if a < b:
                w = self.word[a:b]
                words, sums = _log_sums(w, alpha[self.begin[a:b], w] + logp[self.piece[a:b]])
                alpha[j, words] = sums
        return alpha

    def log_likelihood(self, logp: np.ndarray) -> np.ndarray:
        return self.log_forward(logp)[self.lengths, np.arange(len(self.lengths))]

    def log_expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by logarithms; counts[word, language]."""
        alpha = self.log_forward(logp)
        n, top = len(self.lengths), len(alpha) - 1
        beta = np.full_like(alpha, -np.inf)
        beta[self.lengths, np.arange(n)] = 0
        order = np.lexsort((self.word, self.begin))
        steps = np.searchsorted(self.begin[order], np.arange(top + 1))
        for i in range(top - 1, -1, -1):
            arcs = order[steps[i] : steps[i + 1]]
            if len(arcs):
                w = self.word[arcs]
                words, sums = _log_sums(w, beta[self.end[arcs], w] + logp[self.piece[arcs]])
                beta[i, words] = sums
        total = alpha[self.lengths, np.arange(n)]
        share = np.exp(alpha[self.begin, self.word] + logp[self.piece] + beta[self.end, self.word] - total[self.word]) * counts[self.word]
        return np.stack([np.bincount(self.piece, share[:, c], minlength=len(logp)) for c in range(logp.shape[1])], axis=1)


def _log_sums(word: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (in ascending order, repeated) and the logarithm of the sum of each one's rows."""
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    most = np.maximum.reduceat(logs, first)
    most[np.isneginf(most)] = -1e300
    sums = np.add.reduceat(np.exp(logs - np.repeat(most, np.diff(np.append(first, len(word))), axis=0)), first)
    return word[first], most + np.log(np.maximum(sums, 1e-300))


def _groups(words: Sequence[bytes], languages: int) -> Iterator[list[int]]:
    """Places of words, those of like lengths together, in groups of about ``CELLS`` positions and languages."""
    group: list[int] = []
    for k in sorted(range(len(words)), key=lambda k: len(words[k])):
        if group and (len(group) + 1) * (len(words[k]) + 1) * languages > CELLS:
            yield group
            group = []
        group.append(k)
    if group:
        yield group


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode's categories L), lower-cased."""
    text = text.lower()
    words = _LETTERS.findall(text)
    if not text.isascii() and _ODD.search(text) and not all(map(str.isalpha, words)):
        words = _LETTERS.findall(_NUMBER.sub(" ", text))
    return words


def _bytes(word: str) -> bytes:
    return (" " + word).encode("utf-8", "surrogatepass")


class Model:
    def __init__(self, languages: list[str], pieces: list[bytes], p: np.ndarray):
        self.languages, self.p = languages, p
        self.pieces = index_of(pieces)
        self.longest = max(map(len, pieces), default=0)
        self.forget()
        self.floor = np.full(len(languages), -np.inf)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.log, self.bytes = np.zeros((1024, len(self.languages))), np.zeros(1024)  # of a known word, by language and altogether

    def log_likelihood(self, words: Sequence[bytes]) -> np.ndarray:
        out = np.full((len(words), len(self.languages)), -np.inf)
        short = [k for k, w in enumerate(words) if len(w) <= LONGEST]
        if short:
            like = Lattice([words[k] for k in short], self.pieces, self.longest).likelihood(self.p)
            out[short] = np.log(np.maximum(like, 1e-300))
            out[np.array(short)[(like < 1e-290).any(1)]] = -np.inf
        left = np.flatnonzero(np.isneginf(out).any(1)).tolist()
        if left:
            logp = np.log(self.p)
            for group in _groups([words[k] for k in left], len(self.languages)):
                at = [left[g] for g in group]
                out[at] = Lattice([words[k] for k in at], self.pieces, self.longest).log_likelihood(logp)
        return out

    def learn(self, words: Sequence[str]) -> None:
        if len(self.known) + len(words) > WORDS_KEPT:
            self.known.clear()
        for at in range(0, len(words), 5000):
            some = words[at : at + 5000]
            like = self.log_likelihood([_bytes(w) for w in some])
            base = len(self.known)
            while base + len(some) > len(self.log):
                self.log, self.bytes = (np.concatenate((x, np.zeros_like(x))) for x in (self.log, self.bytes))
            self.log[base : base + len(some)] = like
            self.bytes[base : base + len(some)] = [len(_bytes(w)) for w in some]
            self.known.update(zip(some, range(base, base + len(some))))

    def sums(self, texts: Sequence[str]) -> list[np.ndarray | None]:
        """Logarithms of each text's likelihood by language, and its bytes; None for texts without words."""
        found = [words_of(t) if t else [] for t in texts]
        new = list({w for ws in found for w in ws if w not in self.known})
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = list({w for ws in found for w in ws})
        if new:
            self.learn(new)
        get = self.known.__getitem__
        places = [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in found]
        return [np.append(self.log[at].sum(0), self.bytes[at].sum()) if len(at) else None for at in places]

    def judge(self, texts: Sequence[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether the text is typical of that language."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        names, scores, typical = [], [], []
        for row in self.sums(texts):
            if row is None:
                names.append("und")
                scores.append(0.0)
                typical.append(False)
                continue
            total, size = row[:-1], row[-1]
            best = int(total.argmax())
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
            typical.append(bool(size < JUDGED or total[best] >= self.floor[best] * size))
        return names, scores, typical

    def score(self, texts: Sequence[str]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def set_floors(self, texts: Sequence[tuple[str, str]]) -> None:
        """The least logarithm a byte that is typical of each language, from the texts it was fitted on."""
        for k, language in enumerate(self.languages):
            rows = [r for r in self.sums([t for name, t in texts if name == language]) if r is not None and r[-1] >= JUDGED]
            if rows:
                self.floor[k] = WORSE * np.mean([r[k] / r[-1] for r in rows])
            self.forget()


def fit_texts(texts: Sequence[tuple[str, str]], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """A model from (language, text) pairs."""
    counts: dict[str, Counter] = {}
    for language, text in texts:
        counts.setdefault(language, Counter()).update(words_of(text or ""))
    languages = sorted(k for k, c in counts.items() if c)
    single = {bytes([b]) for b in range(256)}
    usable = [*pieces, *sorted(single - set(pieces))]
    model = Model(languages, usable, np.zeros((len(usable), len(languages))))
    if not languages:
        return model
    vocabulary = sorted(set().union(*(counts[k] for k in languages)))
    words = [_bytes(w) for w in vocabulary]
    weight = np.zeros((len(words), len(languages)))
    for c, k in enumerate(languages):
        weight[:, c] = np.fromiter(map(counts[k].__getitem__, vocabulary), float, len(words))
    short = [k for k, w in enumerate(words) if len(w) <= LONGEST]
    long = [k for k, w in enumerate(words) if len(w) > LONGEST]
    lattice = lambda at: (Lattice([words[k] for k in at], model.pieces, model.longest), weight[at])
    blocks = [lattice(short[a : a + 20_000]) for a in range(0, len(short), 20_000)]
    long_blocks = [lattice([long[g] for g in group]) for group in _groups([words[k] for k in long], len(languages))]
    p = np.full_like(model.p, 1 / len(usable))
    lengths = np.array([len(b) for b in usable], float)[:, None]
    for r in range(rounds):
        uses = sum(x.expected(p, w) for x, w in blocks) + sum(x.log_expected(np.log(p), w) for x, w in long_blocks)
        uses += 0.05 / lengths**2  # unseen pieces keep a little, short ones more
        p = uses / uses.sum(0)
    model.p = p
    del blocks, long_blocks, words, weight, vocabulary, counts  # the driver need not hold them beside what follows
    model.set_floors(texts)
    return model


def fit(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Model:
    """A model from at most about ``rows`` rows a language of ``docs`` with a language, a text and an id."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = {r["l"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit_texts([], read_pieces(path))
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / n))))
    sample = known.where(place <= share[F.col(lang_col)]).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).toArrow()
    texts = sorted(zip(sample["l"].to_pylist(), sample["t"].to_pylist()))
    del sample
    shrink_driver(docs.sparkSession)  # what collecting took is not held beside what fitting takes
    model = fit_texts(texts, read_pieces(path))
    del texts
    shrink_driver(docs.sparkSession)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``id_col, *carry, lang_pred, score, typical`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column("text")
            for rows in chunks(text_buffer(column)[1]):
                names, scores, typical = own.judge(column.slice(rows.start, rows.stop - rows.start).to_pylist())
                lead = [batch.column(c).slice(rows.start, rows.stop - rows.start) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*lead, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(typical, pa.bool_())], names=[*batch.schema.names[:-1], "_lang", "_score", "_typical"])
        own.known.clear()

    shapes = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in narrow.columns[:-1])
    out = narrow.mapInArrow(tidy(run), f"{shapes}, _lang string, _score double, _typical boolean")
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_typical").alias("typical"))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds
