"""Quality by compression: one zstandard dictionary of good and one of bad text.

A text is compressed block by block with either dictionary. The difference of
the two sizes over their sum is positive where the good dictionary helps more; a
logistic curve fitted on labelled texts turns it into a probability.

Fitting is bounded by ``FIT_ROWS`` texts a label (those with the least hash of the
id; one half trains the dictionaries, the other, which they have not seen, the
curve). Scoring is a scan and one Arrow map; the dictionaries (``DICTIONARY`` bytes
each) and two numbers are all that is sent. Texts are compressed whole, in
blocks of ``BLOCK`` bytes, so length neither dilutes the dictionaries nor needs
memory.

Cases: null and empty texts have a difference of 0 and so the curve's middle.
Without labels of both kinds every score is the share of good labels (0.5
without any). Several labels of one row all count. Repeated rows, empty tables
and further columns are handled alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 2_000
DICTIONARY = 1 << 16
BLOCK = 4096
LEVEL = 3


class Model:
    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, shift: float = 0.0):
        self.good, self.bad, self.slope, self.shift = good, bad, slope, shift

    def compressors(self):
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), write_checksum=False, write_content_size=False, write_dict_id=False)
        return (make(self.good), make(self.bad)) if self.good and self.bad else None

    def difference(self, texts: Sequence[bytes], pair=None) -> np.ndarray:
        """(bad size - good size) / (bad size + good size) of each text."""
        pair = pair or self.compressors()
        out = np.zeros(len(texts))
        if pair is None:
            return out
        for i, t in enumerate(texts):
            good = bad = 0
            for at in range(0, len(t), BLOCK):
                block = t[at : at + BLOCK]
                good += len(pair[0].compress(block))
                bad += len(pair[1].compress(block))
            if good:
                out[i] = (bad - good) / (bad + good)
        return out

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.shift, -40, 40)))


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[a : a + BLOCK] for t in texts for a in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its own end is the dictionary
        return b"".join(blocks)[-DICTIONARY:]


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Logistic regression on one variable by Newton steps, with a slight pull to 0."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        gradient = a.T @ (y - p) - 1e-2 * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit_texts(texts: Sequence[tuple[int, str]]) -> Model:
    """A model from (label, text) pairs."""
    raw = [(y, (t or "").encode("utf-8", "surrogatepass")) for y, t in texts]
    share = (sum(y for y, _ in raw) + 1) / (len(raw) + 2)
    halves = [[t for k, (y, t) in enumerate(raw) if y == label and t] for label in (1, 0)]
    if min(map(len, halves)) < 2:
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    model = Model(*(_dictionary(h[::2]) for h in halves))
    held = [(y, t) for y, h in zip((1, 0), halves) for t in h[1::2]]
    y = np.array([y for y, _ in held], float)
    model.slope, shift = _curve(model.difference([t for _, t in held]), y)
    # The fitted rows hold as many of either label as the bound allows; the shift restores the true share.
    model.shift = shift
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Model:
    """A model from at most about ``rows`` rows a label of ``labels``, with the labels' true shares.

    The sampled labels (bounded by ``rows``) are broadcast to the texts, so no text is shuffled.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).alias("_y"))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit_texts([])
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / n))))
    chosen = F.broadcast(known.where(place <= share[F.col("_y")]))
    sample = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).join(chosen, id_col).select(F.xxhash64(id_col).alias("h"), F.col("_y").alias("y"), F.col(text_col).alias("t")).toArrow()
    model = fit_texts([(y, t) for _, y, t in sorted(zip(*(sample[c].to_pylist() for c in ("h", "y", "t"))))])
    taken = [max(1, sum(v == y for v in sample["y"].to_pylist())) for y in (1, 0)]
    if model.good and len(sizes) == 2:
        model.shift += float(np.log(sizes[1] / sizes[0] * taken[1] / taken[0]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``id_col, *carry, score`` of every row: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        pair = own.compressors()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                scores = own.score(own.difference([t or b"" for t in part.column("text").to_pylist()], pair))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "_score"])

    shapes = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in narrow.columns[:-1])
    out = narrow.mapInArrow(run, f"{shapes}, _score double")
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)), F.col("_score").alias("score"))
