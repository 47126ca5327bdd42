"""URL filters: a bit-parallel wildcard automaton.

All glob rules are packed into one Shift-And automaton of several 64-bit words.
Each rule owns a start bit and one bit per literal; ``*`` is a self-loop for any
byte but ``/``, ``**`` a self-loop for any byte. A step for one character is

    D = ((D << 1) & TAKE[c]) | (D & STAY[c])

and is done for a whole batch of URLs at once, so every rule advances over every
URL in the same few vector operations. The plan is a scan and one Arrow map:
no shuffle, and memory of one batch.

Cases: a null url or one without ``://`` has an empty host and path, no rule and
the verdict of the globs for the empty URL (allow unless a glob takes it).
Repeated rows give repeated results; an empty table gives an empty result; very
long URLs are stepped alone after shorter ones have ended; further columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.scan import U64, text_buffer

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its own.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Globs over ``.host/path`` that block a URL which no rule fits.
GLOBS = ("*.ads.*/**", "*.adserver.*/**", "*.tracker.*/**", "*/ads/**", "*/cgi-bin/**", "*/wp-login.php**", "**.exe", "**.zip")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """Globs packed into Shift-And masks of as many 64-bit words as they need."""

    def __init__(self, globs: Sequence[str]):
        states: list[tuple[int | None, str]] = []  # (byte that enters the state, its self-loop)
        self.final = []
        begins = []
        for glob in globs:
            begins.append(len(states))
            states.append((None, ""))
            text = glob.encode()
            i = 0
            while i < len(text):
                if text[i : i + 1] == b"*":
                    wide = text[i : i + 2] == b"**"
                    states[-1] = (states[-1][0], "**" if wide or states[-1][1] == "**" else "*")
                    i += 1 + wide
                else:
                    states.append((text[i], ""))
                    i += 1
            self.final.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.take = np.zeros((256, self.words), U64)
        self.stay = np.zeros((256, self.words), U64)
        self.begin = np.zeros(self.words, U64)
        for k, (byte, loop) in enumerate(states):
            word, bit = k // 64, U64(1 << (k % 64))
            if byte is not None:
                self.take[byte, word] |= bit
            if loop:
                self.stay[:, word] |= bit
            if loop == "*":
                self.stay[ord("/"), word] &= ~bit
        for k in begins:
            self.begin[k // 64] |= U64(1 << (k % 64))

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which globs match which texts: booleans of shape (texts, globs)."""
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")  # at step j the first rows are those still running
        starts, alive = offsets[:-1][order], lengths[order]
        d = np.tile(self.begin, (n, 1))
        ended = np.searchsorted(-alive, -np.arange(int(alive[0]) if n else 0), "left")
        for j, m in enumerate(ended):
            c = data[starts[:m] + j]
            now = d[:m]
            moved = now << U64(1)
            moved[:, 1:] |= now[:, :-1] >> U64(63)
            d[:m] = (moved & self.take[c]) | (now & self.stay[c])
        out = np.empty((n, len(self.final)), bool)
        for g, k in enumerate(self.final):
            out[order, g] = (d[:, k // 64] >> U64(k % 64)) & U64(1) == 1
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for no ``://``."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[str] = GLOBS) -> DataFrame:
    """``id_col, host, path, rule, verdict`` of every row of ``pages``.

    Of the rules that fit, the longest (host and path together, then host) decides;
    without one, the URL is blocked if a glob matches ``.host/path``.
    """
    ranked = sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1])))
    names = np.array([None, *(host + path for _, host, path in ranked)], object)
    verdicts = np.array(["", *(verdict for verdict, _, _ in ranked)], object)
    everything = [f"*.{host}{path}**" for _, host, path in ranked] + list(globs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(everything)
        for batch in batches:
            hits = automaton.run(*text_buffer(batch.column("canonical")))
            fits = hits[:, : len(ranked)]
            best = np.where(fits.any(1), len(ranked) - np.argmax(fits[:, ::-1], 1), 0) if ranked else np.zeros(len(hits), int)
            method = np.where(hits[:, len(ranked) :].any(1), "block", "allow").astype(object)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(names[best], pa.string()), pa.array(np.where(best > 0, verdicts[best], method), pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    host, path = host_and_path(F.col(url_col))
    narrow = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    narrow = narrow.withColumn("canonical", F.concat(F.lit("."), F.col("host"), F.col("path")))
    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
