"""URL filters by a bit-parallel wildcard automaton.

Every rule becomes two globs over the canonical URL ``host + path`` (``host`` itself and its
subdomains). All globs are packed into multiword Shift-And masks; one pass over the characters of
a batch of URLs advances every glob of every URL by a few word operations.

Edge cases: a null url, an empty one and one without ``://`` have empty host and path and fit no
rule, so the default verdict holds. Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY, LABELS = 256, 257  # '?' in a glob; '*' within a host (any byte but '/')
REST = 258  # '*' of any bytes


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[list[int]]:
        """Symbols of ``host path*`` and ``*.host path*``; '*' and '?' in the path are wildcards."""
        path = [REST if c == 42 else ANY if c == 63 else c for c in self.path.encode()]
        own = [*self.host.lower().encode(), *path, REST]
        return [own, [LABELS, 46, *own]]


class ShiftAnd:
    """Masks of many globs, side by side in 64-bit words. Bit i: the glob's first i symbols have matched."""

    def __init__(self, globs: list[list[int]]):
        states, loops = [], []  # per state: the symbol that leads into it; its self loop
        self.first, self.last = [], []
        for glob in globs:
            self.first.append(len(states))
            states.append(None)
            loops.append(None)
            for symbol in glob:
                if symbol in (LABELS, REST):
                    loops[-1] = symbol
                else:
                    states.append(symbol)
                    loops.append(None)
            self.last.append(len(states) - 1)
        self.words = (len(states) + 63) // 64
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for at, (symbol, loop) in enumerate(zip(states, loops)):
            word, bit = at // 64, np.uint64(1 << (at % 64))
            if symbol is not None:
                self.step[slice(None) if symbol == ANY else symbol, word] |= bit
            if loop is not None:
                self.stay[:, word] |= bit
                if loop == LABELS:
                    self.stay[ord("/"), word] &= ~bit
        self.start = np.zeros(self.words, np.uint64)
        for at in self.first:
            self.start[at // 64] |= np.uint64(1 << (at % 64))

    def accepted(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix texts x globs. Texts go longest first, so finished ones drop off the end."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        offset = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)[order]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        state = np.repeat(self.start[None, :], len(texts), 0)
        left = np.sort(size)
        for t in range(int(size.max(initial=0))):
            k = len(texts) - int(np.searchsorted(left, t, side="right"))  # those longer than t
            c = buf[offset[:k] + t]
            now = state[:k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:k] = (moved & self.step[c]) | (now & self.stay[c])
        done = np.empty((len(texts), len(self.last)), bool)
        for g, at in enumerate(self.last):
            done[order, g] = (state[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1) == 1
        return done


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(has, F.translate(host, upper, upper.lower())).otherwise(""), F.when(has, path).otherwise("")


def judge(pages: DataFrame, id_col: str, url_col: str, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)``: the longest rule that fits each url, else ``default``.

    Reads two columns, shuffles nothing; a batch's memory is its URLs plus ``words`` words a URL.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    globs = [g for r in ranked for g in r.globs()]
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(globs)
        names, verdicts = [r.name for r in ranked] + [None], [r.verdict for r in ranked] + [default]
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = automaton.accepted([(h + p).encode() for h, p in zip(hosts, paths)])
            fits = hit.reshape(len(hosts), len(ranked), 2).any(2) if ranked else np.zeros((len(hosts), 0), bool)
            best = np.where(fits.any(1), fits.argmax(1), len(ranked)) if ranked else np.zeros(len(hosts), int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([names[i] for i in best], pa.string()), pa.array([verdicts[i] for i in best], pa.string())], ["id", "host", "path", "rule", "verdict"])

    kind = dict(pages.dtypes)[id_col]
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
