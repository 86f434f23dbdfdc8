"""Url rules as one bit-parallel automaton.

Every rule is a glob over the canonical url ``.host/path``.  All globs lie side
by side in one bit mask of 64-bit words (extended Shift-And).  Each glob owns a
start bit and a bit for each character; a wildcard is a bit that may also keep
its place.  One step for a character ``c``::

    state = ((state << 1) & enter[c]) | (state & stay[c])

moves every glob at once, and a batch of urls moves together, a character each
step, until all are read.  Globs are anchored at both ends; ``*`` stands for any
characters but ``/``, ``**`` for any characters, ``?`` for one character.

A rule (action, host, path) becomes the globs that hold for the host itself and
for all subdomains.  The longest rule that fits decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansio.llm.common import by_slice, extended

#: Verdict of a url that no rule fits: the rules name what is blocked.
OTHERWISE = "allow"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """``*.host`` followed by the path's start, over ``.host/path``: the leading dot serves the host itself."""
        return f"*.{self.host}{self.path}**"


class Automaton:
    """All globs in one mask of 64-bit words."""

    def __init__(self, globs: Sequence[str]):
        starts, finals, position = [], [], 0
        enter: list[tuple[int, np.ndarray]] = []
        stay: list[tuple[int, np.ndarray]] = []
        everything = np.ones(256, bool)
        inside = everything.copy()
        inside[ord("/")] = False
        for glob in globs:
            starts.append(position)
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i:i + 2] == b"**":
                    stay.append((position, everything))
                    i += 2
                    continue
                if raw[i:i + 1] == b"*":
                    stay.append((position, inside))
                else:
                    position += 1
                    accepted = everything
                    if raw[i:i + 1] != b"?":
                        accepted = np.zeros(256, bool)
                        accepted[raw[i]] = True
                    enter.append((position, accepted))
                i += 1
            finals.append(position)
            position += 1
        self.words = max(1, -(-position // 64))
        self.enter, self.stay = self._masks(enter), self._masks(stay)
        self.start = self._bits(starts)
        self.finals = finals

    def _bits(self, positions: Sequence[int]) -> np.ndarray:
        bits = np.zeros(self.words, np.uint64)
        for p in positions:
            bits[p // 64] |= np.uint64(1 << p % 64)
        return bits

    def _masks(self, classes: list[tuple[int, np.ndarray]]) -> np.ndarray:
        masks = np.zeros((256, self.words), np.uint64)
        for p, accepted in classes:
            masks[accepted, p // 64] |= np.uint64(1 << p % 64)
        return masks

    def run(self, texts: Sequence[bytes]) -> np.ndarray:
        """For each text and glob whether it fits, all texts read side by side."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        ends = -lengths[order]
        offsets = (np.cumsum(lengths) - lengths)[order]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(lengths.max(initial=0))):
            active = int(np.searchsorted(ends, -step))  # those longer than ``step``
            c = raw[offsets[:active] + step]
            now = state[:active]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:active] = (moved & self.enter[c]) | (now & self.stay[c])
        fits = np.empty((len(texts), len(self.finals)), bool)
        for k, p in enumerate(self.finals):
            fits[order, k] = (state[:, p // 64] >> np.uint64(p % 64)) & one == one
        return fits


def lower_ascii(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty for a null or one without ``://``."""
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict`` of every row.

    ``rule`` is the longest rule that fits, null if none does; the verdict is
    the rule's action, or ``allow`` for a url that no rule fits.  Repeated rows
    are judged each; no row is dropped.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = Automaton([r.glob for r in ranked])
    names = [r.name for r in ranked] + [None]
    actions = [r.action for r in ranked] + [OTHERWISE]
    host, path = canonical(F.col(url))
    rows = pages.select(key, host.alias("host"), path.alias("path"))

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        urls = [f".{h}{p}".encode() if h or p else b""
                for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
        fits = np.column_stack([automaton.run(urls), np.ones(len(urls), bool)])
        first = fits.argmax(1)
        return pa.RecordBatch.from_arrays(
            [*part.columns, pa.array([names[i] for i in first], pa.string()),
             pa.array([actions[i] for i in first], pa.string())], [*part.schema.names, "rule", "verdict"])

    return rows.mapInArrow(by_slice(batch), extended(rows, "rule string, verdict string"))
