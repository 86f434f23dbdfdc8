"""Token counts of sections, from one encoding of the whole document.

A document is encoded once.  The character span of every token is joined with
the character spans of the sections by two binary searches (first and last
character), and a token that touches several sections is allocated by a rule:

* ``first``: the section of its first character;
* ``last``: the section of its last character;
* ``most``: the section that holds most of its characters, the first of equals.

Every token belongs to one section, so the counts of a document add up to its
number of tokens.  A character that is split over several tokens is part of each
of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.llm.bpe import Encoder, encoder
from scansio.llm.common import by_slice

RULES = ("first", "last", "most")
SECTIONS = "doc_id bigint, section int, start bigint, length bigint, n_tokens bigint, n_crossing bigint"


def token_spans(text: str, encode: Encoder, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and character after the last of each token."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(widths[np.frombuffer(encode.encode(text), "<u4")])
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def line_starts(text: str) -> np.ndarray:
    """Sections are lines: each begins behind a line feed, which belongs to the line before."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.concatenate(([0], np.flatnonzero(points == 10) + 1))


def allocate(low: np.ndarray, high: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each section its tokens, and those that touch it but are another's."""
    first = np.searchsorted(starts, low, "right") - 1
    last = np.searchsorted(starts, high - 1, "right") - 1
    owner = {"first": first, "last": last, "most": first.copy()}[rule]
    crossing = np.flatnonzero(first != last)
    touched = np.zeros(len(starts), np.int64)
    for t in crossing:
        sections = np.arange(first[t], last[t] + 1)
        if rule == "most":
            edges = np.clip(np.append(starts[sections], high[t]), low[t], high[t])
            owner[t] = sections[np.argmax(np.diff(edges))]
        touched[sections] += 1
        touched[owner[t]] -= 1
    return np.bincount(owner, minlength=len(starts)), touched


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "first") -> DataFrame:
    """Tokens of each line of each document.

    ``doc_id, section`` (from 0), ``start`` and ``length`` in characters,
    ``n_tokens`` allocated to the section by the rule, ``n_crossing`` tokens that
    touch it but count elsewhere.  A null or empty text has one empty section
    without tokens; the end of a text behind its last line feed is a section of
    its own, empty as it may be.  Repeated rows are documents of their own, texts
    of any length are encoded whole, further columns are not read, and an empty
    table gives an empty one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = [f.split()[0] for f in SECTIONS.split(", ")]

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path, pattern)
        widths = np.array([len(t) for t in encode.token], np.int64)
        parts = []
        for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            text = text or ""
            starts = line_starts(text)
            if text:
                counts, crossing = allocate(*token_spans(text, encode, widths), starts, rule)
            else:
                counts = crossing = np.zeros(1, np.int64)
            n = len(starts)
            parts.append((pa.array([doc] * n, pa.int64()), np.arange(n, dtype=np.int32), starts,
                          np.diff(np.append(starts, len(text))), counts, crossing))
        columns = [pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in column])
                   for column in zip(*parts)]
        return pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(by_slice(batch), SECTIONS)
