"""Byte-level BPE as a monoid: halves are encoded, neighbours joined at their border.

A text is split into halves down to short leaves.  Joining two neighbours
re-encodes only a window around their border, and the window grows until what
lies outside cannot change:

* Pattern matches.  The pattern never looks behind a match's start, so scanning
  from a true start of a match gives the matches of the whole text.  A match of
  the left half is settled once every character that its decision looked at is
  in the left half.  Matches of the right half are settled from the first place
  where the new scan starts a match at the start of one of theirs.
* Tokens of one long match.  A token sequence is the encoding of its bytes if
  each two neighbouring tokens are the encoding of their bytes.  A re-encoded
  window that still begins and ends with the tokens that stood there leaves
  every pair outside as it was, so the whole sequence is the encoding.

Decoding concatenates bytes up the same tree.  A null text is empty.  The tree
of one document is built in one task; its parts are never longer than the
document, and documents are independent of each other.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.llm.common import by_slice, extended

LEAF_CHARS = 8192
LEAF_BYTES = 32
LEAF_TOKENS = 8192
#: Matches whose ids one Python worker remembers: twice as many at most, the older half is forgotten.
REMEMBERED = 250_000
#: Above every rank.
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of ``piece``: the pair of lowest rank is merged first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return merge_listed(piece, ranks) if len(piece) <= 2 * LEAF_BYTES else merge_heaped(piece, ranks)


def merge_listed(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """For short pieces: the ranks of all pairs in a list."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) != NEVER:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
    return [ranks[p] for p in parts]


def merge_heaped(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """For long pieces: the mergeable pairs in a heap."""
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if end[i] else n
        # an entry is stale if either side has been merged meanwhile
        if j >= n or ranks.get(piece[i:end[j]]) != rank:
            continue
        end[i], after[i], end[j] = end[j], after[j], 0
        if after[i] < n:
            before[after[i]] = i
            rank = ranks.get(piece[i:end[after[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i))
        if before[i] >= 0:
            rank = ranks.get(piece[before[i]:end[i]])
            if rank is not None:
                heapq.heappush(heap, (rank, before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = after[i]
    return ids


def packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


class Codes(dict):
    """Part of a text to its ids as little-endian unsigned 32-bit numbers, worked out when first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, match: str) -> bytes:
        code = self.older.get(match)
        if code is None:
            code = self.encode(match)
        if len(match) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[match] = code
        return code


class Encoder:
    """Encoding and decoding by one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.matches = regex.compile(pattern).findall
        self.code = Codes(lambda match: packed(self.encode_bytes(match.encode()))).__getitem__

    # one match

    def encode_bytes(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return merge(piece, self.ranks)
        # the largest power of two below the length: runs of one letter then split where their tokens do
        half = 1 << ((len(piece) - 1).bit_length() - 1)
        return self.join_tokens(self.encode_bytes(piece[:half]), self.encode_bytes(piece[half:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes, re-encoding a growing window at the border."""
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = merge(b"".join(map(self.token.__getitem__, left[-i:] + right[:j])), self.ranks)
            begins = i == len(left) or window[0] == left[-i]
            ends = j == len(right) or window[-1] == right[j - 1]
            if begins and ends:
                return left[:-i] + window + right[j:]
            i, j = (i if begins else 2 * i), (j if ends else 2 * j)

    # one text

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        return b"".join(self._encode(text, 0, len(text))[1])

    def _encode(self, text: str, low: int, high: int) -> tuple[list[str], list[bytes]]:
        if high - low <= LEAF_CHARS:
            found = self.matches(text[low:high])
            return found, list(map(self.code, found))
        middle = (low + high) // 2
        return self.join_matches(self._encode(text, low, middle), self._encode(text, middle, high))

    def join_matches(self, left, right):
        """The matches and codes of two neighbours' text, scanning a growing window anew."""
        found, codes = left
        ahead, tail = 0, 0
        # open: the decision may have looked past the end (1 character after a
        # match and the blank behind it, 3 from its start for a contraction)
        while tail < len(found) and (ahead < 2 or ahead + len(found[-1 - tail]) < 3):
            ahead += len(found[-1 - tail])
            tail += 1
        kept = len(found) - tail
        opened = "".join(found[kept:])
        fresh, used = self._rescan(opened, right[0])
        del found[kept:], codes[kept:]
        found += fresh
        codes += map(self.code, fresh)
        found += right[0][used:]
        codes += right[1][used:]
        return found, codes

    def _rescan(self, opened: str, right: list[str]) -> tuple[list[str], int]:
        """Matches from the start of ``opened`` up to a start of a match of ``right``, and its number."""
        grow = 4
        while True:
            grow = min(grow, len(right))
            scanned = opened + "".join(right[:grow])
            fresh = self.matches(scanned)
            if grow == len(right):
                return fresh, grow
            place, start, t = 0, len(opened), 0
            for k, match in enumerate(fresh):
                begin, place = place, place + len(match)
                if place + 2 > len(scanned) or begin + 3 > len(scanned):
                    break
                while start < place and t < grow:
                    start += len(right[t])
                    t += 1
                if start == place and place >= len(opened):
                    return fresh[:k + 1], t
            grow *= 2

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        count = len(ids) // 4
        if count <= LEAF_TOKENS:
            return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I").tolist()))
        half = count // 2 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    return Encoder(path, pattern)


def _mapped(df: DataFrame, column: str, out: str, work: Callable) -> DataFrame:
    """``df`` with ``work`` of a column's values instead of the column."""
    keep = [c for c in df.columns if c != column]

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        values = pa.array([work(x) for x in rows.column(len(keep)).to_pylist()], pa.large_binary())
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], values.cast(pa.binary())], [*keep, out])

    schema = extended(df.select(*keep), f"`{out}` binary")
    return df.select(*keep, column).mapInArrow(by_slice(batch), schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The text column replaced by its ids: binary, little-endian unsigned 32-bit. Null text has no ids."""
    return _mapped(df, text, ids, lambda x: encoder(path, pattern).encode(x or ""))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The ids replaced by the bytes they stand for."""
    return _mapped(df, ids, out, lambda x: encoder(path, pattern).decode(x or b""))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, encoded and decoded."""
    rows = encode(docs.select("doc_id", "text"), path, pattern).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(rows, path, pattern).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
