"""Encoding, decoding, token counts and packing against the public libraries and by hand."""

import random
import zlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from scansio.llm import bpe, packing, quality, simhash, tokens
from scansio.llm.queries import JSON, PATTERN, QUERIES, RANKS

TEXTS = ["", None, "a", "  two  blanks ", "it's we'll 'r'e", "é日本😀", "line\n\nline\n", "a" * 3000, " " * 700 + "x",
         "=" * 300, "<|endoftext|> is text", "ab" * 1500, "the same", "the same"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def frame(spark, rows, schema="doc_id bigint, text string, ids int, length string"):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], schema)


def test_tree_is_the_encoding(library, monkeypatch):
    """Tiny leaves: every join of two halves is at work."""
    for name, size in (("LEAF_CHARS", 5), ("LEAF_BYTES", 3), ("LEAF_TOKENS", 3)):
        monkeypatch.setattr(bpe, name, size)
    encoder = bpe.Encoder(RANKS, PATTERN)
    draw = random.Random(5)
    parts = ["'s", "'", "re", "ll", " ", "  ", "\n", "a", "the", "ing", "é", "12", "!", "日", "\t", "😀", " 't"]
    made = ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(3000)]
    made += ["".join(draw.choices("abcdei", k=draw.randint(50, 300))) for _ in range(100)]
    for text in made + [t or "" for t in TEXTS]:
        ids = encoder.encode(text)
        assert memoryview(ids).cast("I").tolist() == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_merges_of_long_pieces():
    ranks = bpe.read_ranks(RANKS)
    draw = random.Random(6)
    for _ in range(300):
        piece = bytes(draw.choices(b"abcdeiou st", k=draw.randint(2, 60)))
        assert bpe.merge_listed(piece, ranks) == bpe.merge_heaped(piece, ranks)


def test_codec_of_frames(spark, library):
    rows = list(enumerate(TEXTS)) + [(None, "no id")]
    docs = frame(spark, rows)
    encoded = bpe.encode(docs.select("doc_id", "text"), RANKS, PATTERN)
    decoded = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(encoded, RANKS, PATTERN).collect()}
    assert decoded == {i: (t or "").encode() for i, t in rows}
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.digests(docs, RANKS, PATTERN).collect()}
    assert got == {i: len(library.encode_ordinary(t or "")) for i, t in rows}
    assert bpe.digests(docs.limit(0), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("rule", tokens.RULES)
def test_sections_share_out_all_tokens(spark, library, rule):
    rows = list(enumerate(TEXTS))
    got = tokens.count_tokens(frame(spark, rows), RANKS, PATTERN, rule).collect()
    for i, text in rows:
        mine = sorted((r["section"], r["start"], r["length"], r["n_tokens"]) for r in got if r["doc_id"] == i)
        lines = (text or "").split("\n")
        assert len(mine) == len(lines) and sum(m[3] for m in mine) == len(library.encode_ordinary(text or ""))
        assert sum(m[2] for m in mine) == len(text or "")


def test_crossing_tokens_by_rule():
    import numpy as np

    low, high, starts = np.array([0, 2, 6]), np.array([2, 6, 8]), np.array([0, 3, 7])
    by_rule = {r: tokens.allocate(low, high, starts, r)[0].tolist() for r in tokens.RULES}
    assert by_rule == {"first": [2, 1, 0], "last": [1, 1, 1], "most": [1, 2, 0]}
    assert tokens.allocate(low, high, starts, "most")[1].tolist() == [1, 0, 1]


def test_token_counts_of_odd_tables(spark, library):
    """Repeated rows, null ids, a very long text, names of the result among the columns, an empty table."""
    long = "some words here\n" * 20000
    rows = [(1, "a b\nc"), (1, "a b\nc"), (None, "x"), (2, None), (3, ""), (4, long)]
    docs = frame(spark, rows, "doc_id bigint, text string, section int, n_tokens string")
    got = tokens.count_tokens(docs, RANKS, PATTERN).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["length"], r["n_tokens"]))
    assert len(by[1]) == 4 and sorted(by[1])[::2] == sorted(by[1])[1::2]
    assert by[2] == by[3] == [(0, 0, 0, 0)] and len(by[None]) == 1
    assert len(by[4]) == 20001 and sum(x[3] for x in by[4]) == len(library.encode_ordinary(long))
    assert tokens.count_tokens(docs.limit(0), RANKS, PATTERN).count() == 0


def test_names_that_clash_are_errors(spark):
    docs = frame(spark, [(1, "a")], "doc_id bigint, text string, ids int, hash string")
    for work in (lambda: bpe.encode(docs, RANKS, PATTERN), lambda: simhash.fingerprints(docs),
                 lambda: quality.scored(docs, quality.Machine.new(), "hash")):
        with pytest.raises(ValueError, match="already"):
            work()


def test_words_are_the_tokenizers_ids():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    words = packing.Words(JSON, PATTERN)
    for text in [*TEXTS, " " * 2_000_000 + "x", "\n" * 5000 + " <|endoftext|>", "a" * 200_000]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert memoryview(words.ids(text or "")).cast("I").tolist() == ids


def test_packed_ids_are_the_librarys_by_default(spark, tmp_path):
    """The query and the pipeline: added tokens of the file are tokens, also inside a word and twice in a row."""
    tokenizer = Tokenizer.from_file(JSON)
    named = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in named
    made = [f"end of page {t} next page" for t in named] + [f"a{t}{t}b\n {t}  é" for t in named] + ["<|endoftext", "<|END|>"]
    rows = [(i, t) for i, t in enumerate(TEXTS + made) if len(t or "") < 300]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, len(ids), zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids))))
    for got in (QUERIES["op1_best_fit_packing"](spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, "")):
        assert sorted(map(tuple, got.select("doc_id", "length", "ids_crc32").collect())) == want


def sequences_of(plan, counts, capacity):
    """Fill the sequences of a plan, checking that each is gapless and fits."""
    held, used = {}, dict.fromkeys(counts, 0)
    for w, low, high, first, each, base in plan:
        assert (high - low) % each == 0 and used[w] == low
        used[w] = high
        for r in range(high - low):
            held.setdefault(first + r // each, []).append((base + r % each * w, w))
    assert used == counts
    for parts in held.values():
        at = 0
        for offset, w in sorted(parts):
            assert offset == at
            at += w
        assert at <= capacity
    return len(held)


def fewest(sizes, capacity):
    """The least number of sequences, by trying all."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1:])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    """Fixed sets and the best packing of the rest are the best packing of all."""
    draw = random.Random(11)
    for _ in range(200):
        capacity = draw.choice([8, 12, 20])
        sizes = sorted((draw.randint(1, capacity) for _ in range(draw.randint(1, 9))), reverse=True)
        counts = {w: sizes.count(w) for w in sizes}
        rest = packing.Sizes(counts)
        fixed = sum(b.count for b in packing.reduce(rest, capacity))
        left = sorted((w for w, n in rest.counts.items() for _ in range(n)), reverse=True)
        assert fixed + fewest(left, capacity) == fewest(sizes, capacity)
        sequences_of(packing.segments(counts, capacity), counts, capacity)


def test_pack_of_frames(spark):
    docs = frame(spark, [*enumerate(TEXTS), (None, "no id"), (3, "a"), (3, "a")])
    rows = packing.packed_digests(docs, JSON, PATTERN, capacity=64).collect()
    words = packing.Words(JSON, PATTERN)
    seen = {}
    for r in rows:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        assert sorted(parts)[0][0] == 0 and sum(n for _, n in parts) <= 64
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    for i, text in enumerate(TEXTS):
        ids = words.ids(text or "") + (2).to_bytes(4, "little")
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        mine = mine if i != 3 else mine[:0]
        for piece, start, length, crc in mine:
            assert crc == zlib.crc32(ids[4 * start:4 * (start + length)]) and (length == 64 or piece == 0)
        assert i == 3 or sum(m[2] for m in mine) == len(ids) // 4
    assert sum(r["doc_id"] == 3 for r in rows) == 3
    assert packing.packed_digests(docs.limit(0), JSON, PATTERN).count() == 0


def test_sequences_hold_the_ids(spark):
    pieces = packing.tokenise(frame(spark, list(enumerate(TEXTS))), JSON, PATTERN, 128)
    whole = packing.sequences(packing.pack(pieces, 128)).collect()
    assert all(len(r["ids"]) == 4 * r["length"] <= 512 for r in whole)
    assert sum(r["length"] for r in whole) == pieces.selectExpr("sum(length)").first()[0]


def test_hot_length_is_numbered_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 50)
    pieces = spark.range(1000).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 3 = 0, id % 9 + 1, 4) as bigint) as length")
    ranks = packing.numbered(pieces, ["doc_id", "piece"], 1000).groupBy("length").agg({"rank": "max", "*": "count"}).collect()
    assert all(r["max(rank)"] + 1 == r["count(1)"] for r in ranks)


def test_vocabulary_is_not_in_the_repository():
    assert public_tokenizers.path("x").startswith("/opt")
