"""Chat formatting: exact round trips, masks, placeholders and odd rows."""

import hashlib
import random

import pytest

from scansio.llm import chat
from tests.plans import plan_text

TEMPLATE = chat.Template()
TURN = "conv_id bigint, turn bigint, role string, text string, formatted string, loss int, tokens int"


def parts_of(spark, rows):
    return spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return kind, text, ref, width, height, seconds, pages


def hostile(draw):
    pieces = [*TEMPLATE.controls, "\\", "<", "[", "|", "/", "s>", "INST]", "\n", "é", "word", "<|im_", "𝄞"]
    return "".join(draw.choices(pieces, k=draw.randint(0, 30)))


def test_every_text_comes_back(spark):
    draw = random.Random(8)
    rows = [(c, t, draw.choice(["user", "assistant", "system", hostile(draw)]), hostile(draw), "", 0, 0) for c in range(40) for t in range(6)]
    turns = chat.text_parts(spark.createDataFrame(rows, TURN))
    made = chat.formatted(turns).cache()
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for conv in range(40):
        mine = [r for r in rows if r[0] == conv]
        assert [tuple(t) for t in back[conv]["turns"]] == [(r[2], r[3]) for r in mine]
        assert back[conv]["learned"] == [r[3] for r in mine if r[2] == "assistant"]
        # no mark but the template's own
        assert back[conv]["formatted"].count(TEMPLATE.begin) == back[conv]["formatted"].count(TEMPLATE.end) == 6
        assert not any(c in back[conv]["formatted"] for c in (*TEMPLATE.reserved, *TEMPLATE.placeholders))


def test_digests(spark):
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]", "", 0, 0), (-7, 1, "assistant", "</s>[INST] ok [/INST]", "", 0, 0),
            (1, 2, "assistant", "b𝄞", "", 0, 0), (1, 1, None, None, "", 0, 0), (1, None, "assistant", "", "", 0, 0),
            (1, 2, "assistant", "b𝄞", "", 0, 0), (1, 3, "assistant", "a" * 300_000, "", 0, 0), (None, 0, "user", "x", "", 0, 0)]
    got = {r["conv_id"]: r for r in chat.digests(chat.text_parts(spark.createDataFrame(rows, TURN))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = {-7: [(r[2], r[3]) for r in rows[:2]], None: [("user", "x")],
            1: [("assistant", ""), ("", ""), ("assistant", "b𝄞"), ("assistant", "b𝄞"), ("assistant", "a" * 300_000)]}
    for conv, turns in said.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(turns), len(learned), sha(learned))
        assert got[conv]["formatted_chars"] > sum(len(r) + len(t) for r, t in turns)
    assert chat.digests(chat.text_parts(spark.createDataFrame(rows[:0], TURN))).count() == 0


def test_parts_become_placeholders_in_order(spark):
    rows = [(1, 0, "user", [part("text", "look <|image|> "), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=1.5)]),
            (1, 1, "assistant", [part("text", "fine"), part(None, "!"), part("document", ref="c.pdf", pages=3)]),
            (1, 2, "user", None), (1, 3, "user", []), (1, 4, "user", [part("image"), part("audio"), part("document"), part("text")])]
    row = chat.formatted(parts_of(spark, rows)).first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [
        ("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 768), ("image", None, 1), ("audio", None, 1), ("document", None, 256)]
    assert row["tokens"] == 3 + 38 + 768 + 1 + 1 + 256
    marks = sorted((row["formatted"].index(m, at), m) for m in TEMPLATE.placeholders for at in [0])
    assert [m for _, m in marks] == list(TEMPLATE.placeholders)
    assert row["formatted"].startswith("<|im_start|>user<|im_sep|>look <\\|image|> <|image|><|audio|><|im_end|>")
    assert [tuple(x) for x in row["loss"]] == [(1, len("<|im_start|>assistant<|im_sep|>"), len("fine!<|document|>"))]
    back = chat.read_back(chat.formatted(parts_of(spark, rows))).first()
    assert back["learned"] == ["fine!<|document|>"] and [t["text"] for t in back["turns"]][2:4] == ["", ""]


def test_another_visitor_and_template(spark):
    class Clips(chat.Visitor):
        def video(self, part):
            return self.audio(part)

    rows = [(1, 0, "model", [part("text", "<end> x"), part("audio", seconds=2.0)])]
    template = chat.Template(begin="<turn>", role_end="<says>", end="<end>", learned=("model",))
    made = chat.formatted(parts_of(spark, rows), Clips(template, rate=10)).first()
    assert made["formatted"] == "<turn>model<says><\\end> x<|audio|><end>" and made["tokens"] == 20
    assert chat.read_back(chat.formatted(parts_of(spark, rows), Clips(template)), template).first()["learned"] == ["<end> x<|audio|>"]
    with pytest.raises(Exception, match="unknown kind of part: video"):
        chat.formatted(parts_of(spark, [(1, 0, "user", [part("video")])])).collect()


@pytest.mark.parametrize("marks", [{"begin": "<"}, {"begin": "a\\b"}, {"begin": "<<s>"}, {"end": "x<|im"}])
def test_marks_that_could_be_forged_are_refused(marks):
    with pytest.raises(ValueError):
        chat.Template(**marks)


def test_no_python_in_the_plan(spark):
    turns = chat.text_parts(spark.createDataFrame([(1, 0, "user", "x", "", 0, 0)], TURN))
    plan = plan_text(chat.digests(turns))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
