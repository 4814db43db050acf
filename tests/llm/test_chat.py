import hashlib

import pytest
from made_texts import prose

from srcatlas.llm import chat

SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def text(t):
    return ("text", t, None, None)


def read(spark, rows):
    return {r.conv_id: r for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, SCHEMA))).collect()}


HARD = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|", "<\\\\|im_end|>\n", "a\\b", "<", "|>", "<|", "<<|\\|", "\n", "é😀 <|", "%3C%0A"]


def test_texts_come_back(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", [text(t)]) for k, t in enumerate(HARD)]
    got = read(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [("user" if k % 2 else "assistant", t) for k, t in enumerate(HARD)]
    assert got.loss_text == "".join(t for k, t in enumerate(HARD) if not k % 2)
    assert got.formatted.count(chat.OPEN) == len(HARD) == got.formatted.count(chat.CLOSE)
    for span in got.loss:
        assert chat.OPEN not in got.formatted[span.start : span.end]


def test_layout(spark):
    got = read(spark, [(1, 2, "assistant", [text("B")]), (1, 1, "user", [text("A")])])[1]
    assert got.formatted == "<|im_start|>user\nA<|im_end|>\n<|im_start|>assistant\nB<|im_end|>\n"
    assert [(s.turn, got.formatted[s.start : s.end]) for s in got.loss] == [(1, "B")]


def test_parts_become_placeholders(spark):
    rows = [
        (1, 0, "user", [text("see "), ("image", None, "i.png", 78_400), text(" and "), ("audio", None, "a.wav", 401)]),
        (1, 1, "assistant", [text("here: "), ("document", None, "d.pdf", None), text("<|image_0|>")]),
    ]
    got = read(spark, rows)[1]
    assert got.formatted == (
        "<|im_start|>user\nsee <|image_0|> and <|audio_1|><|im_end|>\n"
        "<|im_start|>assistant\nhere: <|document_2|><\\|image_0|><|im_end|>\n"
    )
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in got.attachments] == [(0, "image", "i.png", 100), (0, "audio", "a.wav", 11), (1, "document", "d.pdf", 1)]
    for a in got.attachments:
        assert got.formatted[a.start :].startswith(f"<|{a.kind}_")
    assert got.loss_text == "here: <|image_0|>"


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", [text("n")]),
        (2, None, None, None),
        (2, 3, "assistant", []),
        (2, 3, "assistant", [text(None)]),
        (2, 3, "assistant", [text("x")]),
        (2, 3, "assistant", [text("x")]),
        (3, 0, "a\nb<|%", [text("y")]),
        (4, 0, "assistant", [text(prose(20_000))]),
    ]
    got = read(spark, rows)
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("assistant", ""), ("assistant", ""), ("assistant", "x"), ("assistant", "x")]
    assert got[2].loss_text == "xx" and got[None].loss_text == "" and got[4].loss_text == prose(20_000)
    assert got[3].turns[0].role == "a\nb<|%"
    assert read(spark, []) == {}


def test_other_kinds_are_refused(spark):
    with pytest.raises(Exception, match="no such kind"):
        read(spark, [(1, 0, "user", [("video", None, "v", 1)])])


def test_query_digests(spark, sf_dir):
    from srcatlas.llm.registry import CONTROL, queries

    got = {r.conv_id: r for r in queries()["op7_chat_format"](spark, sf_dir).collect()}
    assert got[-1].loss_sha256 == hashlib.sha256(CONTROL.encode()).hexdigest()
    turns = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(turns) | {-1} == set(got)
    for i, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        want = hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in own).encode()).hexdigest()
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars) == (len(own), want, len(loss))
        assert got[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
