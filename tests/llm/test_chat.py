"""Perspective rotation on hand-made conversations."""

from quizloom.llm import chat


def _one(out, speaker):
    return next(r for r in out if r.speaker == speaker)


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", "é?")]
    out = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.speaker for r in out} == {"ann", "bob"}
    a = _one(out, "ann")
    assert a.text == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
        "<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>assistant\né?<|im_end|>\n"
    )
    assert a.mask == "0101" and _one(out, "bob").mask == "0010"
    cut = [tuple(map(int, s.split(":"))) for s in a.spans.split()]
    assert [a.text[i:j] for i, j in cut] == ["hi<|im_end|>", "é?<|im_end|>"]
    assert a.trained_chars == sum(j - i for i, j in cut)


def test_parts_and_odd_rows(spark):
    rows = [(1, i, "ab"[i % 2], "t") for i in range(1000)] + [(2, None, None, None), (2, None, " ", ""), (3, 0, "system", "s"), (None, 0, "a", "x"), (None, 0, "a", "x")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, part string")
    out = chat.perspectives(df).collect()
    assert sum(r.n_turns for r in out) == 2000 + 2 + 1 + 2
    assert sorted(r.n_turns for r in out if r.conv_id == 1) == [232, 232] + [256] * 6
    assert [(r.speaker, r.part, r.mask) for r in out if r.conv_id == 2] == [("unknown", -1, "11")]
    assert [(r.speaker, r.mask, r.trained_chars) for r in out if r.conv_id == 3] == [(None, "0", 0)]
    assert [(r.speaker, r.n_turns) for r in out if r.conv_id is None] == [("a", 2)]
    assert chat.perspectives(df.limit(0)).count() == 0
    assert "Python" not in chat.perspectives(df)._jdf.queryExecution().toString()
