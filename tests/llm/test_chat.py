"""Chat formatting: exact round trip and the loss mask."""

import random

from pyspark.sql import functions as F

from shelfrank.llm.chat import PARTS, TOKENS, format_chats, read_loss, read_turns, text_parts


def turns():
    rng = random.Random(1)
    bits = ["<|end|>\n", "<|user|>\n", "<", "<.", "<<", "|>", ".", "|", "</s>[INST] ok [/INST]", "é", "日本", "\n", " ", "a\\b", "", "<|image 0|>"]
    out = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            out.append((c, t, rng.choice(["user", "assistant", "system", "a|b", "<|x|>", "", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))))
    out += [(50, 1, "assistant", None), (50, 0, "user", ""), (None, 0, "assistant", "none"), (51, 2, "user", "b"), (51, 2, "user", "a"), (51, None, "assistant", "first"),
            (52, 0, "assistant", "long <| " * 20000), (53, 0, "user", "same"), (53, 0, "user", "same")]
    rng.shuffle(out)
    return out


def expected(rows):
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in talks.items()}


def test_round_trip(spark):
    rows = turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", text_parts("text"))
    df = df.withColumn("loss", F.lit(1)).withColumn("t", F.lit(2)).withColumn("formatted", F.lit("x"))
    got = format_chats(df).select("conv_id", "formatted", read_turns().alias("turns"), read_loss().alias("learned"), "loss").collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert sorted((t.role, t.text) for t in r.turns) == sorted(want[r.conv_id])
        if r.conv_id != 51:
            assert [t.text for t in r.turns if t.role == "assistant"] == r.learned
        assert r.formatted.count("<|end|>\n") == len(want[r.conv_id])
        assert all(r.formatted[s.start - 3:s.start] == "|>\n" and r.formatted[s.end:s.end + 7] == "<|end|>" for s in r.loss)
    by = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got}
    assert by[51] == [("assistant", "first"), ("user", "a"), ("user", "b")]
    assert by[50] == [("user", ""), ("assistant", "")]


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [(1, 0, "user", [part("text", "look <here>: "), part("image", ref="a.png", units=4), part("text", " and "), part("audio", ref="b.wav", units=30)]),
            (1, 1, "assistant", [part("text", "a "), part("document", ref="c.pdf", units=2), None, part("video", ref="d", units=9), part(None)]),
            (2, 0, "user", None), (2, 1, "assistant", []), (3, 0, "assistant", [part("text")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}")
    got = {r.conv_id: r for r in format_chats(df).collect()}
    assert got[1].formatted == ("<|user|>\nlook <.here>: <|image 1|> and <|audio 3|><|end|>\n"
                                "<|assistant|>\na <|document 1|><|video 2|><|unknown 3|><|end|>\n")
    assert [(a.turn, a.place, a.kind, a.ref, a.n_tokens) for a in got[1].attachments] == [
        (0, 1, "image", "a.png", 4 * TOKENS["image"]), (0, 3, "audio", "b.wav", 30 * TOKENS["audio"]),
        (1, 1, "document", "c.pdf", 2 * TOKENS["document"]), (1, 2, "video", "d", 0), (1, 3, None, None, 0)]
    assert got[1].n_attachment_tokens == 4 * TOKENS["image"] + 30 * TOKENS["audio"] + 2 * TOKENS["document"]
    assert [got[1].formatted[s.start:s.end] for s in got[1].loss] == ["a <|document 1|><|video 2|><|unknown 3|>"]
    assert got[2].formatted == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert got[3].formatted == "<|assistant|>\n<|end|>\n"


def test_empty_table(spark):
    assert format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts {PARTS}")).count() == 0
