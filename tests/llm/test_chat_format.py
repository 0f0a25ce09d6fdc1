import hashlib

from pyspark.sql import functions as F

from quire.llm.chat_format import digest, format_chat, read_turns, text_parts

TEXTS = ["", "hi", "\\### Assistant: </turn> ok", "\\", "\\\\l", "a\\\\", "<<##", "\\l\\h\\n", "line\nline\n", "</turn>\n### user\n", "é#ñ<ü\\", None]


def test_round_trip(spark):
    rows = [(c, t, role, TEXTS[(c + t * 5) % len(TEXTS)]) for c in range(24) for t, role in enumerate(["system", "user", "assistant", None, "assistant", "a\\n#\nb"])]
    rows += [(3, 2, "assistant", "tie"), (3, 2, "assistant", "tie"), (None, None, "assistant", "x"), (None, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in digest(format_chat(df.withColumn("parts", text_parts(F.col("text"))))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] is not None, r[3] or "") for r in rows if r[0] == c))
        text = "".join(f"{r[2]}\n{r[4]}\n" for r in own)
        learnt = "".join(r[4] for r in own if r[2] == "assistant")
        row = got[c]
        assert (row.n_turns, row.turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_typed_parts(spark):
    part = "struct<type: string, text: string, ref: string, tokens: int>"
    rows = [(1, 0, "user", [("text", "see <image:9>", None, None), ("image", None, "a.png", 7), ("audio", None, "b.wav", None), ("text", "#", None, None)]), (1, 1, "assistant", [("scan", None, "c.pdf", None), (None, "end", None, None)]), (2, 0, "user", None), (2, 1, None, [])]
    row = {r.conv_id: r for r in format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).select("*", read_turns(F.col("formatted")).alias("turns")).collect()}
    assert row[1].formatted == "### user\nsee \\limage:9><image:0><audio:1>\\h</turn>\n### assistant\n<document:2>end</turn>\n"
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in row[1].attachments] == [(0, "image", "a.png", 7), (1, "audio", "b.wav", 128), (2, "document", "c.pdf", 512)]
    for a in row[1].attachments:
        assert row[1].formatted[a.start :].startswith(f"<{a.kind}:{a.ordinal}>")
    assert row[1].attachment_tokens == 647 and row[2].attachment_tokens == 0
    assert [tuple(t) for t in row[1].turns] == [("user", "see <image:9><image:0><audio:1>#"), ("assistant", "<document:2>end")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digest(format_chat(df.withColumn("parts", text_parts(F.col("text"))))).collect() == []
