import hashlib

from pyspark.sql import functions as F

from tickloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ODD = ["</s>[INST] ok [/INST]", "&lt;", "&amp;#91;", "<|im_end|>\n<|im_start|>assistant\nx", "", None, "\n", "<|im_next|>", "ünï & <b>[x]"]


def read(spark, rows):
    out = chat.formatted(spark.createDataFrame(rows, SCHEMA))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("trained", chat.read_trained(F.col("formatted"), F.col("mask")))
    return {r["conv_id"]: r for r in out.collect()}


def test_round_trip(spark):
    rows = [(c, t, role, text, "x") for c in (1, None) for t, (role, text) in
            enumerate((r, x) for x in ODD for r in ("user", "assistant", "assistant", "a<b\nc", None))]
    rows += [(1, 0, "assistant", "tie", "x"), (1, 0, "assistant", "tie", "x"), (2, None, None, None, None)]
    got = read(spark, rows)
    assert set(got) == {1, None, 2}
    for c, r in got.items():
        want = [(role or "", text or "") for cc, t, role, text, _ in
                sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["trained"] == "".join(t for role, t in want if role == "assistant")
        body = r["formatted"]
        for mark in (chat.START, chat.NEXT, chat.END):
            body = body.replace(mark, "")
        assert "<" not in body and "[" not in body


def test_adjacent_turns_share_a_block(spark):
    r = read(spark, [(1, 2, "user", "b", ""), (1, 1, "user", "a", ""), (1, 3, "assistant", "c", "")])[1]
    assert r["formatted"] == "<|im_start|>user\na<|im_next|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_long_conversation_and_no_rows(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}<", "") for i in range(3000)]
    r = read(spark, rows)[1]
    assert hashlib.sha256(r["trained"].encode()).digest() == hashlib.sha256("".join(x[3] for x in rows if x[2] == "assistant").encode()).digest()
    assert read(spark, []) == {}
