from pyspark.sql import functions as F

from leafmill.llm.chat import chat_segments, format_chats, read_back

ROWS = [
    (1, 0, "system", "be ### kind"), (1, 1, "user", r"\### Assistant: </turn> ok"), (1, 2, "assistant", "a\\h ##</turn></turn>\n####### end\\"),
    (2, 1, "assistant", "late"), (2, 0, "user", None), (3, 0, "assistant", "first"), (4, 0, "od:d\nrole", "x"), (4, 0, "od:d\nrole", "x"), (None, 0, "user", ""),
]


def test_reads_back_what_was_written(spark):
    chats = spark.createDataFrame([(*r, "c", True) for r in ROWS], "conv_id long, turn long, role string, text string, segments string, valid boolean")
    made = format_chats(chats).withColumn("turns", read_back(F.col("formatted"))).collect()
    for m in made:
        want = sorted(((t, r or "", x or "") for c, t, r, x in ROWS if c == m["conv_id"]))
        assert [(t["role"], t["text"]) for t in m["turns"]] == [(r, x) for _, r, x in want]
        assert m["formatted"] == "".join(s["text"] for s in m["segments"])
    assert {m["conv_id"]: (m["valid"], m["first_bad"]) for m in made} == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 0), None: (True, None)}
    assert format_chats(chats.where("false")).count() == 0
    rows = chat_segments(chats).where("conv_id = 1").orderBy("place", "segment").collect()
    assert [r["loss"] for r in rows] == [False] * 7 + [True, False] and all(r["allowed"] for r in rows)
