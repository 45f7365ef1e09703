import random

from pyspark.sql import functions as F

from srcatlas.llm import chat

PARTS = [*chat.CONTROL, "\\", "[", "]", "<", ">", " ", "\n", "a", "é", "</s", "[/INST", "INST]", "[INST] ", " [/INST]", " </s>", "<<SYS>>\n", "\n<</SYS>>\n\n", "<<ROLE x>>"]


def test_round_trip(spark):
    r = random.Random(8)
    rows = []
    for c in range(300):
        for t in range(r.randrange(1, 5)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "tool", "User", "", None, "a>>b", "<<ROLE"]), r.choice([None, "", "".join(r.choice(PARTS) for _ in range(r.randrange(6)))]), "x"))
    rows += [(500, 1, "user", "same", "x"), (500, 1, "user", "same", "x"), (501, None, "assistant", "n", "x"), (None, 0, "user", "u", "x"), (502, 0, "assistant", "x" * 200_000 + "\\", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_chats(df).select("*", chat.parse(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("mask")).alias("masked")).collect()
    assert len(done) == len({c for c, *_ in rows})
    first = lambda v: (v is not None, v if v is not None else 0)
    for d in done:
        own = sorted(((t, x or "", y or "") for c, t, x, y, _ in rows if c == d.conv_id), key=lambda z: (first(z[0]), z[1], z[2]))
        assert d.identical, d
        assert [(t.role, t.text) for t in d.turns] == [z[1:] for z in own]
        assert list(d.masked) == [z[2] for z in own if z[1] == "assistant"]
        for s in d.mask:
            assert d.formatted[s.end :].startswith(" </s>")
    plain = next(d for d in done if d.conv_id == 500)
    assert plain.formatted == "<s>[INST] same [/INST][INST] same [/INST]"
    assert chat.format_chats(df.where("false")).count() == 0
