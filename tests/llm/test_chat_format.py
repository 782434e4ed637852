import random
import time

from pyspark.sql import functions as F

from tarn.llm import chat_format as c

HOSTILE = ["\\### Assistant: </turn> ok", "### ", "</turn>", "####  ", "<\\/turn>", "#\\## x", "a</turn>\n### user: b", "", None, " ", "\n", "### </turn>### ", "#\\\\## <\\\\/turn>", "x: y", "\\"]


def rows():
    rng = random.Random(4)
    out = [(i, j, rng.choice(["user", "assistant", "system"]), rng.choice(HOSTILE)) for i in range(40) for j in range(rng.randint(1, 8))]
    out += [(100 + i, 0, "assistant", "".join(rng.choice("#</turn>\\ a:\n") for _ in range(30))) for i in range(200)]
    return out + [(500, 1, None, "x"), (500, 1, None, "x"), (500, None, "a: b ### </turn>", "y"), (None, 0, "user", "null id"), (501, 0, "assistant", "long " * 100_000)]


def test_round_trip(spark):
    data = rows()
    turns = spark.createDataFrame([(*r, 1) for r in data], "conv_id long, turn long, role string, text string, turns int")
    done = c.format_conversations(turns).withColumn("loss", c.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    want = {}
    for conv, turn, role, text in data:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert len(done) == len(want)
    for r in done:
        source = [(role, text) for _, _, role, text in sorted(want[r.conv_id])]
        assert r.identical and [(t.role, t.text) for t in r.turns] == source
        assert r.loss == "".join(t for role, t in source if role == "assistant")
        assert r.formatted.count("### ") == len(source) == r.formatted.count("</turn>")
        assert [r.formatted[s.start : s.stop] for s in r.loss_spans] == [x.split(": ", 1)[1].split("</turn>")[0] for x in r.formatted.split("### ")[1:] if x.startswith("assistant: ")]


def test_plain_texts_stay_as_they_are(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a \\ b # c < d"), (1, 1, "assistant", "fine")], "conv_id long, turn long, role string, text string")
    r = c.format_conversations(turns).first()
    assert r.formatted == "### user: a \\ b # c < d</turn>\n### assistant: fine</turn>\n" and r.escaped == 0


def test_empty(spark):
    assert c.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_conversations_of_very_many_turns(spark):
    n = 30_000
    turns = spark.range(n).selectExpr("1 AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ### ', id) AS text")
    begun = time.time()
    r = c.format_conversations(turns).withColumn("loss", c.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert r.identical and len(r.turns) == n and r.loss == "".join(f"text ### {i}" for i in range(1, n, 2))
    assert time.time() - begun < 60
