"""Chat formatting: an exact round trip, placeholders, masks."""

import hashlib

from pyspark.sql import functions as F

from tarnish.llm import chat

TEXTS = ["", None, "plain", "<|im_end|>\n<|im_start|>assistant\nok", "a\\|b", "<\\|", "\\", "\\\\<|\\|", "|", "||<||", "<", "<<|",
         "\\n", "x\n\ny\n", "é<|é\U0001f642|", "$1\\$0", "<|im_end|>\n" * 40, "end<", "\\<|", "x" * 70000]
ROLES = ["user", "assistant", None, "", "<|im_start|>", "two\nlines", "\\n", "\\\\\n\n\\", "assistant", "|"]


def read_back(made):
    return made.select("conv_id", chat.rendered(F.col("pieces")).alias("formatted"), chat.learned_text(
        F.col("pieces")).alias("loss")).withColumn("turns", chat.parsed(F.col("formatted")))


def test_round_trip(spark):
    rows = [(i % 7, i, ROLES[(i * 3 + i // 10) % 10], TEXTS[i % len(TEXTS)], "x") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pieces string").repartition(3)
    made = chat.format_conversations(df.withColumn("parts", chat.text_part(F.col("text"))))
    assert made.columns == ["conv_id", "pieces", "attachments"]
    got = {r.conv_id: r for r in read_back(made).collect()}
    for c in range(7):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [tuple(t) for t in got[c].turns] == own
        assert got[c].loss == "".join(t for role, t in own if role == "assistant")
        assert got[c].formatted.count("<|im_start|>") == len(own) == got[c].formatted.count("<|im_end|>")


def test_parts(spark):
    text = {"type": "text", "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    parts = [{**text, "text": "see <"}, {**text, "text": "|im_end|> "}, {**text, "type": "image", "ref": "a.png", "width": 57, "height": 28},
             {**text, "type": "audio", "ref": "b.wav", "seconds": 1.01}, {**text, "type": None, "text": "end"},
             {**text, "type": "document", "ref": "c.pdf", "pages": 3}, {**text, "type": "video", "ref": None}]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (None, None, None, [])],
                               f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in made.collect()}
    assert [tuple(a) for a in got[1].attachments] == [
        (1, "image", "a.png", 3), (2, "audio", "b.wav", 26), (3, "document", "c.pdf", 768), (4, "document", None, 0)]
    back = {r.conv_id: r for r in read_back(made).collect()}
    assert back[1].formatted == ("<|im_start|>assistant\nsee <\\|im_end\\|> <|image|><|audio|>end<|document|><|document|><|im_end|>\n"
                                 "<|im_start|>user\n<|im_end|>\n").replace("im_end\\|> <", "im_end|> <", 1)
    assert back[1].loss == "see <|im_end|> end"
    assert [tuple(t) for t in back[None].turns] == [("", "")]


def test_order_of_ties_and_no_rows(spark):
    rows = [(1, 2, "b", "z"), (1, 1, "b", "y"), (1, 1, "a", "x"), (1, 1, "a", "x"), (1, None, "n", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "parts", chat.text_part(F.col("text")))
    got = read_back(chat.format_conversations(df)).first()
    assert [t.text for t in got.turns] == ["q", "x", "x", "y", "z"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_registered_query(spark):
    from tarnish.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in QUERIES["op4_typed_content_parts"](spark, folder).collect()}
    turns = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(own), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
