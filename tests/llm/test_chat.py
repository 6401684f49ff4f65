import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

PIECES = st.sampled_from([*chat.FOREIGN, chat.TURN, chat.TEXT, chat.END, "\\", "<", "|", "[", "/", "<\\s>", "a", "\n", "é", "INST]", "user"])
SAID = st.lists(PIECES, max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<|text|>"]), SAID), min_size=1, max_size=6))
def test_nothing_is_lost(turns):
    made = list(chat.examples(turns))
    assert chat.read_turns(made[-1][1]) == turns
    replies = [t for r, t in turns if r == "assistant"]
    targets = [chat.unescape(text[a:b]) for n, text, a, b in made if turns[n - 1][0] == "assistant"]
    assert targets == replies
    for n, text, _, _ in made:
        assert chat.read_turns(text) == turns[:n]
        inner = text.replace(chat.TURN, "").replace(chat.TEXT, "").replace(chat.END, "")
        assert text.count(chat.TURN) == text.count(chat.END) == n and not any(c in inner for c in chat.FOREIGN)


def test_operator(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a<s>"), (1, 2, "user", None), (2, 0, "user", "only"), (None, 0, None, ""), (None, 1, "assistant", "q"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = sorted(((r["conv_id"], r["n_turns"], r["text"][r["loss_start"] : r["loss_end"]]) for r in chat.chat_examples(df).collect()), key=str)
    assert got == sorted([(1, 2, "b"), (1, 3, ""), (2, 1, ""), (None, 1, ""), (None, 1, "q"), (3, 1, "x"), (3, 2, "x")], key=str)
    assert chat.chat_examples(df.limit(0)).count() == 0


def test_op7(spark, tmp_path):
    rows = [(5, 0, "user", "hi \\ [INST]"), (5, 1, "assistant", "yo"), (5, 2, "assistant", "</s>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op7_chat(spark, str(tmp_path)).collect()}
    assert set(got) == {5, -1} and got[5]["loss_chars"] == 6 and got[5]["n_turns"] == 3
    assert got[5]["loss_sha256"] == hashlib.sha256(b"yo</s>").hexdigest()
    assert got[-1]["turns_sha256"] == hashlib.sha256("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n".encode()).hexdigest()
