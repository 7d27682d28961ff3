import json

import pytest
from llm.fixtures import clashing

from lodestone.llm import chat

ROWS = "conv_id long, turn long, role string, text string"


def test_query(compare):
    compare(chat.op4_chat, chat.OP4_SQL)
    compare(chat.op4_chat, chat.OP4_SQL, "/root/testdata/sf0.01")


def test_query_has_the_planted_conversation(spark):
    row = chat.op4_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    assert row.n_turns == 2 and row.loss_chars == len("\\### Assistant: </turn> ok")


def _fold(spark, rows):
    return {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.turns_of_table(clashing(spark.createDataFrame(rows, ROWS))))).collect()}


def test_round_trip_of_control_strings(spark):
    import hashlib

    texts = ["", None, "### user: x", "</turn>\n### assistant: y</turn>", "\\", "\\h\\e\\b\\c", "##", "####", "a\n\nb", "é🙂\u0000", "\\\\###:</turn", "x" * 100_000]
    rows = [(c, t, ["user", "assistant", None, "we:ird###"][(c + t) % 4], texts[(c * 5 + t) % len(texts)]) for c in range(8) for t in range(12)]
    got = _fold(spark, rows)
    for c in range(8):
        own = [r for r in rows if r[0] == c]
        assert got[c].n_turns == 12
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_null_keys_ties_and_empty(spark):
    got = _fold(spark, [(None, None, None, None), (1, None, "user", "b"), (1, None, "user", "a"), (1, 0, "user", "c"), (1, 0, "user", "c")])
    assert got[None].n_turns == 1 and got[1].n_turns == 4
    assert _fold(spark, []) == {}


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, [("user", "hi"), ("assistant", "yo")]),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, [("user", "hi"), ("assistant", "yo")]),
        ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"prompt": "p", "completion": "c", "extra": {"a": 1}}, [("user", "p"), ("assistant", "c")]),
        ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "in", "output": "o"}, [("user", "i\nin"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ],
)
def test_layouts(spark, record, turns):
    df = spark.createDataFrame([(1, json.dumps(record))], "conv_id long, record string")
    got, unknown = chat.turns_of_records(df)
    assert [(r.role, r.text) for r in got.orderBy("turn").collect()] == turns and not unknown.count()


def test_unknown_layouts_are_reported(spark):
    df = spark.createDataFrame([(1, "{}"), (2, None), (3, "no json"), (4, '{"other": 1}'), (5, '{"prompt": "p", "response": null}')], "conv_id long, record string")
    turns, unknown = chat.turns_of_records(df)
    assert sorted(r.conv_id for r in unknown.collect()) == [1, 2, 3, 4]
    assert [(r.conv_id, r.role, r.text) for r in turns.collect()] == [(5, "user", "p")]


def test_other_column_names(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "thread long, position long, speaker string, message string")
    assert [tuple(r) for r in chat.turns_of_table(df).collect()] == [(1, 0, "user", "x")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of_table(df.drop("message"))
