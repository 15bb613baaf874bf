import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.chat import LAYOUTS, Layout, Template, canonical_turns, chats, escaped, fingerprint_of, formatted, read_back, unescaped

T = Template()
BITS = st.sampled_from([*T.all_controls, T.escape, "0", "1", "<", "|", "im_end", "é", "\n", "[", "<|", "𝔘", "a b"])


def rows_of(df, *names):
    return {r[0]: tuple(r[n] for n in names) for r in df.collect()}


def test_layouts_of_json(spark):
    records = {
        1: {"prompt": "p", "completion": "c", "meta": {"id": 4}}, 2: {"instruction": "do", "input": "", "output": "out"}, 3: {"instruction": "do", "input": "this", "output": "out", "system": "s"},
        4: {"messages": [{"role": "user", "content": "u", "name": "n"}, {"content": None, "role": "tool"}, {"role": "assistant"}]}, 5: {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "x", "value": 5}]},
        6: {"messages": "no list"}, 7: {"messages": []}, 8: {"prompt": "p"}, 9: {"prompt": "p", "completion": None, "response": "r"}, 10: {"question": 5, "answer": True}, 11: {"instruction": "do", "output": "out"},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in records.items()] + [(12, "{bad"), (13, None)], "conv_id long, record string")
    out = canonical_turns(df, json="record")
    got = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in out.collect()}
    assert got[1] == ("prompt", [("user", "p"), ("assistant", "c")]) and got[2] == ("instruction", [("user", "do"), ("assistant", "out")])
    assert got[3] == ("instruction", [("system", "s"), ("user", "do\n\nthis"), ("assistant", "out")]) and got[11] == got[2]
    assert got[4] == ("messages", [("user", "u"), ("tool", ""), ("assistant", "")]) and got[5] == ("dialogue", [("user", "h"), ("assistant", "g"), ("x", "5")])
    assert got[9] == ("response", [("user", "p"), ("assistant", "r")]) and got[10] == ("question", [("user", "5"), ("assistant", "true")])
    assert all(got[k] == (None, None) for k in (6, 7, 8, 12, 13))
    prints = rows_of(out, "fingerprint")
    assert prints[1] == (fingerprint_of(["completion", "prompt"]),) and prints[4] == (fingerprint_of(["messages[].content", "messages[].role"]),)


def test_layouts_of_columns(spark):
    df = spark.createDataFrame([(1, None, "p", "c", 1, "x"), (2, [("user", "u"), (None, None)], None, None, 2, "y"), (3, None, None, None, 3, None), (4, [("a", "b")], "p", "c", 4, None)], "conv_id long, messages array<struct<role:string,content:string>>, prompt string, completion string, id_ int, turns string")
    with pytest.raises(ValueError):
        canonical_turns(df.drop("id_"), layouts=(*LAYOUTS, Layout("again", (("user", ("prompt",)), ("assistant", ("completion",))))))
    got = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in canonical_turns(df.drop("id_")).collect()}
    assert got == {1: ("prompt", [("user", "p"), ("assistant", "c")]), 2: ("messages", [("user", "u"), ("", "")]), 3: (None, None), 4: (None, None)}


def test_escapes_are_reversible(spark):
    texts = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(BITS, max_size=12))
    def collect(parts):
        texts.append("".join(parts))

    collect()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", "t", escaped(F.col("t"), T).alias("e")).select("*", unescaped(F.col("e"), T).alias("u"))
    for r in df.collect():
        assert r.u == r.t and not any(c in r.e for c in T.all_controls)


def test_round_trip(spark):
    rows = [(1, None, "system", "s"), (1, 2, "assistant", "two <|im_end|>"), (1, 1, "user", None), (1, 3, "assistant", "␛1 é"), (2, 0, None, "</s>[INST] ok [/INST]"), (3, 0, "assis<|im_sep|>tant", ""), (3, 1, "assistant", ""), (None, 0, "assistant", "lost?")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, loss int, formatted string").repartition(3)
    made = formatted(canonical_turns(chats(df)))
    out = {r.conv_id: ([tuple(t) for t in r.turns], r.learned, r.n_chars) for r in read_back(made).collect()}
    assert out[1][:2] == ([("system", "s"), ("user", ""), ("assistant", "two <|im_end|>"), ("assistant", "␛1 é")], "two <|im_end|>␛1 é")
    assert out[2][:2] == ([("", "</s>[INST] ok [/INST]")], "") and out[3][:2] == ([("assis<|im_sep|>tant", ""), ("assistant", "")], "") and out[None][1] == "lost?"
    text = {r.conv_id: (r.formatted, r.loss) for r in made.collect()}
    assert text[2][0] == "<|im_start|><|im_sep|><␛1/s>[␛1INST] ok [␛1/INST]<|im_end|>" and out[2][2] == len(text[2][0])
    whole, loss = text[1]
    parts = [p + "<|im_end|>" for p in whole.split("<|im_end|>")[:-1]]
    assert [parts[m.turn][m.start : m.start + m.length] for m in loss] == ["two <␛1|im_end|>", "␛01 é"]
    assert formatted(canonical_turns(chats(df.limit(0)))).count() == 0


def test_templates_that_cannot_be_read_back():
    for bad in ({"open": "1x"}, {"close": "|"}, {"controls": ("a␛",)}):
        with pytest.raises(ValueError):
            Template(**bad)
