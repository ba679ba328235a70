"""Chat formatting: exact round trips over hostile texts."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

PART = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\\\\", "a", "\n", "é", "[", "END]", "<", " "]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PART, PART), max_size=4))
def test_round_trip(turns):
    text = chat.encode(turns)
    found, spans = chat.parse(text)
    assert found == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]


@pytest.mark.parametrize("text", ["", "x<s></s>", "<s>x</s>", "<s></s>x", "<s>[ROLE]a</s>", "<s>[ROLE]a[TEXT]b</s>", "<s>[ROLE]a[TEXT]b[END]", "<s></s></s>", "<s>[ROLE]a[TEXT][INST][END]</s>"])
def test_other_texts_are_refused(text):
    with pytest.raises(ValueError):
        chat.parse(text)


SCHEMA = "conv_id long, turn long, role string, text string, Text string, turns int"


def test_table(spark):
    rows = [(1, 1, "assistant", "b [END] \\", None, 1), (1, 0, "user", "a", None, 1), (2, 0, None, None, None, 1), (3, 0, "user", "x", None, 1), (3, 0, "user", "x", None, 1), (None, None, "assistant", "lost", None, 1), (4, 0, "assistant", "long " * 20_000, None, 1)]
    data = chat.with_probe(spark, spark.createDataFrame(rows, SCHEMA))
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(data)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out[1]["turns_sha256"] == sha("user\na\nassistant\nb [END] \\\n") and out[1]["loss_sha256"] == sha("b [END] \\")
    assert out[2]["turns_sha256"] == sha("\n\n") and out[2]["loss_chars"] == 0
    assert out[3]["n_turns"] == 2 and out[None]["loss_chars"] == 4 and out[4]["loss_chars"] == 100_000
    said = "</s>[INST] ok [/INST]"
    assert out[-7]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and out[-7]["loss_sha256"] == sha(said)
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
