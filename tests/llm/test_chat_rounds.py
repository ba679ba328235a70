"""Only conflicting turns are escaped, and escaping goes on until the turns come back."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat

PARTS = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\\\\", "a", "<", "]", "\n", "/"]), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_turns_come_back(turns):
    text = chat.encode(turns)
    assert chat.parse(text)[0] == turns
    # what escaping every turn gives: a turn without control strings is not changed by it
    assert text == chat.render([(chat.escape(r), chat.escape(t)) for r, t in turns])


def test_only_conflicts_change():
    turns = [("user", "plain \\ text"), ("assistant", "ends \\"), ("user", "[INST] x"), ("assistant", "")]
    assert chat.encode(turns[:1]) == chat.render(turns[:1])
    assert chat.encode(turns) == chat.render([turns[0], ("assistant", "ends \\\\"), ("user", "\\[INST] x"), turns[3]])
