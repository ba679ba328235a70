"""Chat formatting that survives a round trip through its own parser.

render() writes a conversation with control strings around each turn; parse() is
a deterministic parser of that grammar. encode() renders, reparses, compares, and
escapes text until the recovered turns are identical to the source.

Grammar: ``<s>`` (turn)* ``</s>``, turn = ``[ROLE]`` role ``[TEXT]`` text ``[END]``.
A backslash before a control string (or a backslash run that ends at one) makes it
ordinary text. Only text that holds a control string changes.

Null text or role is empty. Turns are ordered by turn, null first, then by role
and text, so repeated rows stay and ties have one order. An empty conversation has
no rows and so no output. A null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

START, ROLE, TEXT, END, STOP = "<s>", "[ROLE]", "[TEXT]", "[END]", "</s>"
#: Strings that mark turns here or in common templates; none of them passes unescaped.
CONTROLS = (START, STOP, ROLE, TEXT, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
#: Backslashes count only where a control string follows them.
_ESCAPED = re.compile(r"(\\+)(" + _CONTROL.pattern + ")")
_RUN = re.compile(r"(\\*)(" + _CONTROL.pattern + ")")
_TAIL = re.compile(r"\\+\Z")


def escape(text: str) -> str:
    """Each control string behind one more than twice the backslashes before it; a final run doubled."""
    text = _TAIL.sub(lambda m: m[0] * 2, text)
    return _RUN.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    """The inverse of escape()."""
    text = _ESCAPED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)
    return _TAIL.sub(lambda m: m[0][: len(m[0]) // 2], text)


def render(turns: Iterable[tuple[str, str]]) -> str:
    """Turns whose parts are already safe, as one text."""
    return START + "".join(f"{ROLE}{role}{TEXT}{text}{END}" for role, text in turns) + STOP


def parse(text: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """(role, text) of each turn, unescaped, and the span of its text; ValueError if the text isn't of the grammar."""
    marks = [m for m in _RUN.finditer(text) if len(m[1]) % 2 == 0]
    want, turns, spans = [START], [], []
    begin = role = 0
    for i, m in enumerate(marks):
        if m[2] not in want:
            raise ValueError(f"{m[2]} where {' or '.join(want)} belongs")
        here = m.start(2)
        if m[2] in (START, END):
            if m[2] == END:
                turns.append((unescape(text[role[0] : role[1]]), unescape(text[begin:here])))
                spans.append((begin, here))
            elif here:
                raise ValueError("text before the start")
            want = [ROLE, STOP]
            begin = m.end()
        elif m[2] == ROLE or m[2] == STOP:
            if here != begin:
                raise ValueError("text between turns")
            if m[2] == STOP:
                if i + 1 < len(marks) or m.end() != len(text):
                    raise ValueError("text after the end")
                return turns, spans
            want, begin = [TEXT], m.end()
        else:
            role, want, begin = (begin, here), [END], m.end()
    raise ValueError("no end")


def _recovered(text: str) -> list[tuple[str, str]] | None:
    """The turns that parse() finds; None if the text isn't of the grammar."""
    try:
        return parse(text)[0]
    except ValueError:
        return None


def encode(turns: list[tuple[str, str]]) -> str:
    """The rendered conversation, its conflicting turns escaped until parse() gives the same turns back."""
    safe, plain = list(turns), set(range(len(turns)))
    while _recovered(text := render(safe)) != turns:
        # turns that don't come back by themselves or, if all do, those that are as they were
        conflicts = [i for i in plain if _recovered(render([turns[i]])) != [turns[i]]] or list(plain)
        if not conflicts:
            raise ValueError("the round trip does not hold")
        for i in conflicts:
            safe[i] = (escape(turns[i][0]), escape(turns[i][1]))
        plain.difference_update(conflicts)
    return text


def loss_spans(text: str, role: str = "assistant") -> list[tuple[int, int]]:
    """Spans of a formatted text that a model is trained on: the texts of one role."""
    turns, spans = parse(text)
    return [s for (r, _), s in zip(turns, spans) if r == role]


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans of each conversation.

    Turns of one conversation are gathered in one row: a conversation is a row of
    the result, so its length is bounded by what a row may hold.
    """
    rows = common.pick(conversations, conv_id="long", turn="long", role="string", text="string")
    rows = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [encode([(t["role"], t["text"]) for t in turns]) for turns in part.column(1).to_pylist()]
                spans = [[{"start": a, "end": b} for a, b in loss_spans(t)] for t in texts]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "loss_spans"])

    return grouped.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts say: their turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns, _ = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                for column, v in zip(out, (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                    column.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return common.pick(conversations, conv_id="long", turn="long", role="string", text="string").unionByName(probe)
