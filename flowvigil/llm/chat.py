"""Chat formatting by event-sourced reconstruction.

A log of events is dealt by conversation and message, sorted by sequence and folded: a message
event starts a text, deltas add to it, an edit replaces it, a regeneration empties it. The final
messages are rendered, one segment a message, so that a conversation's output is the segments
in order of turns and no task ever holds a whole conversation.

Template: ``<s>[INST] role`` newline ``text [/INST]</s>`` newline. A control string inside a role
or text gets a mark behind its first character, and backslashes are doubled, so the output can be read back.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template's family.
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "</s>", "<s>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\([\\.n])")
OPEN, CLOSE = "<s>[INST] ", " [/INST]</s>\n"
_SEGMENT = re.compile(r"<s>\[INST\] ([^\n]*)\n(.*?) \[/INST\]</s>\n", re.S)

EVENTS = "conv_id long, message long, turn long, seq long, kind string, role string, text string"
SEGMENTS = "conv_id long, turn long, message long, formatted string, loss_start int, loss_end int"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\." + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", ".": "", "n": "\n"}[m[1]], text)


def render(role: str, text: str, learn: bool) -> tuple[str, int | None, int | None]:
    """The segment of a message, and where the text to learn stands in it (code points)."""
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return head + body + CLOSE, *((len(head), len(head) + len(body)) if learn else (None, None))


def read_back(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    m = _SEGMENT.fullmatch(segment)
    return unescape(m[1]), unescape(m[2])


DRAFT = "A draft that does not stay."


def events_of(conversations: DataFrame) -> DataFrame:
    """A log, as a chat server would have kept it, that ends in the given table of turns; a row is a message of its own.

    By the length of its text modulo 3 a message is streamed in three deltas, or drafted and then edited and
    continued, or drafted, regenerated and streamed in two deltas. A null text is a draft that is edited to null. Null ids,
    turns and roles stay as they are, repeated rows are messages each, whole texts of any length are cut into at most three
    events, other columns are not looked at, and an empty table gives an empty log.
    """
    n = F.length("text")
    cut = lambda a, b: F.substring("text", F.floor(n * a / 6).cast("int") + 1, (F.floor(n * b / 6) - F.floor(n * a / 6)).cast("int"))

    def log(*events):
        return F.array(*(F.struct(F.lit(i).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
                         for i, (kind, text) in enumerate(events)))
    draft, none = F.lit(DRAFT), F.lit(None).cast("string")
    streamed = log(("message", none), ("delta", cut(0, 2)), ("delta", cut(2, 4)), ("delta", cut(4, 6)))
    edited = log(("message", draft), ("edit", cut(0, 3)), ("delta", cut(3, 6)))
    again = log(("message", draft), ("regenerate", none), ("delta", cut(0, 3)), ("delta", cut(3, 6)))
    events = F.when(n.isNull(), log(("message", draft), ("edit", none))).when(n % 3 == 0, streamed).when(n % 3 == 1, edited).otherwise(again)
    named = conversations.select("conv_id", F.monotonically_increasing_id().alias("message"), "turn", "role", events.alias("log"))
    return named.select("conv_id", "message", "turn", "role", F.explode("log").alias("e")).select("conv_id", "message", "turn", "e.seq", "e.kind", "role", "e.text")


def fold_and_render(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """Segments of the final messages: conv_id, turn, message, formatted, and the loss mask's start and end.

    A message's turn is the smallest of its events and its role the first that is not null. Null
    roles and texts are empty; events with a null or unknown kind count as deltas; equal sequence
    numbers are told apart by kind and text; null ids and turns are values like others. Only
    messages of the role ``learn`` have a mask. An empty log gives no segments, a message of any length one.
    """
    columns = ["conv_id", "message", "turn", "seq", "kind", "role", "text"]

    def run(batches):
        now, parts, turn, role = None, [], None, None

        def done():
            segment = render(role or "", "".join(parts), role == learn)
            return (now[0], turn, now[1], *segment)
        for batch in batches:
            out = []
            for conv, message, at, _, kind, who, text in zip(*(batch[c].to_pylist() for c in columns)):
                if now != (conv, message):
                    if now is not None:
                        out.append(done())
                    now, parts, turn, role = (conv, message), [], at, None
                if kind in ("message", "edit", "regenerate"):
                    parts = []
                if kind != "regenerate":
                    parts.append(text or "")
                role = who if role is None else role
                turn = at if turn is None or (at is not None and at < turn) else turn
            yield _segments(out)
        if now is not None:
            yield _segments([done()])
    dealt = events.select(*columns).repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "text")
    return dealt.mapInArrow(run, SEGMENTS)


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
    names = [x.strip().split(" ")[0] for x in SEGMENTS.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names)


def digests(segments: DataFrame) -> DataFrame:
    """What the segments of each conversation say, read back from them in order of turns.

    Null turns come first; segments of one turn are ordered by their formatted text, so repeated rows and ties have
    one result. A null conv_id is a conversation of its own; no segments give no rows.
    Streams through each conversation: a task holds one batch of segments and running digests.
    """
    import hashlib

    def run(batches):
        now, state = None, None

        def row():
            turns, learnt, n, chars, size = state
            return (now, n, turns.hexdigest(), chars, learnt.hexdigest(), size)
        for batch in batches:
            out = []
            for conv, text, start, end in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                role, said = read_back(text)
                state[0].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    loss = unescape(text[start:end])
                    state[1].update(loss.encode())
                    state[3] += len(loss)
                state[2] += 1
                state[4] += len(text)
            yield _digest_rows(out)
        if state is not None:
            yield _digest_rows([row()])
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(run, DIGESTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.strip().split(" ") for x in DIGESTS.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows) if rows else [()] * 6, fields)],
                                      [n for n, _ in fields])
