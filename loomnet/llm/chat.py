"""Chat formatting: conversations rebuilt from their event logs, then rendered.

Logs are partitioned by conversation and sorted by sequence; one pass over each sorted
partition folds streamed deltas, edits and regenerations into final messages, holding no
more than the conversation at hand.

Events have a kind: ``message`` opens a message; ``delta`` appends to the message whose
sequence is ``target``, or to the last one if that has the event's role, or opens one;
``edit`` replaces the text of its target, or of the last message of its role;
``regenerate`` drops its target, or the last message of its role, with all that follows,
and opens a new message. A table without ``kind`` holds messages only.

Defined results. Events without a conversation or sequence are left out. A null kind is a
message, a null role is ``unknown``, a null text is empty; an unknown kind counts as a
message, and a target that isn't there falls back as if none were given. Rows that repeat in
all six fields count once; different events of one sequence are taken in order of kind
(message, regenerate, delta, edit, others), role, target and text. Control marks in texts and roles
are broken up, and line ends in roles become spaces, so that neither can end a message or open one. Extra columns are ignored. A conversation with no
events has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "conv_id long, n_messages int, text string"


def _render(role: str, text: str) -> str:
    role = role.replace("<|", "< |").replace("\r", " ").replace("\n", " ")
    return f"<|im_start|>{role}\n{text.replace('<|', '< |')}<|im_end|>\n"


def _find(messages: list, target, role: str) -> int:
    """Index of the message that an event is about, or -1."""
    if target is not None:
        for i in range(len(messages) - 1, -1, -1):
            if messages[i][0] == target:
                return i
    for i in range(len(messages) - 1, -1, -1):
        if messages[i][1] == role:
            return i
    return -1


def fold(messages: list, kind: str, seq: int, target, role: str, text: str) -> None:
    """Applies one event to the list of [sequence, role, parts of the text]."""
    if kind == "delta":
        i = _find(messages, target, role) if target is not None else (len(messages) - 1 if messages and messages[-1][1] == role else -1)
        if i >= 0:
            messages[i][2].append(text)
            return
    elif kind == "edit":
        i = _find(messages, target, role)
        if i >= 0:
            messages[i][2] = [text]
            return
    elif kind == "regenerate":
        i = _find(messages, target, role)
        if i >= 0:
            del messages[i:]
    messages.append([seq, role, [text]])


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, last, messages, done, size = None, None, [], [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.string())], names=["conv_id", "n_messages", "text"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != conv:
                if messages:
                    done.append((conv, len(messages), "".join(_render(r, "".join(t)) for _, r, t in messages)))
                    size += len(done[-1][2])
                    if size > 8 << 20:
                        yield flush()
                        done, size = [], 0
                conv, last, messages = row[0], None, []
            if row == last:
                continue
            last = row
            _, seq, _, kind, role, target, text = row
            fold(messages, kind, seq, target, role, text)
    if messages:
        done.append((conv, len(messages), "".join(_render(r, "".join(t)) for _, r, t in messages)))
    if done:
        yield flush()


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, n_messages, text): one rendered conversation a row. Needs conv_id, turn, role and text; kind and target are optional."""
    have = {c.lower() for c in events.columns}
    kind = F.coalesce(F.col("kind").cast("string"), F.lit("message")) if "kind" in have else F.lit("message")
    target = F.col("target").cast("long") if "target" in have else F.lit(None).cast("long")
    rows = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), kind.alias("kind"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), target.alias("target"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).filter("conv_id is not null and seq is not null")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("message", "regenerate", "delta", "edit"))), F.col("kind")), F.lit(0))
    rows = rows.select("conv_id", "seq", F.when(rank == 0, 9).otherwise(rank).alias("rank"), "kind", "role", "target", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "rank", "kind", "role", "target", "text").mapInArrow(_fold_sorted, OUT)


def streamed(conversations: DataFrame) -> DataFrame:
    """An event log whose final state is the table of messages (conv_id, turn, role, text): each message is opened with a draft that an edit or a regeneration replaces, or streamed as deltas."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv_id is not null and turn is not null").distinct()
    at, half = F.col("turn") * 10, (F.length("text") / 2).cast("int")
    event = lambda k, kind, text, target=None: F.struct((at + k).alias("turn"), F.lit(kind).alias("kind"), (F.lit(None).cast("long") if target is None else target).alias("target"), F.col("role"), text.alias("text"))
    first, second = F.left("text", half), F.substr("text", half + 1, F.length("text"))
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    logs = (
        F.when(way == 0, F.array(event(0, "message", first), event(1, "delta", second, at)))
        .when(way == 1, F.array(event(0, "message", F.lit("a draft")), event(1, "edit", F.col("text"), at)))
        .otherwise(F.array(event(0, "message", F.lit("a draft")), event(1, "regenerate", first, at), event(2, "delta", second, at + 1)))
    )
    return rows.select("conv_id", F.explode(logs).alias("e")).select("conv_id", "e.*")


SQL = """
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages,
       string_agg('<|im_start|>' || replace(replace(replace(role, '<|', '< |'), chr(13), ' '), chr(10), ' ') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
      WHERE conv_id IS NOT NULL AND turn IS NOT NULL) GROUP BY conv_id
"""

#: streamed() takes repeated rows once, and messages keep their order by turn.
EVENTS_SQL = SQL
