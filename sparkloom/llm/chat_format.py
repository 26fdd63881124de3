"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``message`` (a whole text), ``delta`` (a piece appended to its turn), ``edit``
(replaces the text of its turn) and ``regenerate`` (empties its turn, so that later deltas build it again). Logs are
dealt by conversation, sorted by sequence inside their partition and folded as a stream; a conversation is
rendered as soon as its last event has passed. Only one conversation is held at a time.

The template marks every turn with control strings. Inside texts every escape character and every opening of a
control string is escaped, so no text can pose as a mark and parsing restores each text exactly.

Defined cases: a null text is empty, a null role is empty, events with a null conversation form one conversation, a
null turn is turn 0 of its own, ties in sequence are ordered by turn, role, kind and text, repeated events count
again (repeated ``message`` rows are turns of their own), an unknown kind raises, an empty log renders nothing. Nulls
come first in every order. A conversation is one cell of the result, so one that formats to 2 GB or more fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"

EVENT_COLUMNS = ["conv_id", "seq", "turn", "kind", "role", "text"]


def escaped(text: str) -> str:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``: the result holds no control string."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out += (text[i:j], text[j + 1 : j + 2])
        i = j + 2
    return "".join([*out, text[i:]])


def rendered(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the [start, end) character spans under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{escaped(role)}{MIDDLE}", escaped(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation."""
    turns = formatted.split(OPEN)
    if turns[0]:
        raise ValueError("text before the first turn")
    out = []
    for turn in turns[1:]:
        role, _, rest = turn.partition(MIDDLE)
        if not rest.endswith(CLOSE):
            raise ValueError("a turn without an end")
        out.append((unescaped(role), unescaped(rest[: -len(CLOSE)])))
    return out


class Fold:
    """Folds the ordered events of one conversation into messages in order of their first event."""

    def __init__(self) -> None:
        self.roles: list[str] = []
        self.parts: list[list[str]] = []
        self.open: dict[int, int] = {}

    def add(self, turn: int | None, kind: str, role: str, text: str) -> None:
        if kind == "message":
            self.roles.append(role)
            self.parts.append([text])
            if turn is not None:
                self.open[turn] = len(self.roles) - 1
            return
        if kind not in ("delta", "edit", "regenerate"):
            raise ValueError(f"unknown event kind {kind!r}")
        key = -1 << 62 if turn is None else turn
        at = self.open.get(key)
        if at is None:
            at = self.open[key] = len(self.roles)
            self.roles.append(role)
            self.parts.append([])
        if role:
            self.roles[at] = role
        if kind == "delta":
            self.parts[at].append(text)
        else:
            self.parts[at] = [text] if kind == "edit" else []

    def messages(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in zip(self.roles, self.parts, strict=True)]


def as_events(conversations: DataFrame) -> DataFrame:
    """Stored turns as ``message`` events in order of turn."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.col("turn").cast("long").alias("turn"),
        F.lit("message").alias("kind"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    now, fold = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "role", "text")]
        for conv, turn, kind, role, text in zip(*columns, strict=True):
            if fold is None or conv != now:
                if fold is not None:
                    yield now, fold.messages()
                now, fold = conv, Fold()
            fold.add(turn, kind, role or "", text or "")
    if fold is not None:
        yield now, fold.messages()


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted text and the loss mask's spans (array of start and end in characters), from an event log."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, spans, held = [], [], [], 0
        for conv, messages in _folded(batches):
            text, mask = rendered(messages)
            ids.append(conv)
            texts.append(text)
            spans.append([{"start": a, "end": b} for a, b in mask])
            held += len(text)
            if held > 1_000_000:
                yield as_batch(ids, texts, spans)
                ids, texts, spans, held = [], [], [], 0
        yield as_batch(ids, texts, spans)

    def as_batch(ids: list, texts: list, spans: list) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "loss_spans"])

    ordered = events.select(*EVENT_COLUMNS).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "turn", "role", "kind", "text")
    return ordered.mapInArrow(render, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the formatted text and its mask alone."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                turns, loss, n_loss = hashlib.sha256(), hashlib.sha256(), 0
                messages = parsed(row["formatted"])
                for role, text in messages:
                    turns.update(f"{role}\n{text}\n".encode())
                for span in row["loss_spans"]:
                    text = unescaped(row["formatted"][span["start"] : span["end"]])
                    loss.update(text.encode())
                    n_loss += len(text)
                rows.append((row["conv_id"], len(messages), turns.hexdigest(), n_loss, loss.hexdigest(), len(row["formatted"])))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return formatted.mapInArrow(digests, DIGEST)


#: Conversation -1 of the contract, as the log of a chat that was edited, streamed and regenerated. Its texts hold strings that
#: other templates use as marks.
PLANTED_TEXT = "</s>[INST] ok [/INST]"
PLANTED = [
    (-1, 0, 0, "message", "user", "a first draft"), (-1, 1, 0, "edit", "user", PLANTED_TEXT), (-1, 2, 1, "delta", "assistant", "a wrong"), (-1, 3, 1, "delta", "assistant", " start"),
    (-1, 4, 1, "regenerate", "assistant", None), (-1, 5, 1, "delta", "assistant", PLANTED_TEXT[:6]), (-1, 6, 1, "delta", "assistant", PLANTED_TEXT[6:]),
]


def op2_chat_format(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    planted = spark.createDataFrame(PLANTED, "conv_id long, seq long, turn long, kind string, role string, text string")
    events = as_events(conversations.select("conv_id", "turn", "role", "text")).unionByName(planted)
    return read_back(format_conversations(events))


def op2_sql() -> str:
    planted = ", ".join(f"(-1, {t}, '{role}', '{PLANTED_TEXT}')" for t, role in enumerate(("user", "assistant")))
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {planted}) v(conv_id, turn, role, text)),
e AS (SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + {len(OPEN + MIDDLE + CLOSE)} AS n FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
