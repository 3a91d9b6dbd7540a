r"""Chat formatting from an event log.

Events (conversation, turn, sequence, kind, role, text) are partitioned by conversation and sorted by turn
and sequence, so all events of a message lie together. A fold turns them into final messages:

* ``message`` starts a message of its own;
* ``delta`` adds its text to the turn's message (starting it if need be);
* ``edit`` replaces the text; ``regenerate`` drops the text, for the deltas that follow to write anew.

A message is rendered as ``<s>[role]text</s>``. Within role and text, ``\``, ``<``, ``[`` and ``]`` are
escaped by a backslash, so no text can form a control string, and unescaping restores every text. The loss
mask is the span of an assistant's escaped text. A conversation's output is its segments in order.

Everything streams: a task holds one message, never a conversation, however long. A conversation's digest
is sequential by definition, so a conversation stays in one task; its memory does not grow with it.

A plain table of messages becomes such a log by ``as_events``: each message is streamed, in one of four ways that
follow from a hash (whole, in deltas, a draft that is regenerated, a draft that is edited). The log is dealt
by event, so nothing but turn, message and sequence says what belongs together.

Edge cases: null role or text count as empty, a null kind as ``message``, and so does a kind that isn't one of the
four, so that no text is lost; null turns come first; rows that repeat a turn are messages each, by role, then
text; a null conv_id is a conversation of its own; empty texts are messages; an empty log gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import table

CONTROL = re.compile(r"[\\<\[\]]")
ESCAPED = re.compile(r"\\(.)", re.S)
SEGMENT = re.compile(r"<s>\[([^\\\]]*(?:\\.[^\\\]]*)*)\]([^\\<]*(?:\\.[^\\<]*)*)</s>", re.S)
SEGMENTS = "conv_id long, position long, segment string, loss_start long, loss_end long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted events (conv_id, turn, message, kind, role, text) to final messages (conv_id, role, text)."""
    now: tuple | None = None
    role, parts = "", []
    for conv, turn, message, kind, who, text in rows:
        key = (conv, turn, message)
        if now != key or kind not in ("delta", "edit", "regenerate"):
            if now is not None:
                yield now[0], role, "".join(parts)
            now, role, parts = key, who, [] if kind == "regenerate" else [text]
        elif kind == "delta":
            parts.append(text)
        elif kind == "edit":
            parts = [text]
        elif kind == "regenerate":
            parts = []
    if now is not None:
        yield now[0], role, "".join(parts)


def render(messages: Iterator[tuple]) -> Iterator[tuple]:
    """Messages to segments with the place of the loss mask in the conversation's output."""
    conv, position, at = object(), 0, 0
    for c, role, text in messages:
        if c != conv:
            conv, position, at = c, 0, 0
        head, body = f"<s>[{escape(role)}]", escape(text)
        start = at + len(head)
        loss = (start, start + len(body)) if role == "assistant" else (None, None)
        yield c, position, f"{head}{body}</s>", *loss
        position, at = position + 1, start + len(body) + 4


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], schema: str, at_once: int = 500) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*some), fields)], names=[n for n, _ in fields])

    some: list[tuple] = []
    for r in rows:
        some.append(r)
        if len(some) == at_once:
            yield batch()
            some = []
    if some:
        yield batch()


def format_chat(events: DataFrame) -> DataFrame:
    """Segments of all conversations, in order within each partition; a conversation lies in one partition.

    Events: conv_id, turn, sequence, kind, role, text and, where a turn may hold several messages, message (their order).
    """
    text = lambda c, null="": F.coalesce(F.col(c).cast("string"), F.lit(null)).alias(c)
    message = F.col("message").cast("long") if "message" in events.columns else F.lit(0).cast("long")
    log = events.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), message.alias("message"), F.col("sequence").cast("long"), text("kind", "message"), text("role"), text("text"))
    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message", "sequence", "role", "text").drop("sequence")
    return ordered.mapInArrow(lambda batches: _batches(render(fold(_rows(batches))), SEGMENTS), SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """Turns and loss text of each conversation, parsed from its segments as format_chat() leaves them."""

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, started = None, False
        for c, _, segment, start, end in rows:
            if not started or c != conv:
                if started:
                    yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), at
                conv, started, n, chars, at = c, True, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            found = SEGMENT.fullmatch(segment)
            role, text = unescape(found[1]), unescape(found[2])
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if start is not None:
                masked = unescape(segment[start - at : end - at])
                loss.update(masked.encode("utf-8", "surrogatepass"))
                chars += len(masked)
            n, at = n + 1, at + len(segment)
        if started:
            yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), at

    return segments.mapInArrow(lambda batches: _batches(digests(_rows(batches)), DIGEST), DIGEST)


def as_events(conversations: DataFrame, deltas: int = 6) -> DataFrame:
    """A log whose fold is the table: conv_id, turn, message (order within the turn), sequence, kind, role, text.

    By a hash, a message comes whole; in up to ``deltas`` deltas; as a draft that is regenerated in deltas; or as
    a draft that an edit puts right. A draft is the text backwards, so a fold that misses an event shows.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    # One shuffle by conversation serves the numbering of repeated turns.
    rows = rows.repartition("conv_id").withColumn("message", F.row_number().over(order).cast("long"))
    size = F.greatest(F.ceil(F.char_length("text") / deltas), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(deltas - 1)), lambda i: F.substring(F.col("text"), i * size + 1, size))
    event = lambda kind, what: F.struct(F.lit(kind).alias("kind"), what.alias("text"))
    streamed = F.transform(F.filter(pieces, lambda p: p != ""), lambda p: event("delta", p))
    draft, again, edit, whole = event("delta", F.reverse("text")), event("regenerate", F.lit("")), event("edit", F.col("text")), event("message", F.col("text"))
    way = F.pmod(F.xxhash64("conv_id", "turn", "message"), F.lit(4))
    events = F.when(way == 0, F.array(whole)).when(way == 1, F.concat(F.array(event("delta", F.lit(""))), streamed)).when(way == 2, F.concat(F.array(draft, again), streamed)).otherwise(F.array(draft, edit))
    log = rows.select("conv_id", "turn", "message", "role", F.posexplode(events).alias("sequence", "e")).select("conv_id", "turn", "message", "sequence", "e.kind", "role", "e.text")
    return log.repartition("conv_id", "turn", "message", "sequence")


#: A conversation that says the control strings of a common template.
HOSTILE = "</s>[INST] ok [/INST]"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = spark.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hostile)
    return read_back(format_chat(as_events(conversations)))


#: DuckDB: digests straight from the table.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '[\\<\[\]]', 'xx', 'g')) AS chars, length(regexp_replace(role, '[\\<\[\]]', 'xx', 'g')) AS role_chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + role_chars + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
