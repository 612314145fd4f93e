"""Chat formatting from event logs.

A log has a row per event: conv_id, seq, event, message, payload. ``seq`` orders
the events of a conversation, whose messages may be streamed, edited and
regenerated while others go on; ``message`` names the message that an event is
about. Logs are partitioned by conversation, sorted by sequence number, folded
into final messages (streamed deltas, edits, regenerations, retractions) and
rendered by a template that marks turns and escapes its own control strings
inside texts, so that the output parses back to the same turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .util import Scratch

#: The control strings of the template. None holds the escape character.
BOS, EOS = "<s>", "</s>"
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
ROLE_OPEN, ROLE_CLOSE = "[ROLE ", "[/ROLE]"
CONTROL = (BOS, EOS, "[INST]", "[/INST]", "[ROLE", ROLE_CLOSE)
ESCAPE = "\\"

_HIDE = re.compile("|".join([re.escape(ESCAPE), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)]))
_SHOW = re.compile(re.escape(ESCAPE) + "(.?)", re.S)


def escape(text: str) -> str:
    """Double the escape character and put one after the first character of every control string."""
    return _HIDE.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    return _SHOW.sub(lambda m: ESCAPE if m[1] == ESCAPE else m[1], text)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, loss spans): spans are code point ranges of the escaped assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == "user":
            head, tail = BOS + USER_OPEN, USER_CLOSE + EOS
        elif role == "assistant":
            head, tail = BOS, EOS
        else:
            head, tail = f"{BOS}{ROLE_OPEN}{escape(role)}{ROLE_CLOSE}", EOS
        parts += (head, body, tail)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; raises ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        end = formatted.find(EOS, at)
        if not formatted.startswith(BOS, at) or end < 0:
            raise ValueError(f"no turn at {at}")
        body = formatted[at + len(BOS) : end]
        if body.startswith(USER_OPEN):
            if not body.endswith(USER_CLOSE):
                raise ValueError(f"open user turn at {at}")
            turns.append(("user", unescape(body[len(USER_OPEN) : -len(USER_CLOSE)])))
        elif body.startswith(ROLE_OPEN):
            role, _, text = body[len(ROLE_OPEN) :].partition(ROLE_CLOSE)
            turns.append((unescape(role), unescape(text)))
        else:
            turns.append(("assistant", unescape(body)))
        at = end + len(EOS)
    return turns


# ---------------------------------------------------------------- events

#: Fixed values of the log. start: a message begins, the payload is its role; delta: append; edit: replace the whole text;
#: regenerate: throw the text away, deltas follow; retract: the message goes, until it starts again.
EVENTS = ("start", "delta", "edit", "regenerate", "retract")

#: Sequence numbers: room for so many messages in a place, and events in a message.
_PLACE, _EVENTS = 10**19, 10**9

LOG = "conv_id long, seq decimal(38,0), event string, message string, payload string"


def conversation_events(rows: DataFrame, chunk: int = 512) -> DataFrame:
    """A log (``LOG``) that ends in ``rows`` (conv_id, turn, role, text), for want of a recorded one.

    Messages start in order of turn (null last; ties by role, then text; a row
    that repeats another is a message of its own). A text arrives in deltas of
    ``chunk`` characters. Of fifteen messages, five are first streamed with a
    wrong text and regenerated, and three are streamed short and edited when
    the next turn has begun, between the events of that turn's messages.
    """
    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    r = r.withColumn("n", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text")))
    r = r.withColumn("at", F.col("turn").cast("decimal(38,0)") * F.lit(str(_PLACE)).cast("decimal(20,0)") + (F.col("n") * F.lit(_EVENTS)).cast("decimal(20,0)"))
    r = r.withColumn("kind", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(15)))
    event = lambda name, payload, late=0: F.struct(F.lit(name).alias("event"), payload.alias("payload"), F.lit(late).alias("late"))
    # split by code points
    n = F.greatest(F.lit(1), F.ceil(F.char_length("text") / F.lit(chunk))).cast("int")
    deltas = F.transform(F.sequence(F.lit(0), n - 1), lambda i: event("delta", F.substring(F.col("text"), i * chunk + 1, F.lit(chunk))))
    again = F.concat(F.array(event("delta", F.lit("</s>draft ")), event("regenerate", F.lit(""))), deltas)
    edited = F.array(event("delta", F.substring("text", 1, 7)), event("edit", F.col("text"), 1))
    log = F.concat(F.array(event("start", F.col("role"))), F.when(F.col("kind") % 5 == 0, edited).when(F.col("kind") % 3 == 0, again).otherwise(deltas))
    r = r.select("conv_id", "at", F.concat_ws(".", F.col("turn").cast("string"), F.col("n").cast("string")).alias("message"), F.posexplode(log).alias("i", "e"))
    late = F.when(F.col("e.late") == 1, F.lit(str(_PLACE))).otherwise(F.lit("0")).cast("decimal(20,0)")
    return r.select("conv_id", (F.col("at") + late + F.col("i")).cast("decimal(38,0)").alias("seq"), "e.event", "message", "e.payload")


class Message:
    """What the events of a message, in order, have left so far."""

    def __init__(self) -> None:
        self.role: str | None = None  # None: not begun, or retracted
        self.parts: list[str] = []

    def apply(self, event: str, payload: str | None) -> None:
        if event == "start":
            self.role, self.parts = payload or "", []
        elif event not in EVENTS:
            raise ValueError(f"unknown event {event}")
        elif self.role is None:
            pass  # events before a start, or after a retraction, change nothing
        elif event == "delta":
            self.parts.append(payload or "")
        elif event == "edit":
            self.parts = [payload or ""]
        elif event == "regenerate":
            self.parts = []
        else:
            self.role, self.parts = None, []


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, message and seq -> a row per message that is left; only the message being folded is held."""
    key, message, first, last, out, size = None, Message(), None, None, [], 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()), strict=True)], ["conv_id", "place", "message", "role", "text"])

    for batch in batches:
        for conv, name, seq, event, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (conv, name) != key:
                if message.role is not None:
                    out.append((key[0], first, key[1], message.role, "".join(message.parts)))
                    size += sum(map(len, message.parts))
                    if size > 4 << 20:
                        yield flush()
                        out, size = [], 0
                key, message, first, last = (conv, name), Message(), None, None
            if (seq, event, payload) == last:  # delivered twice
                continue
            last = (seq, event, payload)
            message.apply(event, payload)
            if event == "start":
                first = seq
    if message.role is not None:
        out.append((key[0], first, key[1], message.role, "".join(message.parts)))
    if out:
        yield flush()


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of a log (``LOG``): conv_id, place (seq of the last start), message, role, text.

    An event names its message and changes no other, so the log of a
    conversation is dealt out by conversation and message and each part folded
    in order of seq: one conversation with much of the log is no hot task, and
    a task holds one message at a time. Events that repeat another wholly count
    once; events of equal seq are taken in order of event and payload; null
    payloads are empty; messages that are retracted or never start leave
    nothing; null conv_id is one conversation, null message one message. An
    empty log gives no rows; other columns are ignored. Not yet computed: to be
    stored with few rows a batch.
    """
    rows = events.select(F.col("conv_id").cast("long").alias("conv_id"), "message", F.col("seq").cast("decimal(38,0)").alias("seq"), "event", "payload")
    dealt = rows.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "event", "payload")
    folded = dealt.withColumn("seq", F.col("seq").cast("string")).mapInArrow(_fold_batches, "conv_id long, place string, message string, role string, text string")
    return folded.withColumn("place", F.col("place").cast("decimal(38,0)"))


_FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"
_FORMATTED_PA = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    key: tuple | None = None
    parts: list[str] = []
    spans: list[dict] = []
    at = 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FORMATTED_PA, strict=True)], schema=_FORMATTED_PA)

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
            if key != (conv,):
                if key is not None:
                    out.append((key[0], "".join(parts), spans))
                    size += at
                key, parts, spans, at = (conv,), [], [], 0
                if size > 4 << 20:
                    yield flush()
                    out, size = [], 0
            piece, loss = render([(role, text)])
            spans += [{"start": at + a, "end": at + b} for a, b in loss]
            parts.append(piece)
            at += len(piece)
    if key is not None:
        out.append((key[0], "".join(parts), spans))
    if out:
        yield flush()


def format_conversations(events: DataFrame) -> DataFrame:
    """One row per conversation of a log (``LOG``): conv_id, formatted, loss_spans.

    Messages are in order of the seq of their start, ties by name; a
    conversation without messages has no row; odd rows as in ``fold_events``.
    The log is folded first; only final texts are then gathered by conversation
    and rendered as they stream by: one row is one training text, and it alone
    must fit a task.
    """
    with Scratch(events.sparkSession) as tmp:
        return tmp.keep(tmp.stored(_formatted(events), "formatted"))


def _formatted(events: DataFrame) -> DataFrame:
    m = fold_events(events)
    return m.repartition("conv_id").sortWithinPartitions("conv_id", "place", "message").mapInArrow(_render_batches, _FORMATTED)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            turns = parse(text)
            said, loss, n = hashlib.sha256(), hashlib.sha256(), 0
            for role, body in turns:
                said.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            for x in spans:
                body = unescape(text[x["start"] : x["end"]])
                n += len(body)
                loss.update(body.encode("utf-8", "surrogatepass"))
            rows.append((conv, len(turns), said.hexdigest(), n, loss.hexdigest(), len(text)))
        cols = list(zip(*rows, strict=True)) or [()] * len(_DIGEST)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _DIGEST, strict=True)], schema=_DIGEST)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from the formatted text alone. Not yet computed."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_digest_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    with Scratch(spark) as tmp:
        return tmp.keep(tmp.stored(read_back(_formatted(conversation_events(rows.unionByName(extra)))), "read"))


_HIDDEN = r"regexp_replace(replace(t, '\', '\\'), '(<)(s>|/s>)|(\[)(INST\]|/INST\]|ROLE|/ROLE\])', '\1\3\\\2\4', 'g')"

OP3_SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length({_HIDDEN}) as esc, length(replace(role, '\', '\\')) as role_chars from c)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn nulls last, role, t)) as turns_sha256,
  coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls last, role, t) filter (role = 'assistant'), '')) as loss_sha256,
  sum(7 + esc + case role when 'user' then 15 when 'assistant' then 0 else 13 + role_chars end)::bigint as formatted_chars
from e group by conv_id
"""
