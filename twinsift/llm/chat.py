"""Chat formatting by event-sourced reconstruction.

A log has events ``(conv_id, seq, kind, role, text)``. It is partitioned by
conversation and sorted by sequence; one pass over the sorted rows folds each
conversation's events into final messages and renders them:

* ``open`` starts a message with ``role`` and ``text``;
* ``delta`` appends to the last message;
* ``edit`` replaces the text of message number ``target`` (the last if null)
  and drops all later messages;
* ``regen`` empties message ``target`` (the last if null) and drops all later
  ones, and the deltas that follow fill it anew.

A task holds one conversation's final messages and one batch of events.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` for a message.
Inside roles and texts, ``%`` becomes ``%25`` and ``<|`` becomes ``%3C|``
(in roles a line end becomes ``%0A`` too), so no text can hold a control
string, and :func:`read_back` recovers every text exactly. ``loss_spans`` are
the code point ranges of the assistant texts in ``formatted``.

Defined results: a null text or role is empty; deltas, edits and regenerations
before any message, or of one that isn't there, change nothing; events of equal
sequence go by kind, role and text; repeated rows are repeated events; a null
conv_id is a conversation; an empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = f"{END}{START}assistant ok"
FORMAT_SCHEMA = "conv_id long, formatted string, loss_spans array<struct<start:int,end:int>>"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return text.replace("%", "%25").replace("<|", "%3C|")


def unescape(text: str) -> str:
    return text.replace("%3C|", "<|").replace("%25", "%")


def fold(messages: list[list[str]], kind: str, role: str, text: str, target: int | None) -> None:
    """Apply one event to the messages, each [role, text, ...] in parts."""
    if kind == "open":
        messages.append([role, text])
        return
    at = len(messages) - 1 if target is None else target
    if not 0 <= at < len(messages):
        return
    if kind == "delta":
        messages[at].append(text)
    elif kind in ("edit", "regen"):
        messages[at][1:] = [text if kind == "edit" else ""]
        del messages[at + 1 :]


def render(messages: Iterable[list[str]]) -> tuple[str, list[tuple[int, int]]]:
    out, spans, at = [], [], 0
    for role, *parts in messages:
        head, body = f"{START}{escape(role).replace('\n', '%0A')}\n", escape("".join(parts))
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    turns = []
    for part in formatted.split(f"{END}\n")[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        turns.append((unescape(role.replace("%0A", "\n")), unescape(text)))
    return turns


def format_log(events: DataFrame) -> DataFrame:
    """Fold and render a log: (conv_id, formatted, loss_spans).

    ``target`` may be missing. Other columns are ignored.
    """
    target = F.col("target").cast("int") if "target" in events.columns else F.lit(None).cast("int")
    log = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), "seq", "kind",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), target.alias("target"),
    )
    ordered = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "role", "text", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, messages, done = object(), [], []
        for b in batches:
            for conv, kind, role, text, to in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "target")), strict=True):
                if conv != current:
                    if messages:
                        done.append((current, *render(messages)))
                    current, messages = conv, []
                fold(messages, kind, role, text, to)
            if done:
                yield rendered(done)
                done = []
        if messages:
            yield rendered([(current, *render(messages))])

    def rendered(rows: list) -> pa.RecordBatch:
        ids, texts, spans = zip(*rows, strict=True)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span)], ["conv_id", "formatted", "loss_spans"])

    return ordered.mapInArrow(run, FORMAT_SCHEMA)


def conversation_events(rows: DataFrame) -> DataFrame:
    """Finished conversations as a log: every row opens a message, by turn."""
    return rows.select("conv_id", F.col("turn").alias("seq"), F.lit("open").alias("kind"), "role", "text")


def message_events(rows: DataFrame) -> DataFrame:
    """Finished conversations as the log that a chat service would have written.

    Each message opens with a draft that streams on in a delta. If its turn is
    odd, it is then regenerated and streamed again in two deltas; else its first
    half is streamed and an edit sets the final text. So folding the log gives
    the rows by turn, and those of equal turn by role and text.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    at = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).alias("place"))
    half = F.floor(F.length("text") / 2).cast("int")
    left, right = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    none = F.lit(None).cast("string")
    event = lambda step, kind, said: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), said.alias("text"))
    draft = [event(0, "open", F.lit("draft")), event(1, "delta", F.lit(", not final"))]
    again = F.array(*draft, event(2, "regen", none), event(3, "delta", left), event(4, "delta", right))
    edited = F.array(*draft, event(2, "delta", left), event(3, "edit", F.col("text")))
    each = at.select("conv_id", "turn", "place", "role", F.explode(F.when(F.col("turn") % 2 == 1, again).otherwise(edited)).alias("e"))
    return each.select("conv_id", F.struct("turn", "place", "e.step").alias("seq"), "e.kind", "role", "e.text")


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says, read back from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                turns = read_back(text)
                loss = [unescape(text[s["start"] : s["end"]]) for s in spans]
                sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
                rows.append((conv, len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, loss)), sha(loss), len(text)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = zip(*rows, strict=True) if rows else [[]] * len(types)
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return formatted.mapInArrow(run, DIGEST_SCHEMA)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], rows.schema)
    return digests(format_log(message_events(rows.unionByName(extra))))
