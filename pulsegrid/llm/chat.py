"""Conversations as one text each, by a compiled template, with the spans a model is to learn.

Turns are dealt out by (conversation, slice), a slice being the turns of ``width`` consecutive numbers; counts of the slices, drawn up before without any text, tell every turn its place and its
conversation's length, so loops know their first and last turn however many tasks share a conversation. Texts are shuffled once. A task renders its turns one after the other and
gives a piece for every run of a slice's turns, of about ``piece`` characters at most unless one turn is longer; pieces in order of ``first_turn`` are the conversation's text, and a
piece's mask counts its characters.

Control strings inside texts are escaped reversibly (a backslash more between ``<`` and ``|``), so a text cannot close its turn, and reading back gives it unchanged.

Defined results: a null role or text is an empty one; turns of one number stand by role, then by text; a null number comes first; a null conversation is a conversation; repeated rows are
turns of their own. An empty table gives an empty one. Other columns are not carried along. Rows that share conversation and slice are sorted by one task,
on its disk where they are many, and streamed over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .templates import Sink, Template, unescape_control, unescape_line

CHATML = """
{%- for message in messages -%}
{{ '<|im_start|>' ~ (message.role | escape_line) ~ '\\n' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.content | escape_control }}{% endgeneration %}
{%- else -%}
{{ message.content | escape_control }}
{%- endif -%}
{{ '<|im_end|>\\n' }}
{%- endfor -%}
{%- if add_generation_prompt -%}{{ '<|im_start|>assistant\\n' }}{%- endif -%}
"""
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n([^<]*(?:<(?!\|im_end\|>\n)[^<]*)*)<\|im_end\|>\n")
PIECES = "first_turn bigint, n_turns bigint, length bigint, formatted string, mask array<struct<start:bigint,end:bigint>>"


def formatted(df: DataFrame, template: str = CHATML, constants: Mapping[str, object] | None = None, *, conv: str = "conv_id", turn: str = "turn",
              role: str = "role", text: str = "text", width: int = 1024, piece: int = 1 << 20) -> DataFrame:
    """``conv_id, first_turn, n_turns, length`` (turns of the whole conversation)``, formatted, mask`` of every piece."""
    given = {"add_generation_prompt": False, **(constants or {})}
    Template(template, given)  # refused here, not in a task
    lowest = F.lit(-(2 ** 63)).cast("bigint")
    rows = df.select(F.struct(F.col(conv).alias("c")).alias("key"), F.coalesce(F.floor(F.col(turn) / width), lowest).alias("slice"), F.col(turn).alias("turn"),
                     F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    counts = rows.groupBy("key", "slice").agg(F.count("*").alias("m"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("key", "slice", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("key")).alias("length"))
    # The window keeps a (conversation, slice) in one task, in order.
    order = Window.partitionBy("key", "slice").orderBy("turn", "role", "text")
    placed = rows.join(places, ["key", "slice"]).select(
        F.col("key.c").alias("conv"), "slice", (F.col("before") + F.row_number().over(order) - 1).alias("at"), "length", "role", "text")
    kind = placed.schema["conv"].dataType.simpleString()
    names = ["conv", "first_turn", "n_turns", "length", "formatted", "mask"]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, given)
        sink, scope, run, done, size = Sink(), {}, None, [], 0

        def flush() -> None:
            nonlocal sink, size
            if run is not None and run[3] > run[2]:
                done.append((run[0], run[2], run[3] - run[2], run[4], "".join(sink.parts), [{"start": a, "end": b} for a, b in sink.spans]))
                size += sink.length
            sink = Sink()

        def out(schema: pa.Schema) -> pa.RecordBatch:
            nonlocal done, size
            made = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(
                (schema.field("conv").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))], names=names)
            done, size = [], 0
            return made

        schema = None
        for batch in batches:
            schema = batch.schema
            for c, s, at, length, r, t in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                if run is None or (c, s) != (run[0], run[1]) or sink.length >= piece:
                    flush()
                    run = [c, s, at, at, length]
                    scope = compiled.start(sink if at == 0 else None)
                compiled.turn(scope, sink, r, t, at, length)
                run[3] = at + 1
                if at == length - 1:
                    compiled.tail(scope, sink)
                if size >= piece or len(done) >= 1024:
                    yield out(schema)
        flush()
        if done:
            yield out(schema)

    return placed.mapInArrow(render, f"conv {kind}, {PIECES}").withColumnRenamed("conv", "conv_id")


def read_back(pieces: DataFrame) -> DataFrame:
    """``conv_id, first_turn, n_turns, length, turns, learned, n_chars``: of every piece of ``CHATML`` the turns it holds, unescaped and each as role, line end, text, line end; the
    unescaped text under its mask; its characters. A piece that is not wholly made of turns stops the job."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, learned, n = [], [], []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist()):
                at, parts = 0, []
                for m in _TURN.finditer(text):
                    if m.start() != at:
                        break
                    at = m.end()
                    parts.append(f"{unescape_line(m[1])}\n{unescape_control(m[2])}\n")
                if at != len(text):
                    raise ValueError(f"no turn at character {at}")
                turns.append("".join(parts))
                n.append(len(parts))
                learned.append("".join(unescape_control(text[s["start"]:s["end"]]) for s in mask))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("first_turn"), pa.array(n, pa.int64()), batch.column("length"), pa.array(turns, pa.string()),
                                              pa.array(learned, pa.string()), pa.array([len(t) for t in batch.column("formatted").to_pylist()], pa.int64())],
                                             names=["conv_id", "first_turn", "n_turns", "length", "turns", "learned", "n_chars"])

    kind = pieces.schema["conv_id"].dataType.simpleString()
    return pieces.mapInArrow(read, f"conv_id {kind}, first_turn bigint, n_turns bigint, length bigint, turns string, learned string, n_chars bigint")


def digests(read: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of every conversation. Conversations of one piece are hashed where they are; only the pieces of
    longer ones travel with their texts, to be hashed one after the other."""
    whole = F.col("n_turns") == F.col("length")
    rows = read.select("conv_id", "first_turn", "n_turns", "n_chars", F.length("learned").cast("bigint").alias("n_learned"), whole.alias("whole"),
                       F.when(whole, F.sha2(F.col("turns").cast("binary"), 256)).otherwise(F.col("turns")).alias("turns"),
                       F.when(whole, F.sha2(F.col("learned").cast("binary"), 256)).otherwise(F.col("learned")).alias("learned"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        conv, state = None, None

        def row(conv, s) -> tuple:
            return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

        for batch in batches:
            done = []
            columns = [batch.column(k).to_pylist() for k in ("conv_id", "n_turns", "n_chars", "n_learned", "whole", "turns", "learned")]
            for c, n, chars, learned, all_here, t, l in zip(*columns):
                if state is not None and (all_here or c != conv):
                    done.append(row(conv, state))
                    state = None
                if all_here:
                    done.append((c, n, t, learned, l, chars))
                    continue
                if state is None:
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(t.encode())
                state[2] += learned
                state[3].update(l.encode())
                state[4] += chars
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(
                    (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(conv, state), (
                batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)

    kind = read.schema["conv_id"].dataType.simpleString()
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn").mapInArrow(
        add, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
