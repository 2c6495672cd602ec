"""Chat formatting at the level of tokens: segments encoded apart, reserved ids between them, masks from prefix sums."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from labelmesh.llm.tokens import ByteBpe, once, publish, vocabulary

# A turn reads "### role: text</turn>\n". Its three marks are single ids above the vocabulary.
OPEN, BODY, CLOSE = "### ", ": ", "</turn>\n"
_IN_ROLE = re.compile(r"\\|#(?=##)|</turn>|: ")
_IN_TEXT = re.compile(r"\\|#(?=##)|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    """A backslash before every backslash and every place where a control string begins."""
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(
    turns: DataFrame, path: str | None = None, trained_role: str = "assistant", conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """Formatted conversations as one row per turn: their ids one after the other are the conversation's ids.

    Columns: conv, ``turn_index`` (0, 1, ... by ``turn``, nulls first; equal turns by their ids), ``ids``,
    ``token_start`` (ids of the conversation before this turn), ``loss_from`` and ``loss_to`` (the span, counted from
    the conversation's start, under the loss mask; empty unless the role is ``trained_role``). A conversation is never
    held whole: the starts are running sums in a window that spills. Null roles and texts count as empty strings, rows
    with a null conversation form one conversation, repeated rows are turns of their own, an empty table gives none.
    """
    vocab = publish(turns.sparkSession, path or vocabulary("byte_bpe_50k.json"))

    def encode(batches):
        bpe = once(ByteBpe, vocab.value)
        marks = [np.array([bpe.size + i], dtype="<u4") for i in range(3)]
        for batch in batches:
            ids, heads, bodies = [], [], []
            names = batch.column(2).to_pylist()
            texts = [escape(name or "", True) for name in names] + [escape(said or "") for said in batch.column(3).to_pylist()]
            found, counts = bpe.encode_all(pa.array(texts, pa.string()))
            parts = np.split(found, np.cumsum(counts)[:-1])
            for name, head, body in zip(names, parts, parts[len(names):]):
                ids.append(np.concatenate((marks[0], head, marks[1], body, marks[2])).view("<i4"))
                heads.append(len(head) + 2)
                bodies.append(len(body) if name == trained_role else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(heads, pa.int32()),
                 pa.array(bodies, pa.int32())], names=["_conv", "_turn", "ids", "_head", "_body"])

    kept = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).cast("string"), F.col(text).cast("string"))
    schema = T.StructType([kept.schema["_conv"], kept.schema["_turn"]]).add("ids", T.ArrayType(T.IntegerType())).add("_head", "integer").add("_body", "integer")
    order = Window.partitionBy("_conv").orderBy("_turn", "ids")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).cast("long")
    return (
        kept.mapInArrow(encode, schema)
        .select("_conv", F.row_number().over(order).cast("long").alias("_row"), "ids", start.alias("token_start"), "_head", "_body")
        .select(F.col("_conv").alias(conv), (F.col("_row") - 1).alias("turn_index"), "ids", "token_start",
                (F.col("token_start") + F.col("_head")).alias("loss_from"),
                (F.col("token_start") + F.col("_head") + F.col("_body")).alias("loss_to"))
    )


class _Reader:
    """Reads one conversation back, turn after turn, from ids and mask alone."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.turns = self.loss_chars = self.chars = self.tokens = 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, start: int, loss_from: int, loss_to: int) -> None:
        if start != self.tokens:
            raise ValueError(f"turn starts at token {start}, expected {self.tokens}")
        size = self.bpe.size
        marks = np.flatnonzero(ids >= size)
        if list(ids[marks] - size) != [0, 1, 2]:
            raise ValueError("marks of a turn are out of order")
        role = self.bpe.decode(ids[marks[0] + 1:marks[1]])
        text = self.bpe.decode(ids[marks[1] + 1:marks[2]])
        self.said.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        masked = unescape(self.bpe.decode(ids[loss_from - start:loss_to - start]))
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        self.chars += len(OPEN) + len(role) + len(BODY) + len(text) + len(CLOSE)
        self.turns += 1
        self.tokens += len(ids)

    def row(self, conv) -> tuple:
        return conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, path: str | None = None, conv: str = "conv_id") -> DataFrame:
    """What the formatted ids say, per conversation: turns, digests of all and of the masked text, characters.

    Turns stream in order through one running digest, so memory does not depend on a conversation's length.
    """
    vocab = publish(formatted.sparkSession, path or vocabulary("byte_bpe_50k.json"))
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = T.StructType([formatted.schema[conv]])
    for name, kind in zip(names[1:], ["long", "string", "long", "string", "long"]):
        schema = schema.add(name, kind)

    def run(batches):
        bpe = once(ByteBpe, vocab.value)
        here, reader = None, None
        for batch in batches:
            rows = []
            offsets, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            spans = [c.to_pylist() for c in (batch.column(0), *batch.columns[2:])]
            for i, (key, start, loss_from, loss_to) in enumerate(zip(*spans)):
                if reader is None or key != here:
                    if reader is not None:
                        rows.append(reader.row(here))
                    here, reader = key, _Reader(bpe)
                reader.add(values[offsets[i]:offsets[i + 1]], start, loss_from, loss_to)
            if rows:
                yield _batch(rows, batch.schema.field(0).type, names)
        if reader is not None:
            yield _batch([reader.row(here)], batch.schema.field(0).type, names)

    ordered = formatted.select(conv, "ids", "token_start", "loss_from", "loss_to").sortWithinPartitions(conv, "token_start")
    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
