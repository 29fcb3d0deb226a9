"""Chat formatting on the level of tokens.

Role and text of a turn are encoded on their own; ids beyond the tokenizer's vocabulary are spliced around
them as marks, so no content can produce a mark. As text, a turn is ``### role ###``, a line feed, the text,
``</turn>`` and a line feed. Contents are escaped before they are encoded: a backslash is doubled, ``###`` and
``</turn>`` get a backslash in front, and dropping each backslash with the character behind it kept undoes
that. A turn's loss mask is the running sum of +1 where the learned text begins and -1 behind it, and its
place in the conversation is the running sum of the lengths of the turns before.

Turns are rows, so a conversation of any length is never gathered: encoding takes rows as they lie, one
shuffle by conversation orders the encoded turns, and whatever needs a conversation in order streams them.

Defined results: a null text or role is an empty one; a null turn comes first; turns with equal numbers are
ordered by a hash of role and text; rows that repeat are turns of their own; rows of null conversation ids
form one conversation. Further columns are not formatted; clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deflow.llm import common
from deflow.llm.tokens import byte_table, encoder

TURN, BODY, END = "### ", " ###\n", "</turn>\n"     # the marks as text; their ids follow the vocabulary in this order
LEARNED = "assistant"
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def assemble(role: np.ndarray, text: np.ndarray, marks: tuple[int, int, int], learned: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of a turn."""
    ids = np.concatenate([[marks[0]], role, [marks[1]], text, [marks[2]]]).astype(np.int32)
    step = np.zeros(len(ids) + 1, np.int8)
    if learned and len(text):
        step[len(role) + 2] += 1
        step[len(role) + 2 + len(text)] -= 1
    return ids, np.cumsum(step[:-1], dtype=np.int8)


def format_turns(turns: DataFrame, tokenizer_path: str, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, start (place of the turn's first token in its conversation), input_ids, loss_mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, True)
        marks = (enc.size, enc.size + 1, enc.size + 2)
        for b in common.batches_of(batches, 512):
            roles, texts = ([x or "" for x in b.column(i).to_pylist()] for i in (3, 4))
            parts = [[np.frombuffer(x, enc.dtype) for x in enc.encode([escape(t) for t in column])] for column in (roles, texts)]
            made = [assemble(r, t, marks, name == LEARNED) for r, t, name in zip(*parts, roles)]
            yield common.carry(b, ["c", "turn", "tie"], input_ids=pa.array([m[0] for m in made], pa.list_(pa.int32())),
                               loss_mask=pa.array([m[1] for m in made], pa.list_(pa.int8())))

    rows = turns.select(turns[conversation].cast("long").alias("c"), turns[turn].cast("long").alias("turn"),
                        F.xxhash64(turns[role], turns[text]).alias("tie"), turns[role].alias("role"), turns[text].alias("text"))
    made = common.on_workers(rows).mapInArrow(run, "c long, turn long, tie long, input_ids array<int>, loss_mask array<byte>")
    before = Window.partitionBy("c").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.size("input_ids")
    return made.select(F.col("c").alias("conv_id"), "turn", (F.sum(size).over(before) - size).alias("start"), "input_ids", "loss_mask")


class Reader:
    """Turns encoded ids back into role, text and learned text."""

    def __init__(self, tokenizer_path: str):
        enc = encoder(tokenizer_path, True)
        self.table, self.size = byte_table(enc.tokenizer), enc.size

    def text(self, ids: np.ndarray) -> str:
        return b"".join(self.table[i] for i in ids.tolist()).decode("utf-8")

    def turn(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """Role, text, text under the mask, code points as formatted."""
        at = np.flatnonzero(ids >= self.size)
        if len(at) != 3 or not np.array_equal(ids[at], self.size + np.arange(3)):
            raise ValueError("a turn without its three marks")
        role, text = self.text(ids[1:at[1]]), self.text(ids[at[1] + 1:at[2]])
        learned = self.text(ids[mask.astype(bool)])
        return unescape(role), unescape(text), unescape(learned), len(role) + len(text) + len(TURN) + len(BODY) + len(END)


def summaries(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """What formatted turns hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest is sequential by nature, so a conversation's turns pass one task in order; it keeps the digests' states only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, key, state = Reader(tokenizer_path), None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def row(key, s):
            return key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

        for b in batches:
            done = []
            for c, ids, mask in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if state is None or c != key:
                    if state is not None:
                        done.append(row(key, state))
                    key, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, learned, chars = reader.turn(ids.values.to_numpy(), mask.values.to_numpy())
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += chars
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(key, state), types)], names=names)

    rows = formatted.select("conv_id", "start", "input_ids", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return common.on_workers(rows).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
