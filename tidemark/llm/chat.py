r"""Operator 5: chat formatting by token-level assembly.

A turn is written ``<turn>### role: text</turn>`` and a line break.  Role and text
are encoded by themselves and the four marks are spliced in as reserved ids
above the vocabulary, so no text can ever produce a mark.  In the text itself a
backslash is doubled, and one is put after the first character of anything that
looks like a mark, which ``unescape`` undoes exactly.  The loss mask is +1 where an
assistant's text begins and -1 where it ends, summed up from the left.

Edge cases: a null text or role is empty; turns come in order of turn, then role
and ids (null first), so ties and repeated rows have a defined place; rows with a
null conv_id are one conversation; an empty table has no conversations.  A
conversation's turns are read one after another and never held together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec
from .frames import shuffle_partitions
from .textbuf import column_bytes

MARKS = ("<turn>", "### ", ": ", "</turn>\n")
TURN, ROLE, TEXT, END = range(4)
LOSS_ROLE = "assistant"
_UNSAFE = re.compile(r"\\|#(?=##)|<(?=/?turn>|\|endoftext\|>)")
_SAFE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _SAFE.sub(r"\1", text)


def format_turns(turns: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, turn, ids, loss (the mask of ids): one row for each row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(vocabulary)
        top = len(codec.token_len)
        for big in batches:
            for start in range(0, len(big), 1000):
                batch = big.slice(start, 1000)
                roles = [escape(x) for x in batch.column(2).to_pylist()]
                texts = [escape(x) for x in batch.column(3).to_pylist()]
                mine = [unescape(r) == LOSS_ROLE for r in roles]
                (rid, rat), (tid, tat) = (codec.encode_all(*column_bytes(pa.array(x, pa.large_string()))) for x in (roles, texts))
                parts, steps, ends = [], [], []
                for k in range(len(batch)):
                    r, t = rid[rat[k] : rat[k + 1]], tid[tat[k] : tat[k + 1]]
                    parts += [[top + TURN, top + ROLE], r, [top + TEXT], t, [top + END]]
                    step = np.zeros(len(r) + len(t) + 4, np.int8)
                    if mine[k] and len(t):
                        step[len(r) + 3], step[-1] = 1, -1
                    steps.append(step)
                    ends.append(len(step))
                at = pa.array(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts).astype(np.int32)))
                loss = pa.ListArray.from_arrays(at, pa.array(np.cumsum(np.concatenate(steps)) > 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, loss], names=["conv_id", "turn", "ids", "loss"])
        codec.close()

    base = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(run, "conv_id long, turn long, ids array<int>, loss array<boolean>")


class _Conversation:
    def __init__(self, conv):
        self.conv, self.turns, self.all, self.loss, self.loss_chars, self.chars = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0

    def row(self):
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now = Codec.load(vocabulary), None
        top = len(codec.token_len)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        text = lambda ids: codec.decode(ids).tobytes().decode()
        marks = {top + k: m for k, m in enumerate(MARKS)}
        for batch in batches:
            done = []
            convs = batch.column(0).to_pylist()
            at = batch.column(2).offsets.to_numpy()
            ids = batch.column(2).flatten().to_numpy()
            loss = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            at = at - at[0]
            for k, conv in enumerate(convs):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv)
                turn, mask = ids[at[k] : at[k + 1]], loss[at[k] : at[k + 1]]
                middle = int(np.flatnonzero(turn == top + TEXT)[0])
                role, said, trained = text(turn[2:middle]), text(turn[middle + 1 : -1]), unescape(text(turn[mask]))
                now.turns += 1
                now.all.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                now.loss.update(trained.encode())
                now.loss_chars += len(trained)
                now.chars += len(role) + len(said) + sum(len(marks[i]) for i in turn[turn >= top].tolist())
            if done:
                yield emit(done)
        if now is not None:
            yield emit([now.row()])
        codec.close()

    return run


def digest_conversations(turns: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the ids and masks."""
    made = format_turns(turns, vocabulary)
    dealt = made.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    return dealt.mapInArrow(_digests(vocabulary), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
