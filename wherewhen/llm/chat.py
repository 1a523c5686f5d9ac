"""Chat formatting: whole conversations, encoded once, with an offset-aligned loss mask.

A conversation is rendered whole under a template whose marks are control
strings; control strings inside roles and texts are escaped so that they can be
read back. The rendered text is encoded once with offsets, and the sorted spans
of the turns to learn are laid over the sorted token spans by binary search.

Defined results: null roles and texts count as empty. Turns stand in order of
turn, role, text (nulls first), so repeated rows are turns of their own. Rows
with a null conv_id form one conversation. A conversation is one training
example: memory is that of the longest one, never of a task's share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@dataclass(frozen=True)
class Template:
    """``open role shut text close`` for each turn.

    ``control`` lists what must not appear in a role or text; the marks are among
    it. After the first character of each occurrence the escape character is put
    in, and escape characters of the text are doubled.
    """

    open: str = "[INST]"
    shut: str = "[/INST]"
    close: str = "</s>"
    control: tuple[str, ...] = ("[INST]", "[/INST]", "</s>", "<s>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    escape: str = "␛"

    def hide(self, text: str) -> str:
        if self.escape in text:
            text = text.replace(self.escape, self.escape * 2)
        # One character at a time, so that overlapping strings are all broken.
        return re.sub(f"(?=(?:{'|'.join(map(re.escape, self.control))}))(.)", rf"\1{self.escape}", text, flags=re.S)

    def show(self, text: str) -> str:
        return re.sub(f"{self.escape}({self.escape}?)", r"\1", text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the span of every turn's own text in it."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{self.open}{self.hide(role)}{self.shut}", self.hide(text)
            spans.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, self.close]
            at = spans[-1][1] + len(self.close)
        return "".join(parts), spans

    def parse(self, text: str) -> list[tuple[str, str]]:
        turns = []
        for piece in text.split(self.close)[:-1]:
            role, _, body = piece.removeprefix(self.open).partition(self.shut)
            turns.append((self.show(role), self.show(body)))
        return turns


def load_tokenizer(data: str, template: Template):
    """A tokenizer from its JSON text, with the template's marks as tokens of their own."""
    from tokenizers import Tokenizer, pre_tokenizers, processors

    tokenizer = Tokenizer.from_str(data)
    tokenizer.add_special_tokens([template.open, template.shut, template.close])
    if isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets keep leading spaces
    return tokenizer


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for each token that overlaps one of the sorted, disjoint spans.

    Starts and ends of tokens ascend, so a span covers the tokens from the first
    that ends behind its start to the last that starts before its end.
    """
    mask = np.zeros(len(offsets), bool)
    if not spans or not len(offsets):
        return mask
    edges = np.array([s for s in spans if s[1] > s[0]], np.int64).reshape(-1, 2)
    first = np.searchsorted(offsets[:, 1], edges[:, 0], side="right")
    last = np.searchsorted(offsets[:, 0], edges[:, 1], side="left")
    for a, b in zip(first, last, strict=True):
        mask[a:b] = True
    return mask


FORMATTED = "conv_id long, formatted string, tokens array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def formatted_conversations(
    conversations: DataFrame, template: Template | None = None, tokenizer: str = TOKENIZER,
    learn: tuple[str, ...] = ("assistant",), slices: int | None = None,
) -> DataFrame:
    """One row per conversation: formatted text, token ids, their spans, and the loss mask.

    Turns meet in the task of their conversation and are streamed in order. The
    tokenizer file is read on the driver and sent with a broadcast; its size is
    that of a vocabulary.
    """
    template = template or Template()
    spark = conversations.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    ordered = rows.repartition(slices or partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    schema = pa.schema([
        ("conv_id", pa.int64()), ("formatted", pa.string()), ("tokens", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = load_tokenizer(vocabulary.value, template)

        def finish(conv_id: int | None, turns: list[tuple[str, str]]) -> tuple:
            text, spans = template.render(turns)
            code = coder.encode(text, add_special_tokens=False)
            offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
            mask = token_mask(offsets, [s for s, (role, _) in zip(spans, turns, strict=True) if role in learn])
            return conv_id, text, code.ids, offsets[:, 0].astype(np.int32), offsets[:, 1].astype(np.int32), mask

        def block(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        current, turns, done, size = None, [], [], 0
        for batch in batches:
            for conv_id, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and conv_id != current:
                    done.append(finish(current, turns))
                    size, turns = size + len(done[-1][1]), []
                    if size > 1 << 22:
                        yield block(done)
                        done, size = [], 0
                current = conv_id
                turns.append((role, text))
        if turns:
            done.append(finish(current, turns))
        yield block(done)

    return ordered.mapInArrow(run, FORMATTED)


def masked_text(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The characters under the mask; tokens that share a character count it once."""
    out, reached = [], 0
    for start, end in zip(starts[mask], ends[mask], strict=True):
        start = max(start, reached)
        if end > start:
            out.append(text[start:end])
            reached = end
    return "".join(out)
