"""Conversation structure repair by prefix-doubling path ranking.

The turns of a conversation are read by an automaton of four states (start,
after system, after user, after assistant). A node is a place between two turns
and a state; its arcs are the edits Delete, Insert, Keep and Rerole. A cost
program from the end gives every node its cheapest cost to a legal end, and the
arcs that keep to it are the optimal ones. Nodes are then ranked by the first
letters of their least audit, for audits of length 1, 2, 4, ...: the rank for
twice the length is that of the pair (own rank, rank of the node that length
further on), and pointers double in the same step. Of a node's optimal arcs the
one with the least (letter, rank of its end) is followed, and the least path is
read off the doubled pointers, all places at once.

Legal is ``(s?(ua)+)?`` in role initials. Faults of a turn, the first that holds:
blank (no character but ASCII white space), duplicate (role and text stood
earlier in the conversation), truncated (the last other character is none of
``.!?``). Blank and duplicate turns are deleted; truncated ones cost more if not.

Defined results: a null role or text is one space, an empty role has no initial
and is never legal as it stands. Turns stand in order of turn (nulls first),
then role and text; rows that repeat are turns of their own, the later one a
duplicate. Rows with a null conv_id are one conversation. Columns other than
conv_id, turn, role, text are dropped. An empty table gives no rows. The digest
of a repaired conversation is sequential, so its turns pass through one task in
order; memory is that of the longest conversation (and 100,000 turns), not of a
task's share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, partitions

START, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)  # codes 1-4 in the order of their letters; 0 ends an audit
END, DELETE, INSERT, KEEP, REROLE = range(5)
FAR = np.int64(1) << 40
# The state that a written turn leads to; a kept one only if its initial is the one wanted.
WRITTEN = np.array([USER, USER, ASSISTANT, USER])
ROLE = {USER: "user", ASSISTANT: "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


def kept_state() -> np.ndarray:
    """[state, initial as 1 s, 2 u, 3 a, 0 other] -> the state after keeping such a turn, or -1."""
    out = np.full((4, 4), -1)
    out[START, SYSTEM] = SYSTEM
    for state in range(4):
        out[state, WRITTEN[state]] = WRITTEN[state]
    return out


KEPT = kept_state()


class Paths:
    """Cheapest repairs of a block of conversations, given turn by turn.

    ``initials`` (0-3), ``must_go`` and ``truncated`` are arrays over all turns,
    ``lengths`` the turns of each conversation.
    """

    def __init__(self, lengths: np.ndarray, initials: np.ndarray, must_go: np.ndarray, truncated: np.ndarray, costs: Costs):
        self.lengths = lengths
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]  # a place before each turn and one after the last
        n = int((lengths + 1).sum())
        turns = np.ones(n, bool)
        turns[self.first + lengths] = False
        self.is_turn = turns
        spread = lambda values, rest: np.where(turns, self._laid(values, turns), rest)
        extra = costs.truncated * spread(truncated, False)
        stays = ~spread(must_go, True)
        kept = KEPT[:, spread(initials, 0)].T  # place, state -> state or -1
        # Cost and end state of the three edits that go on to the next place, and of an insertion.
        keep = np.where((kept >= 0) & stays[:, None], extra[:, None], FAR)
        rerole = np.where(stays, costs.rerole + extra, FAR)[:, None] + np.zeros((1, 4), np.int64)
        self.cost = np.full((n, 4), FAR)
        self._solve(keep, rerole, kept, costs)
        self._arcs(keep, rerole, kept, costs)

    @staticmethod
    def _laid(values: np.ndarray, turns: np.ndarray) -> np.ndarray:
        out = np.zeros(len(turns), values.dtype)
        out[turns] = values
        return out

    def _solve(self, keep: np.ndarray, rerole: np.ndarray, kept: np.ndarray, costs: Costs) -> None:
        """Costs of all nodes, place by place from the end, for all conversations that are that long."""
        order = np.argsort(-self.lengths, kind="stable")
        ends = (self.first + self.lengths)[order]
        lengths = self.lengths[order]
        for back in range(int(lengths.max(initial=0)) + 1):
            at = ends[: np.searchsorted(-lengths, -back, side="right")] - back
            if back:
                after = self.cost[at + 1]
                rows = np.arange(len(at))[:, None]
                best = np.minimum(costs.delete + after, keep[at] + after[rows, np.maximum(kept[at], 0)])
                best = np.minimum(best, rerole[at] + after[:, WRITTEN])
            else:
                best = np.full((len(at), 4), FAR)
                best[:, [START, ASSISTANT]] = 0
            for _ in range(3):  # insertions stay at a place: at most user, assistant, user in a row pay
                best = np.minimum(best, costs.insert + best[:, WRITTEN])
            self.cost[at] = best

    def _arcs(self, keep: np.ndarray, rerole: np.ndarray, kept: np.ndarray, costs: Costs) -> None:
        """Optimal arcs: end node of each node's edit, by code, or -1."""
        n = len(self.cost)
        state = np.broadcast_to(np.arange(4), (n, 4))
        place = np.arange(n)[:, None]
        after = np.minimum(place + 1, n - 1)
        ends = np.full((n, 4, 5), -1)
        for code, price, to_place, to_state in (
            (DELETE, np.where(self.is_turn, costs.delete, FAR)[:, None], after, state), (INSERT, costs.insert, place, WRITTEN[state]),
            (KEEP, keep, after, np.maximum(kept, 0)), (REROLE, rerole, after, WRITTEN[state]),
        ):
            good = price + self.cost[to_place, to_state] == self.cost
            ends[:, :, code] = np.where(good & (self.cost < FAR), 4 * to_place + to_state, -1)
        self.ends = ends.reshape(4 * n, 5)

    def least(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every step of every conversation's least path: conversation, node, edit code."""
        ends, node = self.ends, np.arange(len(self.ends))
        letter = np.where((ends >= 0).any(axis=1), (ends >= 0).argmax(axis=1), END)
        rank, step = letter, np.where(letter == END, node, ends[node, letter])
        pointers, reach = [step], np.where(letter == END, 0, 1)
        while (letter[pointers[-1]] != END).any():  # some audit is longer than what the ranks have seen
            jump = pointers[-1]
            _, rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)
            rank = rank.astype(np.int64) + 1
            rank[letter == END] = END
            # Least letter, then least rank of the audit behind it. The letters of a node's arcs differ, so a choice stands.
            behind = np.where(ends >= 0, np.arange(5) * (rank.max() + 1) + rank[np.maximum(ends, 0)], FAR)
            letter = np.where(letter == END, END, behind.argmin(axis=1))
            reach = reach + reach[jump]
            pointers.append(jump[jump])
        starts = 4 * self.first + START
        steps = reach[starts]
        talk = np.repeat(np.arange(len(starts)), steps)
        number = np.arange(len(talk)) - np.repeat(np.cumsum(steps) - steps, steps)
        at = starts[talk]
        for k, jump in enumerate(pointers):
            at = np.where(number >> k & 1, jump[at], at)
        return talk, at, letter[at]


def checked_turns(conversations: DataFrame) -> DataFrame:
    """Turns with what can be told from one row: initial, blank, unended."""
    tail = F.right(F.rtrim(F.col("text"), F.lit("\t\n\x0b\x0c\r ")), F.lit(1))
    filled = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    initial = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)).cast("int")
    return filled.select(
        "*", initial.alias("initial"), (~F.col("text").rlike(WORD)).alias("blank"), (~tail.isin(".", "!", "?")).alias("unended"),
    )


REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string, repaired array<struct<role: string, text: string>>"
)
BLOCK_TURNS = 100_000


def repaired_conversations(conversations: DataFrame, costs: Costs | None = None, texts: bool = True) -> DataFrame:
    """One row per conversation: counts of faults, cost and letters of the cheapest repair, its digest, its turns if ``texts``."""
    costs = costs or Costs()
    turns = checked_turns(conversations)
    ordered = turns.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([
        ("conv_id", pa.int64()), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired", kind),
    ])

    def faults(rows: list[tuple]) -> tuple[list[int], dict[str, int]]:
        """0 none, 1 blank, 2 duplicate, 3 truncated for each turn, and what is counted of a conversation."""
        seen, out = set(), []
        for _, _, role, text, _, blank, unended in rows:
            out.append(1 if blank else 2 if (role, text) in seen else 3 if unended else 0)
            seen.add((role, text))
        numbers = {r[1] for r in rows if r[1] is not None}
        pairs = zip(rows, rows[1:], strict=False)
        return out, {
            "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            "blank": out.count(1), "duplicate": out.count(2), "truncated": out.count(3),
            "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs),
        }

    def solve(block: list[tuple[int | None, list[tuple]]]) -> pa.RecordBatch:
        found = [faults(rows) for _, rows in block]
        lengths = np.array([len(rows) for _, rows in block], np.int64)
        flat = [r for _, rows in block for r in rows]
        fault = np.array([f for each, _ in found for f in each], np.int64)
        paths = Paths(lengths, np.array([r[4] or 0 for r in flat], np.int64), (fault == 1) | (fault == 2), fault == 3, costs)
        talk, node, code = paths.least()
        base = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        turn = (node >> 2) - paths.first[talk] + base[talk]
        audits = LETTERS[code].tobytes().decode("ascii")
        written = [[] for _ in block]
        for t, i, c, state in zip(talk.tolist(), turn.tolist(), code.tolist(), (node & 3).tolist(), strict=True):
            if c != DELETE:
                role = flat[i][2] if c == KEEP else ROLE[int(WRITTEN[state])]
                written[t].append((role, "" if c == INSERT else flat[i][3]))
        edges = np.searchsorted(talk, np.arange(len(block) + 1))
        out = []
        for k, (conv_id, _) in enumerate(block):
            digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in written[k]).encode())
            out.append({
                "conv_id": conv_id, **found[k][1], "cost": int(paths.cost[paths.first[k], START]), "audit": audits[edges[k] : edges[k + 1]],
                "repaired_sha256": digest.hexdigest(), "repaired": [{"role": r, "text": t} for r, t in written[k]] if texts else None,
            })
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, current = [], 0, object()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != current:
                    if size >= BLOCK_TURNS:
                        yield solve(block)
                        block, size = [], 0
                    current = row[0]
                    block.append((current, []))
                block[-1][1].append(row)
                size += 1
        if block:
            yield solve(block)

    return ordered.mapInArrow(run, REPAIRED)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role user. Nulls are one space.
    """
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", show("conv_id"), show("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", show("role").alias("role"), show("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    repeated = rows.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return repeated.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
    )
