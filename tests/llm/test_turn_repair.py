"""Conversation repair against a search over all edits, and against plain restatements."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from wherewhen.llm import queries, turn_repair

ROW = "conv_id long, turn long, role string, text string, audit string, kind int"
SPACE = " \t\n\x0b\x0c\r"


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def legal_start(initials):
    """Whether some legal sequence begins so."""
    return re.fullmatch(r"s?(ua)*u?", initials) is not None


def plain_repair(rows):
    """Cheapest (cost, audit, repaired rows): a best-first search over edits, with no knowledge of states."""
    faults = plain_faults(rows)
    done, counter = set(), itertools.count()
    heap = [(0, "", 0, "", next(counter), ())]
    while heap:
        cost, audit, i, initials, _, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            return cost, audit, out
        key = (i, "e" if not initials else initials[-1], audit)
        if key in done:
            continue
        done.add(key)

        def go(price, letter, n, role, text):
            after = initials + role[:1] if role is not None else initials
            if legal_start(after) and cost + price <= 4 * len(rows) and (role is None or role[:1]):
                more = (*out, (role, text)) if role is not None else out
                heapq.heappush(heap, (cost + price, audit + letter, n, after, next(counter), more))

        for role in ("user", "assistant"):
            go(3, "I", i, role, "")
        if i < len(rows):
            _, role, text = rows[i]
            go(4, "D", i + 1, None, None)
            if faults[i] in ("", "truncated"):
                extra = 3 * (faults[i] == "truncated")
                go(extra, "K", i + 1, role, text)
                for other in ("user", "assistant"):
                    go(3 + extra, "R", i + 1, other, text)
    raise AssertionError


def plain_row(rows):
    """What the operator returns for the turns of one conversation, in order."""
    faults = plain_faults(rows)
    cost, audit, out = plain_repair(rows)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def grouped(rows):
    talks = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        talks[conv_id].append((turn, " " if role is None else role, " " if text is None else text))
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in talks.items()}


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "USER", "a", "user", "assistant", "user", "assistant"]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Really?  \n", "more. then", "é", "Yes.", "x" * 50_000 + "."]
    rows = []
    for conv_id in range(300):
        for turn in range(rng.randint(1, 5)):
            rows.append((conv_id, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(roles), rng.choice(texts), "clash", 1))
    rows += [(None, 1, "user", "Nobody's.", None, None), (None, None, None, None, None, None)]
    return rows


def test_repairs_match_a_search_over_edits(spark, talks):
    found = turn_repair.repaired_conversations(spark.createDataFrame(talks, ROW)).collect()
    want = {k: plain_row(v) for k, v in grouped(talks).items()}
    assert {r["conv_id"]: tuple(r)[1:9] for r in found} == want
    for row in found:
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in row["repaired"]).encode()).hexdigest() == row["repaired_sha256"]
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r["role"][:1] for r in row["repaired"]))


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"Turn {i}.", None, None) for i in range(3000)]
    row = turn_repair.repaired_conversations(spark.createDataFrame(rows, ROW)).first()
    assert re.fullmatch("(ua)+", "".join(r["role"][0] for r in row["repaired"]))
    # assistant, user, user: an assistant turn put in between costs 3, as a changed role does.
    assert row["cost"] == 3 * 1000 + 3 and len(row["audit"]) >= 3000


def test_empty_table(spark):
    assert turn_repair.repaired_conversations(spark.createDataFrame([], ROW)).collect() == []


def test_query_keeps_every_conversation(spark, talks, tmp_path):
    lost = next(i for i in itertools.count(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [*talks, (lost, 0, "user", "Gone.", None, None)]
    spark.createDataFrame(rows, ROW).write.parquet(str(tmp_path / "conversations.parquet"))
    after = []
    for conv_id, turn, role, text, *_ in rows:
        shown = [" " if v is None else v for v in (conv_id, turn)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(conv_id, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows}
    want |= {k: plain_row(v) for k, v in grouped(after).items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.turn_repairs(spark, str(tmp_path)).collect()} == want
