"""Substring deduplication against a plain pass over all windows in order."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wherewhen.llm import queries, relative_lz

SCHEMA = "doc_id long, text string, found string, id string, tag long"


def words_of(text):
    return (text or "").encode().split()


def plain(rows, size=20):
    """Per document in order of id: words, and which of them stand in a window seen earlier."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def make_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    new = lambda n: rng.choices(words, k=n)
    passages = [new(n) for n in (20, 21, 19, 25, 60, 300, 30)]
    line = new(12)  # an anchor that crowds without a window of its own
    rows = []
    for i in range(400):
        text = new(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            passage = list(rng.choice(passages))
            if rng.random() < 0.4:
                passage[rng.randrange(len(passage))] = "changed"
            if rng.random() < 0.3:
                a = rng.randrange(len(passage))
                passage = passage[a:]
            text += passage + new(rng.randint(0, 8))
        if i % 2:
            text += line + new(25)
        rows.append((i * 3 - 100, " \n".join(text)))
    rows += [(5000 + i, rows[7][1]) for i in range(60)]
    rows += [(7000, "a " * 5000), (7001, "a b " * 40), (7002, "a " * 19), (7003, ""), (7004, None), (7005, "Ä é 漢字 x " * 30)]
    rows += [(7006, " ".join(new(30) * 3)), (None, rows[9][1])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.mark.parametrize(("batch_words", "crowd"), [(2_000_000, 16), (500, 16), (500, 2), (50_000, 2), (1, 1 << 40)])
def test_parsing_matches_a_pass_over_all_windows(spark, rows, batch_words, crowd):
    docs = spark.createDataFrame([(*r, "f", "i", 3) for r in rows], SCHEMA).repartition(5)
    found = relative_lz.parsed_documents(docs, relative_lz.Parsing(batch_words=batch_words, crowd=crowd)).collect()
    assert Counter(tuple(r)[:4] for r in found) == Counter(plain(rows))
    texts = {r[0]: words_of(r[1]) for r in rows}
    for row in found:
        assert hashlib.sha256(row["kept"].encode()).hexdigest() == row["kept_sha256"]
        covered = set()
        for f in row["factors"]:
            own, source = texts[row["doc_id"]], texts[f["source_id"]]
            assert f["n_words"] >= 20
            assert own[f["start"] : f["start"] + f["n_words"]] == source[f["source_start"] : f["source_start"] + f["n_words"]]
            where = lambda d, at: (d is not None, d or 0, at)
            assert where(f["source_id"], f["source_start"]) < where(row["doc_id"], f["start"])
            covered |= set(range(f["start"], f["start"] + f["n_words"]))
        assert len(covered) == row["n_removed"]


def test_repeated_rows_are_one_document(spark, rows):
    some = rows[:100]
    docs = spark.createDataFrame([*some, *some[:30], (some[0][0], "another text of the same id")], "doc_id long, text string")
    want = plain(some)
    twice = {r[0] for r in some[:30]}
    want = Counter(want + [w for w in want if w[0] in twice] + plain([(some[0][0], "another text of the same id")]))
    assert Counter(map(tuple, relative_lz.parsed_documents(docs, texts=False).drop("kept", "factors").collect())) == want


def test_empty_table(spark):
    assert relative_lz.parsed_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_windows_choose_equal_blocks():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    twice = np.concatenate([codes[50:300], codes])
    anchor, block, start, count = relative_lz.document_blocks(twice, np.array([250, 400]), relative_lz.Parsing())
    assert count.sum() == 231 + 381
    where = {int(b): int(s) for b, s in zip(block, start, strict=True)}
    inner = [(int(s), where[int(b)]) for b, s in zip(block, start, strict=True) if s < 250]
    assert sum(late == early + 300 for early, late in inner) >= len(inner) - 2


def test_query(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.substring_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows))
