"""Cross-tokenizer alignment against a plain count of all links."""

import base64
import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wherewhen.llm import pair_bitmaps, queries

SCHEMA = "doc_id long, text string, place int, segment string, a string"


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(pair_bitmaps.BYTE_TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=pair_bitmaps.PIECE_TOKENIZER)


@pytest.fixture(scope="module")
def raw():
    """Bytes of the ids of the first tokenizer, from the rank file."""
    with open(pair_bitmaps.BYTE_TOKENIZER.replace(".json", ".tiktoken"), "rb") as file:
        return {int(n): base64.b64decode(t) for t, n in map(bytes.split, file)}


def plain(rows, coders, raw):
    a, b = coders
    out, count, tops = [], Counter(), defaultdict(int)
    for doc_id, text in rows:
        groups, whole = [], bool(text)
        if text:
            left = [(i, raw[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
            pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
            right = [(i, bytes([int(p[1:-1], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()) for i, p in pieces]
            whole = all(b"".join(x for _, x in side) == (" " + text).encode() for side in (left, right))
            if whole:
                here = [[], []]
                at = [0, 0]
                queues = [list(left), list(right)]
                while queues[0] or queues[1]:
                    side = 0 if at[0] <= at[1] and queues[0] else 1
                    i, data = queues[side].pop(0)
                    here[side].append(i)
                    at[side] += len(data)
                    if at[0] == at[1]:
                        groups.append(here)
                        here = [[], []]
        links = [(g[0][-1], g[1][-1]) for g in groups]
        count.update(links)
        shown = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        sizes = [sum(len(g[s]) for g in groups) for s in (0, 1)]
        out.append([doc_id, *sizes, len(groups), links, hashlib.sha256(shown.encode()).hexdigest() if groups else ""])
    for (_, right), n in count.items():
        tops[right] = max(tops[right], n)
    return Counter(
        (d, na, nb, ng, len(links), sum(count[p] == tops[p[1]] for p in links), sum(count[p] for p in links), h) for d, na, nb, ng, links, h in out
    )


def make_rows():
    rng = random.Random(4)
    words = ["the", "über", "nation", "élan", "it's", "漢字", "x1", "12345", "🙂", "tion", "re-do", "\n\n", "  ", "\t", "ﬁne", "Ǆ", "<s>", "</s>", "<|endoftext|>", "<unk>", "<0x41>"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "▁ a real one"), (204, "the " * 5000), (205, "x" * 20_000), (206, "\0\x1c\x85\xa0"), (207, "á")]
    rows += [(3, rows[3][1]), (3, "another text"), (None, "no id"), (None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.mark.parametrize(("links", "documents"), [(4_000_000, 1 << 16), (300, 1 << 16), (50, 7)])
def test_alignment_matches_a_plain_count(spark, rows, coders, raw, links, documents):
    docs = spark.createDataFrame([(*r, 1, "s", "a") for r in rows], SCHEMA).repartition(3)
    got = pair_bitmaps.aligned_documents(docs, index=pair_bitmaps.Index(links, documents))
    assert Counter(map(tuple, got.collect())) == plain(rows, coders, raw)


def test_empty_table(spark):
    assert pair_bitmaps.aligned_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_dense_bitmaps():
    rng = np.random.default_rng(2)
    many, few = np.sort(rng.choice(1 << 16, 9000, replace=False)), np.array([0, 5, 65535])
    found = pair_bitmaps.containers(np.repeat([0, 1], [len(many), len(few)]), np.concatenate([many, few])).to_pylist()
    assert [len(f) for f in found] == [8192, 6]
    assert [pair_bitmaps.popcount(f) for f in found] == [9000, 3]
    assert pair_bitmaps.listed(found[0]).tolist() == many.tolist() and pair_bitmaps.listed(found[1]).tolist() == few.tolist()
    both = set(many.tolist()) | set(few.tolist())
    assert set(pair_bitmaps.listed(pair_bitmaps.merged(found)).tolist()) == both and pair_bitmaps.popcount(pair_bitmaps.merged(found)) == len(both)
    thin = [np.arange(k, 1 << 16, 20).astype("<u2").tobytes() for k in (0, 1)]
    assert len(pair_bitmaps.merged(thin)) == 8192


def test_ranks_give_the_ids_of_the_file(coders):
    """Texts of letters below U+0300, where ids come from ranks."""
    with open(pair_bitmaps.BYTE_TOKENIZER, encoding="utf-8") as file:
        side = pair_bitmaps.byte_side(file.read())
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x300)]
    texts = ["".join(rng.choices(letters, k=50)) for _ in range(3000)]
    texts += ["".join(rng.choice([" ", "\n", "'", "s", "é", "1", "½", ".", "\xa0", "\x85", "\x1f", "ll"]) for _ in range(30)) for _ in range(3000)]
    texts += [" " + a + b for a in letters for b in " s'\n"]
    for text in texts:
        assert side.encode(text).tolist() == coders[0].encode(text, add_special_tokens=False).ids


def test_bytes_of_ids(raw):
    with open(pair_bitmaps.BYTE_TOKENIZER, encoding="utf-8") as file:
        data = file.read()
    tokens = pair_bitmaps.byte_side(data).tokens
    assert {i: t for i, t in enumerate(tokens) if i in raw} == raw and len(tokens) == len(json.loads(data)["model"]["vocab"]) + 1


def test_query(spark, tmp_path, rows, coders, raw):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert Counter(map(tuple, queries.tokenizer_alignment(spark, str(tmp_path)).collect())) == plain(rows, coders, raw)


@pytest.mark.parametrize("n", [pair_bitmaps.DENSE - 1, pair_bitmaps.DENSE, pair_bitmaps.DENSE + 1])
def test_pairs_of_as_many_documents_as_bits_have_numbers(spark, coders, raw, n):
    """Where sorted numbers and bits have the same length, in one task's bitmaps and in merged ones."""
    docs = np.arange(n) * 3
    one = pair_bitmaps.containers(np.zeros(n, int), docs).to_pylist()[0]
    halves = [docs[::2].astype("<u2").tobytes(), docs[1::2].astype("<u2").tobytes()]
    for bitmap in (one, pair_bitmaps.merged(halves)):
        assert pair_bitmaps.listed(bitmap).tolist() == docs.tolist() and pair_bitmaps.popcount(bitmap) == n
    rows = [(i, "nation nation") for i in range(n)] + [(n + i, "a nation") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for index in (pair_bitmaps.Index(), pair_bitmaps.Index(3000)):
        assert Counter(map(tuple, pair_bitmaps.aligned_documents(frame, index=index).collect())) == plain(rows, coders, raw)


def test_long_runs_of_blanks(coders):
    with open(pair_bitmaps.BYTE_TOKENIZER, encoding="utf-8") as file:
        side = pair_bitmaps.byte_side(file.read())
    for text in (" " * 1_100_000 + "a", "a" + " \n" * 550_000):
        assert side.encode(text).tolist() == coders[0].encode(text, add_special_tokens=False).ids


def test_ids_of_postings(spark, coders):
    rows = [(0, "Nation hjelmsätt zebra"), (1, "cryptoc 98765 ampoule")]
    _, postings = pair_bitmaps.encoded(
        spark.createDataFrame(rows, "doc_id long, text string"), pair_bitmaps.BYTE_TOKENIZER, pair_bitmaps.PIECE_TOKENIZER, pair_bitmaps.Index()
    )
    used = [{i for _, t in rows for i in coders[0].encode(" " + t, add_special_tokens=False).ids}, {i for _, t in rows for i in coders[1].encode(t)}]
    assert max(used[0]) >= 1 << 15
    for r in postings.collect():
        assert r.a in used[0] and r.b in used[1]
