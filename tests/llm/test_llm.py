"""The training-data operators against brute force, and their defined results in odd cases."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from wherewhen.llm import block_names, buckets, chat, circulant, common, katz, mixing, order_minhash, quality, url_rules, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size int, batch string"


def make_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(20, 60))) for _ in range(25)]
    near = []
    for text in base[:10]:
        for _ in range(4):
            parts = text.split()
            parts[rng.randrange(len(parts))] = "changed"
            near.append(" ".join(parts))
    odd = ["", None, "  \n\t", "one two", "ONE two", "one two", "x" * 300_000, "Ä é 漢字 ␛ \x0b mixed", base[0], base[0].upper(), base[0]]
    return base + near + odd


@pytest.fixture(scope="module")
def docs(spark):
    texts = make_texts()
    rows = [(i, t, "en", ["a", "b", None, "a", "a"][i % 5], len(t or ""), "s", 1, "b") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "nobody's own words stand here", "en", None, 1, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 > 0, 0) for i in range(50)] + [(None, True, 0), (3, None, 0)], "doc_id long, quality boolean, toxic int").selectExpr(
        "doc_id", "int(quality) AS quality", "toxic")


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_duplicates_match_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i]["doc_id"])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    want = Counter((rows[i]["doc_id"], len(sets[i]), least[find(i)], rows[i]["doc_id"] == least[find(i)]) for i in range(len(rows)))
    assert Counter(map(tuple, circulant.near_duplicates(docs).collect())) == want


def test_circulant_signature_estimates_similarity():
    method = circulant.CirculantMinHash()
    rng = np.random.default_rng(1)
    common_part = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    a = np.sort(np.concatenate([common_part, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    b = np.sort(np.concatenate([common_part, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    assert abs((method.signature(a) == method.signature(b)).mean() - 0.75) < 0.16


def test_exact_groups_match_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    texts = [common_lower(r["text"]) for r in rows]
    size = Counter(texts)
    keep = {}
    for r, t in zip(rows, texts):
        if t not in keep or (r["doc_id"] is not None and (keep[t] is None or r["doc_id"] > keep[t])):
            keep[t] = r["doc_id"]
    got = block_names.exact_groups(docs, block_bytes=7).collect()
    assert Counter((r[0], r[1], r[2], r[4]) for r in got) == Counter(
        (r["doc_id"], keep[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, texts))
    assert sum(r["kept"] for r in got) == len(size)
    assert block_names.distinct_documents(docs).count() == len(size)


def common_lower(text):
    return (text or "").encode().lower().decode()


@pytest.mark.parametrize("order, batch_bytes", [(1, 500), (2, 500), (3, 500), (3, 8 << 20), (4, 2000)])
def test_katz_matches_brute_force_and_sums_to_one(docs, order, batch_bytes):
    rows = docs.select("doc_id", "text").collect()
    tokens = [(r["text"] or "").encode().lower().split() + [b"\n"] for r in rows]
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    grams = [Counter() for _ in range(order)]  # by length less one; None stands before a text
    for t, out in zip(tokens, held):
        padded = [None] * (order - 1) + t
        for k in range(order):
            if not out:
                grams[k].update(tuple(padded[i - k : i + 1]) for i in range(order - 1, len(padded)))
    n = sum(grams[0].values())
    context = [Counter() for _ in range(order)]
    for k in range(order):
        for g, c in grams[k].items():
            context[k][g[:-1]] += c

    def discount(counter):
        classes = Counter(counter.values())
        return katz.discounts(np.array([0] + [classes.get(i, 0) for i in range(1, 7)]))

    d = [discount(g) for g in grams]

    def seen(g):
        k, c = len(g) - 1, grams[len(g) - 1][g]
        return (d[k][c] if c <= 5 else 1) * c / (context[k][g[:-1]] + 1)

    left, low = [defaultdict(lambda: 1.0) for _ in range(order)], [defaultdict(lambda: 1.0) for _ in range(order)]
    for k in range(order):
        for g in grams[k]:
            left[k][g[:-1]] -= seen(g)
            if k:
                low[k][g[:-1]] -= seen(g[1:])

    def probability(g):
        k = len(g) - 1
        if g in grams[k]:
            return seen(g)
        if not k:
            return left[0][()]
        return probability(g[1:]) * (left[k][g[:-1]] / low[k][g[:-1]] if g[:-1] in context[k] else 1)

    pool = [h for h in context[-1]][:6] + [(b"never", b"w1", b"w7")[-(order - 1) :] if order > 1 else ()]
    for h in pool:
        assert math.isclose(sum(probability((*h, *w)) for w in [*grams[0], (b"no such word",)]), 1, rel_tol=1e-9)
    want = []
    for t in tokens:
        padded = [None] * (order - 1) + t
        want.append((len(t), round(sum(math.log10(probability(tuple(padded[i - order + 1 : i + 1]))) for i in range(order - 1, len(padded))), 6)))
    got = sorted((r["n_tokens"], round(r["score"], 6)) for r in katz.katz_scores(docs, order=order, batch_bytes=batch_bytes).collect())
    want.sort()
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])


def test_katz_names_all_words_of_a_batch_at_once():
    text = b" a  ab\tb\nabcdefgh abcdefghi\x0b" + b"x" * 64 + b" " + b"x" * 65 + b"\x0c" + b"x" * 200 + b"\r\0 a\0 a \xc3\xa9\xc2\xa0\x85\x1c ab " + b"x" * 65
    for data in (text, text + b"\n", b"", b"\n", b" \t "):
        starts, names = katz.word_names(data + bytes(8))
        words = data.split()
        assert [data[s:].split(None, 1)[0] for s in starts.tolist()] == words and len(names) == len(words)
        assert len(set(names.tolist())) == len(set(words)) == len(set(zip(words, names.tolist())))
    words = [bytes([65 + i % 26]) * (i % 150 + 1) + str(i).encode() for i in range(3000)]
    assert len(set(katz.word_names(b" ".join([*words, bytes(8)]))[1].tolist())) == len(set(words))


def test_katz_order_of_values_is_that_of_a_stable_sort():
    rng = np.random.default_rng(5)
    few, wide = rng.integers(0, 50, 1000), rng.integers(0, 1 << 63, 1000)
    alike = rng.integers(0, 3, 1000) * (1 << 61) + rng.integers(0, 4, 1000)  # differ in leading and in last bits only
    for values in (few, wide, alike, alike.view(np.uint64) + np.uint64(1 << 63), few[:1], few[:0], np.full(7, 2**63 - 1)):
        order, by_value = katz.ranked(values)
        assert order.tolist() == np.argsort(values, kind="stable").tolist() and by_value.tolist() == np.sort(values).tolist()
        one, number = katz.distinct_of(values)
        assert (values[one][number] == values).all() and values[one].tolist() == sorted(set(values.tolist()))


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 60), 8))
        counts = [rng.randint(1, 20) for _ in lengths]

        def padding(edges):
            return sum(c * min(e - x for e in edges if e >= x) for x, c in zip(lengths, counts))

        best = min(padding([*some, lengths[-1]]) for some in itertools.combinations(lengths[:-1], 2))
        assert padding(buckets.optimal_boundaries(np.array(lengths), np.array(counts), 3)) == best


def test_batches_keep_the_budget(docs):
    rows = buckets.packed_buckets(docs, buckets=4, token_budget=200, columns=["doc_id"], slice_rows=5).collect()
    assert len(rows) == docs.count()
    batches = Counter((r["bucket"], r["batch"], r["padded_length"]) for r in rows)
    assert all(n * padded <= 200 or n == 1 for (_, _, padded), n in batches.items())
    for bucket in {b for b, _, _ in batches}:
        sizes = [n for (b, _, _), n in sorted(batches.items()) if b == bucket]
        assert len(set(sizes[:-1])) <= 1  # only the last batch may be short


def test_mix_reaches_targets(spark, docs):
    plan = mixing.mixing_plan(docs, columns=["doc_id"]).collect()
    assert len(plan) == docs.count()
    assert all(r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) and r["copies"] <= 3 for r in plan)
    total = sum({(r["source_size"], r["target"]) for r in plan} and [t for _, t in {(r["source_size"], r["target"]) for r in plan}])
    assert math.isclose(total, sum({r["source_size"] for r in plan}))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    many = spark.createDataFrame([(i, "a b c", "x" if i % 3 else "y") for i in range(3000)], "doc_id long, text string, source string")
    for r in mixing.mixing_plan(many).groupBy("source").agg({"target": "max", "copies": "sum"}).collect():
        assert abs(3 * r["sum(copies)"] - r["max(target)"]) < 0.08 * r["max(target)"]


def test_order_fingerprints(docs):
    rows = order_minhash.edited_fingerprints(docs, slices=3).collect()
    assert len(rows) == docs.count()
    source = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id IS NOT NULL").collect()}
    prints = defaultdict(set)
    for r in rows:
        if r["doc_id"] is not None:
            prints[source[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    got = {r["doc_id"]: r for r in rows}
    text, after = source[10], source[11]
    edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
    assert got[10]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[10]["n_chars"] == len(text)
    sketch = order_minhash.OrderSketch()
    draws = sketch.permutations()
    words = [f"word{i}" for i in range(200)]
    moved = order_minhash.likeness(*(sketch.fingerprint(" ".join(w), draws) for w in (words, words[100:] + words[:100])))
    changed = order_minhash.likeness(*(sketch.fingerprint(" ".join(w), draws) for w in (words, [*words[:-3], "a", "b", "c"])))
    assert moved < 0.75 < changed  # the order counts


def test_url_rules(spark):
    hosts = spark.createDataFrame([("com/", "allow"), ("ads.com/x", "block")], "rule string, verdict string")
    patterns = spark.createDataFrame([("/track/*.gif^", "block"), ("*evil*", "block"), ("/track/ok.gif", "allow")], "rule string, verdict string")
    urls = ["http://a.ADS.com/xyz?q", "http://ads.com", "http://b.org/track/a.gif", "http://b.org/track/a.gifs", "http://b.org/devil",
            "http://b.org/track/ok.gif", None, "", "no host", "http://b.org/track/a.gif"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["_rule"], r["verdict"]) for r in url_rules.judged_urls(pages, hosts, patterns).collect()}
    assert got[0] == ("a.ads.com", "/xyz", "ads.com/x", "block") and got[1] == ("ads.com", "", None, "allow")
    assert [got[i][3] for i in range(2, 10)] == ["block", "allow", "block", "allow", "allow", "allow", "allow", "block"]
    assert got[6] == ("", "", None, "allow")


def test_archives_round_trip(spark):
    long = "y" * 200_000
    rows = [(1, "http://a", "same"), (2, "http://b\r\nX: 1", "same"), (3, None, None), (4, "u", ""), (5, "é", long), (None, "n", "same"), (2, "http://b", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archived(pages).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == Counter({(1, "revisit", 2, 4): 1, (2, "response", None, 4): 2, (3, "revisit", 4, 0): 1, (4, "response", None, 0): 1,
                             (5, "response", None, 200_000): 1, (None, "revisit", 2, 4): 1})
    assert {r["payload"] for r in got if r["page_id"] == 5} == {long}
    assert warc.archived(pages.limit(0)).count() == 0


def test_template_is_reversible(spark):
    template = chat.Template()
    rng = random.Random(2)
    pieces = [*template.control, template.escape, "<", "[", "INST]", "x", "\n", "é", "[[INST]"]
    for _ in range(300):
        turns = [("".join(rng.choices(pieces, k=3)), "".join(rng.choices(pieces, k=8))) for _ in range(3)]
        text, spans = template.render(turns)
        assert template.parse(text) == turns
        assert [template.show(text[a:b]) for a, b in spans] == [t for _, t in turns]
    rows = [(1, 1, "assistant", " two  spaces 漢字"), (1, 0, "user", None), (None, 0, None, "x"), (1, 1, "assistant", " two  spaces 漢字"), (2, 0, "assistant", "")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.formatted_conversations(talks, template).collect()}
    assert set(got) == {1, 2, None}
    r = got[1]
    learnt = chat.masked_text(r["formatted"], *(np.array(r[c]) for c in ("starts", "ends", "mask")))
    assert learnt == " two  spaces 漢字" * 2
    assert not any(got[2]["mask"]) and not any(got[None]["mask"])


def test_quality_scores_held_out_rows(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choices(["plain", "words", "of", "text", "here", "again."], k=40))
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choices(["buy", "now", "win"], k=40))
    rows = [(i, good() if i % 3 else bad()) for i in range(600)]
    frame = spark.createDataFrame([*rows, (1000, ""), (1001, None)], "doc_id long, text string")
    vectors = common.stored(quality.document_vectors(frame), "t")
    model = quality.fit_quality(vectors, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int"), features=32)
    scores = {r["doc_id"]: r["score"] for r in quality.score_vectors(vectors, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(scores[i] >= 0.7) == (i % 3 > 0) for i in held]) > 0.97
    assert len(scores) == 602 and all(0 <= s <= 1 for s in scores.values())


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 0.6, 0.4, 0.9, 1]), np.ones(5))
    assert list(y) == [0, 0.5, 0.9, 1]


def test_pipeline_stages(spark, docs, nothing, labels, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, current, str(tmp_path)), f"t-{name}")
        if name != "pack":
            assert out.columns == docs.columns
        if name == "exact_dedup":
            assert out.count() == len({common_lower(r["text"]) for r in current.select("text").collect()})
        if name == "near_dedup":
            named = out.where("doc_id IS NOT NULL")
            assert named.count() == named.select("doc_id").distinct().count()
        current = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == current.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_empty_tables(nothing, spark):
    assert circulant.near_duplicates(nothing).count() == 0
    assert katz.katz_scores(nothing).count() == 0
    assert order_minhash.edited_fingerprints(nothing).count() == 0
    assert block_names.exact_groups(nothing).count() == 0
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted_conversations(talks).count() == 0
