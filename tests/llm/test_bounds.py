"""What reaches the driver is bounded, and rules fit whatever the case of their hosts."""

import hashlib
import random
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from wherewhen.llm import block_names, order_minhash, url_rules, warc


def test_rule_hosts_fit_in_any_case(spark):
    pages = spark.createDataFrame([(0, "http://a.example.com/x"), (1, "http://EXAMPLE.com/X"), (2, "http://other.com/x")], "page_id long, url string")
    hosts = spark.createDataFrame([("Example.COM/", "block"), ("example.com/X", "allow")], "rule string, verdict string")
    none = spark.createDataFrame([], "rule string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judged_urls(pages, hosts, none).collect()}
    assert got == {0: ("Example.COM/", "block"), 1: ("example.com/X", "allow"), 2: (None, "allow")}
    assert url_rules.judged_urls(pages.where("false"), hosts, none).collect() == []
    assert {r.verdict for r in url_rules.judged_urls(pages, none, none).collect()} == {"allow"}


def test_the_dictionary_sample_is_bounded(spark):
    """Twenty thousand pages, half of them copies of one: four hundred records come to the driver, each once."""
    pages = spark.range(20_000, numPartitions=32).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("page_id"), F.lit("http://a").alias("url"),
        F.when(F.col("id") % 2 == 0, F.lit("same " * 400)).otherwise(F.concat(F.repeat(F.lit("word "), 400), F.col("id").cast("string"))).alias("html"))
    words = warc.record_dictionary(pages, "2024-01-01T00:00:00Z", records=50)
    assert 0 < len(words) <= 65536
    assert words == warc.record_dictionary(pages.repartition(5), "2024-01-01T00:00:00Z", records=50)
    assert warc.record_dictionary(pages.where("false"), "2024-01-01T00:00:00Z") == b""


def test_block_names_tell_blocks_apart(spark):
    blocks = [bytes([i % 7]) * (4096 if i % 3 else i) for i in range(300)]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "local long, block binary")
    names = {r.local: r.name for r in block_names.named(rows, ["block"], ["local"]).collect()}
    assert len(names) == 300
    assert Counter(len({names[i] for i, c in enumerate(blocks) if c == b}) for b in set(blocks)) == {1: len(set(blocks))}
    assert len(set(names.values())) == len(set(blocks))
    plan = block_names.named(rows, ["block"], ["local"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_rows_without_an_id_are_cut_into_slices(spark):
    """Three quarters of the rows have no id: slices stay even, each lends one row, and every row meets the one after it."""
    rows = [(i if i % 4 == 0 else None, f"text {i} " * (1 + i % 5)) for i in range(2000)] + [(8, "another text of the same id"), (None, None), (12, "text 12 " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    placed = order_minhash.neighbour_slices(docs, 8)
    sizes = {r["slice"]: r["n"] for r in placed.where("guest = 0").groupBy("slice").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == len(rows) and len(sizes) >= 12 and max(sizes.values()) < 400
    guests = placed.where("guest = 1").groupBy("slice").count().collect()
    assert len(guests) == len(sizes) and all(r["count"] == 1 for r in guests)
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = sorted(map(tuple, hashed.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
    want = Counter()
    for (doc_id, text, _), (_, after, _) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        want[doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    got = order_minhash.edited_fingerprints(docs, slices=8).select("doc_id", "n_chars", "edited_sha256").collect()
    assert Counter(map(tuple, got)) == want


def plain_fingerprint(sketch, text):
    """Order MinHash by definition: all numbered k-mers, the least two under each permutation, in text order."""
    seen, names, places = Counter(), [], []
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table, where = sketch.numbered(points)
    assert sorted(where.tolist()) == list(range(len(points) - sketch.k + 1))
    by_place = dict(zip(where.tolist(), table.tolist(), strict=True))
    for i in range(len(points) - sketch.k + 1):
        mer = text[i : i + sketch.k]
        names.append((mer, seen[mer]))
        places.append(by_place[i])
        seen[mer] += 1
    assert len({n: p for n, p in zip(names, places, strict=True)}) == len(set(places)) == len(names)  # a name each
    out = []
    for mask in sketch.permutations().tolist():
        least = sorted(range(len(places)), key=lambda i: (places[i] ^ mask, i))[: sketch.tuple_size]
        out.append(tuple(names[i] for i in sorted(least)))
    return out


def test_signatures_equal_plain_order_minhash():
    """Entries agree exactly where the ordered tuples of least k-mers do."""
    rng = random.Random(3)
    sketch = order_minhash.OrderSketch()
    draws = sketch.permutations()
    base = "".join(rng.choices("abcdefgh ", k=400)) + "repeat me " * 20
    others = [base, base[:200] + "X" + base[200:], base[300:] + base[:300], base.replace("repeat", "Repeat", 3), "".join(rng.choices("abcdefgh ", k=300))]
    prints = [sketch.fingerprint(t, draws) for t in others]
    plain = [plain_fingerprint(sketch, t) for t in others]
    for i in range(len(others)):
        for j in range(len(others)):
            same = [a == b for a, b in zip(plain[i], plain[j], strict=True)]
            assert sum(a != b for a, b in zip((prints[i] == prints[j]).tolist(), same, strict=True)) <= 1  # 16-bit entries


def test_positions_of_very_long_texts_are_exact():
    names = np.array([5 << 24, 3 << 24, 3 << 24, 9 << 24], np.uint64)
    places = np.array([1 << 24, (1 << 24) + 1, 7, 1 << 25], np.uint64)
    table, where = order_minhash._sorted(names, places)
    assert (table >> np.uint64(24)).tolist() == [3, 3, 5, 9] and where.tolist() == [7, (1 << 24) + 1, 1 << 24, 1 << 25]
