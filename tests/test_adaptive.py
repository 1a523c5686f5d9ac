"""The tiered adaptive search against a cell-by-cell work list, round by round."""

import random

from wherewhen.operators import adaptive

DEEPEST, CAP = 3, 5
SCHEMA = "area long, code long, keyword string, keyword_ord long, tier int, page long, pos long, place_id string"
WORDS = [("bar", 1), ("grill", 1), ("cafe", 2)]


def world(seed):
    """Places of leaf cells, and what a cell's search for a keyword lists: up to 8 of the places below it, in a fixed order."""
    rng = random.Random(seed)
    leaves = [(area, 4**DEEPEST + rng.randrange(4**DEEPEST) % rng.choice([4, 16, 64])) for area in (0, 1) for _ in range(60)]
    spots = [(f"p{i}", area, code, rng.sample([w for w, _ in WORDS], rng.randint(1, 3))) for i, (area, code) in enumerate(leaves)]

    def listed(area, code, word):
        shift = 2 * ((4**DEEPEST).bit_length() - code.bit_length()) // 2
        return [p for p, a, c, words in spots if a == area and word in words and c >> shift == code][:8]

    return listed


def work_list(listed, areas):
    """place -> (area, code, tier) of the hit that finds it first, and all searches made."""
    queue, first, asked = [(a, 1) for a in areas], {}, set()
    while queue:
        area, code = queue.pop(0)
        asked.add((area, code, 1))
        ones = [(p, 1) for w, t in WORDS if t == 1 for p in listed(area, code, w)]
        if len({p for p, _ in ones}) >= CAP and code < 4**DEEPEST:
            queue += [(area, 4 * code + i) for i in range(4)]
            continue
        asked.add((area, code, 2))
        for p, tier in [(p, 2) for w, t in WORDS if t == 2 for p in listed(area, code, w)] + ones:
            first.setdefault(p, (area, code, tier))
    return first, asked


def test_search_round_by_round_equals_the_work_list(spark):
    listed = world(4)
    want, asked = work_list(listed, [0, 1])
    areas = spark.createDataFrame([(0,), (1,)], "area long")
    results, searched = [], []
    for _ in range(2 * DEEPEST + 4):
        frame = spark.createDataFrame(results, SCHEMA)
        todo = adaptive.next_searches(areas, frame, spark.createDataFrame(searched, "area long, code long, tier int"), DEEPEST, CAP).collect()
        if not todo:
            break
        for area, code, tier in todo:
            searched.append((area, code, tier))
            results += [(area, code, w, i, t, 0, n, p) for i, (w, t) in enumerate(WORDS) if t == tier for n, p in enumerate(listed(area, code, w))]
    assert set(searched) == asked and len(searched) == len(asked)
    # Results of an earlier run, below cells that are not divided now, change nothing.
    stray = [(a, 4 * c, "bar", 0, 1, 0, 0, "stray") for a, c, t in asked if t == 2 and c < 4**DEEPEST]
    got = adaptive.adaptive_search(spark.createDataFrame(results + stray, SCHEMA), DEEPEST, CAP).collect()
    assert {r.place_id: (r.area, r.code, r.tier) for r in got} == want
    assert len(got) == len(want) and len({r.path for r in got}) > 4


def test_nothing_found(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert adaptive.adaptive_search(empty, DEEPEST).collect() == []
    areas = spark.createDataFrame([(7,)], "area long")
    none = spark.createDataFrame([], "area long, code long, tier int")
    assert [tuple(r) for r in adaptive.next_searches(areas, empty, none, DEEPEST).collect()] == [(7, 1, 1)]
