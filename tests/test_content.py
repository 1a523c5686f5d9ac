"""Items, pages, long texts, documents and model answers."""

import random
import re

import regex
from pyspark.sql import functions as F

from wherewhen.functions import focus, jsontext, labels, markup, tags, urls
from wherewhen.operators import directory, documents, items, pages
from wherewhen.operators.intervals import merge_intervals
from wherewhen.plans import extraction


def test_cheapest(spark):
    rows = [
        ("a", 0, "Pint", 7.0, "drink"), ("a", 1, "Lager", 5.0, "drink"), ("a", 2, "Cider", 5.0, "drink"), ("a", 3, "Fries", None, "food"),
        ("a", 4, "Wings", 12.0, "food"), ("b", 0, "Soup", None, "food"),
    ]
    frame = spark.createDataFrame(rows, "p string, item_ord int, name string, price double, category string")
    got = {r.p: tuple(r)[1:] for r in items.cheapest_per_group(frame, ["p"]).collect()}
    assert got == {"a": ("Lager", 5.0, "Wings", 12.0), "b": (None, None, None, None)}


def test_option_summary(spark):
    frame = spark.createDataFrame(
        [
            (["$1 wings", "$3 sliders", "$6 nachos"], ["$5 bottled", "$7 draft", "$9 wine"]), (["$4 a"], ["$2 b"]), ([], ["$2 b"]), ([], []),
            (["x", "$1 y"], ["z"]), (["$1.2.3 q"], ["$1 r"]),
        ],
        "food array<string>, drink array<string>",
    )
    got = [r[0] for r in frame.select(items.option_summary(F.col("food"), F.col("drink"))).collect()]
    assert got == [
        "$1 wings, $3 sliders, $5 bottled, $6 nachos, $7 draft and $9 wine", "$2 b and $4 a", "$2 b", "", "x, z and $1 y",
        "$1 r and $1.2.3 q",
    ]


def test_intervals_match_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 5)}", s := rng.randint(0, 5000), s + rng.choice([0, 3, 10, 400]))
            for _ in range(1500)] + [(None, 5, 9), (None, 9, 12), ("one", 1, 1)]

    def merged(group):
        out = []
        for s, e in sorted((s, e) for g, s, e in rows if g == group):
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                out.append((s, e))
        return out

    want = sorted((str(g), *iv) for g in {r[0] for r in rows} for iv in merged(g))
    frame = spark.createDataFrame(rows, "g string, s long, e long")
    for slices in (1, 40, None):
        got = sorted((str(r.g), r.s, r.e) for r in merge_intervals(frame, ["g"], "s", "e", slices).collect())
        assert got == want
    assert merge_intervals(frame.where("false"), ["g"], "s", "e").collect() == []


def test_no_task_holds_a_group_of_intervals(spark):
    """One group has a third of all rows, with starts far apart: its rows are dealt evenly all the same."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).alias("g"), (F.col("id") * 10**13 + 7).alias("s"),
        (F.col("id") * 10**13 + 7 + (F.col("id") % 5) * 10**13).alias("e"))
    merged = merge_intervals(rows, ["g"], "s", "e", slices=16)
    assert merged.count() > 0
    held = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in merged.inputFiles()})
    sizes = [r["count"] for r in held.groupBy("__slice").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 2 * 30_000 / 16
    crowd = held.where("__group.g = 0").groupBy("__slice").count().count()
    assert crowd >= 5


def test_page_text(evaluate):
    html = "<html><script type='x'>var a = '<b>';\n</script><style>\np{}</style><p>One&nbsp;<b>two</b>\n\t three </p></html>"
    assert evaluate(markup.page_text, [html, "<p>" + "x " * 9000 + "</p>"])[0] == "One&nbsp; two three"
    assert len(evaluate(lambda c: markup.page_text(c, 8000), ["<p>" + "xy " * 9000 + "</p>"])[0]) == 8000
    assert len(evaluate(markup.page_text, ["<p>" + "xy " * 9000 + "</p>"])[0]) == 26999
    upper = "<SCRIPT>x</SCRIPT>y"
    assert evaluate(markup.page_text, [upper]) == ["x y"]
    assert evaluate(lambda c: markup.page_text(c, any_case=True), [upper]) == ["y"]


def test_links(evaluate):
    def links(*bodies, base="https://bar.example.com/a/b"):
        return evaluate(lambda h: markup.same_site_links(h, F.lit(base)), list(bodies))

    many = "".join(f'<a href="/specials/{i}">x</a>' for i in range(10))
    got = links(
        '<a href="/happy-hour">Go</a>', '<a href="/deals">Happy Hour</a>', '<button data-href="/specials">x</button>',
        '<a href="https://www.bar.example.com/hh?x=1#y">z</a>', '<a href="https://other.com/happy-hour">z</a>',
        '<a href="/specials/">a</a><a href="/specials?b=1">b</a>', many, '<a href="#happy-hour">x</a><a href="mailto:hh@x.y">happy hour</a>',
        '<a href="specials">x</a><a href="../hh">y</a>', "", '<a href="/hhx">no</a>',
    )
    assert got[:6] == [
        ["https://bar.example.com/happy-hour"], ["https://bar.example.com/deals"], ["https://bar.example.com/specials"],
        ["https://www.bar.example.com/hh"], [], ["https://bar.example.com/specials"],
    ]
    assert got[6] == [f"https://bar.example.com/specials/{i}" for i in range(10)]
    first = evaluate(lambda h: markup.same_site_links(h, F.lit("https://bar.example.com/"), limit=5), [many])
    assert first == [got[6][:5]]
    assert got[7:] == [[], ["https://bar.example.com/a/specials", "https://bar.example.com/hh"], [], []]


def test_urls(evaluate):
    assert evaluate(urls.strip_query, ["HTTP://x.com/a/?b#c", "https://x.com", "x.com/"]) == ["http://x.com/a", "https://x.com", "x.com"]
    assert evaluate(urls.with_scheme, [" x.com ", "https://x", "", None]) == ["http://x.com", "https://x", None, None]
    assert evaluate(urls.home_variants, ["https://x.com/?q=1", ""]) == [["https://x.com/home", "https://x.com/"], None]
    assert evaluate(urls.resolve_dots, ["/a/./b/../c", "/../x", "/a/..", "/a/b"]) == ["/a/c", "/x", "/", "/a/b"]


def images(spark, html, url="https://bar.example.com/happy-hour"):
    frame = spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")
    return [r.url for r in pages.page_images(frame, ["page_id"]).orderBy("ord").collect()]


def test_images(spark):
    base = "https://bar.example.com"
    assert images(spark, '<img srcset="/m1.jpg 800w, /m2.jpg 1600w"><img data-src="/m3.png">') == [f"{base}/m1.jpg", f"{base}/m2.jpg", f"{base}/m3.png"]
    assert images(spark, '<img src="/m.jpg?w=500"><img src="/m.jpg?w=1000">') == [f"{base}/m.jpg?w=500"]
    assert images(spark, '<img src="/m.jpg?w=90"><img srcset="/n.jpg 100w">') == []
    assert images(spark, "<div style=\"background:url('/menu.png')\">") == [f"{base}/menu.png"]
    assert images(spark, '<img src="/logo.png"><img src="data:image/png;base64,x">') == []
    assert images(spark, '<img src="/a&amp;b.jpg">') == [f"{base}/a&b.jpg"]
    plain = f"{base}/about"
    far = "x" * 400
    assert images(spark, f'<img src="/a.jpg">{far}<p>drinks</p><img src="/b.jpg">', plain) == [f"{base}/b.jpg"]
    blocked = f'<img src="/a.jpg">{far}<p>drinks</p><img src="/a.jpg?v=2">'
    assert images(spark, blocked, plain) == []
    assert images(spark, '<img src="https://cdn.other.com/a.jpg">') == []
    assert len(images(spark, "".join(f'<img src="/m{i}.jpg">' for i in range(7)))) == 7
    assert images(spark, '<img src="https://img.wixstatic.com/a.jpg">') == ["https://img.wixstatic.com/a.jpg"]


def test_attributes_follow_the_grammar(spark, evaluate):
    tag = """<IMG alt="src='/no.jpg'" SRC = '/m"1.jpg' data-src="/m2.jpg" hidden>"""
    want = [("alt", "src='/no.jpg'"), ("src", '/m"1.jpg'), ("data-src", "/m2.jpg")]
    assert tags.attributes(tag) == want and tags.attributes("<img>") == []
    read = evaluate(lambda t: tags.attribute_values(t, ["src", "data-src"]), [tag, "<img>", "", None])
    assert read == [['/m"1.jpg', "/m2.jpg"], [], [], None]
    ordered = '<style>p {background: url( "/menu-z.png" )}</style><img srcset="/menu-b.jpg 2x" src="/menu-a.jpg"><source srcset="/menu-c.jpg">'
    assert images(spark, ordered) == [f"https://bar.example.com/menu-{n}" for n in ("a.jpg", "b.jpg", "c.jpg", "z.png")]


def test_script_shell(evaluate):
    pages_ = ['<meta content="Wix.com Website Builder">', "<p>plain</p>", "", None, "x" * 5000 + "squarespace"]
    assert evaluate(markup.is_script_shell, pages_) == [True, False, False, False, True]
    assert evaluate(lambda c: markup.is_script_shell(c, 5000), pages_)[-1] is False


def python_focus(text, patterns, before, after, limit):
    """A mask over the text's positions; what it covers, run by run."""
    if len(text) <= focus.SHORT:
        return text
    covered = bytearray(2 * len(text) + 1)  # positions and what lies between them: windows that touch are one run
    hits = {m.start() for p in patterns for m in regex.finditer(p, text)}
    for at in hits:
        early = at < len(text) * focus.NAV_TOP_SHARE
        bar = regex.search(focus.NAV_BAR, text[max(0, at - focus.NAV_REACH) : at + focus.NAV_REACH])
        if early and bar and not regex.search(focus.PRICE, text[at : at + focus.PRICE_REACH]):
            continue
        for i in range(2 * max(0, at - before), 2 * min(len(text), at + after) + 1):
            covered[i] = 1
    runs = [text[m.start() // 2 : m.end() // 2] for m in re.finditer(b"\x01+", bytes(covered))]
    return "\n\n".join(runs)[:limit] if runs else text


def test_focus(evaluate):
    nav = "FOOD HAPPY HOUR WKND BRUNCH BEER COCKTAILS " + "lorem ipsum " * 900
    texts = [
        "no anchor " * 60, "happy hour short", nav, "a" * 6000 + " happy hour $5 " + "b" * 9000 + " drink specials " + "c" * 9000,
        "FOOD HAPPY HOUR WKND BRUNCH BEER COCKTAILS $5 beer " + "x" * 12000, "h " * 200 + "hh" + " y" * 300 + " Happy-Hour " + "z" * 300,
        "é𝒳" * 150 + " HH specials " + "ü" * 500,
    ]
    want = [python_focus(t, focus.ANCHORS, 200, 4000, 8000) for t in texts]
    assert evaluate(lambda c: focus.focused_text(c, max_out=8000), texts) == want
    rng = random.Random(5)
    noise = ["".join(rng.choice(["ab ", "Ab Cd ", "XY ", "ba", "$3 ", "é"]) for _ in range(300)) for _ in range(30)]
    mine = ["ab", "XY"]
    got = evaluate(lambda c: focus.focused_text(c, mine, 5, 20, None), noise)
    assert got == [python_focus(t, mine, 5, 20, None) for t in noise]


def test_grounding(spark):
    cases = [
        ("$5 House Lager", "we pour house lager daily", True), ("Crispy Wings", "Wings tonight", True), ("$5", "anything", False),
        ("", "x", False), ("IPA", "an ipa here", True), ("the and", "nothing", False), ("Unicorn Steak", "salad", False),
    ]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r.g for r in frame.select("i", focus.is_grounded(F.col("a"), F.col("b")).alias("g")).orderBy("i").collect()]
    assert got == [c for *_, c in cases]


def test_answer_fields_read_as_a_schema_would(spark):
    """Fields taken from the VARIANT equal those that ``from_json`` reads from the block, in odd answers too."""
    item = "struct<name: string, price: double>"
    cases = [
        '{"drink": {"name": "A", "price": "5"}, "food": "x"}', '{"drink": {"name": 5, "price": 5.25}, "food": {"name": {"a":1}}, "short_summary": [1, 2]}',
        '{"drink": null, "food": {}}', "[]", "5", "null", '"x"', '{"drink": {"price": 1e3}, "food": {"price": true}}', '{"confidence": true}',
        '{"happy_hours": [{"day": 1, "times": null}, null], "confidence": 0.5}', '{"happy_hours": ["x"], "confidence": "high"}',
        '{"happy_hours": {}, "confidence": null}', '{"a": 1}], [{"b": 2}', '{"a": 1}} , {{"b": 2}', '{"a":1} {"b":2}', "", None,
        '{"drink": {"price": 12345678901234567890}}', '1, "\u241f end of candidate \u241f"], ["x"', '{"drink": {"name": "A"}} and more',
    ]
    c = F.col("t")
    menu = F.from_json(jsontext.json_block(c), f"drink {item}, food {item}, short_summary string")
    hours = F.from_json(jsontext.json_block(c), "happy_hours array<struct<day: string, times: string>>, confidence string")
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", jsontext.parse_menu(c).alias("m"), menu.alias("m0"), jsontext.parse_hours(c).alias("h"), hours.alias("h0"))
    for r in rows.collect():
        m0, h0 = r.m0 or {}, r.h0 or {}
        get = lambda row, name: row[name] if row else None
        assert (r.m.drink, r.m.food, r.m.short_summary) == (get(m0, "drink"), get(m0, "food"), get(m0, "short_summary") or ""), r.t
        assert (r.h.happy_hours, r.h.confidence) == (get(h0, "happy_hours") or [], get(h0, "confidence") or "low"), r.t


def test_json_blocks(evaluate):
    cases = {
        'x\n```json\n{"a": 1}\n```\ny': '{"a": 1}', '```\n{"a": 2}\n```': '{"a": 2}', 'so {"a": {"b": 3}} it is': '{"a": {"b": 3}}',
        '{"a": 4}': '{"a": 4}', "nothing here": None, '{"a": 5}}': None, "[1, 2]": "[1, 2]", "": None,
        '```json\nbroken\n``` {"a": 6}': '{"a": 6}', '{"a": 1}, {"b": 2}': None,
    }
    assert evaluate(jsontext.json_block, list(cases)) == list(cases.values())


def test_answers(evaluate):
    hours = evaluate(jsontext.parse_hours, ['{"happy_hours": [{"day": "Mon", "times": "3"}], "confidence": "high"}', "none", "{}"])
    assert [(len(h.happy_hours), h.confidence) for h in hours] == [(1, "high"), (0, "low"), (0, "low")]
    menus = evaluate(jsontext.parse_menu, ['{"drink": {"name": "Ale", "price": 5}, "food": null}', "none"])
    assert menus[0].drink.name == "Ale" and menus[0].food is None and menus[0].short_summary == "" and menus[1].drink is None


def test_categories(evaluate):
    out = [["cafe", "coffee_shop"], ["gas_station", "convenience_store"], ["CAFE", "BAKERY"],
           ["cafe", "coffee_shop", "food", "point_of_interest", "establishment"], ["juice_bar", "food", "point_of_interest"],
           ["fast_food_restaurant", "food", "establishment"]]
    kept = [["bar", "restaurant"], ["cafe", "restaurant"], [], None, ["BAR", "CAFE"], ["fast_food_restaurant", "bar", "food"]]
    assert evaluate(documents.is_excluded, [(t,) for t in out + kept], "v array<string>") == [True] * 6 + [False] * 6
    confirmed = evaluate(lambda t: documents.is_excluded(t, F.lit(True)), [(t,) for t in out], "v array<string>")
    assert not any(confirmed)


def test_labels(evaluate):
    assert evaluate(labels.price_sign, ["PRICE_LEVEL_MODERATE", "x", None]) == ["$$", "", ""]
    assert evaluate(labels.local_phone, ["+1 619-555", "619", None]) == ["619-555", "619", ""]
    assert evaluate(labels.source_label, ["Google Places", "Website (AI)", "Manual", "", None, "Yelp"]) == [
        "Google Maps", "Website", "Manual", "Unknown", "Unknown", "Yelp"]
    assert evaluate(labels.short_address, ["1 A St, San Diego, CA 92101, USA", "2 B St, San Diego, CA", None]) == ["1 A St, USA", "2 B St, San Diego", ""]
    assert evaluate(labels.date_label, ["2026-04-09", "bad", None, "2026-02-30"]) == ["Apr 9, 2026", "", "", ""]


PLACES = [
    (0, "Sushi Monday", "1 Main St", "Monday: 3:00 PM - 6:00 PM"), (1, "Taco Tuesday", "2 Oak Ave", "Tuesday: 3:00 PM - 6:00 PM"),
    (2, "No HH Diner", "3 Sushi Way", ""), (3, "Sushi Palace", "4 Elm St", "Monday: 5:00 PM - 7:00 PM"),
]


def test_directory_filters(spark):
    frame = spark.createDataFrame(PLACES, "ord int, restaurant_name string, address string, happy_hour_times string")
    tuesday = "2026-04-21 16:00:00"

    def found(**filters):
        return [r.ord for r in directory.directory_query(frame, directory.Filters(**filters), tuesday).collect()]

    assert found() == [0, 1, 2, 3]
    assert found(search="sushi") == [0, 2, 3]
    assert found(search="Sushi", has_schedule=True) == [0, 3]
    assert found(has_schedule=True) == [0, 1, 3]
    assert found(search="Sushi", active_now=True) == []
    assert found(active_now=True) == [1]
    assert found(search="%") == []
    names = directory.directory_query(frame, directory.Filters(), tuesday, by_name=True).collect()
    assert [r.ord for r in names] == [2, 0, 3, 1]
    counters = directory.result_counters(frame, directory.Filters(search="Sushi"), tuesday).first()
    assert tuple(counters) == (3, 3, 0)


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "happy_hour_times string, menu_summary string")
    assert tuple(directory.summary(empty).first()) == (0, 0, None, 0, None)


def test_fallback_pages(spark):
    chosen = spark.createDataFrame([(1, "https://x.com/?a", "https://x.com/hh", "s" * 50), (2, "https://y.com", "https://y.com", None), (3, "https://z.com", "https://z.com/hh", "s" * 50)], "k int, website_url string, page_url string, text string")
    known = spark.createDataFrame([("https://x.com/home", "h" * 900), ("https://x.com/", "r" * 999), ("https://y.com/", "r" * 500), ("https://z.com/home", "h" * 60), ("https://z.com", "r" * 70)], "url string, text string")
    got = {r.k: (r.page_url, len(r.text or "")) for r in pages.fallback_pages(chosen, pages.texts_by_address(known), ["k"]).collect()}
    assert got == {1: ("https://x.com/home", 900), 2: ("https://y.com", 0), 3: ("https://z.com/", 70)}


def test_menu_answers(spark):
    places = spark.createDataFrame(
        [(i, f"N{i}", "own", None, None, None, None, None) for i in range(5)],
        "k int, restaurant_name string, menu_summary string, cheapest_drink string, cheapest_drink_price double, "
        "cheapest_food string, cheapest_food_price double, menu_url string",
    )
    prompts = spark.createDataFrame([(i, "cold lager and fries", "page", "first") for i in range(4)], "k int, text string, page_url string, first_url string")
    answers = spark.createDataFrame([
        (0, '{"drink": {"name": "Lager", "price": 5}, "food": {"name": "unicorn", "price": 1}, "short_summary": "S"}'), (1, "sorry"),
        (2, '{"food": {"name": "", "price": 3}}'), (3, '{"drink": {"name": "unicorn", "price": 5}}'),
    ], "k int, response string")
    images_ = spark.createDataFrame([(3, '{"drink": {"name": "Seen", "price": 2}, "short_summary": "I"}'), (0, '{"food": {"name": "Seen", "price": 2}}')], "k int, response string")
    rows = {r.k: r for r in extraction.apply_menu_responses(places, prompts, answers, ["k"], images_).collect()}
    assert (rows[0].cheapest_drink, rows[0].cheapest_drink_price, rows[0].cheapest_food, rows[0].menu_url, rows[0].menu_summary) == ("Lager", 5.0, None, "page", "S")
    assert (rows[1].menu_summary, rows[1].extracted) == ("", False)
    assert (rows[2].cheapest_food, rows[2].cheapest_food_price, rows[2].menu_summary) == ("", 3.0, "")
    assert (rows[3].cheapest_drink, rows[3].menu_url, rows[3].menu_summary) == ("Seen", "first", "I")
    assert (rows[4].menu_summary, rows[4].extracted) == ("own", False)
    alone = images_.withColumn("k", F.lit(4)).unionByName(images_.where("k = 3").withColumn("k", F.lit(4)))
    rows = [r for r in extraction.apply_menu_responses(places, prompts, answers.union(answers), ["k"], alone).collect()]
    assert len(rows) == places.count() and [r.extracted for r in rows if r.k == 4] == [True]


def test_hours_answers(spark):
    places = spark.createDataFrame([(i, "own", "src") for i in range(4)], "k int, happy_hour_times string, source string")
    good = '{"happy_hours": [{"day": "Monday", "times": "3 PM - 5 PM"}], "confidence": "%s"}'
    answers = spark.createDataFrame([(0, good % "high"), (1, good % "low"), (2, '{"happy_hours": [], "confidence": "high"}')], "k int, response string")
    seen = spark.createDataFrame([(1, good % "medium"), (2, good % "medium")], "k int, response string")
    only = spark.createDataFrame([(3, 0, good % "none"), (3, 1, good % "medium"), (1, 1, good % "low")], "k int, ord int, response string")
    late = answers.withColumn("ord", F.lit(0)).where("k < 2")
    got = extraction.apply_hours_responses(places, late.union(late.select("k", F.lit(good % "low").alias("response"), F.lit(1).alias("ord"))), ["k"], only, order="ord").collect()
    assert sorted((r.k, r.source) for r in got) == [(0, "src"), (1, "src"), (2, "src"), (3, "Website image (AI parsed, medium confidence)")]
    rows = {r.k: r for r in extraction.apply_hours_responses(places, answers, ["k"], seen).collect()}
    assert (rows[0].happy_hour_times, rows[0].source) == ("Monday: 3 PM - 5 PM", "Website (AI parsed, high confidence)")
    assert rows[1].source == "Website image (AI parsed, medium confidence)"
    assert (rows[2].happy_hour_times, rows[2].extracted) == ("own", False) and rows[3].source == "src"


def test_prompts_do_not_refill_values(spark):
    frame = spark.range(1).select(extraction.menu_prompt(F.lit("{text}"), F.lit("T{name}"), F.lit("  ")).alias("p"))
    text = frame.first().p
    assert "Venue: {text}\n" in text and text.endswith("T{name}") and "Known hours" not in text


def test_hours_prompts_share_a_site(spark):
    places = spark.createDataFrame([(i, "https://x.com/?p=1" if i < 40 else "", f"N{i}", "") for i in range(50)], "k int, website_url string, restaurant_name string, happy_hour_times string")
    stored = spark.createDataFrame(
        [("https://x.com/", '<a href="/specials">go</a> home'), ("https://x.com/specials", "<p>Monday 3 to 6</p>")], "url string, html string"
    )
    rows = extraction.build_hours_prompts(places, stored, ["k"]).collect()
    assert len(rows) == 40 and {(r.page_url, r.first_url, r.text) for r in rows} == {("https://x.com/specials", "https://x.com/specials", "Monday 3 to 6")}
    short = extraction.build_menu_prompts(places, stored, ["k"])
    assert short.count() == 0
