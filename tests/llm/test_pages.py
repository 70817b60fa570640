"""Operators over the element stream: hand-made pages, edge cases, brute force on the smallest tables."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from corpusloom.llm import language, mainbody, near_duplicates, quality, queries, repeated_lines, scan_noise

STREAM = "page_id long, pos int, siteindex int, docelttype string, doceltcmd string, nestinglevel short, text string, n string, key string, boiler string"
PAGES = "page_id long, siteindex int, uri string, lang string, n string, pdf string, text string"

PROSE = "The library of the old town presents a new plan for the river, and people say that it changes the harvest. However, the school near the market often repairs the roof of the museum in spring."


def page(i, site, parts, uri=None):
    """Rows of a page from (kind, cmd, level, text) parts."""
    rows = [("Document", "Start", 1, str(i)), ("Document", "Title", 1, f"Title {i}"), ("Document", "Uri", 1, uri or f"https://h/{i}"), *parts, ("Document", "End", 1, str(i))]
    return [(i, pos, site, k, c, n, t, "x", "y", "z") for pos, (k, c, n, t) in enumerate(rows)]


def web_page(i, site, body):
    return page(
        i, site,
        [
            ("NavigationList", "Start", 1, None), ("ListItem", "Text", 2, "Home"), ("ListItem", "Text", 2, "News"), ("NavigationList", "End", 1, None),
            ("Section", "Start", 1, None), ("TextBlock", "Text", 2, "We use cookies."), ("Section", "End", 1, None),
            ("Section", "Start", 1, "Most read"), ("TextBlock", "Text", 2, f"Teaser number {i}"), ("Section", "End", 1, None),
            ("Section", "Start", 1, f"Title {i}"), ("TextBlock", "Text", 2, f"Posted by Ann Smith on {i}/{i}"), *body, ("Section", "End", 1, None),
            ("TextBlock", "Text", 1, "© 2020 All rights reserved"),
        ],
    )


def frames(spark, rows, uris=()):
    uris = dict(uris)
    ids = {(r[0], r[2]) for r in rows if r[0] is not None}
    docs = [(p, s, uris.get(p, f"https://h/{p}"), "en", "a", "b", "c") for p, s in sorted(ids)]
    return spark.createDataFrame(rows, STREAM), spark.createDataFrame(docs, PAGES)


@pytest.fixture(scope="module")
def site(spark):
    bodies = {
        1: [("TextBlock", "Text", 2, PROSE)],
        2: [("TextBlock", "Text", 2, PROSE.replace("library", "station"))],
        3: [("TextBlock", "Text", 2, f"Item number {w}") for w in ("one", "two", "three", "four")],
        4: [("TextBlock", "Text", 2, '{"id":12,"k":"abc","v":[1,2,null],"ok":true}')] * 3,
        5: [("TextBlock", "Text", 2, None), ("TextBlock", "Text", 2, ""), ("TextBlock", "Text", 2, PROSE)],
    }
    rows = [r for i, b in bodies.items() for r in web_page(i, 0, b)]
    rows += rows[:40] + [(None, 1, 0, "TextBlock", "Text", 1, "lost", "", "", ""), (1, None, 0, "TextBlock", "Text", 1, "lost", "", "", "")]
    return frames(spark, rows)


def test_boilerplate(site):
    found = {(r.page_id, r.pos) for r in mainbody.boilerplate_found(*site).collect()}
    t, _ = site
    texts = {(r.page_id, r.pos): r.text for r in t.where("page_id IS NOT NULL AND pos IS NOT NULL").collect()}
    kept = {v for k, v in texts.items() if k not in found and v}
    gone = {texts[k] for k in found}
    assert {"Home", "We use cookies.", "Most read", "Teaser number 1", "Posted by Ann Smith on 2/2", "© 2020 All rights reserved"} <= gone
    assert PROSE in kept and "Item number one" in kept and "Title 3" in kept


def test_boilerplate_by_shuffle(site, monkeypatch):
    want = sorted(mainbody.boilerplate_found(*site).collect())
    monkeypatch.setattr(mainbody, "BROADCAST_ROWS", -1)
    assert sorted(mainbody.boilerplate_found(*site).collect()) == want


def test_pages_are_walked_once(site):
    plan = mainbody.element_rows(site[0])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Sort [") == 1 and plan.count("Exchange ") == 1


def test_repeated_rows_part_no_neighbours(spark):
    pages = {
        i: [("Section", "Start", 1, None), ("TextBlock", "Text", 2, "Read also"), ("TextBlock", "Text", 2, f"{PROSE} Part {'abcde'[i]}"), ("Section", "End", 1, None), ("Section", "Start", 1, None), ("TextBlock", "Text", 2, PROSE[i:]), ("Section", "End", 1, None)]
        for i in range(5)
    }
    rows = [r for i, parts in pages.items() for r in page(i, 0, parts)]
    once, twice = (sorted(mainbody.boilerplate_found(*frames(spark, x)).collect()) for x in (rows, rows + rows))
    assert [(r.page_id, r.pos) for r in once] == [(i, pos) for i in range(5) for pos in (4, 5)] and twice == once


def test_pages_in_pieces(spark, site):
    want = sorted(mainbody.boilerplate_found(*site).collect())
    for n in (1, 3, 20):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            assert sorted(mainbody.boilerplate_found(*site).collect()) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_page_without_sections_keeps_its_text(spark, site):
    t, docs = site
    flat = [(90, k, 0, "TextBlock" if k > 2 else "Document", ("Start", "Title", "Uri", "Text", "Text")[k], 1, x, "", "", "") for k, x in enumerate((None, "T", "http://s0/90", PROSE, "More of it."))]
    t = t.unionByName(spark.createDataFrame(flat, t.schema))
    assert not [r for r in mainbody.boilerplate_found(t, docs).collect() if r.page_id == 90]


def own_page(i, title, parts):
    rows = page(i, 0, [("Section", "Start", 1, title), ("TextBlock", "Text", 2, f"{title} {PROSE}"), ("Section", "End", 1, None), *parts])
    return [(*r[:6], title, *r[7:]) if r[4] == "Title" else r for r in rows]


TOPICS = ("apple", "bridge", "candle", "desert", "engine", "forest", "garden", "harbour")


def test_whole_subtrees_recur(spark):
    """A subtree that is equal on many pages goes, whatever its first row is, at any depth; one of which a row differs stays."""
    notice = "All contents of this site are protected, and whoever copies them needs our leave in writing. " * 2
    def parts(word):
        return [
            ("Section", "Start", 1, None), ("TextBlock", "Text", 2, notice), ("TextBlock", "Text", 2, "Ask the office."), ("Section", "End", 1, None),
            ("Section", "Start", 1, None), ("TextBlock", "Text", 2, f"{PROSE} {word}"),
            ("Section", "Start", 2, None), ("TextBlock", "Text", 3, notice.upper()), ("TextBlock", "Text", 3, "Ask us."), ("Section", "End", 2, None),
            ("List", "Start", 2, None), ("ListItem", "Text", 3, "red paint"), ("ListItem", "Text", 3, f"paint of {word}"), ("List", "End", 2, None),
            ("Section", "End", 1, None),
        ]
    t, docs = frames(spark, [r for i, w in enumerate(TOPICS) for r in own_page(i, w, parts(w))])
    found = {(r.page_id, r.pos) for r in mainbody.boilerplate_found(t, docs).collect()}
    gone = {r.text for r in t.collect() if (r.page_id, r.pos) in found}
    assert gone == {notice, notice.upper(), "Ask the office.", "Ask us."} and len(found) == 4 * len(TOPICS)


def test_like_pages_are_no_template(spark):
    """The sections that three edited copies of a page share are theirs."""
    shared = [("Section", "Start", 1, "How to paint"), ("TextBlock", "Text", 2, "Take a brush."), ("Section", "End", 1, None)]
    rows = [r for i, w in enumerate(TOPICS) for r in own_page(i, w, [])]
    for i in (20, 21, 22):
        rows += own_page(i, "paint", [*shared, ("Section", "Start", 1, None), ("TextBlock", "Text", 2, f"{PROSE} {TOPICS[i - 20]}"), ("Section", "End", 1, None)])
    assert mainbody.boilerplate_found(*frames(spark, rows)).count() == 0


def test_quality(site):
    q = {r.page_id: r for r in quality.page_quality(*site).collect()}
    assert {p for p, r in q.items() if "not_prose" in r.reasons} == {3, 4}
    assert q[4].junk and not q[3].junk and q[1].reasons == [] and q[5].visible > 0
    assert "fineweb_punctuated" in q[3].published and {r.page_id for r in quality.junk_pages(quality.page_quality(*site)).collect()} <= {3, 4}


def test_statistics_of_odd_texts():
    s = quality.batch_stats(pa.array([None, "", "  \n", "A b.\nC", "x" * 3_000_000, "Ã© ï»¿ �"]))
    marks = quality.batch_stats(pa.array(["# a… b...\nc....", "x 1 2", None, "𐐀𐐁 abc"]))
    assert marks["marks"].tolist() == [4, 0, 0, 0] and marks["ellipses"].tolist() == [2, 0, 0, 0] and marks["letter_words"].tolist() == [3, 1, 0, 2]
    assert s["lines"].tolist() == [0, 0, 0, 2, 1, 1] and s["words"].tolist()[3] == 3 and s["broken"].tolist()[5] > 0


@pytest.mark.parametrize("op", [mainbody.boilerplate_found, quality.page_quality, repeated_lines.repeated_lines, scan_noise.scan_noise, language.language_found])
def test_empty_tables(spark, op):
    assert op(*frames(spark, [])).count() == 0


def test_repeated_lines_brute_force(spark, small):
    t, n = spark.read.parquet(f"{small}/textdf.parquet"), spark.read.parquet(f"{small}/nlpdocs.parquet")
    pages = Counter(r.siteindex for r in n.collect())
    lines, cover = [], defaultdict(set)
    for r in t.distinct().where("text IS NOT NULL").collect():
        if r.docelttype != "Document":
            for i, line in enumerate(r.text.split("\n"), 1):
                k = (r.siteindex, regex.sub(r"[^\p{L}\p{M}]", "", line.lower()))
                if k[1]:
                    cover[k].add(r.page_id)
                    lines.append((r.page_id, r.pos, i, k))
    want = {(p, o, i) for p, o, i, k in lines if len(cover[k]) >= 4 and len(cover[k]) * 8 >= pages[k[0]]}
    assert {tuple(r) for r in repeated_lines.repeated_lines(t, n).collect()} == want


def test_repeated_lines_are_taken_out(spark):
    rows = [r for i in range(4) for r in page(i, 0, [("TextBlock", "Text", 1, f"own {'abcd'[i] * 3}\nSHARE  this, {i}!"), ("TextBlock", "Text", 1, "Share This."), ("TextBlock", "Text", 1, "42")])]
    t, n = frames(spark, rows)
    clean = {(r.page_id, r.pos): r.clean_text for r in repeated_lines.without_repeated_lines(t, n).collect()}
    assert clean[(0, 3)] == "own aaa" and clean[(0, 4)] == "" and clean[(0, 5)] == "42"


def test_lines_with_a_slot(spark):
    names = ["Ann", "Bo", "Cyril", "Dora", "Emil", "Fay", "Gus", "Hal"]
    rows = [r for i, n in enumerate(names) for r in page(i, 0, [("TextBlock", "Text", 1, f"Written by {n} Smith"), ("TextBlock", "Text", 1, "Same line, always 12"), ("TextBlock", "Text", 1, f"{n * 3} alone {i}")])]
    t, n = frames(spark, rows)
    assert {r.pos for r in repeated_lines.repeated_lines(t, n).collect()} == {4}
    assert [(r.siteindex, r.depth, r.pages, r.page_id, r.pos, r.line_no) for r in repeated_lines.slot_templates(t, n).collect()] == [(0, 2, 8, 0, 3, 1)]


def test_score_packing():
    scores = -np.array([[0, 1.0, 15.9, 17.0, 200.0, 2000.0, 0.1, 0.2, 0.3]])
    got = [((int(language.pack(scores)[0]) >> (7 * i)) & 127) * 0.25 for i in range(9)]
    assert got == [0, 1, 16, 17, 31.75, 31.75, 0, 0.25, 0.25]


def test_line_confidence(spark):
    scores = np.array([[0, -1.0, -2.0, -8, -8, -8, -8, -8, -8], [0] * 9])
    df = spark.createDataFrame([(int(x),) for x in language.pack(scores)], "packed long").select(language.line_language(F.col("packed")).alias("l"), language.line_confidence(F.col("packed")).alias("c"))
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("fr", pytest.approx(1 / np.exp(scores[0]).sum())) and got[1] == ("fr", pytest.approx(1 / 9))


def test_scan_noise(spark):
    clean = [("TextBlock", "Text", 1, "the council opens the museum and the station in the modern village. ") for _ in range(12)]
    scan = [
        ("Section", "Start", 1, "Page 1"), ("TextBlock", "Text", 2, "Ann Smith – Town 7"), ("TextBlock", "Text", 2, "the coun-\ncil opens the\nmuseum."),
        ("TextBlock", "Text", 2, "the c0uncil opens\nthe rnuseum and the\nstafion"), ("TextBlock", "Text", 2, None), ("TextBlock", "Text", 2, "- 7 -"), ("Section", "End", 1, None),
    ]
    born = [("Section", "Start", 1, "Page 1"), ("TextBlock", "Text", 2, "the c0uncil : 17"), ("Section", "End", 1, None)]
    rows = page(1, 0, clean) + page(2, 0, scan, "https://h/2.PDF") * 2 + page(3, 0, born, "https://h/3.pdf")
    t, n = frames(spark, rows, [(2, "https://h/2.PDF"), (3, "https://h/3.pdf")])
    got = {tuple(r) for r in scan_noise.scan_noise(t, n).collect()}
    assert got == {(2, 4, "header"), (2, 5, "hyphen"), (2, 6, "chars"), (2, 8, "page_number")}
    fixed = {r.pos: r.text for r in scan_noise.repaired_blocks(t, n).collect()}
    assert fixed == {5: "the council opens the museum.", 6: "the council opens the museum and the station"}


def test_scan_candidates():
    assert ("museum", (scan_noise.PAIRS.index(("rn", "m")),)) in scan_noise.candidates("rnuseum")
    assert scan_noise.candidates("x") == scan_noise.candidates("x" * 99) == []
    assert {len(c) for _, c in scan_noise.candidates("e" * 200)} == {1} and "cafe" in dict(scan_noise.candidates("c@f" + "c"))
    assert scan_noise.viterbi([[("a", 0.0), ("b", 1.0)], [("c", 0.0)]], {("a", "c"): 2.0}) == ["a", "c"]


def test_frequent_misreadings(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abdeghiklmnoprstuvwz", k=rng.randint(3, 9))): 20 for _ in range(3000)}
    words |= {"the": 100_000, "tbe": 10, "house": 400, "horse": 300}
    counts = spark.createDataFrame(list(words.items()), "unit string, n long")
    tokens = spark.createDataFrame([("tbe",), ("the",), ("house",), ("horse",)], "unit string")
    total = float(sum(words.values()))
    read = scan_noise.readings(tokens, counts, total).cache()
    costs = scan_noise.channel_costs(read, tokens)
    assert all(1 < c < 9 for c in costs)
    best = {r.unit: r.readings[0] for r in scan_noise.lattices(read, [scan_noise.CHANNEL] * len(costs)).collect()}
    assert {u for u, r in best.items() if r.gain > 0} == {"tbe"} and best["tbe"].candidate == "the"


def test_the_line_decides_between_words(spark):
    """"hall" and "ball" are both words; only their neighbours tell which one was printed."""
    clean = [("TextBlock", "Text", 1, t) for t in ["the town hall opens. "] * 30 + ["a red ball rolls. "] * 30 + ["the museum and the station open in the village. "] * 30]
    scan = [
        ("Section", "Start", 1, "Page 1"), ("TextBlock", "Text", 2, "Ann – 1"), ("TextBlock", "Text", 2, "the town\nball opens"), ("TextBlock", "Text", 2, "a red\nball rolls"),
        ("TextBlock", "Text", 2, "the tovvn\nhall opens"), ("Section", "End", 1, None),
    ]
    t, n = frames(spark, page(1, 0, clean) + page(2, 0, scan, "https://h/2.pdf"), [(2, "https://h/2.pdf")])
    assert {(r.pos, r.noise) for r in scan_noise.scan_noise(t, n).collect()} == {(4, "header"), (5, "chars"), (7, "chars")}
    assert {r.pos: r.text for r in scan_noise.repaired_blocks(t, n).collect()} == {5: "the town hall opens", 6: "a red ball rolls", 7: "the town hall opens"}


def test_words_and_pairs_are_counted_alike(spark):
    text = "Café «d’été» c@fe_1 日本 x\nx 2"
    words, bounds = scan_noise.word_keys(pa.array([text, "", "a"]))
    want = ["café", "d", "été", "c@fe_1", "x", "x", "2", "a"]
    assert words.tolist() == scan_noise._hashes(want).tolist() and bounds.tolist() == [0, 7, 7, 8]


WORD = re.compile(r"[^\W_]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return frozenset(zip(w, w[1:], w[2:]))


def test_near_duplicates_brute_force(spark):
    base = [f"{PROSE} {' '.join(f'w{i}x{j}' for j in range(30))}" for i in range(40)]
    texts = base + [t.replace("library", "bank") for t in base[:15]] + base[:5] + [" ".join(t.split()[20:]) for t in base[:10]] + ["", "two words", None]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")
    words = df.select("page_id", F.coalesce(near_duplicates.word_hashes("text"), F.array().cast("array<int>")).alias("words"))
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = {(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b])}
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(words).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r.page_id: r.group_id for r in near_duplicates.near_duplicate_groups(words).collect()}
    assert all(groups[a] == groups[b] for a, b in want) and groups[39] == 39


def test_crowded_near_duplicates(spark):
    common = [f"c{j}" for j in range(300)]
    texts = [" ".join([*common[: 7 * (i % 40)], f"n{i}", *common[7 * (i % 40) :]]) for i in range(1300)]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")
    words = df.select("page_id", near_duplicates.word_hashes("text").alias("words"))
    assert near_duplicates.near_duplicate_pairs(words).count() == 1300 * 1299 // 2


def test_near_duplicates_at_the_threshold(spark):
    texts = []
    for i in range(400):  # 66 runs, of which 44 are common to both: 44 of 88
        own = [f"p{i}w{j}" for j in range(68)]
        texts += [" ".join(own), " ".join([*own[:46], *(f"q{i}w{j}" for j in range(22))])]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")
    words = df.select("page_id", near_duplicates.word_hashes("text").alias("words"))
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(words).collect()}
    assert got <= {(2 * i, 2 * i + 1) for i in range(400)} and len(got) >= 398


def test_signatures_across_chunks():
    """Sets that end beyond a multiple of CHUNK, longer ones and empty ones have the signatures they have alone."""
    rng = np.random.default_rng(5)
    for sizes in ((near_duplicates.CHUNK - 10, 0, 40), (near_duplicates.CHUNK * 2 + 9,), (30, near_duplicates.CHUNK + 50, 2, 60)):
        lists = [rng.integers(-(2**31), 2**31, n).astype(np.int32) for n in sizes]
        together = near_duplicates.sign(pa.array(lists, pa.list_(pa.int32()))).to_pylist()
        for words, got in zip(lists, together):
            runs = np.array(got["runs"], np.int32).view(np.uint32).astype(np.uint64)
            assert len(runs) == max(len(words) - near_duplicates.RUN + 1, 0)
            least = [int(((runs * a + b) >> np.uint64(32)).min()) for a, b in zip(near_duplicates._A, near_duplicates._B)] if len(runs) else None
            assert got["signature"] == (least and np.array(least, ">u4").tobytes())
            assert got["set_hash"] == near_duplicates.sign(pa.array([words], pa.list_(pa.int32()))).to_pylist()[0]["set_hash"]


def test_runs_are_sorted_and_not_hashed(monkeypatch):
    words = pa.array([np.arange(i, i + 300).tolist() * 2 for i in range(50)] + [[], [1, 2]], pa.list_(pa.int32()))
    whole, sizes = np.unique, []
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: (sizes.append(len(x)), whole(x, *a, **k))[1])
    runs = near_duplicates.sign(words).field("runs")
    assert [len(set(r)) == len(r) for r in runs.to_pylist()] == [True] * 52 and [len(r) for r in runs[-3:].to_pylist()] == [300, 0, 0]
    assert max(sizes, default=0) <= len(words)


def test_words_travel_as_bytes(spark):
    texts = [(1, 1, "The old town, and the river."), (1, 2, None), (1, 3, ""), (1, 4, "a b c"), (2, 1, "..."), (3, 1, None), (4, 1, "สวัสดี 12 x" * 50)]
    df = spark.createDataFrame(texts, "page_id long, pos int, text string").coalesce(1)
    rows = df.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", near_duplicates.word_bytes("text").alias("w")))).alias("r"))
    got = {r.page_id: r.words for r in rows.select("page_id", near_duplicates.joined_words(F.col("r.w")).alias("words")).collect()}
    hashes = {(r.page_id, r.pos): r.w or [] for r in df.select("page_id", "pos", near_duplicates.word_hashes("text").alias("w")).collect()}
    assert got == {i: [w for (p, _), ws in sorted(hashes.items()) if p == i for w in ws] for i in (1, 2, 3, 4)} and len(got[1]) == 9


def test_label_codes(spark):
    df = spark.createDataFrame([("FR",), ("it-419",), (" de ",), ("xx",), ("",), (None,)], "lang string")
    assert [r[0] for r in df.select(language.label_code(F.col("lang"))).collect()] == ["fr", "it", "de", None, None, None]


def test_found_queries_have_their_columns(spark, small):
    want = {
        "p1_found": ["page_id"], "p2_found": ["page_id", "pos"], "p3_found": ["page_id", "pos", "line_no"], "p4_found": ["page_id", "pos", "noise"],
        "p5_found": ["page_id", "pos", "line_no", "lang"], "p6_found": ["page_id_a", "page_id_b"], "p7_found": ["page_id", "pos", "start_char", "end_char"],
        "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
    }
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, small)
        assert df.columns == columns, name
        rows = [tuple(map(str, r)) for r in df.collect()]
        assert len(rows) == len(set(rows)), name
        assert dict(df.dtypes).get("pos", "int") == "int" and dict(df.dtypes).get("line_no", "int") == "int"
