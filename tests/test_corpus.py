"""Edge cases of the corpus and crawl operators."""

from pyspark.sql import functions as F

from corpusloom.operators import corpus, crawl
from corpusloom.plans import queries
from corpusloom.sources import tables

SCHEMA = "page_id long, pos int, siteindex int, docelttype string, doceltcmd string, nestinglevel short, text string, cnt long"


def stream(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)


def test_first_occurrence_and_repeats(spark):
    rows = [(2, 5, 0, "TextBlock", "Text", 1, "a"), (1, 9, 0, None, "Text", 1, "a"), (1, 9, 0, None, "Text", 1, "a"), (1, 3, 1, "TextBlock", "Text", 1, "a"), (1, 4, 1, "TextBlock", "Text", 1, None)]
    got = {(r.siteindex, r.page_id, r.pos) for r in corpus.site_blocks(stream(spark, rows)).collect()}
    assert got == {(0, 1, 9), (1, 1, 3)}


def test_empty_tables(spark):
    empty = stream(spark, [])
    assert corpus.vocabulary(corpus.site_blocks(empty)).count() == 0
    assert corpus.cumulative_percent(corpus.vocabulary(empty), "word").count() == 0
    assert crawl.novelty(empty.selectExpr("siteindex as site", "page_id as doc", "pos", "text")).count() == 0


def test_cumulative_percent_ties(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 6)], "word string, cnt long")
    got = {r.word: round(r.percent, 6) for r in corpus.cumulative_percent(df, "word").collect()}
    assert got == {"c": 60.0, "a": 80.0, "b": 100.0}


def test_nearest_words(spark):
    words = spark.createDataFrame([("hause",), ("xyz",), ("a",)], "word string")
    entries = spark.createDataFrame([("haus",), ("hause",), ("b",)], "entry string")
    got = {r.word: (r.nearest, r.distance) for r in corpus.nearest_words(words, entries).collect()}
    assert got == {"hause": ("hause", 0), "a": ("b", 1)}


def test_nearest_words_at_any_distance(spark, small):
    words = spark.createDataFrame([("hause",), ("xyzzy",), ("a",), ("московский",), ("東京都",), (None,)], "word string")
    entries = spark.createDataFrame([("haus",), ("hause",), ("b",), ("москва",), ("東京",), (None,)], "entry string")
    got = {r.word: (r.nearest, r.distance) for r in corpus.nearest_words_at_any_distance(words, entries).collect()}
    assert got == {"hause": ("hause", 0), "a": ("b", 1), "xyzzy": ("b", 5), "московский": ("москва", 5), "東京都": ("東京", 1)}
    every = {r.word for r in corpus.vocabulary(queries._blocks(spark, small)).collect()}
    assert {r.word for r in queries.lexicon_tags_all_words(spark, small).collect()} == every
    assert {r.word for r in queries.nearest_lexicon_any_distance(spark, small).collect()} == {r.word for r in spark.createDataFrame([(w,) for w in every], "w string").selectExpr("lower(w) word").collect()}


def test_novelty_counts_texts_once(spark):
    rows = [(0, 1, 0, "ab"), (0, 1, 1, "ab"), (0, 2, 0, "ab"), (0, 2, 1, "cde"), (0, 3, 0, "")]
    df = spark.createDataFrame(rows, "site int, doc long, pos int, text string")
    got = {r.doc: round(r.ratio, 3) for r in crawl.novelty(df).collect()}
    assert got == {1: 0.5, 2: 0.6, 3: 1.0}


def test_frontier_rounds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "z")], "source string, target string")
    got = {r.url: r.depth for r in crawl.frontier_depths(edges, spark.createDataFrame([("a",)], "url string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_request_log_round_trip(spark, small, tmp_path):
    log = crawl.requests_once(spark.read.parquet(f"{small}/requests.parquet"))
    tables.write_request_log(log, str(tmp_path / "log"))
    back = tables.read_request_log(spark, str(tmp_path / "log"))
    assert back.count() == log.count()
    assert back.agg(F.sum("content_size_bytes")).first()[0] == log.agg(F.sum("content_size_bytes")).first()[0]


def test_wiki_text(spark):
    text = "== T ==\n'''Bold''' [[a|b]] {{x}}<ref>r</ref>\n* item"
    assert spark.createDataFrame([(text,)], "t string").select(tables.plain_wiki_text(F.col("t"))).first()[0] == "T\nBold b \nitem"


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n" * 15 + "id\tFlexion\tÉtiquettes\n1\tmaison\tnom fem\n2\tbad\n")
    (tmp_path / "b.txt").write_text("!\tPUNCT\nmaison\tNOUN\nx\n")
    assert [tuple(r) for r in tables.read_inflections(spark, str(tmp_path / "a.txt")).collect()] == [("maison", "NOUN")]
    assert [tuple(r) for r in tables.read_tagged_forms(spark, str(tmp_path / "b.txt")).collect()] == [("maison", "NOUN")]


def test_running_over_split_keys(spark):
    from corpusloom.operators.running import moving_mean, running

    rows = [("a" if i % 3 else None, i, float(i % 7) if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(7)
    got = {r.i: (r.s, r.m, r.n) for r in running(df, ["k"], [F.col("i")], {"s": F.col("v")}, {"m": F.col("v")}, "n").collect()}
    means = {r.i: r.mean for r in moving_mean(df, ["k"], [F.col("i")], "v", 10, "mean").collect()}
    for key in ("a", None):
        seen = []
        for k, i, v in rows:
            if k == key:
                seen.append(v)
                real = [x for x in seen if x is not None]
                last = [x for x in seen[-10:] if x is not None]
                assert got[i] == (sum(real), max(real, default=None), len(seen))
                assert (means[i] is None and not last) or abs(means[i] - sum(last) / len(last)) < 1e-9


def test_bloom_filter_has_no_false_negatives(spark):
    known = spark.createDataFrame([(f"https://h/{i}",) for i in range(300)] + [(None,)], "url string")
    links = spark.createDataFrame([(f"https://h/{i}",) for i in range(200, 1300)] + [(None,)], "url string")
    got = {r.url for r in crawl.maybe_known(links, crawl.bloom_filter(known, 300, 0.01), 300, 0.01).collect()}
    assert {f"https://h/{i}" for i in range(200, 300)} <= got and len(got) < 100 + 60
    assert crawl.bloom_size(1000, 0.01) == (9586, 7)
