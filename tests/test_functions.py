import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.operators import crawl


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("url", "base", "file"),
    [
        ("https://www.a.example.com/en/148.html", "example.com", "en/148.html.nlp.txt"),
        ("https://a.example.org/en/853/", "example.org", "en/853/_default_.nlp.txt"),
        ("http://x.co.uk/", "co.uk", "_default_.nlp.txt"),
        ("http://10.0.0.1/x", "10.0.0.1", "x.nlp.txt"),
    ],
)
def test_urls(spark, url, base, file):
    u = F.col("u")
    assert one(spark, urls.base_domain(u), u=url) == base
    assert one(spark, urls.file_path(u), u=url) == file


def test_query_is_hashed(spark):
    assert one(spark, urls.file_path(F.col("u")), u="http://h.example.com/p?q=1").startswith("p_")


@pytest.mark.parametrize(
    ("pattern", "path", "blocked"),
    [
        ("/authors/", "/authors/x", True), ("/authors/", "/authors", False), ("/*.php$", "/a/b.php", True), ("/*.php$", "/a/b.php?x=1", False),
        ("/a$b", "/a$bc", True), ("/fish*", "/fishheads", True), ("/x", "/robots.txt", True),
    ],
)
def test_robots(spark, pattern, path, blocked):
    allowed = crawl.robots_allowed(F.col("u"), F.array("p"))
    assert one(spark, allowed, u="https://h.example.org" + path, p=pattern) is not blocked


def test_no_rules_allow_all(spark):
    assert one(spark, crawl.robots_allowed(F.col("u"), F.lit(None).cast("array<string>")), u="https://h/robots.txt") is True


def test_robots_groups(spark):
    content = "User-agent: A\nUser-agent: B\nDisallow: /x?\nDisallow:\n# c\nUser-agent: a\nDisallow: /y\nCrawl-delay: 2\nSitemap: s"
    rows = {r.agent: r for r in crawl.robots_rules(spark.createDataFrame([("h", content)], "host string, content string")).collect()}
    assert rows["a"].patterns == ["/x", "/y"] and rows["b"].patterns == ["/x"] and rows["a"].delay == 2.0


def test_resolved(spark):
    df = spark.createDataFrame([("https://a.example.org/d/e", "../f#x"), ("https://a.example.org/", None)], "b string, h string")
    assert [r[0] for r in df.select(urls.resolved("b", "h")).collect()] == ["https://a.example.org/f", None]


def test_config():
    c = crawl.CrawlConfig.parse(["# c", "excludeUrls=/old", "SCOPE=Domain", "rootUrl=https://x/", "maxPageCount=5", "excludeUrls=/a*"])
    assert (c.scope, c.maxpagecount, c.excludeurls) == ("domain", 5, ["/a*"])
    assert crawl.CrawlConfig.parse(c.render()) == c
    with pytest.raises(ValueError):
        crawl.CrawlConfig.parse(["nonsense=1"])


@pytest.mark.parametrize(("tag", "expected"), [("nom masc", "NOUN"), ("prn", "PROPN"), ("pronom", "NOUN"), ("v1", "VERB"), ("zzz", "zzz")])
def test_tags(spark, tag, expected):
    assert one(spark, tx.universal_tag(F.col("t")), t=tag) == expected


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, tx.truncated_title(t), t="x" * 60) == "x" * 47 + "..."
    assert one(spark, tx.escaped_block(t), t="## a\nb") == ". ## a\\nb"
    assert one(spark, tx.context_window(t, "key"), t="a" * 30 + "key" + "b" * 30) == "a" * 20 + "key" + "b" * 18
    assert one(spark, tx.is_number(t), t="1,5") is True
    assert one(spark, tx.capitalised(t), t="abC dE") == "AbC DE"
    assert one(spark, F.size(tx.tokens(t)), t=None) == 0
    assert one(spark, tx.tag_union(F.col("t"), F.col("u")), t="B|A", u=None) == "A|B"


def test_agents_and_excludes(spark):
    rules = crawl.robots_rules(spark.createDataFrame([("h", "User-agent: *\nDisallow: /s\nUser-agent: bingbot\nDisallow: /b"), ("i", "User-agent: *\nDisallow: /s")], "host string, content string"))
    extra = spark.createDataFrame([("h", "/x"), ("k", "/y")], "host string, pattern string")
    got = {r.host: r.patterns for r in crawl.with_excludes(rules, extra).collect()}
    assert got == {"h": ["/b", "/x"], "i": ["/s"], "k": ["/y"]}


def test_outside_the_root_all_is_allowed(spark):
    allowed = crawl.allowed_under_root(F.col("u"), F.col("r"), F.array(F.lit("/a")))
    assert one(spark, allowed, u="http://h/a/x", r="https://h/") is False
    assert one(spark, allowed, u="https://other/a", r="https://h/") is True


def test_observed(spark, small):
    from pyspark.sql import Observation

    o = Observation("crawl")
    n = crawl.observed_crawl(spark.read.parquet(f"{small}/requests.parquet"), o).count()
    assert o.get["requests"] == n
