"""More registered queries of the core: scalar functions over whole tables, and operators whose inputs (markup, robots
files, structured text, page geometry) no table has, over small fixtures with their expected rows as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.html import convert, css, dom
from corpusloom.operators import corpus, crawl, geometry
from corpusloom.plans.queries import _BASE, _HOST, _LINKS, _NOVELTY, _PATH, _R, _ROOT, _T, _TOKENS, _VOCAB, _WORDS, _blocks, _novelty, _once, _requests, _words, query
from corpusloom.plans.session import shared_folder, table
from corpusloom.sources import nlp_format, tables

_DUCK = {"int": "INT", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def expected(schema: str, *rows: tuple) -> str:
    """The rows as SQL, with the types of a Spark schema."""
    fields = [f.split() for f in schema.split(", ")]
    casts = ", ".join(f"{n}::{_DUCK[t]} AS {n}" for n, t in fields)
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"SELECT {casts} FROM (VALUES {values}) v({', '.join(n for n, _ in fields)})"


def _fixture_folder(spark: SparkSession, files: dict[str, str]) -> str:
    """A folder of text files in the shared folder."""
    folder = f"{shared_folder(spark)}/fixture-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, text in files.items():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
        out.write(bytearray(text.encode()))
        out.close()
    return folder


# scalar functions over tables


@query(
    f"""SELECT page_id, {_BASE.format('uri')} AS domain_name, {_HOST.format('uri')} AS subdomain_name,
        replace({_HOST.format('uri')} || {_ROOT.format('uri')}, '/', '_') AS path_name FROM nlpdocs"""
)
def storage_names(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("uri")
    return table(spark, d, "nlpdocs").select("page_id", *(urls.storage_name(u, s).alias(f"{s}_name") for s in ("domain", "subdomain", "path")))


@query(
    rf"""SELECT page_id, substr({_HOST.format('uri')} || '_' || regexp_replace(replace({_PATH.format('uri')} || coalesce(regexp_extract(uri, '(\?[^#]*)', 1), ''), '/', '_'),
        '[<>:"|?*\\]', '_', 'g'), 1, 100) AS name FROM nlpdocs"""
)
def flat_file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nlpdocs").select("page_id", urls.flat_name(F.col("uri")).alias("name"))


_PATHS = [("/a%20b/c", "/a b/c"), ("/x.../y..", "/x/y.."), ("/q<1>|*?", "/q_1____"), ("/a+b", "/a+b"), ("/%zz", "/%zz"), ("/", "/")]


@query(expected("path string, clean string", *_PATHS))
def sanitised_paths(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p, _ in _PATHS], "path string").select("path", urls.sanitised(F.col("path")).alias("clean"))


@query(f"SELECT request_id, regexp_replace(regexp_replace(split_part(redirected_from, '#', 1), '%20$', ''), '\\s+$', '') AS target FROM {_R} WHERE redirected_from IS NOT NULL")
def redirect_targets(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).where("redirected_from IS NOT NULL").select("request_id", urls.repaired_redirect(F.col("redirected_from")).alias("target"))


_HREFS = [
    ("http://h.org/a/b", "c?x=1#y", "http://h.org/a/c?x=1"), ("http://h.org/a/b", "/r", "http://h.org/r"), ("http://h.org/a/", "../z", "http://h.org/z"),
    ("http://h.org/a/b", "//o.org/p", "http://o.org/p"), ("https://h.org", "#top", "https://h.org"), ("http://h.org/a", None, None),
]


@query(expected("base string, href string, url string", *_HREFS))
def hrefs_resolved(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in _HREFS], "base string, href string")
    return rows.select("base", "href", urls.resolved("base", "href").alias("url"))


_BASES = [("https://a.org/x", "//b.org/", "https://b.org/"), ("https://a.org/x", "/rel/", "https://a.org/x"), ("https://a.org/x", "http://c.org/y/", "http://c.org/y/")]


@query(expected("page string, href string, base string", *_BASES))
def base_hrefs(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in _BASES], "page string, href string")
    return rows.select("page", "href", urls.base_href(F.col("page"), F.col("href")).alias("base"))


_DELAYS = [("120", 120.0), ("1.5", 1.5), ("Thu, 01 Jan 1970 00:01:00 GMT", 60.0), ("soon", None)]


@query(expected("value string, seconds double", *_DELAYS))
def retry_after_values(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(v,) for v, _ in _DELAYS], "value string")
    return rows.select("value", tx.retry_after_seconds(F.col("value"), F.timestamp_seconds(F.lit(0))).alias("seconds"))


_TAG_CASE = "CASE " + " ".join(f"WHEN contains(leffftags, '{part}') THEN '{name}'" for name, parts in tx.TAG_RULES for part in parts) + " ELSE leffftags END"


@query(f"SELECT word, lang, {_TAG_CASE} AS tag FROM vocabulary WHERE leffftags IS NOT NULL")
def universal_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocabulary").where("leffftags IS NOT NULL").select("word", "lang", tx.universal_tag(F.col("leffftags")).alias("tag"))


@query("SELECT page_id, CASE WHEN length(title) > 47 THEN substr(title, 1, 47) || '...' ELSE title END AS short FROM nlpdocs WHERE title IS NOT NULL")
def titles_truncated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nlpdocs").where("title IS NOT NULL").select("page_id", tx.truncated_title(F.col("title")).alias("short"))


@query(
    "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[  \\t\\r\\n]+'), lambda w: w <> ''))::INT AS words, list_filter(regexp_split_to_array(text, '[  \\t\\r\\n]+'), lambda w: w <> '')[1] AS first_word "
    "FROM documents WHERE text IS NOT NULL"
)
def space_words_count(spark: SparkSession, d: str) -> DataFrame:
    w = tx.space_words(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(w).alias("words"), F.get(w, F.lit(0)).alias("first_word"))


_CASES = [("mon petit chat", "MON PETIT CHAT", "mon petit chat", "Mon Petit Chat"), ("éTé à LA mer", "ÉTÉ À LA MER", "été à la mer", "ÉTé À LA Mer"), ("", "", "", "")]


@query(expected("text string, up string, low string, cap string", *_CASES))
def text_transforms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return spark.createDataFrame([r[:1] for r in _CASES], "text string").select("text", F.upper(t).alias("up"), F.lower(t).alias("low"), tx.capitalised(t).alias("cap"))


_CHARSET_SQL = f"(SELECT ch, sum(cnt)::BIGINT AS cnt FROM (SELECT unnest(string_split(word, '')) AS ch, cnt FROM {_VOCAB}) WHERE ch <> '' GROUP BY ch)"


@query(
    rf"""SELECT ch, unicode(ch)::INT AS code, (unicode(ch) % 256)::INT AS luminance, regexp_matches(ch, '^\p{{L}}$') AS is_alpha, regexp_matches(ch, '^\p{{Nd}}$') AS is_digit,
        regexp_matches(ch, '^[\s\p{{Z}}]$') AS is_space FROM {_CHARSET_SQL}"""
)
def charset_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes and classes of the corpus's characters, and their luminance in a character image."""
    chars = corpus.charset_table(corpus.charset(corpus.vocabulary(_blocks(spark, d))))
    return chars.select("ch", "code", tx.luminance(F.col("ch")).cast("int").alias("luminance"), "is_alpha", "is_digit", "is_space")


@query("""SELECT doc_id, regexp_replace('"' || text || '"', '^"+|"+$', '', 'g') AS plain FROM documents WHERE text IS NOT NULL""")
def json_strings_unwrapped(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), F.col("text"), F.lit('"'))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tx.unwrapped_json_string(quoted).alias("plain"))


_SENTENCES = [("One. Two! Three?", 0, "One."), ("One. Two! Three?", 1, "Two!"), ("One. Two! Three?", 2, "Three?"), ("v1.2 is out\nend", 0, "v1.2 is out"), ("v1.2 is out\nend", 1, "end")]


@query(expected("text string, place int, sentence string", *_SENTENCES))
def plain_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in sorted({r[0] for r in _SENTENCES})], "text string")
    return rows.select("text", F.posexplode(tx.sentences(F.col("text"))).alias("place", "sentence"))


@query(
    f"""WITH t AS (SELECT list_filter({_TOKENS.format('text')}, lambda x: true) AS t, text FROM {_T} WHERE (docelttype IS DISTINCT FROM 'Document' OR doceltcmd = 'Title')
             AND doceltcmd <> 'End' AND contains(text, '-')),
        p AS (SELECT t, list_position(t, '-') AS k FROM t)
        SELECT true AS own, CASE WHEN k > 1 THEN '<<' || t[k - 1] END AS "before", CASE WHEN k < len(t) THEN t[k + 1] || '>>' END AS "after", count(*) AS n
        FROM p WHERE k > 0 GROUP BY ALL"""
)
def separator_own_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The tokens around the first hyphen of a block (a hyphen always is a token of its own here)."""
    s = corpus.separator_neighbours(F.col("text"), "-")
    rows = corpus.interesting(_once(spark, d, "docelttype", "doceltcmd", "text")).where(F.col("text").contains("-")).select(s.alias("s")).where("s IS NOT NULL")
    return rows.groupBy("s.own", "s.before", "s.after").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT site, doc FROM {_NOVELTY} WHERE ratio > 0")
def documents_worth_writing(spark: SparkSession, d: str) -> DataFrame:
    """Documents with anything new on their site."""
    return _novelty(spark, d).where("ratio > 0").select("site", "doc")


@query("SELECT page_id, w.website || '/' || n.page_id AS file FROM nlpdocs n JOIN websites w USING (siteindex)")
def site_directories(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "nlpdocs").join(table(spark, d, "websites"), "siteindex")
    return pages.select("page_id", F.concat("website", F.lit("/"), F.col("page_id").cast("string")).alias("file"))


@query(f"SELECT request_id, printf('%.1f', round(content_size_bytes / 1048576.0::DOUBLE, 1)) || ' MB' AS size FROM {_R} WHERE content_size_bytes IS NOT NULL")
def sizes_in_megabytes(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).where("content_size_bytes IS NOT NULL").select("request_id", corpus.megabytes(F.col("content_size_bytes")).alias("size"))


_PIECES = [("abab", 2), ("ab", 3), ("b", 1)]


@query(expected("piece string, n bigint", ("a", 7), ("ab", 7), ("b", 8), ("ba", 2), ("aba", 2), ("bab", 2), ("abab", 2)))
def pieces_trained(spark: SparkSession, d: str) -> DataFrame:
    """Unigram pieces of a small vocabulary: their occurrences from the trained probabilities."""
    pieces = corpus.trained_pieces(spark.createDataFrame(_PIECES, "word string, cnt bigint"))
    return pieces.select("piece", F.round(F.exp("logprob") * 30).cast("bigint").alias("n"))


_SEGMENTS = [(1, "abab b", "ab|ab|b"), (2, "abx", "ab|x"), (3, "", "")]


@query(expected("doc_id bigint, segments string", *((i, s) for i, _, s in _SEGMENTS)))
def unigram_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(i, t) for i, t, _ in _SEGMENTS], "doc_id bigint, text string")
    return corpus.unigram_segments(rows, {"a": -3.0, "b": -3.0, "ab": -1.0}).select("doc_id", F.array_join("segments", "|").alias("segments"))


_SPOKEN = [("le chat dort sur la table de la maison", "fr"), ("la maison de mon ami est sur la route", "fr"), ("the cat sleeps on the table of the house", "en"), ("the house of my friend is on the road", "en")]


@query(expected("id bigint, lang string", (1, "fr"), (2, "en")))
def languages_detected(spark: SparkSession, d: str) -> DataFrame:
    """A classifier of character trigrams on sentences it hasn't seen."""
    profiles = corpus.trigram_profiles(spark.createDataFrame(_SPOKEN, "text string, lang string"))
    texts = spark.createDataFrame([(1, "mon chat est dans la maison"), (2, "my cat is in the house"), (3, "12 !?"), (4, None)], "id bigint, text string")
    return corpus.detected_languages(texts, profiles, "id").select("id", "lang")


# crawl


@query(
    f"""SELECT request_id, CASE WHEN status_code = 'OK' AND coalesce(content_size_bytes, 0) <= 10000000 THEN CASE WHEN suffix(lower(url), '.pdf') THEN 'Pdf' ELSE 'Html' END END AS kind FROM {_R}"""
)
def download_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What would be kept of every request, the type told by the address."""
    kind = F.when(F.lower("url").endswith(".pdf"), "application/pdf").otherwise("text/html")
    return _requests(spark, d).select("request_id", crawl.should_download(F.col("status_code"), kind, F.col("content_size_bytes")).alias("kind"))


_FOLLOW = [("nofollow", " NoFollow ", True, True), ("noindex, NOFOLLOW", "nofollow noopener", True, False), ("none", "", True, False), ("all", "canonical", False, False), (None, None, False, False)]


@query(expected("robots string, rel string, page boolean, link boolean", *_FOLLOW))
def nofollow_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in _FOLLOW], "robots string, rel string")
    return rows.select("robots", "rel", crawl.nofollow_page(F.col("robots")).alias("page"), crawl.nofollow_link(F.col("rel")).alias("link"))


_CONFIG = ["# a crawl", "Scope=path", "ROOTURL = http://a.org/x", "maxPageCount=50", "excludeUrls=/p/*", "excludeUrls=/q=1"]


@query(expected("key string, value string", ("scope", "path"), ("rooturl", "http://a.org/x"), ("maxpagecount", "50"), ("excludeurls", "/p/*"), ("excludeurls", "/q"), ("minuniquetext", "10"), ("mincrawldelay", "100")))
def config_settings(spark: SparkSession, d: str) -> DataFrame:
    """A settings file read and written again; a value ends at its second equals sign, defaults fill the rest."""
    rows = [tuple(line.split("=", 1)) for line in crawl.CrawlConfig.parse(_CONFIG).render()]
    return spark.createDataFrame(rows, "key string, value string").where("value NOT IN ('', '0')")


@query(f"SELECT request_id, url, coalesce(crawl_depth, 0) = 0 AS root_replaced, {_HOST.format('url')} <> {_HOST.format('redirected_from')} AS cross_host FROM {_R} WHERE redirected_from <> url")
def redirects_followed(spark: SparkSession, d: str) -> DataFrame:
    return crawl.followed_redirects(_requests(spark, d))


@query(
    f"""WITH f AS (SELECT r.siteindex, coalesce(crawl_depth, 0) + 1 AS crawl_depth, split_part(coalesce(redirected_from, parent_url), '#', 1) AS url FROM {_R} r
             WHERE status_code = 'OK' AND coalesce(crawl_depth, 0) < 100 AND coalesce(redirected_from, parent_url) IS NOT NULL)
        SELECT f.siteindex, f.url, min(f.crawl_depth)::INT AS crawl_depth FROM f JOIN websites w USING (siteindex)
        WHERE f.url <> '' AND {_HOST.format('f.url')} = {_HOST.format('w.rooturl')} AND f.url NOT IN (SELECT uri FROM nlpdocs WHERE uri IS NOT NULL) GROUP BY ALL"""
)
def pages_scheduled(spark: SparkSession, d: str) -> DataFrame:
    """A round of the page pipeline over the log, with each request's related address as its only link."""
    fetched = _requests(spark, d).select("siteindex", "url", "crawl_depth", "status_code", F.array(F.coalesce("redirected_from", "parent_url")).alias("links"))
    fetched = fetched.withColumn("links", F.filter("links", lambda x: x.isNotNull()))
    known = table(spark, d, "nlpdocs").where("uri IS NOT NULL").select(F.col("uri").alias("url"))
    sites = table(spark, d, "websites").withColumn("scope", F.lit("subdomain"))
    return crawl.page_pipeline(fetched, known, sites).select("siteindex", "url", F.col("crawl_depth").cast("int").alias("crawl_depth"))


@query(f"SELECT url FROM {_LINKS} WHERE url NOT IN (SELECT uri FROM nlpdocs WHERE uri IS NOT NULL)")
def links_new_exact(spark: SparkSession, d: str) -> DataFrame:
    links = _requests(spark, d).where("url IS NOT NULL").select(urls.without_fragment(F.col("url")).alias("url"))
    return crawl.new_exact(links, table(spark, d, "nlpdocs").where("uri IS NOT NULL").select(F.col("uri").alias("url")))


@query(f"SELECT DISTINCT url FROM {_R} WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM {_R} WHERE url IS NOT NULL AND status_code = 'OK')")
def frontier_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the log without an answer, with which a stopped crawl goes on."""
    log = _requests(spark, d).where("url IS NOT NULL").select("url", "status_code")
    return crawl.resumed_frontier(log.select("url"), log.where("status_code = 'OK'").select("url"))


@query(
    f"""SELECT siteindex, n || ' pages' AS pages, e || ' errors' AS errors, printf('%.1f', b / 1048576.0::DOUBLE) || ' MB' AS size
        FROM (SELECT siteindex, count_if(status_code = 'OK') AS n, count(error_message) AS e, sum(coalesce(content_size_bytes, 0)) AS b FROM {_R} GROUP BY siteindex)"""
)
def progress_lines(spark: SparkSession, d: str) -> DataFrame:
    c = crawl.crawl_counters(_requests(spark, d))
    line = F.split(crawl.progress_line(F.lit(0), F.col("pages"), F.col("errors"), F.lit(0.5), F.coalesce("bytes", F.lit(0))), r" \| ")
    return c.select("siteindex", line[1].alias("pages"), line[2].alias("errors"), line[4].alias("size"))


_ROBOTS = "User-agent: a\nUser-Agent: B # two\nDisallow: /x??\nAllow: /x/y\nCrawl-delay: 2.5\n\nUser-agent: *\nDisallow:\nDisallow: /z\nSitemap: http://h/s.xml\nUser-agent: a\nDisallow: /w"


@query(expected("agent string, patterns string, delay double, sitemaps string", ("a", "/w,/x", 2.5, ""), ("b", "/x", 2.5, ""), ("*", "/z", None, "http://h/s.xml")))
def robots_groups_parsed(spark: SparkSession, d: str) -> DataFrame:
    rules = crawl.robots_rules(spark.createDataFrame([("h", _ROBOTS)], "host string, content string"))
    return rules.select("agent", F.array_join("patterns", ",").alias("patterns"), "delay", F.array_join("sitemaps", ",").alias("sitemaps"))


@query(expected("agent string, patterns string, root boolean", ("A", "/w,/x", True), ("other", "/z", True)))
def robots_agents_chosen(spark: SparkSession, d: str) -> DataFrame:
    """The rules of an agent: its own group whatever its case, else that of *; and whether it may read the root."""
    rules = crawl.robots_rules(spark.createDataFrame([("h", _ROBOTS)], "host string, content string"))
    one = lambda a: crawl.agent_rules(rules, a).join(crawl.agent_allowed_at_root(rules, a), "host").select(F.lit(a).alias("agent"), F.array_join("patterns", ",").alias("patterns"), F.col("allowed").alias("root"))
    return one("A").unionByName(one("other"))


_PATTERNS = [
    ("/authors/", "/authors/x", False), ("/authors/", "/authors", True), ("/*.php$", "/a/b.php", False), ("/*.php$", "/a/b.php?x=1", True), ("/a$b", "/a$bc", False),
    ("/fish*", "/fishheads", False), ("/z", "/robots.txt", False), ("/p", "/", True),
]


@query(expected("pattern string, path string, allowed boolean", *_PATTERNS))
def robots_patterns_matched(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in _PATTERNS], "pattern string, path string")
    return rows.select("pattern", "path", crawl.robots_allowed(F.concat(F.lit("http://h.org"), "path"), F.array("pattern")).alias("allowed"))


@query(expected("host string, patterns string, url string, allowed boolean", ("h", "/w,/x,/q", "https://h/q1", False), ("h", "/w,/x,/q", "http://o/q1", True), ("h", "/w,/x,/q", "http://h/ok", True)))
def robots_with_excludes(spark: SparkSession, d: str) -> DataFrame:
    """Extra exclusions of the settings join an agent's rules; addresses outside the root aren't its business."""
    rules = crawl.robots_rules(spark.createDataFrame([("h", _ROBOTS)], "host string, content string"))
    mine = crawl.with_excludes(rules, spark.createDataFrame([("h", "/q")], "host string, pattern string"), "a")
    pages = mine.crossJoin(spark.createDataFrame([("https://h/q1",), ("http://o/q1",), ("http://h/ok",)], "url string"))
    allowed = crawl.allowed_under_root(F.col("url"), F.lit("http://h/"), F.col("patterns"))
    return pages.select("host", F.array_join("patterns", ",").alias("patterns"), "url", allowed.alias("allowed"))


@query("SELECT siteindex, CASE WHEN least(mincrawldelay * 3, 5000) > mincrawldelay THEN least(mincrawldelay * 3, 5000) ELSE mincrawldelay END::INT AS delay_ms FROM websites")
def crawl_delays(spark: SparkSession, d: str) -> DataFrame:
    """Delays if every robots file asked for three times the site's minimum."""
    low = F.coalesce("mincrawldelay", F.lit(0))
    return table(spark, d, "websites").select("siteindex", crawl.crawl_delay_ms(low * 3 / 1000.0, low).alias("delay_ms"))


@query(expected("entries bigint, rate double, bits bigint, hashes int", (100, 0.01, 959, 7), (2000001, 0.001, 28755190, 10)))
def bloom_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, p, *crawl.bloom_size(n, p)) for n, p in ((100, 0.01), (2_000_001, 0.001))]
    return spark.createDataFrame(rows, "entries bigint, rate double, bits bigint, hashes int")


@query("SELECT count(DISTINCT split_part(uri, '#', 1)) AS known, 0::BIGINT AS missed FROM nlpdocs WHERE uri IS NOT NULL")
def bloom_has_no_misses(spark: SparkSession, d: str) -> DataFrame:
    """All addresses of the corpus against a Bloom filter of them."""
    known = table(spark, d, "nlpdocs").where("uri IS NOT NULL").select(urls.without_fragment(F.col("uri")).alias("url")).distinct()
    hit = crawl.maybe_known(known, crawl.bloom_filter(known))
    n = known.agg(F.count(F.lit(1)).alias("known"))
    return n.crossJoin(hit.agg(F.count(F.lit(1)).alias("hit"))).select("known", (F.col("known") - F.col("hit")).alias("missed"))


@query(f"SELECT siteindex, count(*) AS errors, max(clock) AS latest FROM {_R} WHERE error_message IS NOT NULL GROUP BY siteindex")
def latest_errors(spark: SparkSession, d: str) -> DataFrame:
    bad = _requests(spark, d).where("error_message IS NOT NULL")
    return bad.groupBy("siteindex").agg(F.count(F.lit(1)).alias("errors"), F.max("clock").alias("latest"))


@query(
    f"""WITH x AS (SELECT siteindex, request_id, clock, row_number() OVER w AS seq, sum(coalesce(content_size_bytes, 0)) OVER u AS bytes, min(clock) OVER (PARTITION BY siteindex) AS begun FROM {_R}
             WINDOW w AS (PARTITION BY siteindex ORDER BY clock NULLS FIRST, request_id), u AS (PARTITION BY siteindex ORDER BY clock NULLS FIRST, request_id ROWS UNBOUNDED PRECEDING)),
        y AS (SELECT siteindex, seq, CASE WHEN (epoch_us(clock) // 1000000 - epoch_us(begun) // 1000000) // 60 >= 30 THEN 'duration' WHEN bytes >= 300000 THEN 'size' END AS reason FROM x)
        SELECT siteindex, min(seq)::INT AS seq, arg_min(reason, seq) AS reason FROM y WHERE reason IS NOT NULL GROUP BY siteindex"""
)
def stops_by_duration_or_size(spark: SparkSession, d: str) -> DataFrame:
    """Where crawls of half an hour or 300,000 bytes at most would have ended, without other conditions."""
    sites = table(spark, d, "websites").select("siteindex", F.lit(None).cast("int").alias("maxpagecount"), F.lit(0).alias("minuniquetext"))
    return crawl.first_stop(_requests(spark, d), sites, max_errors=2**31 - 1, max_minutes=30, max_bytes=300_000).select("siteindex", "seq", "reason")


@query(
    f"""WITH n AS (SELECT request_id, url, row_number() OVER (PARTITION BY siteindex ORDER BY request_id) - 1 AS before FROM {_R} WHERE regexp_matches(lower(url), '^https?://'))
        SELECT request_id, CASE WHEN before >= 20 THEN 'too many pages of the domain' END AS reason FROM n"""
)
def crawl_capped_by_domain(spark: SparkSession, d: str) -> DataFrame:
    """Requests beyond the twentieth of their site, by the page predicate with a cap."""
    from corpusloom.operators.running import running

    rows = running(_requests(spark, d).where(F.lower("url").rlike("^https?://")).select("siteindex", "request_id", "url"), ["siteindex"], [F.col("request_id")], seq="n")
    verdict = crawl.should_crawl(F.col("url"), F.col("url"), F.lit("subdomain"), F.lit(0), F.lit(0), domain_pages=F.col("n") - 1, max_domain_pages=20)
    return rows.select("request_id", verdict["reason"].alias("reason"))


# sources and sinks


@query(f"SELECT siteindex, count(*) AS n, sum(coalesce(content_size_bytes, 0))::BIGINT AS bytes, count(error_message) AS errors FROM {_R} GROUP BY siteindex")
def request_log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The log written as semicolon-separated lines and read again."""
    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    tables.write_request_log(_requests(spark, d), folder)
    log = tables.read_request_log(spark, folder)
    return log.groupBy("siteindex").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("content_size_bytes", F.lit(0))).alias("bytes"), F.count("error_message").alias("errors"))


_LEXICON = "\n".join([*(f"line {i}" for i in range(15)), "id\tFlexion\tLemme\tÉtiquettes", "1\tchats\tchat\tnom mas pl", "2\tva\taller\tv3_i_t 3sg", "3\trouge\trouge\tadj epi sg"])


@query(expected("token string, tag string", ("chats", "NOUN"), ("va", "VERB"), ("rouge", "ADJ")))
def lexicon_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_inflections(spark, _fixture_folder(spark, {"lexicon.txt": _LEXICON}))


@query(expected("token string, tag string", ("chat", "nc"), ("bleu", "adj")))
def tagged_forms_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first line is taken for a header and lost; lines with one cell are skipped."""
    return tables.read_tagged_forms(spark, _fixture_folder(spark, {"forms.txt": "lost\tx\nchat\tnc\nbad\nbleu\tadj"}))


@query(expected("url string", ("http://a.org/",), ("http://b.org/x",)))
def site_urls_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_site_urls(spark, _fixture_folder(spark, {"sites.txt": '"http://a.org/",\n\n  \'http://b.org/x\'\n'}))


@query(expected("entry string", ("CHAT",), ("ÉTÉ",)))
def dictionary_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_dictionary(spark, _fixture_folder(spark, {"words.txt": "# comment\nchat\n\n été \n"}))


_DUMP = (
    "<mediawiki><page><title>A</title><revision><timestamp>2020-01-01T00:00:00Z</timestamp><contributor><username>u</username></contributor>"
    "<text>'''A''' is [[b|the b]] {{t}}.</text></revision></page><page><title>R</title><revision><timestamp>x</timestamp><contributor><username>v</username></contributor>"
    "<text>#REDIRECT [[A]]</text></revision></page></mediawiki>"
)


@query(expected("title string, username string, plain string", ("A", "u", "A is the b .")))
def wiki_dump_scan(spark: SparkSession, d: str) -> DataFrame:
    dump = tables.read_wiki_dump(spark, _fixture_folder(spark, {"dump.xml": _DUMP}))
    return dump.select("title", "username", tables.plain_wiki_text(F.col("text")).alias("plain"))


_FILE = (
    "## NLPTextDocument Title My page\n## NLPTextDocument Uri http://a.org/\n## NLPTextDocument Timestamp 01/02/2020 03:04:05\n## NLPTextDocument Metadata k=v=w\n\n"
    "## 1 Section Start Head\nfirst\\nsecond\n. ## no mark\n## 2 List Items Fruits >> apple || pear\n## 2 Table Start\n## 3 TableHeader Start 1,1\nh\n## 3 TableHeader End\n"
    "## 3 TableCell Start 2:1,1:2\nc\n## 3 TableCell End\n## 2 Table End\n## 1 Section End <<Head>>"
)
_ROWS = [
    (0, "Document", "Start", 1, None, None), (1, "Document", "Title", 1, "My page", None), (2, "Document", "Uri", 1, "http://a.org/", None), (3, "Section", "Start", 1, "Head", None),
    (4, "TextBlock", "Text", 1, "first\nsecond", None), (5, "TextBlock", "Text", 1, ". ## no mark", None), (6, "List", "Start", 2, "Fruits", None), (7, "ListItem", "Text", 3, "apple", None),
    (8, "ListItem", "Text", 3, "pear", None), (9, "List", "End", 2, None, None), (10, "Table", "Start", 2, None, None), (11, "TableHeader", "Start", 3, None, "1,1"), (12, "TextBlock", "Text", 3, "h", None),
    (13, "TableHeader", "End", 3, None, None), (14, "TableCell", "Start", 3, None, "2:1,1:2"), (15, "TextBlock", "Text", 3, "c", None), (16, "TableCell", "End", 3, None, None), (17, "Table", "End", 2, None, None),
    (18, "Section", "End", 1, None, None), (19, "Document", "End", 1, None, None),
]
_ROW_SCHEMA = "pos int, docelttype string, doceltcmd string, nestinglevel int, text string, coords string"


def _shown(rows: DataFrame) -> DataFrame:
    at_ends = (F.col("docelttype") == "Document") & F.col("doceltcmd").isin("Start", "End")
    return rows.select("pos", "docelttype", "doceltcmd", "nestinglevel", F.when(~at_ends, F.col("text")).alias("text"), "coords")


@query(expected(_ROW_SCHEMA, *_ROWS))
def structured_text_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Element rows of a structured text file, read from a folder."""
    return _shown(nlp_format.load_documents(spark, _fixture_folder(spark, {"site/page.nlp.txt": _FILE, "other.txt": "no"})))


@query(expected(_ROW_SCHEMA, *_ROWS))
def structured_text_files(spark: SparkSession, d: str) -> DataFrame:
    """The same rows written to files by the writer, and these read again."""
    rows = nlp_format.parse_documents(spark.createDataFrame([("site/page", _FILE)], "doc string, value string"))
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    nlp_format.write_documents(rows, folder)
    return _shown(nlp_format.load_documents(spark, folder))


@query(expected("title string, uri string, stamp string, v string", ("My page", "http://a.org/", "01/02/2020 03:04:05", "v=w")))
def structured_text_properties(spark: SparkSession, d: str) -> DataFrame:
    m = nlp_format.document_metadata(spark.createDataFrame([("f", _FILE)], "doc string, value string"))
    return m.select("title", "uri", F.col("timestamp").alias("stamp"), F.col("metadata")["k"].alias("v"))


_BODIES = [(1, "é".encode("latin-1"), "text/html; charset=iso-8859-1", "é"), (2, "<meta charset=utf-8>é".encode(), "text/html", "<meta charset=utf-8>é"), (3, "ж".encode("cp1251"), "text/html; charset=windows-1251", "ж")]


@query(expected("id int, text string", *((r[0], r[3]) for r in _BODIES)))
def bodies_decoded(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([r[:3] for r in _BODIES], "id int, body binary, kind string")
    return rows.select("id", convert.decoded_body("body", "kind").alias("text"))


@query("SELECT word, lang FROM vocabulary")
def table_cached(spark: SparkSession, d: str) -> DataFrame:
    """A table made once and read again from its file."""
    path = f"{shared_folder(spark)}/cached-{uuid.uuid4().hex}"
    make = lambda: table(spark, d, "vocabulary").select("word", "lang")
    corpus.cached_table(make, spark, path)
    return corpus.cached_table(make, spark, path)


@query("SELECT word, cnt FROM vocabulary WHERE NOT contains(word, ';') AND NOT contains(word, '\"')")
def table_as_csv(spark: SparkSession, d: str) -> DataFrame:
    """A table written as semicolon-separated lines with a header and read again."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    corpus.write_csv(table(spark, d, "vocabulary").select("word", "cnt").where("NOT contains(word, ';') AND NOT contains(word, '\"')"), folder)
    return spark.read.option("sep", ";").option("header", True).schema("word string, cnt bigint").csv(folder)


# pages

_CASES_HTML = [
    ("mixed", "<div>a<p>b</p>c</div>", "b|a c"), ("br", "<p>a<br>b</p>", "a b"), ("inline", "<p>wor<b>d</b>.</p>", "wor d ."), ("twice", "<p>x &amp;lt; y</p>", "x < y"),
    ("hidden", '<p class="login">x</p><p>y</p>', "y"), ("aria", '<p aria-hidden="false">x</p>', None), ("alt", '<p><img alt="pic"> t</p>', "pic t"), ("link", '<p><a href="/" title="T"></a></p>', "T"),
    ("skip", "<p>a</p><script>b</script><style>c</style><noscript>d</noscript><svg><text>e</text></svg>", "a"), ("open", "<p>one<p>two", "one|two"),
    ("style", "<style>span{display:block}</style><p>a<span>b</span></p>", "b|a"), ("media", "<style>@media print{span{display:block}}</style><p>a<span>b</span></p>", "a b"),
    ("important", "<style>span{display:inline!important}span.x{display:block}</style><p>a<span class=x>b</span></p>", "a b"),
    ("specific", "<style>p span{display:block}span{display:inline}</style><p>a<span>b</span></p>", "b|a"),
]


@query(expected("name string, blocks string", *((n, b) for n, _, b in _CASES_HTML if b)))
def html_micro_cases(spark: SparkSession, d: str) -> DataFrame:
    """The text blocks of small pages, in order."""
    pages = spark.createDataFrame([(i, n, h) for i, (n, h, _) in enumerate(_CASES_HTML)], "page_id bigint, url string, html string")
    rows = convert.page_elements(pages).where("docelttype = 'TextBlock'").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "|").alias("blocks"))
    return rows.join(pages.select("page_id", F.col("url").alias("name")), "page_id").select("name", "blocks")


_GOLDEN = (
    "<html><head><title>Reo. Nd.</title><style>p{color:red}</style></head><body><nav><ul><li><a href=/en>En</a></li><li><a href=/la>la</a></li></ul></nav><div class=ad>Asc</div>"
    "<article><h1>Reo. Nd.</h1><p><b>Reo. Nd.<br></article><footer>© blog</footer><script>'</p>'</script></body></html>"
)
_GOLDEN_ROWS = [
    ("Document", "Start", 1, None), ("Document", "Title", 1, "Reo. Nd."), ("Document", "Uri", 1, "http://x/"), ("NavigationList", "Start", 1, None), ("ListItem", "Start", 2, None), ("TextBlock", "Text", 3, "En"),
    ("ListItem", "End", 2, None), ("ListItem", "Start", 2, None), ("TextBlock", "Text", 3, "la"), ("ListItem", "End", 2, None), ("NavigationList", "End", 1, None), ("TextBlock", "Text", 1, "Asc"),
    ("Section", "Start", 1, "Reo. Nd."), ("TextBlock", "Text", 2, "Reo. Nd."), ("Section", "End", 1, None), ("TextBlock", "Text", 1, "© blog"), ("Document", "End", 1, None),
]


def _page(spark: SparkSession, html: str, url: str = "http://x/") -> DataFrame:
    return spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")


@query(expected("pos int, docelttype string, doceltcmd string, nestinglevel int, text string", *((i, *r) for i, r in enumerate(_GOLDEN_ROWS))))
def html_golden_page(spark: SparkSession, d: str) -> DataFrame:
    """A page with a menu, an advertisement, an article with unclosed markup and a footer."""
    return convert.page_elements(_page(spark, _GOLDEN)).drop("page_id", "coords")


_SECTIONS = "<h1>A</h1><p>a</p><div><p>x</p><h2>B</h2><p>b</p></div><div><h2>C</h2></div><h1>D</h1>"


@query(expected("pos int, doceltcmd string, nestinglevel int, text string", (3, "Start", 1, "A"), (5, "Start", 2, "B"), (8, "End", 2, None), (9, "Start", 2, "C"), (10, "End", 2, None), (11, "End", 1, None), (12, "Start", 1, "D"), (13, "End", 1, None)))
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections by heading level; a container opens its heading's section before its first content."""
    return convert.page_elements(_page(spark, _SECTIONS)).where("docelttype = 'Section'").select("pos", "doceltcmd", "nestinglevel", "text")


_TABLE = "<table><caption>c</caption><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>d</td></tr><tr><th colspan=2>e</th></tr></table>"


@query(expected("docelttype string, coords string, text string", ("TableCell", "1:2,1:1", "a"), ("TableCell", "1,2", "b"), ("TableCell", "2,2", "d"), ("TableHeader", "3:1,1:2", "e")))
def html_table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of table cells beside spans, with their texts; a caption is dropped."""
    rows = convert.page_elements(_page(spark, _TABLE))
    starts = rows.where("coords IS NOT NULL").select("pos", "docelttype", "coords")
    return starts.join(rows.select((F.col("pos") - 1).alias("pos"), "text"), "pos").select("docelttype", "coords", "text")


_LISTS = "<ul><li><a href=a>A</a></li><li><a href=b>B</a> <a href=c>C</a></li></ul><ul>stray<li>i</li></ul><ol><li><a href=d>D</a><p>p</p><p>q</p></li></ol>"


@query(expected("docelttype string, text string", ("NavigationList", None), ("TextBlock", "A"), ("TextBlock", "B C"), ("List", None), ("TextBlock", "i"), ("List", None), ("TextBlock", "p"), ("TextBlock", "q"), ("TextBlock", "D"), ("TextBlock", "stray")))
def html_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of nothing but links are navigation; stray text of a list flows to the block around it."""
    rows = convert.page_elements(_page(spark, _LISTS)).where("docelttype IN ('List', 'NavigationList', 'TextBlock') AND doceltcmd <> 'End'")
    return rows.select("docelttype", "text")


_LINKED = "<link rel=canonical href=/c><a href=/a#x>1</a><a href=/a>2</a><area href='b?q=1' rel=NoFollow><a href='http://o.org/'>3</a><a>4</a>"


@query(expected("url string, rel string", ("http://x/c", "canonical"), ("http://x/a", ""), ("http://x/b?q=1", "NoFollow"), ("http://o.org/", "")))
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of anchors, areas and canonical links, absolute and each once."""
    return convert.page_links(_page(spark, _LINKED)).select("url", F.coalesce("rel", F.lit("")).alias("rel"))


_TREES = [
    ("<p><b>a<p>c", "p(b(a))p(b(c))"), ("<ul><li>a<li>b</ul>", "ul(li(a)li(b))"), ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt(a)dd(b)dt(c))"), ("<table>x<tr><td>a</td></tr></table>", "xtable(tbody(tr(td(a))))"),
    ("<p>a<div>b</div>", "p(a)div(b)"), ("<b>a<i>b</b>c</i>", "b(ai(b))i(c)"), ("a</p>b", "ap()b"), ("<h1>a<h2>b", "h1(a)h2(b)"),
]


def _written(node: dom.Node) -> str:
    return node.text if node.tag is None else f"{node.tag}({''.join(map(_written, node.children))})"


def _body(html: str) -> str:
    body = next(n for n in dom.parse(html).walk() if n.tag == "body")
    return "".join(map(_written, body.children))


_SELECTORS = [
    ("p", 2), (".c", 1), ("#i", 1), ("*", 8), ("div > p", 1), ("div p", 2), ("p + span", 1), ("p ~ span", 1), ("[data-x]", 1), ("[data-x^=ab]", 1), ("[data-x$=bc]", 1), ("[data-x*=b]", 1), ("[class~=a]", 1),
    ("p:not(.c)", 1), ("li:nth-child(2n+1)", 2), ("li:last-child", 1), ("li:first-child", 1), ("li:nth-of-type(2)", 1), ("ul:has(li)", 1), ("li:only-child", 0), ("p:empty", 0),
]
_SELECTED = "<div><p class='a c' id=i>x</p><span><p data-x=abc>y</p></span></div><ul><li>1<li>2<li>3</ul>"


@query(expected("selector string, hits int", *_SELECTORS))
def css_selectors(spark: SparkSession, d: str) -> DataFrame:
    """How many elements of a body each selector finds."""
    body = next(n for n in dom.parse(_SELECTED).walk() if n.tag == "body")
    inside = [n for n in body.walk() if n.tag and n is not body]
    rows = [(s, sum(css.compile_selector(s)[0](n) for n in inside)) for s, _ in _SELECTORS]
    return spark.createDataFrame(rows, "selector string, hits int")


@query(expected("html string, tree string", *_TREES))
def html_trees(spark: SparkSession, d: str) -> DataFrame:
    """Trees of broken markup: implied ends, reopened and misnested formatting, strangers in tables."""
    return spark.createDataFrame([(h, _body(h)) for h, _ in _TREES], "html string, tree string")


# geometry


@query(
    "SELECT l_orderkey, l_linenumber, greatest(floor(l_quantity - 10 + 0.5), 0)::INT AS x, greatest(floor(l_discount * 100 + 0.5), 0)::INT AS y, "
    "(CASE WHEN floor(l_quantity - 20 + 0.5) <= 0 THEN 8 ELSE floor(l_quantity - 20 + 0.5) END)::INT AS w, (CASE WHEN floor(l_tax * 100 + 0.5) <= 0 THEN 8 ELSE floor(l_tax * 100 + 0.5) END)::INT AS h FROM lineitem"
)
def boxes_made_valid(spark: SparkSession, d: str) -> DataFrame:
    box = geometry.valid_box(F.col("l_quantity") - 10, F.col("l_discount") * 100, F.col("l_quantity") - 20, F.col("l_tax") * 100)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query(f"SELECT block_id, pos::BIGINT AS pos FROM {_WORDS} WHERE x >= 5 AND y >= 3 AND x + w <= 85 AND y + h <= 63")
def words_inside_clip(spark: SparkSession, d: str) -> DataFrame:
    box, clip = tuple(F.col(c) for c in "xywh"), tuple(F.lit(v) for v in (5.7, 3.2, 80.9, 60.0))
    return _words(spark, d).where(geometry.inside(box, clip)).select("block_id", "pos")


@query(r"SELECT word, lang, NOT regexp_matches(word, '[^\x20-\x7f\x{a0}-\x{ff}]') AS plain FROM vocabulary")
def words_without_icons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocabulary").select("word", "lang", geometry.is_icon_free(F.col("word")).alias("plain"))


@query("SELECT c_custkey, round(10 + c_nationkey * cos(c_custkey * 0.1) - 2 * sin(c_custkey * 0.1), 6) AS x, round(5 + c_nationkey * sin(c_custkey * 0.1) + 2 * cos(c_custkey * 0.1), 6) AS y FROM customer")
def points_rotated(spark: SparkSession, d: str) -> DataFrame:
    x, y = geometry.rotated(F.lit(10), F.lit(5), F.lit(10) + F.col("c_nationkey"), F.lit(7), F.col("c_custkey") * 0.1)
    return table(spark, d, "customer").select("c_custkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


_SHAPES = [(1, [0.0, 0, 4, 0, 4, 4, 0, 4]), (2, [2.0, 0, 6, 0, 6, 4, 2, 4]), (3, [2.0, 0, 4, 2, 2, 4, 0, 2]), (4, [90.0, 90, 91, 90, 91, 91, 90, 91])]


@query(expected("left_id bigint, right_id bigint, overlap double", (1, 2, 0.333333), (1, 3, 0.5), (2, 3, 0.2)))
def polygons_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Two squares shifted by half, and a diamond of half a square's area."""
    boxes = spark.createDataFrame([(1, i, list(map(float, b))) for i, b in _SHAPES], "image bigint, id bigint, box array<double>")
    pairs = geometry.polygon_overlaps(boxes, boxes).where("left_id < right_id")
    return pairs.select("left_id", "right_id", F.round("overlap", 6).alias("overlap"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 100 < 40 THEN 1920 WHEN o_orderkey % 100 < 75 THEN 1366 ELSE 1280 END AS width FROM orders")
def viewport_widths(spark: SparkSession, d: str) -> DataFrame:
    shares = [(1920, 40.0), (1366, 35.0), (1280, 25.0)]
    return table(spark, d, "orders").select("o_orderkey", geometry.viewport_width(F.col("o_orderkey") % 100, shares).alias("width"))


_LABELS = [("Name", "v", "text", "Name"), ("", " v ", "text", "v"), ("p", "Go", "submit", "Go"), (None, "", "text", None)]


@query(expected("placeholder string, value string, kind string, label string", *_LABELS))
def input_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([r[:3] for r in _LABELS], "placeholder string, value string, kind string")
    return rows.select("*", geometry.input_label(F.col("placeholder"), F.col("value"), F.col("kind")).alias("label"))


_KEPT = [("ab", 0.99, "ab", 0, None), ("chat", 0.985, "chef", 2, "chat"), ("chap", 0.9, "chat", 1, "CHAT"), ("chat", 0.9, "chef", 2, None), ("chat", 0.7, "chat", 0, None), ("12:30", 0.92, "x", 5, "12:30"), ("12:30", 0.8, "x", 5, None), ("cat", 0.85, "cat", 0, "cat")]


@query(expected("text string, score double", *((r[4], r[1]) for r in _KEPT if r[4])))
def words_kept(spark: SparkSession, d: str) -> DataFrame:
    """Word instances kept by score and lexicon distance, and corrected where the lexicon is near."""
    return geometry.kept_words(spark.createDataFrame([r[:4] for r in _KEPT], "text string, score double, nearest string, distance int")).select("text", "score")


@query(
    f"""WITH RECURSIVE w AS (SELECT block_id, pos, y::DOUBLE AS y, (y + h)::DOUBLE AS b, row_number() OVER (PARTITION BY block_id ORDER BY pos, y, h) AS k FROM {_WORDS}),
        r AS (SELECT block_id, k, pos, y, b, 1 AS line_no FROM w WHERE k = 1 UNION ALL
              SELECT w.block_id, w.k, w.pos, CASE WHEN w.y > r.y + (r.b - r.y) / 2 THEN w.y ELSE least(r.y, w.y) END, CASE WHEN w.y > r.y + (r.b - r.y) / 2 THEN w.b ELSE greatest(r.b, w.b) END,
                     r.line_no + (w.y > r.y + (r.b - r.y) / 2)::INT FROM r JOIN w ON w.block_id = r.block_id AND w.k = r.k + 1)
        SELECT block_id, pos::BIGINT AS pos, line_no::INT AS line_no FROM r"""
)
def lines_segmented(spark: SparkSession, d: str) -> DataFrame:
    return geometry.segmented_lines(_words(spark, d))


_LINE_WORDS = [(1, 1, "a", 0, 10), (1, 2, "b", 2, 10), (1, 3, "c", 20, 10), (2, 1, "z", 5, 5)]


@query(expected("block_id bigint, line_no int, text string", (1, 1, "a b"), (1, 2, "c"), (2, 1, "z")))
def line_texts_joined(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame(_LINE_WORDS, "block_id bigint, pos bigint, text string, y bigint, h bigint")
    return geometry.line_texts(words, geometry.segmented_lines(words))


_SCORES = [(1, 1, 5, [0.1, 0.8, 0.1]), (1, 2, 2, [0.7, 0.2, 0.1]), (1, 3, 9, [0.2, 0.2, 0.6])]


@query(expected("word_id bigint, text string, score double", (7, "ABC", 0.7)))
def words_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Characters of a word in order of x, each the class of its greatest score, and the mean of these scores."""
    chars = spark.createDataFrame([(i, c, x, s) for i, c, x, s in _SCORES], "image bigint, char_id bigint, x bigint, scores array<double>")
    assigned = spark.createDataFrame([(1, c, 7) for c in (1, 2, 3)], "image bigint, char_id bigint, word_id bigint")
    return geometry.decoded_words(chars, assigned, "ABC").select("word_id", "text", F.round("score", 6).alias("score"))


@query(expected("x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, score double", (0.0, -1.0, 6.0, -1.0, 6.0, 3.0, 0.0, 3.0, 0.99)))
def dense_boxes_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The one cell above the minimum, at x 4, with distances 1, 2, 3, 4 to its sides and no angle."""
    maps = spark.createDataFrame([(7, 2, [0.1, 0.99], [[0.0] * 5, [1.0, 2.0, 3.0, 4.0, 0.0]])], "image bigint, width int, scores array<double>, geometry array<array<double>>")
    box = [F.col("box")[i].alias(f"{'xy'[i % 2]}{i // 2}") for i in range(8)]
    return geometry.dense_boxes(maps).select(*box, "score")


_IOU = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))::DOUBLE"


@query(
    f"""WITH RECURSIVE w AS (SELECT block_id, x, y, w, h, round(0.9::DOUBLE + (x % 10) / 100.0::DOUBLE, 2) AS s, row_number() OVER (PARTITION BY block_id ORDER BY x % 10 DESC, x, y, w) - 1 AS k FROM {_WORDS}),
        o AS (SELECT a.block_id, a.k AS i, b.k AS j, round({_IOU} / (a.w * a.h + b.w * b.h - {_IOU}), 9) AS iou FROM w a JOIN w b ON a.block_id = b.block_id AND a.k < b.k),
        m AS (SELECT w.block_id, w.k, coalesce(sum(CASE WHEN iou > 0.15 THEN 1 << j END), 0)::BIGINT AS away, coalesce(sum(CASE WHEN iou > 0.5 THEN 1 << j END), 0)::BIGINT AS near
              FROM w LEFT JOIN o ON o.block_id = w.block_id AND o.i = w.k GROUP BY w.block_id, w.k),
        r AS (SELECT block_id, 0::BIGINT AS k, 0::BIGINT AS gone, NULL::BIGINT AS merged FROM m WHERE k = 0 UNION ALL
              SELECT m.block_id, r.k + 1, CASE WHEN r.gone & (1 << r.k) = 0 THEN r.gone | m.away ELSE r.gone END, CASE WHEN r.gone & (1 << r.k) = 0 THEN (m.near & ~r.gone) | (1 << r.k) END
              FROM r JOIN m ON m.block_id = r.block_id AND m.k = r.k)
        SELECT r.block_id AS image, round(max(CASE WHEN w.k = r.k - 1 THEN w.s END), 6) AS score, round(sum(w.x * w.s) / sum(w.s), 6) AS x, round(sum((w.y + w.h) * w.s) / sum(w.s), 6) AS bottom
        FROM r JOIN w ON w.block_id = r.block_id AND r.merged & (1 << w.k) <> 0 GROUP BY r.block_id, r.k"""
)
def detections_merged(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the order lines as detections of one image an order: suppressed beyond an overlap of 0.15, merged beyond 0.5."""
    w = _words(spark, d)
    x, y, r, b = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    box = F.array(*(c.cast("double") for c in (x, y, r, y, r, b, x, b)))
    rows = w.select(F.col("block_id").alias("image"), box.alias("box"), F.round(0.9 + (F.col("x") % 10) / 100.0, 2).alias("score"))
    out = geometry.suppressed(rows, min_score=0.5, min_neighbours=0)
    return out.select("image", F.round("score", 6).alias("score"), F.round(F.col("box")[0], 6).alias("x"), F.round(F.col("box")[5], 6).alias("bottom"))


@query(expected("score double, first double, second double, x double", (0.9, 0.6, 0.4, 0.04), (0.7, 0.0, 1.0, 50.0)))
def detections_with_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class scores are averaged with the boxes: 0.9 and 0.6 of two boxes that all but coincide; a third takes none."""
    square = lambda x: [x, 0.0, x + 4, 0.0, x + 4, 4.0, x, 4.0]
    rows = [(1, square(0.0), 0.9, [1.0, 0.0]), (1, square(0.1), 0.6, [0.0, 1.0]), (1, square(50.0), 0.7, [0.0, 1.0])]
    out = geometry.suppressed(spark.createDataFrame(rows, "image bigint, box array<double>, score double, classes array<double>"), min_score=0.5, min_neighbours=0)
    return out.select("score", F.round(F.col("classes")[0], 6).alias("first"), F.round(F.col("classes")[1], 6).alias("second"), F.round(F.col("box")[0], 6).alias("x"))


_GEOMETRY = (
    '{"tagName":"P","classNames":"c","boundingBox":{"x":1,"y":2,"width":30,"height":10},"text":"ab","lines":[{"text":"ab","boundingBox":{"x":1,"y":2,"width":20,"height":10},'
    '"words":[{"text":"ab","boundingBox":{"x":1,"y":2,"width":12,"height":10},"letters":[{"char":"a","boundingBox":{"x":1,"y":2,"width":5,"height":10}},{"char":"b","boundingBox":{"x":7,"y":2,"width":6,"height":10}}]}]}]}'
)


@query(expected("level string, text string, x int, y int, w int, h int", ("block", "ab", 1, 2, 30, 10), ("line", "ab", 1, 2, 20, 10), ("word", "ab", 1, 2, 12, 10), ("char", "a", 1, 2, 5, 10), ("char", "b", 7, 2, 6, 10)))
def geometry_flattened(spark: SparkSession, d: str) -> DataFrame:
    return geometry.flattened_boxes(spark.createDataFrame([(1, _GEOMETRY)], "page_id bigint, json string")).drop("page_id")


@query(expected("line string", ("0,1,4,1,4,3,0,3,hey",)))
def detection_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([([0.2, 0.9, 4.1, 1.0, 3.9, 3.2, 0.0, 2.8], "hey")], "box array<double>, text string")
    return rows.select(geometry.detection_line(F.col("box"), F.col("text")).alias("line"))


_NODES = [(1, None, None), (2, 1, ""), (3, 2, None), (4, 3, "a"), (5, 3, "b")]


@query(expected("node_id bigint, parent_id bigint", (1, None), (3, 1), (4, 3), (5, 3)))
def tree_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Node 2 has one child and no text: its child moves up; the root stays."""
    rows = spark.createDataFrame([(1, *r) for r in _NODES], "page_id bigint, node_id bigint, parent_id bigint, text string")
    return geometry.pruned_tree(rows).select("node_id", "parent_id")


_TREE = (
    '[{"node_id":1,"tagName":"BODY","width":100,"height":100,"x":0,"y":0},{"node_id":2,"parent_id":1,"tagName":"DIV","display":"none","width":10,"height":10,"x":0,"y":0},'
    '{"node_id":3,"parent_id":2,"tagName":"P","text":"t","width":10,"height":10,"x":0,"y":0},{"node_id":4,"parent_id":1,"tagName":"Q","text":"q","before":"<","after":">","width":10,"height":10,"x":5,"y":5},'
    '{"node_id":5,"parent_id":4,"tagName":"B","text":"far","width":10,"height":10,"x":5,"y":500}]'
)


@query(expected("node_id bigint, text string, parents string, visible boolean", (1, "", "", True), (2, "", "1", False), (3, "t", "2,1", False), (4, "<q>", "1", True), (5, "far", "4,1", False)))
def page_tree_read(spark: SparkSession, d: str) -> DataFrame:
    """Recorded nodes with their parents, what pseudo elements add to their texts, and whether they can be seen."""
    nodes = geometry.page_tree(spark.createDataFrame([(1, _TREE)], "page_id bigint, json string"), 200, 200)
    return nodes.select("node_id", "text", F.array_join("parents", ",").alias("parents"), "visible")


@query(expected("number int", (13,)))
def capture_number(spark: SparkSession, d: str) -> DataFrame:
    return geometry.next_capture(spark.createDataFrame([("00003.json",), ("00012_screen.png",), ("00011.json",)], "name string"))
