"""The registered queries of the core: name -> (spark, sf_dir) -> DataFrame, and their SQL.

Every query runs over its whole tables.  Repeated rows count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.html import convert
from corpusloom.operators import corpus, crawl, geometry
from corpusloom.plans.session import settle, table
from corpusloom.sources import nlp_format
from corpusloom.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_T = "(SELECT DISTINCT page_id, pos, siteindex, docelttype, doceltcmd, nestinglevel, text FROM textdf)"
_INTERESTING = "(docelttype IS DISTINCT FROM 'Document' OR doceltcmd = 'Title') AND doceltcmd <> 'End' AND text IS NOT NULL"
_TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')"
_R = "(SELECT DISTINCT * FROM requests)"
_BLOCKS = f"""(SELECT siteindex, page_id, pos, text FROM (
    SELECT *, row_number() OVER (PARTITION BY siteindex, text ORDER BY page_id, pos) AS n FROM {_T} WHERE {_INTERESTING}) WHERE n = 1)"""
_VOCAB = f"(SELECT word, count(*) AS cnt FROM (SELECT unnest({_TOKENS.format('text')}) AS word FROM {_BLOCKS}) GROUP BY word)"
_CHARSET = f"(SELECT ch, sum(cnt)::BIGINT AS cnt FROM (SELECT unnest(string_split(word, '')) AS ch, cnt FROM {_VOCAB}) WHERE ch <> '' GROUP BY ch)"


def _textdf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "textdf")


def _once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return corpus.once(_textdf(spark, d), *columns)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return corpus.site_blocks(_textdf(spark, d))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return crawl.requests_once(table(spark, d, "requests"))


# element stream


@query(f"SELECT docelttype, doceltcmd, count(*) AS n FROM {_T} GROUP BY docelttype, doceltcmd")
def element_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Elements by kind and command."""
    return _once(spark, d, "docelttype", "doceltcmd").groupBy("docelttype", "doceltcmd").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT page_id) AS documents FROM textdf WHERE docelttype = 'Document' AND doceltcmd = 'Start'")
def document_count(spark: SparkSession, d: str) -> DataFrame:
    rows = _textdf(spark, d).where("docelttype = 'Document' AND doceltcmd = 'Start'")
    return rows.agg(F.countDistinct("page_id").alias("documents"))


@query(f"SELECT page_id, pos, text FROM {_T} WHERE {_INTERESTING}")
def blocks_filtered(spark: SparkSession, d: str) -> DataFrame:
    return corpus.interesting(_once(spark, d, "docelttype", "doceltcmd", "text")).select("page_id", "pos", "text")


@query(f"SELECT siteindex, page_id, pos, md5(text) AS text_md5 FROM {_BLOCKS}")
def blocks_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("siteindex", "page_id", "pos", "text_md5")


@query(
    f"""SELECT b.siteindex, b.page_id, b.pos, len({_TOKENS.format('b.text')})::INT AS words_count
        FROM {_BLOCKS} b JOIN nlpdocs n USING (page_id)
        WHERE substr(lower(n.lang), 1, 2) = 'fr' AND len({_TOKENS.format('b.text')}) >= 5"""
)
def dataset_filter_fr_min5(spark: SparkSession, d: str) -> DataFrame:
    return corpus.dataset(_textdf(spark, d), table(spark, d, "nlpdocs")).select("siteindex", "page_id", "pos", "words_count")


@query(
    f"""WITH n AS (SELECT siteindex, sum(len({_TOKENS.format('text')})) AS n FROM {_BLOCKS} GROUP BY siteindex)
        SELECT website, coalesce(n, 0)::BIGINT AS words_count, coalesce(n, 0) * 100.0::DOUBLE / sum(coalesce(n, 0)) OVER () AS percent
        FROM websites LEFT JOIN n USING (siteindex)"""
)
def site_word_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.site_word_stats(_blocks(spark, d), table(spark, d, "websites"))


@query(f"SELECT sum(length(text))::BIGINT AS characters, sum(len({_TOKENS.format('text')}))::BIGINT AS words, count(*) AS blocks FROM {_BLOCKS}")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return corpus.totals(_blocks(spark, d))


@query(f"SELECT word, cnt FROM {_VOCAB}")
def vocab_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.vocabulary(_blocks(spark, d))


_CUM = """SELECT {0}, cnt, 100.0::DOUBLE * sum(cnt) OVER (ORDER BY cnt DESC, {0} ROWS UNBOUNDED PRECEDING) / sum(cnt) OVER () AS percent FROM {1}"""


@query(_CUM.format("word", _VOCAB))
def vocab_cumpct(spark: SparkSession, d: str) -> DataFrame:
    return corpus.cumulative_percent(settle(corpus.vocabulary(_blocks(spark, d))), "word")


@query(f"SELECT ch, cnt FROM {_CHARSET}")
def charset_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.charset(corpus.vocabulary(_blocks(spark, d)))


@query(_CUM.format("ch", _CHARSET))
def charset_cumpct(spark: SparkSession, d: str) -> DataFrame:
    return corpus.cumulative_percent(settle(corpus.charset(corpus.vocabulary(_blocks(spark, d)))), "ch")


@query()
def charset_names(spark: SparkSession, d: str) -> DataFrame:
    return corpus.charset_table(corpus.charset(corpus.vocabulary(_blocks(spark, d))))


@query(
    rf"SELECT ch, cnt FROM {_CHARSET} WHERE NOT regexp_matches(ch, '^[\p{{L}}\p{{Nd}}]$')"
)
def separator_chars(spark: SparkSession, d: str) -> DataFrame:
    return corpus.separator_characters(corpus.charset(corpus.vocabulary(_blocks(spark, d))))


@query(f"SELECT page_id, pos, text FROM {_T} WHERE docelttype IS DISTINCT FROM 'Document' AND doceltcmd IN ('Start', 'Text') AND text <> ''")
def text_strings(spark: SparkSession, d: str) -> DataFrame:
    return corpus.text_strings(_once(spark, d, "docelttype", "doceltcmd", "text"))


@query(f"SELECT page_id, pos, text AS title FROM {_T} WHERE docelttype = 'Section' AND doceltcmd = 'Start' AND text IS NOT NULL")
def section_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "docelttype", "doceltcmd", "text").where("docelttype = 'Section' AND doceltcmd = 'Start' AND text IS NOT NULL")
    return rows.select("page_id", "pos", F.col("text").alias("title"))


@query(f"SELECT docelttype, count(*) AS n FROM {_T} WHERE doceltcmd = 'Text' AND length(text) < 50 GROUP BY docelttype")
def short_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "docelttype", "doceltcmd", "text").where((F.col("doceltcmd") == "Text") & tx.is_short(F.col("text")))
    return rows.groupBy("docelttype").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH x AS (SELECT *, sum(CASE WHEN docelttype = 'NavigationList' THEN CASE doceltcmd WHEN 'Start' THEN 1 WHEN 'End' THEN -1 END ELSE 0 END)
                   OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM {_T})
        SELECT text AS item, count(*) AS n FROM x WHERE depth > 0 AND docelttype = 'ListItem' AND doceltcmd = 'Text' GROUP BY text"""
)
def nav_list_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of navigation lists with how often each stands in one."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("pos")
    step = F.when(F.col("docelttype") == "NavigationList", F.when(F.col("doceltcmd") == "Start", 1).when(F.col("doceltcmd") == "End", -1)).otherwise(0)
    rows = _once(spark, d, "docelttype", "doceltcmd", "text").withColumn("depth", F.sum(step).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    items = rows.where("depth > 0 AND docelttype = 'ListItem' AND doceltcmd = 'Text'")
    return items.groupBy(F.col("text").alias("item")).agg(F.count(F.lit(1)).alias("n"))


_LIMARK = "le budget"


@query(
    f"""SELECT page_id, pos, substr(text, greatest(strpos(text, '{_LIMARK}') - 20, 1),
               strpos(text, '{_LIMARK}') + 20 - greatest(strpos(text, '{_LIMARK}') - 20, 1) + 1) AS context
        FROM {_T} WHERE strpos(text, '{_LIMARK}') > 0"""
)
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "text").where(F.col("text").contains(_LIMARK))
    return rows.select("page_id", "pos", tx.context_window(F.col("text"), _LIMARK).alias("context"))


@query(rf"SELECT page_id, pos FROM {_T} WHERE regexp_matches(text, '(^|[^\p{{L}}\p{{N}}])(école|budget)($|[^\p{{L}}\p{{N}}])')")
def word_boundary_filter(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "text").where(F.col("text").rlike(r"(^|[^\p{L}\p{N}])(école|budget)($|[^\p{L}\p{N}])")).select("page_id", "pos")


@query(
    rf"""SELECT page_id, pos, i::INT AS line, trim(string_split(text, chr(10))[i]) AS sentence_line
         FROM {_T} t, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i) WHERE doceltcmd = 'Text' AND trim(string_split(text, chr(10))[i]) <> ''"""
)
def block_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(spark, d, "doceltcmd", "text").where("doceltcmd = 'Text'").select("page_id", "pos", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return rows.select("page_id", "pos", (F.col("i") + 1).alias("line"), F.trim("l").alias("sentence_line")).where("sentence_line <> ''")


# lexicons


@query(
    f"""WITH lex AS (SELECT word AS token, string_agg(DISTINCT leffftags, '|' ORDER BY leffftags) AS tags FROM vocabulary WHERE leffftags IS NOT NULL GROUP BY word)
        SELECT v.word, coalesce(a.tags, b.tags, CASE WHEN try_cast(replace(v.word, ',', '.') AS DOUBLE) IS NOT NULL THEN 'Number' END) AS tags
        FROM {_VOCAB} v LEFT JOIN lex a ON a.token = v.word LEFT JOIN lex b ON b.token = lower(v.word)
        WHERE regexp_matches(v.word, '^[0-9a-zA-ZÀ-ÿ]+$') AND NOT regexp_matches(lower(v.word), '^(nan|inf|infinity|[0-9]+[edf][0-9]*[df]?)$')"""
)
def lexicon_tags_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the corpus's words; words of other than Latin letters and digits, and those only one of two engines reads as numbers, are left out."""
    lex = table(spark, d, "vocabulary").select(F.col("word").alias("token"), F.col("leffftags").alias("tag"))
    words = corpus.vocabulary(_blocks(spark, d)).select("word")
    words = words.where(F.col("word").rlike("^[0-9a-zA-ZÀ-ÿ]+$") & ~F.lower("word").rlike("^(nan|inf|infinity|[0-9]+[edf][0-9]*[df]?)$"))
    return corpus.lexicon_tags(words, corpus.tag_sets(lex)).select("word", "tags")


@query(
    """SELECT word, lang, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT unnest(string_split(concat_ws('|', leffftags, dicollectetags), '|')) AS x)) AS tags
       FROM vocabulary WHERE leffftags IS NOT NULL OR dicollectetags IS NOT NULL"""
)
def tag_merge(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vocabulary").where("leffftags IS NOT NULL OR dicollectetags IS NOT NULL")
    return v.select("word", "lang", tx.tag_union(F.col("leffftags"), F.col("dicollectetags")).alias("tags"))


@query("SELECT word, lang, cnt FROM vocabulary WHERE contains(commontags, 'NOUN') ORDER BY cnt DESC, word, lang LIMIT 100")
def nouns_topk(spark: SparkSession, d: str) -> DataFrame:
    return corpus.nouns(table(spark, d, "vocabulary"), 100).select("word", "lang", "cnt")


@query("SELECT word, lang, length(word)::INT AS chars FROM vocabulary WHERE commontags IS NULL OR commontags = 'None' OR contains(commontags, 'PROPN')")
def unknown_words(spark: SparkSession, d: str) -> DataFrame:
    return corpus.unknown_words(table(spark, d, "vocabulary")).select("word", "lang", F.length("word").alias("chars"))


@query(
    f"""WITH w AS (SELECT DISTINCT lower(word) AS word FROM {_VOCAB} WHERE regexp_matches(word, '^[a-zA-Z]+$') AND length(word) BETWEEN 4 AND 30),
             l AS (SELECT DISTINCT lower(word) AS entry FROM vocabulary WHERE regexp_matches(word, '^[a-zA-Z]+$')),
             p AS (SELECT word, entry, levenshtein(word, entry)::INT AS distance FROM w JOIN l ON abs(length(word) - length(entry)) <= 1 AND levenshtein(word, entry) <= 1)
        SELECT word, min_by(entry, (distance, entry)) AS nearest, min(distance)::INT AS distance FROM p GROUP BY word"""
)
def nearest_lexicon_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    words = corpus.vocabulary(_blocks(spark, d)).where(F.col("word").rlike("^[a-zA-Z]+$") & F.length("word").between(4, 30)).select(F.lower("word").alias("word"))
    entries = table(spark, d, "vocabulary").where(F.col("word").rlike("^[a-zA-Z]+$")).select(F.lower("word").alias("entry"))
    return corpus.nearest_words(words, entries)


@query()
def nearest_lexicon_any_distance(spark: SparkSession, d: str) -> DataFrame:
    """The nearest known word of every word of the corpus, in all scripts and at any distance."""
    words = corpus.vocabulary(_blocks(spark, d)).select(F.lower("word").alias("word"))
    return corpus.nearest_words_at_any_distance(words, table(spark, d, "vocabulary").select(F.lower("word").alias("entry")))


@query()
def lexicon_tags_all_words(spark: SparkSession, d: str) -> DataFrame:
    """Tags of all words of the corpus, in all scripts."""
    lex = table(spark, d, "vocabulary").select(F.col("word").alias("token"), F.col("leffftags").alias("tag"))
    return corpus.lexicon_tags(corpus.vocabulary(_blocks(spark, d)).select("word"), corpus.tag_sets(lex)).select("word", "tags")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 200")
def sample_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return corpus.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 200)


@query()
def unigram_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Best unigram paths of the documents over the vocabulary's words, scored by their frequency."""
    v = table(spark, d, "vocabulary").where("cnt > 0").groupBy("word").agg(F.sum("cnt").alias("cnt"))
    rows = v.select("word", F.log("cnt").alias("s")).collect()
    top = max((r.s for r in rows), default=0.0)
    return corpus.unigram_segments(table(spark, d, "documents").select("doc_id", "text"), {r.word: r.s - top - 5.0 for r in rows})


# crawl log

_LABELS = ", ".join(f"coalesce(count_if(r.status_code = '{s}'), 0) AS {s.lower()}" for s in crawl.STATUS_LABELS)


@query(f"SELECT w.website, count(r.request_id) AS requests, {_LABELS} FROM websites w LEFT JOIN {_R} r USING (siteindex) GROUP BY w.siteindex, w.website")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return crawl.status_pivot(_requests(spark, d), table(spark, d, "websites"))


@query(f"SELECT siteindex, count(*) AS requests, count_if(status_code = 'OK') AS ok FROM {_R} GROUP BY siteindex HAVING count(*) <> count_if(status_code = 'OK')")
def sites_not_ok(spark: SparkSession, d: str) -> DataFrame:
    n = _requests(spark, d).groupBy("siteindex").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") == "OK").alias("ok"))
    return n.where("requests <> ok")


@query(
    f"""SELECT request_id, url, status_code FROM {_R} WHERE (error_message IS NOT NULL AND NOT contains(lower(error_message), 'not found') AND NOT contains(lower(error_message), 'moved'))
        OR (status_code IS NOT NULL AND status_code NOT IN ('OK', 'NotFound', 'Redirect', 'Moved', 'NoContent'))"""
)
def error_filter(spark: SparkSession, d: str) -> DataFrame:
    return crawl.failed_requests(_requests(spark, d)).select("request_id", "url", "status_code")


@query(
    f"""SELECT siteindex, place::INT AS place, request_id, url FROM (SELECT *, row_number() OVER (PARTITION BY siteindex ORDER BY clock DESC NULLS LAST, request_id DESC) AS place FROM {_R}) WHERE place <= 10"""
)
def last10_pages(spark: SparkSession, d: str) -> DataFrame:
    return crawl.last_requests(_requests(spark, d))


@query(
    f"""SELECT siteindex, count(*) AS requests, count_if(status_code = 'OK') AS pages, count(error_message) AS errors, sum(content_size_bytes)::BIGINT AS bytes,
        sum(response_time_ms)::BIGINT AS response_ms, sum(download_time_ms)::BIGINT AS download_ms, max(crawl_depth) AS depth FROM {_R} GROUP BY siteindex"""
)
def crawl_counters(spark: SparkSession, d: str) -> DataFrame:
    return crawl.crawl_counters(_requests(spark, d))


@query(
    rf"SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS authority, count(*) AS n FROM {_R} GROUP BY 1"
)
def crawl_by_authority(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).groupBy(F.lower(urls.authority(F.col("url"))).alias("authority")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH l AS (SELECT siteindex, count(*) AS n FROM {_R} GROUP BY 1), p AS (SELECT siteindex, count(*) AS n FROM nlpdocs GROUP BY 1),
             t AS (SELECT siteindex, count(*) AS n, sum(length(text))::BIGINT AS c FROM {_T} GROUP BY 1)
        SELECT website, coalesce(l.n, 0) AS log_rows, coalesce(p.n, 0) AS documents, coalesce(t.n, 0) AS elements, coalesce(t.c, 0) AS characters
        FROM websites LEFT JOIN l USING (siteindex) LEFT JOIN p USING (siteindex) LEFT JOIN t USING (siteindex)"""
)
def site_load_report(spark: SparkSession, d: str) -> DataFrame:
    return crawl.site_report(_once(spark, d, "siteindex", "text"), table(spark, d, "nlpdocs"), _requests(spark, d), table(spark, d, "websites"))


_NOVELTY = f"""(WITH b AS (SELECT siteindex AS site, page_id AS doc, pos, text FROM {_T} WHERE {_INTERESTING}),
    f AS (SELECT *, row_number() OVER (PARTITION BY site, text ORDER BY doc, pos) AS n FROM b)
    SELECT site, doc, sum(length(text))::BIGINT AS chars, sum(CASE WHEN n = 1 THEN length(text) ELSE 0 END)::BIGINT AS new_chars,
           CASE WHEN sum(length(text)) > 0 THEN sum(CASE WHEN n = 1 THEN length(text) ELSE 0 END)::DOUBLE / sum(length(text)) ELSE 1.0 END AS ratio
    FROM f GROUP BY site, doc)"""


def _novelty(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.interesting(_once(spark, d, "siteindex", "text")).select(F.col("siteindex").alias("site"), F.col("page_id").alias("doc"), "pos", "text")
    return crawl.novelty(rows)


@query(f"SELECT * FROM {_NOVELTY}")
def novelty_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return _novelty(spark, d)


@query(f"SELECT site, doc, round(avg(ratio) OVER (PARTITION BY site ORDER BY doc ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 6) AS moving_ratio FROM {_NOVELTY}")
def novelty_moving_avg(spark: SparkSession, d: str) -> DataFrame:
    return crawl.moving_novelty(_novelty(spark, d)).withColumn("moving_ratio", F.round("moving_ratio", 6))


@query(
    f"""WITH x AS (SELECT r.*, row_number() OVER w AS seq, sum((coalesce(status_code, '') = 'OK')::INT) OVER u AS pages,
                   sum((error_message IS NOT NULL)::INT) OVER u AS errors,
                   avg(unique_text_blocks_pct) OVER (PARTITION BY siteindex ORDER BY clock NULLS FIRST, request_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS m
            FROM {_R} r WINDOW w AS (PARTITION BY siteindex ORDER BY clock NULLS FIRST, request_id),
                               u AS (PARTITION BY siteindex ORDER BY clock NULLS FIRST, request_id ROWS UNBOUNDED PRECEDING)),
        y AS (SELECT siteindex, seq, request_id, CASE WHEN pages >= maxpagecount THEN 'pages' WHEN errors > 20 THEN 'errors'
                     WHEN seq >= 10 AND m * 100 < minuniquetext THEN 'unique' END AS reason FROM x JOIN websites USING (siteindex))
        SELECT siteindex, min(seq)::INT AS seq, arg_min(reason, seq) AS reason, arg_min(request_id, seq) AS request_id FROM y WHERE reason IS NOT NULL GROUP BY siteindex"""
)
def first_stop_violation(spark: SparkSession, d: str) -> DataFrame:
    return crawl.first_stop(_requests(spark, d), table(spark, d, "websites"))


@query(
    f"""SELECT siteindex, request_id, max(ms - n * 120) OVER (PARTITION BY siteindex ORDER BY clock NULLS FIRST, request_id ROWS UNBOUNDED PRECEDING) + n * 120 AS start_ms
        FROM (SELECT *, epoch_us(clock) // 1000 AS ms, row_number() OVER (PARTITION BY siteindex ORDER BY clock NULLS FIRST, request_id) AS n FROM {_R})"""
)
def rate_limited_starts(spark: SparkSession, d: str) -> DataFrame:
    return crawl.rate_limited_starts(_requests(spark, d))


@query(f"SELECT request_id, translate(error_message, ';' || chr(10), ', ') AS message FROM {_R} WHERE error_message IS NOT NULL")
def csv_safe_messages(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).where("error_message IS NOT NULL").select("request_id", tx.csv_safe(F.col("error_message")).alias("message"))


@query(f"SELECT request_id FROM {_R} WHERE error_message IS NOT NULL AND coalesce(retry_count, 0) < 3")
def requests_to_retry(spark: SparkSession, d: str) -> DataFrame:
    r = _requests(spark, d)
    return r.where(crawl.should_recrawl(F.col("error_message"), F.col("retry_count"))).select("request_id")


# URLs

_HOST = r"lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_PATH = r"coalesce(nullif(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
_BASE = "array_to_string(list_slice(string_split({0}, '.'), -2, -1), '.')".format(_HOST.format("{0}"))
_ROOT = "CASE WHEN strpos({0}, '.') > 1 THEN regexp_extract({0}, '^([^.]*/)', 1) ELSE {0} END".format(_PATH.format("{0}"))


@query(
    rf"""SELECT page_id, regexp_extract(uri, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS website, {_HOST.format('uri')} AS host,
        {_BASE.format('uri')} AS base_domain, {_ROOT.format('uri')} AS root_path, coalesce(regexp_extract(uri, '(\?[^#]*)', 1), '') AS query, split_part(uri, '#', 1) AS plain
        FROM nlpdocs"""
)
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("uri")
    return table(spark, d, "nlpdocs").select(
        "page_id", urls.authority(u).alias("website"), urls.host(u).alias("host"), urls.base_domain(u).alias("base_domain"),
        urls.root_path(u).alias("root_path"), urls.query(u).alias("query"), urls.without_fragment(u).alias("plain"),
    )


@query(f"SELECT {_BASE.format('uri')} AS base_domain, count(*) AS n FROM nlpdocs GROUP BY 1")
def base_domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nlpdocs").groupBy(urls.base_domain(F.col("uri")).alias("base_domain")).agg(F.count(F.lit(1)).alias("n"))


@query(
    rf"""SELECT page_id, p || CASE WHEN p = '' OR suffix(p, '/') THEN '_default_' ELSE '' END || CASE WHEN q <> '' THEN '_' || upper(md5(q)) ELSE '' END || '.nlp.txt' AS file
        FROM (SELECT page_id, regexp_replace(substr({_PATH.format('uri')}, 2), '\.+/', '/', 'g') AS p, coalesce(regexp_extract(uri, '(\?[^#]*)', 1), '') AS q FROM nlpdocs)"""
)
def page_file_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nlpdocs").select("page_id", urls.file_path(F.col("uri")).alias("file"))


def _key_sql(col: str) -> str:
    # the signed little-endian number of the first eight digest bytes
    parts = " || ".join(f"substr(md5({col}), {15 - 2 * i}, 2)" for i in range(8))
    return f"(CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT FROM (SELECT *, ('0x' || {parts})::UBIGINT::HUGEINT AS u"


@query(f"SELECT page_id, {_key_sql('uri').replace('::BIGINT FROM', '::BIGINT AS key FROM')} FROM nlpdocs WHERE uri IS NOT NULL)")
def url_key64(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nlpdocs").where("uri IS NOT NULL").select("page_id", urls.key64(F.col("uri")).alias("key"))


_SCOPED = f"""CASE w.scope WHEN 'domain' THEN {_BASE.format('n.uri')} = {_BASE.format('w.rooturl')}
    WHEN 'subdomain' THEN {_HOST.format('n.uri')} = {_HOST.format('w.rooturl')}
    WHEN 'path' THEN {_HOST.format('n.uri')} = {_HOST.format('w.rooturl')} AND starts_with({_PATH.format('n.uri')}, {_ROOT.format('w.rooturl')}) ELSE false END"""


@query(f"SELECT n.page_id, w.scope, {_SCOPED} AS inside FROM nlpdocs n JOIN websites w USING (siteindex)")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "nlpdocs").join(table(spark, d, "websites"), "siteindex")
    return pages.select("page_id", "scope", urls.in_scope(F.col("uri"), F.col("rooturl"), F.col("scope")).alias("inside"))


@query(
    rf"""SELECT request_id, allowed, reason FROM (SELECT request_id, CASE WHEN n.url IS NULL OR n.url = '' THEN 'no url' WHEN coalesce(crawl_depth, 0) > 3 THEN 'too deep'
        WHEN NOT regexp_matches(lower(n.url), '^https?://') THEN 'scheme' WHEN NOT ({_SCOPED.replace('n.uri', 'n.url')}) THEN 'external' END AS reason, reason IS NULL AS allowed
        FROM {_R} n JOIN websites w USING (siteindex))"""
)
def should_crawl_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = _requests(spark, d).join(table(spark, d, "websites"), "siteindex")
    verdict = crawl.should_crawl(F.col("url"), F.col("rooturl"), F.col("scope"), F.col("crawl_depth"), F.lit(0), max_depth=3)
    return rows.select("request_id", verdict.alias("v")).select("request_id", "v.allowed", "v.reason")


@query(
    rf"""SELECT page_id, w.excludeurls IS NULL OR NOT regexp_matches({_PATH.format('uri')} || coalesce(regexp_extract(uri, '(\?[^#]*)', 1), ''),
        '^' || replace(regexp_replace(w.excludeurls, '([.?+])', '\\\1', 'g'), '*', '.*')) AS allowed
        FROM nlpdocs JOIN websites w USING (siteindex)"""
)
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Pages against the exclude patterns of their site, taken as rules for the crawler."""
    pages = table(spark, d, "nlpdocs").join(table(spark, d, "websites").select("siteindex", "excludeurls"), "siteindex")
    patterns = F.when(F.col("excludeurls").isNotNull(), F.array("excludeurls"))
    return pages.select("page_id", crawl.robots_allowed(F.col("uri"), patterns).alias("allowed"))


_KNOWN = f"(SELECT DISTINCT split_part(uri, '#', 1) AS url FROM nlpdocs WHERE uri IS NOT NULL)"
_LINKS = f"(SELECT DISTINCT split_part(url, '#', 1) AS url FROM {_R} WHERE url IS NOT NULL)"


@query(f"SELECT url FROM {_LINKS} WHERE url NOT IN (SELECT url FROM {_KNOWN})")
def links_new_left_anti(spark: SparkSession, d: str) -> DataFrame:
    """Requested addresses no page of the corpus has."""
    plain = lambda df, c: df.where(F.col(c).isNotNull()).select(urls.without_fragment(F.col(c)).alias("url"))
    return crawl.new_links(plain(_requests(spark, d), "url"), plain(table(spark, d, "nlpdocs"), "uri"))


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT parent_url AS s, url AS t FROM {_R} WHERE parent_url IS NOT NULL AND url IS NOT NULL),
        f(url, depth) AS (SELECT rooturl, 0 FROM websites UNION SELECT e.t, f.depth + 1 FROM f JOIN e ON e.s = f.url WHERE f.depth < 20)
        SELECT url, min(depth)::INT AS depth FROM f GROUP BY url"""
)
def frontier_bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    edges = _requests(spark, d).select(F.col("parent_url").alias("source"), F.col("url").alias("target"))
    return crawl.frontier_depths(edges, table(spark, d, "websites").select(F.col("rooturl").alias("url")))


@query("SELECT page_id, strftime(ts, '%m/%d/%Y %H:%M:%S') AS stamp FROM nlpdocs WHERE ts IS NOT NULL")
def timestamp_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nlpdocs").where("ts IS NOT NULL").select("page_id", tx.timestamp_text(F.col("ts")).alias("stamp"))


@query("SELECT page_id, k AS key, v AS value FROM (SELECT page_id, split_part(p, '=', 1) AS k, substr(p, strpos(p, '=') + 1) AS v FROM (SELECT page_id, unnest(string_split(metadata, ';')) AS p FROM nlpdocs WHERE metadata IS NOT NULL)) WHERE k <> ''")
def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "nlpdocs").where("metadata IS NOT NULL").select("page_id", F.explode(F.split("metadata", ";")).alias("p"))
    return pairs.select("page_id", F.substring_index("p", "=", 1).alias("key"), F.col("p").substr(F.locate("=", "p") + 1, F.length("p")).alias("value")).where("key <> ''")


# format and pages


@query(
    f"""SELECT doceltcmd, docelttype, count(*) AS n, sum(coalesce(length(trim(text)), 0))::BIGINT AS characters
        FROM {_T} WHERE page_id NOT IN (SELECT page_id FROM textdf WHERE docelttype IS NULL) AND NOT (docelttype = 'Document' AND doceltcmd IN ('Start', 'End'))
          AND (doceltcmd <> 'Text' OR (text IS NOT NULL AND trim(text) <> ''))
        GROUP BY ALL"""
)
def format_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The stream written as structured text and read again: rows and characters by kind.

    What the format has no line for is left out on both sides: pages with elements of no kind, blocks without text."""
    once = _once(spark, d, "docelttype", "doceltcmd", "nestinglevel", "text")
    rows = once.join(once.where("docelttype IS NULL").select("page_id").distinct(), "page_id", "left_anti")
    rows = rows.where("doceltcmd <> 'Text' OR (text IS NOT NULL AND trim(text) <> '')")
    files = nlp_format.render_documents(rows.select(F.col("page_id").cast("string").alias("doc"), "pos", "docelttype", "doceltcmd", "nestinglevel", F.trim("text").alias("text")), compact=False)
    back = nlp_format.parse_documents(files).where("NOT (docelttype = 'Document' AND doceltcmd IN ('Start', 'End'))")
    return back.groupBy("doceltcmd", "docelttype").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length(F.trim("text")), F.lit(0))).alias("characters"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The documents as pages: a paragraph a line; & is escaped twice, as texts are decoded twice."""
    escaped: Column = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;amp;")), F.lit("<"), F.lit("&amp;lt;")), F.lit("\r"), F.lit(" "))
    body = F.array_join(F.transform(F.split(escaped, "\n"), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n")
    html = F.concat(F.lit("<html><head><title>t</title></head><body><article>"), body, F.lit("</article></body></html>"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.coalesce("uri", F.lit("")).alias("url"), html.alias("html"))


@query(
    r"""SELECT doc_id AS page_id, count(*) AS blocks, sum(length(l))::BIGINT AS characters
        FROM (SELECT doc_id, regexp_replace(unnest(string_split(replace(text, chr(13), ' '), chr(10))), '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g') AS l FROM documents)
        WHERE l <> '' GROUP BY doc_id"""
)
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Pages converted to element rows: text blocks and their characters."""
    rows = convert.page_elements(_pages(spark, d)).where("docelttype = 'TextBlock'")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("characters"))


@query()
def html_fixture_elements(spark: SparkSession, d: str) -> DataFrame:
    """Element rows of small pages with the markup that is hard: lists, tables, headings, styles, broken nesting."""
    rows = [(i, f"https://a.example.org/{i}", h) for i, h in enumerate(FIXTURE_PAGES)]
    return convert.page_elements(spark.createDataFrame(rows, "page_id long, url string, html string"))


@query()
def html_fixture_links(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, f"https://a.example.org/{i}", h) for i, h in enumerate(FIXTURE_PAGES)]
    return convert.page_links(spark.createDataFrame(rows, "page_id long, url string, html string"))


FIXTURE_PAGES = (
    "<nav><ul><li><a href='/a'>A</a></li><li><a href='b?x=1#y'>B</a></li></ul></nav><main><h1>T</h1><p>one<p>two<b>bold<p>three</main>",
    "<style>span{display:block}</style><p>a<span>b</span></p><p class='login'>x</p><table><tr><th>h<td rowspan=2>c<tr><td>d</table>",
    "<link rel=canonical href=/c><h1>A</h1><p>a</p><div><h2>B</h2><p>b</p></div><div><h2>C</h2><ol><li>i<li>j</ol></div>",
    "<ul>stray<li>i</li></ul><p>x &amp;lt; y<br>z</p><p><img alt='pic'> t <a href='/' title='T'></a></p>",
)


@query()
def robots_rule_groups(spark: SparkSession, d: str) -> DataFrame:
    """Robots files, one for each site with exclusions: agents, patterns, delays, sitemaps."""
    sites = table(spark, d, "websites")
    content = F.concat(
        F.lit("User-agent: *\nUser-agent: bingbot\nDisallow: "), F.coalesce("excludeurls", F.lit("")),
        F.lit("\nCrawl-delay: "), (F.col("mincrawldelay") / 1000).cast("string"), F.lit("\n# end\nSitemap: "), F.col("rooturl"), F.lit("sitemap.xml"),
    )
    return crawl.robots_rules(sites.select(F.col("website").alias("host"), content.alias("content")))


# geometry, on boxes made of the order lines

_WORDS = "(SELECT l_orderkey AS block_id, l_linenumber AS pos, (l_suppkey % 97)::BIGINT AS x, (l_partkey % 53)::BIGINT AS y, (1 + l_quantity)::BIGINT AS w, 12::BIGINT AS h FROM lineitem)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    i = lambda c: F.col(c).cast("bigint")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("block_id"), i("l_linenumber").alias("pos"), (i("l_suppkey") % 97).alias("x"), (i("l_partkey") % 53).alias("y"),
        (1 + i("l_quantity")).alias("w"), F.lit(12).cast("bigint").alias("h"),
    )


@query(f"SELECT block_id, min(x) AS x, min(y) AS y, (max(x + w) - min(x))::BIGINT AS w, (max(y + h) - min(y))::BIGINT AS h FROM {_WORDS} GROUP BY block_id")
def box_union(spark: SparkSession, d: str) -> DataFrame:
    return geometry.union_boxes(_words(spark, d), "block_id")


@query(
    f"""WITH c AS (SELECT block_id AS image, pos AS char_id, x, y, 4 AS w, h FROM {_WORDS}), v AS (SELECT block_id AS image, pos AS word_id, x, y, w, h FROM {_WORDS} WHERE pos % 2 = 1),
        p AS (SELECT c.image, char_id, word_id, greatest(0, least(c.x + c.w, v.x + v.w) - greatest(c.x, v.x)) * greatest(0, least(c.y + c.h, v.y + v.h) - greatest(c.y, v.y)) AS i,
                     c.w * c.h + v.w * v.h AS s FROM c JOIN v USING (image))
        SELECT image, char_id, arg_min(word_id, (-(i::DOUBLE / (s - i)), word_id)) AS word_id, max(i::DOUBLE / (s - i)) AS overlap FROM p WHERE i > 0 GROUP BY image, char_id"""
)
def box_iou_join(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d).withColumnRenamed("block_id", "image")
    chars = w.select("image", F.col("pos").alias("char_id"), "x", "y", F.lit(4).cast("bigint").alias("w"), "h")
    return geometry.chars_to_words(chars, w.where("pos % 2 = 1").withColumnRenamed("pos", "word_id"))


@query(
    f"""SELECT word_id, pos, CASE WHEN x + w - 1 > nx THEN nx - x + 1 ELSE w END AS w
        FROM (SELECT block_id AS word_id, pos, x, w, lead(x) OVER (PARTITION BY block_id ORDER BY pos, x, w) AS nx FROM {_WORDS})"""
)
def letter_overlap_repair(spark: SparkSession, d: str) -> DataFrame:
    letters = _words(spark, d).withColumnRenamed("block_id", "word_id").select("word_id", "pos", "x", "w")
    return geometry.trimmed_letters(letters).select("word_id", "pos", "w")


@query("SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT AS cls, list_max(embedding)::DOUBLE AS top FROM embeddings")
def argmax_decode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    top = F.array_max("embedding")
    return e.select("vec_id", F.array_position("embedding", top).alias("cls"), top.cast("double").alias("top"))


_FILES = [(f"{i:05d}{part}", i * 7 + 1 if i % 5 else 0, 800, 600 + (i % 3 == 0) * (part == "_boxes.png"), i % 7 == 0) for i in range(40) for part in (".json", "_screen.png", "_boxes.png")][:-1]


@query(
    f"""SELECT substr(name, 1, 5) AS capture, count(*) AS files,
        count(*) >= 3 AND bool_or(suffix(name, '.json')) AND bool_or(suffix(name, '_screen.png')) AND bool_or(suffix(name, '_boxes.png')) AND min(size) > 0 AND NOT bool_or(bad)
        AND max(w) = min(w) AND max(h) = min(h) AS valid FROM (VALUES {", ".join(map(str, _FILES))}) f(name, size, w, h, bad) GROUP BY 1"""
)
def capture_qa(spark: SparkSession, d: str) -> DataFrame:
    return geometry.capture_quality(spark.createDataFrame(_FILES, "name string, size int, width int, height int, error_page boolean"))


# streams


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, clock) AS hour, status_code, count(*) AS requests FROM requests WHERE clock IS NOT NULL GROUP BY ALL")
def stream_hourly_status(spark: SparkSession, d: str) -> DataFrame:
    """Requests by hour of event time and status, from a stream."""
    log = streams.read_log(spark, f"{d}/requests.parquet").where("clock IS NOT NULL")
    return streams.drained(streams.hourly_status(log), "complete")


@query("SELECT DISTINCT request_id FROM requests WHERE logged_at IS NOT NULL")
def stream_unique_requests(spark: SparkSession, d: str) -> DataFrame:
    log = streams.read_log(spark, f"{d}/requests.parquet").where("logged_at IS NOT NULL")
    return streams.drained(streams.unique_requests(log).select("request_id"))


@query(
    """SELECT siteindex, count_if(status_code = 'OK') AS pages, count(error_message) AS errors, sum(coalesce(content_size_bytes, 0))::BIGINT AS bytes FROM requests GROUP BY siteindex"""
)
def stream_running_totals(spark: SparkSession, d: str) -> DataFrame:
    """The last update of every site's totals, from a stream with state; repeats in the log are counted as they come."""
    stream = streams.running_totals(streams.read_log(spark, f"{d}/requests.parquet"))
    updates = streams.appended_updates(stream)
    return updates.groupBy("siteindex").agg(F.max("pages").alias("pages"), F.max("errors").alias("errors"), F.max("bytes").alias("bytes"))


# more of the crawl


@query(
    f"""SELECT request_id, (epoch_us(clock) // 1000 + trunc(greatest(coalesce(CASE WHEN isnan(retry_after_s) THEN NULL ELSE retry_after_s END * 1000, 0), 5000))::BIGINT)::BIGINT AS retry_ms
        FROM {_R} WHERE error_message IS NOT NULL AND coalesce(retry_count, 0) < 3 AND clock IS NOT NULL"""
)
def retry_times(spark: SparkSession, d: str) -> DataFrame:
    return crawl.retry_times(_requests(spark, d))


@query(
    f"""WITH f AS (SELECT DISTINCT url, status_code AS logged FROM {_R} WHERE status_code IS NOT NULL AND status_code <> 'OK' AND url IS NOT NULL),
             l AS (SELECT url, arg_max(status_code, request_id) AS fresh FROM {_R} WHERE url IS NOT NULL AND status_code IS NOT NULL GROUP BY url)
        SELECT f.url, f.logged, l.fresh FROM f LEFT JOIN l USING (url)"""
)
def errors_rechecked(spark: SparkSession, d: str) -> DataFrame:
    """Failed addresses beside their latest status in the log."""
    log = _requests(spark, d).where("url IS NOT NULL")
    fresh = log.where("status_code IS NOT NULL").groupBy("url").agg(F.max_by("status_code", "request_id").alias("status_code"))
    return crawl.rechecked_errors(log, fresh)


@query(
    f"""SELECT parent_url, url FROM (SELECT parent_url, url, row_number() OVER (PARTITION BY parent_url ORDER BY pos) AS n
        FROM (SELECT parent_url, url, min(request_id) AS pos FROM {_R} WHERE parent_url IS NOT NULL AND url IS NOT NULL GROUP BY ALL)) WHERE n <= 5"""
)
def links_capped_per_page(spark: SparkSession, d: str) -> DataFrame:
    links = _requests(spark, d).where("parent_url IS NOT NULL AND url IS NOT NULL").groupBy(F.col("parent_url").alias("page"), "url").agg(F.min("request_id").alias("pos"))
    return crawl.capped_links(links, 5).select(F.col("page").alias("parent_url"), "url")


@query(
    f"""SELECT request_id, url FROM {_R} WHERE url IS NOT NULL ORDER BY crawl_depth NULLS FIRST, request_id LIMIT 50"""
)
def frontier_next_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = _requests(spark, d).where("url IS NOT NULL").withColumn("seq", F.col("request_id"))
    return crawl.next_batch(rows, 50).select("request_id", "url")


@query(
    f"""SELECT request_id, CASE WHEN coalesce(content_size_bytes, 0) = 0 THEN 'no content' WHEN NOT coalesce({_SCOPED.replace('n.uri', 'n.url')}, false) THEN 'external'
        WHEN coalesce(crawl_depth, 0) >= 4 THEN 'too deep' END AS reason FROM {_R} n JOIN websites w USING (siteindex)"""
)
def should_crawl_links_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = _requests(spark, d).join(table(spark, d, "websites"), "siteindex")
    content = F.when(F.coalesce("content_size_bytes", F.lit(0)) > 0, "x")
    internal = crawl.is_internal(F.col("url"), F.col("rooturl"), F.col("rooturl"), F.col("scope"))
    return rows.select("request_id", crawl.should_crawl_links(content, internal, F.col("crawl_depth"), 4)["reason"].alias("reason"))


@query(
    rf"""SELECT uri FROM (SELECT uri, {_HOST.format('uri')} AS host, excludeurls FROM nlpdocs JOIN websites USING (siteindex))
        WHERE excludeurls IS NULL OR NOT regexp_matches({_PATH.format('uri')} || coalesce(regexp_extract(uri, '(\?[^#]*)', 1), ''), '^' || replace(regexp_replace(excludeurls, '([.?+])', '\\\1', 'g'), '*', '.*'))"""
)
def frontier_refiltered(spark: SparkSession, d: str) -> DataFrame:
    """Addresses still allowed by the exclude patterns of their site."""
    sites = table(spark, d, "websites")
    pages = table(spark, d, "nlpdocs").select(F.col("uri").alias("url"), F.col("siteindex").alias("host"))
    rules = sites.select(F.col("siteindex").alias("host"), F.when(F.col("excludeurls").isNotNull(), F.array("excludeurls")).alias("patterns"))
    return crawl.still_allowed(pages, rules).select(F.col("url").alias("uri"))


@query(
    """SELECT lang AS dataset, uri AS url FROM (SELECT lang, uri, row_number() OVER (PARTITION BY lang ORDER BY md5(uri || '#0'), uri) AS n
       FROM (SELECT DISTINCT lang, uri FROM documents WHERE uri IS NOT NULL AND lang IS NOT NULL)) WHERE n <= 100"""
)
def dataset_url_lists(spark: SparkSession, d: str) -> DataFrame:
    """At most 100 addresses of each dataset (the documents' labels), drawn by a seeded hash."""
    listed = table(spark, d, "documents").where("uri IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").alias("dataset"), F.col("uri").alias("url")).distinct()
    return corpus.dataset_samples(listed.select("dataset"), listed, n=100)


@query("SELECT c_custkey, (CASE WHEN c_acctbal < 0 THEN 0 ELSE least(round_even(c_acctbal, 0), 4999) END)::INT AS x FROM customer")
def points_clipped(spark: SparkSession, d: str) -> DataFrame:
    x, _ = geometry.clipped_point(F.col("c_acctbal"), F.lit(0.0), 5000, 1)
    return table(spark, d, "customer").select("c_custkey", x.alias("x"))


@query(
    "SELECT p_partkey, (round(p_size * (2280.0::DOUBLE / greatest(p_size, p_retailprice)) / 32) * 32)::INT AS w, (round(p_retailprice * (2280.0::DOUBLE / greatest(p_size, p_retailprice)) / 32) * 32)::INT AS h FROM part"
)
def sizes_scaled(spark: SparkSession, d: str) -> DataFrame:
    w, h = geometry.resized(F.col("p_size"), F.col("p_retailprice"), 2280, 32)
    return table(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"))


@query()
def links_maybe_known(spark: SparkSession, d: str) -> DataFrame:
    """Requested addresses a Bloom filter of the corpus's pages takes for known."""
    plain = lambda df, c: df.where(F.col(c).isNotNull()).select(urls.without_fragment(F.col(c)).alias("url"))
    return crawl.maybe_known(plain(_requests(spark, d), "url"), crawl.bloom_filter(plain(table(spark, d, "nlpdocs"), "uri")))


from corpusloom.plans import more_queries  # noqa: E402, F401  registers its queries beside these
