"""The corpus workload: element filters, per-site deduplication, vocabulary, charset and statistics.

Inputs are element streams (page_id, pos, siteindex, docelttype, doceltcmd,
nestinglevel, text).  Repeated rows count once; a null docelttype is a kind of
its own that isn't Document."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as tx
from corpusloom.operators.running import running
from corpusloom.plans.session import settle

MIN_WORDS = 5


COLUMNS = ("siteindex", "docelttype", "doceltcmd", "nestinglevel", "text")


def once(textdf: DataFrame, *columns: str) -> DataFrame:
    """Every element row once, with the columns asked for (all of the stream's by default).

    Repeats are exact, so that whole rows are keys of a hash aggregate, without a sort."""
    return textdf.select("page_id", "pos", *(columns or COLUMNS)).distinct()


def interesting(textdf: DataFrame) -> DataFrame:
    """Rows that hold text of the page: no Document rows but titles, no End rows, no null texts."""
    kind = ~F.col("docelttype").eqNullSafe("Document") | (F.col("doceltcmd") == "Title")
    return textdf.where(kind & (F.col("doceltcmd") != "End") & F.col("text").isNotNull())


def site_blocks(textdf: DataFrame) -> DataFrame:
    """The first occurrence of every text of a site, in page order.

    The least (page_id, pos) is a partial aggregate, so a text on many pages, or a site with a third
    of all rows, never gathers in one task."""
    rows = interesting(textdf).select("siteindex", "page_id", "pos", "text")
    first = rows.groupBy("siteindex", F.md5("text").alias("text_md5")).agg(F.min(F.struct("page_id", "pos", "text")).alias("f"))
    return first.select("siteindex", "text_md5", "f.page_id", "f.pos", "f.text")


def dataset(textdf: DataFrame, pages: DataFrame, language: str = "fr", min_words: int = MIN_WORDS) -> DataFrame:
    """Distinct blocks of a site of at least min_words tokens in a language (by the page's label).

    Deduplication comes before the filters, as a text first met on a page of another language is lost."""
    of_language = pages.where(F.substring(F.lower("lang"), 1, 2) == language).select("page_id")
    blocks = site_blocks(textdf).withColumn("words_count", tx.words_count(F.col("text")))
    return blocks.where(F.col("words_count") >= min_words).join(of_language, "page_id", "left_semi")


def site_word_stats(blocks: DataFrame, sites: DataFrame) -> DataFrame:
    """(website, words_count, percent) of every site, those without words included."""
    n = blocks.groupBy("siteindex").agg(F.sum(tx.words_count(F.col("text"))).alias("n"))
    out = sites.select("siteindex", "website").join(n, "siteindex", "left").withColumn("words_count", F.coalesce("n", F.lit(0)))
    return out.select("website", "words_count", (F.col("words_count") * 100.0 / n.agg(F.sum("n")).scalar()).alias("percent"))


def totals(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.sum(F.length("text")).alias("characters"), F.sum(tx.words_count(F.col("text"))).alias("words"), F.count(F.lit(1)).alias("blocks"))


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(word, cnt): occurrences of every token."""
    return blocks.select(F.explode(tx.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def charset(vocab: DataFrame) -> DataFrame:
    """(ch, cnt): occurrences of every character, from the words' counts."""
    return vocab.select(F.explode(tx.characters(F.col("word"))).alias("ch"), "cnt").groupBy("ch").agg(F.sum("cnt").alias("cnt"))


def cumulative_percent(counts: DataFrame, key: str) -> DataFrame:
    """counts(key, cnt) with the running share of all occurrences, most frequent first, ties by key.

    The running sum is over range partitions, so that the many words of one count are split."""
    rows = running(counts, [], [F.desc("cnt"), F.col(key)], {"_sum": F.col("cnt")})
    return rows.select(key, "cnt", (100.0 * F.col("_sum") / counts.agg(F.sum("cnt")).scalar()).alias("percent"))


@F.arrow_udf(T.StringType())
def char_name(chars: pa.Array) -> pa.Array:
    """The Unicode name of a character, by default CHAR and its code."""
    return pa.array([unicodedata.name(c, f"CHAR {ord(c)}") if c else None for c in chars.to_pylist()], pa.string())


@F.arrow_udf(T.IntegerType())
def char_code(chars: pa.Array) -> pa.Array:
    return pa.array([ord(c[0]) if c else None for c in chars.to_pylist()], pa.int32())


def charset_table(chars: DataFrame) -> DataFrame:
    """Charset with code, name and classes."""
    c = F.col("ch")
    return chars.select(
        char_code(c).alias("code"), "cnt", "ch", char_name(c).alias("name"),
        c.rlike(r"^\p{L}$").alias("is_alpha"), c.rlike(r"^\p{Nd}$").alias("is_digit"), c.rlike(r"^[\s\p{Z}]$").alias("is_space"),
    )


def tag_sets(lexicon: DataFrame) -> DataFrame:
    """(token, tags): the distinct tags of every token of lexicon(token, tag), sorted."""
    return lexicon.where(F.col("token").isNotNull() & F.col("tag").isNotNull()).groupBy("token").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))


def lexicon_tags(words: DataFrame, tags: DataFrame) -> DataFrame:
    """words(word) with the tags of lexicon tags(token, tags): as written, else in lower case, else Number.

    A lexicon is joined by what its size allows: Spark broadcasts it below its threshold."""
    a = tags.select(F.col("token").alias("word"), F.col("tags").alias("_a"))
    b = tags.select(F.col("token").alias("_low"), F.col("tags").alias("_b"))
    out = words.withColumn("_low", F.lower("word")).join(a, "word", "left").join(b, "_low", "left")
    number = F.when(tx.is_number(F.col("word")), F.lit("Number"))
    return out.withColumn("tags", F.coalesce("_a", "_b", number)).drop("_a", "_b", "_low")


def unknown_words(vocab: DataFrame) -> DataFrame:
    """Words without common tags, or names."""
    return vocab.where(F.col("commontags").isNull() | (F.col("commontags") == "None") | F.col("commontags").contains("PROPN"))


def nouns(vocab: DataFrame, n: int) -> DataFrame:
    """The n most frequent words tagged as nouns (a report)."""
    return vocab.where(F.col("commontags").contains("NOUN")).orderBy(F.desc("cnt"), "word", "lang").limit(n)


def separator_characters(chars: DataFrame) -> DataFrame:
    return chars.where(~F.col("ch").rlike(r"^[\p{L}\p{Nd}]$"))


def separator_neighbours(text: Column, char: str) -> Column:
    """How a separator's first occurrence was cut: (own, before, after).

    ``own`` says that it is a token of its own; the neighbours then are the tokens around it, else the
    parts of the token that holds it, with << or >> for what comes from the tokens beside."""
    t = tx.tokens(text)
    at = F.array_position(t, char).cast("int")
    nth = lambda i: F.try_element_at(t, i)
    holder = F.get(F.filter(t, lambda x: x.contains(char)), F.lit(0))
    own = F.struct(
        F.lit(True).alias("own"),
        F.when(at > 1, F.concat(F.lit("<<"), nth(at - 1))).alias("before"),
        F.when(at < F.size(t), F.concat(nth(at + 1), F.lit(">>"))).alias("after"),
    )
    inner = F.struct(F.lit(False).alias("own"), F.substring_index(holder, char, 1).alias("before"), F.substring(holder, F.locate(char, holder) + 1, F.length(holder)).alias("after"))
    return F.when(at > 0, own).when(holder.isNotNull(), inner)


def trigram_profiles(texts: DataFrame) -> DataFrame:
    """(lang, gram, weight) of labelled texts(text, lang): log probabilities of character trigrams, and of an
    unseen one (gram null), for each language.  A few thousand rows a language, whatever the number of texts."""
    counts = texts.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.explode(_trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kinds = counts.select("gram").distinct().count()
    seen = counts.join(F.broadcast(total), "lang").select("lang", "gram", F.log((F.col("n") + 0.5) / (F.col("total") + 0.5 * kinds)).alias("weight"))
    return seen.unionByName(total.select("lang", F.lit(None).cast("string").alias("gram"), F.log(0.5 / (F.col("total") + 0.5 * kinds)).alias("weight")))


def _trigrams(text: Column) -> Column:
    """The trigrams of a text in lower case, with one space for each run of other characters than letters."""
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))), lambda g: F.length(g) == 3)


def detected_languages(texts: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """(key, lang, confidence) of texts(key, text): the language whose profile gives the text's trigrams the greatest
    probability, and its posterior; texts without letters have none.  A naive Bayes classifier in joins and sums:
    only distinct trigrams of a text with their counts are shuffled."""
    grams = texts.select(key, F.explode(_trigrams(F.col("text"))).alias("gram")).where("trim(gram) <> ''").groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))
    base = profiles.where("gram IS NULL").select("lang", F.col("weight").alias("unseen"))
    by_gram = profiles.where("gram IS NOT NULL").join(base, "lang").groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.col("weight") - F.col("unseen")))).alias("gain"))
    gains = grams.join(by_gram, "gram").select(key, "n", F.explode("gain").alias("lang", "w")).groupBy(key, "lang").agg(F.sum(F.col("n") * F.col("w")).alias("gain"))
    totals = grams.groupBy(key).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(base))  # a row for each language
    scores = totals.join(gains, [key, "lang"], "left").select(key, "lang", (F.col("n") * F.col("unseen") + F.coalesce("gain", F.lit(0.0))).alias("score"))
    best = scores.groupBy(key).agg(F.max_by("lang", F.struct("score", "lang")).alias("lang"), F.max("score").alias("top"), F.collect_list("score").alias("all"))
    return best.select(key, "lang", (1 / F.aggregate(F.transform("all", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)).alias("confidence"))


def nearest_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, nearest, distance) of words(word) within one edit of a word of lexicon(entry), ties to the least.

    Two words within one edit share themselves or a word with one character deleted; joining on these
    finds all pairs without comparing every word with every entry."""

    def variants(df: DataFrame, c: str) -> DataFrame:
        dropped = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))
        return df.select(c, F.explode(F.array_distinct(F.concat(F.array(F.col(c)), F.when(F.length(c) > 0, dropped).otherwise(F.array().cast("array<string>"))))).alias("v"))

    pairs = variants(words.select("word").distinct(), "word").join(variants(lexicon.select("entry").distinct(), "entry"), "v").select("word", "entry").distinct()
    near = pairs.withColumn("distance", F.levenshtein("word", "entry")).where(F.col("distance") <= 1)
    best = near.groupBy("word").agg(F.min(F.struct("distance", "entry")).alias("b"))
    return best.select("word", F.col("b.entry").alias("nearest"), F.col("b.distance").alias("distance"))


def nearest_words_at_any_distance(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, nearest, distance) of every word of words(word), ties to the least; lexicon(entry) is a fixed table.

    Only words without an entry within one edit are held against the whole lexicon."""
    near = nearest_words(words, lexicon)
    far = words.select("word").where("word IS NOT NULL").distinct().join(near.select("word"), "word", "left_anti")
    far = far.repartition(4 * words.sparkSession.sparkContext.defaultParallelism, "word")  # little data, much work
    pairs = far.crossJoin(F.broadcast(lexicon.select("entry").where("entry IS NOT NULL").distinct()))
    best = pairs.groupBy("word").agg(F.min(F.struct(F.levenshtein("word", "entry").alias("distance"), "entry")).alias("b"))
    return near.unionByName(best.select("word", F.col("b.entry").alias("nearest"), F.col("b.distance").alias("distance")))


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows, the same in every run: those with the least hash of their key."""
    return df.withColumn("_h", F.md5(F.col(key).cast("string"))).orderBy("_h", key).limit(n).drop("_h")


def text_strings(textdf: DataFrame) -> DataFrame:
    """Titles and texts in reading order: (page_id, pos, text)."""
    shown = F.col("text").isNotNull() & (F.col("text") != "") & ~F.col("docelttype").eqNullSafe("Document")
    return textdf.where(shown & F.col("doceltcmd").isin("Start", "Text")).select("page_id", "pos", "text")


def unigram_segments(texts: DataFrame, pieces: dict[str, float]) -> DataFrame:
    """(doc_id, segments): the best path of every word over scored pieces; characters without a piece stand alone."""
    longest = max(map(len, pieces), default=1)

    def run(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            row: list[str] = []
            for word in (text or "").split():
                n = len(word)
                best = [0.0] + [-1e18] * n
                back = [0] * (n + 1)
                for i in range(n):
                    for j in range(i + 1, min(n, i + longest) + 1):
                        score = pieces.get(word[i:j], -30.0 if j == i + 1 else None)
                        if score is not None and best[i] + score > best[j]:
                            best[j], back[j] = best[i] + score, i
                cut, j = [], n
                while j > 0:
                    cut.append(word[back[j] : j])
                    j = back[j]
                row += cut[::-1]
            out.append(row)
        return pa.array(out, pa.list_(pa.string()))

    return texts.select("doc_id", F.arrow_udf(run, T.ArrayType(T.StringType()))("text").alias("segments"))


def dataset_samples(lines: DataFrame, urls: DataFrame, n: int = 10_000, seed: int = 0) -> DataFrame:
    """urls(dataset, url) of the listed datasets lines(dataset), at most n of each, drawn by a seeded hash (a sampling operator).

    Up to spark.sql.optimizer.windowGroupLimitThreshold, Spark keeps the first n of every partition before it shuffles."""
    chosen = urls.join(lines.select("dataset").distinct(), "dataset", "left_semi")
    w = Window.partitionBy("dataset").orderBy(F.md5(F.concat(F.col("url"), F.lit(f"#{seed}"))), "url")
    return chosen.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def write_csv(df: DataFrame, folder: str, separator: str = ";") -> None:
    """A table as lines with a header."""
    df.write.mode("overwrite").option("sep", separator).option("header", True).csv(folder)


def cached_table(df_of, spark, path: str) -> DataFrame:
    """The table at a path; if there is none, what df_of() gives is written there first."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df_of().write.parquet(path)
    return spark.read.parquet(path)


def piece_counts(pieces: DataFrame) -> DataFrame:
    """(piece, count) of unigram pieces(piece, logprob): probabilities in millionths."""
    return pieces.select("piece", F.round(F.exp("logprob") * 1e6, 3).alias("count"))


def trained_pieces(words: DataFrame, size: int = 8_000, longest: int = 8) -> DataFrame:
    """(piece, logprob) of a unigram model of words(word, cnt): the pieces of up to ``longest`` characters that save most
    characters over single ones, and all single characters; their log probability is that of their occurrences."""
    n = F.length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda k: F.substring("word", i, k))))
    counts = words.where(n > 0).select(F.explode(spans).alias("piece"), "cnt").groupBy("piece").agg(F.sum("cnt").alias("n"))
    gain = F.when(F.length("piece") == 1, F.lit(2**62)).otherwise(F.col("n") * (F.length("piece") - 1))
    kept = settle(counts.orderBy(F.desc(gain), "piece").limit(size))
    return kept.select("piece", F.log(F.col("n") / kept.agg(F.sum("n")).scalar()).alias("logprob"))


def megabytes(size: Column) -> Column:
    """A size in bytes as text in MB with one decimal."""
    return F.concat(F.format_string("%.1f", F.round(size / 1048576.0, 1)), F.lit(" MB"))
