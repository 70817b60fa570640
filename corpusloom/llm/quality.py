"""Problem 1: per-document text quality statistics.

All statistics are row-local sums over the lines of a block, computed over Arrow
batches in the scan before any shuffle; a page's are their sums over its main
body.  Published rules with their fixed thresholds then give a reason for every
failed one (``published``).  They are made for long texts in English: four in five
bodies of these pages that fail one are prose, most of them Thai, which has no
full stops, or Japanese and Chinese, whose runs of letters aren't words.  A body
that fails any is therefore held against a second, own set of rules for all
scripts (``reasons``), of which ``not_prose`` decides.

Nulls, empty texts and pages without any body text give zero statistics and no
failure; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import chars
from corpusloom.llm.mainbody import main_body

# Fixed values of published rules.  Rae et al. 2021, Scaling Language Models (Gopher), table A1: words, their mean length, hash
# signs and ellipses a word, lines with bullets, lines that end in ellipses, words with a letter, stop words.
GOPHER = {"words": (50, 100_000), "mean_word": (3, 10), "marks": 0.1, "bullets": 0.9, "ellipses": 0.3, "letter_words": 0.8, "stop_words": 2}
# Penedo et al. 2024, The FineWeb Datasets, section 3.6: lines that end in punctuation, lines under 30 characters.
FINEWEB = {"punctuated": 0.12, "short_lines": 0.67, "short": 30}
#: Fixed thresholds of the own rules.
MIN_PROSE_SHARE = 0.5
SHORT_LINE = 60
MAX_SYMBOL_SHARE = 0.22
MAX_BROKEN_SHARE = 0.02
MIN_LETTER_SHARE = 0.6
MAX_MEAN_WORD = 14.0
MIN_COMMON_SHARE = 0.04
MIN_PUNCTUATED_SHARE = 0.2
#: Reasons that make a body that isn't prose junk rather than a list or a table.
JUNK = ("broken_text", "code", "keywords", "long_words")
#: Function words of the spaced languages that prose can't do without.
COMMON_WORDS = (
    "the and of to in is for de la le les et des que que est pour der die das und ist für von "
    "el los las y por un una il di che e per non lo в и на не что с по для"
)

_FIELDS = ("visible", "letters", "symbols", "digits", "broken", "prose", "words", "sentences", "lines", "short", "punctuated", "bullets", "common", "code_lines", "listed", "marks", "ellipses", "letter_words", "tiny")


#: Characters that the statistics ask for, a bit for each set.
_SETS = {"stop": ".!?…", "closer": ")]»”’\"'", "wide_stop": "。！？", "unit": "%€$£", "wrong": "ÃÂÐÑãäåæçèéïâ", "code": "{}<>\\^~_=#@$[]", "column": ";|\t", "bullet": "-•*·▪■–"}


@functools.lru_cache(maxsize=1)
def _set_bits() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for i, members in enumerate(_SETS.values()):
        table[[ord(c) for c in members]] |= np.uint8(1 << i)
    return table


def _shift(flag: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(flag)
    if by > 0:
        out[by:] = flag[:-by]
    elif by < 0:
        out[:by] = flag[-by:]
    return out


def batch_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of every text, as sums over its lines.

    A line is prose if it is unbroken text whose sentences end, or has the
    length of a sentence without the separators of a list or table row."""
    cp, bounds = chars.code_points(texts)
    kinds = chars.classes()[cp]
    starts, ends_at, row = chars.lines(cp, bounds)
    line_of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(cp)))
    # most flags are rare: their places are counted, where running sums would pass over all characters; none is ever at a line's end
    at_line = lambda places: np.bincount(line_of[places], minlength=len(starts))
    per_line = lambda flag: at_line(np.flatnonzero(flag))
    sets = _set_bits()[np.minimum(cp, 0xFFFF)]
    among = {k: (sets & np.uint8(1 << i)) > 0 for i, k in enumerate(_SETS)}
    space = (kinds & chars.SPACE) > 0
    lm = (kinds & (chars.LETTER | chars.MARK)) > 0
    alnum = lm | ((kinds & chars.DIGIT) > 0)
    edge = np.zeros(len(cp) + 1, bool)
    edge[bounds] = True
    last = edge[1:]
    visible_run = chars.running(~space)
    visible = visible_run[ends_at] - visible_run[starts]
    letter_run = chars.running(lm)
    letters, digits = letter_run[ends_at] - letter_run[starts], per_line((kinds & chars.DIGIT) > 0)
    symbols = per_line((kinds & chars.SYMBOL) > 0)
    stop, closer = among["stop"], among["closer"]
    after_word = _shift(alnum | closer | stop | among["unit"], 1)
    before_gap = last | _shift(space | closer, -1)
    sentence = (stop & after_word & before_gap) | among["wide_stop"]
    stops = per_line(sentence)
    low = (cp >= 0x80) & (cp <= 0xBF)
    broken = per_line((cp == 0xFFFD) | ((cp >= 0x80) & (cp <= 0x9F)) | (among["wrong"] & _shift(low, -1)))
    hexed = per_line((cp == ord("0")) & _shift(cp == ord("x"), -1))
    code = per_line(among["code"]) + hexed
    listed = per_line((cp == ord(",")) & _shift(space, -1))
    commas = per_line(cp == ord(","))
    w0, w1 = chars.runs(alnum, bounds)
    words, letter_words = at_line(w0), at_line(w0[letter_run[w1] > letter_run[w0]])
    dot, dots = cp == ord("."), cp == ord("…")
    triple = dot & _shift(dot, -1) & _shift(_shift(dot, -1), -1) & ~_shift(dot, 1)
    marks = per_line((cp == ord("#")) | dots | triple)
    low_cp = chars.lower_table()[cp]
    short = (w1 - w0) <= 6
    common = at_line(w0[short][np.isin(chars.span_hashes(low_cp, w0[short], w1[short]), _common_hashes())])
    columns = per_line(among["column"])
    gap = np.flatnonzero(space & _shift(space, -1) & ~_shift(space, 1) & (cp != 10))
    if len(gap):  # two spaces with text on both sides of them in the line
        at = np.searchsorted(starts, gap, side="right") - 1
        inside = (gap > starts[at]) & (visible_run[ends_at[at]] > visible_run[np.minimum(gap + 1, len(cp))])
        columns = columns + np.bincount(at[inside], minlength=len(starts))
    first = np.minimum(starts, max(len(cp) - 1, 0))
    bullet = (visible > 0) & among["bullet"][first] & (ends_at > starts) if len(cp) else np.zeros(len(starts), bool)
    final = np.minimum(np.maximum(ends_at - 1, 0), max(len(cp) - 1, 0))
    ends_so = (ends_at > starts) & (dots | (dot & _shift(dot, 1) & _shift(_shift(dot, 1), 1)))[final] if len(cp) else np.zeros(len(starts), bool)
    thai = per_line((cp >= 0x0E00) & (cp <= 0x0E7F)) * 2 > letters
    cjk = per_line(((cp >= 0x3040) & (cp <= 0x30FF)) | ((cp >= 0x4E00) & (cp <= 0x9FFF))) * 2 > letters
    clean = (broken <= MAX_BROKEN_SHARE * visible) & (code * 25 <= visible) & (letters >= MIN_LETTER_SHARE * visible)
    spaced = (stops > 0) & (visible <= stops * 400) & (visible >= 12)
    bare = (visible >= np.where(cjk, 11, 28)) & (commas * 25 <= visible) & (columns == 0) & (cjk | (visible <= 12 * words))
    prose = clean & np.where(thai, (visible >= 30) & (commas * 60 <= visible), spaced | bare)
    full = visible > 0
    by_line = {
        "visible": visible, "letters": letters, "symbols": symbols, "digits": digits, "broken": broken, "prose": np.where(prose, visible, 0),
        "words": words, "sentences": np.where(prose, np.maximum(stops, 1), 0), "lines": full, "short": full & (ends_at - starts < SHORT_LINE),
        "punctuated": full & (stops > 0), "bullets": bullet, "common": common,
        "code_lines": full & ((code * 25 > visible) | (hexed > 0)), "listed": listed,
        "marks": marks, "ellipses": ends_so, "letter_words": letter_words, "tiny": full & (ends_at - starts < FINEWEB["short"]),
    }
    n = len(bounds) - 1
    return {k: np.bincount(row, weights=v, minlength=n).astype(np.int32) for k, v in by_line.items()}


@functools.lru_cache(maxsize=1)
def _common_hashes() -> np.ndarray:
    return np.array(sorted({chars.text_hash(w) for w in COMMON_WORDS.split()}), np.uint64)


_STRUCT = T.StructType([T.StructField(f, T.IntegerType()) for f in _FIELDS])


@F.arrow_udf(_STRUCT)
def text_stats(texts: pa.Array) -> pa.Array:
    def work(part: pa.Array) -> pa.Array:
        stats = batch_stats(part)
        return pa.StructArray.from_arrays([pa.array(stats[f]) for f in _FIELDS], list(_FIELDS))

    return chars.in_chunks(texts, work)


def page_quality(textdf: DataFrame, nlpdocs: DataFrame) -> DataFrame:
    """One row for each page of nlpdocs: its statistics, shares and the failed rules."""
    return quality_of(main_body(textdf, nlpdocs, (text_stats(F.col("text")).alias("st"),)), nlpdocs)


def quality_of(body: DataFrame, nlpdocs: DataFrame) -> DataFrame:
    """The same of the rows of main_body with their statistics ``st``."""
    body = body.where(~F.col("boiler") & ~F.col("is_doc") & (F.col("cmd") == "Text"))
    sums = body.groupBy("page_id").agg(
        *(F.sum(F.col("st")[f]).alias(f) for f in _FIELDS),
        F.sum(F.when(F.col("level") >= 4, F.col("st.visible"))).alias("cells"),
        F.sum(F.when(F.col("kind") == "ListItem", F.col("st.visible"))).alias("items"),
    )
    pages = nlpdocs.select("page_id", F.lower(F.trim("uri")).endswith(".pdf").alias("pdf")).groupBy("page_id").agg(F.max("pdf").alias("pdf"))
    df = pages.join(sums, "page_id", "left").na.fill(0, [*_FIELDS, "cells", "items"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    df = df.withColumns(
        {
            "prose_share": share("prose", "visible"),
            "symbol_share": share("symbols", "visible"),
            "letter_share": share("letters", "visible"),
            "broken_share": share("broken", "visible"),
            "mean_word": share("letters", "words"),
            "short_share": share("short", "lines"),
            "punctuated_share": share("punctuated", "lines"),
            "bullet_share": share("bullets", "lines"),
            "common_share": share("common", "words"),
            "pdf": F.coalesce("pdf", F.lit(False)),
        }
    )
    thin = F.col("prose_share") < MIN_PROSE_SHARE
    published = {
        "gopher_words": ~F.col("words").between(*GOPHER["words"]),
        "gopher_mean_word": ~F.col("mean_word").between(*GOPHER["mean_word"]),
        "gopher_marks": F.col("marks") > GOPHER["marks"] * F.col("words"),
        "gopher_bullets": F.col("bullet_share") > GOPHER["bullets"],
        "gopher_ellipses": F.col("ellipses") > GOPHER["ellipses"] * F.col("lines"),
        "gopher_letter_words": F.col("letter_words") < GOPHER["letter_words"] * F.col("words"),
        "gopher_stop_words": F.col("common") < GOPHER["stop_words"],
        "fineweb_punctuated": F.col("punctuated_share") <= FINEWEB["punctuated"],
        "fineweb_short_lines": F.col("tiny") >= FINEWEB["short_lines"] * F.col("lines"),
    }
    rules = {
        "not_prose": thin,
        "broken_text": F.col("broken_share") > MAX_BROKEN_SHARE,
        "few_letters": F.col("letter_share") < MIN_LETTER_SHARE,
        "symbols": F.col("symbol_share") > MAX_SYMBOL_SHARE,
        "short_lines": thin & (F.col("short_share") > 0.8),
        "unpunctuated": thin & (F.col("punctuated_share") < MIN_PUNCTUATED_SHARE),
        "code": thin & (F.col("code_lines") * 2 > F.col("lines")),
        "keywords": thin & (F.col("listed") * 4 >= F.col("words")),
        "no_common_words": thin & (F.col("common_share") < MIN_COMMON_SHARE),
        "long_words": thin & (F.col("mean_word") > MAX_MEAN_WORD),
    }
    failed = lambda rs: F.filter(F.array(*(F.when((F.col("visible") > 0) & r, F.lit(name)) for name, r in rs.items())), lambda x: x.isNotNull())
    return df.withColumn("published", failed(published)).withColumn("reasons", failed(rules)).withColumn("junk", thin & F.arrays_overlap("reasons", F.array(*map(F.lit, JUNK))))


def junk_pages(quality: DataFrame) -> DataFrame:
    """(page_id) whose main body as a whole fails a published rule and, by the check, isn't prose; never a PDF."""
    return quality.where(~F.col("pdf") & (F.size("published") > 0) & F.array_contains("reasons", "not_prose")).select("page_id")
