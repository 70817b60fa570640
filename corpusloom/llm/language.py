"""Problem 5: missing or wrong document language labels.

A bidirectional gated recurrent network over bytes labels every position of
every word; the positions' log probabilities are pooled over words, lines and
the pages' main bodies.  The network is fitted by backpropagation through time
on the driver, on a bounded sample (SAMPLE_ROWS rows) of the pages' own labels,
wrong ones included.  Its unit is the word (in scripts without spaces the
character), with marks for its two ends: a batch has few different words, so
that each is run through the network once.

A line's scores travel as one integer: for each language, how far it lies
behind the best, in steps of a quarter, at most 127.  That bounds the weight of a
line in its page on purpose: without it, one long foreign paragraph (of Thai, say,
whose every character is sure) outvoted the page's own language.  Pages whose body is junk,
and pages or lines without letters, have no language.  Nulls: a null label is a
missing one; a null text has no lines; repeated rows count once; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import chars
from corpusloom.llm.gru import ByteGRU
from corpusloom.llm.mainbody import main_body
from corpusloom.llm.quality import quality_of, text_stats
from corpusloom.plans.session import settle

LANGUAGES = ("fr", "en", "de", "es", "it", "ru", "ja", "zh", "th")
#: The classifier's sample: pages, rows of all, words a language; bytes of a word run at once in training, and in use.
SAMPLE_PAGES, SAMPLE_ROWS, SAMPLE_WORDS, PIECE, LONG_PIECE = 3_000, 12_000, 8_000, 16, 256
TRAIN_STEPS, HIDDEN = 1_000, 32
LONG_LINE = 40
#: How far behind a line's best language the page's must lie, in quarters.
MARGIN = 16
_STEP = 0.25
#: Words kept with their scores in each Python worker.
CACHE_WORDS = 400_000


def word_spans(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; characters of scripts without spaces are words of their own."""
    inside = (chars.classes()[cp] & (chars.LETTER | chars.MARK)) > 0
    single = ((cp >= 0x0E00) & (cp <= 0x0E7F)) | ((cp >= 0x3040) & (cp <= 0x30FF)) | ((cp >= 0x3400) & (cp <= 0x9FFF))
    edge = np.zeros(len(cp) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if len(cp) else inside
    alone = np.concatenate([[False], single[:-1]]) if len(cp) else single
    start = inside & (~before | single | alone | edge[:-1])
    after = np.concatenate([inside[1:], [False]]) if len(cp) else inside
    next_alone = np.concatenate([single[1:], [False]]) if len(cp) else single
    end = inside & (~after | single | next_alone | edge[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def byte_ids(words: list[str], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The padded bytes of all pieces of the words, ends marked, and each piece's word."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        raw = b"\x02" + w.encode("utf-8", "replace") + b"\x03"
        for a in range(0, len(raw), piece):
            pieces.append(raw[a : a + piece])
            owner.append(i)
    ids = np.zeros((len(pieces), max([1, *map(len, pieces)])), np.uint8)
    for i, x in enumerate(pieces):
        ids[i, : len(x)] = np.frombuffer(x, np.uint8)
    return ids, np.array(owner, np.int64)


def word_scores(model: ByteGRU, words: list[str]) -> np.ndarray:
    """(words, languages): pooled log probabilities, centred on their best."""
    out = np.zeros((len(words), len(LANGUAGES)), np.float32)
    for a in range(0, len(words), 4096):
        part = words[a : a + 4096]
        ids, owner = byte_ids(part, LONG_PIECE)
        order = np.argsort((ids != 0).sum(axis=1), kind="stable")
        for b in range(0, len(order), 512):
            pick = order[b : b + 512]
            x = ids[pick]
            x = x[:, : int((x != 0).sum(axis=1).max())]
            np.add.at(out, a + owner[pick], model.pooled(x))
    return out


_CACHE: dict[str, dict[int, int]] = {}
_ROWS: dict[str, list] = {}


def _scores_of(model: ByteGRU, key: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, languages) for all spans, each different word run once a worker."""
    hashes = chars.span_hashes(cp, starts, ends)
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if key not in _CACHE or len(_CACHE[key]) > CACHE_WORDS:
        _CACHE.clear()
        _ROWS.clear()
        _CACHE[key], _ROWS[key] = {}, [np.zeros((0, len(LANGUAGES)), np.float32)]
    known = _CACHE[key]
    at = np.array([known.get(h, -1) for h in unique.tolist()], np.int64)
    new = np.flatnonzero(at < 0)
    if len(new):
        words = [cp[starts[i] : ends[i]].astype("<u4").tobytes().decode("utf-32-le", "replace") for i in first[new]]
        rows = _ROWS[key][0]
        at[new] = len(rows) + np.arange(len(new))
        known.update(zip(unique[new].tolist(), at[new].tolist()))
        _ROWS[key][0] = np.concatenate([rows, word_scores(model, words)])
    return _ROWS[key][0][at][inverse]


_LINE = T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("chars", T.IntegerType()), T.StructField("packed", T.LongType())])


def pack(scores: np.ndarray) -> np.ndarray:
    behind = np.clip(np.rint((scores.max(axis=1, keepdims=True) - scores) / _STEP), 0, 127).astype(np.int64)
    out = np.zeros(len(scores), np.int64)
    for i in range(len(LANGUAGES)):
        out |= behind[:, i] << (7 * i)
    return out


def behind(packed: Column, i: int) -> Column:
    """How far language i lies behind the best, in quarters."""
    return F.shiftright(packed, 7 * i).bitwiseAND(F.lit(127))


def batch_lines(model: ByteGRU, key: str, texts: pa.Array) -> pa.Array:
    cp, bounds = chars.code_points(texts)
    low = chars.lower_table()[cp]
    starts, ends = word_spans(cp, bounds)
    l0, l1, row = chars.lines(cp, bounds)
    n, langs = len(l0), len(LANGUAGES)
    sums = np.zeros((n, langs))
    if len(starts):
        scores = _scores_of(model, key, low, starts, ends)
        line = np.searchsorted(l0, starts, side="right") - 1
        for i in range(langs):
            sums[:, i] = np.bincount(line, weights=scores[:, i], minlength=n)
        words = np.bincount(line, minlength=n)
    else:
        words = np.zeros(n, np.int64)
    first = np.searchsorted(row, np.arange(len(bounds) - 1))
    number = np.arange(n) - first[row] + 1
    real = words > 0
    count = np.bincount(row[real], minlength=len(bounds) - 1)
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    items = pa.StructArray.from_arrays(
        [pa.array(number[real].astype(np.int32)), pa.array((l1 - l0)[real].astype(np.int32)), pa.array(pack(sums[real]))],
        ["line_no", "chars", "packed"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def line_scores(model: ByteGRU):
    """A function of a text column: (line_no, chars, packed) of each line with letters."""
    key = uuid.uuid4().hex

    def run(texts: pa.Array) -> pa.Array:
        return chars.in_chunks(texts, lambda part: batch_lines(model, key, part))

    return F.arrow_udf(run, T.ArrayType(_LINE))


def label_code(label: Column) -> Column:
    """The language a label means, by its first two letters; null for none."""
    code = F.lower(F.substring(F.trim(label), 1, 2))
    return F.when(code.isin(*LANGUAGES), code)


def training_words(rows: list[tuple[str, str]], per_language: int = SAMPLE_WORDS) -> tuple[list[str], np.ndarray]:
    """Words and labels of labelled texts, as many of each language."""
    rng = np.random.default_rng(11)
    words: list[str] = []
    labels: list[int] = []
    for i, lang in enumerate(LANGUAGES):
        for furniture in (False, True):  # half of the words from short texts
            texts = sorted(t for t, known in rows if known == lang and (len(t) < 60) == furniture)
            if not texts:
                continue
            cp, bounds = chars.code_points(pa.array([t.lower() for t in texts], pa.large_string()))
            a, b = word_spans(cp, bounds)
            for k in rng.choice(len(a), min(per_language // 2, len(a)), replace=False) if len(a) else []:
                words.append(cp[a[k] : b[k]].astype("<u4").tobytes().decode("utf-32-le", "replace"))
                labels.append(i)
    return words, np.array(labels, np.int64)


def fit(rows: list[tuple[str, str]], steps: int = TRAIN_STEPS) -> ByteGRU:
    """The network fitted on labelled texts."""
    model = ByteGRU(len(LANGUAGES), hidden=HIDDEN)
    words, labels = training_words(rows)
    if words:
        ids, owner = byte_ids(words)
        y = labels[owner]
        share = np.bincount(y, minlength=len(LANGUAGES)).astype(float)
        weight = np.where(share > 0, 1 / np.maximum(share, 1), 0)[y]
        pick = np.random.default_rng(5).choice(len(ids), 60_000, p=weight / weight.sum())
        model.train(ids[pick], y[pick], steps=steps)
    return model


def sample_rows(textdf: DataFrame, nlpdocs: DataFrame) -> list[tuple[str, str]]:
    """At most 2 x SAMPLE_ROWS labelled texts of about SAMPLE_PAGES pages, the same in every run:
    running text under its page's label, page furniture under the label most pages of the site have."""
    label = label_code(F.col("lang")).alias("label")
    pages = nlpdocs.select("page_id", "siteindex", label).where("label IS NOT NULL")
    sites = pages.groupBy("siteindex", "label").count().groupBy("siteindex").agg(F.max_by("label", F.struct("count", "label")).alias("label"))
    every = max(1, nlpdocs.count() // SAMPLE_PAGES)
    picked = F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0
    own = textdf.where(picked & (F.col("docelttype") == "TextBlock") & F.length("text").between(60, 600)).select("page_id", "text")
    long = own.join(pages.where(picked), "page_id").select("text", "label").orderBy(F.xxhash64("text"), "label").limit(SAMPLE_ROWS)
    shared = textdf.where(picked & (F.col("nestinglevel") <= 2) & (F.col("docelttype") != "Document") & F.length("text").between(3, 200))
    short = shared.where("nestinglevel = 1 OR docelttype = 'ListItem'").select("siteindex", "text")
    short = short.join(sites, "siteindex").select("text", "label").orderBy(F.xxhash64("text"), "label").limit(SAMPLE_ROWS)
    return [(r.text, r.label) for r in long.unionByName(short).collect()]


def page_lines(textdf: DataFrame, nlpdocs: DataFrame, model: ByteGRU | None = None) -> DataFrame:
    """The rows of main_body with their lines' scores and statistics."""
    model = model or fit(sample_rows(textdf, nlpdocs))
    text = F.col("text")
    return main_body(textdf, nlpdocs, (text_stats(text).alias("st"), line_scores(model)(text).alias("lines")))


def page_languages(rows: DataFrame, nlpdocs: DataFrame) -> DataFrame:
    """(page_id, lang, confidence, label) of every page with a language: that of its main body."""
    body = rows.where(~F.col("boiler") & ~F.col("is_doc") & (F.size("lines") > 0))
    lines = body.select("page_id", F.explode("lines").alias("l"))
    sums = lines.groupBy("page_id").agg(*(F.sum(behind(F.col("l.packed"), i)).alias(f"b{i}") for i in range(len(LANGUAGES))))
    least = F.least(*(F.col(f"b{i}") for i in range(len(LANGUAGES))))
    lang = F.coalesce(*(F.when(F.col(f"b{i}") == least, F.lit(c)) for i, c in enumerate(LANGUAGES)))
    odds = sum((F.exp(-_STEP * (F.col(f"b{i}") - least)) for i in range(1, len(LANGUAGES))), F.exp(-_STEP * (F.col("b0") - least)))
    pages = sums.select("page_id", lang.alias("lang"), (1 / odds).alias("confidence"))
    junk = quality_of(rows, nlpdocs).where(F.col("junk") & ~F.col("pdf")).select("page_id")
    labels = nlpdocs.groupBy("page_id").agg(F.max("lang").alias("label"))
    return pages.join(junk, "page_id", "left_anti").join(labels, "page_id")


def line_language(packed: Column) -> Column:
    return F.coalesce(*(F.when(behind(packed, i) == 0, F.lit(c)) for i, c in enumerate(LANGUAGES)))


def line_confidence(packed: Column) -> Column:
    """The posterior of a line's best language."""
    odds = sum((F.exp(-_STEP * behind(packed, i)) for i in range(1, len(LANGUAGES))), F.exp(-_STEP * behind(packed, 0)))
    return 1 / odds


def language_found(textdf: DataFrame, nlpdocs: DataFrame, model: ByteGRU | None = None) -> DataFrame:
    """(page_id, pos, line_no, lang, confidence): pages without their right label, at 0, 0, and long lines in
    another language than their page's."""
    rows = page_lines(textdf, nlpdocs, model).where(F.col("has_text") & ~F.col("is_doc"))
    rows = settle(rows.select("page_id", "pos", "kind", "cmd", "level", "is_doc", "boiler", "st", "lines"))
    pages = settle(page_languages(rows, nlpdocs))
    wrong = pages.where(~label_code(F.col("label")).eqNullSafe(F.col("lang")))
    zero = F.lit(0).cast("int")
    lines = rows.where(~F.col("is_doc")).select("page_id", "pos", F.inline("lines")).where(F.col("chars") >= LONG_LINE)
    lines = lines.join(pages.select("page_id", F.col("lang").alias("page_lang")), "page_id")
    far = F.coalesce(*(F.when(F.col("page_lang") == c, behind(F.col("packed"), i)) for i, c in enumerate(LANGUAGES)))
    foreign = lines.where(far >= MARGIN).select("page_id", "pos", "line_no", line_language(F.col("packed")).alias("lang"), line_confidence(F.col("packed")).alias("confidence"))
    return wrong.select("page_id", zero.alias("pos"), zero.alias("line_no"), "lang", "confidence").unionByName(foreign)
