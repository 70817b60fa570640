"""Problem 4: noise in text from scanned pages.

A PDF page whose blocks keep their line breaks is a scan.  Running headers and
page numbers are told from the form and place of a block, split words from the
mark at the line's end.  Misread characters: a noisy channel.  Every word of a
scan, however often it occurs in the rest of the corpus, has as readings what it
could have been before one or two confusions.  A reading's score is the corpus
likelihood (word counts mixed with a character 4-gram model of all words) times
the probability of its confusions, which are estimated from the scans: a first
round with one probability for all confusions counts how often each is found,
against the occurrences of what was printed.  All readings within BEAM of the word
itself stand in the lattice of their block, with transitions from the corpus's
counts of neighbouring words; Viterbi decodes it, and both what is found and what
is repaired is read from the decoded block.  Only pairs of words that stand in some
lattice are counted in the corpus.  In scripts without spaces the windows of
characters around a confusable one, which hold their neighbours already, are
compared alone.

Counts are made over all pages that aren't PDFs.  Null texts have no noise;
repeated rows count once; a scan of one block without a break isn't known as
one; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import chars
from corpusloom.llm.mainbody import is_pdf
from corpusloom.plans.session import settle

# What was read, and what may have been printed.
CONFUSIONS = (
    ("0", "o"), ("@", "a"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("b", "h"), ("h", "b"), ("6", "é"), ("6", "ó"),
    ("6", "b"), ("5", "s"), ("8", "b"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("q", "g"), ("9", "g"),
    ("ä", "à"), ("8", "в"), ("н", "и"), ("и", "н"), ("щ", "ш"), ("ш", "щ"), ("0", "о"), ("3", "з"), ("6", "б"),
)
# The same for scripts without spaces.
WIDE_CONFUSIONS = (
    ("ほ", "は"), ("は", "ほ"), ("ソ", "ン"), ("ン", "ソ"), ("シ", "ツ"), ("ツ", "シ"), ("ー", "一"), ("口", "ロ"), ("ロ", "口"), ("力", "カ"), ("二", "ニ"),
    ("丁", "了"), ("昀", "的"), ("末", "未"), ("未", "末"), ("己", "已"), ("己", "已"), ("入", "人"), ("人", "入"), ("曰", "日"), ("土", "士"),
    ("ไ", "ใ"), ("ใ", "ไ"), ("ธ", "ร"), ("ร", "ธ"), ("ด", "ค"), ("ค", "ด"), ("ผ", "พ"), ("พ", "ผ"), ("บ", "ป"), ("ป", "บ"), ("ภ", "ถ"), ("ถ", "ภ"),
)
CHANNEL = 4.0  # minus the log probability of a confusion before any is seen, which counts as much as PRIOR occurrences
PRIOR = 2_000.0
MARGIN = 0.7
#: How far behind the word as written a reading may lie and stay in the lattice.
BEAM = 8.0
#: Weight of the transitions, and the occurrences by which they are smoothed.
TRANSITION, SMOOTH = 0.75, 20.0
MAX_EDITS = 2
#: Words with more places of confusion than this (no word of a language has so many) are read with one confusion only.
MAX_SITES = 60
#: Lattices are broadcast up to this many words, else joined by shuffle.
BROADCAST_ROWS = 200_000
#: The ids of PDF pages are broadcast up to this many (8 bytes each), so that no text moves to be told from them; else joined by shuffle.
BROADCAST_IDS = 4_000_000
_BINS = 1 << 18

_SPACELESS = "฀-๿぀-ヿ㐀-鿿"
_WORD = re.compile(rf"(?:(?![{_SPACELESS}])[\w@])+")
_BREAK = re.compile(r"(?<=[^\W\d_])[-¬\xad‐]\s*\n\s*(?=[^\W\d_])")
_WIDE = re.compile(rf"(?<=[{_SPACELESS}])\s*\n\s*(?=[{_SPACELESS}])")
PAIRS = tuple(dict.fromkeys(CONFUSIONS + WIDE_CONFUSIONS))
_NUMBER = {pair: i for i, pair in enumerate(PAIRS)}
_TARGETS: dict[str, list[str]] = {}
for _a, _b in WIDE_CONFUSIONS:
    if _b not in _TARGETS.setdefault(_a, []):
        _TARGETS[_a].append(_b)
_CENTRES = set(_TARGETS) | {b for _, b in WIDE_CONFUSIONS}
_CENTRE = re.compile("[" + "".join(sorted(_CENTRES)) + "]")
NUMBER = r"^\s*(?:\[\s*\d+\s*\]|[-–—]\s*\d+\s*[-–—]|\d+\s*/\s*\d+|\d+|[ivxlcdmIVXLCDM]+)\s*$"


def joined(text: str) -> str:
    """The text without its line breaks."""
    return re.sub(r"\s*\n\s*", " ", _WIDE.sub("", _BREAK.sub("", text)))


def units(text: str) -> list[str]:
    """The words of spaced scripts in lower case, and the windows around confusable characters of others
    (marked: two and three characters)."""
    low = unicodedata.normalize("NFC", text.lower())
    out = [w for w in _WORD.findall(low) if not w.isdigit() and w != "@"]
    for m in _CENTRE.finditer(low):
        i = m.start()
        out.append("\x01" + low[max(0, i - 1) : i] + "\x02" + low[i : i + 2])
        out.append("\x01\x02" + low[i : i + 2])
    return out


def candidates(unit: str) -> list[tuple[str, tuple[int, ...]]]:
    """What a unit may have been, with the numbers of the confusions."""
    if unit[:1] == "\x01":
        i = unit.index("\x02") + 1
        return [(unit[:i] + t + unit[i + 1 :], (_NUMBER[unit[i], t],)) for t in _TARGETS.get(unit[i], ())]
    sites = [(m, len(a), b, _NUMBER[a, b]) for a, b in CONFUSIONS for m in _places(unit, a)]
    out: dict[str, tuple[int, ...]] = {}
    for at, n, b, k in sites:
        out.setdefault(unit[:at] + b + unit[at + n :], (k,))
    for i, one in enumerate(sites):
        for two in sites[i + 1 :] if len(sites) <= MAX_SITES else ():
            (p, pn, pb, pk), (q, qn, qb, qk) = sorted([one, two])
            if p + pn <= q:
                out.setdefault(unit[:p] + pb + unit[p + pn : q] + qb + unit[q + qn :], (pk, qk))
    odd = [c for c in unit if c in "@0123456789"]
    if len(odd) > MAX_EDITS:  # many plain digits and signs: all of them at once
        plain = {"0": "o", "@": "a", "1": "l", "5": "s"}
        out.setdefault("".join(plain.get(c, c) for c in unit), tuple(_NUMBER[c, plain.get(c, "o")] if c in plain else _NUMBER["0", "o"] for c in odd))
    out.pop(unit, None)
    return list(out.items())


def _places(unit: str, part: str) -> list[int]:
    out, at = [], unit.find(part)
    while at >= 0:
        out.append(at)
        at = unit.find(part, at + 1)
    return out


class CharModel:
    """Interpolated character 4-grams of the corpus's words, in hashed tables of fixed size."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables  # (5, bins): grams of 0 to 4 characters

    @staticmethod
    def grams(word: str) -> list[list[int]]:
        text = "^^^" + word + "$"
        return [[hash_gram(text[i - k + 1 : i + 1]) for k in range(5)] for i in range(3, len(text))]

    def log_p(self, word: str) -> float:
        total, t = 0.0, self.tables
        text = "^^^" + word + "$"
        for i in range(3, len(text)):
            p = 1e-6
            for k, share in ((1, 0.02), (2, 0.08), (3, 0.3), (4, 0.6)):
                seen = t[k - 1][hash_gram(text[i - k + 1 : i])]
                if seen > 0:
                    p += share * t[k][hash_gram(text[i - k + 1 : i + 1])] / seen
            total += float(np.log(p))
        return total


def hash_gram(gram: str) -> int:
    h = 1469598103934665603
    for c in gram:
        h = ((h ^ ord(c)) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return (h ^ (h >> 29)) % _BINS


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["unit", "n"])
        count.clear()
        return batch

    for batch in batches:
        for text in batch.column("text").to_pylist():
            count.update(units(text))
        if len(count) > 300_000:
            yield out()
    yield out()


def pdf_pages(nlpdocs: DataFrame) -> DataFrame:
    """(page_id) of the PDF pages."""
    pdf = settle(nlpdocs.where(is_pdf(F.col("uri")) & F.col("page_id").isNotNull()).select("page_id").distinct())
    return F.broadcast(pdf) if pdf.count() <= BROADCAST_IDS else pdf


def corpus_texts(textdf: DataFrame, pdf: DataFrame) -> DataFrame:
    """(text) of all pages that aren't PDFs."""
    rows = textdf.where(F.col("text").isNotNull() & (F.col("doceltcmd") != "Uri")).select("page_id", "text")
    return rows.join(pdf, "page_id", "left_anti").select("text")


def unit_counts(textdf: DataFrame, pdf: DataFrame) -> DataFrame:
    """(unit, n): occurrences on all pages that aren't PDFs; each partition adds up its own first."""
    return corpus_texts(textdf, pdf).mapInArrow(_count_units, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _gram_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = np.zeros((5, _BINS), np.float64)
    for batch in batches:
        for unit, n in zip(batch.column("unit").to_pylist(), batch.column("n").to_pylist()):
            if unit[:1] == "\x01" or n < 2:
                continue
            weight, text = np.log2(1 + n), "^^^" + unit + "$"
            for i in range(3, len(text)):
                for k in range(5):
                    tables[k][hash_gram(text[i - k + 1 : i + 1])] += weight
    k, at = np.nonzero(tables)
    yield pa.RecordBatch.from_arrays([pa.array(k * _BINS + at), pa.array(tables[k, at])], ["at", "w"])


def char_model(counts: DataFrame) -> CharModel:
    """What the driver gets is bounded by the size of the hashed tables."""
    flat = np.zeros(5 * _BINS, np.float32)
    sums = counts.mapInArrow(_gram_tables, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).toArrow()
    flat[sums.column("at").to_numpy()] = sums.column("w").to_numpy()
    return CharModel(flat.reshape(5, _BINS))


def scan_rows(textdf: DataFrame, pdf: DataFrame) -> DataFrame:
    """(page_id, pos, text, role) of the text rows of scanned pages, each once: role is header, page_number or text."""
    rows = textdf.join(pdf, "page_id", "left_semi").select("page_id", "pos", "docelttype", "doceltcmd", "text")
    w = Window.partitionBy("page_id").orderBy("pos")
    page = Window.partitionBy("page_id")
    text = F.col("doceltcmd") == "Text"
    doc = F.col("docelttype").eqNullSafe("Document")
    after = F.lag((F.col("doceltcmd") == "Start") & ~doc).over(w)
    rows = rows.withColumn("again", F.lag("pos").over(w).eqNullSafe(F.col("pos"))).where(~F.col("again"))
    rows = rows.withColumn("scan", F.max(text & F.col("text").contains("\n")).over(page)).withColumn("first", F.coalesce(after, F.lit(False)))
    rows = rows.where(F.col("scan") & text & F.col("text").isNotNull() & ~doc)
    t = F.col("text")
    header = F.col("first") & (F.length(t) <= 100) & ~t.contains("\n") & ~t.rlike(r"[.!?…。！？»”\"」:;,]\s*$")
    role = F.when(t.rlike(NUMBER), "page_number").when(header, "header").otherwise("text")
    return rows.select("page_id", "pos", "text", role.alias("role"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def row_units(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(set(units(joined(t)))) if t is not None else [] for t in texts.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("candidate", T.StringType()), T.StructField("confusions", T.ArrayType(T.IntegerType()))])))
def unit_candidates(rows: pa.Array) -> pa.Array:
    return pa.array(
        [[{"candidate": c, "confusions": e} for c, e in candidates(u)] for u in rows.to_pylist()],
        pa.list_(pa.struct([("candidate", pa.string()), ("confusions", pa.list_(pa.int32()))])),
    )


def _score(model: CharModel, total: float):
    """By how much log P of a reading is more than that of the unit: of a word, its count mixed with the character model; of a window, its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}

        def log_p(u: str, n: int) -> float:
            if u[:1] == "\x01":
                return float(np.log((n + 0.01) / total))
            if u not in cache:
                if len(cache) > 500_000:
                    cache.clear()
                cache[u] = float(np.exp(max(model.log_p(u), -600.0)))
            return float(np.log(0.8 * n / total + 0.2 * cache[u] + 1e-300))

        for batch in batches:
            d = batch.to_pydict()
            gain = [log_p(c, m or 0) - log_p(u, n or 0) for u, c, n, m in zip(d["unit"], d["candidate"], d["n"], d["m"])]
            columns = ["unit", "k", "candidate", "confusions"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(gain, pa.float64())], [*columns, "gain"])

    return run


def readings(tokens: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """(unit, k, candidate, confusions, gain): what the units of tokens(unit), of k occurrences, may have been, with the gain
    in log likelihood before the confusions are paid for; those that can't reach the lattice are left out."""
    model = char_model(counts)
    seen = tokens.groupBy("unit").agg(F.count(F.lit(1)).alias("k")).join(counts, "unit", "left")
    pairs = seen.select("unit", "k", "n", F.inline(unit_candidates("unit")))
    pairs = pairs.join(counts.select(F.col("unit").alias("candidate"), F.col("n").alias("m")), "candidate", "left")
    scored = pairs.select("unit", "k", "candidate", "confusions", "n", "m").mapInArrow(_score(model, total), "unit string, k long, candidate string, confusions array<int>, gain double")
    return scored.where(F.col("gain") > -BEAM)


def channel_costs(read: DataFrame, tokens: DataFrame) -> list[float]:
    """Minus the log probability of each of PAIRS: its corrections under one probability for all, against the occurrences
    of what was printed in the scans.  What the driver gets is a row for each pair."""
    best = read.groupBy("unit", "k").agg(F.max_by("confusions", F.struct(F.col("gain") - CHANNEL * F.size("confusions"), "candidate")).alias("c"), F.max(F.col("gain") - CHANNEL * F.size("confusions")).alias("g"))
    found = best.where(F.col("g") > MARGIN).select("k", F.explode("c").alias("pair")).groupBy("pair").agg(F.sum("k").alias("n"))
    found = {r.pair: r.n for r in found.collect()}
    units = tokens.where(~F.col("unit").startswith("\x01")).groupBy("unit").agg(F.count(F.lit(1)).alias("k"))
    printed = sorted({b for _, b in PAIRS})
    often = lambda b: F.sum(F.col("k") * (F.length("unit") - F.length(F.replace("unit", F.lit(b), F.lit("")))) / len(b))
    row = units.agg(*(often(b).alias(f"c{i}") for i, b in enumerate(printed))).first()
    count = {b: row[i] or 0.0 for i, b in enumerate(printed)}
    prior = PRIOR * float(np.exp(-CHANNEL))
    costs = [-np.log((found.get(i, 0) + prior) / (max(count[b], found.get(i, 0)) + PRIOR)) for i, (_, b) in enumerate(PAIRS)]
    return [float(c) if p not in WIDE_CONFUSIONS else CHANNEL for c, p in zip(costs, PAIRS)]  # windows have no single character's count


def lattices(read: DataFrame, costs: list[float]) -> DataFrame:
    """(unit, readings array<struct<gain, candidate>>): what stands beside a unit in a lattice, its confusions paid for."""
    cost = F.aggregate("confusions", F.lit(0.0), lambda a, i: a + F.get(F.array(*map(F.lit, costs)), i))
    kept = read.select("unit", "candidate", (F.col("gain") - cost - MARGIN).alias("gain")).where(F.col("gain") > -BEAM)
    return kept.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("gain", "candidate")), asc=False).alias("readings"))


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order (as units has them, digits included), and the bounds of the texts in words."""
    texts = [None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()]
    cp, bounds = chars.code_points(pa.array(texts, pa.large_string()))
    inside = ((chars.classes()[cp] & (chars.LETTER | chars.DIGIT)) > 0) | (cp == ord("_")) | (cp == ord("@"))
    for a, b in ((0x0E00, 0x0E7F), (0x3040, 0x30FF), (0x3400, 0x9FFF)):
        inside &= (cp < a) | (cp > b)
    starts, ends = chars.runs(inside, bounds)
    return chars.span_hashes(chars.lower_table()[cp], starts, ends), np.searchsorted(starts, bounds)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + right


#: Bits of the sieve that tells which words and pairs are worth counting; what it lets through wrongly is joined away.
SIEVE_BITS = 1 << 23


def _sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(SIEVE_BITS, bool)
    for batch in batches:
        bits[batch.column("key").to_numpy().view(np.uint64) % np.uint64(SIEVE_BITS)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def neighbour_counts(textdf: DataFrame, pdf: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, n) of the needed(key) words and pairs of neighbouring words on all pages that aren't PDFs.

    Tasks are told by a sieve of fixed size what may be needed, and add up their own counts first."""
    parts = needed.coalesce(16).mapInArrow(_sieve, "bits binary").collect()  # at most 16 rows of a megabyte
    bits = np.zeros(SIEVE_BITS // 8, np.uint8)
    for r in parts:
        bits |= np.frombuffer(r.bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.unpackbits(bits).view(bool)
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            unique, at = np.unique(np.concatenate([held[0], keys]), return_inverse=True)
            return unique, np.bincount(at, weights=np.concatenate([held[1], n]), minlength=len(unique)).astype(np.int64)

        for batch in batches:
            words, bounds = word_keys(batch.column("text"))
            last = np.zeros(len(words) + 1, bool)
            last[bounds[1:]] = True  # the next word is another text's
            pairs = pair_keys(words[:-1], words[1:])[~last[1:-1]] if len(words) else words
            keys = np.concatenate([words, pairs])
            keys = keys[inside[keys % np.uint64(SIEVE_BITS)]]
            held = added(keys, np.ones(len(keys), np.int64))
            if len(held[0]) > 1_000_000:
                yield out(held)
                held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield out(held)

    def out(held: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], ["key", "n"])

    counted = corpus_texts(textdf, pdf).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return needed.join(counted, "key")


Lattice = list[list[tuple[str, float]]]


def block_lattice(text: str, alternatives: dict[str, list[tuple[str, float]]]) -> tuple[str, list[tuple[int, int]], Lattice]:
    """The text in one line, the places of its words, and their readings, the word as written first."""
    line = joined(text)
    places, lattice = [], []
    for m in _WORD.finditer(line):
        w = unicodedata.normalize("NFC", m.group().lower())
        places.append((m.start(), m.end()))
        lattice.append([(w, 0.0), *alternatives.get(w, ())])
    return line, places, lattice


def neighbours(lattice: Lattice) -> Iterator[tuple[str, str]]:
    """The pairs of neighbouring readings of which either has alternatives."""
    for left, right in zip(lattice, lattice[1:]):
        if len(left) > 1 or len(right) > 1:
            for w, _ in left:
                for v, _ in right:
                    yield w, v


def _hashes(words: list[str]) -> np.ndarray:
    cp, bounds = chars.code_points(pa.array(words, pa.large_string()))
    return chars.span_hashes(cp, bounds[:-1], bounds[1:])


def _alternatives(column: pa.Array) -> list[dict[str, list[tuple[str, float]]]]:
    return [{x["unit"]: [(r["candidate"], r["gain"]) for r in x["readings"]] for x in row or ()} for row in column.to_pylist()]


def _needed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, pos, key) of the words and pairs each block's transitions take."""
    for batch in batches:
        pages, places, keys = [], [], [np.zeros(0, np.uint64)]
        for page, pos, text, alt in zip(batch.column("page_id").to_pylist(), batch.column("pos").to_pylist(), batch.column("text").to_pylist(), _alternatives(batch.column("lattice"))):
            linked = list(dict.fromkeys(neighbours(block_lattice(text, alt)[2])))
            if linked:
                left, right = _hashes([w for w, _ in linked]), _hashes([v for _, v in linked])
                own = np.unique(np.concatenate([left, right, pair_keys(left, right)]))
                keys.append(own)
                pages += [page] * len(own)
                places += [pos] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(places, pa.int32()), pa.array(np.concatenate(keys).view(np.int64))], ["page_id", "pos", "key"])


def transitions(linked: list[tuple[str, str]], n: dict[int, int], total: float) -> dict[tuple[str, str], float]:
    """By how much more probable each second word is after the first one, as a weighted logarithm, smoothed by its own probability."""
    if not linked:
        return {}
    left, right = _hashes([w for w, _ in linked]), _hashes([v for _, v in linked])
    count = lambda keys: np.array([n.get(int(k), 0) for k in keys.view(np.int64)], float)
    own = (count(right) + 0.5) / total
    given = (count(pair_keys(left, right)) + SMOOTH * own) / (count(left) + SMOOTH)
    return dict(zip(linked, (TRANSITION * np.clip(np.log(given / own), -6, 6)).tolist()))


def decoded(total: float):
    """(page_id, pos, found, text): is a word of the block misread, and its repaired text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            counts = [{x["key"]: x["n"] for x in row or ()} for row in batch.column("counts").to_pylist()]
            for text, alt, n in zip(batch.column("text").to_pylist(), _alternatives(batch.column("lattice")), counts):
                line, places, lattice = block_lattice(text, alt)
                path = viterbi(lattice, transitions(list(dict.fromkeys(neighbours(lattice))), n, total))
                parts, at = [], 0
                for (a, b), w, options in zip(places, path, lattice):
                    if w != options[0][0]:
                        old = line[a:b]
                        w = w.upper() if old.isupper() and len(old) > 1 else w[:1].upper() + w[1:] if old[:1].isupper() else w
                        parts += [line[at:a], w]
                        at = b
                fixed = "".join(parts) + line[at:]
                for u, options in alt.items():
                    if u[:1] == "\x01" and options[0][1] > 0:
                        fixed = fixed.replace(u[1:].replace("\x02", ""), options[0][0][1:].replace("\x02", ""))
                        parts.append(u)
                found.append(bool(parts))
                texts.append(fixed)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("pos"), pa.array(found, pa.bool_()), pa.array(texts, pa.string())], ["page_id", "pos", "found", "text"])

    return run


def decode(body: DataFrame, textdf: DataFrame, pdf: DataFrame) -> DataFrame:
    """(page_id, pos, found, text) of body(page_id, pos, text), the text blocks of scans that have words with other readings."""
    counts = settle(unit_counts(textdf, pdf))
    tokens = settle(body.select("page_id", "pos", F.explode(row_units("text")).alias("unit")))
    total = float(counts.agg(F.sum("n").alias("n")).collect()[0].n or 1)
    read = settle(readings(tokens.select("unit"), counts, total))
    lattice = settle(lattices(read, channel_costs(read, tokens)))
    if lattice.count() <= BROADCAST_ROWS:
        lattice = F.broadcast(lattice)
    beside = tokens.join(lattice, "unit").groupBy("page_id", "pos").agg(F.sort_array(F.collect_list(F.struct("unit", "readings"))).alias("lattice"))
    blocks = settle(body.select("page_id", "pos", "text").join(beside, ["page_id", "pos"]))
    keys = settle(blocks.mapInArrow(_needed_keys, "page_id long, pos int, key long"))
    pairs = settle(neighbour_counts(textdf, pdf, keys.select("key").distinct()))
    own = keys.join(pairs, "key").groupBy("page_id", "pos").agg(F.collect_list(F.struct("key", "n")).alias("counts"))
    return blocks.join(own, ["page_id", "pos"], "left").select("page_id", "pos", "text", "lattice", "counts").mapInArrow(decoded(total), "page_id long, pos int, found boolean, text string")


def scan_noise(textdf: DataFrame, nlpdocs: DataFrame) -> DataFrame:
    """(page_id, pos, noise) of the rows of scanned pages."""
    pdf = pdf_pages(nlpdocs)
    rows = settle(scan_rows(textdf, pdf))
    body = rows.where("role = 'text'")
    misread = decode(body, textdf, pdf).where("found")
    split = body.where(F.col("text").rlike("(?<=[\\p{L}\\p{M}])[-¬\\u00AD‐]\\s*\\n\\s*(?=\\p{L})"))
    parts = (
        rows.where("role <> 'text'").select("page_id", "pos", F.col("role").alias("noise")),
        split.select("page_id", "pos", F.lit("hyphen").alias("noise")),
        misread.select("page_id", "pos", F.lit("chars").alias("noise")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def viterbi(lattice: list[list[tuple[str, float]]], pair: dict[tuple[str, str], float]) -> list[str]:
    """The best path through the readings (word, log score) of a line's words, with scores of neighbours."""
    if not lattice:
        return []
    best = [s for _, s in lattice[0]]
    back: list[list[int]] = []
    for before, now in zip(lattice, lattice[1:]):
        rows = [[b + pair.get((w, v), 0.0) for b, (w, _) in zip(best, before)] for v, _ in now]
        back.append([max(range(len(r)), key=r.__getitem__) for r in rows])
        best = [max(r) + s for r, (_, s) in zip(rows, now)]
    k = max(range(len(best)), key=best.__getitem__)
    path = [lattice[-1][k][0]]
    for row, step in zip(reversed(lattice[:-1]), reversed(back)):
        k = step[k]
        path.append(row[k][0])
    return path[::-1]


@F.arrow_udf(T.StringType())
def joined_text(texts: pa.Array) -> pa.Array:
    return pa.array([joined(t) if t is not None else None for t in texts.to_pylist()], pa.string())


def repaired_blocks(textdf: DataFrame, nlpdocs: DataFrame) -> DataFrame:
    """(page_id, pos, text) of the blocks of scanned pages as continuous readable text, without headers and page numbers."""
    pdf = pdf_pages(nlpdocs)
    rows = settle(scan_rows(textdf, pdf).where("role = 'text'"))
    fixed = decode(rows, textdf, pdf).select("page_id", "pos", F.col("text").alias("fixed"))
    return rows.join(fixed, ["page_id", "pos"], "left").select("page_id", "pos", F.coalesce("fixed", joined_text("text")).alias("text"))
