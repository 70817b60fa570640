"""Problem 7: sentence boundaries across languages and scripts.

Spaced scripts: every terminator with what surrounds it is a candidate; its
reading (abbreviation, initial, ordinal, decimal, host name, ellipsis, quoted
speech, end) is decided by the token before and the opening word after it, one
candidate at a time.  Which words open sentences is learnt: those that blocks begin
with.  Scripts without spaces: the words around a gap are cut by the cheapest path
through a lattice of dictionary words, and the gap is classified by the last word
before it (final particles) and, in Chinese and Japanese, the first one after it;
there wide stops outside quotations and line ends are boundaries as well.  Direct
speech belongs to the sentence reporting it.

A null or blank text has no sentences; positions are characters from 0, end
exclusive, without surrounding space.  Very long blocks are read once, in
linear time.  Repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.plans.session import settle

# Abbreviations that never end a sentence, by language.
TITLES = frozenset(
    "mr mrs ms dr prof st no nos sec fig vol approx vs e.g i.e cf "  # en
    "m mm mme mlle env p ex p.ex art av bd chap "  # fr
    "hr fr nr vgl z b z.b bzw ca ggf str abs "  # de
    "sr sra srta d dña n.º núm aprox p.ej ej ud véase pág "  # es
    "sig sig.ra sigg dott dott.ssa ing avv per es v "  # it
    "г ул им т е т.е т.к см др проф гр стр".split()  # ru
)
# Abbreviations that end a sentence if a new one opens after them.
CLOSERS = frozenset("etc inc ltd co corp cie usw ecc cía s.a s.l s.p.a s.r.l e.v gmbh ag руб коп a.m p.m т.д т.п c".split())
# Of these, those that always end one in texts without capitals.
LISTS = frozenset("etc usw ecc т.д т.п".split())
# Months after a German ordinal.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
_STOPS = ".!?…"
_QUOTES = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", '"': '"', "‘": "’"}
_CLOSING = set("»”“」』\"’)]")
_WORD = re.compile(r"[^\W_]+(?:[.’'º-][^\W_]+)*º?|\S")
_THAI = re.compile(r"[฀-๿]")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_LETTERED = re.compile(r"[^\W\d_]{1,2}(?:\.[^\W\d_]{1,2})+")
_DASH_SPEECH = re.compile(r"(?:(?<=^)|(?<=[.!?…\n]\s)|(?<=\n))—(?=[^\s\d])[^\n—]*?(?=\s—\s?[^\W\d_])")
_LETTER = re.compile(r"[^\W\d_]")

Spans = list[tuple[int, int]]


def _trim(text: str, cuts: list[int]) -> Spans:
    out, at = [], 0
    for cut in [*cuts, len(text)]:
        a, b = at, cut
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        at = max(at, cut)
    return out


def _quoted(text: str) -> bytearray:
    """1 at the characters inside quotation marks; an unclosed mark quotes nothing."""
    inside = bytearray(len(text))
    stack: list[tuple[str, int]] = []
    for i, c in enumerate(text):
        if stack and c == stack[-1][0]:
            _, start = stack.pop()
            if not stack:
                inside[start:i] = b"\x01" * (i - start)
        elif c in _QUOTES and len(stack) < 3:
            stack.append((_QUOTES[c], i))
        elif c == "\n":
            stack.clear()
    if "—" in text:  # speech that opens with a dash, up to the dash of its report
        for m in _DASH_SPEECH.finditer(text):
            inside[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    return inside


def _token_before(text: str, i: int) -> tuple[str, int]:
    """The word that ends before position i, with inner dots, and its start."""
    a = i
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] in ".-º" and a - 1 > 0 and text[a - 2].isalnum()):
        a -= 1
    return text[a:i], a


def _word_after(text: str, i: int) -> str:
    m = _LETTER.search(text, i)
    if not m:
        return ""
    j = m.start()
    k = j
    while k < len(text) and (text[k].isalpha() or text[k] == "-"):
        k += 1
    return text[j:k]


def spaced_cuts(text: str, openers: frozenset[str] = frozenset()) -> list[int]:
    """Where sentences end in a text of a spaced script."""
    quoted = _quoted(text)
    flat = not any(c.isupper() for c in text) or not any(c.islower() for c in text)
    flowing = _flows(text)
    cuts, n, i = [], len(text), 0
    while i < n:
        c = text[i]
        if c == "\n":
            if not flowing and not quoted[i]:
                cuts.append(i)
            i += 1
            continue
        if c not in _STOPS:
            i += 1
            continue
        j = i
        while j < n and text[j] in _STOPS:
            j += 1
        k = j
        while k < n and (text[k] in _CLOSING or (text[k] in "  \xa0" and k + 1 < n and text[k + 1] in "»")):
            if text[k] == '"' and not quoted[k - 1 if k else 0]:
                break  # a straight mark that opens
            k += 1
        if quoted[i] and (k == j or (k < n and quoted[k])):
            i = j
            continue  # within direct speech
        gap = k < n and text[k].isspace()
        m = k
        while m < n and text[m].isspace():
            m += 1
        if m >= n:
            break
        if _ends(text, i, j, k, m, gap, flat, bool(quoted[i]), openers):
            cuts.append(k)
        i = max(k, j)
    return cuts


def _ends(text: str, i: int, j: int, k: int, m: int, gap: bool, flat: bool, speech: bool, openers: frozenset[str]) -> bool:
    """Does the terminator text[i:j], with closing marks up to k, before text[m], end a sentence?"""
    nxt = text[m]
    opens = nxt.isupper() or nxt.isdigit() or nxt in "«“„\"¡¿(「[" or not nxt.isalnum() and nxt not in "-—–,;:)»”"
    if speech:  # the report comes after it, unless a new sentence does
        return gap and opens and not flat
    if nxt in "—–" and gap:  # the report of speech between dashes, or new speech
        return text[m + 1 : m + 3].strip()[:1].isupper()
    if k > j and nxt.islower():  # the report of speech whose opening mark is lost
        return False
    if nxt in ",;:)»”":
        return False
    mark = text[i:j]
    if len(mark) >= 2 and mark[0] in ".…" or mark == "…":
        return gap and opens and not flat
    if mark[0] in "!?":
        return gap or (nxt.isupper() and not flat)
    token, start = _token_before(text, i)
    low = token.lower().lstrip(".")
    last = low.rsplit(".", 1)[-1]
    word = _word_after(text, m)
    opener = word.lower() in openers
    if not gap:
        if nxt.isdigit() or not nxt.isupper() or flat:
            return False
        return len(last) > 1 and "." not in low and low not in TITLES
    if not token:
        return opens or flat
    if low in CLOSERS or last in LISTS or (_LETTERED.fullmatch(low) and low not in TITLES):
        if low in LISTS:
            return flat or opens
        if low == "c":  # a company's "& C." or an initial
            company = text[max(0, start - 3) : start].strip().lower() in ("e", "y", "et", "&")
            return company and opener and (flat or opens)
        if flat:
            return opener and low not in ("a.m", "p.m")
        return opens and (opener or low not in ("s.a", "s.l", "s.p.a", "e.v") or nxt.isupper())
    if low in TITLES or last in TITLES and "." in low:
        return False
    if low in ("д", "п") and re.search(r"(?:^|\s)т\.\s*$", text[max(0, start - 5) : start].lower()):
        return flat or opens  # "and so on"
    if len(last) == 1 and last.isalpha():
        return False  # an initial
    if last.isdigit():
        if word.lower() in MONTHS:
            return False
        return (opens and nxt.isupper()) if not flat else opener
    return True  # an edited or careless sentence may open with a small letter


def _flows(text: str) -> bool:
    """Are the lines wrapped, so that their ends say nothing?"""
    parts = [p.strip() for p in text.split("\n") if p.strip()]
    if len(parts) < 2 or not any(c.isupper() for c in text):
        return False
    return any(a[-1] not in ".!?…。！？»”」\"" and b[0].islower() for a, b in zip(parts, parts[1:]))


@functools.lru_cache(maxsize=8)
def _longest(words: frozenset[str]) -> int:
    return max(map(len, words), default=1)


def lattice_words(text: str, words: frozenset[str]) -> list[tuple[int, int]]:
    """The cheapest cut into dictionary words; unknown characters cost more than any word."""
    n, longest = len(text), _longest(words)
    cost = [0.0] + [float("inf")] * n
    back = [0] * (n + 1)
    for i in range(n):
        base = cost[i]
        if base + 3 < cost[i + 1]:
            cost[i + 1], back[i + 1] = base + 3, i
        for j in range(i + 1, min(n, i + longest) + 1):
            if base + 1 < cost[j] and text[i:j] in words:
                cost[j], back[j] = base + 1, i
    out, j = [], n
    while j > 0:
        out.append((back[j], j))
        j = back[j]
    return out[::-1]


_DIGIT_SIDE = re.compile(r"[\d,.]*\d$")
# Words before a Thai quotation, number words' units, and connectives a sentence can't open or close with.
THAI_SPEECH = ("ว่า", "พูด", "ถาม", "ตอบ", "บอก")
THAI_FINALS = ("แล้ว", "อีกครั้ง", "ครับ", "ค่ะ", "คะ", "นะ", "ไหม", "หรือ", "จริงหรือ")
THAI_JOINTS = ("และ", "แต่", "เพราะ", "กับ", "หรือ", "ในขณะที่", "มา", "ราคา", "ของ", "ที่", "ใน")


def thai_cuts(text: str, words: frozenset[str]) -> list[int]:
    """Ends of Thai sentences: gaps outside quotations and numbers whose words don't bind over them."""
    quoted = _quoted(text)
    cuts, n = [], len(text)
    for i, c in enumerate(text):
        if c == "\n":
            cuts.append(i)
            continue
        if not c.isspace() or quoted[i] or i == 0 or text[i - 1].isspace():
            continue
        m = i
        while m < n and text[m].isspace():
            m += 1
        if m >= n or text[m].isdigit() or text[m] in "“\"(" or text[m] in ",.;:%":
            continue
        if _DIGIT_SIDE.search(text, max(0, i - 8), i):
            continue
        left = text[text.rfind(" ", 0, i) + 1 : i]
        if left.endswith(THAI_SPEECH):
            continue
        if left.endswith(THAI_FINALS) or left[-1] in "”\"!?":
            cuts.append(i)
            continue
        tail = lattice_words(left, words)
        last = left[tail[-1][0] : tail[-1][1]] if tail else ""
        if last in THAI_JOINTS:
            continue
        cuts.append(i)
    return cuts


# What Chinese and Japanese sentences end with, and what links the parts of one.
WIDE_FINALS = frozenset("了 吗 呢 吧 啊 呀 です ます でした ました ません でしょう ください だ だった た ね よ".split())
WIDE_JOINTS = frozenset("和 与 或 但 而 在 的 是 把 を に が は の で と も から まで より".split())


@functools.lru_cache(maxsize=8)
def _with_particles(words: frozenset[str]) -> frozenset[str]:
    return words | WIDE_FINALS | WIDE_JOINTS


_PART = re.compile(r"[^\s。！？、，]+")


def gap_ends(text: str, start: int, i: int, words: frozenset[str]) -> bool:
    """Does the gap at i, after a part from ``start``, end a Chinese or Japanese sentence?  Only if the last dictionary word in it is a final
    particle or form and the first one after it can open a sentence."""
    left, after = text[start:i], _PART.search(text, i)
    right = after[0] if after and text[i : after.start()].isspace() else ""
    if not left or not _CJK.match(right):
        return False
    words = _with_particles(words)
    a, b = lattice_words(left, words)[-1]
    c, d = lattice_words(right, words)[0]
    return b - a < len(left) and left[a:b] in WIDE_FINALS and right[c:d] not in WIDE_JOINTS and right[c:d] not in WIDE_FINALS


def wide_cuts(text: str, words: frozenset[str] = frozenset()) -> list[int]:
    """Ends of Chinese and Japanese sentences: wide stops outside quotations, line ends after finished lines, and gaps
    between a final particle and an opening word, as a lattice of dictionary words cuts what is around them."""
    quoted = _quoted(text)
    cuts, n, i, part = [], len(text), 0, 0
    while i < n:
        c = text[i]
        if c == "\n" and not quoted[i]:
            cuts.append(i)
        elif c in " \u3000" and not quoted[i] and i and not text[i - 1].isspace() and gap_ends(text, part, i, words):
            cuts.append(i)
        elif c in "。！？!?．" or c == "…" and i + 1 < n and text[i + 1].isspace():
            j = i
            while j < n and text[j] in "。！？!?．…":
                j += 1
            k = j
            while k < n and text[k] in "」』”’）)":
                k += 1
            if quoted[i] and (k == j or (k < n and text[k] not in " \n　")):
                i = k  # speech, or its report follows
                continue
            if k < n:
                cuts.append(k)
            i = part = k
            continue
        if c.isspace() or c in "、，":
            part = i + 1
        i += 1
    return cuts


def sentences(text: str | None, words: frozenset[str] = frozenset(), openers: frozenset[str] = frozenset()) -> Spans:
    """The sentences of a block as (start, end)."""
    if not text or not text.strip():
        return []
    letters = sum(map(str.isalpha, text)) or 1
    thai, cjk = len(_THAI.findall(text)), len(_CJK.findall(text))
    if thai * 2 > letters:
        cuts = thai_cuts(text, words)
    elif cjk * 2 > letters:
        cuts = wide_cuts(text, words)
    else:
        cuts = spaced_cuts(text, openers)
    return _trim(text, cuts)


_SPANS = T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))


def _spans_udf(words: frozenset[str], openers: frozenset[str]):
    def cut(texts: pa.Array) -> pa.Array:
        rows = [[{"start_char": a, "end_char": b} for a, b in sentences(t, words, openers)] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32())])))

    return F.arrow_udf(cut, _SPANS)


#: A word opens sentences if one block in so many begins with it; so there are at most as many opening words.
OPENER_SHARE = 1_000


def lattice_dictionary(vocabulary: DataFrame) -> frozenset[str]:
    """The words of scripts without spaces of the vocabulary, a table of fixed size."""
    rows = vocabulary.where(F.col("word").rlike(r"[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]")).select("word").distinct()
    return frozenset(r.word for r in rows.collect())


def opening_words(blocks: DataFrame) -> frozenset[str]:
    """The words in lower case that one in OPENER_SHARE of the blocks(text) of spaced scripts begins with."""
    first = F.lower(F.regexp_extract("text", r"^[\s\p{P}]*(\p{L}[\p{L}\p{M}-]*)", 1))
    counts = blocks.select(first.alias("w")).where(F.col("w") != "").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts)
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    return frozenset(r.w for r in counts.where(F.col("n") * OPENER_SHARE >= total).select("w").collect())


def block_sentences(blocks: DataFrame, words: frozenset[str] = frozenset(), openers: frozenset[str] = frozenset()) -> DataFrame:
    """(page_id, pos, start_char, end_char) of the sentences of blocks(page_id, pos, text)."""
    return blocks.select("page_id", "pos", F.inline(_spans_udf(words, openers)("text")))


def text_blocks(textdf: DataFrame) -> DataFrame:
    """The TextBlocks of the stream, each once."""
    rows = textdf.where(F.col("docelttype").eqNullSafe("TextBlock") & F.col("text").isNotNull())
    return rows.select("page_id", "pos", "text").dropDuplicates(["page_id", "pos"])
