"""Operators over documents: brute force, exact round trips, edge cases."""

import re
import unicodedata

import pytest
from tokenizers import Tokenizer

from corpusloom.llm import leaks, repetition, sentences, token_ids

DOCS = "doc_id long, text string, ids string, word string, n long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", 1) for i, t in enumerate(texts)], DOCS)


ODD = [
    None, "", "   ", "\n\n\t x", "Hello  world's don't I'LL", "naïve café é   x", "日本語のテキスト、中文。ไทย", "😀👍🏽 a😀", "<|endoftext|> </s>", "a" * 3000, "12345 3.14 ½ ²",
    "​﻿\x00\x1f", "Привет мир", "x\r\ny", "ǅ ß İ", "a b c　d", "!!!???...…", "one", "one",
]


def test_token_ids_equal_the_library(spark):
    t = Tokenizer.from_file(token_ids.default_path())
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch([x or "" for x in ODD], add_special_tokens=False)]
    df = docs(spark, ODD)
    encoded = token_ids.token_ids(df.union(df.limit(3)))
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert [got[i] for i in range(len(ODD))] == want and encoded.count() == len(ODD)
    assert {r.doc_id: r.text for r in token_ids.decode_ids(encoded).collect()} == {i: x or "" for i, x in enumerate(ODD)}


def test_rows_without_id(spark):
    df = spark.createDataFrame([(None, "Hello again, unusual wordage"), (1, "Hello")], "doc_id long, text string")
    t = Tokenizer.from_file(token_ids.default_path())
    want = t.encode("Hello again, unusual wordage", add_special_tokens=False).ids
    assert {r.doc_id: r.ids for r in token_ids.token_ids(df).collect()}[None] == want
    item = " ".join(f"word{i}" for i in range(14))
    e = spark.createDataFrame([(1, item), (None, item)], "item_id long, text string")
    d = spark.createDataFrame([(None, item), (2, item)], "doc_id long, text string")
    assert [tuple(r) for r in leaks.verbatim_leaks(d, e).collect()] == [(2, 1)]


def test_token_ids_of_nothing(spark):
    assert token_ids.token_ids(docs(spark, [])).count() == 0


def norm(text):
    return " ".join(re.findall(r"[^\W_]+", "".join(c if c.isalpha() or c.isnumeric() else " " for c in (text or "").lower())))


def brute_share(text):
    s, seen = norm(text), set()
    cover = bytearray(len(s))
    for i in range(len(s) - 29):
        if s[i : i + 30] in seen:
            cover[i : i + 30] = b"\x01" * 30
        seen.add(s[i : i + 30])
    return sum(cover) / len(s) if s else 0.0


def test_repetition_brute_force(spark):
    line = "The same sentence comes back here again and again. "
    texts = [*ODD, line, line * 2, line * 50, "x" + line * 3 + "quite another text of some length, with words of its own.", "ab" * 40, line * 20_000]
    got = {r.doc_id: r.share for r in repetition.repetition(docs(spark, texts)).collect()}
    assert {i: round(v, 9) for i, v in got.items()} == {i: round(brute_share(t), 9) for i, t in enumerate(texts)}
    found = {r.doc_id for r in repetition.repetitive(docs(spark, texts)).collect()}
    assert found == {i for i, t in enumerate(texts) if brute_share(t) >= 0.3}
    assert repetition.repetitive(docs(spark, [])).count() == 0


def fold(text):
    return re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower())


def test_leaks_brute_force(spark):
    items = [f"Passage {w} tells how the old river crosses twelve green villages near the sea before {w} reaches café number 7." for w in ("alpha", "beta", "gamma")]
    items += [items[0] + " With more words after the shared passage, of its own kind.", None, "", "too short"]
    texts = [
        None, "", "nothing here", f"Before. {items[0]} After.", items[1].upper().replace("É", "É"), " ".join(items[2].split()[:12]), " ".join(items[2].split()[:11]),
        " ".join(items[2].split()[3:15]) + " tail", f"{items[0]} {items[2]}", items[0].replace(" ", " - "), "word " * 5000 + items[1],
    ]
    runs = lambda w: {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
    grams = {i: runs(fold(t)) for i, t in enumerate(items)}
    want = {(d, i) for d, g in enumerate(runs(fold(t)) for t in texts) for i, other in grams.items() if g & other}
    e = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    assert {tuple(r) for r in leaks.verbatim_leaks(docs(spark, texts), e).collect()} == want
    assert leaks.verbatim_leaks(docs(spark, []), e).count() == 0
    assert leaks.verbatim_leaks(docs(spark, texts), e.limit(0)).count() == 0


def test_paraphrase(spark):
    item = "The annual report of the northern harbour lists 42 ships that carried grain and timber across the strait in winter."
    copy = "The annual report of the northern harbour names 42 ships that carried timber across the strait in winter."
    other = copy.replace("42", "17")
    e = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.verbatim for r in leaks.leaks(docs(spark, [item, copy, other, "unrelated words only"]), e, paraphrases=True).collect()}
    assert got == {0: True, 1: False}


def test_paraphrases_keep_all_verbatim_leaks(spark):
    item = " ".join(f"word{i}" for i in range(40))
    texts = [" ".join([*(f"x{i}" for i in range(k)), *item.split()[9:21], *(f"y{i}" for i in range(50))]) for k in range(30)]
    e = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.verbatim for r in leaks.leaks(docs(spark, texts), e, paraphrases=True).collect()}
    assert got == dict.fromkeys(range(30), True)


def test_paraphrase_with_numbers_far_apart(spark):
    words = [f"word{i}" for i in range(60)]
    item = " ".join(["17", *words, "42"])
    copy = " ".join(["17", *("or" if i % 8 == 3 else w for i, w in enumerate(words)), "42"])
    around = " ".join(f"x{i}" for i in range(25))
    e = spark.createDataFrame([(1, item), (2, "or " * 14)], "item_id long, text string")
    texts = [f"{around} {copy} {around}", f"{around} {copy.replace('42', '43')} {around}"]
    assert [tuple(r)[:3] for r in leaks.leaks(docs(spark, texts), e, paraphrases=True).collect()] == [(0, 1, False)]


CASES = [
    ("Mr. Smith paid 3.5 pounds. He left.", ["Mr. Smith paid 3.5 pounds.", "He left."]),
    ("They sell tea, etc. The end!", ["They sell tea, etc.", "The end!"]),
    ("La société Risan S.A. compare le plan, cf. art. 4 du règlement. M. Duval rit.", ["La société Risan S.A. compare le plan, cf. art. 4 du règlement.", "M. Duval rit."]),
    ("« Vraiment ? Oui ! » demande Luc. Il part.", ["« Vraiment ? Oui ! » demande Luc.", "Il part."]),
    ("Le toit fuit… puis plus rien. Fin.", ["Le toit fuit… puis plus rien.", "Fin."]),
    ("Am 11. Juni kommt er. Dort gibt es Brot usw. Das ist gut.", ["Am 11. Juni kommt er.", "Dort gibt es Brot usw.", "Das ist gut."]),
    ("—Es bueno. ¿De verdad? —preguntó Ana. El Sr. Paz llega.", ["—Es bueno. ¿De verdad? —preguntó Ana.", "El Sr. Paz llega."]),
    ("«Дом стоит!» — сказал П. Иванов. В городе на ул. Мира тихо.", ["«Дом стоит!» — сказал П. Иванов.", "В городе на ул. Мира тихо."]),
    ("“好的。真的吗？”他问道。天气5.48米。", ["“好的。真的吗？”他问道。", "天气5.48米。"]),
    ("「はい。」と言った。家を見た。", ["「はい。」と言った。", "家を見た。"]),
    ("บ้านมีราคา 17 บาท คุณพูดว่า “ดี มาก” ตลาดเปิดมา 3 ปีแล้ว สวนปิด", ["บ้านมีราคา 17 บาท", "คุณพูดว่า “ดี มาก”", "ตลาดเปิดมา 3 ปีแล้ว", "สวนปิด"]),
    ("The site is on abc.example now.The next begins.", ["The site is on abc.example now.", "The next begins."]),
    ("line one\nLine two", ["line one", "Line two"]),
    ("a split sen-\ntence goes\non here. Then it ends.", ["a split sen-\ntence goes\non here.", "Then it ends."]),
    ("mr. x left the town. he came back.", ["mr. x left the town.", "he came back."]),
    (None, []), ("", []), (" \n ", []), ("...", ["..."]), ("x" * 100_000, ["x" * 100_000]),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_sentences(text, expected):
    spans = sentences.sentences(text)
    assert [text[a:b] for a, b in spans] == expected


@pytest.mark.parametrize("text", [c[0] for c in CASES if c[0]])
def test_sentences_leave_out_only_space(text):
    at = 0
    for a, b in sentences.sentences(text):
        assert text[at:a].strip() == "" and a < b
        at = b
    assert text[at:].strip() == ""


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, 2, "One. Two."), (1, 3, None)], "page_id long, pos int, text string")
    assert [tuple(r) for r in sentences.block_sentences(df).collect()] == [(1, 2, 0, 4), (1, 2, 5, 9)]


def test_gaps_of_scripts_without_spaces():
    cut = lambda text, *words: [text[a:b] for a, b in sentences.sentences(text, frozenset(words))]
    assert cut("家を見ました 本が好きです") == ["家を見ました", "本が好きです"]
    assert cut("本はまた 家にある") == ["本はまた", "家にある"] and cut("本はまた 家にある", "また") == ["本はまた 家にある"]
    assert cut("他走了 天气很好") == ["他走了", "天气很好"] and cut("他走了 和我") == ["他走了 和我"] and cut("北京 天气很好") == ["北京 天气很好"]
    assert cut("「見ました 本」と言った") == ["「見ました 本」と言った"]
    long = "家を見ました " * 3000
    assert len(cut(long)) == 3000
    thai = "ก" * 60 + "มา สวนปิด"  # the word before the gap is more than forty characters from the part's begin
    assert cut(thai, "มา") == [thai] and cut("สวน" * 30 + " สวน", "สวน") == ["สวน" * 30, "สวน"]


def test_opening_words(spark):
    df = spark.createDataFrame([("The cat.",)] * 3 + [("« Le chat. »",), ("12",), (None,), ("日本",)], "text string")
    assert sentences.opening_words(df) == {"the", "le", "日本"}
    assert sentences.opening_words(df.limit(0)) == frozenset()
    text = "They met mr. x inc. the end came"
    assert len(sentences.sentences(text.lower(), openers=frozenset(["the"]))) == 2 and len(sentences.sentences(text.lower())) == 1


def test_lattice_takes_the_longest_words():
    words = frozenset(["ตลาด", "โรงเรียน", "โรง"])
    text = "โรงเรียนตลาด"
    assert [text[a:b] for a, b in sentences.lattice_words(text, words)] == ["โรงเรียน", "ตลาด"]
