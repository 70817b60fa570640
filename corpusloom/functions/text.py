"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words, numbers and single other characters; SQL engines agree on it.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SHORT_TEXT = 50
TITLE_LIMIT = 47


def tokens(text: Column) -> Column:
    """Base tokens of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def words_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def characters(text: Column) -> Column:
    """The characters (code points) of a text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def is_number(token: Column) -> Column:
    """Would a decimal parser take the token, with a comma for the point?"""
    return F.replace(token, F.lit(","), F.lit(".")).try_cast("double").isNotNull()


def csv_safe(text: Column) -> Column:
    """A string that can stand in a field of a semicolon-separated line."""
    return F.translate(text, ";\n", ", ")


def truncated_title(text: Column) -> Column:
    return F.when(F.length(text) > TITLE_LIMIT, F.concat(F.substring(text, 1, TITLE_LIMIT), F.lit("..."))).otherwise(text)


def is_short(text: Column) -> Column:
    return F.length(text) < SHORT_TEXT


def context_window(text: Column, needle: str, width: int = 20) -> Column:
    """The surroundings of the first occurrence of a literal: width characters before its first
    character and width after it; null where it is absent."""
    at = F.locate(needle, text)
    start = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + width - start + 1))


def escaped_block(text: Column) -> Column:
    """A text as one line of the structured format."""
    one = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.when(one.startswith("##"), F.concat(F.lit(". "), one)).otherwise(one)


def unescaped_block(line: Column) -> Column:
    return F.replace(line, F.lit("\\n"), F.lit("\n"))


def space_words(text: Column) -> Column:
    """Split at runs of space, no-break space, tab and line ends; no empty words."""
    return F.filter(F.split(text, "[ \\x{A0}\\t\\r\\n]+"), lambda w: w != "")


def capitalised(text: Column) -> Column:
    """First letter of every word in upper case, the rest kept."""
    parts = F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.array_join(parts, " ")


def luminance(char: Column) -> Column:
    return F.ascii(char) % 256


def unwrapped_json_string(text: Column) -> Column:
    return F.regexp_replace(text, '^"+|"+$', "")


def retry_after_seconds(value: Column, now: Column) -> Column:
    """A delay header: a number of seconds, or a date from which they are counted."""
    date = F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(value.try_cast("double"), F.unix_timestamp(date).cast("double") - F.unix_timestamp(now).cast("double"))


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy HH:mm:ss")


def parsed_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("MM/dd/yyyy HH:mm:ss"))


def sentences(text: Column) -> Column:
    """The plain sentencizer: a terminator ends a sentence where space follows."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?…])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


# Universal tags and the fragments of a lexicon's tag that mean them; the first that is contained decides.
TAG_RULES = (
    ("ADJ", ("adj", "loc.adj")),
    ("ADP", ("prep",)),
    ("ADV", ("adv", "loc.adv")),
    ("AUX", ("v0a", "v0e", "ppas")),
    ("CCONJ", ("cjco",)),
    ("DET", ("det",)),
    ("INTJ", ("interj",)),
    ("NOUN", ("nom",)),
    ("NUM", ("nb", "ord")),
    ("PRON", ("pro",)),
    ("PROPN", ("prn", "patr", "npr")),
    ("SCONJ", ("cjsub",)),
    ("SYM", ("symb",)),
    ("VERB", ("v1", "v2", "v3", "loc.verb")),
)


def universal_tag(tag: Column) -> Column:
    """A lexicon's tag as a universal one: the first rule whose fragment it contains, else itself."""
    return F.coalesce(*(F.when(tag.contains(part), F.lit(name)) for name, parts in TAG_RULES for part in parts), tag)


def tag_union(a: Column, b: Column) -> Column:
    """The distinct tags of two lists joined by |, sorted; null only if both are."""
    split = lambda c: F.coalesce(F.split(c, r"\|"), F.array().cast("array<string>"))
    return F.when(a.isNotNull() | b.isNotNull(), F.array_join(F.array_sort(F.array_union(split(a), split(b))), "|"))
