"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

Everything runs in Spark's own expressions.  Texts are cut by the tokenizer's
pattern; only distinct words are encoded.  A word is an array of byte symbols
(cut where no token of the vocabulary crosses), over which a higher-order fold
applies merge after merge by the rank map, a literal hash table of arrays.

The words with at least one FREQUENT-th of all occurrences, of which there can't be
more than FREQUENT, and their ids are a literal table as well, so that they are
looked up in place; all other words are joined, and none of them is hot.

Defined ids: a null or empty text has the empty list; blank texts have the ids
of their white space.  A doc_id counts once (repeated rows are one document);
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.session import settle

#: A word with one in so many occurrences is encoded in place.
FREQUENT = 262_144
_SEEDS = 16
_NO_ID = -(2**63)
_BUCKETS = 131_072
_NONE = 1 << 20  # the rank of what can't be merged
#: The word pattern of the tokenizer, for Java: letters, digits and space as in Unicode.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = "Ā"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def _symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            chars[chr(256 + extra)] = b
            extra += 1
    return chars


class Ranks:
    """What the file says, as literals: ids of bytes, rank map, safe cuts, pieces of ids."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        of, vocab = _symbols(), model["vocab"]
        piece = {i: bytes(of[c] for c in s) for s, i in vocab.items()}
        self.pieces = piece
        self.byte_ids = [vocab[c] for c, _ in sorted(of.items(), key=lambda x: x[1])]
        buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, both = vocab[a], vocab[b], vocab[a + b]
            buckets[_bucket(a, b)].append((a * 65536 + b) << 20 | both)
        self.pairs = F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>")
        crossed = defaultdict(set)
        for p in piece.values():
            for x, y in zip(p, p[1:]):
                if y >= 0xC2:
                    crossed[y].add(x)
        ways = defaultdict(list)
        for y in range(0xC2, 0xF5):
            ways[frozenset(set(range(256)) - crossed[y])].append(y)
        hexed = lambda bs: "[" + "".join(f"\\x{b:02x}" for b in sorted(bs)) + "]"
        self.cuts = r"(?=[\xc2-\xf4])(?:" + "|".join(f"(?<={hexed(xs)})(?={hexed(ys)})" for xs, ys in ways.items() if xs) + ")"


def _bucket(a: int, b: int) -> int:
    return (a * 40_503 + b * 7) % _BUCKETS


def bound(value: Column, body) -> Column:
    """body(value) with the value computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(pairs: Column, a: Column, b: Column) -> Column:
    """The symbol that two symbols merge into, which is also the merge's rank; _NONE if they don't."""
    key = a.cast("bigint") * 65536 + b
    at = F.pmod(a.cast("bigint") * 40_503 + b * 7, F.lit(_BUCKETS)).cast("int") + 1
    none = F.lit(_NONE).cast("bigint")
    return F.aggregate(F.element_at(pairs, at), none, lambda found, x: F.when(F.shiftright(x, 20) == key, x.bitwiseAND(F.lit(_NONE - 1))).otherwise(found))


def fold_merges(ranks: Ranks, chunk: Column) -> Column:
    """The ids of a chunk (its bytes as characters up to U+00FF)."""
    return bound(ranks.pairs, lambda pairs: _fold(pairs, ranks.byte_ids, chunk))


def _fold(pairs: Column, byte_ids: list[int], chunk: Column) -> Column:
    digits = F.hex(F.encode(chunk, "ISO-8859-1"))
    n = F.length(chunk)
    ids = F.from_json(F.lit(json.dumps(byte_ids)), "array<bigint>")
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    symbols = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(ids, byte(i) + 1))
    none = F.array().cast("array<bigint>")

    def ranked(s: Column) -> Column:
        pair = lambda i: merged(pairs, F.element_at(s, i), F.element_at(s, i + 1))
        r = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), pair)).otherwise(none)
        return F.struct(s.alias("s"), r.alias("r"))

    def step(state: Column) -> Column:
        s, r, least = state["s"], state["r"], F.array_min(state["r"])
        i = F.array_position(r, least).cast("int")  # the leftmost pair of the least rank; its symbols are i and i + 1
        size = F.size(s)
        left, right = F.slice(s, F.lit(1), i - 1), F.slice(s, i + 2, F.greatest(size - i - 1, F.lit(0)))
        before = F.when(i > 1, F.array(merged(pairs, F.element_at(s, i - 1), least))).otherwise(none)
        after = F.when(i + 1 < size, F.array(merged(pairs, least, F.element_at(s, i + 2)))).otherwise(none)
        next_s = F.concat(left, F.array(least), right)
        next_r = F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), before, after, F.slice(r, i + 2, F.greatest(size - i - 2, F.lit(0))))
        return F.when(F.coalesce(least < _NONE, F.lit(False)), F.struct(next_s.alias("s"), next_r.alias("r"))).otherwise(state)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), bound(symbols, ranked), lambda x, _: step(x), lambda x: x["s"])
    return folded.cast("array<int>")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def encode_words(words: DataFrame, ranks: Ranks) -> DataFrame:
    """(word, n, ids) of words(word, n): distinct words."""
    latin = F.decode(F.encode("word", "UTF-8"), "ISO-8859-1")
    parts = F.when(F.octet_length("word") == F.length("word"), F.array(latin)).otherwise(
        F.split(F.regexp_replace(latin, F.lit(ranks.cuts), F.lit(_CUT)), _CUT)
    )
    rows = settle(words).select("word", "n", F.posexplode(parts).alias("at", "chunk"))
    chunks = rows.select("chunk").distinct()
    known = chunks.select("chunk", fold_merges(ranks, F.col("chunk")).alias("ids"))
    joined = rows.join(known, "chunk").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))
    return joined.select("word", "n", F.flatten("p.ids").alias("ids"))


def slot_of(word: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(word, F.lit(seed)), F.lit(_BUCKETS)).cast("int")


def frequent_table(words: DataFrame) -> tuple[Column, int]:
    """The frequent words and their ids, each in the slot of its hash, and the hash's seed.

    Of two words for one slot the more frequent has it; the seed is the one that leaves the least
    occurrences without a slot.  The driver gets at most FREQUENT words."""
    total = words.agg(F.sum("n").alias("n")).collect()[0].n or 0
    often = words.where(F.col("n") * FREQUENT >= total).select("word", "n", "ids", F.array(*(slot_of(F.col("word"), s) for s in range(_SEEDS))).alias("slots"))
    rows = sorted(often.collect(), key=lambda r: (-r.n, r.word))
    lost = []
    for seed in range(_SEEDS):
        taken: set[int] = set()
        lost.append(sum(r.n for r in rows if r.slots[seed] in taken or taken.add(r.slots[seed])))
    seed = lost.index(min(lost))
    keys: list[str | None] = [None] * _BUCKETS
    ids: list[list[int] | None] = [None] * _BUCKETS
    for r in rows:
        slot = r.slots[seed]
        if keys[slot] is None:
            keys[slot], ids[slot] = r.word, list(r.ids)
    return F.from_json(F.lit(json.dumps({"k": keys, "i": ids})), "struct<k:array<string>,i:array<array<int>>>"), seed


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every document, without special tokens."""
    ranks = Ranks(path or default_path())
    docs = documents.select("doc_id", "text")
    if docs.count() > docs.select("doc_id").distinct().count():
        docs = docs.dropDuplicates(["doc_id"])
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(_NO_ID)))  # a null doc_id is a document as well
    split = words_of(F.col("text"))  # after the shuffle by document: a text is smaller than its words
    counts = documents.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = settle(encode_words(counts, ranks))
    table, seed = frequent_table(words)

    def ids_of(t: Column, w: Column) -> Column:  # null if the word isn't in the table
        slot = slot_of(w, seed) + 1
        return F.when(F.element_at(t["k"], slot) == w, F.element_at(t["i"], slot))

    missing = bound(table, lambda t: F.transform(split, lambda w, i: F.when(ids_of(t, w).isNull(), F.struct(i.alias("at"), w.alias("word")))))
    rare = docs.select("key", F.inline(F.array_compact(missing)))
    rare = rare.join(words.select("word", "ids"), "word").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("m"))
    rare = rare.select("key", F.col("m.at").alias("more_at"), F.col("m.ids").alias("more_ids"))
    found = docs.join(rare, "key", "left")
    joined = lambda i: F.element_at("more_ids", F.array_position("more_at", i).cast("int"))
    ids = bound(table, lambda t: F.transform(split, lambda w, i: F.coalesce(ids_of(t, w), joined(i))))
    return found.select("doc_id", F.flatten(ids).alias("ids"))


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): binary pieces put together."""
    pieces = Ranks(path or default_path()).pieces
    hexed = F.from_json(F.lit(json.dumps([pieces.get(i, b"").hex() for i in range(max(pieces) + 1)])), "array<string>")
    text = F.concat_ws("", F.transform("ids", lambda i: F.element_at(hexed, i + 1)))
    return encoded.select("doc_id", F.decode(F.unhex(text), "UTF-8").alias("text"))
