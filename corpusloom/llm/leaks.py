"""Problem 9: evaluation texts leaking into training text.

Latent semantic retrieval.  Documents are cut into passages: of words known from
the evaluation items (a word the items don't have can't be part of a verbatim
leak), and for paraphrases of all words.  A randomised singular value
decomposition of the TF-IDF matrix of all passages is distributed: one pass adds
up A'(A Omega) over the partitions, which the driver orthonormalises to Q, a
second one the small matrix (AQ)'(AQ), whose eigenvectors give the singular
directions.  The passages of the items lie in an index of the latent space:
clusters with their radius, so that a cluster is skipped only if no passage in
it can reach the cosine.  What reaches it is a candidate, and only candidates
are checked: for RUN equal words in a row (verbatim), or for a longest common
subsequence with the passage, or with the part of the document that is as long as
the item and aligned with it, and for the item's numbers as answers (paraphrase).

The corpus is read once; all further passes read the settled word numbers.  The
items are a fixed table: they are read by the driver in blocks of BLOCK_ITEMS, so
that what is sent to the executors is bounded whatever their number.  Words are
runs of letters and digits, without case and accents.  Null and empty texts, and
texts and items with fewer words than a run, have no leaks; copies are documents
of their own; an item that shares a passage with another is reported as well;
rows without doc_id or item_id and extra columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import chars
from corpusloom.plans.session import settle

RUN = 12
#: (words of a passage, words between the begins of passages) of verbatim search and of paraphrases.
VERBATIM, WHOLE = (16, 5), (24, 12)
RANK, OVERSAMPLE = 64, 16
#: Cosines from which a passage and an item's passage are compared.
COSINE, PARAPHRASE_COSINE = 0.6, 0.75
PARAPHRASE_SHARE, PARAPHRASE_KNOWN = 0.7, 0.8
ITEM_STEP = 3
BLOCK_ITEMS = 20_000
#: Passages, and pairs, that are worked on at once.
CHUNK, PAIRS = 4_096, 1_024


@functools.lru_cache(maxsize=1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Code points without case and accents; which of them are letters, marks, digits."""
    fold = chars.lower_table().copy()
    for i in range(0xC0, 0x10000):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c)).lower() if not 0xD800 <= i < 0xE000 else ""
        if len(base) == 1 and not 0xAC00 <= i < 0xD7B0:
            fold[i] = ord(base)
    return fold, chars.classes()


def fold_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each word's text, and the bounds of the texts in words."""
    cp, bounds = chars.code_points(texts)
    fold, kinds = _fold()
    keep = (kinds[cp] & chars.MARK) == 0
    at = chars.running(keep)[bounds]
    text = fold[cp[keep]]
    alnum = (kinds[text] & (chars.LETTER | chars.DIGIT)) > 0
    starts, ends = chars.runs(alnum, at)
    return chars.span_hashes(text, starts, ends), np.searchsorted(at, starts, side="right") - 1, np.searchsorted(starts, at)


class Items:
    """A block of evaluation items: words, runs, passages and what the answers need."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = [r for r in rows if r[1]]
        self.ids = np.array([r[0] for r in rows], np.int64)
        words, _, bounds = fold_words(pa.array([r[1] for r in rows], pa.large_string()))
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        self.items = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        number: set[int] = set()
        for r, item in zip(rows, self.items):
            folded = unicodedata.normalize("NFKD", r[1]).lower()
            spans = "".join(c if c.isalnum() else " " for c in folded if not unicodedata.combining(c)).split()
            number.update(int(i) for i, s in zip(item, spans) if s.isdigit())
        self.numbers = np.array(sorted(number), np.int64)
        runs, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        self.windows: dict[bool, tuple[list[np.ndarray], np.ndarray, np.ndarray]] = {}
        for k, item in enumerate(self.items):
            if len(item) >= RUN:
                runs.append(run_hashes(item))
                owner.append(np.full(len(item) - RUN + 1, k))
        runs, owner = np.concatenate(runs), np.concatenate(owner)
        order = np.argsort(runs, kind="stable")
        self.runs, self.owner = runs[order], owner[order]
        for whole in (False, True):  # item passages as long as a run, or as a document's passage
            parts, of, at = [], [], []
            for k, item in enumerate(self.items):
                width = min(len(item), WHOLE[0]) if whole else RUN
                if len(item) >= RUN:
                    begin = sorted({*range(0, len(item) - width + 1, ITEM_STEP), len(item) - width})
                    parts += [item[b : b + width] for b in begin]
                    of += [k] * len(begin)
                    at += begin
            self.windows[whole] = parts, np.array(of, np.int64), np.array(at, np.int64)
        self.size = np.array([len(x) for x in self.items], np.int64)
        longest = int(self.size.max(initial=1))
        self.table = np.full((len(self.items), longest), -2, np.int32)  # the items' words, padded
        for k, item in enumerate(self.items):
            self.table[k, : len(item)] = item
        answers = [np.intersect1d(item, self.numbers) for item in self.items]
        self.answers = np.full((len(self.items), max([1, *map(len, answers)])), -2, np.int32)
        for k, x in enumerate(answers):
            self.answers[k, : len(x)] = x


def run_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of every RUN consecutive word ids."""
    n = max(len(ids) - RUN + 1, 0)
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = np.zeros(n, np.uint64)
        for i in range(RUN):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[i : i + n]
    return h


def known_words(items: Items, texts: pa.Array, whole: bool) -> pa.Array:
    """The item words of every text as ids, -1 for a gap; texts without RUN of them in a row
    are null.  If ``whole``, every other word is a gap of its own and no text is null."""
    words, row, bounds = fold_words(texts)
    ids = np.searchsorted(items.vocabulary, words)
    ids[ids == len(items.vocabulary)] = 0
    known = items.vocabulary[ids] == words if len(words) and len(items.vocabulary) else np.zeros(len(words), bool)
    ids = np.where(known, ids, -1).astype(np.int32)
    n = len(bounds) - 1
    keep = np.ones(len(words), bool)
    if not whole:
        s, e = chars.runs(known, bounds)
        long = e - s >= RUN
        keep = np.zeros(len(words) + 1, np.int64)
        np.add.at(keep, s[long], 1)
        np.add.at(keep, e[long], -1)
        keep = np.cumsum(keep)[:-1] > 0
        first = np.zeros(len(words), bool)
        first[s[long]] = True
        # a gap before each run; two runs that touch (in other texts) stay apart by the offsets
        at = np.flatnonzero(keep)
        ids = np.insert(ids[at], np.flatnonzero(first[at]), -1)
        size = np.bincount(row[keep], minlength=n) + np.bincount(row[first], minlength=n)
    else:
        size = np.bincount(row, minlength=n)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=pa.array(size == 0))


def passages(values: np.ndarray, offsets: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of the passages of documents' ids, which lie one after another; begins and ends are places in ``values``."""
    values, base = values[offsets[0] : offsets[-1]], int(offsets[0])
    bounds = offsets.astype(np.int64) - base
    width, step = WHOLE if whole else VERBATIM
    if whole:
        s, e = bounds[:-1], bounds[1:]
    else:
        s, e = chars.runs(values >= 0, bounds)
    n = np.where(e - s >= RUN, (e - s - RUN) // step + 1, 0)
    row = np.repeat(np.arange(len(s)), n)
    begin = s[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
    end = np.minimum(begin + width, e[row])
    if whole:
        known = chars.running(values >= 0)
        keep = known[end] - known[begin] >= PARAPHRASE_KNOWN * (end - begin)
        begin, end = begin[keep], end[keep]
    return np.searchsorted(bounds, begin, side="right") - 1, begin + base, end + base


class Passages:
    """The passages of a batch: their documents' numbers, their begins there, and their words one after another."""

    def __init__(self, batch: pa.RecordBatch, whole: bool):
        lists = batch.column("ids")
        self.offsets, self.values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        self.doc, begin, end = passages(self.values, self.offsets, whole)
        self.begin = begin - self.offsets[self.doc]
        self.flat, self.bounds = spread(self.values, begin, end)

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first passage, words, bounds) of CHUNK passages at a time."""
        for a in range(0, len(self.doc), CHUNK):
            bounds = self.bounds[a : a + CHUNK + 1]
            yield a, self.flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def spread(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of values one after another, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    return values[np.repeat(begin - bounds[:-1], end - begin) + np.arange(bounds[-1])], bounds


def _document_frequency(n: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(n + 1, np.int64), 0
        for batch in batches:
            for _, flat, bounds in Passages(batch, whole).chunks():
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                seen = np.unique(owner[flat >= 0] * (n + 1) + flat[flat >= 0])
                count += np.bincount(seen % (n + 1), minlength=n + 1)
                total += len(bounds) - 1
        count[n] = total
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["id", "n"])

    return run


def _units(flat: np.ndarray, bounds: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The words' weights in their passages' unit TF-IDF vectors."""
    w = np.where(flat >= 0, idf[flat], 0.0)
    norm = np.sqrt(np.maximum(np.add.reduceat(w * w, bounds[:-1]), 1e-12))
    return w / np.repeat(norm, np.diff(bounds))


def _weights(flat: np.ndarray, bounds: np.ndarray, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """(passages, columns): the passages' unit TF-IDF vectors times a matrix over the words."""
    w = _units(flat, bounds, idf).astype(matrix.dtype)
    return np.add.reduceat(matrix[flat] * w[:, None], bounds[:-1], axis=0)


def _sketch(idf: np.ndarray, omega: np.ndarray, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(omega)
        for batch in batches:
            for _, flat, bounds in Passages(batch, whole).chunks():
                w = _units(flat, bounds, idf)
                t = np.add.reduceat(omega[flat] * w[:, None], bounds[:-1], axis=0)
                order = np.argsort(flat, kind="stable")  # the rows of a word are added up together
                of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[order]
                words, first = np.unique(flat[order], return_index=True)
                total[words] += np.add.reduceat(t[of] * w[order][:, None], first, axis=0)
        at = np.flatnonzero(np.abs(total).sum(axis=1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, i]) for i in range(total.shape[1]))], ["id", *(f"y{i}" for i in range(total.shape[1]))])

    return run


def _gram(idf: np.ndarray, q: np.ndarray, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((q.shape[1], q.shape[1]))
        for batch in batches:
            for _, flat, bounds in Passages(batch, whole).chunks():
                x = _weights(flat, bounds, idf, q)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "g"])

    return run


def latent_basis(runs: DataFrame, words: int, whole: bool = False, rank: int = RANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idf, basis, singular values): weights of the item words, and the leading right singular vectors
    of the passages' TF-IDF matrix.  What the driver gets is bounded by the words of the items."""
    frequency = runs.select("ids").mapInArrow(_document_frequency(words, whole), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    df = np.zeros(words + 1)
    for r in frequency.collect():
        df[r.id] = r.n
    idf = np.log((df[words] + 1) / (df[:words] + 1)) + 1
    rank = max(1, min(rank, words))
    omega = np.random.default_rng(17).standard_normal((max(words, 1), min(rank + OVERSAMPLE, max(words, 1))))
    columns = [f"y{i}" for i in range(omega.shape[1])]
    sums = runs.select("ids").mapInArrow(_sketch(idf, omega, whole), "id long, " + ", ".join(f"{c} double" for c in columns))
    y = np.zeros_like(omega)
    for r in sums.groupBy("id").agg(*(F.sum(c).alias(c) for c in columns)).collect():
        y[r.id] = [r[c] for c in columns]
    q, _ = np.linalg.qr(y + 1e-9 * omega)
    gram = np.zeros(q.shape[1] ** 2)
    for r in runs.select("ids").mapInArrow(_gram(idf, q.astype(np.float32), whole), "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).collect():
        gram[r["at"]] = r.g
    values, vectors = np.linalg.eigh(gram.reshape(q.shape[1], -1))
    lead = np.argsort(-values)[:rank]
    return idf, (q @ vectors[:, lead]).astype(np.float32), np.sqrt(np.maximum(values[lead], 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class LatentIndex:
    """Item passages in the latent space, in clusters with their radius.  A cluster is left out for a
    query only if the angle to its centre less its radius is greater than that of the cosine."""

    def __init__(self, vectors: np.ndarray, rounds: int = 4):
        n = len(vectors)
        k = max(1, int(np.sqrt(n) / 2))
        centres = vectors[np.linspace(0, max(n - 1, 0), k).astype(np.int64)] if n else np.zeros((0, vectors.shape[1]), np.float32)
        label = np.zeros(n, np.int64)
        for _ in range(rounds if n else 0):
            label = np.argmax(vectors @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, label, vectors)
            centres = _unit(sums).astype(np.float32)
        self.centres = centres
        self.members = [np.flatnonzero(label == c) for c in range(len(centres))]
        self.vectors = [vectors[m] for m in self.members]
        self.radius = [float(np.arccos(np.clip((v @ c).min(), -1, 1))) if len(v) else 0.0 for v, c in zip(self.vectors, centres)]

    def search(self, queries: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item passage, cosine) of all pairs from that cosine."""
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        to_centre = queries @ self.centres.T
        for c, (members, vectors, radius) in enumerate(zip(self.members, self.vectors, self.radius)):
            reach = np.arccos(cosine) + radius + 1e-3
            near = np.flatnonzero(to_centre[:, c] >= np.cos(reach)) if reach < np.pi else np.arange(len(queries))
            if len(near) and len(members):
                score = queries[near] @ vectors.T
                i, j = np.nonzero(score >= cosine)
                out.append((near[i], members[j], score[i, j]))
        return tuple(np.concatenate(x) for x in zip(*out))


def common_subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of two tables of words, padded with different negative numbers."""
    row = np.zeros((len(a), b.shape[1] + 1), np.int16)
    for i in range(a.shape[1]):
        take = np.where(b == a[:, i : i + 1], row[:, :-1] + 1, 0)
        row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], take), axis=1)
    return row[:, -1].astype(np.int64)


def _table(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of values as rows, padded."""
    size = end - begin
    out = np.full((len(size), int(size.max(initial=1))), -3, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = spread(values, begin, end)[0]
    out[out == -1] = -4  # an unknown word is no padding
    return out, size


def paraphrase_shares(values: np.ndarray, part_at: tuple[np.ndarray, np.ndarray], near_at: tuple[np.ndarray, np.ndarray], items: Items, which: np.ndarray) -> np.ndarray:
    """For each pair, the share of the passage or of the item that is a common subsequence, the greater one; 0 if a number of the item is missing around."""
    share = np.zeros(len(which))
    for a in range(0, len(which), PAIRS):
        w = which[a : a + PAIRS]
        item, item_size, answers = items.table[w], items.size[w], items.answers[w]
        near, near_size = _table(values, *(x[a : a + PAIRS] for x in near_at))
        part, part_size = _table(values, *(x[a : a + PAIRS] for x in part_at))
        ok = ((answers == -2) | (answers[:, :, None] == near[:, None, :]).any(axis=2)).all(axis=1)
        for text, size in ((part, part_size), (near, near_size)):
            short = np.minimum(size, item_size)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            same = text[at][:, :, None] == item[at][:, None, :]
            # the subsequence can't be longer than the words of either that the other has
            most = np.minimum(same.any(axis=2).sum(axis=1), same.any(axis=1).sum(axis=1))
            at = at[most >= PARAPHRASE_SHARE * short[at]]
            if len(at):
                share[a + at] = np.maximum(share[a + at], common_subsequences(text[at], item[at]) / short[at])
    return share


def _search(items: Items, idf: np.ndarray, basis: np.ndarray, whole: bool):
    def lookup(long: bool) -> tuple[LatentIndex, np.ndarray, np.ndarray]:
        windows, owner, begin = items.windows[long]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in windows])]).astype(np.int64)
        vectors = _unit(_weights(np.concatenate(windows), bounds, idf, basis)).astype(np.float32) if windows else np.zeros((0, basis.shape[1]), np.float32)
        return LatentIndex(vectors), owner, begin

    short, long, n = lookup(False), lookup(True) if whole else None, len(items.ids)

    def candidates(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, begin of the item's best passage); only whole passages are held against those of their length."""
        x, size = _unit(_weights(flat, bounds, idf, basis)), np.diff(bounds)
        found = []
        for (index, owner, begin), rows in ((short, size < WHOLE[0]), (long, size >= WHOLE[0])) if whole else ((short, size >= 0),):
            rows = np.flatnonzero(rows)
            query, window, cosine = index.search(x[rows], PARAPHRASE_COSINE if whole else COSINE)
            query, item = rows[query], owner[window]
            order = np.lexsort((window, -cosine, item, query))  # of each passage and item the best
            pair = query[order] * n + item[order]
            best = order[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else order
            found.append((query[best], item[best], begin[window[best]]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def verbatim(flat: np.ndarray, bounds: np.ndarray, passage: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which of the candidate pairs have RUN words in a row in common."""
        looked = np.unique(passage)
        if not len(looked):
            return np.zeros(0, bool)
        flat, bounds = spread(flat, bounds[looked], bounds[looked + 1])
        of, h = np.repeat(looked, np.diff(bounds)), run_hashes(flat)
        of = np.where(of[: len(h)] == of[RUN - 1 :], of[: len(h)], -1)  # runs within a passage
        h, of = h[of >= 0], of[of >= 0]
        lo, hi = np.searchsorted(items.runs, h, "left"), np.searchsorted(items.runs, h, "right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.isin(passage * n + item, np.repeat(of, size) * n + items.owner[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = Passages(batch, whole)
            keys, shares = [np.zeros(0, np.int64)], [np.zeros(0)]
            for a, flat, bounds in p.chunks():
                query, item, item_begin = candidates(flat, bounds)
                doc = p.doc[a + query]
                if whole:
                    begin = p.offsets[doc] + p.begin[a + query]
                    start = begin - item_begin
                    lo = np.maximum(start - RUN // 2, p.offsets[doc])
                    hi = np.minimum(p.offsets[doc + 1], start + items.size[item] + RUN + RUN // 2)
                    share = paraphrase_shares(p.values, (begin, begin + np.diff(bounds)[query]), (lo, np.maximum(lo, hi)), items, item)
                    found = share >= PARAPHRASE_SHARE
                else:
                    found = verbatim(flat, bounds, query, item)
                    share = found.astype(float)
                keys.append((doc * n + item)[found])
                shares.append(share[found])
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            best = np.zeros(len(key))
            np.maximum.at(best, at, np.concatenate(shares))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[key // n].astype(np.int64)), pa.array(items.ids[key % n]), pa.array(np.full(len(key), not whole)), pa.array(np.round(best, 4))],
                ["doc_id", "item_id", "verbatim", "share"],
            ) if len(key) else pa.RecordBatch.from_pylist([], pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("verbatim", pa.bool_()), ("share", pa.float64())]))

    return run


def leaks(documents: DataFrame, eval_items: DataFrame, paraphrases: bool = False) -> DataFrame:
    """(doc_id, item_id, verbatim, share) of the documents that contain passages of items: RUN words
    in a row, or also (if ``paraphrases``) most of a passage's or item's words in order, the item's numbers included."""
    rows = [(r.item_id, r.text) for r in eval_items.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL").orderBy("item_id").collect()]
    found = None
    tasks = 3 * documents.sparkSession.sparkContext.defaultParallelism  # the ids are small, the work on them isn't
    for a in range(0, max(len(rows), 1), BLOCK_ITEMS):
        items = Items(rows[a : a + BLOCK_ITEMS])
        known = F.arrow_udf(lambda t, i=items: chars.in_chunks(t, lambda p: known_words(i, p, paraphrases)), T.ArrayType(T.IntegerType()))
        ids = documents.where("doc_id IS NOT NULL").select("doc_id", known("text").alias("ids")).where("ids IS NOT NULL")
        ids = settle(ids.repartition(max(tasks, documents.rdd.getNumPartitions()), F.xxhash64("doc_id", "ids")))
        idf, basis, _ = latent_basis(ids, len(items.vocabulary), paraphrases)
        for whole in (False, True)[: 1 + paraphrases]:
            part = ids.mapInArrow(_search(items, idf, basis, whole), "doc_id long, item_id long, verbatim boolean, share double")
            found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("verbatim").alias("verbatim"), F.max("share").alias("share"))


def verbatim_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the documents that contain RUN consecutive words of the item."""
    return leaks(documents, eval_items).where("verbatim").select("doc_id", "item_id")
