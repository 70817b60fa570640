"""Problem 10: repetition inside a single document.

Weak supervision.  Five rules measure a document's repetition each in its own
way and vote for it, against it, or abstain.  Spark counts the patterns of
votes over all documents (at most 3^5); expectation-maximisation on the pattern
counts estimates the rules' accuracies and gives each pattern a posterior
probability, which decides: a document is taken from POSTERIOR upwards.  The rule
that measures the share of characters is what repetition is defined by: where it
votes, its vote is the label, from which the accuracies of the four others are
learnt; where it abstains they decide.  Learning without labels was tried and
drifts to what the four rules, which depend on each other, have in common.  An
exact check of the share follows, as the rule abstains between its two bounds.

The text is read in lower case with every run of other characters than letters
and digits as one space.  Null, empty and short texts (under 31 characters) have
share 0; copies of a document are documents of their own; very long texts are
worked on alone; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import chars
from corpusloom.plans.session import settle

WINDOW = 30
MIN_SHARE = 0.3
POSTERIOR = 0.5
SMOOTHING = 1.0
#: (votes for from, votes against up to) of each rule's measure.
RULES = {
    "share": (0.3, 0.2),
    "line_share": (0.2, 0.05),
    "sentence_share": (0.2, 0.05),
    "run_share": (0.25, 0.1),
    "word_share": (0.62, 0.45),
}
LABEL = "share"
_FIELDS = tuple(RULES)


def normal_form(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, one space for each run of other characters, trimmed."""
    alnum = (chars.classes()[cp] & (chars.LETTER | chars.DIGIT)) > 0
    before = np.concatenate([[False], alnum[:-1]]) if len(cp) else alnum
    first = np.zeros(len(cp) + 1, bool)
    first[bounds] = True
    keep = alnum | (before & ~first[:-1])
    out = np.where(alnum, chars.lower_table()[cp], 32)[keep]
    at = chars.running(keep)[bounds]
    ends = at[1:]
    trailing = (ends > at[:-1]) & (out[np.maximum(ends - 1, 0)] == 32) if len(out) else np.zeros(len(ends), bool)
    drop = np.zeros(len(out), bool)
    drop[ends[trailing] - 1] = True
    return out[~drop], at - np.concatenate([[0], np.cumsum(trailing)])


def repeated_chars(text: np.ndarray) -> int:
    """Characters in stretches of WINDOW equal to one that starts earlier."""
    n = len(text) - WINDOW + 1
    if n < 2:
        return 0
    starts = np.arange(n)
    h = chars.span_hashes(text, starts, starts + WINDOW)
    order = np.argsort(h, kind="stable")
    s = h[order]
    again = np.zeros(n, bool)
    again[order[1:]] = s[1:] == s[:-1]
    if not again.any():
        return 0
    cover = np.zeros(len(text) + 1, np.int64)
    at = np.flatnonzero(again)
    cover[at] += 1
    np.subtract.at(cover, at + WINDOW, 1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _again_share(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """By row, the weight of the items equal to an earlier item of the row, as a share of all."""
    with np.errstate(over="ignore"):
        key = hashes ^ (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    total = np.bincount(rows, weights=weights, minlength=n)
    again = np.bincount(rows, weights=np.where(first, 0, weights), minlength=n)
    return np.where(total > 0, again / np.maximum(total, 1), 0.0)


def batch_measures(texts: pa.Array) -> pa.Array:
    cp, bounds = chars.code_points(texts)
    n = len(bounds) - 1
    text, at = normal_form(cp, bounds)
    size = np.diff(at)
    share = np.zeros(n)
    for i in np.flatnonzero(size > WINDOW):
        share[i] = repeated_chars(text[at[i] : at[i + 1]]) / size[i]
    w0, w1 = chars.runs(text != 32, at)
    words = chars.span_hashes(text, w0, w1)
    row = np.searchsorted(at, w0, side="right") - 1
    word_share = _again_share(row, words, np.ones(len(words)), n)
    k = 5
    m = max(len(words) - k + 1, 0)
    with np.errstate(over="ignore"):
        run = words[:m].copy()
        for i in range(1, k):
            run = (run ^ (run >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + words[i : i + m]
    whole = row[:m] == row[k - 1 : k - 1 + m]
    run_share = _again_share(row[:m][whole], run[whole], np.ones(int(whole.sum())), n)
    shares = []
    for breaks in ((10,), tuple(map(ord, "\n.!?…。！？"))):
        cut = np.isin(cp, breaks)
        s, e = chars.runs(~cut, bounds)
        keep = e - s >= 8
        s, e = s[keep], e[keep]
        shares.append(_again_share(np.searchsorted(bounds, s, side="right") - 1, chars.span_hashes(cp, s, e), (e - s).astype(float), n))
    values = {"share": share, "line_share": shares[0], "sentence_share": shares[1], "run_share": run_share, "word_share": word_share}
    return pa.StructArray.from_arrays([pa.array(values[f]) for f in _FIELDS], list(_FIELDS))


@F.arrow_udf(T.StructType([T.StructField(f, T.DoubleType()) for f in _FIELDS]))
def measures(texts: pa.Array) -> pa.Array:
    return chars.in_chunks(texts, batch_measures)


def votes(documents: DataFrame) -> DataFrame:
    """(doc_id, measures, pattern): a vote is 1, 0, or 2 for an abstention; a pattern is its votes as digits."""
    df = documents.select("doc_id", measures("text").alias("m")).select("doc_id", "m.*")
    vote = lambda f: F.when(F.col(f) >= RULES[f][0], 1).when(F.col(f) <= RULES[f][1], 0).otherwise(2)
    return df.withColumn("pattern", F.concat(*(vote(f).cast("string") for f in _FIELDS)))


def posteriors(patterns: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """The probability of repetition of every pattern of votes, by expectation-maximisation."""
    keys = sorted(patterns)
    if not keys:
        return {}
    count = np.array([patterns[k] for k in keys], float)
    v = np.array([[int(c) for c in k] for k in keys])
    label, rules = v[:, _FIELDS.index(LABEL)], np.delete(v, _FIELDS.index(LABEL), axis=1)
    yes, no, known = rules == 1, rules == 0, label != 2
    p = np.where(known, label, (yes.sum(1) + 0.5) / ((yes | no).sum(1) + 1)).astype(float)
    for _ in range(rounds):
        w1, w0 = (p * count)[:, None], ((1 - p) * count)[:, None]
        prior = np.log((w1.sum() + SMOOTHING) / (w0.sum() + SMOOTHING))
        hit = ((w1 * yes).sum(0) + SMOOTHING) / ((w1 * (yes | no)).sum(0) + 2 * SMOOTHING)
        false = ((w0 * yes).sum(0) + SMOOTHING) / ((w0 * (yes | no)).sum(0) + 2 * SMOOTHING)
        odds = prior + (yes * np.log(hit / false) + no * np.log((1 - hit) / (1 - false))).sum(1)
        new = np.where(known, label, 1 / (1 + np.exp(-odds)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return dict(zip(keys, p.tolist()))


def repetition(documents: DataFrame) -> DataFrame:
    """(doc_id, share, line_share, sentence_share, run_share, word_share, posterior) of every document."""
    voted = settle(votes(documents))
    table = posteriors({r.pattern: r.n for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()})
    if not table:
        return voted.withColumn("posterior", F.lit(None).cast("double")).drop("pattern")
    of = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return voted.withColumn("posterior", of[F.col("pattern")]).drop("pattern")


def repetitive(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents that are probably repetitive and of which MIN_SHARE or more repeats their own earlier text."""
    found = repetition(documents).where((F.col("posterior") >= POSTERIOR) & (F.col("share") >= MIN_SHARE))
    return found.select("doc_id").distinct()
