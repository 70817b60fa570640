"""The registered queries of the operators for training data, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import language, leaks, mainbody, near_duplicates, quality, repeated_lines, repetition, scan_noise, sentences, token_ids
from corpusloom.plans.session import settle, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.junk_pages(quality.page_quality(table(spark, d, "textdf"), table(spark, d, "nlpdocs")))


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.page_quality(table(spark, d, "textdf"), table(spark, d, "nlpdocs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.boilerplate_found(table(spark, d, "textdf"), table(spark, d, "nlpdocs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "textdf"), table(spark, d, "nlpdocs"))


def p3_slots(spark: SparkSession, d: str) -> DataFrame:
    """Templates with a wildcard, such as bylines."""
    return repeated_lines.slot_templates(table(spark, d, "textdf"), table(spark, d, "nlpdocs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.scan_noise(table(spark, d, "textdf"), table(spark, d, "nlpdocs"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repaired_blocks(table(spark, d, "textdf"), table(spark, d, "nlpdocs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return language.language_found(table(spark, d, "textdf"), table(spark, d, "nlpdocs")).drop("confidence")


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "nlpdocs")
    return language.page_languages(settle(language.page_lines(table(spark, d, "textdf"), docs)), docs)


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p5_found with their confidence."""
    return language.language_found(table(spark, d, "textdf"), table(spark, d, "nlpdocs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(near_duplicates.page_words(table(spark, d, "textdf"), table(spark, d, "nlpdocs")))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(near_duplicates.page_words(table(spark, d, "textdf"), table(spark, d, "nlpdocs")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of the annotated blocks; the operator itself takes any block."""
    wanted = table(spark, d, "annotated_blocks").select("page_id", "pos").distinct()
    blocks = table(spark, d, "textdf").select("page_id", "pos", "text").where("text IS NOT NULL").join(wanted, ["page_id", "pos"], "left_semi")
    words, openers = sentences.lattice_dictionary(table(spark, d, "vocabulary")), sentences.opening_words(_text_blocks(spark, d))
    return sentences.block_sentences(blocks.dropDuplicates(["page_id", "pos"]), words, openers)


def _text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "textdf").where("docelttype = 'TextBlock' AND text IS NOT NULL").select("text")


def p7_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every TextBlock."""
    words, openers = sentences.lattice_dictionary(table(spark, d, "vocabulary")), sentences.opening_words(_text_blocks(spark, d))
    return sentences.block_sentences(sentences.text_blocks(table(spark, d, "textdf")), words, openers)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids.token_ids(table(spark, d, "documents"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text) decoded again from the ids."""
    return token_ids.decode_ids(token_ids.token_ids(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.verbatim_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Verbatim leaks and paraphrases."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), paraphrases=True)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_statistics, p2_found, p3_found, p3_slots, p4_found, p4_repaired, p5_found, p5_languages, p5_lines, p6_found, p6_groups, p7_found, p7_sentences, p8_ids, p8_roundtrip, p9_found, p9_leaks, p10_found, p10_shares)}
_FOLDED = r"regexp_extract_all(strip_accents(lower(regexp_replace(text, '\p{M}', '', 'g'))), '[\p{L}\p{N}]+')"
_GRAMS = "SELECT {0}, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM (SELECT {0}, " + _FOLDED + " AS w FROM {1} WHERE text IS NOT NULL), unnest(range(1, len(w) - 10)) u(i)"
ORACLES = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.replace('{0}', 'doc_id').replace('{1}', 'documents')}) JOIN ({_GRAMS.replace('{0}', 'item_id').replace('{1}', 'eval_items')}) USING (g)",
    "p10_found": r"""
        WITH t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, substr(t, i, 30) ORDER BY i) AS n FROM t, unnest(range(1, length(t) - 28)) u(i)),
        c AS (SELECT doc_id, count(DISTINCT k) AS n FROM w, unnest(range(i, i + 30)) v(k) WHERE n > 1 GROUP BY doc_id)
        SELECT doc_id FROM c JOIN t USING (doc_id) WHERE n >= 0.3 * length(t)""",
    "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p3_found": r"""
        WITH l AS (
            SELECT DISTINCT page_id, pos, siteindex, i::INT AS line_no,
                   regexp_replace(lower(string_split(text, chr(10))[i]), '[^\p{L}\p{M}]+', '', 'g') AS k
            FROM (SELECT DISTINCT page_id, pos, siteindex, text FROM textdf
                  WHERE docelttype IS DISTINCT FROM 'Document' AND text IS NOT NULL) AS t,
                 unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
        n AS (SELECT siteindex, count(DISTINCT page_id) AS pages FROM nlpdocs GROUP BY siteindex),
        f AS (SELECT siteindex, k FROM l JOIN n USING (siteindex) WHERE k <> ''
              GROUP BY siteindex, k, pages HAVING count(DISTINCT page_id) >= 4 AND count(DISTINCT page_id) * 8 >= pages)
        SELECT page_id, pos, line_no FROM l JOIN f USING (siteindex, k)""",
}
