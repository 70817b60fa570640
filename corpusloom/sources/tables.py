"""Scans and sinks of the crawl's side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# The columns of a request log, as its header has them.
LOG_COLUMNS = (
    "Clock", "Url", "Status code", "Reponse time (ms)", "Download time (ms)", "Content size (bytes)", "Unique text blocks (%)",
    "Crawl depth", "Parent Url", "Redirected from", "Retry count", "Retry after (s)", "Error message",
)
_LOG_FIELDS = (
    "clock", "url", "status_code", "response_time_ms", "download_time_ms", "content_size_bytes", "unique_text_blocks_pct",
    "crawl_depth", "parent_url", "redirected_from", "retry_count", "retry_after_s", "error_message",
)
_LOG_TYPES = ("timestamp", "string", "string", "int", "int", "bigint", "double", "int", "string", "string", "int", "double", "string")


def write_request_log(log: DataFrame, folder: str) -> None:
    """Semicolon-separated lines with a header; separators and line ends inside values are replaced."""
    cols = [
        (tx.csv_safe(F.col(c)) if t == "string" else F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if t == "timestamp" else F.col(c)).alias(n)
        for c, n, t in zip(_LOG_FIELDS, LOG_COLUMNS, _LOG_TYPES)
    ]
    log.select("siteindex", *cols).write.option("sep", ";").option("header", True).option("quote", "").csv(folder)


def read_request_log(spark: SparkSession, folder: str) -> DataFrame:
    schema = "`siteindex` int, " + ", ".join(f"`{n}` {t}" for n, t in zip(LOG_COLUMNS, _LOG_TYPES))
    df = spark.read.schema(schema).option("sep", ";").option("header", True).option("quote", "").option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(folder)
    return df.toDF("siteindex", *_LOG_FIELDS)


def read_inflections(spark: SparkSession, path: str) -> DataFrame:
    """(token, tag) of the first lexicon: tab-separated after fifteen lines of preamble and a header line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    header = lines.where("n = 15").select(F.split("line", "\t").alias("h")).first()
    columns = list(header.h) if header else []
    at = lambda name: columns.index(name) + 1 if name in columns else 0
    cells = lines.where("n > 15").select(F.split("line", "\t").alias("c"))
    token, tag = at("Flexion"), at("Étiquettes")
    rows = cells.select(F.try_element_at("c", F.lit(token or 1)).alias("token"), F.try_element_at("c", F.lit(tag or 2)).alias("raw"))
    return rows.where("token <> '' AND raw IS NOT NULL").select("token", tx.universal_tag(F.col("raw")).alias("tag"))


def read_tagged_forms(spark: SparkSession, path: str) -> DataFrame:
    """(token, tag) of the second lexicon: form and tag in the third and fourth of its columns or the first two.

    The file has no header; its first line is taken for one and lost.  Lines with too few cells are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    cells = F.split("line", "\t")
    rows = lines.where("n > 0").select(cells.alias("c")).where(F.size("c") >= 2)
    wide = F.size("c") >= 5
    return rows.select(F.when(wide, F.col("c")[2]).otherwise(F.col("c")[0]).alias("token"), F.when(wide, F.col("c")[3]).otherwise(F.col("c")[1]).alias("tag"))


def read_site_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url): one a line, surrounding quotes cut."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"^[\"']+|[\"',]+$", "").alias("url"))
    return lines.where("url <> ''")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(entry): the words of a lexicon file in upper case, comments skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"))
    return lines.where((F.col("v") != "") & ~F.col("v").startswith("#")).select(F.upper("v").alias("entry"))


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, timestamp, username, text) of the articles of a dump; redirects are left out."""
    df = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<timestamp:string,contributor:struct<username:string>,text:string>").load(path)
    out = df.select("title", "revision.timestamp", F.col("revision.contributor.username").alias("username"), F.col("revision.text").alias("text"))
    return out.where(~F.upper("text").startswith("#REDIRECT"))


def plain_wiki_text(text):
    """Wiki markup as plain text: templates, references, files and tables go, links keep their words."""
    for pattern, to in (
        (r"(?s)<ref[^>]*?/>|<ref.*?</ref>", ""),
        (r"(?s)\{\|.*?\|\}", ""),
        (r"\{\{[^{}]*\}\}", ""),
        (r"\{\{[^{}]*\}\}", ""),
        (r"(?i)\[\[(?:file|image|category|catégorie|fichier):[^\[\]]*\]\]", ""),
        (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"),
        (r"\[\[([^\]]*)\]\]", "$1"),
        (r"\[https?://\S+ ([^\]]*)\]", "$1"),
        (r"<[^>]+>", ""),
        (r"'{2,}", ""),
        (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"),
        (r"(?m)^[*#:;]+\s*", ""),
        (r"\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def pdf_pages(spark: SparkSession, path: str, extract) -> DataFrame:
    """Element rows of the PDF files below a path: a section a page, a block for each text block of it.

    ``extract(bytes)`` gives the pages' lists of texts; no PDF library is part of this package."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                rows.append((name, "Document", "Start", 1, name))
                for i, blocks in enumerate(extract(content), 1):
                    rows.append((name, "Section", "Start", 1, f"Page {i}"))
                    rows += [(name, "TextBlock", "Text", 2, b) for b in blocks]
                    rows.append((name, "Section", "End", 1, None))
                rows.append((name, "Document", "End", 1, name))
            yield pd.DataFrame(rows, columns=["doc", "docelttype", "doceltcmd", "nestinglevel", "text"]).assign(pos=range(len(rows)))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(run, "doc string, docelttype string, doceltcmd string, nestinglevel int, text string, pos int")
