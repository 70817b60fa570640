"""Problem 3: lines repeated across one site's documents.

Every line is parsed into a template: letters in lower case, while digits,
punctuation and spacing are slots that match anything.  Templates stand in a
token tree of fixed depth for each site: the path of a line is its first
letters, cut into tokens of equal length (scripts without spaces have no
others, and spacing mustn't matter).  Spark merges the trees of all partitions
by adding the rows below each leaf, and from the leaves those below the nodes
above; what can't cover enough pages is cut, whole, before any page is counted.
Below a leaf that stays, the pages of every template are counted exactly
(repeated_lines).  A node that stays although none of its children does has a
wildcard for a child, which takes all lines that go on in other ways, such as
bylines with names (slot_templates).

Nulls: rows without page_id, pos or text have no lines; a null site is a site
of its own that is never found; repeated rows count once; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import chars
from corpusloom.plans.session import settle

MIN_PAGES = 4
PAGE_SHARE = 8  # a template covers one page in so many
DEPTH, TOKEN = 3, 4  # of the tree: levels, letters a token
NODES = ("node1", "node2", "node3")
#: Templates are broadcast up to this many, else joined by shuffle.
BROADCAST_ROWS = 200_000

_LINES = T.ArrayType(
    T.StructType(
        [
            T.StructField("line_no", T.IntegerType()),
            *(T.StructField(f"node{k}", T.IntegerType()) for k in (1, 2, 3)),
            T.StructField("key", T.LongType()),
        ]
    )
)


def batch_lines(texts: pa.Array) -> pa.Array:
    """The lines with letters of every text: number from 1, nodes of the tree from its root to the leaf, template."""
    cp, bounds = chars.code_points(texts)
    starts, ends, row = chars.lines(cp, bounds)
    keep = (chars.classes()[cp] & (chars.LETTER | chars.MARK)) > 0
    at = chars.running(keep)
    letters = chars.lower_table()[cp[keep]]
    s, e = at[starts], at[ends]
    key = chars.span_hashes(letters, s, e).view(np.int64)
    nodes = [chars.span_hashes(letters, s, np.minimum(e, s + k * TOKEN)).astype(np.uint32).view(np.int32) for k in range(1, DEPTH + 1)]
    first = np.searchsorted(row, np.arange(len(bounds) - 1))
    number = np.arange(len(row)) - first[row] + 1
    real = e > s
    n = np.bincount(row[real], minlength=len(bounds) - 1)
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    items = pa.StructArray.from_arrays(
        [pa.array(number[real].astype(np.int32)), *(pa.array(x[real]) for x in nodes), pa.array(key[real])], ["line_no", *NODES, "key"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets), items)


@F.arrow_udf(_LINES)
def line_templates(texts: pa.Array) -> pa.Array:
    return chars.in_chunks(texts, batch_lines)


def text_lines(textdf: DataFrame) -> DataFrame:
    """(page_id, pos, siteindex, line_no, node1, node2, node3, key) of all lines with letters outside Document rows."""
    rows = textdf.where(
        F.col("text").isNotNull() & F.col("page_id").isNotNull() & F.col("pos").isNotNull() & ~F.col("docelttype").eqNullSafe("Document")
    )
    return rows.select("page_id", "pos", "siteindex", F.inline(line_templates("text")))


def needed_pages(nlpdocs: DataFrame) -> DataFrame:
    """(siteindex, need): on how many pages of a site a line comes back too often."""
    pages = nlpdocs.groupBy("siteindex").agg(F.countDistinct("page_id").alias("site_pages"))
    return pages.select("siteindex", F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("site_pages") / PAGE_SHARE)).alias("need"))


def merged_tree(lines: DataFrame, need: DataFrame) -> DataFrame:
    """(siteindex, node1, node2, node3, n, need) of the leaves below a node with lines enough: the trees of all partitions
    are added up by leaf; the nodes above are sums of the leaves."""
    leaves = lines.groupBy("siteindex", *NODES).agg(F.count(F.lit(1)).alias("n")).join(need, "siteindex")
    top = settle(leaves)
    kept = top.groupBy("siteindex", "need", "node1").agg(F.sum("n").alias("n")).where("n >= need").select("siteindex", "node1")
    return top.join(kept, ["siteindex", "node1"], "left_semi")


def site_templates(lines: DataFrame, nlpdocs: DataFrame) -> DataFrame:
    """(siteindex, key, pages): the templates of text_lines that cover too many pages of their site."""
    need = needed_pages(nlpdocs)
    leaves = settle(merged_tree(lines, need).where("n >= need").select("siteindex", "node3"))
    kept = lines.join(_small(leaves), ["siteindex", "node3"], "left_semi")
    return (
        kept.select("siteindex", "key", "page_id")
        .distinct()
        .groupBy("siteindex", "key")
        .agg(F.count(F.lit(1)).alias("pages"))
        .join(need, "siteindex")
        .where(F.col("pages") >= F.col("need"))
        .select("siteindex", "key", "pages")
    )


def slot_templates(textdf: DataFrame, nlpdocs: DataFrame) -> DataFrame:
    """(siteindex, depth, pages, page_id, pos, line_no): the templates with a wildcard after ``depth`` tokens that cover too
    many pages of their site, each with its first line: inner nodes whose lines go on in ways none of which recurs enough."""
    lines, need = settle(text_lines(textdf)), needed_pages(nlpdocs)
    tree = settle(merged_tree(lines, need))
    out, rest = None, tree.where("n < need")  # the lines of leaves that stay have templates of their own
    for depth in range(DEPTH - 1, 0, -1):
        node = NODES[depth - 1]
        full = settle(rest.groupBy("siteindex", "need", node).agg(F.sum("n").alias("n")).where("n >= need").select("siteindex", "need", node))
        below = lines.join(_small(full), ["siteindex", node]).join(_small(rest.select("siteindex", "node3").distinct()), ["siteindex", "node3"], "left_semi")
        found = below.groupBy("siteindex", "need", node, "page_id").agg(F.min(F.struct("page_id", "pos", "line_no")).alias("first"))
        found = found.groupBy("siteindex", "need", node).agg(F.count(F.lit(1)).alias("pages"), F.min("first").alias("first")).where("pages >= need")
        part = found.select("siteindex", F.lit(depth).alias("depth"), "pages", "first.*")
        out = part if out is None else out.unionByName(part)
        rest = settle(rest.join(_small(full), ["siteindex", node], "left_anti"))
    return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeated_lines(textdf: DataFrame, nlpdocs: DataFrame) -> DataFrame:
    """(page_id, pos, line_no) of the lines whose template covers too many pages of their site."""
    lines = settle(text_lines(textdf))
    found = settle(site_templates(lines, nlpdocs).select("siteindex", "key"))
    return lines.join(_small(found), ["siteindex", "key"], "left_semi").select("page_id", "pos", "line_no").distinct()


def without_repeated_lines(textdf: DataFrame, nlpdocs: DataFrame) -> DataFrame:
    """textdf, each row once, with the column clean_text: the text without its repeated
    lines; null where the text is null, empty where nothing remains."""
    found = repeated_lines(textdf, nlpdocs).groupBy("page_id", "pos").agg(F.collect_set("line_no").alias("_lines"))
    rows = textdf.dropDuplicates(["page_id", "pos"]).join(found, ["page_id", "pos"], "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_lines", (i + 1).cast("int")))
    return rows.withColumn("clean_text", F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("_lines")
