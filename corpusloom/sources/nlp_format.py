"""The line-oriented structured text format: element rows <-> lines <-> files.

A file is a document; its lines are properties, delimiters and text blocks.
Rows are (doc, pos, docelttype, doceltcmd, nestinglevel, text[, coords]) as in the
element stream.  Reading and writing are expressions over one document's lines
or rows; only the grouping of a document's rows shuffles."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from corpusloom.functions.text import TITLE_LIMIT, escaped_block, unescaped_block

# Fixed values of the format.
PROPERTY = "## NLPTextDocument "
KINDS = "Section|NavigationList|List|ListItem|Table|TableHeader|TableCell"
_DELIMITER = rf"^## (\d+) ({KINDS}) (Start|End|Items) ?(.*)$"
SCHEMA = "doc string, pos int, docelttype string, doceltcmd string, nestinglevel int, text string"


def parse_documents(files: DataFrame, strict: bool = True) -> DataFrame:
    """Element rows of files(doc, value): one row for each whole file.

    The Start rows of table cells have coordinates in ``coords``: row,column, with spans row:span,column:span.
    Malformed delimiters raise an error (``strict``) or are dropped; empty lines are skipped.
    Text rows carry the level of the last delimiter, list items of the short form one more."""
    lines = files.select("doc", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).where(F.col("value") != "")
    v = F.col("value")
    part = lambda i: F.regexp_extract(v, _DELIMITER, i)
    lines = lines.select(
        "doc",
        "line",
        "value",
        F.when(v.startswith(PROPERTY), F.regexp_extract(v, rf"^{PROPERTY}(\S+) ?(.*)$", 1)).alias("name"),
        F.when(v.startswith("##") & ~v.startswith(PROPERTY), F.coalesce(F.nullif(part(1), F.lit("")), F.lit("?"))).alias("level"),
        part(2).alias("kind"),
        part(3).alias("cmd"),
        F.trim(part(4)).alias("rest"),
    )
    bad = F.col("level").eqNullSafe("?") | (F.col("name").isNotNull() & ~F.col("name").isin("Title", "Uri", "Timestamp", "Metadata"))
    if strict:
        message = F.concat(F.lit("File format error in "), F.col("doc"), F.lit(" on line "), F.col("line").cast("string"), F.lit(": "), F.substring("value", 1, 50))
        lines = lines.withColumn("value", F.when(bad, F.raise_error(message)).otherwise(F.col("value")))
    else:
        lines = lines.where(~bad)
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("at", F.coalesce(F.last(F.col("level").try_cast("int"), ignorenulls=True).over(w), F.lit(1)))
    none = F.lit(None).cast("string")

    def row(kind: Column, cmd: Column, level: Column, text: Column, coords: Column = none) -> Column:
        return F.struct(kind.alias("docelttype"), cmd.alias("doceltcmd"), level.cast("int").alias("nestinglevel"), unescaped_block(text).alias("text"), coords.alias("coords"))

    title = F.nullif(F.trim(F.substring_index("rest", ">>", 1)), F.lit(""))
    items = F.filter(F.transform(F.split(F.regexp_extract("rest", r"^.*?>>(.*)$", 1), r"\|\|"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.concat(
        F.array(row(F.col("kind"), F.lit("Start"), F.col("at"), title)),
        F.transform(items, lambda x: row(F.lit("ListItem"), F.lit("Text"), F.col("at") + 1, x)),
        F.array(row(F.col("kind"), F.lit("End"), F.col("at"), none)),
    )
    started = F.when(F.col("kind").isin("Section", "NavigationList", "List", "Table"), F.nullif(F.col("rest"), F.lit("")))
    cell = F.when(F.col("kind").isin("TableHeader", "TableCell"), F.nullif(F.col("rest"), F.lit("")))
    value = F.trim(F.regexp_extract("value", rf"^{PROPERTY}(\S+) ?(.*)$", 2))
    rows = (
        F.when(F.col("name").isin("Title", "Uri"), F.array(row(F.lit("Document"), F.col("name"), F.lit(1), value)))
        .when(F.col("name").isNotNull(), F.array().cast("array<struct<docelttype:string,doceltcmd:string,nestinglevel:int,text:string,coords:string>>"))
        .when(F.col("cmd") == "Items", short)
        .when(F.col("cmd") == "Start", F.array(row(F.col("kind"), F.lit("Start"), F.col("at"), started, cell)))
        .when(F.col("cmd") == "End", F.array(row(F.col("kind"), F.lit("End"), F.col("at"), none)))
        .otherwise(F.array(row(F.lit("TextBlock"), F.lit("Text"), F.col("at"), F.col("value"))))
    )
    body = lines.select("doc", "line", F.posexplode(rows).alias("sub", "r"))
    ends = files.select("doc", F.explode(F.array(F.lit(-1), F.lit(2**31 - 1))).alias("line")).select(
        "doc", "line", F.lit(0).alias("sub"), row(F.lit("Document"), F.when(F.col("line") < 0, "Start").otherwise("End"), F.lit(1), F.col("doc")).alias("r")
    )
    order = Window.partitionBy("doc").orderBy("line", "sub")
    return body.unionByName(ends).select("doc", (F.row_number().over(order) - 1).cast("int").alias("pos"), "r.*")


def document_metadata(files: DataFrame) -> DataFrame:
    """(doc, title, uri, timestamp, metadata) of files(doc, value)."""
    value = lambda name: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{PROPERTY}{name} (.*)$", 1)), F.lit(""))
    pairs = F.regexp_extract_all("value", F.lit(rf"(?m)^{PROPERTY}Metadata ([^\r\n]*)$"), F.lit(1))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), p.substr(F.locate("=", p) + 1, F.length(p))))
    return files.select("doc", value("Title").alias("title"), value("Uri").alias("uri"), value("Timestamp").alias("timestamp"), F.map_from_entries(entries).alias("metadata"))


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Element rows of all .nlp.txt files below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.nlp.txt").text(folder, wholetext=True)
    return parse_documents(files.select(F.col("_metadata.file_path").alias("doc"), "value"))


def render_documents(rows: DataFrame, compact: bool = True) -> DataFrame:
    """(doc, value): the lines of every document's element rows (doc, pos, docelttype, doceltcmd, nestinglevel, text).

    Lists of nothing but one-line items take one line.  ``compact`` writes as little as the format allows: untitled
    groups without content go, and lists of short items are put in the one-line form; without it every row has its line."""
    w = Window.partitionBy("doc").orderBy("pos")
    one_line = F.replace(F.col("text"), F.lit("\n"), F.lit("\\n"))
    text, kind, cmd, level = one_line, F.col("docelttype"), F.col("doceltcmd"), F.col("nestinglevel").cast("int")
    rows = rows.dropDuplicates(["doc", "pos"])
    if "coords" not in rows.columns:
        rows = rows.withColumn("coords", F.lit(None).cast("string"))
    rows = _with_end_titles(_compacted(rows) if compact else rows)
    opens = F.when((cmd == "Start") & kind.isin("List", "NavigationList"), 1).otherwise(0)
    rows = rows.withColumn("_l", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("doc", "_l")
    listed = (F.min(F.when(kind == "ListItem", cmd == "Text").otherwise(True)).over(inside)) & (F.col("_l") > 0)
    end = F.min(F.when((cmd == "End") & kind.isin("List", "NavigationList"), F.col("pos"))).over(inside)
    only_items = F.min(F.when(F.col("pos") < end, kind.isin("ListItem", "List", "NavigationList")).otherwise(True)).over(inside)
    rows = rows.withColumn("_end", end).withColumn("_short", listed & only_items & (F.col("pos") <= end))
    header = F.concat(F.lit("## "), level.cast("string"), F.lit(" "), kind, F.lit(" "))
    shown = F.when(F.length(text) > TITLE_LIMIT, F.concat(F.substring(text, 1, TITLE_LIMIT), F.lit("..."))).otherwise(text)
    line = (
        F.when((kind == "Document") & cmd.isin("Title", "Uri"), F.concat(F.lit(PROPERTY), cmd, F.lit(" "), F.coalesce(text, F.lit(""))))
        .when(kind == "Document", F.lit(None))
        .when(F.col("_short") & (cmd == "Start"), F.concat(header, F.lit("Items "), F.coalesce(F.concat(text, F.lit(" ")), F.lit("")), F.lit(">> ")))
        .when(F.col("_short") & (cmd == "Text"), text)
        .when(F.col("_short"), F.lit(None))
        .when(cmd == "Text", escaped_block(F.col("text")))
        .when(cmd == "Start", F.concat(header, F.lit("Start "), F.coalesce(text, "coords", F.lit(""))))
        .otherwise(F.concat(header, F.lit("End"), F.coalesce(F.concat(F.lit(" <<"), shown, F.lit(">>")), F.lit(""))))
    )
    rows = rows.withColumn("_line", line).withColumn("_group", F.when(F.col("_short"), F.col("_l")).otherwise(-F.col("pos") - 1))
    parts = rows.where(F.col("_line").isNotNull()).groupBy("doc", "_group").agg(
        F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "_line"))).alias("p")
    )
    one = F.when(F.col("_group") > 0, F.concat(F.col("p")[0]["_line"], F.array_join(F.slice("p._line", 2, F.greatest(F.size("p"), F.lit(1))), " || "))).otherwise(F.col("p")[0]["_line"])
    lines = parts.select("doc", F.struct("pos", one.alias("line")).alias("l"))
    return lines.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list("l"))["line"], "\n").alias("value"))


def _compacted(rows: DataFrame) -> DataFrame:
    """Rows without untitled groups that have no content (navigation lists stay), and with the items of lists of
    nothing but short items as single rows."""
    w = Window.partitionBy("doc").orderBy("pos")
    group = F.col("docelttype").isin("Section", "List", "Table", "ListItem", "TableHeader", "TableCell")
    start, end = F.col("doceltcmd") == "Start", F.col("doceltcmd") == "End"
    same = F.coalesce(F.lead("docelttype").over(w) == F.col("docelttype"), F.lit(False))
    opens_empty = group & start & (F.coalesce(F.col("text"), F.lit("")) == "") & same & F.coalesce(F.lead(end).over(w), F.lit(False))
    rows = rows.withColumn("_e", opens_empty).withColumn("_e", F.col("_e") | F.coalesce(F.lag("_e").over(w), F.lit(False))).where(~F.col("_e")).drop("_e")
    # an item of one short block is a one-line item if all of its list's are
    item = lambda c, by: F.coalesce(F.lag(c, by).over(w), F.lit("")) if by > 0 else F.coalesce(F.lead(c, -by).over(w), F.lit(""))
    single = (
        (F.col("docelttype") == "TextBlock") & (F.length("text") < 50) & (item("docelttype", 1) == "ListItem") & (item("doceltcmd", 1) == "Start")
        & (item("docelttype", -1) == "ListItem") & (item("doceltcmd", -1) == "End")
    )
    opens = F.when((F.col("doceltcmd") == "Start") & F.col("docelttype").isin("List", "NavigationList"), 1).otherwise(0)
    rows = rows.withColumn("_s", single).withColumn("_g", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shell = (F.col("docelttype") == "ListItem") & F.col("doceltcmd").isin("Start", "End")
    closes = F.min(F.when((F.col("doceltcmd") == "End") & F.col("docelttype").isin("List", "NavigationList"), F.col("pos"))).over(Window.partitionBy("doc", "_g"))
    rows = rows.withColumn("_c", closes)
    within = (F.col("_g") > 0) & (F.col("pos") < F.col("_c"))
    list_row = F.col("docelttype").isin("List", "NavigationList")
    fine = F.min(F.when(within, F.col("_s") | shell | list_row | ((F.col("docelttype") == "ListItem") & (F.col("doceltcmd") == "Text"))).otherwise(True)).over(Window.partitionBy("doc", "_g"))
    items = F.count_if(within & shell).over(Window.partitionBy("doc", "_g")) == 2 * F.count_if(within & F.col("_s")).over(Window.partitionBy("doc", "_g"))
    rows = rows.withColumn("_f", fine & items & within)
    rows = rows.where(~(F.col("_f") & shell)).withColumn("docelttype", F.when(F.col("_f") & F.col("_s"), "ListItem").otherwise(F.col("docelttype")))
    return rows.drop("_s", "_g", "_c", "_f")


def _with_end_titles(rows: DataFrame) -> DataFrame:
    start, end = F.col("doceltcmd") == "Start", F.col("doceltcmd") == "End"
    titled = Window.partitionBy("doc", "nestinglevel", "docelttype").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(start, F.struct(F.col("text").alias("t"))), ignorenulls=True).over(titled)["t"]
    return rows.withColumn("text", F.when(end & (F.col("docelttype") != "Document"), last).otherwise(F.col("text")))


def file_name(doc: str) -> str:
    """The file of a document below its folder: without scheme and leading slashes, and never above the folder."""
    parts = [p for p in doc.partition("://")[2 if "://" in doc else 0].split("/") if p not in ("", ".", "..")]
    return "/".join(parts or ["_default_"]).removesuffix(".nlp.txt") + ".nlp.txt"


def write_documents(rows: DataFrame, folder: str) -> None:
    """A file of a document's lines for each document, doc.nlp.txt below the folder (in its sub-folders, if doc has slashes), so
    that load_documents reads them again.  Each task writes the files of its documents; a repeated task writes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for doc, value in zip(batch.column("doc").to_pylist(), batch.column("value").to_pylist()):
                path = f"{base}/{file_name(doc)}"
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(path) as f:
                    f.write(value.encode())
            yield batch.select(["doc"])

    render_documents(rows).mapInArrow(write, "doc string").write.format("noop").mode("overwrite").save()


class StructuredTextSource(DataSource):
    """spark.read.format("structured_text").option("path", folder): element rows of .nlp.txt files, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "structured_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        fs, path = pa_fs.FileSystem.from_uri(self.folder)
        found = fs.get_file_info(pa_fs.FileSelector(path, recursive=True))
        return [InputPartition(p) for p in sorted(f.path for f in found if f.is_file and f.path.endswith(".nlp.txt"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = pa_fs.FileSystem.from_uri(self.folder)
        with fs.open_input_stream(partition.value) as f, io.TextIOWrapper(f, encoding="utf-8-sig") as lines:
            for pos, row in enumerate(element_rows(partition.value, lines)):
                yield (partition.value, pos, *row)


def element_rows(doc: str, lines) -> Iterator[tuple[str, str, int, str | None]]:
    """(kind, command, level, text) of a file's lines, one by one."""
    import re

    level, delimiter = 1, re.compile(_DELIMITER)
    yield "Document", "Start", 1, doc
    for line in lines:
        line = line.rstrip("\r\n")
        if not line:
            continue
        if line.startswith(PROPERTY):
            name, _, value = line[len(PROPERTY) :].partition(" ")
            if name in ("Title", "Uri"):
                yield "Document", name, 1, value.strip().replace("\\n", "\n")
            continue
        if not line.startswith("##"):
            yield "TextBlock", "Text", level, line.replace("\\n", "\n")
            continue
        m = delimiter.match(line)
        if not m:
            raise ValueError(f"File format error in file {doc}: {line[:50]}")
        level, kind, cmd, rest = int(m[1]), m[2], m[3], m[4].strip()
        if cmd == "Items":
            title, _, items = rest.partition(">>")
            yield kind, "Start", level, title.strip() or None
            for item in filter(None, map(str.strip, items.split("||"))):
                yield "ListItem", "Text", level + 1, item.replace("\\n", "\n")
            yield kind, "End", level, None
        else:
            titled = cmd == "Start" and kind in ("Section", "NavigationList", "List", "Table")
            yield kind, cmd, level, (rest or None) if titled else None
    yield "Document", "End", 1, doc


def arrow_rows(rows: list[tuple]) -> pa.Table:
    """Element rows as an Arrow table of the schema above."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
