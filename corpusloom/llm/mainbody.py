"""Problem 2: page boilerplate mixed with main content.

Site template removal.  A page of the element stream is a sequence of
level-1 subtrees (sections, lists, single blocks), which nest.  Every row has a
hash of its level and normalised text (if long, its text in lower case); the hash of a subtree is made of the sum
of its root's and its children's, whole texts of any length included.  Spark
counts the different page bodies of each host in which a hash comes back, and a
subtree that recurs is deleted with everything below it.  For templates that
change from page to page, leaves that can stand for a section (its heading, the
first block below a heading, the label in front of a colon) have keys as well; a
section whose heading (or first leaf) recurs is deleted too.  What hangs directly
at level 1 outside any section and doesn't recur (trails, teaser lists) is taken
as page chrome by its position, unless the page has no other text at all; so
what remains inside the surviving sections is the main body.

Nulls: rows without page_id or pos are ignored; a null text never is
boilerplate; a null docelttype is resolved from the neighbouring rows; a null
level counts as body.  Repeated rows count once.  Empty tables give empty
results.  Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.session import settle

#: A hash recurs on a host if it is in so many page bodies, and in as many as this share of its pages.
MIN_PAGES = 3
LEAF_SHARE = 0.02
SLOT_SHARE = 0.05
#: Leaves beyond this length are running text; a subtree that begins with one isn't a template.
SHORT = 160
#: Subtrees rooted at these levels have hashes of their own; what is deeper counts in theirs.
TREES = (1, 2, 3)
#: Bits of a row's hash, so that the sum of four million rows doesn't overflow.
ROW_BITS = 40
#: The table of recurring hashes is broadcast up to this many rows, else joined by shuffle.
BROADCAST_ROWS = 200_000

_OWN = set("page_id pos siteindex kind cmd level has_text is_doc pdf outside in_section top_key label_key leaf_key slot_key head_key body_key body page_title trees".split()) | {f"tree_{k}" for k in TREES}


def norm(c: Column) -> Column:
    """Letters in lower case; all else is one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}]+", " "))


def is_pdf(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).endswith(".pdf"), F.lit(False))


def _h(tag: str, c: Column) -> Column:
    """The key of a leaf: null for texts without letters."""
    return F.when(F.length(c) > 0, F.xxhash64(F.lit(tag), c))


def _slots(short: Column) -> Column:
    """A short text without what changes from page to page."""
    cased = F.regexp_replace(short, r"(?<=\S\s{1,3})\p{Lu}[\p{L}\p{M}.’']*", "X")
    return (
        F.when(short.rlike(r"[,，]\s*[^,，]+$"), F.concat(F.lit("… "), F.regexp_extract(short, r"[,，]\s*([^,，]+)$", 1)))
        .when(short.rlike(r"^\s*[^:：・\n]+[:：・]"), F.concat(F.regexp_extract(short, r"^\s*([^:：・\n]+)[:：・]", 1), F.lit(" …")))
        .when(~short.rlike(r"[\p{Lu}\p{Ll}]"), F.regexp_extract(short, r"^\s*(\S+)", 1))
        .otherwise(cased)
    )


#: Kinds and commands of the format by number; 0 is null, and all that have no name here come last.
_KINDS = ("Document", "Section", "List", "NavigationList", "ListItem", "Table", "TableHeader", "TableCell", "TextBlock")
_CMDS = ("Start", "End", "Text", "Title", "Uri")
_DOCUMENT, _SECTION, _LIST, _NAVIGATION, _ITEM = range(1, 6)
_START, _END, _TEXT, _TITLE, _URI = range(1, 6)
_OTHER = "other"
#: Numbers of a row on their way into the walk over the pages and out of it; the bits of its code below its level, and of its marks.
#: They travel as one array, as every column takes Spark's Arrow writer about as long as its sorting does.
_IN = ("page_id", "pos", "siteindex", "code", "v", "name", "titled")
_OUT = ("page_id", "pos", "siteindex", "code", "marks", "name", "top_name", "titled", "sketch", *(f"held_{k}" for k in TREES))
_CODE = {c: 7 + i for i, c in enumerate(("long", "has_text", "uri", "uri_pdf", "titled", "name", "siteindex", "heading"))}
_LEVEL = 16
_MARKS = {c: i for i, c in enumerate(("pdf", "in_section", "in_list", "bodied", "first", "top_head", "top_name", "titled", "sketch", *(f"held_{k}" for k in TREES), *(f"begins_{k}" for k in TREES)))}


def _number(c: Column, names: tuple[str, ...], other: int) -> Column:
    return F.coalesce(*(F.when(c == x, F.lit(i + 1)) for i, x in enumerate(names)), F.when(c.isNotNull(), F.lit(other)), F.lit(0))


def _named(number: Column, names: tuple[str, ...]) -> Column:
    return F.when(number > 0, F.coalesce(*(F.when(number == i + 1, F.lit(x)) for i, x in enumerate(names)), F.lit(_OTHER)))


def _walk(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of whole pages, in order: the rows with text and the openings of sections that have a key, each once, with what their page and neighbours tell of them."""
    numbers = batch.column("_numbers").flatten().to_numpy().reshape(batch.num_rows, len(_IN))
    once = np.ones(len(numbers), bool)
    once[1:] = (numbers[1:, :2] != numbers[:-1, :2]).any(axis=1)
    if not once.all():
        batch, numbers = batch.filter(pa.array(once)), numbers[once]
    page, _, _, code, v, name, titled = (np.ascontiguousarray(c) for c in numbers.T)
    n = len(page)
    begins = np.ones(n, bool)
    begins[1:] = page[1:] != page[:-1]
    here, starts = np.arange(n), np.flatnonzero(begins)
    sizes = np.diff(starts, append=n)
    start, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    kind, cmd, level = code & 15, (code >> 4) & 7, code >> _LEVEL
    long, has_text, uri, uri_pdf, is_titled, named, _, heading = (((code >> i) & 1).astype(bool) for i in _CODE.values())

    def last(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The page's last row with the flag up to each row, and whether there is one."""
        at = np.maximum.accumulate(np.where(flag, here, -1))
        return at, at >= start

    def later(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The page's first row with the flag after each row, and whether there is one."""
        at = np.append(np.minimum.accumulate(np.where(flag, here, n)[::-1])[::-1][1:], n)
        return np.minimum(at, n - 1), at < end

    def least(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least known value of each row's page, and whether there is one."""
        lowest = np.minimum.reduceat(np.where(known, values, np.iinfo(np.int64).max), starts)
        return np.repeat(lowest, sizes), np.repeat(np.logical_or.reduceat(known, starts), sizes)

    follows, after, back = here + 1 < end, np.minimum(here + 1, n - 1), np.maximum(here - 1, 0)
    doc = kind == _DOCUMENT
    one, opener = level == 1, (cmd == _START) & ~doc
    listy = np.where(kind > 0, (kind == _LIST) | (kind == _NAVIGATION), follows & (kind[after] == _ITEM))
    section, listed = one & opener & ~listy, one & opener & listy
    # a section's name: its heading, else its first leaf; none if running text follows or it begins the page's title
    keyed = section & ~(follows & long[after]) & (named | (follows & named[after]))
    title, has_title = last((cmd == _TITLE) & heading)
    asked = np.flatnonzero(keyed & has_title & heading)
    if len(asked):
        brief = batch.column("_brief")
        begun = zip(brief.take(pa.array(title[asked])).to_pylist(), brief.take(pa.array(asked)).to_pylist())
        keyed[asked] = [not whole.startswith(x) for whole, x in begun]
    top, under = last(one)
    at_uri, has_uri = last(uri)
    in_list = under & listed[top]
    out = {"code": code, "name": name, "top_name": np.where(named, name, name[after])[top]}
    marks = {"pdf": has_uri & uri_pdf[at_uri], "in_section": under & section[top], "in_list": in_list, "top_head": named[top], "top_name": under & keyed[top]}
    marks["first"] = ~begins & (level[back] == 1) & (cmd[back] == _START) & has_text[back] & (level == 2) & (cmd == _TEXT)
    # a page without any text below level 1 but in lists has nothing but its level-1 rows for a body
    bodied = (level > 1) & ~in_list & ~doc & (cmd == _TEXT) & has_text
    marks["bodied"] = np.repeat(np.logical_or.reduceat(bodied, starts), sizes)
    # copies of a page have its title, exact ones its running text as well
    out["titled"], marks["titled"] = least(titled, is_titled)
    out["sketch"], marks["sketch"] = least(v, long & (level > 1) & (v > 0))
    # a subtree's sum is what has run up at its end less what had at its beginning
    before = np.cumsum(v) - v
    before -= before[start]
    total = np.repeat(np.add.reduceat(v, starts), sizes)
    opens = ~doc & (cmd != _END)
    holds = (kind == 0) | (kind == _SECTION) | (kind == _LIST) | (kind == _NAVIGATION)
    for k in TREES:  # blocks, items and cells below level 1 are no templates alone: bodies have equal ones
        below = opens & (level <= k)
        rooted = (level == k) & (holds & (cmd == _START) if k > 1 else True)
        unsure = (level == k) & holds & (cmd == 0) if k > 1 else False
        root, in_tree = last(below & ~unsure)
        close, closed = later(below)
        out[f"held_{k}"] = held = np.where(closed, before[close], total) - before[root]
        marks[f"held_{k}"] = tree = in_tree & rooted[root] & ~doc & (held > 0)
        # the first row with content names the subtrees that begin with it
        marks[f"begins_{k}"] = tree & (v > 0) & (before == before[root])
    keep = has_text | (one & marks["top_name"])
    out |= {c: numbers[:, i] for i, c in enumerate(_IN[:3])} | {"marks": sum(marks[c].astype(np.int64) << i for c, i in _MARKS.items())}
    flat = np.stack([out[c][keep] for c in _OUT], axis=1)
    batch = batch.filter(pa.array(keep))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(_OUT)), pa.array(flat.ravel()))
    return pa.RecordBatch.from_arrays([lists, *batch.columns[1:]], batch.schema.names)


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page in one piece through _walk."""
    held: list[pa.RecordBatch] = []
    going = None
    for batch in batches:
        if not batch.num_rows:
            continue
        page = batch.column("_numbers").flatten().to_numpy()[:: len(_IN)]
        whole = int(np.argmax(page == page[-1]))  # the last page may go on
        if held and (whole or page[-1] != going):
            yield _walk(pa.concat_batches([*held, batch.slice(0, whole)]))
            held = []
        elif whole:
            yield _walk(batch.slice(0, whole))
        held.append(batch.slice(whole))
        going = page[-1]
    if held:
        yield _walk(pa.concat_batches(held))


def element_rows(textdf: DataFrame, carry: tuple[Column, ...] = ()) -> DataFrame:
    """Every row with text and every opening of a section that has a key, once, with its level-1 subtree and the hashes that stand for it.

    One shuffle by page, one sort and one walk over the sorted pages serve all.  Long
    texts don't take part in it: what is needed of them is computed in the scan, and so
    are the aliased columns ``carry``."""
    t = F.col("text")
    content = F.col("_content")
    # only headings and the first leaves of sections stand for a subtree, only blocks carry labels
    level = F.coalesce(F.col("nestinglevel").cast("int"), F.lit(2))
    kind, cmd = F.col("docelttype"), F.col("doceltcmd")
    is_short = F.length(t) <= SHORT
    brief = (level <= 2) & is_short
    element = F.coalesce(kind != "Document", ~cmd.isin("Title", "Uri"), F.lit(True))
    block = (level == 2) & (cmd == "Text") & ~F.coalesce(kind == "ListItem", F.lit(False))
    heading = is_short & ((level == 1) | ((level == 2) & (cmd == "Title")))
    flags = {
        "long": F.length(t) > SHORT, "has_text": t.isNotNull(), "uri": cmd == "Uri", "uri_pdf": is_pdf(t), "titled": (cmd == "Title") & t.isNotNull(),
        "name": brief & (F.length(content) > 0), "siteindex": F.col("siteindex").isNotNull(), "heading": heading,
    }
    code = level.cast("long") * (1 << _LEVEL) + _number(kind, _KINDS, 15) + _number(cmd, _CMDS, 7) * 16
    numbers = {
        "code": code + sum(F.when(c, F.lit(1 << _CODE[x])).otherwise(0) for x, c in flags.items()),
        "v": F.when(element & ((F.length(t) > SHORT) | (F.length(content) > 0)), F.shiftrightunsigned(F.xxhash64(level, F.coalesce(content, F.lower(F.trim(t)))), 64 - ROW_BITS)).otherwise(0),
        "name": F.when(flags["name"], F.xxhash64(content)).otherwise(0),
        "titled": F.when(flags["titled"], F.xxhash64(F.lower(F.trim(t)))).otherwise(0),
    }
    rows = textdf.where(F.col("page_id").isNotNull() & F.col("pos").isNotNull())
    types = {c: rows.schema[c].dataType for c in _IN[:3]}
    rows = rows.withColumn("_content", F.when(is_short, norm(t))).select(
        *types, *(c.alias(x) for x, c in numbers.items()), F.when(block & is_short, t).when(heading, content).cast("binary").alias("_brief"), *carry
    )
    rows = rows.repartition("page_id").sortWithinPartitions("page_id", "pos")
    kept = [f for f in rows.schema if f.name not in _IN and f.name != "_brief"]
    records = [f.name for f in kept if f.dataType.typeName() == "struct" and len({x.dataType for x in f.dataType}) == 1]  # numbers of one type
    packed = [F.when(F.col(c).isNotNull(), F.array(*(F.col(c)[x] for x in rows.schema[c].dataType.names))).alias(c) if c in records else F.col(c) for c in (f.name for f in kept)]
    rows = rows.select(F.array(*(F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in _IN)).alias("_numbers"), "_brief", *packed)
    rows = rows.mapInArrow(walked, rows.schema)
    unpacked = lambda f: F.when(F.col(f.name).isNotNull(), F.struct(*(F.col(f.name)[i].alias(x.name) for i, x in enumerate(f.dataType)))).alias(f.name)
    carried = [unpacked(f) if f.name in records else F.col(f.name) for f in kept]

    of = {c: F.col("_numbers")[i] for i, c in enumerate(_OUT)}
    mark = {c: F.col("_marks").bitwiseAND(F.lit(1 << i)) > 0 for c, i in _MARKS.items()}
    told = {c: F.col("_code").bitwiseAND(F.lit(1 << i)) > 0 for c, i in _CODE.items()}
    rows = rows.withColumns({"_code": of["code"], "_marks": of["marks"]})
    level, number = F.shiftright("_code", _LEVEL).cast("int"), F.col("_code").bitwiseAND(F.lit(15))
    kind, cmd = _named(number, _KINDS), _named(F.shiftright("_code", 4).bitwiseAND(F.lit(7)), _CMDS)
    is_doc, in_section = number == _DOCUMENT, mark["in_section"]
    short = F.when((level == 2) & (cmd == "Text") & (number != _ITEM), F.col("_brief").cast("string"))
    label = F.when(~short.rlike(r"[.!?。！？]\s*$"), norm(F.regexp_extract(short, r"^\s*([\p{L}\p{M} ’']{2,}?)\s*[:：]", 1)))
    key = lambda tag, c: F.xxhash64(F.lit(tag), c)
    top_key = F.when(in_section & mark["top_name"], F.when(mark["top_head"], key("head", of["top_name"])).otherwise(key("leaf", of["top_name"])))
    page_title = F.when(mark["titled"], of["titled"]).otherwise(F.xxhash64(of["page_id"]))
    trees = {k: F.when(mark[f"held_{k}"], key("tree", of[f"held_{k}"])) for k in TREES}
    return rows.select(
        *((F.when(told[c], of[c]) if c == "siteindex" else of[c]).cast(k).alias(c) for c, k in types.items()),
        kind.alias("kind"),
        cmd.alias("cmd"),
        level.alias("level"),
        told["has_text"].alias("has_text"),
        is_doc.alias("is_doc"),
        mark["pdf"].alias("pdf"),
        (mark["bodied"] & (((level == 1) & ~is_doc & (cmd == "Text")) | (mark["in_list"] & ~is_doc))).alias("outside"),
        (in_section & ~is_doc).alias("in_section"),
        top_key.alias("top_key"),
        # keys that may recur: own heading or label; for the first block of a section its leaf and its slots
        F.when(in_section & (F.length(label) > 0), key("head", F.xxhash64(label))).alias("label_key"),
        F.when(mark["first"] & told["name"], key("first", of["name"])).alias("leaf_key"),
        F.when(mark["first"], _h("slots", norm(_slots(short)))).alias("slot_key"),
        F.when((level == 1) & ~is_doc & told["name"], key("head", of["name"])).alias("head_key"),
        F.when(level == 1, top_key).alias("body_key"),
        page_title.alias("page_title"),
        F.xxhash64(page_title, F.when(mark["sketch"], of["sketch"]).otherwise(of["page_id"])).alias("body"),
        *(c.alias(f"tree_{k}") for k, c in trees.items()),
        F.array_compact(F.array(*(F.when(mark[f"begins_{k}"], c) for k, c in trees.items()))).alias("trees"),
        *carried,
    )


def recurring(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(siteindex, key, head): the hashes that come back in too many page bodies of their host."""
    names = ("leaf_key", "slot_key", "head_key", "body_key", "label_key")
    keys = F.filter(
        F.array(*(F.struct(F.col(k).alias("key"), F.lit(k == "leaf_key").alias("leaf"), F.lit(k == "head_key").alias("head")) for k in names)),
        lambda x: x["key"].isNotNull(),
    )
    keys = F.concat(keys, F.transform("trees", lambda k: F.struct(k.alias("key"), F.lit(False).alias("leaf"), F.lit(False).alias("head"))))
    one = (
        rows.where(F.size(keys) > 0)
        .select("body", "page_title", "siteindex", F.explode(keys).alias("x"))
        .groupBy("body", "page_title", "siteindex", "x.key")
        .agg(F.max("x.leaf").alias("leaf"), F.max("x.head").alias("head"))
    )
    counts = (
        one.groupBy("siteindex", "key")
        .agg(F.count(F.lit(1)).alias("bodies"), F.countDistinct("page_title").alias("titles"), F.max("leaf").alias("leaf"), F.max("head").alias("head"))
        .where(F.col("bodies") >= MIN_PAGES)
    )
    # pages of one title are like copies, unless most pages of the host have the same few titles
    own = rows.where(F.col("cmd") == "Title").groupBy("siteindex").agg((F.countDistinct("page_title") * 2 >= F.countDistinct("page_id")).alias("own"))
    counts = counts.join(own, "siteindex", "left").withColumn("n", F.when(F.col("own"), F.col("titles")).otherwise(F.col("bodies")))
    counts = counts.where(F.col("n") >= MIN_PAGES)
    total = pages.groupBy("siteindex").agg(F.countDistinct("page_id").alias("pages"))
    share = F.when(F.col("leaf"), F.lit(LEAF_SHARE)).otherwise(F.lit(SLOT_SHARE))
    return counts.join(total, "siteindex").where(F.col("n") >= share * F.col("pages")).select("siteindex", "key", "head")


def main_body(textdf: DataFrame, nlpdocs: DataFrame, carry: tuple[Column, ...] = ()) -> DataFrame:
    """Rows of textdf with text, each once, and the openings of sections: page_id, pos,
    siteindex, kind, cmd, level, has_text, is_doc, pdf, boiler and the columns ``carry``. A kind
    or cmd without a name in _KINDS or _CMDS is "other".

    ``boiler`` is true on rows outside the main body of their web page, headings
    of deleted subtrees included.  Rows of PDF pages (those whose Uri row ends in
    ``.pdf``) are always body."""
    rows = settle(element_rows(textdf, carry))
    rec = settle(recurring(rows, nlpdocs))
    small = rec.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda d: d)
    carried = [c for c in rows.columns if c not in _OWN]
    # rows without a key (most) have one of their own in a shuffle, so that they aren't all in one task
    spread = (lambda c: F.col(c)) if small else (lambda c: F.coalesce(F.col(c), F.xxhash64("page_id", "pos", F.lit(c))))
    trees = [f"tree_{k}" for k in TREES]
    for key in ("top_key", "leaf_key", "slot_key", "label_key", *trees):
        r = rec.select(F.col("siteindex").alias("_s"), F.col("key").alias("_k"), F.lit(True).alias(f"{key}_rec"))
        rows = rows.withColumn("_j", spread(key)).join(hint(r), (F.col("siteindex") == F.col("_s")) & (F.col("_j") == F.col("_k")), "left").drop("_s", "_k", "_j")
    # a heading that is a template on any host marks the one-line teasers it labels on all hosts
    heads = rec.where("head").select(F.col("key").alias("_k"), F.lit(True).alias("anywhere_rec")).distinct()
    rows = rows.withColumn("_j", spread("label_key")).join(hint(heads), F.col("_j") == F.col("_k"), "left").drop("_j", "_k")
    rec_of = lambda k: F.coalesce(F.col(f"{k}_rec"), F.lit(False)) & F.col("label_key" if k == "anywhere" else k).isNotNull()
    boiler = F.col("outside") | reduce(or_, map(rec_of, trees)) | (
        F.col("in_section") & (rec_of("top_key") | rec_of("label_key") | rec_of("anywhere") | rec_of("leaf_key") | rec_of("slot_key"))
    )
    keep = ["page_id", "pos", "siteindex", "kind", "cmd", "level", "has_text", "is_doc", "pdf"]
    return rows.select(*keep, (boiler & ~F.col("pdf") & ~F.col("is_doc")).alias("boiler"), *carried)


def boilerplate_found(textdf: DataFrame, nlpdocs: DataFrame) -> DataFrame:
    """(page_id, pos) of the rows with non-null text outside the main body."""
    return main_body(textdf, nlpdocs).where(F.col("boiler") & F.col("has_text")).select("page_id", "pos")
