"""Page geometry and text detection post-processing on box tables.

Axis-aligned boxes are plain columns; rotated boxes, which SQL can't clip, are
NumPy over the boxes of one image, grouped by image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.session import settle

# Thresholds of the detection stages.
WORD_MIN_SCORE, WORD_NMS_IOU, CHAR_MIN_SCORE, CHAR_NMS_IOU, MIN_NEIGHBOURS = 0.95, 0.15, 0.25, 0.3, 1
NEIGHBOUR_IOU = 0.5
KEEP_SCORE, LEXICON_SCORE, OTHER_SCORE = 0.98, 0.80, 0.90

GEOMETRY_SCHEMA = (
    "tagName string, classNames string, boundingBox struct<x:int,y:int,width:int,height:int>, text string, "
    "lines array<struct<text:string,boundingBox:struct<x:int,y:int,width:int,height:int>,"
    "words:array<struct<text:string,boundingBox:struct<x:int,y:int,width:int,height:int>,"
    "letters:array<struct<char:string,boundingBox:struct<x:int,y:int,width:int,height:int>>>>>>>"
)


def intersection_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Common area of boxes (x, y, w, h)."""
    side = lambda p, n, q, m: F.greatest(F.lit(0), F.least(p + n, q + m) - F.greatest(p, q))
    return side(a[0], a[2], b[0], b[2]) * side(a[1], a[3], b[1], b[3])


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    common = intersection_area(a, b)
    return common / (a[2] * a[3] + b[2] * b[3] - common)


def union_boxes(boxes: DataFrame, *keys: str) -> DataFrame:
    """The least box around the boxes (x, y, w, h) of every key."""
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return boxes.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"))


def valid_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """(x, y, w, h) rounded; negatives become 0 and empty sides 8."""
    r = lambda c: F.floor(c + 0.5).cast("int")
    low = lambda c: F.greatest(r(c), F.lit(0))
    side = lambda c: F.when(r(c) <= 0, 8).otherwise(r(c))
    return F.struct(low(x).alias("x"), low(y).alias("y"), side(w).alias("w"), side(h).alias("h"))


def inside(box: tuple[Column, ...], clip: tuple[Column, ...]) -> Column:
    x, y, w, h = box
    cx, cy, cw, ch = (F.floor(c) for c in clip)
    return (x >= cx) & (y >= cy) & (x + w <= cx + cw) & (y + h <= cy + ch)


def is_icon_free(text: Column) -> Column:
    """Only characters of the two printable Latin ranges."""
    return text.rlike(r"^[\x20-\x7f\xa0-\xff]*$")


def trimmed_letters(letters: DataFrame) -> DataFrame:
    """letters(word_id, pos, x, w, ...): a letter that runs into the next is cut where that begins."""
    following = F.lead("x").over(Window.partitionBy("word_id").orderBy("pos", "x", "w"))
    return letters.withColumn("w", F.when(F.col("x") + F.col("w") - 1 > following, following - F.col("x") + 1).otherwise(F.col("w")))


def segmented_lines(words: DataFrame) -> DataFrame:
    """(block_id, line_no, pos): words(block_id, pos, y, h) cut into lines; a word opens a line if it lies below the
    middle of the line so far, whose box grows with every word.

    The fold depends on its own result, so it runs over the ordered array of a block's words."""
    rows = words.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("pos", "y", "h"))).alias("ws"))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("b"), F.array().cast("array<struct<pos:bigint,line_no:int>>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        y, bottom = w["y"].cast("double"), (w["y"] + w["h"]).cast("double")
        new = s["y"].isNull() | (y > s["y"] + (s["b"] - s["y"]) / 2)
        n = s["n"] + new.cast("int")
        return F.struct(
            n.alias("n"),
            F.when(new, y).otherwise(F.least(s["y"], y)).alias("y"),
            F.when(new, bottom).otherwise(F.greatest(s["b"], bottom)).alias("b"),
            F.concat(s["out"], F.array(F.struct(w["pos"].cast("bigint").alias("pos"), n.alias("line_no")))).alias("out"),
        )

    lines = F.aggregate("ws", start, step, lambda s: s["out"])
    return rows.select("block_id", F.inline(lines))


def line_texts(words: DataFrame, lines: DataFrame) -> DataFrame:
    """(block_id, line_no, text): the words of every line in order, with spaces."""
    rows = words.join(lines, ["block_id", "pos"])
    return rows.groupBy("block_id", "line_no").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "text")))["text"], " ").alias("text"))


def chars_to_words(chars: DataFrame, words: DataFrame) -> DataFrame:
    """(image, char_id, word_id, overlap): every character box with the word box of its image it overlaps most.

    Only boxes of an image meet, and of these only those whose grid cells touch; ties go to the least word."""
    cell = 64
    cells = lambda df: df.withColumn(
        "cell",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.floor(F.col("x") / cell), F.floor((F.col("x") + F.col("w")) / cell)),
                    lambda i: F.transform(F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.col("h")) / cell)), lambda j: i * 1_000_000 + j),
                )
            )
        ),
    )
    c = cells(chars).select("image", "cell", "char_id", *(F.col(k).alias(f"c{k}") for k in "xywh"))
    w = cells(words).select("image", "cell", "word_id", *(F.col(k).alias(f"w{k}") for k in "xywh"))
    score = iou(tuple(F.col(f"c{k}") for k in "xywh"), tuple(F.col(f"w{k}") for k in "xywh"))
    pairs = c.join(w, ["image", "cell"]).withColumn("overlap", score).where(F.col("overlap") > 0)
    best = pairs.groupBy("image", "char_id").agg(F.max(F.struct("overlap", (-F.col("word_id")).alias("m"))).alias("b"))
    return best.select("image", "char_id", (-F.col("b.m")).alias("word_id"), F.col("b.overlap").alias("overlap"))


def decoded_words(chars: DataFrame, assigned: DataFrame, alphabet: str) -> DataFrame:
    """(image, word_id, text, score): characters in order of x, each the class of the greatest score in the alphabet, and their mean greatest score."""
    rows = chars.join(assigned, ["image", "char_id"])
    top = F.array_max("scores")
    rows = rows.select("image", "word_id", "x", "char_id", top.alias("top"), F.array_position("scores", top).alias("cls"))
    letters = F.sort_array(F.collect_list(F.struct("x", "char_id", "cls")))
    text = F.array_join(F.transform(letters, lambda s: F.substring(F.lit(alphabet), s["cls"].cast("int"), F.lit(1))), "")
    return rows.groupBy("image", "word_id").agg(text.alias("text"), F.avg("top").alias("score"))


def kept_words(words: DataFrame) -> DataFrame:
    """words(text, score, nearest, distance) worth keeping, corrected where the lexicon is near."""
    alpha = F.col("text").rlike(r"^\p{L}+$")
    near = F.coalesce(F.col("distance") <= 1, F.lit(False))
    keep = F.when(F.length("text") < 3, F.lit(False)).when(
        alpha, (F.col("score") >= KEEP_SCORE) | ((F.col("score") >= LEXICON_SCORE) & near)
    ).otherwise(F.col("score") >= OTHER_SCORE)
    fixed = F.when(alpha & (F.col("score") < KEEP_SCORE) & (F.col("distance") > 0), F.upper("nearest")).otherwise(F.col("text"))
    return words.where(keep).withColumn("text", fixed)


def rotated(cx: Column, cy: Column, x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """A point turned by an angle around a centre."""
    dx, dy = x - cx, y - cy
    return cx + dx * F.cos(angle) - dy * F.sin(angle), cy + dx * F.sin(angle) + dy * F.cos(angle)


# rotated boxes of one image


def polygon_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return 0.5 * abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))))


def clipped_polygon(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """The part of a convex polygon inside another, edge by edge."""
    if np.dot(clip[:, 0], np.roll(clip[:, 1], -1)) < np.dot(clip[:, 1], np.roll(clip[:, 0], -1)):
        clip = clip[::-1]
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0)):
        if len(out) == 0:
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        points = []
        for p, q, s, t in zip(out, np.roll(out, -1, axis=0), side, np.roll(side, -1)):
            if s >= 0:
                points.append(p)
            if s * t < 0:
                points.append(p + (q - p) * (s / (s - t)))
        out = np.array(points).reshape(-1, 2)
    return out


def polygon_iou(a: np.ndarray, b: np.ndarray) -> float:
    common = clipped_polygon(a, b)
    area = polygon_area(common) if len(common) >= 3 else 0.0
    whole = polygon_area(a) + polygon_area(b) - area
    return area / whole if whole > 0 else 0.0


def overlap_matrix(boxes: np.ndarray) -> np.ndarray:
    """The IoU of all pairs of boxes (8 corner coordinates each): of upright ones by their sides, of others by clipping those whose bounds touch."""
    p = boxes.reshape(-1, 4, 2)
    low, high = p.min(axis=1), p.max(axis=1)
    sides = np.maximum(np.minimum(high[:, None], high[None]) - np.maximum(low[:, None], low[None]), 0)
    common, area = sides.prod(axis=2), (high - low).prod(axis=1)
    whole = area[:, None] + area[None] - common
    out = np.divide(common, whole, out=np.zeros_like(common), where=whole > 0)
    upright = ((p == low[:, None]) | (p == high[:, None])).all(axis=(1, 2))
    turned = np.triu((common > 0) & ~(upright[:, None] & upright[None]), 1)
    for i, j in zip(*np.nonzero(turned)):
        out[i, j] = out[j, i] = polygon_iou(p[i], p[j])
    return np.round(out, 9)


def merged_boxes(
    boxes: np.ndarray, scores: np.ndarray, iou_threshold: float, min_neighbours: int = 0, neighbour_threshold: float = NEIGHBOUR_IOU, min_score: float = 0.0, classes: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boxes, scores, class scores) after non-maximum suppression, best first.

    A kept box takes away all worse ones that overlap it by more than the threshold, and is the mean of itself and
    its neighbours, those beyond the second threshold, weighted by score above the minimum; class scores likewise.
    A box with too few neighbours goes itself and gives them back, but not what it took away besides."""
    overlap, order = overlap_matrix(boxes), np.argsort(-scores, kind="stable")
    place = np.argsort(order)
    gone = np.zeros(len(scores), bool)
    kept: list[tuple[int, np.ndarray]] = []
    for i in order:
        if gone[i]:
            continue
        later = ~gone & (place > place[i])
        near = later & (overlap[i] > neighbour_threshold)
        gone |= later & (overlap[i] > iou_threshold)
        if near.sum() < min_neighbours:
            gone[near] = False
        else:
            near[i] = True
            w = scores * near - min_score * near
            kept.append((i, w / w.sum() if w.sum() > 0 else near / near.sum()))
    at = np.array([i for i, _ in kept], np.int64)
    weights = np.array([w for _, w in kept]).reshape(len(kept), len(scores))
    return weights @ boxes.reshape(len(scores), 8), scores[at], weights @ (classes if classes is not None else np.zeros((len(scores), 0)))


def suppressed(detections: DataFrame, iou_threshold: float = WORD_NMS_IOU, min_score: float = WORD_MIN_SCORE, min_neighbours: int = MIN_NEIGHBOURS) -> DataFrame:
    """(image, box, score, classes) of detections(image, box array<double> of 8, score[, classes array<double>]) above a
    score after suppression, image by image; an image's boxes are bounded by its cells."""
    if "classes" not in detections.columns:
        detections = detections.withColumn("classes", F.array().cast("array<double>"))

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        boxes, scores = np.array(pdf["box"].tolist(), float).reshape(-1, 8), pdf["score"].to_numpy(float)
        classes = np.array(pdf["classes"].tolist(), float).reshape(len(boxes), -1)
        images = pdf["image"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], images[1:] != images[:-1], [True]]))
        out: list[tuple] = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            order = a + np.lexsort((*boxes[a:b].T[::-1], -scores[a:b]))  # the same result whatever order the rows come in
            kept = merged_boxes(boxes[order], scores[order], iou_threshold, min_neighbours, classes=classes[order])
            out += [(images[a], x.tolist(), float(y), z.tolist()) for x, y, z in zip(*kept)]
        return pd.DataFrame(out, columns=["image", "box", "score", "classes"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None or held.empty else pd.concat([held, pdf], ignore_index=True)
            whole = pdf["image"] != pdf["image"].iloc[-1] if len(pdf) else pd.Series([], dtype=bool)  # the last image may go on
            if whole.any():
                yield merged(pdf[whole])
            held = pdf[~whole]
        if held is not None and len(held):
            yield merged(held)

    rows = detections.where((F.col("score") > min_score) & F.col("image").isNotNull()).select("image", "box", "score", "classes")
    rows = rows.repartition("image").sortWithinPartitions("image")  # many small images: no call for each
    return rows.mapInPandas(run, "image long, box array<double>, score double, classes array<double>")


def polygon_overlaps(left: DataFrame, right: DataFrame, cell: int = 64) -> DataFrame:
    """(image, left_id, right_id, overlap): the IoU of convex boxes(image, id, box array<double> of 8) that overlap at all.

    Only boxes of an image whose bounds share a grid cell meet; each pair is clipped once, in Arrow batches."""

    def cells(df: DataFrame, name: str) -> DataFrame:
        side = lambda k: F.transform(F.array(*(F.lit(k + 2 * i) for i in range(4))), lambda i: F.get(F.col("box"), i))
        span = lambda k: F.sequence(F.floor(F.array_min(side(k)) / cell), F.floor(F.array_max(side(k)) / cell))
        out = df.select("image", F.col("id").alias(f"{name}_id"), F.col("box").alias(f"{name}_box"), F.explode(span(0)).alias("cx"), span(1).alias("ys"))
        return out.select("image", f"{name}_id", f"{name}_box", "cx", F.explode("ys").alias("cy"))

    pairs = cells(left, "left").join(cells(right, "right"), ["image", "cx", "cy"]).groupBy("image", "left_id", "right_id").agg(F.first("left_box").alias("a"), F.first("right_box").alias("b"))

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([polygon_iou(np.asarray(x, float).reshape(-1, 2), np.asarray(y, float).reshape(-1, 2)) for x, y in zip(a, b)], dtype=float)

    return pairs.select("image", "left_id", "right_id", score("a", "b").alias("overlap")).where("overlap > 0")


def detection_line(box: Column, text: Column) -> Column:
    return F.concat(F.array_join(F.transform(box, lambda v: F.round(v).cast("int").cast("string")), ","), F.lit(","), text)


def flattened_boxes(pages: DataFrame) -> DataFrame:
    """(page_id, level, text, x, y, w, h) of pages(page_id, json): blocks, lines, words and letters of every element."""
    e = pages.select("page_id", F.from_json("json", GEOMETRY_SCHEMA).alias("e"))
    box = lambda b: [F.col(f"{b}.x").alias("x"), F.col(f"{b}.y").alias("y"), F.col(f"{b}.width").alias("w"), F.col(f"{b}.height").alias("h")]
    lines = e.select("page_id", F.explode("e.lines").alias("l"))
    words = lines.select("page_id", F.explode("l.words").alias("l"))
    letters = words.select("page_id", F.explode("l.letters").alias("l"))
    level = lambda df, name, text, b: df.select("page_id", F.lit(name).alias("level"), F.col(text).alias("text"), *box(b))
    parts = [level(e, "block", "e.text", "e.boundingBox"), level(lines, "line", "l.text", "l.boundingBox"), level(words, "word", "l.text", "l.boundingBox"), level(letters, "char", "l.char", "l.boundingBox")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def capture_quality(files: DataFrame) -> DataFrame:
    """(capture, files, valid): a capture of files(name, size, width, height, error_page) is whole with its three
    parts, none of them empty or of an error page, and all of one size."""
    n = lambda ending: F.count_if(F.col("name").endswith(ending))
    g = files.groupBy(F.substring("name", 1, 5).alias("capture")).agg(
        F.count(F.lit(1)).alias("files"),
        (
            (F.count(F.lit(1)) >= 3) & (n(".json") > 0) & (n("_screen.png") > 0) & (n("_boxes.png") > 0) & (F.min("size") > 0)
            & (F.count_if(F.col("error_page")) == 0) & (F.coalesce(F.max("width") == F.min("width"), F.lit(True))) & (F.coalesce(F.max("height") == F.min("height"), F.lit(True)))
        ).alias("valid"),
    )
    return g


def clipped_point(x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """A point rounded (halves to even) and kept inside the image."""
    keep = lambda c, n: F.least(F.greatest(F.bround(c), F.lit(0)), F.lit(n - 1)).cast("int")
    return keep(x, width), keep(y, height)


def resized(width: Column, height: Column, longest: int, multiple: int) -> tuple[Column, Column]:
    """Width and height scaled so that the longer is ``longest``, both to a multiple."""
    scale = F.lit(float(longest)) / F.greatest(width, height)
    to = lambda c: (F.round(c * scale / multiple) * multiple).cast("int")
    return to(width), to(height)


def viewport_width(draw: Column, shares: list[tuple[int, float]]) -> Column:
    """The width for a draw in [0, 100) by the widths' shares in percent, in their order; the last for the rest."""
    out, below = None, 0.0
    for width, share in shares:
        below += share
        out = F.when(draw < below, width) if out is None else out.when(draw < below, width)
    return out.otherwise(shares[-1][0])


def input_label(placeholder: Column, value: Column, kind: Column) -> Column:
    """What a form input shows: its placeholder, else its value; buttons show their value."""
    text = F.nullif(F.trim(value), F.lit(""))
    return F.when(F.lower(kind).isin("submit", "button"), text).otherwise(F.coalesce(F.nullif(placeholder, F.lit("")), text))


def pruned_tree(nodes: DataFrame) -> DataFrame:
    """nodes(page_id, node_id, parent_id, text) without those that have no text and one child; children move up.

    A kept node's parent is its nearest kept ancestor: the pruned chains are followed by doubling, a round each."""
    children = nodes.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    marked = nodes.join(children, ["page_id", "node_id"], "left")
    drop = (F.coalesce("children", F.lit(0)) == 1) & (F.coalesce(F.trim("text"), F.lit("")) == "") & F.col("parent_id").isNotNull()
    marked = marked.withColumn("dropped", drop).select("page_id", "node_id", "parent_id", "text", "dropped")
    marked = settle(marked)
    up = marked.where("dropped").select("page_id", F.col("node_id").alias("via"), F.col("parent_id").alias("above"))
    while not up.isEmpty():
        moves = up.select("page_id", F.col("via").alias("parent_id"), "above")
        step = marked.join(moves, ["page_id", "parent_id"], "left").select("page_id", "node_id", F.coalesce("above", "parent_id").alias("parent_id"), "text", "dropped")
        twice = up.withColumnRenamed("above", "middle").join(up.select("page_id", F.col("via").alias("middle"), "above"), ["page_id", "middle"])
        marked = settle(step)
        up = settle(twice.select("page_id", "via", "above"))
    return marked.where("NOT dropped").drop("dropped")


def dense_boxes(maps: DataFrame, stride: int = 4, min_score: float = WORD_MIN_SCORE) -> DataFrame:
    """(image, box, score) of dense maps(image, width, scores, geometry): every cell above the minimum is a box turned by its angle.

    geometry has for each cell the distances to the box's top, right, bottom and left side, and the angle."""
    cells = maps.select("image", "width", F.posexplode(F.arrays_zip("scores", "geometry")).alias("at", "c")).where(F.col("c.scores") > min_score)
    cx, cy = (F.col("at") % F.col("width")) * stride, F.floor(F.col("at") / F.col("width")) * stride
    top, right, bottom, left, angle = (F.col("c.geometry")[i] for i in range(5))
    corners = ((-left, -top), (right, -top), (right, bottom), (-left, bottom))
    points = [v for dx, dy in corners for v in rotated(cx, cy, cx + dx, cy + dy, angle)]
    return cells.select("image", F.array(*(p.cast("double") for p in points)).alias("box"), F.col("c.scores").cast("double").alias("score"))


def softened_scores(boxes: np.ndarray, scores: np.ndarray, sigma: float = 0.5, min_score: float = 0.001) -> np.ndarray:
    """Soft suppression: a box's score falls with its overlap with better boxes instead of going at once."""
    scores, left = scores.astype(float).copy(), set(range(len(scores)))
    while left:
        best = max(left, key=lambda i: (scores[i], -i))
        left.discard(best)
        for j in list(left):
            o = polygon_iou(boxes[best].reshape(-1, 2), boxes[j].reshape(-1, 2))
            scores[j] *= float(np.exp(-o * o / sigma))
            if scores[j] < min_score:
                left.discard(j)
    return scores


def next_capture(files: DataFrame) -> DataFrame:
    """(number): the number of the next capture, one above that of the last file name of files(name); 1 if there is none."""
    return files.agg((F.coalesce(F.substring(F.max("name"), 1, 5).try_cast("int"), F.lit(0)) + 1).alias("number"))


PAGE_TREE_SCHEMA = "node_id bigint, parent_id bigint, tagName string, text string, before string, after string, display string, visibility string, opacity double, x int, y int, width int, height int"


def page_tree(pages: DataFrame, width: int, height: int) -> DataFrame:
    """Nodes of recorded pages(page_id, json: an array of PAGE_TREE_SCHEMA objects) with their chain of parents, the text
    with what ::before and ::after add, and whether they can be seen: display, visibility and opacity of the node and of all
    above it, a box, and some of it inside the view.  Chains are followed by doubling, a round each."""
    nodes = pages.select("page_id", F.inline(F.from_json("json", f"array<struct<{PAGE_TREE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")))
    shown = (F.coalesce("display", F.lit("block")) != "none") & (F.coalesce("opacity", F.lit(1.0)) > 0)
    box = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("x") < width) & (F.col("y") < height) & (F.col("x") + F.col("width") > 0) & (F.col("y") + F.col("height") > 0)
    nodes = settle(nodes.withColumn("text", F.concat_ws("", "before", "text", "after")).withColumn("shown", shown).withColumn("own", box & (F.coalesce("visibility", F.lit("visible")) == "visible")))
    up = nodes.select("page_id", "node_id", F.col("parent_id").alias("to"), F.array("parent_id").alias("chain"), "shown")
    up = settle(up.withColumn("chain", F.filter("chain", lambda x: x.isNotNull())))
    while not up.where("to IS NOT NULL").isEmpty():
        above = up.select("page_id", F.col("node_id").alias("to"), F.col("to").alias("to2"), F.col("chain").alias("chain2"), F.col("shown").alias("shown2"))
        step = up.join(above, ["page_id", "to"], "left")
        up = settle(step.select("page_id", "node_id", F.col("to2").alias("to"), F.concat("chain", F.coalesce("chain2", F.array().cast("array<bigint>"))).alias("chain"), (F.col("shown") & F.coalesce("shown2", F.lit(True))).alias("shown")))
    rows = nodes.drop("shown").join(up.select("page_id", "node_id", "chain", "shown"), ["page_id", "node_id"])
    return rows.select("page_id", "node_id", "tagName", "text", F.col("chain").alias("parents"), (F.col("shown") & F.col("own")).alias("visible"))
