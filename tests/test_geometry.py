import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import geometry as g


def square(x, y, s=2.0):
    return np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)


@pytest.mark.parametrize(("dx", "expected"), [(0, 1.0), (1, 1 / 3), (2, 0.0), (5, 0.0)])
def test_polygon_iou(dx, expected):
    assert g.polygon_iou(square(0, 0), square(dx, 0)) == pytest.approx(expected)


def test_rotated_squares():
    a = np.pi / 4
    r = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    s = square(-1, -1)
    assert g.polygon_iou(s, s @ r.T) == pytest.approx(0.7071, abs=1e-3)


def test_suppression_merges_neighbours_and_drops_loners(spark):
    rows = [(1, square(0, 0).ravel().tolist(), 0.99), (1, square(0.2, 0).ravel().tolist(), 0.97), (1, square(9, 9).ravel().tolist(), 0.98)]
    out = g.suppressed(spark.createDataFrame(rows, "image long, box array<double>, score double")).collect()
    assert len(out) == 1 and 0 < out[0].box[0] < 0.2


def test_lines(spark):
    words = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 4, 10), (1, 2, 20, 10)], "block_id long, pos int, y int, h int")
    assert [r.line_no for r in g.segmented_lines(words).orderBy("pos").collect()] == [1, 1, 2]


def test_word_filter(spark):
    rows = [("ab", 1.0, None, None), ("word", 0.85, "word", 0), ("wird", 0.85, "word", 1), ("wxyz", 0.85, "word", 3), ("a-1", 0.95, None, None)]
    out = g.kept_words(spark.createDataFrame(rows, "text string, score double, nearest string, distance int"))
    assert sorted(r.text for r in out.collect()) == ["WORD", "a-1", "word"]


def test_geometry_json(spark):
    json = '{"text":"b","boundingBox":{"x":1,"y":2,"width":3,"height":4},"lines":[{"text":"l","boundingBox":{"x":1,"y":2,"width":3,"height":4},"words":[{"text":"w","boundingBox":{"x":1,"y":2,"width":3,"height":4},"letters":[{"char":"w","boundingBox":{"x":1,"y":2,"width":1,"height":4}}]}]}]}'
    out = g.flattened_boxes(spark.createDataFrame([(1, json), (2, None)], "page_id long, json string")).collect()
    assert sorted(r.level for r in out if r.page_id == 1) == ["block", "char", "line", "word"]


def test_box_columns(spark):
    r = spark.range(1).select(g.valid_box(F.lit(-1.0), F.lit(2.5), F.lit(0.0), F.lit(3.4)).alias("b")).first().b
    assert tuple(r) == (0, 3, 8, 3)


def test_pruned_tree(spark):
    rows = [(1, 1, None, None), (1, 2, 1, ""), (1, 3, 2, None), (1, 4, 3, "a"), (1, 5, 3, "b")]
    out = g.pruned_tree(spark.createDataFrame(rows, "page_id long, node_id long, parent_id long, text string"))
    assert sorted((r.node_id, r.parent_id or 0) for r in out.collect()) == [(1, 0), (3, 1), (4, 3), (5, 3)]


def test_dense_boxes(spark):
    maps = spark.createDataFrame([(7, 2, [0.1, 0.99], [[0.0] * 5, [1.0, 2.0, 3.0, 4.0, 0.0]])], "image long, width int, scores array<double>, geometry array<array<double>>")
    r = g.dense_boxes(maps).collect()
    assert len(r) == 1 and r[0].box == [0.0, -1.0, 6.0, -1.0, 6.0, 3.0, 0.0, 3.0]


def test_class_scores_and_soft_suppression():
    boxes = np.stack([square(0, 0).ravel(), square(0.1, 0).ravel(), square(9, 9).ravel()])
    kept, scores, classes = g.merged_boxes(boxes, np.array([0.9, 0.8, 0.7]), 0.3, classes=np.eye(3))
    assert len(kept) == 2 and classes[0].sum() == pytest.approx(1.0) and scores[0] == 0.9
    soft = g.softened_scores(boxes, np.array([0.9, 0.8, 0.7]))
    assert soft[0] == 0.9 and soft[1] < 0.3 and soft[2] == pytest.approx(0.7)


def test_labels_and_viewports(spark):
    df = spark.createDataFrame([("p", "v", "text"), ("", " v ", "text"), ("p", "v", "submit")], "a string, b string, c string")
    assert [r[0] for r in df.select(g.input_label(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["p", "v", "v"]
    r = spark.range(1).select(g.viewport_width(F.lit(55.0), [(1920, 50.0), (1366, 30.0), (1280, 20.0)]).alias("w")).first()
    assert r.w == 1366


def test_characters_to_corrected_words(spark):
    words = spark.createDataFrame([(1, 10, 0, 0, 40, 10), (1, 11, 100, 0, 40, 10)], "image long, word_id long, x long, y long, w long, h long")
    letters = [(1, i, x, 0, 8, 10, [1.0 if c == a else 0.1 for a in "CAT"]) for i, (x, c) in enumerate([(22, "T"), (2, "C"), (12, "A"), (105, "A"), (300, "C")])]
    chars = spark.createDataFrame(letters, "image long, char_id long, x long, y long, w long, h long, scores array<double>")
    assigned = g.chars_to_words(chars, words)
    got = {r.word_id: (r.text, r.score) for r in g.decoded_words(chars, assigned, "CAT").collect()}
    assert got == {10: ("CAT", 1.0), 11: ("A", 1.0)}
