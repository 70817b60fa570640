"""Core operators of the second part: nulls, empty tables, ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, crawl, geometry


def test_no_texts_have_no_language(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "id bigint, text string")
    profiles = corpus.trigram_profiles(spark.createDataFrame([("le chat", "fr"), ("the cat", "en"), (None, "en"), ("x", None)], "text string, lang string"))
    assert corpus.detected_languages(texts, profiles, "id").count() == 0
    assert corpus.detected_languages(texts.limit(0), profiles, "id").count() == 0
    r = corpus.detected_languages(spark.createDataFrame([(7, "the cat")], "id bigint, text string"), profiles, "id").first()
    assert (r.id, r.lang) == (7, "en") and 0.5 < r.confidence <= 1


def test_suppression_of_nothing_and_of_ties(spark):
    rows = spark.createDataFrame([(None, [0.0] * 8, 0.99), (1, [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0], 0.99), (1, [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0], 0.99)], "image bigint, box array<double>, score double")
    out = geometry.suppressed(rows, min_neighbours=1).collect()
    assert [(r.image, r.score, r.box) for r in out] == [(1, 0.99, [0.0, 0, 2, 0, 2, 2, 0, 2])]
    assert geometry.suppressed(rows.limit(0)).count() == 0
    # too few neighbours: the box goes, what it took away beyond the second threshold comes back
    kept, _, _ = geometry.merged_boxes(np.array([[0.0, 0, 4, 0, 4, 4, 0, 4], [2.0, 0, 6, 0, 6, 4, 2, 4]]), np.array([0.9, 0.8]), 0.15, min_neighbours=1)
    assert len(kept) == 0


def test_upright_and_turned_overlaps_agree():
    rng = np.random.default_rng(2)
    low = rng.uniform(0, 10, (30, 2))
    high = low + rng.uniform(0.5, 6, (30, 2))
    boxes = np.stack([low[:, 0], low[:, 1], high[:, 0], low[:, 1], high[:, 0], high[:, 1], low[:, 0], high[:, 1]], axis=1)
    fast = geometry.overlap_matrix(boxes)
    slow = np.array([[geometry.polygon_iou(a.reshape(4, 2), b.reshape(4, 2)) for b in boxes] for a in boxes])
    np.fill_diagonal(slow, 1)
    assert fast == pytest.approx(slow, abs=1e-8)


def test_pipeline_without_pages(spark):
    fetched = spark.createDataFrame([(1, "http://a.org/", None, "OK", ["http://a.org/x#1", "http://a.org/x", "http://b.org/", None, ""]), (1, "http://a.org/q", 1, None, ["http://a.org/no"]), (1, "http://a.org/r", 1, "OK", None)], "siteindex int, url string, crawl_depth int, status_code string, links array<string>")
    sites = spark.createDataFrame([(1, "http://a.org/", "subdomain")], "siteindex int, rooturl string, scope string")
    known = spark.createDataFrame([], "url string")
    assert [tuple(r) for r in crawl.page_pipeline(fetched, known, sites).collect()] == [(1, "http://a.org/x", 1)]
    assert crawl.page_pipeline(fetched, known.union(spark.createDataFrame([("http://a.org/x",)], "url string")), sites).count() == 0


def test_pieces_of_nothing(spark):
    assert corpus.trained_pieces(spark.createDataFrame([], "word string, cnt bigint")).count() == 0


def test_a_cluster_without_a_shared_folder(spark, monkeypatch):
    from corpusloom.plans import session

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
    assert session.shared_folder(spark) and F is not None
