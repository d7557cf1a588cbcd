"""Vector search by blocks and planned hybrid search, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import lexical as L
from lumenframe.operators import planned as P
from lumenframe.operators import vectors as Q


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize(("block", "cells", "least"), [(4096, 4_000_000, None), (3, 20, None), (4096, 7, 0.4)])
def test_vector_search(spark, monkeypatch, metric, block, cells, least):
    """Any block size gives the same rows, ties by row, also where a task has fewer rows than k."""
    monkeypatch.setattr(Q, "CELLS", cells)
    rng = np.random.default_rng(2)
    m = rng.integers(-3, 4, (120, 5)) / 4  # many ties
    asked = rng.integers(-3, 4, (8, 5)) / 4
    vectors = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(m)], "row long, embedding array<float>").repartition(7)
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(asked)], "query_id string, query array<double>")
    got = {(r.query_id, r["rank"]): (r.row, r.score) for r in Q.search(vectors, queries, 10, metric, least, block).collect()}
    want = {}
    for i, q in enumerate(asked):
        s = m @ q if metric == "ip" else ((m - q) ** 2).sum(1)
        able = [j for j in range(len(m)) if least is None or round(s[j], 6) >= least]
        for rank, j in enumerate(sorted(able, key=lambda j: (-s[j] if metric == "ip" else s[j], j))[:10], 1):
            want[f"q{i}", rank] = (j, pytest.approx(s[j]))
    assert got == want


def test_vector_search_of_nothing(spark):
    none = spark.createDataFrame([], "row long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>")
    assert Q.search(none, q, 3).count() == 0
    assert Q.search(none, q.limit(0), 3).count() == 0


PLAN = "query_id long, modality string, variant string, weight double, in_scope boolean, text string, vector array<float>"
FRAMES = [(1, "v1", 0.0, "a man walks his dog"), (2, "v1", 1.0, "the dog sleeps by the fire"), (3, "v2", 0.0, "a red boat on the river"), (4, "v2", 5.0, "walking the dog, walking home"), (5, "v3", 0.0, None)]


@pytest.fixture(scope="module")
def world(spark):
    frames = spark.createDataFrame(FRAMES, "frame_id long, video_id string, ts double, text string")
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(1, 6)], "row long, embedding array<float>")
    return frames, {"caption": (L.postings(frames, text="text"), L.stats(frames, "text"), frames)}, vectors


def search(spark, world, rows, **more):
    frames, indexes, vectors = world
    found, skipped = P.planned_search(spark.createDataFrame(rows, PLAN), frames, indexes, vectors, **more)
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r)
    return out, {(r.query_id, r.modality, r.variant): r.reason for r in skipped.collect()}


def test_queries_do_not_mix(spark, world):
    """A query's answer is the same alone and beside others."""
    rows = [(q, "caption", v, w, True, t, None) for q, v, w, t in ((7, "original", 1.0, "dog walks"), (7, "p1", 0.5, "boat"), (8, "original", 1.0, "a red boat"), (9, "original", 1.0, "nothing here matches"))]
    both, _ = search(spark, world, rows)
    for q in (7, 8):
        alone, _ = search(spark, world, [r for r in rows if r[0] == q])
        assert [tuple(r) for r in both[q]] == [tuple(r) for r in alone[q]]
    assert both[7][0].frame_id == 4 and both[8][0].frame_id == 3 and 9 not in both
    assert {r.frame_id for r in both[7]} == {1, 2, 3, 4}  # the paraphrase brings the boat


def test_skipped_branches(spark, world):
    rows = [(1, "caption", "original", 1.0, True, "dog", None), (1, "ocr", "original", 1.0, True, "dog", None), (1, "objects", "original", 1.0, False, "dog", None), (2, "caption", "original", 1.0, True, " ?! ", None), (2, "caption", "p1", 1.0, None, "dog", None), (3, "caption", "original", 1.0, True, None, None)]
    found, skipped = search(spark, world, rows)
    assert list(found) == [1]
    assert skipped == {(1, "ocr", "original"): "engine_unavailable", (1, "objects", "original"): "outside_modality_scope", (2, "caption", "original"): "no_reliable_modality_terms", (2, "caption", "p1"): "outside_modality_scope", (3, "caption", "original"): "no_reliable_modality_terms"}


def test_phrase_counts(spark, world):
    frames, (postings, sizes, texts) = world[0], world[1]["caption"]
    told, _ = P.branches(spark.createDataFrame([(1, "caption", "original", 1.0, True, "walks dog", None), (2, "caption", "original", 1.0, True, "home dog walks", None)], PLAN), ["caption"])
    got = {(r.query_id, r.frame_id): r.score for r in P.text_hits(told, postings, sizes, texts, 10).collect()}
    # both hold dog and walk; "walking the dog" reads "walk dog" without function words, "walks his dog" too
    assert got[1, 1] > 0.9 * 0.5 and got[1, 4] - got[1, 2] > 0.1
    alone = {(r.query_id, r.frame_id): r.score for r in P.text_hits(told.where("query_id = 2"), postings, sizes, texts.where("false"), 10).collect()}
    assert got[2, 4] == alone[2, 4]  # its words stand in another order there


def test_variants_are_capped(spark):
    frames = spark.createDataFrame([(i, "v", float(i)) for i in range(4)], "frame_id long, video_id string, ts double")
    hits = [(1, "caption", "original", 1.0, 0, 0.9, 1), *[(1, "caption", f"p{k}", 1.0, f, 0.5, f) for k in range(5) for f in (1, 2)]]
    rows = {r.frame_id: r for r in P.fused_variants(spark.createDataFrame(hits, "query_id long, modality string, variant string, weight double, frame_id long, score double, rank int"), frames, 0.5).collect()}
    assert rows[0].intra == pytest.approx(1 / 61, abs=1e-9) and rows[1].intra == pytest.approx(0.5 / 61, abs=1e-9) == rows[2].intra
    assert [rows[f]["rank"] for f in (0, 1, 2)] == [1, 2, 3]


def test_vectors_and_hints(spark, world):
    rows = [(1, "visual", "original", 1.0, True, None, [0.0, 1.0]), (1, "caption", "original", 1.0, True, "boat", None)]
    found, _ = search(spark, world, rows, top_k=3)
    assert len(found[1]) == 3 and found[1][0].rrf >= 0.55 / 66
    hinted, _ = search(spark, world, rows, hints=spark.createDataFrame([(1, "caption")], "query_id long, modality string"))
    boat = lambda d: next(r for r in d[1] if r.frame_id == 3)
    all_, _ = search(spark, world, rows)
    assert boat(hinted).rrf - boat(all_).rrf == pytest.approx(0.5 * 0.2 / 61, abs=1e-9)
    assert boat(hinted).score == boat(all_).score
