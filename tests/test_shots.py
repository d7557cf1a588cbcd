"""Shots, candidates, absolute support and repeated vectors, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import selection as P
from lumenframe.operators import sequences as S
from lumenframe.operators import shots as T

SHOT = "video_id string, shot_index int, start_frame long, end_frame long, frame_count long"


def test_scenes_become_disjoint_shots(spark):
    rng = random.Random(2)
    scenes = [(f"v{rng.randrange(4)}", s := rng.randint(-30, 320), s + rng.randint(-2, 60)) for _ in range(120)] + [("out", 400, 500), ("out", -9, -1)]
    videos = [(f"v{i}", 300) for i in range(5)] + [("out", 300)]
    got = {}
    for r in T.scenes_to_shots(spark.createDataFrame(scenes, "video_id string, start_frame int, end_frame int"), spark.createDataFrame(videos, "video_id string, frame_count int")).orderBy("video_id", "shot_index").collect():
        got.setdefault(r.video_id, []).append((r.shot_index, r.start_frame, r.end_frame))
    want = {}
    for v, n in videos:
        before, out = -1, []
        for s, e in sorted((max(0, s), min(n - 1, e)) for w, s, e in scenes if w == v and e >= 0 and s <= n - 1 and max(0, s) <= min(n - 1, e)):
            s = max(s, before + 1)
            if s <= e:
                out.append((len(out) + 1, s, e))
                before = e
        want[v] = out or [(1, 0, n - 1)]
    assert got == want
    T.validated(T.scenes_to_shots(spark.createDataFrame(scenes, "video_id string, start_frame int, end_frame int"), spark.createDataFrame(videos, "video_id string, frame_count int"))).collect()


@pytest.mark.parametrize(
    ("rows", "match"),
    [
        ([("v", -1, 0, 5, 9)], "negative number in shot v/-1"), ([("v", 1, 5, 4, 9)], "end before start in shot v/1"), ([("v", 1, 0, 9, 9)], "end beyond the video in shot v/1"),
        ([("v", 1, 0, 2, 9), ("v", 1, 4, 5, 9)], "duplicate shot_index: v/1"), ([("v", 1, 0, 4, 9), ("v", 2, 4, 5, 9)], "shots overlap: v/2 starts at 4 before 4"), ([("v", 1, 0, 8, 9), ("v", 2, 2, 3, 9), ("v", 3, 5, 6, 9)], "shots overlap"),
    ],
)
def test_bad_shots_are_rejected(spark, rows, match):
    with pytest.raises(Exception, match=match):
        T.validated(spark.createDataFrame(rows, SHOT)).collect()


@pytest.mark.parametrize(("fps", "interval", "guard", "tiny"), [(25.0, 0.5, 0.1, 0.3), (10.0, 0.05, 0.0, 0.0), (3.0, 0.5, 0.4, 1.0), (30.0, 0.35, 0.25, 0.2)])
def test_candidates(spark, fps, interval, guard, tiny):
    rng = random.Random(int(fps))
    shots, at = [], 0
    for k in range(40):
        n = rng.choice([1, 2, 3, 5, 8, 20, 80])
        shots.append(("v" if k < 30 else "w", k, at, at + n - 1, 10**6))
        at += n
    want = {}
    for v, k, s, e, _ in shots:
        inset = round(guard * fps)
        a, z = min(e, s + inset), max(s, e - inset)
        put = lambda f, r, v=v, s=s, e=e: want.setdefault((v, max(s, min(f, e))), set()).add(r)
        if (e - s + 1) / fps <= tiny + 1e-12 or a >= z:
            put(s + (e - s) // 2, "tiny_shot_midpoint")
        else:
            step = interval * fps
            for i in range(e - s + 1 if step <= 1 else math.floor((e - s) / step + 1e-12) + 1):
                put(s + (i if step <= 1 else round(i * step)), "dense_interval")
            put(a, "shot_boundary_start")
            put(z, "shot_boundary_end")
    for v in ("v", "w"):
        own = [x for x in shots if x[0] == v]
        want.setdefault((v, own[0][2]), set()).add("video_start")
        want.setdefault((v, own[-1][3]), set()).add("video_end")
    got = T.candidates(spark.createDataFrame(shots, SHOT), F.lit(fps), interval, guard, tiny, True).collect()
    assert {(r.video_id, r.frame_index): r.reasons for r in got} == {k: sorted(v, key=T.REASONS.index) for k, v in want.items()}
    by = {x[1]: x for x in shots}
    assert all(by[r.shot_index][2] <= r.frame_index <= by[r.shot_index][3] and r.timestamp == r.frame_index / fps and r.shot_end == (by[r.shot_index][3] + 1) / fps and r.candidate_id == f"CANDIDATE_{r.video_id}_{r.frame_index:09d}" for r in got)


def test_absolute_support(spark):
    cases = [({"visual": 0.15}, 0.0, True), ({"visual": 0.1, "dense_text": 0.6}, 0.0, True), ({"visual": 0.1, "dense_text": 0.5}, 0.9, False), ({"bge_dense": 0.55}, 0.0, True), ({"caption": 0.9}, 0.14, False), ({"caption": 0.9}, 0.15, True), ({}, None, False)]
    df = spark.createDataFrame([(i, m, s) for i, (m, s, _) in enumerate(cases)], "i int, m map<string,double>, s double")
    assert [r.x for r in df.select("i", S.absolute_support(F.col("m"), F.col("s")).alias("x")).orderBy("i").collect()] == [w for *_, w in cases]


def test_vector_repeats(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 3))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ts = np.cumsum(rng.choice([0, 0.5, 1, 9], 300))
    rows = [(f"v{i % 2}", i, float(ts[i]), [float(x) for x in m[i]]) for i in range(300)]
    got = {r.frame_id: (r.repeat_of, r.similarity) for r in P.vector_repeats(spark.createDataFrame(rows, "video_id string, frame_id long, ts double, embedding array<double>"), 5.0, 0.9).collect()}
    want = {}
    for v in ("v0", "v1"):
        kept = []
        for _, i, t, e in (r for r in rows if r[0] == v):
            near = [(np.dot(m[k], e), -n, k) for n, k in enumerate(kept) if t - ts[k] <= 5]
            best = max(near, default=(-1, 0, None))
            if best[0] >= 0.9:
                want[i] = (best[2], pytest.approx(best[0], abs=1e-6))
            else:
                want[i] = (None, None)
                kept.append(i)
    assert got == want and any(r is not None for r, _ in got.values())
