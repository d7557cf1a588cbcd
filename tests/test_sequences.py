"""Greedy and beam algorithms against plain enumeration, and small fixtures."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import sequences as S
from lumenframe.operators import timeline as T
from lumenframe.sources.corpus import normalize_frames


@pytest.mark.parametrize(("gap", "equal"), [("log", False), ("linear", False), ("none", True), ("log", True)])
def test_kbest_equals_enumeration(spark, gap, equal):
    """Every rising sequence of each video, with all its penalties, where the beam is wide enough."""
    rng = random.Random(42)
    cases = {}
    for v in range(60):
        n = 1 + v % 4
        cases[f"v{v}"] = n, [[(rng.randint(0, 30), round(rng.random(), 3), rng.choice([None, "", "a", "b"])) for _ in range(rng.randint(1, 5))] for _ in range(n)]
    for n in range(1, 5):
        own = {v: pool for v, (m, pool) in cases.items() if m == n}
        want = {}
        for v, pool in own.items():
            # of one event's candidates at one frame the best counts
            pool = [[(f, *max((s, x or "") for g, s, x in p if g == f)) for f in {g for g, _, _ in p}] for p in pool]
            best = {}
            for combo in itertools.product(*pool):
                fs = tuple(c[0] for c in combo)
                pairs = list(zip(combo, combo[1:], strict=False))
                if all(a[0] < b[0] or (equal and a[0] == b[0]) for a, b in pairs):
                    far = [math.log1p(b[0] - a[0]) if gap == "log" else (b[0] - a[0]) / 1000 if gap == "linear" else 0 for a, b in pairs]
                    place = sum((0.2 if a[0] == b[0] else 0.02 if b[0] - a[0] <= 2 else 0) + 0.01 * (a[2] == b[2] != "") for a, b in pairs)
                    best[fs] = max(0, 0.7 * sum(c[1] for c in combo) / n + 0.3 * 0.8 - min(0.35, 0.01 * sum(far) / len(far) if far else 0) - min(0.4, place))
            want |= {(v, fs): s for fs, s in best.items()}
        rows = [(v, e, f, s, x, 0.8) for v, pool in own.items() for e, p in enumerate(pool) for f, s, x in p]
        df = spark.createDataFrame(rows, "video_id string, event int, frame long, score double, shot_id string, video_score double")
        got = S.kbest(df, n, 10_000, 10_000, gap, allow_equal=equal).collect()
        assert {(r.video_id, tuple(r.frames)): r.score for r in got} == pytest.approx(want, abs=2e-6)
        for v in own:
            mine = sorted((r for r in got if r.video_id == v), key=lambda r: r["rank"])
            assert [(-r.score, r.frames) for r in mine] == sorted((-r.score, r.frames) for r in mine)


def test_beam_keeps_sequences_that_can_end(spark):
    """High scores that no later event follows don't crowd out the others, and the first event is cut to the beam too."""
    rows = [("v", 0, 90 + i, 1.0) for i in range(5)] + [("v", 0, 1, 0.1), ("v", 0, 2, 0.2), ("v", 1, 50, 0.5)]
    got = S.kbest(spark.createDataFrame(rows, "video_id string, event int, frame long, score double"), 2, 10, 1).collect()
    assert [r.frames for r in got] == [[2, 50]]


def test_gating(spark):
    rows = [("full", 0, 0.9, 0.9), ("full", 1, 0.2, 0.9), ("half", 0, 1.0, 0.9), ("weak", 0, 0.9, 0.9), ("weak", 1, 0.1, 0.9), ("faint", 0, 0.9, 0.1), ("faint", 1, 0.9, 0.1)]
    df = spark.createDataFrame(rows, "video_id string, event int, quality double, score double")
    context = spark.createDataFrame([("half", 2.0), ("weak", 0.5), ("weak", 0.1)], "video_id string, context double")
    got = {r.video_id: r for r in S.gated(df, 2, context, least_score=0.5).collect()}
    assert (got["full"].coverage, got["full"].support, got["full"].context, got["full"].total) == (1.0, 0.55, 0.0, pytest.approx(0.45 + 0.45 * 0.55))
    assert (got["half"].coverage, got["half"].context) == (0.5, 1.0) and got["weak"].coverage == 0.5 and got["weak"].context == 0.5 and got["faint"].coverage == got["faint"].support == 0.0
    assert [r.video_id for r in S.gated(df, 2, context, complete=True).collect()] == ["faint", "full"]
    assert [r.video_id for r in S.gated(df, 2, absolute=F.col("score") > 0.5, complete=True).collect()] == ["full"]


def test_chain_dp_equals_enumeration():
    rng = random.Random(1)
    for _ in range(100):
        n, events = rng.randint(1, 6), rng.randint(2, 3)
        rows = sorted((rng.randint(0, 9) * 1.0, str(i)) for i in range(n))
        rel = np.array([[rng.random() for _ in range(n)] for _ in range(events)])
        best = max((sum(rel[e][j] for e, j in enumerate(c)) for c in itertools.product(range(n), repeat=events) if all(0 <= rows[b][0] - rows[a][0] <= 4 for a, b in zip(c, c[1:], strict=False))), default=None)
        got = S.chain_dp(np.array([t for t, _ in rows]), rel, 4)
        assert max(got) == pytest.approx(best / events)
    assert list(S.chain_dp(np.array([0.0, 1.0]), np.array([[0.2, 0.3]]), 4)) == [1.0, 1.0]


def test_selection_covers_events_and_leaves_out_near_duplicates():
    m = np.array([[1, 0], [0.999, 0.0447], [0, 1.0]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = S.cses((m @ np.array([1, 0]) + 1) / 2, m @ m.T, np.array([0.0, 1.0, 9.0]), ["a", "b", "c"], [set(), set(), {"e"}])
    assert [i for i, _ in got] == [2, 0]


def test_selection_picks_the_largest_gain_each_time():
    """Gains of each pick recomputed from the definition, for random clips with events."""
    rng = np.random.default_rng(5)
    p = S.ClipProfile(most=6)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        m = rng.normal(size=(n, 3))
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        sim, ts, rel = np.clip(m @ m.T, -1, 1), np.sort(rng.uniform(0, 10, n)), rng.uniform(0, 1, n)
        events = [set(rng.choice(["x", "y"], rng.integers(0, 3))) for _ in range(n)]
        names = set().union(*events)
        got = S.cses(rel, sim, ts, list(range(n)), events, p)
        width = max(ts.max() - ts.min(), 1e-9)
        place = [min(3, int((t - ts.min()) / width * 4)) for t in ts]
        taken: list[int] = []

        def gain(i, taken=taken, sim=sim, rel=rel, place=place, events=events, names=names):
            seen = lambda rows: np.mean([max([0.0, *(sim[j, c] for c in rows)]) for j in range(len(rel))])
            new = 0.5 * (place[i] not in {place[c] for c in taken}) / 4 + 0.5 * len(events[i] - set().union(*(events[c] for c in taken))) / max(1, len(names))
            return 0.7 * rel[i] + 0.2 * (seen([*taken, i]) - seen(taken)) + 0.1 * new

        for k, (i, g) in enumerate(got):
            assert g == pytest.approx(gain(i), abs=2e-8) and i not in taken
            covered = set().union(*(events[c] for c in taken))
            if k >= len(names) and covered == names:
                open_ = [j for j in range(n) if j not in taken and not any(sim[j, c] > 0.92 and abs(ts[j] - ts[c]) <= 2 for c in taken)]
                assert i in open_ and g >= max(gain(j) for j in open_) - 2e-8
            taken.append(i)


def test_groups_without_a_result(spark):
    """A video without a rising chain, one where nothing may be chosen, empty inputs: no row, and no failure."""
    rows = spark.createDataFrame([("v", 0, 10, 0.5), ("v", 1, 5, 0.5), ("w", 0, 1, 0.5), ("w", 1, 2, 0.5)], "video_id string, event int, frame long, score double")
    assert [r.video_id for r in S.kbest(rows, 2).collect()] == ["w"]
    assert S.kbest(rows.where("video_id = 'v'"), 2).count() == 0 and S.kbest(rows.limit(0), 2).count() == 0
    from lumenframe.operators import rerank, selection

    one = spark.createDataFrame([("v", "c", 1.0, 1, 0.5, None, [1.0, 0.0], [], 2.0)], "video_id string, candidate_id string, ts double, frame long, importance double, duplicate_group string, embedding array<float>, event_ids array<string>, duration double")
    assert selection.select_keyframes(one, hard_max=0).count() == 0 and selection.select_keyframes(one.limit(0)).count() == 0
    assert S.select_in_clips(one.selectExpr("video_id", "'s' shot_id", "frame row", "ts", "embedding"), [1.0, 0.0], S.ClipProfile(most=0)).count() == 0
    assert S.chain_scores(rows.selectExpr("video_id", "string(frame) candidate_id", "double(frame) ts", "array(score, score) relevance").limit(0), 1.0).count() == 0
    paths = S.kbest(rows, 2).selectExpr("video_id", "string(rank) path_id", "frames", "score")
    assert rerank.ranked_sequences(paths.limit(0), 2, radius=1).count() == 0
    assert selection.strongest(one.selectExpr("video_id", "frame frame_id", "ts", "importance strength").limit(0)).count() == 0


def test_greedy_lists():
    assert S.kept_captions(["a person cooks", "a person cooks", "a person cooks.", "rain", ""]) == [0, 3]
    assert S.suppressed([1, 3, 2, 1], [0, 0.5, 1.2, 5], 1.0) == [1, 3]


def hits(spark, rows):
    return spark.createDataFrame(rows, "video_id string, frame_id string, ts double, quality double")


def test_ordered_match_modes(spark):
    a, b = hits(spark, [("V1", "enter", 10.0, 0.9)]), hits(spark, [("V2", "wrong", 11.0, 0.9), ("V1", "early", 5.0, 0.9), ("V1", "cook", 30.0, 0.8)])
    mode, found = S.match_with_fallback([a, b], 60)
    assert mode == "strict" and [tuple(r)[:3] for r in found.collect()] == [("V1", "enter", "cook")]
    mode, found = S.match_with_fallback([a, hits(spark, [("V1", "late", 500.0, 0.5)])], 60)
    assert mode == "relaxed_gap" and found.count() == 1
    mode, found = S.match_with_fallback([a, a], 60)
    assert mode == "sparse_compat" and found.count() == 1


def test_r_score_example(spark):
    truth = spark.createDataFrame([("q", "L10_V010", [(95, 105), (145, 155), (195, 205), (245, 255)])], "id string, truth_video string, intervals array<struct<s:long,e:long>>")
    guess = spark.createDataFrame([("q", "L10_V010", [101, 156, 203, 251]), ("q", "other", [101, 150, 200, 250]), ("q", "L10_V010", [95, 155, 205, 245])], "id string, video_id string, frames array<long>")
    assert sorted(r.r for r in S.r_score(guess, truth).collect()) == [0.0, 0.75, 1.0]


def test_neighbours_exclude_self_and_other_videos(spark):
    rows = spark.createDataFrame([("A", 0, 0), ("A", 1, 1_000_000), ("A", 2, 2_000_000), ("B", 3, 1_000_000)], "video_id string, frame_id long, micros long")
    got = {r.frame_id: ([x.frame_id for x in r.before], [x.frame_id for x in r.after]) for r in T.neighbours(rows, 5).collect()}
    assert got == {0: ([], [1, 2]), 1: ([0], [2]), 2: ([0, 1], []), 3: ([], [])}
    assert {r.frame_id: r.before for r in T.neighbours(rows, 0).collect()}[1] == []


def test_normalize_without_optional_columns(spark):
    row = normalize_frames(spark.createDataFrame([("V", "f", None)], "video_id string, frame_id string, frame_index long")).first()
    assert (row.timestamp, row.timestamp_source, row.timestamp_confidence, row.caption) == (None, "unknown", 0.0, None)


def test_local_hypotheses_and_paths(spark):
    from lumenframe.operators import refine as N

    scores = [(1, f, s, m) for f, s, m in ((10, 0.1, 0.0), (11, 0.2, 0.1), (12, 0.9, 0.8), (13, 0.8, 0.1))]
    scores += [(2, f, 0.5, None) for f in (5, 6, 7)]  # flat
    scores += [(3, f, s, 0.0) for f, s in ((1, 0.0), (2, 1.0), (3, 1.0))]  # a change without motion
    scores += [(4, f, s, None) for f, s in ((1, 0.2), (2, 0.7), (3, 0.1), (4, 0.6))]  # two peaks
    scores += [(5, f, s, None) for f, s in ((1, 0.0), (2, 1.0), (3, 0.1))]  # a change that isn't confirmed
    windows = spark.createDataFrame([(1, "first_leave", 13), (2, "peak", 7), (3, "first_contact", None), (4, "peak", None), (5, "first_transition", None), (6, None, None)], "window_id int, boundary string, coarse int")
    got = N.local_hypotheses(spark.createDataFrame(scores, "window_id int, frame int, score double, motion double"), windows, 3)
    by = {}
    for r in got.orderBy("window_id", "rank").collect():
        by.setdefault(r.window_id, []).append((r.frame, r.strategy, r.confidence, r.source))
    assert [x[0] for x in by[1]] == [12, 13, 11] and by[1][0][1:] == ("first_fully_left_state", 1.0, "local_refinement")
    assert by[2] == [(7, "flat_local_score_fallback", 0.0, "canonical_metadata")]
    assert by[3] == [(2, "insufficient_temporal_signal_fallback", 0.0, "canonical_metadata")]
    assert [x[0] for x in by[4]] == [2, 4] and by[4][0][1] == "local_peak"
    assert [x[0] for x in by[5]] == [2, 3, 1] and set(by) == {1, 2, 3, 4, 5}
    paths = spark.createDataFrame([(1, 0.5), (2, 0.4)], "path_id int, score double")
    choices = spark.createDataFrame([(1, 0, 5, 1.0), (1, 0, 9, 0.2), (1, 1, 7, 0.5), (1, 1, 10, 0.1), (2, 0, 8, 1.0), (2, 1, 8, 1.0)], "path_id int, event int, frame long, confidence double")
    rows = [(r.path_id, r.frames, r.score) for r in N.refined_paths(paths, choices, 2).orderBy(F.desc("score"), "frames").collect()]
    assert rows == [(1, [5, 7], 0.5375), (1, [5, 10], 0.5075), (1, [9, 10], 0.4475)]


def test_local_scores(spark):
    """Windows meet just their frames, whatever bucket they fall in; scores and motion are those of numpy."""
    from lumenframe.operators import refine as N

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 3))
    frames = [(f"v{i % 2}", i, i * 0.7 - 3, [float(x) for x in v]) for i, v in enumerate(vectors)]
    asked = rng.normal(size=(3, 3))
    windows = [(f"w{i}", f"v{i % 2}", i % 3, (low := float(rng.uniform(-4, 26))), low + float(rng.uniform(0, 2))) for i in range(30)] + [("edge", "v0", 0, -3.0, -1.0)]
    df = N.local_scores(spark.createDataFrame(windows, "window_id string, video_id string, event int, low double, high double"), spark.createDataFrame(frames, "video_id string, frame long, ts double, embedding array<double>"), spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "event int, query array<double>"), 2.0)
    got = {(r.window_id, r.frame): (r.score, r.motion) for r in df.collect()}
    want = {}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for w, v, e, low, high in windows:
        last = None
        for video, i, t, x in frames:
            if video == v and low <= t <= high:
                want[w, i] = (pytest.approx((cos(x, asked[e]) + 1) / 2), pytest.approx(0 if last is None else min(1, max(0, 1 - cos(x, last)))))
                last = x
    assert got == want


def test_local_scores_reject(spark):
    from lumenframe.operators import refine as N

    w = lambda high: spark.createDataFrame([("w", "v", 0, 0.0, high)], "window_id string, video_id string, event int, low double, high double")
    f = lambda e: spark.createDataFrame([("v", 1, 0.5, e)], "video_id string, frame long, ts double, embedding array<double>")
    q = lambda e: spark.createDataFrame([(0, e)], "event int, query array<double>")
    for args, match in (((w(9.0), f([1.0]), q([1.0])), "wider than the band"), ((w(1.0), f([0.0]), q([1.0])), "frame embedding has no direction"), ((w(1.0), f([1.0]), q([float("nan")])), "query embedding has no direction"), ((w(1.0), f([1.0]), q([1.0, 2.0])), "differ in dimension")):
        with pytest.raises(Exception, match=match):
            N.local_scores(*args, 2.0).collect()
    assert N.local_scores(w(1.0).limit(0), f([1.0]), q([1.0]), 2.0).count() == 0
