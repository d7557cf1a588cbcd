"""Fuzzy clusters, text and object events, the merge fold, and joins that reject, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import aliases as A
from lumenframe.operators import features as N
from lumenframe.operators import similar as S
from lumenframe.operators.fusion import merge_fold


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def clusters_of(texts, percent=82):
    texts = sorted(texts)
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if 200 * lcs(a, b) >= percent * (len(a) + len(b)):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {t: find(t) for t in texts}


def edited(rng, t):
    for _ in range(rng.randint(1, 3)):
        i = rng.randrange(len(t) + 1)
        t = rng.choice([t[:i] + rng.choice("abcé ") + t[i:], t[:i] + t[i + 1 :], t[:i] + "x" + t[i + 1 :]])
    return t


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(80))) for _ in range(2))
        assert S.common_subsequence(a, b) == lcs(a, b)


@pytest.mark.parametrize("percent", [70, 82, 95])
def test_clusters_equal_all_pairs(spark, percent):
    """No pair that reaches the ratio is lost, for short and long texts, in groups of their own."""
    rng = random.Random(percent)
    rows = []
    for g in range(3):
        seeds = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 40))) for _ in range(12)] + ["a", "ab", "abc", ""]
        texts = seeds + [edited(rng, s) for s in seeds[:12] for _ in range(3)]
        rows += [(g, t) for t in texts + texts[:3]] + [(g, None)]
    rows += [(9, "alone")]
    got = defaultdict(dict)
    for r in S.fuzzy_clusters(spark.createDataFrame(rows, "g long, t string"), F.col("g"), F.col("t"), percent).collect():
        got[r.grp][r.text] = r.cluster
    assert got == {g: clusters_of({t for h, t in rows if h == g and t}, percent) for g in (0, 1, 2, 9)}


def test_long_chains_end_in_one_component(spark):
    edges = spark.createDataFrame([("g", f"{i:04}", f"{i + 1:04}") for i in range(500)] + [("h", "0003", "0001")], "grp string, a string, b string")
    got = {(r.grp, r.node): r.label for r in S.components(edges).collect()}
    assert {v for (g, _), v in got.items() if g == "g"} == {"0000"} and got["h", "0003"] == "0001" and len(got) == 503


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], "g long, t string")
    assert S.fuzzy_clusters(none, F.col("g"), F.col("t")).count() == 0
    with pytest.raises(ValueError):
        S.candidate_pairs(none, 60)


def test_comparison(spark):
    said = ["  ﬁne—Print!  ", "ＡＢＣ １２", "Straße_x", None, "!?", "étude"]
    got = [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i long, t string").select("i", N.comparison(F.col("t")).alias("k")).orderBy("i").collect()]
    assert got == ["fine print", "abc 12", "strasse_x", "", "", "étude"]


def regions(spark, rows):
    return spark.createDataFrame([("v", f"s{i // 5}", i, i, float(t), text, c, a, x, y) for i, t, text, c, a, x, y in rows], "video_id string, shot_id string, frame_id long, frame_index long, ts double, text string, confidence double, area double, cx double, cy double")


def test_text_events(spark):
    logo = [(i, i * 10, "CHANNEL", 0.99, 0.01, 0.9, 0.1) for i in range(10)]  # everywhere, in one place
    subtitle = [(20 + i, 200 + i, f"what they say {i}", 0.99, 0.02, 0.5, 0.9) for i in range(3)]
    sign = [(30, 300, "Grand Hotel", 0.8, 0.01, 0.3, 0.3), (31, 301, "Grand Hotal", 0.8, 0.01, 0.3, 0.3), (32, 302, "Grand Hotel", 0.8, 0.01, 0.6, 0.3), (33, 302.5, "Grand Hotel", 0.8, 0.01, 0.6, 0.3), (34, 320, "Grand Hotel", 0.97, None, None, None)]
    weak = [(40, 400, "passing", 0.8, 0.01, 0.5, 0.5)]
    rows = regions(spark, logo + subtitle + sign + weak)
    frames = spark.createDataFrame([("v", f"s{i // 5}", i) for i in range(50)], "video_id string, shot_id string, frame_id long")
    tracks = N.text_tracks(frames, rows)
    by = {r.frame_id: r for r in tracks.collect()}
    assert by[0].common and by[0].score == pytest.approx(0.1 * by[0].quality)
    assert by[20].subtitle and by[20].score == pytest.approx(0.35 * by[20].quality)
    assert by[31].track == by[30].track == "grand hotal" and by[30].fraction == pytest.approx(0.1)
    episodes = {r.episode: r for r in N.text_episodes(tracks).where("track = 'grand hotal'").collect()}
    assert [episodes[k].frame_ids for k in (1, 2, 3)] == [[30, 31], [32, 33], [34]]
    assert [episodes[k].kept for k in (1, 2, 3)] == [True, False, False]  # the third is away long enough, but not rare
    events = N.protected_events(N.text_episodes(tracks), "OCR", "ocr_new", 2).collect()
    assert [e.frame_ids for e in events] == [[30, 31]] and events[0].event_id.endswith("_000000030")


def test_object_without_a_name_is_an_error(spark):
    found = spark.createDataFrame([("v", 1, 1, 0.0, " ", None, 0.9, 0.1)], "video_id string, frame_id long, frame_index long, ts double, class_name string, class_id long, confidence double, area double")
    with pytest.raises(Exception, match="class name"):
        N.object_tracks(found, found).collect()


def test_transition_events_and_features(spark):
    kept = spark.createDataFrame([("v", 1, 2, 10, 20)], "video_id string, left_frame long, right_frame long, left_index long, right_index long")
    events = N.transition_events(kept)
    assert {(e.event_type, tuple(e.frame_ids)) for e in events.collect()} == {("semantic_transition_pre", (1,)), ("semantic_transition_post", (2,))}
    frames = spark.createDataFrame([("v", i) for i in range(4)], "video_id string, frame_id long")
    found = spark.createDataFrame([("v", 1, 0.5), ("v", 1, 0.7)], "video_id string, frame_id long, score double")
    got = {r.frame_id: r for r in N.frame_features(frames, {"ocr": (frames.where("frame_id < 3"), found), "caption": (frames.where("frame_id < 1"), found)}, events).collect()}
    assert got[1].ocr == 0.7 and got[1].caption is None and got[1].importance == pytest.approx(0.7) and len(got[1].event_ids) == 1
    assert got[0].ocr == 0.0 and got[3].ocr is None and got[3].importance == 0.0 and got[3].event_ids == []


HIT = "video_id string, frame_id string, segment_id string, faiss_index long, timestamp double, timestamp_confidence double, score double, caption string, objects array<string>, modality_scores map<string,double>, frame_index long, seq long"


def fold_of(rows):
    """Merge from left to right, two rows at a time."""
    held, names = {}, HIT.replace("map<string,double>", "map").replace("array<string>", "array").split(", ")
    names = [n.split()[0] for n in names]
    for raw in rows:
        r = dict(zip(names, raw, strict=True))
        key = (r["video_id"], "f", r["frame_id"]) if r["frame_id"] else (r["video_id"], "s", r["segment_id"]) if r["segment_id"] else ("i", r["faiss_index"]) if r["faiss_index"] is not None else (r["video_id"], "t", f"{r['timestamp']:.3f}")
        if key not in held:
            held[key] = r | {"first_seen": r["seq"]}
            continue
        old = held[key]
        lead, other = (r, old) if r["score"] > old["score"] else (old, r)
        scores = dict(old["modality_scores"])
        for m, s in r["modality_scores"].items():
            scores[m] = max(s, scores.get(m, s))
        held[key] = lead | {
            "score": round(max(old["score"], r["score"]), 6), "caption": lead["caption"] or other["caption"] or None, "objects": [x for x in dict.fromkeys(lead["objects"] + other["objects"]) if x],
            "modality_scores": scores, "frame_index": lead["frame_index"] if lead["frame_index"] is not None else other["frame_index"], "first_seen": old["first_seen"],
        }
    return sorted(held.values(), key=lambda r: (-r["score"], -(r["timestamp_confidence"] or 0), r["first_seen"]))


def test_merge_fold_equals_the_fold(spark):
    rng = random.Random(3)
    rows = []
    for seq in range(400):
        frame, segment, row = rng.choice([None, "", "f1", "f2", "f3", "f4"]), rng.choice([None, "s1", "s2"]), rng.choice([None, 1, 2])
        rows.append((f"v{rng.randrange(3)}", frame, segment, row, rng.randrange(4) / 3, rng.choice([0.5, 1.0]), rng.choice([0.1, 0.25, 0.25 + 4e-7, 0.5, rng.random()]), rng.choice([None, "", f"c{seq}"]), rng.sample(["a", "b", "", "c"], rng.randrange(4)), {rng.choice("xyz"): rng.random()}, rng.choice([None, seq]), seq))
    got = merge_fold(spark.createDataFrame(rows, HIT).repartition(7)).collect()
    want = fold_of(rows)
    assert [r.first_seen for r in got] == [w["first_seen"] for w in want]
    for r, w in zip(got, want, strict=True):
        assert (r.video_id, r.score, r.caption or None, r.objects, r.modality_scores, r.frame_index, r.timestamp, r.shot if "shot" in r else None) == (w["video_id"], w["score"], w["caption"] or None, [x for x in dict.fromkeys(w["objects"]) if x], w["modality_scores"], w["frame_index"], w["timestamp"], None)


RECORD = "video_id string, candidate_id string, frame_id string, status string"


def rejected(spark, rows, match, candidates=(("v", "c1", "f1"), ("v", "c2", "f2"), ("v", "c3", None))):
    table = A.alias_table(spark.createDataFrame(list(candidates), "video_id string, candidate_id string, frame_id string"))
    with pytest.raises(Exception, match=match):
        A.resolve(spark.createDataFrame(rows, RECORD), table, "ocr record").select("video_id", "candidate_id").collect()


@pytest.mark.parametrize(
    ("rows", "match"),
    [
        ([("v", None, " ", "success")], "needs candidate_id or frame_id"),
        ([("v", "c9", None, None)], "unknown candidate c9"),
        ([("v", "f1", None, None)], "unknown candidate f1"),
        ([("w", "c1", None, None)], "unknown candidate c1"),
        ([("v", None, "f9", None)], "unknown candidate f9"),
        ([("v", "c1", "f2", None)], "different candidates c1 f2"),
        ([("v", "c1", None, "done")], "unknown status done"),
        ([("v", "c1", None, None), ("v", None, "f1", None)], "duplicate ocr record for candidate: c1/v"),
    ],
)
def test_records_rejected(spark, rows, match):
    rejected(spark, rows, match)


def test_ambiguous_alias(spark):
    rejected(spark, [("v", "c1", None, None)], "ambiguous: f1", [("v", "c1", "f1"), ("v", "c2", "f1")])
    rejected(spark, [("v", "c1", None, None)], "ambiguous: c2", [("v", "c1", "c2"), ("v", "c2", "f1")])


def test_records_resolved(spark):
    table = A.alias_table(spark.createDataFrame([("v", "c1", "f1"), ("v", "c2", "c2"), ("w", "c1", "")], "video_id string, candidate_id string, frame_id string"))
    rows = [("v", "c1", "f1", "error"), ("v", None, "c2", None), ("w", "c1", None, "skipped")]
    assert {tuple(r) for r in A.resolve(spark.createDataFrame(rows, RECORD), table, "x").select("video_id", "candidate_id").collect()} == {("v", "c1"), ("v", "c2"), ("w", "c1")}


@pytest.mark.parametrize(
    ("vectors", "records", "match"),
    [
        ([("v", 0, [1.0, 0.0])], [], "row without a record: 0"),
        ([], [("v", 0, "c1", None, None, None)], "record without a row: 0"),
        ([("v", 0, [1.0, 0.0])], [("v", 0, "c1", None, 3, None)], "vector_dim mismatch at row 0"),
        ([("v", 0, [float("nan"), 0.0])], [("v", 0, "c1", None, 2, None)], "isn't finite: c1"),
        ([("v", 0, [0.0, 0.0])], [("v", 0, "c1", None, 2, None)], "invalid norm: c1"),
        ([("v", 0, [2.0, 0.0])], [("v", 0, "c1", None, 2, True)], "marked normalized but is not: c1"),
        ([("v", 0, [1.0, 0.0])] * 2, [("v", 0, "c1", None, 2, True)], "duplicate embedding row: v/0"),
        ([("v", 0, [1.0, 0.0]), ("v", 1, [1.0, 0.0])], [("v", 0, "c1", None, 2, True), ("v", 1, None, "f1", 2, True)], "duplicate embedding record for candidate: c1"),
    ],
)
def test_vectors_rejected(spark, vectors, records, match):
    table = A.alias_table(spark.createDataFrame([("v", "c1", "f1"), ("v", "c2", "f2")], "video_id string, candidate_id string, frame_id string"))
    v = spark.createDataFrame(vectors, "video_id string, embedding_index long, embedding array<float>")
    r = spark.createDataFrame(records, "video_id string, embedding_index long, candidate_id string, frame_id string, vector_dim int, normalized boolean")
    with pytest.raises(Exception, match=match):
        A.aligned_vectors(v, r, table).collect()


def test_context_rejected(spark):
    n = lambda rows: spark.createDataFrame(rows, "video_id string, frame_id string, before array<string>")
    assert A.neighbour_context(n([("v", "a", []), ("w", "a", [])])).count() == 2
    for rows, match in (([("v", "a", []), ("v", "a", [])], "duplicate neighbor record: v/a"), ([("v", " ", [])], "without frame_id")):
        with pytest.raises(Exception, match=match):
            A.neighbour_context(n(rows)).collect()
    s = lambda rows: A.segment_members(spark.createDataFrame(rows, "video_id string, segment_id string, keyframe_ids array<string>"))
    assert {tuple(r) for r in s([("v", "s", ["b", " ", "a"]), ("w", "s", ["a"])]).collect()} == {("v", "s", 0, "b"), ("v", "s", 1, "a"), ("w", "s", 0, "a")}
    for rows, match in (([("v", "s", ["a"]), ("v", "s", ["b"])], "duplicate segment record: v/s"), ([("v", "s", ["a", "a"])], "duplicate frame of segments: v/a"), ([("v", "s", ["a"]), ("v", "t", ["a"])], "duplicate frame of segments: v/a"), ([("v", None, ["a"])], "without segment_id")):
        with pytest.raises(Exception, match=match):
            s(rows).select("frame_id", "video_id").collect()


def test_window_of_an_absent_frame(spark):
    segments = spark.createDataFrame([("v", "s", [f"k{i}" for i in range(9)], 10.0, 18.0), ("v", "flat", ["p", "q", "r"], 5.0, 5.0)], "video_id string, segment_id string, keyframe_ids array<string>, start_time double, end_time double")
    targets = spark.createDataFrame([(1, "v", "s", "none", 13.4), (2, "v", "s", "k0", 99.0), (3, "v", "flat", None, 5.0), (4, "v", "s", "none", 99.0), (5, "v", "gone", "k1", 1.0)], "id long, video_id string, segment_id string, frame_id string, timestamp double")
    got = defaultdict(list)
    for r in A.segment_window(A.segment_members(segments), segments, targets, 3).orderBy("id", "rank").collect():
        got[r.id].append(r.frame_id)
    assert got == {1: ["k3", "k2", "k4"], 2: ["k1", "k2", "k3"], 3: ["q", "p", "r"], 4: ["k8", "k7", "k6"]}
