"""Selection, reranking, files, parsing and search: against plain enumeration and on small fixtures."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenframe.functions import labels as B
from lumenframe.operators import rerank as K
from lumenframe.operators import selection as P
from lumenframe.plans import parse
from lumenframe.plans.engine import Engine
from lumenframe.sources import files


def test_selection_meets_the_constraints_wherever_a_subset_can():
    rng = random.Random(42)
    for _ in range(200):
        pool = [P.Candidate(f"c{i}", float(rng.randint(0, 10)), i, rng.random()) for i in range(rng.randint(1, 8))]
        events = [P.Event(f"e{k}", set(rng.sample([c.id for c in pool], rng.randint(1, min(3, len(pool)))))) for k in range(rng.randint(0, 3))]
        bound = rng.choice([None, rng.randint(1, 5)])
        s = P.Selector(pool, events, 10.0, max_gap=4.0, hard_max=bound)
        subsets = [list(c) for n in range((bound or 8) + 1) for c in itertools.combinations(pool, n)]
        possible = any(s.holds(x) for x in subsets)
        got = s.run()
        assert (got.status == "satisfied") == possible
        assert len(got.chosen) <= (bound or 8) and len({c.id for c in got.chosen}) == len(got.chosen)


def test_selection_without_candidates_is_partial():
    got = P.Selector([], [P.Event("e", {"x"})], 10.0).run()
    assert got.status == "partial" and got.chosen == [] and "events_without_candidate" in got.reasons


def test_duplicates_keep_every_event_covered():
    import numpy as np

    v = np.array([1.0, 0.0])
    pool = [P.Candidate("a", 1.0, 1, 0.9, None, v), P.Candidate("b", 2.0, 2, 0.1, None, v), P.Candidate("c", 3.0, 3, 0.5, None, v)]
    got = P.Selector(pool, [P.Event("x", {"b"}), P.Event("y", {"c"})], 4.0, max_gap=9.0, density=0.75, dedupe=True).run()
    assert [c.id for c in got.chosen] == ["b", "c"] and got.status == "satisfied"


def test_suppression_in_blocks_equals_one_pass(spark):
    rng = random.Random(3)
    rows = [(f"v{rng.randint(0, 1)}", i, float(rng.randint(0, 400)), float(rng.randint(0, 5)), rng.getrandbits(4)) for i in range(300)]
    df = spark.createDataFrame(rows, "video_id string, frame_id long, ts double, strength double, hash long")
    want = set()
    for v in ("v0", "v1"):
        kept = []
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: (-r[3], r[2], r[1])):
            if all(abs(r[2] - k[2]) > 2 for k in kept):
                kept.append(r)
        want |= {k[1] for k in kept}
    assert {r.frame_id for r in P.strongest(df, 2.0).collect()} == want
    want = set()
    for v in ("v0", "v1"):
        kept = []
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1])):
            if not any(r[2] - k[2] <= 3 and (r[4] ^ k[4]).bit_count() <= 1 for k in kept):
                kept.append(r)
        want |= {k[1] for k in kept}
    assert {r.frame_id for r in P.distinct_frames(df, 3.0, 1).collect()} == want


def test_near_repeats_of_captions(spark):
    df = spark.createDataFrame([("v", "s", 1, 1.0, "a person cooking rice"), ("v", "s", 2, 2.0, "a person cooking  Rice"), ("v", "s", 3, 3.0, "a dog"), ("v", "t", 4, 1.0, None)], "video_id string, shot_id string, frame_id long, ts double, caption string")
    got = {r.shot_id: r for r in P.captions_without_near_repeats(df).collect()}
    assert (got["s"].caption, got["s"].kept, got["s"].seen) == ("a person cooking rice a dog", 2, 3)
    assert (got["t"].caption, got["t"].kept, got["t"].seen) == ("", 0, 0)


def test_near_repeats_take_whole_captions(spark, tmp_path):
    from difflib import SequenceMatcher

    from lumenframe.plans import searching
    from lumenframe.sources.corpus import text_frames

    long = "the rain falls on the old stone house beside the river all night long"
    texts = [f"Title\n{long}", "Title\nsomething else entirely: green hills", f"Titles\n{long}", f"Head\n{long}", "Title"]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    want = {}
    for r in text_frames(spark, f"file://{tmp_path}").orderBy("ts", "frame_id").collect():
        kept = want.setdefault((r.video_id, str(r.shot_id)), [])
        clean = lambda t: " ".join(t.casefold().split())
        if all(SequenceMatcher(None, clean(k), clean(r.caption)).ratio() < 0.92 for k in kept):
            kept.append(r.caption)
    got = searching.caption_near_dedupe(spark, f"file://{tmp_path}").collect()
    assert {(r.video_id, r.shot_id): r.caption for r in got} == {k: " ".join(v) for k, v in want.items()}


def test_sequences_equal_greedy_passes(spark):
    rng = random.Random(7)
    rows = [(v := f"v{rng.randint(0, 2)}", f"{v}p{rng.randint(0, 3)}", [rng.randint(-1, 6), rng.randint(0, 6)], rng.randint(0, 9) / 10) for _ in range(300)]
    df = spark.createDataFrame(rows, "video_id string, path_id string, frames array<int>, score double")
    order = sorted((r for r in rows if r[2][0] >= 0 and r[2][0] < r[2][1]), key=lambda r: (-r[3], r[2], r[0], r[1]))
    valid, seen = [], set()
    for r in order:
        if (r[0], tuple(r[2])) not in seen:
            seen.add((r[0], tuple(r[2])))
            valid.append(r)
    kept = []
    for capped in (True, False):
        for r in valid:
            if len(kept) < 30 and r not in kept and not (capped and (sum(k[0] == r[0] for k in kept) >= 10 or sum(k[1] == r[1] for k in kept) >= 3)):
                kept.append(r)
    got = K.ranked_sequences(df, 2, 30).orderBy("rank").collect()
    assert [(g.video_id, g.path_id, list(g.frames), g.score) for g in got] == kept
    near = K.ranked_sequences(df, 2, 30, radius=1).collect()
    assert all(a.video_id != b.video_id or any(abs(x - y) > 1 for x, y in zip(a.frames, b.frames, strict=True)) for a, b in itertools.combinations(near, 2))


def test_constraints(spark):
    df = spark.createDataFrame([("a person cooking rice", 0.5), ("rice for a person", 0.5), (None, 0.5)], "caption string, score double")
    c = F.col("caption")
    got = df.select(K.phrase_signal(c, "person cooking"), K.constraint_signal({"actions": ["person cooking"], "ocr_terms": ["x"]}, {"actions": [c]})).collect()
    assert [r[0] for r in got] == pytest.approx([1.0, 0.35 / 1.35, 0.0])
    assert got[0][1] == 0.5
    signal = df.withColumn("constraint", K.phrase_signal(c, "person cooking"))
    assert [r.score for r in K.constrained(signal).orderBy(F.desc("score")).collect()] == pytest.approx([0.575, 0.425 + 0.15 * 0.35 / 1.35, 0.425])
    assert {r.score for r in K.constrained(signal, least=2.0).collect()} == {0.5}


def test_signals(spark):
    df = spark.createDataFrame([(1, -0.5, 0.9, 0.2), (2, 0.25, 0.5, None)], "id int, coarse_rrf double, dense_visual double, cses_gain double").withColumn("visual_coverage", F.lit(0.0))
    got = {r.id: r.score for r in K.weighted_signals(df, K.VISUAL_ONLY).collect()}
    assert got == {1: pytest.approx((0.39 * 0.9 + 0.04) / 0.61), 2: pytest.approx((0.14 * 0.75 + 0.39 * 0.5) / 0.61)}


def test_labels(spark):
    row = spark.sql("SELECT array(named_struct('label', '', 'class_name', 'cat'), named_struct('label', 'dog', 'class_name', 'x'), named_struct('label', 'cat', 'class_name', null)) AS o, ' a, b,,a' AS t")
    assert row.select(B.labels_of(F.col("o")), B.labels_in(F.col("t"))).first()[:] == (["cat", "dog"], ["a", "b"])


def test_record_files(spark, tmp_path):
    (tmp_path / "keyframes_V1.jsonl").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    (tmp_path / "keyframes_V1_report.jsonl").write_text("{}")
    (tmp_path / "map.json").write_text('{"10": {"id": 10}, "9": {"id": 9}, "x": {"id": 0}}')
    (tmp_path / "notes.txt").write_text("")
    schema = StructType.fromDDL("id long")
    found = files.keyframe_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in found] == ["keyframes_V1.jsonl"] and len(files.record_files(spark, str(tmp_path))) == 3
    assert [r.id for r in files.read_records(spark, found, schema, strict=False).orderBy("id").collect()] == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_records(spark, found, schema).collect()
    assert [r.key for r in files.read_frame_map(spark, str(tmp_path / "map.json"), schema).collect()] == ["9", "10", "x"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.record_files(spark, str(tmp_path / "none"))


def test_published_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    first = files.publish(df, path)
    files.publish(df.where("k = 1"), path)
    assert [tuple(r) for r in files.load(spark, path).collect()] == [(1, "a")]
    manifest = (tmp_path / "t" / "CURRENT").read_text()
    (tmp_path / "t" / "CURRENT").write_text(__import__("re").sub("gen=[0-9a-f]+", first, manifest))
    (tmp_path / "t" / ".CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="differs"):
        files.load(spark, path)
    assert files.append_missing(df, str(tmp_path / "a"), ["k"]) == 2 and files.append_missing(df, str(tmp_path / "a"), ["k"]) == 0


def test_answers(spark, tmp_path):
    df = spark.createDataFrame([("V1", 5, "red, blue", 2), ("V1", 5, "red, blue", 3), ("V2", None, "x", 1), ("V0", 7, "y", 1)], "video_id string, frame_index long, answer string, rank int")
    assert files.answer_csv(df, "kis") == "V0,7\r\nV1,5\r\n"
    assert files.answer_csv(df, "qa") == 'V0,7,y\r\nV1,5,"red, blue"\r\n'
    seq = spark.createDataFrame([("V1", [1, 2], 1), ("V1", [3], 2)], "video_id string, frames array<long>, rank int")
    assert files.answer_csv(seq, "trake", events=2) == "V1,1,2\r\n"
    assert open(files.write_answers(df, str(tmp_path), "query-p1-3-kis.txt"), newline="").read() == "V0,7\r\nV1,5\r\n"
    with pytest.raises(ValueError):
        files.answer_file_name("p1-3-kis")


def test_parse():
    p = parse.parse_sequence("Context: a kitchen. E1: a man enters E2: he is cooking 3 eggs E3: the ball reaches the highest point")
    assert p.mode == "list" and p.context == "a kitchen"
    assert [(e.text, e.boundary) for e in p.events] == [("a man enters", "unknown"), ("he is cooking 3 eggs", "state"), ("the ball reaches the highest point", "peak")]
    assert [e.text for e in parse.parse_sequence("he sits down, then he eats after he prays").events] == ["he sits down", "he prays", "he eats"]
    assert [e.text for e in parse.parse_sequence("before she runs, she stands").events] == ["she stands", "she runs"]
    assert [e.text for e in parse.parse_sequence("người đàn ông vào rồi ngồi xuống").events] == ["người đàn ông vào", "ngồi xuống"]
    assert parse.parse_sequence("a man next to a car").mode == "verbatim" and parse.parse_sequence("  ").events == ()
    assert [parse.answer_type(q) for q in ("What color is it?", "How many dogs?", "Is it red?", "tell me")] == ["color", "count", "yes_no", "unknown"]


@pytest.mark.parametrize(
    ("query", "context", "texts", "labels", "warnings"),
    [
        ("E1: a door opens\r\nE2:\r\nE3: a person exits", "", ["a door opens", "", "a person exits"], ["E1", "E2", "E3"], ["empty_event_marker_preserved"]),
        ("A park.\nE1: he stands\nE2: he sits\nE2: he eats\nE4: he leaves", "A park", ["he stands", "he sits", "he eats", "he leaves"], ["E1", "E2", "E2", "E4"], ["duplicate_event_label_preserved", "event_labels_reindexed_by_appearance"]),
        ("1. a 2. 3. c", "", ["a", "", "c"], ["1", "2", "3"], ["empty_event_marker_preserved"]),
        ("- runs\n- runs\n* jumps", "", ["runs", "runs", "jumps"], ["-", "-", "*"], ["duplicate_event_text_preserved"]),
        ("Bối cảnh: một trận bóng. Các sự kiện:\n(1) người vào\n(2) rời hoàn toàn", "một trận bóng", ["người vào", "rời hoàn toàn"], ["(1", "(2"], []),
        ("Please find the following events:\n1) a\n2) b", "", ["a", "b"], ["1", "2"], []),
        ("Setting: a stage 1. one dancer", "a stage", ["one dancer"], ["1"], []),
        ("he has 3. Then he goes", "", ["he has 3", "he goes"], [], []),
        ("Context: a station\na train arrives then doors open", "a station", ["a train arrives", "doors open"], [], []),
        ("a dog in the snow", "", ["a dog in the snow"], [], ["single_event_verbatim_fallback"]),
    ],
)
def test_sequences_keep_every_marker(query, context, texts, labels, warnings):
    p = parse.parse_sequence(query)
    assert (p.context, [e.text for e in p.events], [e.index for e in p.events]) == (context, texts, list(range(len(texts))))
    assert [e.label.strip("-*") for e in p.events if labels] == [x.strip("-*") for x in labels] and list(p.warnings) == warnings
    assert p.complete == all(texts)


@pytest.mark.parametrize(
    ("text", "boundary"),
    [
        ("she fully leaves the frame", "first_leave"), ("con rồng rời hoàn toàn", "first_leave"), ("the ball at its highest", "peak"), ("his foot touches the ground", "first_contact"), ("he is touching the wall", "state"),
        ("the first moment he is touching the wall", "first_contact"), ("he starts to run", "first_transition"), ("the first time the door opens", "first_transition"), ("the first man on the left", "first_transition"), ("the first of the men", "unknown"),
        ("he is running", "state"), ("she remains seated", "state"), ("khoảnh khắc đầu tiên hai người cúi chào", "first_transition"), ("lần đầu tiên nhấc chân", "first_transition"), ("a man enters", "unknown"), ("", "unknown"),
    ],
)
def test_boundaries(text, boundary):
    assert parse.boundary_of(text) == boundary


def test_protected_terms_and_typos():
    p = parse.parse_sequence("E1: Khoảnh khắc đầu tiên hai người cuối chào")
    assert p.events[0].text == "Khoảnh khắc đầu tiên hai người cúi chào" and p.events[0].protected == ("đầu tiên", "cúi chào")
    assert parse.protected_terms("at the peak the dragon touches cột số 3, first") == ("first", "peak", "touches", "cột số 3")


def test_an_empty_slot_finds_nothing(spark):
    frames = spark.createDataFrame([(i, f"a dog runs {i}", "v", float(i), "s", i) for i in range(4)], "frame_id long, caption string, video_id string, ts double, shot_id string, frame_index long")
    engine = Engine(frames)
    assert engine.search("1. dog 2. runs", "trake").count() > 0
    assert engine.search("1. dog 2. 3. runs", "trake").count() == 0


def test_search(spark):
    frames = spark.createDataFrame(
        [("V1", 1, 10, 1.0, "s1", "a person cooking"), ("V1", 2, 20, 2.0, "s1", "a person cooking rice"), ("V1", 3, 30, 9.0, "s2", "a dog runs"), ("V2", 4, 40, 1.0, "s3", "a dog sleeps")],
        "video_id string, frame_id long, frame_index long, ts double, shot_id string, caption string",
    )
    vectors = spark.createDataFrame([(1, [0.8, 0.6]), (3, [1.0, 0.0])], "row long, embedding array<double>")
    e = Engine(frames, vectors)
    assert e.search("person cooking").first().frame_id == 1
    assert {r.frame_id for r in e.search("person cooking", vector=[1.0, 0.0]).collect()} == {1, 2, 3}
    assert [r.shot_id for r in e.search("person cooking", "avs").collect()] == ["s1"]
    top = e.search("dog", "qa", constraints={"actions": ["sleeps"]}).first()
    assert (top.evidence_id, top.frame_id) == ("E001", 4)
    got = e.search("1. person cooking 2. dog runs", "trake").collect()
    assert [list(r.frames) for r in got if r.rank == 1][0][-1] == 30 and {r.video_id for r in got} == {"V1"}
    assert e.search("").count() == 0
    with pytest.raises(ValueError):
        e.search("x", "other")


def test_stored_index_adds_segments_and_prunes(spark, tmp_path):
    from lumenframe.operators import lexical as L
    from lumenframe.sources import textindex

    docs = spark.createDataFrame([(1, "a man walks walks"), (2, "dogs bark"), (3, None), (4, ""), (5, "the dog walked")], "frame_id long, caption string")
    path = f"file://{tmp_path}/index"
    textindex.publish(docs.where("frame_id < 4"), path)
    with pytest.raises(ValueError):  # a key that is there already, and one twice in a segment
        textindex.publish(docs.where("frame_id = 2"), path, add=True)
    with pytest.raises(ValueError):
        textindex.publish(docs.unionByName(docs), f"{path}2")
    assert textindex.postings(spark, path).select("frame_id").distinct().count() == 2
    textindex.publish(docs.where("frame_id >= 4"), path, add=True)
    own = {r.frame_id: (round(r.bm25, 9), r.matched) for r in textindex.search(spark, path, ["walk", "dog"]).collect()}
    assert own == {r.frame_id: (round(r.bm25, 9), r.matched) for r in L.search(docs, ["walk", "dog"]).collect()} and set(own) == {1, 2, 5}
    plan = textindex.postings(spark, path, ["walk"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    textindex.publish(docs.limit(0), f"{path}3")
    assert textindex.search(spark, f"{path}3", ["walk"]).count() == 0


def test_engine_with_a_stored_index(spark, tmp_path):
    from lumenframe.plans.engine import Engine
    from lumenframe.sources import textindex

    frames = spark.createDataFrame([(k, "v", k, float(k), f"s{k // 2}", c) for k, c in enumerate(["a dog runs", "a red car", "the dog and a car", "rain"])], "frame_id long, video_id string, frame_index long, ts double, shot_id string, caption string")
    path = f"file://{tmp_path}/index"
    textindex.publish(frames, path)
    assert Engine(frames, index=path).search("dog car").collect() == Engine(frames).search("dog car").collect()


def test_regions(spark):
    from pyspark.sql import functions as F

    from lumenframe.operators import regions as G

    rows = spark.createDataFrame([("Café\u0000  ở đây\n", 0.9, None), (" \t", 0.9, "en"), ("low", 0.2, None), (None, 0.9, None), ("plain", 0.5, ""), ("東京", 0.7, None)], "text string, confidence double, language string")
    got = {r.text: (r.unaccented_text, r.language) for r in G.text_regions(rows, 0.5).collect()}
    assert got == {"Café ở đây": ("Cafe o day", "vi"), "plain": ("plain", "en"), "東京": ("東京", None)}
    size = (F.lit(100.0), F.lit(50.0))
    shape = lambda points: G.polygon_geometry(F.lit(points).cast("array<array<double>>") if points is None else F.array(*[F.array(*map(F.lit, p)) for p in points]), *size)
    one = spark.range(1).select(shape([(-10.0, 0.0), (50.0, 0.0), (50.0, 80.0)]).alias("p"), shape(None).alias("n"), G.box_area(F.array(*map(F.lit, (90.0, 0.0, 10.0, 9.0))), *size).alias("b")).first()
    assert tuple(one.p) == (0.5, 0.25, 0.5) and one.n is None and one.b == 0.0
    with pytest.raises(Exception, match="three points"):
        spark.range(1).select(shape([(0.0, 0.0), (1.0, 1.0)]).alias("p")).collect()


def test_stems_among_terms_are_those_of_all_stems(spark):
    from lumenframe.functions import text as X

    texts = ["The cities' city-men went, gone; going GOES", "Straße strassen runs running ran run", "boxes boxed boxing e-mails éclairs x", "carried carries carry left leaves leaving lying", "", None, "y ys 2nd 3ds naïve naïves"]
    terms = ["city", "man", "go", "strass", "strassen", "run", "box", "carry", "leav", "leave", "lie", "y", "3ds", "naïves"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.stems_of(F.col("t")).alias("a"), X.stems_among(F.col("t"), terms).alias("b")).collect()
    assert [r.b for r in rows] == [[s for s in r.a if s in terms] for r in rows] and rows[0].b == ["city", "city", "man", "go", "go"]
