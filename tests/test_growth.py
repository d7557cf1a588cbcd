"""Steps whose cost must not grow faster than their input."""

import time

import numpy as np

from lumenframe.operators import vectors as Q


def test_novelty_by_parts(spark, monkeypatch):
    """Groups are dealt over parts; the result is that of all pairs."""
    monkeypatch.setattr(Q, "PART", 16)
    monkeypatch.setattr(Q, "TILE", 5)
    g = np.random.default_rng(4)
    m = g.normal(size=(120, 6))
    label = [None if i % 40 == 7 else "big" if i < 90 else f"l{i % 9}" for i in range(120)]
    row = [5 if i in (3, 50) else i for i in range(120)]
    label[119] = "alone"
    df = spark.createDataFrame([(row[i], [float(x) for x in m[i]], label[i]) for i in range(120)], "row long, embedding array<double>, label string")
    most = {}
    for i in range(120):
        for j in range(120):
            if label[i] is not None and label[i] == label[j] and row[i] != row[j]:
                most[row[i]] = max(most.get(row[i], -9e9), float(m[i] @ m[j]))
    want = sorted((row[i], round(1.0 if row[i] not in most else min(1.0, max(0.0, (1 - most[row[i]]) / 2)), 6)) for i in range(120))
    assert sorted((r.row, r.novelty) for r in Q.novelty(df, "label").collect()) == want


def test_captions_of_long_texts():
    """difflib needs minutes for these."""
    from lumenframe.operators.sequences import kept_captions

    g = np.random.default_rng(2)
    words, other = ([f"w{k}" for k in g.integers(0, 977, 12_000)] for _ in range(2))
    edited = [w if k % 400 else "other" for k, w in enumerate(words)]
    began = time.time()
    assert kept_captions([" ".join(words), " ".join(other), " ".join(edited)]) == [0, 1]
    assert time.time() - began < 30


def test_ratio_is_difflibs(monkeypatch):
    import random
    from difflib import SequenceMatcher

    from lumenframe.operators import ratio as R

    chance, yes = random.Random(7), 0
    for size in (30, 100_000):
        monkeypatch.setattr(R, "SMALL", size)
        for _ in range(400):
            letters = chance.choice(["ab", "abcdefghij klmno", "đàé𝒳x"])
            a = [chance.choice(letters) for _ in range(chance.randint(0, 100))]
            b = [c for c in a if chance.random() < 0.96]
            for _ in range(chance.randint(0, 4)):
                b.insert(chance.randint(0, len(b)), chance.choice(letters))
            if len(b) > 20 and chance.random() < 0.3:
                b[2:7], b[12:17] = b[12:17], b[2:7]
            a, b = "".join(a), "".join(b)
            for least in (0.97, 0.92, 0.7):
                want = SequenceMatcher(None, a, b, autojunk=False).ratio() >= least
                yes += want
                assert R.reaches(R.Text(a), R.Text(b), least) == want
    assert yes > 400


def test_filling_many_candidates():
    """Scores of all candidates against all chosen, anew for each choice, took minutes."""
    from lumenframe.operators import selection as P

    g = np.random.default_rng(5)
    m = g.normal(size=(6000, 16))
    pool = [P.Candidate(f"{i:05d}", i / 10, i, i % 11 / 11, f"g{i // 20}" if i % 5 == 0 else None, P._unit(m[i])) for i in range(6000)]
    began = time.time()
    got = P.Selector(pool, [], 600.0, 4.0, 3.0, dedupe=True)
    chosen = []
    got.fill(chosen)
    assert len(chosen) == len({c.id for c in chosen}) == 1800
    assert got.run().status == "satisfied" and time.time() - began < 30
    # each is the best of what is left
    for k in (1, 40, 700):
        have, groups, units = {c.id for c in chosen[:k]}, {c.group for c in chosen[:k] if c.group}, np.stack([c.unit for c in chosen[:k]])
        score = lambda c: P.IMPORTANCE_SHARE * c.importance + P.NOVELTY_SHARE * (0.0 if c.group in groups else max(0.0, (1 - (units @ c.unit).max()) / 2))  # noqa: B023, E731
        assert max(score(c) for c in pool if c.id not in have) - score(chosen[k]) < 1e-12


def test_nearest_clip_without_backward_frames(spark):
    """A window that ends at the last row of a video is gone through anew for each row."""
    from lumenframe.operators import timeline as T

    hits = spark.createDataFrame([(i, "v", float(i)) for i in range(6)], "id long, video_id string, ts double")
    dense = spark.createDataFrame([(1, "v", 1.0), (2, "v", 4.0), (9, "w", 0.0)], "frame_id long, video_id string, ts double")
    found = T.nearest_clip(hits, dense)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 1.0), (1, 1, 0.0), (2, 1, 1.0), (3, 2, 1.0), (4, 2, 0.0), (5, 2, 1.0)]


def test_stems_in_tasks_are_those_of_columns(spark):
    """Each different token of a slice is stemmed once, and a text's postings don't meet others before they are whole."""
    from pyspark.sql import functions as F

    from lumenframe.functions import text as X
    from lumenframe.operators import lexical as L

    ends = ["", "s", "ss", "e", "es", "ies", "ing", "ied", "ed", "sses", "shes", "ches", "xes", "zes", "oes", "tting", "ooed", "y"]
    words = [a + b for a in ("", "a", "st", "run", "stat", "copp", "été", "x1", "thee") for b in ends if a + b] + list(X.STEMS) + ["ß", "đi"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.stem("w").alias("s")).collect()
    assert {r.w: r.s for r in got} == {w: X.stem_of(w) for w in words}
    docs = spark.createDataFrame([(1, "Runs, running ran; runs"), (2, None), (1, "run"), (3, ""), (4, "Đi ßs runs")], "frame_id long, caption string")
    p = L.postings(docs)
    assert "explode" not in p._jdf.queryExecution().toString().lower()
    assert {(r.frame_id, r.stem, r.tf) for r in p.collect()} == {(1, "run", 5), (4, "đi", 1), (4, "sss", 1), (4, "run", 1)}
    assert p.groupBy("frame_id", "stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def nodes(plan, kind):
    """Names of the columns that go into each node of a kind in an optimised plan."""
    found = []
    below = [plan.children().apply(i) for i in range(plan.children().length())]
    if plan.nodeName() == kind:
        found.append([below[0].output().apply(i).name() for i in range(below[0].output().length())])
    return found + [n for b in below for n in nodes(b, kind)]


def test_novelty_windows_hold_no_tokens(spark):
    from lumenframe.operators import timeline as T

    rows = [("v", 1, 0.0, "a b"), ("v", 2, 1.0, ""), ("v", 3, 1.0, "b c"), ("v", 4, 2.0, None), (None, 5, 0.0, "a"), (None, 6, 0.0, "A"), ("v", 1, 0.0, "a b")]
    found = T.caption_novelty(spark.createDataFrame(rows, "video_id string, frame_id long, ts double, caption string"))
    windows = nodes(found._jdf.queryExecution().optimizedPlan(), "Window")
    assert windows and not any("_w" in columns for columns in windows)
    assert sorted((r.frame_id, r.novelty) for r in found.collect()) == [(1, 0.0), (1, 0.5), (2, 1.0), (3, 0.666667), (4, 1.0), (5, 0.5), (6, 0.0)]


def test_search_holds_few_scores(spark, monkeypatch):
    assert Q.CELLS <= 1_000_000  # a task's doubles of one step: 8 MB for each array of them
    monkeypatch.setattr(Q, "CELLS", 40)
    g = np.random.default_rng(9)
    m = g.integers(-2, 3, (90, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(90)], "row long, embedding array<double>")
    asked = df.where("row % 10 = 0").selectExpr("row AS query_id", "embedding AS query")
    for metric in ("l2", "ip"):
        got = {}
        for r in Q.search(df, asked, 7, metric).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.row, r.score))
        for q in range(0, 90, 10):
            score = ((m - m[q]) ** 2).sum(1) if metric == "l2" else m @ m[q]
            first = sorted(range(90), key=lambda i: (score[i] if metric == "l2" else -score[i], i))[:7]
            assert got[q] == [(i, score[i]) for i in first]


def test_regions_meet_python_twice(spark):
    """Once to be composed and once to be taken apart; ASCII texts aren't sent."""
    from lumenframe.operators import regions as G

    rows = [("Café \u0000x", 1.0, None), ("plain  text", 1.0, ""), ("한국", 1.0, None), ("đi", 1.0, None), ("\u0001 ", 1.0, None), ("x", 0.2, None), (None, 1.0, None), ("ñ", 1.0, "es")]
    found = G.text_regions(spark.createDataFrame(rows, "text string, confidence double, language string"), 0.5)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert sorted((r.text, r.unaccented_text, r.language) for r in found.collect() if r.text != "한국") == [("Café x", "Cafe x", "vi"), ("plain text", "plain text", "en"), ("ñ", "n", "es"), ("đi", "di", "vi")]
    assert [r.language for r in found.where("text = '한국'").collect()] == [None]
