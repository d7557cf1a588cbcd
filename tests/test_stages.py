"""Outside scorers and stages with deadlines."""

import time

import pytest

from lumenframe.operators import scorers as R
from lumenframe.plans import deadlines as D
from lumenframe.plans.engine import Engine


def rows(spark, n=40):
    return spark.createDataFrame([(i % 2, i, float(i), 1 - i / 100, i // 2 + 1, None if i == 4 else f"text {i}") for i in range(n)], "query_id int, candidate int, ts double, score double, rank int, text string")


def _by_number():
    """Scores by the text's number; some rows make it fail in each way that a scorer can. A closure: workers don't see this module."""

    def by_number(items):
        out = []
        for x in items:
            n = int(x["text"].split()[1])
            if n == 7:
                raise RuntimeError("no image")
            out.append(float("nan") if n == 9 else 1.5 if n == 11 else n / 100)
        return out[:-1] if any(x["text"] == "text 13" for x in items) else out

    return by_number


by_number = _by_number()


def test_failures_stay_with_their_rows(spark):
    got = {r.candidate: r for r in R.model_scores(rows(spark).repartition(3), by_number, ["text"], batch=8).collect()}
    assert {i for i, r in got.items() if r.model is None} == {4, 7, 9, 11, 13} == {i for i, r in got.items() if r.reason is not None}
    assert all(got[i].model == i / 100 for i in got if i not in (4, 7, 9, 11, 13))
    assert got[7].reason == "RuntimeError: no image" and "isn't from 0 to 1" in got[9].reason and "gave 0 scores" in got[13].reason and got[0].text == "text 0"
    assert R.model_scores(rows(spark).limit(0), by_number, ["text"]).count() == 0


def test_kept_scores(spark, tmp_path):
    path, log = f"file://{tmp_path}/kept", tmp_path / "calls"

    def counted(items, by_number=by_number):
        with log.open("a") as f:
            f.writelines(f"{x['text']}\n" for x in items)
        return by_number(items)

    some = rows(spark, 12).where("candidate NOT IN (4, 7, 9, 11)")
    first = {r.candidate: r.model for r in R.kept_scores(some, counted, ["text"], path, "m1").collect()}
    assert first == {i: i / 100 for i in (0, 1, 2, 3, 5, 6, 8, 10)}
    asked = len(log.read_text().split("\n"))
    again = R.kept_scores(some.unionByName(some), counted, ["text"], path, "m1").collect()
    assert len(again) == 16 and all(r.model == first[r.candidate] for r in again) and len(log.read_text().split("\n")) == asked
    R.kept_scores(some, counted, ["text"], path, "m2").collect()
    assert len(log.read_text().split("\n")) > asked  # another model, other scores
    bad = R.kept_scores(rows(spark, 12).where("candidate = 7"), counted, ["text"], path, "m1").collect()
    assert bad[0].model is None and bad[0].reason.startswith("RuntimeError")


def test_blending_modes(spark):
    df = rows(spark)
    scores = R.model_scores(df.where("rank <= 20 AND candidate NOT IN (4, 7, 9, 11, 13)").unionByName(df.where("candidate = 7")), by_number, ["text"])
    each = {r.candidate: r for r in R.blended(df, scores, "each").collect()}
    assert each[0].score == pytest.approx(0.8) and each[2].score == pytest.approx(0.8 * 0.98 + 0.2 * 0.02) and each[7].score == pytest.approx(0.93) and each[7].reason == "RuntimeError: no image"
    for q in (0, 1):
        mine = sorted((r for r in each.values() if r.query_id == q), key=lambda r: r["rank"])
        assert [(-r.score, r.ts) for r in mine] == sorted((-r.score, r.ts) for r in mine) and [r["rank"] for r in mine] == list(range(1, 21))
    whole = df.where("query_id = 0 AND candidate <> 4")
    optional = {r.candidate: r for r in R.blended(whole.unionByName(df.where("query_id = 1")), scores, "optional").collect()}
    assert optional[2].status == "passed" and optional[2].score == each[2].score
    assert optional[1].status == "fallback" and all(optional[i].score == pytest.approx(1 - i / 100) and optional[i]["rank"] == i // 2 + 1 for i in range(1, 40, 2))
    assert {r.status for r in R.blended(df, scores, "off").collect()} == {"disabled"}
    with pytest.raises(Exception, match="a required score failed: RuntimeError: no image"):
        R.blended(df.where("candidate = 7"), scores, "required").collect()
    with pytest.raises(ValueError, match="unknown mode"):
        R.blended(df, scores, "maybe")


def _slow():
    def slow(frames):
        for frame in frames:
            time.sleep(60)
            yield frame

    return slow


slow = _slow()


def test_a_slow_stage_ends(spark):
    began = time.monotonic()
    with pytest.raises(D.DeadlineExceeded, match="scan took more than 2 s"):
        D.within(spark, 2, "scan", lambda: spark.range(4).mapInPandas(slow, "id long").count())
    assert time.monotonic() - began < 30
    assert D.within(spark, 30, "scan", lambda: spark.range(4).count()) == 4  # other jobs go on
    with pytest.raises(ZeroDivisionError):
        D.within(spark, 30, "scan", lambda: 1 // 0)


@pytest.fixture(scope="module")
def engine(spark):
    said = ["a dog runs", "a man sits", "a dog sleeps", "a man eats", "a cat", "a bird"]
    frames = spark.createDataFrame([(i, t, f"v{i // 4}", float(i), f"s{i}", i * 25) for i, t in enumerate(said)], "frame_id long, caption string, video_id string, ts double, shot_id string, frame_index long")
    return Engine(frames)


def test_outcomes(spark, engine):
    good = engine.sequence_search("E1: a dog\nE2: a man")
    assert good.status == "passed" and [0, 25] in [r.frames for r in good.rows.collect()] and set(good.seconds) == {"retrieval", "gating", "alignment"}
    assert [tuple(r) for r in good.rows.orderBy("rank").collect()] == [tuple(r) for r in engine.search("E1: a dog\nE2: a man", "trake").orderBy("rank").collect()]
    for query, stage, warning in (("E1: a dog\nE2: a cat", "gating", "no_video_supports_all_events"), ("E1: a dog\nE2:", "gating", "empty_event_marker"), ("E1: a bird\nE2: a cat", "alignment", "no_ordered_sequence")):
        out = engine.sequence_search(query)
        assert (out.status, out.stage) == ("insufficient_support", stage) and warning in out.warnings and (out.rows is None or out.rows.isEmpty())
    assert engine.sequence_search(" ").status == "invalid_query"


def test_a_deadline_is_told(spark, engine, monkeypatch):
    real = engine.event_hits
    monkeypatch.setattr(engine, "event_hits", lambda texts: real(texts).mapInPandas(slow, "event int, frame_id long, score double, rank int"))
    began = time.monotonic()
    out = engine.sequence_search("E1: a dog\nE2: a man", deadline=8.0)
    assert (out.status, out.stage, out.rows) == ("deadline_exceeded", "retrieval", None) and time.monotonic() - began < 50 and "more than 8 s" in out.warnings[-1]
