"""Places in an order, ordered digests, and bundles: interrupted, concurrent and tampered with."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.operators.ranks import places
from lumenframe.sources import bundles, files, textindex


@pytest.mark.parametrize("parts", [1, 7])
def test_places(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", None, ""]), rng.randint(0, 50), i) for i in range(500)] + [("hot", i % 3, 1000 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x long, i long").repartition(parts)
    groups = defaultdict(list)
    for g, x, i in rows:
        groups[g].append((-x, i))
    want = {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    assert {r.i: r.place for r in places(df, ["g"], F.desc("x"), "i").collect()} == want
    assert {r.i: r.n for r in places(df, [], F.desc("i"), name="n").collect()} == {i: n for n, i in enumerate(sorted((r[2] for r in rows), reverse=True), 1)}
    assert places(df.limit(0), ["g"], "i").count() == 0


def rows_of(spark, n=3000):
    return spark.createDataFrame([(i // 10, i, f"t{i}" if i % 7 else None) for i in range(n)], "k long, i long, text string")


def numbered(df):
    return places(df, [], "k", "i", name=bundles.ROW).withColumn(bundles.ROW, F.col(bundles.ROW) - 1)


def test_ordered_digest(spark):
    df = numbered(rows_of(spark)).cache()
    told = bundles.ordered_digest(df, ["k", "i"])
    assert told["rows"] == 3000 and told["wrong"] == []
    assert bundles.ordered_digest(df.repartition(13), ["k", "i"]) == told == bundles.ordered_digest(df.coalesce(1), ["k", "i"])
    row = F.col(bundles.ROW)
    swapped = df.withColumn(bundles.ROW, F.when(row == 5, 1029).when(row == 1029, 5).otherwise(row))
    got = bundles.ordered_digest(swapped, ["k", "i"])
    assert got["wrong"] == ["rows are out of order"] and got["digest"] != told["digest"]
    # rows of equal keys may stand in either order, but not change places unnoticed
    within = bundles.ordered_digest(df.withColumn(bundles.ROW, F.when(row == 5, 6).when(row == 6, 5).otherwise(row)), ["k"])
    assert within["wrong"] == [] and within["digest"] != told["digest"]
    # across blocks: the first row of one with the last of the one before
    edge = bundles.ordered_digest(df.withColumn(bundles.ROW, F.when(row == 1023, 1024).when(row == 1024, 1023).otherwise(row)), ["i"])
    assert edge["wrong"] == ["rows are out of order"]
    for broken in (df.where(row != 7), df.where(row < 2999).unionByName(df.where(row == 3)), df.where(row > 0)):
        assert "row numbers are missing or repeated" in bundles.ordered_digest(broken, ["k", "i"])["wrong"]
    assert bundles.ordered_digest(df.where(row < 2000), ["k", "i"])["wrong"] == []
    assert bundles.ordered_digest(df.withColumn("text", F.coalesce("text", F.lit(""))), ["k", "i"])["digest"] != told["digest"]
    assert bundles.ordered_digest(df.limit(0), ["k", "i"]) == {"rows": 0, "digest": "0-0-0-0", "wrong": []}


def tables(spark, n=50, scale=1.0):
    v = spark.createDataFrame([(i, [0.6 * scale, 0.8]) for i in range(n)], "i long, e array<float>")
    return {"frames": bundles.Table(rows_of(spark, n), ("k", "i")), "vectors": bundles.Table(v, ("i",), "e", 2)}


def test_bundle_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    first = bundles.publish(spark, path, tables(spark), "here")
    held = bundles.load(spark, path, "here")
    assert [r.i for r in held["frames"].orderBy(bundles.ROW).collect()] == list(range(50)) and held["vectors"].count() == 50
    assert bundles.publish(spark, path, tables(spark), "here")["generation"] == first["generation"]
    assert bundles.publish(spark, path, tables(spark, 49), "here")["generation"] != first["generation"]
    assert [(r.role, r.rows, r.order, r.dimension) for r in bundles.report(spark, path).collect()] == [("frames", 49, "k,i", None), ("vectors", 49, "i", 2)]
    with pytest.raises(ValueError, match="made from"):
        bundles.load(spark, path, "elsewhere")
    bundles.publish(spark, f"{path}0", {"none": bundles.Table(rows_of(spark).limit(0), ("i",))})
    assert bundles.load(spark, f"{path}0")["none"].count() == 0


def test_broken_vectors_are_not_published(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    bundles.publish(spark, path, tables(spark))
    with pytest.raises(ValueError, match="unit vector"):
        bundles.publish(spark, path, tables(spark, scale=3.0))
    assert bundles.load(spark, path)["frames"].count() == 50
    bundles.publish(spark, path, tables(spark, 3))  # the claim of the failed one is gone
    assert bundles.load(spark, path)["frames"].count() == 3


def test_tampering_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    m = bundles.publish(spark, path, tables(spark))
    folder = f"{path}/{m['folder']}"
    saved = spark.read.parquet(f"{folder}/frames").collect()
    schema = spark.read.parquet(f"{folder}/frames").schema

    def put(rows):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/frames")

    swapped = [(r.k, r.i, r.text, {3: 40, 40: 3}.get(r[bundles.ROW], r[bundles.ROW])) for r in saved]
    for rows, match in ((swapped, "rows are out of order"), ([tuple(r) for r in saved[:-1]], "rows differ"), ([(*r[:2], "other", r[3]) for r in saved], "digest differ")):
        put(rows)
        with pytest.raises(ValueError, match=match):
            bundles.load(spark, path)
    put([tuple(r) for r in saved])
    assert bundles.load(spark, path)["frames"].count() == 50
    files.replace(spark, f"{folder}/vectors.generation", "another")
    with pytest.raises(ValueError, match="vectors is of another generation"):
        bundles.load(spark, path)
    m["tables"]["frames"]["rows"] = 51
    files.replace(spark, f"{path}/CURRENT", json.dumps(m))
    with pytest.raises(ValueError, match="doesn't match the tables"):
        bundles.load(spark, path)


def test_a_manifest_that_changes_meanwhile(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/b"
    bundles.publish(spark, path, tables(spark))
    real = bundles.ordered_digest

    def slow(rows, order):
        told = real(rows, order)
        monkeypatch.setattr(bundles, "ordered_digest", real)
        bundles.publish(spark, path, tables(spark, 7))
        return told

    monkeypatch.setattr(bundles, "ordered_digest", slow)
    with pytest.raises(ValueError, match="changed while"):
        bundles.load(spark, path)
    assert bundles.load(spark, path)["frames"].count() == 7


def test_a_killed_writer_leaves_the_old_bundle(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    bundles.publish(spark, path, tables(spark))
    files.Claim(spark, path).__enter__()  # a writer that never comes back
    rows_of(spark).write.parquet(f"{path}/gen=partial/frames")
    assert bundles.load(spark, path)["frames"].count() == 50
    with pytest.raises(files.Busy, match="is publishing"):
        bundles.publish(spark, path, tables(spark, 3))
    files.abandon(spark, path)
    bundles.publish(spark, path, tables(spark, 3))
    assert bundles.load(spark, path)["frames"].count() == 3


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    bundles.publish(spark, path, tables(spark))
    with files.Claim(spark, path) as mine, pytest.raises(files.Busy):
        bundles.publish(spark, path, tables(spark, 3))
    # one that took the mark away from another: the other can't commit, and doesn't remove the new mark
    with pytest.raises(files.Busy, match="taken over"), files.Claim(spark, path) as mine:
        files.abandon(spark, path)
        files.Claim(spark, path).__enter__()
        mine.commit("{}")
    with pytest.raises(files.Busy, match="is publishing"):
        files.publish(rows_of(spark, 3), path)
    files.abandon(spark, path)
    # one that replaced CURRENT without a mark: nothing of it is lost
    with pytest.raises(files.Busy, match="taken over"), files.Claim(spark, path) as mine:
        files.replace(spark, f"{path}/CURRENT", "{}")
        mine.commit("mine")
    assert files.get(spark, f"{path}/CURRENT") == "{}"


def test_text_index_keeps_both_writers_segments(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    docs = spark.createDataFrame([(i, f"word{i} dog") for i in range(9)], "frame_id long, caption string")
    textindex.publish(docs.where("frame_id < 3"), path)
    real = textindex._segments

    def late(spark, path):
        found = real(spark, path)
        monkeypatch.setattr(textindex, "_segments", real)
        with pytest.raises(files.Busy):
            textindex.publish(docs.where("frame_id >= 6"), path, add=True)
        return found

    monkeypatch.setattr(textindex, "_segments", late)
    textindex.publish(docs.where("frame_id BETWEEN 3 AND 5"), path, add=True)
    textindex.publish(docs.where("frame_id >= 6"), path, add=True)
    assert {r.frame_id for r in textindex.search(spark, path, ["dog"]).collect()} == set(range(9))
