"""Record files of every shape, strict and lenient."""

import json

import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from lumenframe.operators import evaluation as E
from lumenframe.sources import loading as L

SCHEMA = StructType().add("video_id", StringType()).add("frame_id", StringType()).add("timestamp", DoubleType()).add("faiss_index", LongType())


def frame(v, f, **more):
    return {"video_id": v, "frame_id": f, **more}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + "".join(json.dumps(frame("v", f"a{i}", faiss_index=i, extra=[1])) + ("\n\n" if i == 1 else "\n") for i in range(3)).encode())
    (tmp_path / "b.json").write_text("\ufeff" + json.dumps([frame("v", "b0", timestamp=1.5), frame("v", "b1", faiss_index=7)]))
    (tmp_path / "c.json").write_text(json.dumps(frame("v", "c0", faiss_index=9), indent=1))
    (tmp_path / "d.json").write_text(json.dumps({"x": frame("v", "dx"), "10": frame("v", "d10"), "9": frame("v", "d9", faiss_index=99)}))
    return tmp_path


def names(df):
    return [r.frame_id for r in df.collect()]


def test_every_shape_in_order(spark, folder):
    got = L.load(spark, str(folder), SCHEMA, key_field="faiss_index")
    assert names(got.ordered()) == ["a0", "a1", "a2", "b0", "b1", "c0", "d9", "d10", "dx"] and got.skipped.count() == 0
    at = {r.frame_id: r.faiss_index for r in got.rows.collect()}
    assert at == {"a0": 0, "a1": 1, "a2": 2, "b0": None, "b1": 7, "c0": 9, "d9": 99, "d10": 10, "dx": None}
    with pytest.warns(UserWarning, match="2 without faiss_index"):
        some = L.load(spark, str(folder), SCHEMA, strict=False, key_field="faiss_index", require="faiss_index")
    assert set(names(some.rows)) == set(at) - {"b0", "dx"} and {r.reason for r in some.skipped.collect()} == {"without faiss_index"}


@pytest.mark.parametrize(
    ("name", "text", "match"),
    [
        ("z.jsonl", '{"frame_id": "1"}\n\n{"frame_id": \n', "z.jsonl, line 3: not a record"),
        ("z.jsonl", '{"frame_id": "1"}\n[1]\n', "z.jsonl, line 2: not a record"),
        ("z.jsonl", '{"faiss_index": "many"}\n', "z.jsonl, line 1: not a record"),
        ("z.json", '[{"frame_id": "1"}, 3]', "z.json, element 1: not a record"),
        ("z.json", '{"4": {"frame_id": "1"}, "5": "text"}', "z.json, key 5: not a record"),
        ("z.json", "{", "z.json.*: not a record"),
        ("z.json", '"text"', "z.json.*: not a record"),
    ],
)
def test_strict_says_where(spark, folder, name, text, match):
    (folder / name).write_text(text)
    for path in (folder, folder / name):
        with pytest.raises(ValueError, match=match):
            L.load(spark, str(path), SCHEMA)
    with pytest.warns(UserWarning, match="1 not a record"):
        got = L.load(spark, str(folder), SCHEMA, strict=False)
    assert set(names(got.rows)) >= {"a0", "b0", "c0", "dx"} and got.skipped.count() == 1


def test_line_numbers_of_large_files(spark, tmp_path):
    """The number is right where a file is read in several parts."""
    rows = [json.dumps(frame("v", f"f{i}", faiss_index=i)) for i in range(4000)]
    rows[3210] = "{broken"
    (tmp_path / "big.jsonl").write_text("\n".join(rows))
    (tmp_path / "other.jsonl").write_text("\n".join(rows[:3000]))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        with pytest.raises(ValueError, match="big.jsonl, line 3211:"):
            L.load(spark, str(tmp_path), SCHEMA)
        ok = L.load(spark, str(tmp_path / "other.jsonl"), SCHEMA)
        assert names(ok.ordered()) == [f"f{i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_frame_map(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"1": frame("w", "late", timestamp=9.0), "0": frame("w", "early", timestamp=2.0), "2": frame("a", "none")}))
    got = L.load_frame_map(spark, str(tmp_path / "map.json"), SCHEMA).collect()
    assert [(r.frame_id, r.timestamp_source, r.timestamp_confidence) for r in got] == [("none", "unknown", 0.0), ("early", "interval", 0.5), ("late", "interval", 0.5)]


def test_text_sources(spark, tmp_path):
    def of(*made):
        for n in made:
            (tmp_path / n).write_text("{}")
        return [f.rsplit("/", 1)[-1] for f in L.text_sources(spark, str(tmp_path))]

    (tmp_path / "keyframes_v.jsonl").write_text("{}")
    with pytest.raises(FileNotFoundError):
        L.text_sources(spark, str(tmp_path))
    assert of("ocr_v.jsonl", "captions_v.jsonl", "objects_report.jsonl") == ["captions_v.jsonl", "ocr_v.jsonl"]
    assert of("segments_b.jsonl", "segments_a.jsonl") == ["segments_a.jsonl", "segments_b.jsonl"]
    assert of("segments_all.jsonl") == ["segments_all.jsonl"]


def test_frame_map_audit(spark):
    rows = spark.createDataFrame([(0, "a", "x", None), (0, "b", "x", "interval"), (2, "", "x", "interval"), (9, "d", None, "video_fps"), (-1, "e", "x", None)], "id long, caption string, path string, timestamp_source string")
    got = {r.issue: (r.n, r["sample"]) for r in E.frame_map_audit(rows, 4, "id", ("caption", "path")).collect()}
    assert got == {"count_mismatch": (1, []), "missing_index": (2, [1, 3]), "extra_index": (2, [-1, 9]), "repeated_index": (1, [0]), "empty_caption": (1, [2]), "empty_path": (1, [9]), "source_none": (2, [-1, 0]), "source_interval": (2, [0, 2]), "source_video_fps": (1, [9])}
    fixed = E.frame_map_fixed(rows).collect()
    assert {r.timestamp_source for r in fixed} == {"unknown", "interval", "video_fps"} and {r.timestamp_confidence for r in fixed} == {0.0}
    assert E.frame_map_audit(rows.limit(0), 0, "id", ("caption",)).count() == 0
