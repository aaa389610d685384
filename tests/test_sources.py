"""Files, JSON datasets and indexes."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files


def test_ingest_hashes_files_and_infers_media(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.JPG").write_bytes(b"one")
    (tmp_path / "y.mov").write_bytes(b"two")
    (tmp_path / "z").write_bytes(b"3")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.ingest(spark, str(tmp_path)).collect()}
    assert {k: r.media_type for k, r in rows.items()} == {"x.JPG": "image", "y.mov": "video", "z": "text"}
    assert rows["x.JPG"].content_sha256 == hashlib.sha256(b"one").hexdigest() and rows["y.mov"].size_bytes == 3


def test_jsonl_round_trip_and_corrupt_lines(spark, tmp_path):
    files.write_jsonl(spark.createDataFrame([(1, "x"), (2, "é")], "id int, t string"), str(tmp_path / "out"))
    assert sorted(tuple(r)[:2] for r in files.read_jsonl(spark, str(tmp_path / "out"), "id int, t string").collect()) == [(1, "x"), (2, "é")]
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\nnot json\n')
    rows = files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id int, t string").collect()
    assert sum(r._corrupt_record is not None for r in rows) == 1


def test_video_outputs(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"video_id": "v", "scenes": [{"scene_id": "s1", "start_s": 0, "end_s": 2, "keyframes": [{"frame_id": "f1", "t": 0.5, "score": 0.2}, {"frame_id": "f2", "t": 1.0, "score": 0.9}]}]}, indent=1))
    assert {r.frame_id for r in files.video_keyframes(spark, str(tmp_path / "m.json")).collect()} == {"f1", "f2"}


def test_index_manifest_is_checked(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 0.0])], "asset_id string, vector array<float>")
    files.save_index(v, str(tmp_path), "visual", "m1")
    assert files.load_index(spark, str(tmp_path), "visual", "m1", 2).count() == 1
    with pytest.raises(ValueError):
        files.load_index(spark, str(tmp_path), "visual", "m2", 2)


def test_a_new_index_takes_the_place_of_the_old_one_with_its_manifest(spark, tmp_path):
    for n in (1, 2):
        v = spark.createDataFrame([(f"a{i}", [1.0, 0.0]) for i in range(n)], "asset_id string, vector array<float>")
        files.save_index(v, str(tmp_path), "visual", "m1")
    assert files.load_index(spark, str(tmp_path), "visual", "m1", 2).count() == 2
    spark.createDataFrame([("half", [9.0])], "asset_id string, vector array<float>").write.parquet(f"{tmp_path}/visual/v-crashed")
    assert files.load_index(spark, str(tmp_path), "visual", "m1", 2).count() == 2


def test_only_allowed_folders_are_imported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jpg").write_bytes(b"1")
    assert files.import_folder(spark, str(tmp_path / "in"), (str(tmp_path),)).count() == 1
    for folder in ("/etc", f"{tmp_path}/in/../../etc", f"{tmp_path}x"):
        with pytest.raises(ValueError):
            files.import_folder(spark, folder, (str(tmp_path),))


def test_keyframes_of_a_scene_have_a_budget(spark, tmp_path):
    frames = [{"frame_id": f"f{i}", "t": float(i), "score": s} for i, s in enumerate((0.2, 0.9, 0.9, 0.1))]
    (tmp_path / "m.json").write_text(json.dumps({"video_id": "v", "scenes": [{"scene_id": "s", "start_s": 0, "end_s": 4, "keyframes": frames}]}))
    assert {r.frame_id for r in files.video_keyframes(spark, str(tmp_path / "m.json"), 2).collect()} == {"f1", "f2"}


def test_integrity_and_paths(spark):
    schema = "path string, size_bytes long, content_sha256 string"
    manifest = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("d", 4, "w")], schema)
    found = spark.createDataFrame([("a", 1, "x"), ("b", 9, "y"), ("c", 3, "?"), ("e", 1, "q")], schema)
    assert {(r.path, r.problem) for r in files.integrity(manifest, found).collect()} == {("b", "size"), ("c", "content"), ("d", "missing"), ("e", "unlisted")}
    assets = spark.createDataFrame([("1", "/x/a.jpg"), ("2", "/y/b.jpg"), ("3", "/z/b.jpg")], "asset_id string, path string")
    wanted = spark.createDataFrame([("/x/a.jpg",), ("/moved/a.jpg",), ("/moved/b.jpg",)], "path string")
    assert {r.path: r.asset_id for r in files.resolve_paths(wanted, assets).collect()} == {"/x/a.jpg": "1", "/moved/a.jpg": "1", "/moved/b.jpg": None}
    assert assets.select(files.media_type(F.col("path")).alias("m")).first().m == "image"
