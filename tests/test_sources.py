"""Round trips and error paths of the readers and writers, on generated folders."""

import io
import json
import tarfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from framelake.operators import projections, sampling
from framelake.operators.numbering import dense_index, int_bucket
from framelake.plans import jobs, views
from framelake.sources import cache_store, files, metadata, synthetic, tar_shards

CAMERA = "observation.images.image"
LENGTHS = [3, 2]


@pytest.fixture
def dataset(tmp_path):
    root = tmp_path / "dataset"
    (root / "meta").mkdir(parents=True)
    (root / "data" / "chunk-000").mkdir(parents=True)
    info = {
        "codebase_version": "v2.1", "robot_type": "arm", "total_episodes": 2, "total_frames": 5, "total_tasks": 1,
        "total_videos": 2, "total_chunks": 1, "chunks_size": 1000, "fps": 10, "splits": {"train": "0:2"},
        "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "video_path": None,
        "features": {
            CAMERA: {"dtype": "video", "shape": [4, 4, 3], "names": ["height", "width", "rgb"]},
            "timestamp": {"dtype": "float32", "shape": [1], "names": None},
        },
    }
    (root / "meta" / "info.json").write_text(json.dumps(info, indent=2))
    lines = [json.dumps({"episode_index": i, "tasks": ["stack"], "length": n}) for i, n in enumerate(LENGTHS)]
    (root / "meta" / "episodes.jsonl").write_text("\n\n".join(lines) + "\n")
    start = 0
    for episode, n in enumerate(LENGTHS):
        table = pa.table(
            {
                "timestamp": [f / 10 for f in range(n)],
                "frame_index": list(range(n)),
                "episode_index": [episode] * n,
                "index": list(range(start, start + n)),
                "task_index": [0] * n,
            }
        )
        pq.write_table(table, root / "data" / "chunk-000" / f"episode_{episode:06d}.parquet")
        start += n
    return root


def test_dataset_metadata(spark, dataset):
    root = str(dataset)
    info = metadata.read_info(spark, root)
    row = info.select("root", "fps", projections.camera_keys(F.col("features")).alias("cameras")).first()
    assert (row["root"], row["fps"], row["cameras"]) == (root, 10.0, [CAMERA])
    episodes = metadata.read_episodes(spark, root).orderBy("episode_index").collect()
    assert [(r["dataset_from_index"], r["dataset_to_index"]) for r in episodes] == [(0, 3), (3, 5)]
    assert metadata.read_tasks(spark, root).count() == 0
    (dataset / "meta" / "tasks.jsonl").write_text('{"task_index": 0, "task": "stack"}\n\n')
    assert [r["task"] for r in metadata.read_tasks(spark, root).collect()] == ["stack"]


def test_frame_scan_prunes_episodes(spark, dataset):
    root = str(dataset)
    assert metadata.read_frames(spark, root).count() == 5
    some = metadata.read_frames(spark, root, [1])
    assert some.count() == 2
    assert [f.rpartition("/")[2] for f in some.inputFiles()] == ["episode_000001.parquet"]
    assert "In(episode_index" not in some._jdf.queryExecution().toString()
    (dataset / "data" / "chunk-000" / "episode_000000.parquet").write_bytes(b"not opened")
    assert {r["episode_index"] for r in metadata.read_frames(spark, root, [1, 1]).collect()} == {1} and some.count() == 2
    assert metadata.read_frames(spark, root, []).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        metadata.read_frames(spark, root, [1, 7])


def test_frame_scan_filters_files_of_many_episodes(spark, dataset):
    root = str(dataset)
    info = json.loads((dataset / "meta" / "info.json").read_text())
    (dataset / "meta" / "info.json").write_text(json.dumps(info | {"data_path": "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"}))
    some = metadata.read_frames(spark, root, [1])
    assert some.count() == 2 and "episode_index" in some._jdf.queryExecution().toString().partition("PushedFilters")[2]
    chosen = spark.createDataFrame([(0,)], "episode_index long")
    assert metadata.read_frames(spark, root, chosen).count() == 3


def test_layouts(spark, dataset, tmp_path):
    assert metadata.resolve_layout(spark, "2.1", None) == "v2"
    assert metadata.resolve_layout(spark, "v3.0", str(dataset)) == "v3"
    assert metadata.resolve_layout(spark, "auto", str(dataset)) == "v2"
    assert metadata.resolve_layout(spark, None, None) == "v3"
    assert metadata.resolve_layout(spark, None, str(tmp_path / "nothing")) == "v3"
    with pytest.raises(ValueError):
        metadata.layout_name("v9")


def test_declared_episode_count_is_checked(spark, dataset):
    with open(dataset / "meta" / "episodes.jsonl", "a") as f:
        f.write(json.dumps({"episode_index": 5, "tasks": [], "length": 1}) + "\n")
    with pytest.raises(ValueError, match="declared run"):
        metadata.read_episodes(spark, str(dataset))


def npy(array):
    buffer = io.BytesIO()
    np.save(buffer, array)
    return buffer.getvalue()


def test_tar_round_trip(spark, tmp_path):
    arrays = {i: np.arange(4, dtype="float32").reshape(2, 2) + i for i in range(10)}
    rows = [(i, f"{i:03d}", {"tensor.npy": bytearray(npy(a)), "note.txt": bytearray(b"x")}) for i, a in arrays.items()]
    samples = spark.createDataFrame(rows, "id long, key string, members map<string, binary>")
    numbered = dense_index(samples, ["id"], int_bucket("id"))
    folder = str(tmp_path / "shards")
    tar_shards.write_shards(sampling.assign_shards(numbered, 4, "s-%06d.tar"), folder)
    back = tar_shards.read_shards(spark, "s-{000000..000002}.tar", data_dir=folder)
    assert back.rdd.getNumPartitions() == 3
    got = back.select("key", "shard", tar_shards.decode_npy(F.element_at("members", "tensor.npy")).alias("a")).collect()
    assert len(got) == 10
    for r in got:
        assert r["shard"].endswith(f"s-{int(r['key']) // 4:06d}.tar")
        assert r["a"]["shape"] == [2, 2] and r["a"]["values"] == arrays[int(r["key"])].ravel().tolist()
    only = tar_shards.read_shards(spark, "s-000000.tar", ("tensor",), folder).first()["members"]
    assert list(only) == ["tensor.npy"]
    assert not [f for f in (tmp_path / "shards").iterdir() if f.name.startswith(".")]
    with pytest.raises(Exception, match="already holds"):
        tar_shards.write_shards(sampling.assign_shards(numbered, 4, "s-%06d.tar"), folder)
    encoded = spark.range(1).select(
        tar_shards.encode_npy(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1), F.lit(2)), F.lit("float16")).alias("b")
    ).first()["b"]
    assert np.load(io.BytesIO(encoded)).tolist() == [[1.0, 2.0]]


def test_tar_with_folders_and_plain_reader(spark, tmp_path):
    path = tmp_path / "x.tar"
    with tarfile.open(path, "w") as archive:
        for name in ("a/1.image.jpg", "a/1.cls", "b/1.cls"):
            info = tarfile.TarInfo(name)
            info.size = 1
            archive.addfile(info, io.BytesIO(b"z"))
    rows = tar_shards.read_shards(spark, str(path)).orderBy("key").collect()
    assert [(r["key"], sorted(r["members"])) for r in rows] == [("a/1", ["cls", "image.jpg"]), ("b/1", ["cls"])]


def test_annotation_file(spark, tmp_path):
    path = tmp_path / "ann.json"
    path.write_text(
        json.dumps(
            {
                "videos": [{"id": 1, "width": 4, "height": 2, "length": 2, "file_names": ["a", "b"]}],
                "annotations": [
                    {"id": 7, "video_id": 1, "category_id": 3, "iscrowd": 0, "segmentations": [{"size": [2, 4], "counts": [0, 3, 5]}, None]}
                ],
                "categories": [{"id": 3, "name": "cat", "supercategory": "animal"}],
            },
            indent=1,
        )
    )
    tables = files.read_annotations(spark, str(path))
    assert {name: df.count() for name, df in tables.items()} == {"videos": 1, "annotations": 1, "categories": 1}
    assert tables["annotations"].first()["segmentations"][0]["counts"] == [0, 3, 5]


def test_frame_folders(spark, tmp_path):
    for folder, extension in (("JPEG", "jpg"), ("Masks", "png")):
        for video in ("bear", "dog"):
            (tmp_path / folder / video).mkdir(parents=True)
            for i in range(2):
                (tmp_path / folder / video / f"{i:05d}.{extension}").write_bytes(b"x")
    (tmp_path / "train.txt").write_text("bear\n")
    (tmp_path / "val.txt").write_text("dog\n\n")
    at = lambda name: str(tmp_path / name)
    out = files.read_frame_folders(spark, at("JPEG"), at("Masks"), {"train": at("train.txt"), "val": at("val.txt")})
    rows = sorted((r["video"], r["stem"], r["split"]) for r in out.collect())
    assert rows == [("bear", "00000", "train"), ("bear", "00001", "train"), ("dog", "00000", "val"), ("dog", "00001", "val")]
    with pytest.raises(Exception, match="no split list"):
        files.read_frame_folders(spark, at("JPEG"), at("Masks"), {"train": at("train.txt")}).collect()


def test_manifests_and_report(spark, tmp_path):
    for name in ("a-viewer", "b-viewer", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps({"video_name": name, "n_frames": 3}, indent=1))
    assert files.read_manifests(spark, str(tmp_path)).count() == 2
    assert files.read_manifests(spark, str(tmp_path), recursive=True).count() == 3
    first = files.read_manifests(spark, str(tmp_path), limit=1).collect()
    assert [r["video_name"] for r in first] == ["a-viewer"]
    report = spark.range(1).select(*[F.lit(0.5).alias(c) for c in files.REPORT_COLUMNS])
    files.write_report(report, str(tmp_path / "report"))
    text = spark.read.text(str(tmp_path / "report")).collect()
    assert text[0]["value"] == ",".join(files.REPORT_COLUMNS)
    assert text[1]["value"].startswith("0.50000000,")


def test_synthetic_images(spark):
    images = spark.range(5)
    noise = synthetic.random_pixels(images, "id", 8, 8)
    assert noise.count() == 320 and noise.agg(F.min("value") >= 0, F.max("value") < 255).first() == (True, True)
    squares = synthetic.square_images(images, "id", 16, 16, 3, 1)
    assert squares.filter("(label = 0) <> (value = 255)").count() == 0
    again = synthetic.square_images(images, "id", 16, 16, 3, 1)
    assert squares.exceptAll(again).count() == 0


@pytest.fixture
def cache_inputs(spark):
    episodes = spark.createDataFrame(
        [(d, e, 3) for d in range(2) for e in range(4)], "dataset_index long, episode_index long, length long"
    )
    frames = sampling.explode_frames(episodes).drop("length").withColumns(
        {"timestamp": F.col("frame_index") / 10.0, "task_index": F.lit(0).cast("long")}
    )
    info = spark.createDataFrame(
        [(0, "a", "/a", "top", 10.0), (1, "b", "/b", "wrist", 12.0)],
        "dataset_index long, repo_id string, root string, camera_key string, fps double",
    )
    return frames, episodes, info


def predict_ids(batch):
    return [np.full((2, 3), r, dtype="float32").tolist() for r in batch["row_id"]]


def test_cache_round_trip(spark, tmp_path, cache_inputs):
    path = str(tmp_path / "cache")
    build = lambda **kw: jobs.build_feature_cache(
        *cache_inputs, predict_ids, path, (2, 3), num_frames=2, val_fraction=0.25, test_fraction=0.25, target_mb=0.0001, **kw
    )
    build(dtype="float32")
    cache = cache_store.FeatureCache(spark, path)
    assert cache.metadata["complete"] and cache.metadata["num_rows"] == 24
    index = cache.index.orderBy("row_id").collect()
    assert [r["row_id"] for r in index] == list(range(24))
    assert {r["shard_num_rows"] for r in index} == {4} and cache.metadata["num_shards"] == 6
    assert [r["split"] for r in index] == ["train"] * 12 + ["val"] * 6 + ["test"] * 6
    wanted = spark.createDataFrame([(0, 5), (1, 2), (2, 5)], "position long, row_id long")
    got = cache.get_many(wanted).collect()
    assert [(r["position"], r["features"][0][0]) for r in got] == [(0, 5.0), (1, 2.0), (2, 5.0)]
    with pytest.raises(Exception, match="missing row"):
        cache.get_many(spark.createDataFrame([(0, 99)], wanted.schema)).collect()
    key = spark.createDataFrame([("b", 1, 2)], "repo_id string, episode_index long, frame_index long")
    row = cache.lookup(key).first()
    match = [r for r in index if (r["repo_id"], r["episode_index"], r["frame_index"]) == ("b", 1, 2)]
    assert row["row_id"] == match[0]["row_id"]
    with pytest.raises(Exception, match="ambiguous or missing"):
        cache.lookup(key.withColumn("episode_index", F.lit(77).cast("long"))).collect()
    with pytest.raises(FileExistsError):
        build()
    build(dtype="float32", overwrite=True)
    assert cache_store.FeatureCache(spark, path).index.count() == 24


def test_incomplete_cache_is_refused(spark, tmp_path, cache_inputs):
    path = str(tmp_path / "cache")
    with pytest.raises(Exception, match="feature shape"):
        jobs.build_feature_cache(*cache_inputs, predict_ids, path, (9, 3), num_frames=2)
    with pytest.raises(ValueError, match="incomplete"):
        cache_store.FeatureCache(spark, path)
    with pytest.raises(FileNotFoundError):
        cache_store.FeatureCache(spark, str(tmp_path / "none"))


def test_evaluation_pipelines(spark, sf):
    scores = jobs.evaluate_masks(views.true_mask(spark, sf), views.pred_mask(spark, sf)).collect()
    assert {r["metric"] for r in scores} == {"video_ari", "video_mbo"}
    report = jobs.measure_agreement(views.patches(spark, sf), views.logits(spark, sf), use_softmax=True, temperature=0.1)
    assert report.columns == list(files.REPORT_COLUMNS) and report.count() == 5


def test_tar_overwrite_leaves_no_old_shard(spark, tmp_path):
    samples = spark.createDataFrame([(i, f"{i:03d}", {"txt": bytearray(b"x")}) for i in range(9)], "id long, key string, members map<string, binary>")
    folder = str(tmp_path / "shards")
    for rows, shards in ((samples, 3), (samples.filter("id < 2"), 1)):
        numbered = dense_index(rows, ["id"], int_bucket("id"))
        tar_shards.write_shards(sampling.assign_shards(numbered, 3, "s-%06d.tar"), folder, overwrite=True)
        assert len(list((tmp_path / "shards").glob("*.tar"))) == shards


def test_shards_of_an_unfinished_write_are_not_read(spark, tmp_path):
    folder = tmp_path / "shards"
    writer = tar_shards.ShardWriter(str(folder))
    rows = [Row(shard_file=f"s-{i}.tar", key=str(i), members={"txt": b"x"}) for i in range(3)]
    first, lost = writer.write(iter(rows[:2])), writer.write(iter(rows[2:]))
    assert all(f.name.startswith(".") for f in folder.iterdir())
    with pytest.raises(FileNotFoundError, match="no finished shards"):
        tar_shards.committed_shards(str(folder))
    writer.abort([lost, None])
    writer.commit([first, None])
    assert tar_shards.committed_shards(str(folder)) == [f"{folder}/s-0.tar", f"{folder}/s-1.tar"]
    (folder / "s-2.tar").write_bytes(b"half a shard")
    with pytest.raises(Exception, match="not among the committed shards"):
        tar_shards.read_shards(spark, "s-{0..2}.tar", data_dir=str(folder)).collect()
    back = tar_shards.read_shards(spark, "s-{0..1}.tar", data_dir=f"file://{folder}").collect()
    assert sorted((r.key, bytes(r.members["txt"])) for r in back) == [("0", b"x"), ("1", b"x")]


def test_a_manifest_alone_names_shards_where_nothing_is_renamed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tar_shards, "RENAMING", ())
    folder = str(tmp_path / "shards")
    for rows in (4, 2):
        writer = tar_shards.ShardWriter(folder, overwrite=True)
        writer.commit([writer.write(iter([Row(shard_file=f"s-{i}.tar", key=str(i), members={"n": str(rows).encode()}) for i in range(rows)]))])
        shards = tar_shards.committed_shards(folder)
        assert shards == [f"{folder}/s-{i}.tar" for i in range(rows)]
        back = tar_shards.read_shards(spark, shards).collect()
        assert sorted((r.key, bytes(r.members["n"])) for r in back) == [(str(i), str(rows).encode()) for i in range(rows)]
    assert len(list((tmp_path / "shards").glob(".*.tar"))) == 2


def test_many_shards_are_read_in_runs_without_losing_any(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tar_shards, "READERS", 4)
    rows = [(f"s-{i:03d}.tar", 0, f"{i:03d}", {"txt": bytearray(str(i).encode())}) for i in range(10)]
    samples = spark.createDataFrame(rows, "shard_file string, shard_pos long, key string, members map<string,binary>")
    tar_shards.write_shards(samples, str(tmp_path / "many"))
    paths = tar_shards.committed_shards(str(tmp_path / "many"))
    reader = tar_shards.ShardReader({"path": ";".join(paths)})
    parts = reader.partitions()
    assert [len(p.shards) for p in parts] == [3, 3, 3, 1]
    found = [(key, shard, bytes(members["txt"])) for p in parts for key, shard, members in reader.read(p)]
    assert found == [(f"{i:03d}", paths[i], str(i).encode()) for i in range(10)]
    assert sorted(tuple(r)[:2] for r in tar_shards.read_shards(spark, paths).collect()) == [f[:2] for f in found]
