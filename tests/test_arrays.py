"""Golden values of similarity, heat-maps, frames, colours, paths and scans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions import colors, geometry, nested, paths, vectors
from framelake.operators import agreement, annotations, frames, heatmaps, losses, masks, projections, scans, similarity
from framelake.operators.udfs import equal_lengths, map_columns, predict_features

#: Integer vectors of whole length, so that cosines are fractions.
FEATURES = [
    [[3.0, 4.0], [5.0, -12.0], [-8.0, 6.0], [0.0, 2.0]],
    [[4.0, 3.0], [-3.0, 4.0], [12.0, 5.0], [0.0, -1.0]],
    [[-7.0, 24.0], [8.0, 15.0], [2.0, 0.0], [-4.0, -3.0]],
]
#: Cosines of the first patch with those of the next frame.
FIRST = [24 / 25, 7 / 25, 56 / 65, -4 / 5]


def soft(values):
    e = np.exp(np.asarray(values) - np.max(values))
    return e / e.sum()


def feature_rows(spark):
    rows = [(0, t, p, v) for t, frame in enumerate(FEATURES) for p, v in enumerate(frame)]
    return spark.createDataFrame(rows, "video long, frame long, patch long, feature array<double>")


@pytest.mark.parametrize("block", [1, 3, 128])
def test_affinity_and_target(spark, block):
    rows = similarity.affinity(feature_rows(spark), block=block).orderBy("frame", "patch").collect()
    assert len(rows) == 8
    assert rows[0]["affinity"] == pytest.approx(FIRST)
    unit = [np.array(f) / np.linalg.norm(f, axis=1, keepdims=True) for f in FEATURES]
    for r in rows:
        assert r["affinity"] == pytest.approx(list(unit[r["frame"]][r["patch"]] @ unit[r["frame"] + 1].T))


def test_heatmaps_match_golden(spark):
    logits = spark.createDataFrame([(0, 0, 0, [0.5, -1.0, 2.0, 0.0])], "video long, frame long, patch long, logits array<double>")
    row = similarity.frame_heatmaps(feature_rows(spark), logits, use_softmax=True).first()
    target, prediction = soft(FIRST), soft([0.5, -1, 2, 0])
    assert row["target"] == pytest.approx(list(target))
    assert row["prediction"] == pytest.approx(list(prediction))
    assert row["difference"] == pytest.approx(list(prediction - target))


def test_target_padding_rules(spark):
    row = spark.range(1).select(
        similarity.target_transform(F.array(F.lit(0.9), F.lit(0.1), F.lit(0.5)), F.lit(0), 0.5, 0.2, True, False).alias("plain"),
        similarity.target_transform(F.array(F.lit(0.1), F.lit(0.0)), F.lit(5), 0.5, 0.2, False, True).alias("uniform"),
        vectors.softmax(F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0))).alias("masked"),
    ).first()
    assert row["plain"] == pytest.approx([-2.0, -4.0, 1.0])
    assert row["uniform"] == pytest.approx([0.5, 0.5])
    assert row["masked"] == pytest.approx([0.5, 0.0, 0.5])


def test_agreement_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows, reference = [], []
    for video in range(2):
        for patch in range(6):
            a, t, p = rng.normal(size=12), soft(rng.normal(size=12)), soft(rng.normal(size=12))
            rows.append((video, 0, patch, a.tolist(), t.tolist(), p.tolist()))
            reference.append((a, t, p))
    df = spark.createDataFrame(rows, "video long, frame long, patch long, affinity array<double>, target array<double>, prediction array<double>")
    out = agreement.summarize_rollup(
        agreement.row_statistics(df),
        [*agreement.error_columns(), *agreement.divergence_columns(), *agreement.correlation_columns(), *agreement.topk_columns()],
    ).filter("video = -1").first()
    mean = lambda f: np.mean([f(*r) for r in reference])
    assert out["n_rows"] == 12 and out["n_elements"] == 144
    assert out["target_prediction_mae"] == pytest.approx(mean(lambda a, t, p: np.abs(p - t).mean()))
    assert out["affinity_target_rmse"] == pytest.approx(math.sqrt(mean(lambda a, t, p: ((t - a) ** 2).mean())))
    assert out["kl"] == pytest.approx(mean(lambda a, t, p: (t * np.log(t / p)).sum()))
    assert out["tv"] == pytest.approx(mean(lambda a, t, p: np.abs(p - t).sum() / 2))
    assert out["prob_corr"] == pytest.approx(mean(lambda a, t, p: np.corrcoef(t, p)[0, 1]))
    assert out["top5"] == pytest.approx(mean(lambda a, t, p: t.argmax() in np.argsort(-p)[:5]))
    assert out["pred_at_target_top1"] == pytest.approx(mean(lambda a, t, p: p[t.argmax()]))


def test_similarity_options(spark):
    default = spark.range(1).select(similarity.similarity_options(F.lit("{}")).alias("o")).first()["o"]
    assert (default["time_shift"], default["softmax"], default["threshold"]) == (1, True, None)
    assert default["remove_last_n_frames"] == 1
    scale = spark.range(1).select(similarity.fixed_scale_options(F.lit("{}")).alias("s")).first()["s"]
    assert (scale["probability_max"], scale["difference_abs_max"]) == (0.4, 0.25)
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(similarity.fixed_scale_options(F.lit('{"fixed_probability_max": 0}')).alias("s")).collect()


def test_slice_resolution():
    assert projections.resolve_slice(9, 4, loss_dims=(3, 7)) == (3, 7)
    assert [projections.resolve_slice(n, 4) for n in (4, 8, 5)] == [(0, 4), (4, 8), (0, 4)]
    for bad in ((3, 2), (0, 5), (0, 3), (6, 10)):
        with pytest.raises(ValueError):
            projections.resolve_slice(8, 4, configured=bad)
    with pytest.raises(ValueError):
        projections.resolve_slice(3, 4)


def test_relative_scale_of_flat_rows(spark):
    row = spark.range(1).select(
        heatmaps.scale_relative(F.array(F.lit(0.3), F.lit(0.3)), "target").alias("flat"),
        heatmaps.scale_relative(F.array(F.lit(0.0), F.lit(0.0)), "difference").alias("zero"),
        heatmaps.scale_fixed(F.array(F.lit(0.8), F.lit(0.2)), "prediction", 0.4, 0.25).alias("fixed"),
    ).first()
    assert (row["flat"], row["zero"], row["fixed"]) == ([0.5, 0.5], [0.5, 0.5], [1.0, 0.5])


def test_atlas(spark):
    rows = spark.createDataFrame([(0, 0, 4, [0.0, 0.5, 1.0, 0.0, 0.0, 1.0])], "video long, frame long, patch long, t array<double>")
    tile = heatmaps.atlas_tiles(rows, "t", (2, 3), "prediction").first()
    assert (tile["tile_y"], tile["tile_x"]) == (2, 3)
    assert tuple(tile["tile"][0]) == (19, 60, 85) and tuple(tile["tile"][2]) == (214, 95, 66)
    y, x = geometry.atlas_position(F.lit(4), F.lit(5), 2, 3)
    assert tuple(spark.range(1).select(y, x).first()) == (3, 5)


def test_colors(spark):
    palette = spark.range(4).select(colors.hex_color(colors.palette_color(F.col("id"))).alias("c"))
    assert [r["c"] for r in palette.collect()] == ["#000000", "#800000", "#008000", "#808000"]
    t = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (2.0,)], "t double")
    ramp = [tuple(r["c"]) for r in t.select(colors.color_ramp(F.col("t"), colors.DIVERGING).alias("c")).collect()]
    assert ramp == [(49, 95, 157), (49, 95, 157), (245, 246, 241), (214, 95, 66), (214, 95, 66)]


def test_geometry(spark):
    row = spark.range(1).select(
        geometry.patch_grid(F.lit(8), F.lit(16), F.lit(32)).alias("wide"),
        geometry.patch_grid(F.lit(9), F.lit(16), F.lit(32)).alias("square"),
        geometry.short_side_size(F.lit(480), F.lit(854), 224).alias("short"),
        geometry.center_offset(F.lit(5), F.lit(4)).alias("even"),
    ).first()
    assert tuple(row["wide"]) == (2, 4) and tuple(row["square"]) == (3, 3)
    assert tuple(row["short"]) == (224, 398) and row["even"] == 0
    assert geometry.boundary_dilation(32, 32) == 1
    with pytest.raises(Exception, match="no patch grid"):
        spark.range(1).select(geometry.patch_grid(F.lit(7), F.lit(16), F.lit(16)).alias("g")).collect()


def test_patchify_identity(spark):
    rows = [(0, y, x, c, float(y == x)) for y in range(4) for x in range(4) for c in range(3)]
    pixels = spark.createDataFrame(rows, "image long, y long, x long, channel long, value double")
    first = frames.patchify(pixels, ["image"], 2, 4).orderBy("patch").first()
    assert first["values"] == [1, 1, 1, 0, 0, 0, 0, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("out", [(4, 4), (2, 3), (9, 5)])
def test_nearest_resize_covers_every_output_pixel(spark, out):
    rows = [(0, y, x, y * 10 + x) for y in range(4) for x in range(4)]
    mask = spark.createDataFrame(rows, "sample long, y long, x long, class long")
    got = {(r["y"], r["x"]): r["class"] for r in masks.resize_nearest(mask, (4, 4), out).collect()}
    source = lambda o, n: min(int((o + 0.5) * 4 / n), 3)
    assert got == {
        (y, x): source(y, out[0]) * 10 + source(x, out[1]) for y in range(out[0]) for x in range(out[1])
    }


def test_bilinear_keeps_constants_and_identity(spark):
    rows = [(0, y, x, float(y * 3 + x)) for y in range(3) for x in range(3)]
    image = spark.createDataFrame(rows, "k long, y long, x long, value double")
    same = {(r["y"], r["x"]): r["value"] for r in frames.resize_bilinear(image, ["k"], (3, 3), (3, 3)).collect()}
    assert same == pytest.approx({(y, x): v for _, y, x, v in rows})
    flat = frames.resize_bilinear(image.withColumn("value", F.lit(2.0)), ["k"], (3, 3), (7, 2)).collect()
    assert len(flat) == 14 and all(r["value"] == pytest.approx(2.0) for r in flat)


def test_float_frames_are_scaled_by_their_peak(spark):
    rows = [(0, 0, 0, 0.5), (0, 0, 1, 1.0), (1, 0, 0, 51.0), (1, 0, 1, 255.0)]
    pixels = spark.createDataFrame(rows, "f long, y long, x long, value double")
    got = [r["value"] for r in frames.unit_scale(pixels, "value", ["f"]).orderBy("f", "x").collect()]
    assert got == pytest.approx([0.5, 1.0, 0.2, 1.0])


def test_run_lengths(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [0, 4]), (3, [])], "id long, counts array<bigint>")
    areas = {r["id"]: r["a"] for r in df.select("id", annotations.rle_area(F.col("counts")).alias("a")).collect()}
    assert areas == {1: 2, 2: 4, 3: 0}
    cells = sorted(map(tuple, annotations.rle_decode(df, ["id"], F.lit(2)).collect()))
    # Runs go down the columns of a 2-row mask.
    assert cells == [(1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 0, 1), (2, 1, 0), (2, 1, 1)]


def test_mean_area_and_filters(spark):
    row = spark.range(1).select(
        annotations.mean_area(F.array(F.lit(2.0), F.lit(None).cast("double"), F.lit(0.0), F.lit(4.0))).alias("m"),
        annotations.mean_area(F.array().cast("array<double>")).alias("none"),
    ).first()
    assert (row["m"], row["none"]) == (3.0, 0.0)
    rows = spark.createDataFrame([(1, "a", 5.0, 0), (2, "b", 9.0, 1)], "video_id long, category_id string, avg_area double, iscrowd long")
    assert annotations.annotations_filter(rows).count() == 2
    assert annotations.annotations_filter(rows, area_range=(5.0, 10.0)).count() == 1
    assert annotations.annotations_filter(rows, iscrowd=True).count() == 1
    videos = rows.select("video_id")
    with pytest.raises(Exception, match="ground truth"):
        annotations.require_known_videos(rows, videos.filter("video_id = 1")).collect()


def test_paths_and_shards(spark):
    df = spark.createDataFrame([(3,), (12345,), (1234567,)], "e long")
    got = [r[0] for r in df.select(paths.episode_path("d/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", F.col("e"))).collect()]
    assert got == [
        "d/chunk-000/episode_000003.parquet",
        "d/chunk-012/episode_012345.parquet",
        "d/chunk-1234/episode_1234567.parquet",
    ]
    assert paths.expand_shards("x-{08..11}.tar", "/data") == [f"/data/x-{i:02d}.tar" for i in range(8, 12)]
    assert paths.expand_shards(["/a.tar", ["s3://b/{0..1}.tar"]]) == ["/a.tar", "s3://b/0.tar", "s3://b/1.tar"]
    with pytest.raises(ValueError):
        paths.expand_shards("x.tar")


def test_nested_paths(spark):
    df = spark.createDataFrame([({"b": [1, 2]},)], "a struct<b: array<int>>")
    assert df.select(nested.read_path(df.schema, "a.b.1")).first()[0] == 2
    assert df.select(nested.read_path(df.schema, "a.c", strict=False)).first()[0] is None
    with pytest.raises(ValueError):
        nested.read_path(df.schema, "a.c")
    with pytest.raises(Exception, match="is null"):
        df.select(nested.read_path(df.schema, "a.b.7")).collect()
    written = df.withColumn(*nested.write_path("a.n", F.lit(5)))
    assert written.first()["a"]["n"] == 5


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_id long, `video.npy` long, other long")
    assert projections.select_by_prefix(df, ["video"]).columns == ["_id", "video.npy"]
    assert projections.strip_extensions(df).columns == ["_id", "video", "other"]
    with pytest.raises(KeyError):
        projections.rename_columns(df, {"absent": "x"})
    features = F.create_map(
        F.lit("t"), F.struct(F.lit("float32").alias("dtype")), F.lit("cam"), F.struct(F.lit("video").alias("dtype"))
    )
    assert df.select(projections.choose_camera(features)).first()[0] == "cam"
    with pytest.raises(Exception, match="not found"):
        df.select(projections.choose_camera(features, "other")).collect()
    kept = df.select(projections.filter_map_by_prefix(F.create_map(F.lit("video.npy"), F.lit(1), F.lit("x"), F.lit(2)), ["video"])).first()[0]
    assert kept == {"video.npy": 1}


OUT = T.StructType([T.StructField("state", T.DoubleType()), T.StructField("state_next", T.DoubleType())])


def add_step(state, value, t):
    return {"state": state, "state_next": state + value}


def test_scan_over_ones(spark):
    ones = spark.range(12).selectExpr("id div 4 as seq", "id % 4 as t", "1.0D as v")
    for df in (
        scans.scan_sum(ones, ["seq"], "t", "v", bucket_width=2),
        scans.scan_steps(ones, ["seq"], "t", "v", add_step, 0.0, OUT),
    ):
        rows = df.orderBy("seq", "t").collect()
        assert [r["state"] for r in rows] == [0, 1, 2, 3] * 3
        assert [r["state_next"] for r in rows] == [1, 2, 3, 4] * 3


def test_udfs(spark):
    df = spark.range(4).selectExpr("id", "id * 1.0D as v")
    doubled = map_columns(df, {"v": (lambda s: s * 2, T.DoubleType())})
    assert [r["v"] for r in doubled.orderBy("id").collect()] == [0, 2, 4, 6]
    with pytest.raises(KeyError):
        predict_features(df, len, T.DoubleType())
    short = predict_features(df, lambda batch: [0.0] * 99, T.DoubleType(), ["id"])
    with pytest.raises(Exception, match="predictor gave"):
        short.coalesce(1).collect()
    assert equal_lengths(df, "id", [df.filter("id > 0")]).count() == 1


def test_losses(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.5, 0.5])], "a array<double>, b array<double>")
    assert losses.reconstruction_mse(df, "a", "b").first()["mse"] == pytest.approx((0.25 + 2.25) / 2)
    expected = -(np.log(soft([1, 2])) * 0.5).sum()
    assert losses.soft_cross_entropy(df, "a", "b").first()[0] == pytest.approx(expected)
    named = spark.createDataFrame([(0, "x", 1.0), (0, "y", 5.0)], "k long, loss string, value double")
    assert losses.weighted_total(named, {"x": 2.0, "y": 0.0}, ["k"]).first()["total"] == 2.0
    with pytest.raises(Exception, match="no weight"):
        losses.weighted_total(named, {"x": 2.0}, ["k"]).collect()
