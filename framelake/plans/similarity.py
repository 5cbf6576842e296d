"""Queries over patch similarities, heat-maps, agreement and losses."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.colors import color_ramp, hex_color, palette_color
from ..functions.geometry import patch_grid, short_side_size
from ..functions.vectors import as_doubles, softmax
from ..operators import agreement, heatmaps, losses
from ..operators import similarity as ops
from . import views as v
from .registry import micros, query, r6, s6, smicros

# A soft target needs a temperature; values of unit vectors lie in [-1, 1].
OPTIONS = {"temperature": 0.1, "threshold": 0.0, "mask_diagonal": True, "use_softmax": True}


def softmax_sql(values: str) -> str:
    """Softmax of a list expression."""
    shifted = f"list_transform({values}, lambda z: exp(z - list_max({values})))"
    return f"list_transform({shifted}, lambda w: w / list_sum({shifted}))"


AFFINITY = {
    "units": "SELECT video, frame, patch, list_transform(feature, lambda x: x / greatest(sqrt(list_inner_product(feature, feature)), 1e-12)) AS u FROM patches",
    "aff": """SELECT s.video, s.frame, s.patch, list(list_inner_product(s.u, t.u) ORDER BY t.patch) AS affinity
      FROM units s JOIN units t ON t.video = s.video AND t.frame = s.frame + 1 GROUP BY ALL""",
    "weights": """SELECT *, list_transform(affinity, lambda x, i: CASE WHEN x < 0 OR i = patch + 1 THEN 0 ELSE exp(x / 0.1) END) AS w FROM aff""",
    "targets": """SELECT video, frame, patch, affinity, CASE WHEN list_sum(w) = 0 THEN list_transform(w, lambda x: 1.0 / len(w))
      ELSE list_transform(w, lambda x: x / list_sum(w)) END AS target FROM weights""",
}
PREDICTED = {
    **AFFINITY,
    "raised": f"SELECT video, frame, patch, feature[1:{v.PATCHES}] AS l FROM patches",
    "weighed": "SELECT video, frame, patch, list_transform(l, lambda z: exp(z)) AS e FROM raised",
    "preds": "SELECT video, frame, patch, list_transform(e, lambda w: w / list_sum(e)) AS prediction FROM weighed",
    "maps": """SELECT video, frame, patch, affinity, target, prediction, list_transform(prediction, lambda p, i: p - target[i]) AS difference
      FROM targets JOIN preds USING (video, frame, patch)""",
}


@query(
    "time_shift_pairs",
    v.with_views("patches")
    + """SELECT a.video, a.frame, a.patch, a.label, b.label AS later_label FROM patches a JOIN patches b
    ON b.video = a.video AND b.patch = a.patch AND b.frame = a.frame + 2""",
)
def time_shift_pairs(spark, sf):
    return ops.time_shift_pairs(v.patches(spark, sf), 2, ["video", "patch"], ["label"])


@query(
    "patch_pairs",
    v.with_views(
        "patches",
        extra={
            "raw": """SELECT s.video, s.frame, s.patch, list(list_inner_product(s.feature, t.feature) ORDER BY t.patch) AS affinity
              FROM patches s JOIN patches t ON t.video = s.video AND t.frame = s.frame + 2 GROUP BY ALL"""
        },
    )
    + f"SELECT video, frame, patch, {smicros('affinity')} AS affinity FROM raw",
)
def patch_pairs(spark, sf):
    """Plain products with all patches two frames later, one array per source patch."""
    out = ops.affinity(v.patches(spark, sf), time_shift=2, normalize=False)
    return out.withColumn("affinity", micros("affinity"))


@query(
    "self_similarity",
    v.with_views(
        "patches",
        extra={
            "units": AFFINITY["units"],
            "own": """SELECT s.video, s.frame, s.patch, list(list_inner_product(s.u, t.u) ORDER BY t.patch) AS a
              FROM units s JOIN units t ON t.video = s.video AND t.frame = s.frame GROUP BY ALL""",
        },
    )
    + f"""SELECT video, frame, patch, {smicros('list_transform(a, lambda x, i: CASE WHEN i = patch + 1 THEN -2.0 WHEN x < 0.1 THEN -4.0 ELSE x / 0.5 END)')} AS similarity FROM own""",
)
def self_similarity(spark, sf):
    """Inside each frame, without a softmax: below the threshold -1/T twice scaled, the diagonal -1/T."""
    own = ops.affinity(v.patches(spark, sf), time_shift=0)
    scaled = ops.target_transform(F.col("affinity"), F.col("patch"), 0.5, 0.1, True, False)
    return own.select("video", "frame", "patch", micros(scaled).alias("similarity"))


@query(
    "time_similarity_target",
    v.with_views("patches", extra=AFFINITY)
    + f"SELECT video, frame, patch, {smicros('affinity')} AS affinity, {smicros('target')} AS target FROM targets",
)
def time_similarity_target(spark, sf):
    out = ops.time_similarity_target(v.patches(spark, sf), **OPTIONS)
    return out.select("video", "frame", "patch", micros("affinity").alias("affinity"), micros("target").alias("target"))


@query(
    "row_softmax",
    v.with_views(
        "patches",
        extra={"raised": "SELECT video, frame, patch, feature AS l FROM patches", "weighed": PREDICTED["weighed"], "preds": PREDICTED["preds"]},
    )
    + f"SELECT video, frame, patch, {smicros('prediction')} AS prediction FROM preds",
)
def row_softmax(spark, sf):
    """Over all components of each vector."""
    rows = v.patches(spark, sf).withColumn("logits", as_doubles("feature"))
    return rows.select("video", "frame", "patch", micros(softmax("logits")).alias("prediction"))


def maps(spark, sf):
    return ops.frame_heatmaps(v.patches(spark, sf), v.logits(spark, sf), **OPTIONS)


@query(
    "frame_heatmaps",
    v.with_views("patches", extra=PREDICTED)
    + f"SELECT video, frame, patch, {', '.join(f'{smicros(c)} AS {c}' for c in ('affinity', 'target', 'prediction', 'difference'))} FROM maps",
)
def frame_heatmaps(spark, sf):
    columns = ("affinity", "target", "prediction", "difference")
    return maps(spark, sf).select("video", "frame", "patch", *[micros(c).alias(c) for c in columns])


SCALED = {
    **PREDICTED,
    "scaled": """SELECT video, frame, patch,
      list_transform(affinity, lambda x: least(greatest((x + 1.0) / 2.0, 0), 1)) AS affinity_t,
      list_transform(target, lambda x: least(greatest(CASE WHEN list_max(target) - list_min(target) > 1e-12
        THEN (x - list_min(target)) / (list_max(target) - list_min(target)) ELSE 0.5 END, 0), 1)) AS target_t,
      list_transform(difference, lambda x: least(greatest((x / list_max(list_transform(difference, lambda d: abs(d))) + 1.0) / 2.0, 0), 1)) AS difference_t,
      list_transform(prediction, lambda x: least(greatest(x / 0.4, 0), 1)) AS prediction_f,
      list_transform(difference, lambda x: least(greatest((x / 0.25 + 1.0) / 2.0, 0), 1)) AS difference_f FROM maps""",
}


@query(
    "heatmap_scale_relative",
    v.with_views("patches", extra=SCALED)
    + f"SELECT video, frame, patch, {', '.join(f'{smicros(c)} AS {c}' for c in ('affinity_t', 'target_t', 'difference_t'))} FROM scaled",
)
def heatmap_scale_relative(spark, sf):
    kinds = ("affinity", "target", "difference")
    return maps(spark, sf).select(
        "video",
        "frame",
        "patch",
        *[micros(heatmaps.scale_relative(F.col(k), k)).alias(f"{k}_t") for k in kinds],
    )


@query(
    "heatmap_scale_fixed",
    v.with_views("patches", extra=SCALED)
    + f"SELECT video, frame, patch, {', '.join(f'{smicros(c)} AS {c}' for c in ('prediction_f', 'difference_f'))} FROM scaled",
)
def heatmap_scale_fixed(spark, sf):
    limits = ops.fixed_scale_options(F.lit("{}"))
    return maps(spark, sf).select(
        "video",
        "frame",
        "patch",
        *[
            micros(heatmaps.scale_fixed(F.col(k), k, limits["probability_max"], limits["difference_abs_max"])).alias(f"{k}_f")
            for k in ("prediction", "difference")
        ],
    )


def ramp_sql(t: str, stops) -> list[str]:
    out = []
    last = len(stops) - 1
    for c in range(3):
        table = "(list_value(" + ", ".join(f"{float(s[c])}::DOUBLE" for s in stops) + "))"
        i = f"least(floor({t} * {last}), {last - 1})::INT"
        out.append(f"CAST(round_even({table}[{i} + 1] + ({table}[{i} + 2] - {table}[{i} + 1]) * ({t} * {last} - {i}), 0) AS INT)")
    return out


@query(
    "color_ramp",
    "WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 AS t FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + ", ".join(
        f"{e} AS {name}_{c}"
        for name, stops in (("heat", heatmaps.SEQUENTIAL), ("diff", heatmaps.DIVERGING))
        for c, e in zip("rgb", ramp_sql("t", stops))
    )
    + " FROM t",
)
def color_ramps(spark, sf):
    """Discounts (0 to 0.1) as heat values."""
    t = F.col("l_discount") * 10
    heat, diff = color_ramp(t, heatmaps.SEQUENTIAL), color_ramp(t, heatmaps.DIVERGING)
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        *[ramp[c].alias(f"{name}_{c}") for name, ramp in (("heat", heat), ("diff", diff)) for c in "rgb"],
    )


def palette_sql(first: int) -> str:
    return " | ".join(f"(((p_partkey >> {first + 3 * j}) & 1) << {7 - j})" for j in range(8))


@query(
    "slot_palette",
    f"SELECT p_partkey AS slot, printf('#%02x%02x%02x', {palette_sql(0)}, {palette_sql(1)}, {palette_sql(2)}) AS color FROM part",
)
def slot_palette(spark, sf):
    return v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("slot"), hex_color(palette_color(F.col("p_partkey"))).alias("color")
    )


@query(
    "atlas_layout",
    v.with_views("patches", extra=AFFINITY)
    + f"""SELECT video, frame, (patch // {v.GRID_W}) * {v.GRID_H} AS tile_y, (patch % {v.GRID_W}) * {v.GRID_W} AS tile_x,
    {smicros('affinity')} AS tile FROM aff""",
)
def atlas_layout(spark, sf):
    """Heat values as atlas tiles."""
    tiles = heatmaps.atlas_tiles(ops.affinity(v.patches(spark, sf)), "affinity", (v.GRID_H, v.GRID_W))
    return tiles.withColumn("tile", micros("tile"))


@query(
    "patch_grid",
    """SELECT doc_id, h, w, n, CAST(floor(sqrt(n / (w / h::DOUBLE))) AS BIGINT) AS grid_h, CAST(floor(sqrt(n * (w / h::DOUBLE))) AS BIGINT) AS grid_w
    FROM (SELECT doc_id, (1 + n_chars % 4) * 16 AS h, (1 + n_chars % 4) * 32 AS w, (1 + n_chars % 4) * (1 + n_chars % 4) * 2 AS n FROM documents)""",
)
def patch_grids(spark, sf):
    """Images twice as wide as high, of sizes taken from the documents, with 16-pixel patches."""
    k = F.pmod("n_chars", F.lit(4)) + 1
    images = v.table(spark, sf, "documents").select(
        "doc_id", (k * 16).alias("h"), (k * 32).alias("w"), (k * k * 2).alias("n")
    )
    return images.select("*", patch_grid("n", "h", "w").alias("g")).select(
        "doc_id", "h", "w", "n", "g.grid_h", "g.grid_w"
    )


@query(
    "short_side_size",
    """SELECT p_partkey, h, w, CASE WHEN w < h THEN CAST(floor(h::DOUBLE / w * 224) AS BIGINT) ELSE 224 END AS new_h,
    CASE WHEN w < h THEN 224 ELSE CAST(floor(w::DOUBLE / h * 224) AS BIGINT) END AS new_w
    FROM (SELECT p_partkey, p_size * 10 + 100 AS h, length(p_name) * 30 + 50 AS w FROM part)""",
)
def short_side_sizes(spark, sf):
    images = v.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") * 10 + 100).alias("h"), (F.length("p_name") * 30 + 50).cast("long").alias("w")
    )
    return images.select("*", short_side_size("h", "w", 224).alias("s")).select(
        "p_partkey", "h", "w", "s.new_h", "s.new_w"
    )


@query(
    "resolve_similarity_options",
    """SELECT event_id, CASE event_type WHEN 'click' THEN CAST(k AS INT) WHEN 'view' THEN 3 ELSE 1 END AS time_shift, true AS normalize,
    CASE event_type WHEN 'click' THEN value WHEN 'view' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS temperature,
    CASE WHEN event_type = 'click' THEN 0.25::DOUBLE ELSE -9.0::DOUBLE END AS threshold,
    event_type = 'view' AS mask_diagonal, event_type <> 'view' AS softmax,
    CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 1 END AS remove_last_n_frames
    FROM (SELECT event_id, event_type, value, json_extract_string(props, '$.k') AS k FROM events)""",
)
def resolve_similarity_options(spark, sf):
    """A model config per event: the named loss, another loss of the right kind, or none."""
    k = F.get_json_object("props", "$.k")
    named = F.format_string(
        '{"model":{"losses":{"loss_timesim":{"remove_last_n_frames":2,"target_transform":{"time_shift":%s,"temperature":%s,"threshold":0.25}}}}}',
        k,
        F.col("value").cast("string"),
    )
    other = F.lit(
        '{"model":{"losses":{"mse":{"name":"MSELoss"},"sim":{"target_transform":{"name":"utils.FeatureTimeSimilarity",'
        '"time_shift":3,"temperature":0.5,"mask_diagonal":true,"softmax":false}}}}}'
    )
    config = (
        F.when(F.col("event_type") == "click", named)
        .when(F.col("event_type") == "view", other)
        .otherwise(F.lit('{"model":{}}'))
    )
    options = v.table(spark, sf, "events").select("event_id", ops.similarity_options(config).alias("o"))
    return options.select("event_id", "o.*").withColumn("threshold", F.coalesce("threshold", F.lit(-9.0)))


# --- agreement ----------------------------------------------------------------

LONG = {
    **PREDICTED,
    "long": """SELECT video, frame, patch, unnest(affinity) AS a, unnest(target) AS t, unnest(prediction) AS p,
      unnest(range(len(target))) AS j FROM maps""",
    "rows": """SELECT video, frame, patch, count(*) AS n, sum(abs(t - p)) / 2 AS tv, -sum(t * ln(greatest(p, 1e-12))) AS ce,
      -sum(t * ln(greatest(t, 1e-12))) AS entropy, sum(t * p) / greatest(sqrt(sum(t * t)) * sqrt(sum(p * p)), 1e-12) AS cosine,
      sum(tc * pc) / greatest(sqrt(sum(tc * tc)) * sqrt(sum(pc * pc)), 1e-12) AS corr,
      max(t) AS tpeak, max(p) AS ppeak, arg_max(j, t) AS ti, arg_max(j, p) AS pi, arg_max(j, a) AS ai, arg_max(p, t) AS p_at_t, arg_max(t, p) AS t_at_p
      FROM (SELECT *, t - avg(t) OVER w AS tc, p - avg(p) OVER w AS pc FROM long WINDOW w AS (PARTITION BY video, frame, patch)) GROUP BY video, frame, patch""",
    "ranked": """SELECT r.*, (SELECT count(*) FROM long l WHERE l.video = r.video AND l.frame = r.frame AND l.patch = r.patch AND l.p > r.p_at_t) AS tr FROM rows r""",
}

# Of equal values the first position counts.
TIES = {**LONG, "rows": re.sub(r"arg_max\((\w), (\w)\)", r"arg_max(\1, (\2, -j)) FILTER (\1 IS NOT NULL AND \2 IS NOT NULL)", LONG["rows"])}


def stats(spark, sf):
    return agreement.row_statistics(maps(spark, sf))


def rounded(df, keep=("video", "n_rows", "n_elements")):
    return df.select(*[F.col(c) if c in keep else r6(F.col(c)).alias(c) for c in df.columns])


ERRORS = ", ".join(
    f"{s6(f'avg(abs({b} - {a}))')} AS {name}_mae, {s6(f'sqrt(avg(({b} - {a}) * ({b} - {a})))')} AS {name}_rmse, {s6(f'max(abs({b} - {a}))')} AS {name}_max_abs"
    for name, a, b in (("affinity_target", "a", "t"), ("target_prediction", "t", "p"), ("affinity_prediction", "a", "p"))
)
SIZES = "count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_elements"


@query(
    "agreement_errors",
    v.with_views("patches", extra=LONG)
    + f"SELECT video, count(*) // {v.PATCHES} AS n_rows, count(*) AS n_elements, {ERRORS}, {s6('avg(p - t)')} AS mean_signed FROM long GROUP BY video",
)
def agreement_errors(spark, sf):
    return rounded(agreement.summarize(stats(spark, sf), agreement.error_columns()))


@query(
    "agreement_divergence",
    v.with_views("patches", extra=LONG)
    + f"SELECT video, {SIZES}, {s6('avg(tv)')} AS tv, {s6('avg(ce)')} AS ce, {s6('avg(entropy)')} AS entropy, {s6('avg(ce - entropy)')} AS kl FROM rows GROUP BY video",
)
def agreement_divergence(spark, sf):
    return rounded(agreement.summarize(stats(spark, sf), agreement.divergence_columns()))


@query(
    "agreement_correlation",
    v.with_views("patches", extra=LONG)
    + f"SELECT video, {SIZES}, {s6('avg(cosine)')} AS prob_cos, {s6('avg(corr)')} AS prob_corr FROM rows GROUP BY video",
)
def agreement_correlation(spark, sf):
    return rounded(agreement.summarize(stats(spark, sf), agreement.correlation_columns()))


TOPK = ", ".join(f"{s6(f'avg((tr < {k})::INT)')} AS top{k}" for k in (1, 5, 10)) + ", " + ", ".join(
    f"{s6(f'avg({e})')} AS {name}"
    for name, e in (
        ("aff_target_argmax", "(ai = ti)::INT"),
        ("pred_aff_argmax", "(pi = ai)::INT"),
        ("target_peak", "tpeak"),
        ("pred_peak", "ppeak"),
        ("pred_at_target_top1", "p_at_t"),
        ("target_at_pred_top1", "t_at_p"),
    )
)


@query(
    "agreement_topk",
    v.with_views("patches", extra=LONG) + f"SELECT video, {SIZES}, {TOPK} FROM ranked GROUP BY video",
)
def agreement_topk(spark, sf):
    return rounded(agreement.summarize(stats(spark, sf), agreement.topk_columns()))


@query(
    "agreement_argmax_hist",
    v.with_views(
        "patches",
        extra={
            **TIES,
            "hp": "SELECT video, pi, count(*) AS c FROM rows GROUP BY ALL",
            "ht": "SELECT video, ti, count(*) AS c FROM rows GROUP BY ALL",
            "sp": "SELECT video, count(*) AS u, max(c) / sum(c) AS s FROM hp GROUP BY video",
            "st": "SELECT video, count(*) AS u, max(c) / sum(c) AS s FROM ht GROUP BY video",
        },
    )
    + f"""SELECT video, sp.u AS pred_unique, {s6('sp.s')} AS pred_top_share, st.u AS target_unique, {s6('st.s')} AS target_top_share
    FROM sp JOIN st USING (video)""",
)
def agreement_argmax_hist(spark, sf):
    hist = agreement.argmax_histogram(stats(spark, sf))
    return rounded(hist, ("video", "pred_unique", "target_unique"))


@query(
    "agreement_rollup",
    v.with_views("patches", extra=LONG)
    + f"""SELECT coalesce(video, -1) AS video, {SIZES}, {TOPK}, {s6('avg(tv)')} AS tv, {s6('avg(ce)')} AS ce,
    {s6('avg(entropy)')} AS entropy, {s6('avg(ce - entropy)')} AS kl FROM ranked GROUP BY ROLLUP (video)""",
)
def agreement_rollup(spark, sf):
    columns = [*agreement.topk_columns(), *agreement.divergence_columns()]
    return rounded(agreement.summarize_rollup(stats(spark, sf), columns))


@query(
    "video_report",
    v.with_views(
        "patches",
        extra={
            **TIES,
            "el": """SELECT video, avg(abs(t - a)) AS at_mae, avg(abs(p - a)) AS ap_mae, avg(abs(p - t)) AS tp_mae,
              sqrt(avg((p - t) * (p - t))) AS tp_rmse, max(abs(p - t)) AS tp_max FROM long GROUP BY video""",
            "hp": "SELECT video, pi, count(*) AS c FROM rows GROUP BY ALL",
            "sp": "SELECT video, count(*) AS u, max(c) / sum(c) AS s FROM hp GROUP BY video",
        },
    )
    + f"""SELECT video, count(DISTINCT frame) AS pred_frames, count(*) AS rows, {s6('any_value(at_mae)')} AS aff_target_mae,
    {s6('any_value(ap_mae)')} AS aff_pred_mae, {s6('any_value(tp_mae)')} AS target_pred_mae, {s6('any_value(tp_rmse)')} AS target_pred_rmse,
    {s6('any_value(tp_max)')} AS target_pred_max_abs, {s6('avg(tv)')} AS tv, {s6('avg(ce - entropy)')} AS kl, {s6('avg(ce)')} AS ce, {s6('avg(entropy)')} AS entropy,
    {s6('avg(cosine)')} AS prob_cos, {s6('avg(corr)')} AS prob_corr, {s6('avg((tr < 1)::INT)')} AS top1, {s6('avg((tr < 5)::INT)')} AS top5,
    {s6('avg((tr < 10)::INT)')} AS top10, {s6('avg(p_at_t)')} AS pred_at_target_top1, {s6('avg(tpeak)')} AS target_peak, {s6('avg(ppeak)')} AS pred_peak,
    any_value(u) AS pred_unique, {s6('any_value(s)')} AS pred_top_share
    FROM ranked JOIN el USING (video) JOIN sp USING (video) GROUP BY video""",
)
def video_report(spark, sf):
    """The per-video report table."""
    return rounded(agreement.video_report(stats(spark, sf)), ("video", "pred_frames", "rows", "pred_unique"))


# --- losses -------------------------------------------------------------------


@query(
    "reconstruction_mse",
    v.with_views("patches")
    + f"""SELECT a.video, {s6('avg(list_inner_product(d, d)) / 64')} AS mse FROM (
      SELECT a.video, list_transform(a.feature, lambda x, i: x - b.feature[i]) AS d FROM patches a JOIN patches b
      ON b.video = a.video AND b.patch = a.patch AND b.frame = a.frame + 1) a GROUP BY a.video""",
)
def reconstruction_mse(spark, sf):
    """Each patch against the same patch one frame later."""
    pairs = ops.time_shift_pairs(v.patches(spark, sf), 1, ["video", "patch"], ["feature"])
    return losses.reconstruction_mse(pairs, "feature", "later_feature", ["video"]).withColumn("mse", r6(F.col("mse")))


@query(
    "soft_cross_entropy",
    v.with_views("patches", extra=PREDICTED)
    + f"SELECT video, {s6('avg(-list_sum(list_transform(prediction, lambda p, i: ln(p) * target[i])))')} AS cross_entropy FROM maps GROUP BY video",
)
def soft_cross_entropy(spark, sf):
    rows = ops.time_similarity_target(v.patches(spark, sf), **OPTIONS).join(
        v.logits(spark, sf), ["video", "frame", "patch"]
    )
    out = losses.soft_cross_entropy(rows, "logits", "target", ["video"])
    return out.withColumn("cross_entropy", r6(F.col("cross_entropy")))


WEIGHTS = {"click": 1.0, "view": 0.5, "purchase": 2.0, "signup": 0.0, "error": 0.25}


@query(
    "weighted_loss_total",
    "WITH w AS (SELECT user_id, value * CASE event_type "
    + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in WEIGHTS.items())
    + " END AS v FROM events WHERE event_type <> 'signup'), "
    + "t AS (SELECT user_id, sum(v) AS total FROM w GROUP BY 1), n AS (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY 1)"
    + f" SELECT user_id, {s6('total')} AS total, {s6('(SELECT sum(m * n) / sum(n) FROM n)')} AS epoch_mean FROM t",
)
def weighted_loss_total(spark, sf):
    """Event values as losses named by type; users as batches of the epoch mean."""
    events = v.table(spark, sf, "events").select("user_id", F.col("event_type").alias("loss"), "value")
    batches = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    mean = losses.epoch_mean(batches, "m", "n").scalar()
    return losses.weighted_total(events, WEIGHTS, ["user_id"]).select(
        "user_id", r6(F.col("total")).alias("total"), r6(mean).alias("epoch_mean")
    )
