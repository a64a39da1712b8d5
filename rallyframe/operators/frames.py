"""Frames as rows: dense spines, fills, duplicates, tails, count windows, set operations, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, centre_y, distance
from ..settings import DEFAULTS, JOINTS, KEYS, PLAYERS, Settings
from .windows import along, chunked_range


def dense(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every frame between a camera's first and last; absent ones are undetected, with confidence 0.

    Frames are made in chunks, by many tasks, so a camera of any length, or a stray number far from the others, is no row of its own.
    """
    ends = df.groupBy(*keys).agg(F.min("frame_id").alias("_a"), F.max("frame_id").alias("_b"))
    spine = chunked_range(ends, "_a", "_b", "frame_id").select(*keys, "frame_id")
    fill = {c: v for c, v in (("detected", 0), ("ball_conf", 0.0)) if c in df.columns}
    return spine.join(df, [*keys, "frame_id"], "left").fillna(fill)


def fill_both_ways(df: DataFrame, columns: Sequence[str], limit: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Nulls take the last value of up to `limit` rows back, then the first of up to `limit` rows ahead."""
    w = along(keys)
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0)) for c in columns})
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, limit)) for c in columns})


def last_of_frame(df: DataFrame, order: str = "ingest_seq", keys: Sequence[str] = KEYS) -> DataFrame:
    """Of rows that share a frame, the one that came last."""
    rank = F.row_number().over(Window.partitionBy(*keys, "frame_id").orderBy(F.col(order).desc()))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def tail(df: DataFrame, rows: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last rows of each camera."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("frame_id").desc()))).filter(F.col("_r") <= rows).drop("_r")


def head(df: DataFrame, rows: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first rows of each camera."""
    return df.withColumn("_r", F.row_number().over(along(keys))).filter(F.col("_r") <= rows).drop("_r")


def tumbling(df: DataFrame, value: str, size: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, window, first_frame, frames, values): windows of `size` rows that don't overlap; the last may be shorter."""
    df = df.withColumn("_i", F.row_number().over(along(keys)) - 1)
    lists = F.array_sort(F.collect_list(F.struct("frame_id", F.col(value).alias("v"))))
    out = df.groupBy(*keys, F.floor(F.col("_i") / size).alias("window")).agg(lists.alias("l"))
    return out.select(*keys, "window", F.get("l", F.lit(0))["frame_id"].alias("first_frame"), F.col("l.frame_id").alias("frames"), F.col("l.v").alias("values"))


def sliding(df: DataFrame, value: str, size: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds values: the last `size` rows' values up to this one, the first repeated where there are fewer."""
    w = along(keys)
    got = F.collect_list(F.col(value)).over(w.rowsBetween(1 - size, 0))
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_got", got).withColumn("_first", first).withColumn("values", F.concat(F.array_repeat("_first", F.greatest(F.lit(0), size - F.size("_got"))), "_got")).drop("_got", "_first")


def top_players(boxes: DataFrame, most: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of each frame's boxes (box struct) the largest, numbered from the lowest in the picture up."""
    by_size = Window.partitionBy(*keys, "frame_id").orderBy(area(F.col("box")).desc(), "box")
    by_height = Window.partitionBy(*keys, "frame_id").orderBy(centre_y(F.col("box")).desc(), "box")
    top = boxes.withColumn("_r", F.row_number().over(by_size)).filter(F.col("_r") <= most)
    return top.withColumn("player", F.row_number().over(by_height) - 1).drop("_r")


def zipped(frames: DataFrame, results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of both by position in their camera; the shorter ends it. The columns of results other than keys and frame_id are added."""
    at = F.row_number().over(along(keys))
    right = results.withColumn("_i", at).drop("frame_id")
    return frames.withColumn("_i", at).join(right, [*keys, "_i"]).drop("_i")


def heat_peak(heat: DataFrame) -> DataFrame:
    """(camera_name, frame_id, cell, conf): the hottest cell of each map of logits; the first of equals."""
    best = F.max(F.struct(F.col("logit"), (-F.col("cell")).alias("m"))).alias("b")
    return heat.groupBy("camera_name", "frame_id").agg(best).select("camera_name", "frame_id", (-F.col("b.m")).alias("cell"), (1 / (1 + F.exp(-F.col("b.logit")))).alias("conf"))


def from_heat(peak: DataFrame, width: int, height: int, frame_width: int, frame_height: int, threshold: float) -> DataFrame:
    """Detections of hottest cells: column and row of the cell, scaled to the frame; none below the threshold."""
    seen = F.col("conf") >= threshold
    u, v = (F.col("cell") % width) * (frame_width / width), F.floor(F.col("cell") / width) * (frame_height / height)
    return peak.select("camera_name", "frame_id", seen.cast("int").alias("detected"), F.when(seen, u).alias("ball_u"), F.when(seen, v).alias("ball_v"), F.col("conf").alias("ball_conf"))


def gated(df: DataFrame, threshold: float = DEFAULTS.conf_thr) -> DataFrame:
    """Detections by a model's confidence: below the threshold nothing is detected, and there is no place."""
    seen = (F.coalesce(F.col("detected"), F.lit(0)) == 1) & F.coalesce(F.col("ball_conf") >= threshold, F.lit(False))
    return df.withColumns({"detected": seen.cast("int"), "ball_u": F.when(seen, F.col("ball_u")), "ball_v": F.when(seen, F.col("ball_v"))})


def common_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many frames both have."""
    return a.select("frame_id").intersect(b.select("frame_id")).agg(F.count("*").alias("n_common"))


def missing_cameras(registry: DataFrame, available: DataFrame) -> DataFrame:
    """Cameras of the registry that have no rows."""
    return registry.select("camera_name").join(available.select("camera_name").distinct(), "camera_name", "left_anti")


def compared(actual: DataFrame, expected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Errors per frame that both have: absolute and Euclidean of the ball, of each joint both have, and agreement of flags."""
    joints = [f"{p}_{j}" for p in PLAYERS for j in JOINTS if all(f"{p}_{j}_{x}" in df.columns for x in "uv" for df in (actual, expected))]
    values = ["interp_u", "interp_v", *[f"{j}_{x}" for j in joints for x in "uv"]]
    flags = ["is_outlier", "was_interpolated"]
    e = expected.select(*keys, "frame_id", *[F.col(c).alias(f"_{c}") for c in (*values, *flags)])
    out = actual.join(e, [*keys, "frame_id"])
    err = {c: F.abs(F.col(c) - F.col(f"_{c}")) for c in values}
    cols = [err["interp_u"].alias("u_err"), err["interp_v"].alias("v_err"), distance(F.col("interp_u") - F.col("_interp_u"), F.col("interp_v") - F.col("_interp_v")).alias("ball_err")]
    cols += [F.coalesce((F.col(c) == F.col(f"_{c}")).cast("int"), F.lit(0)).alias(f"{c}_agree") for c in flags]
    return out.select(*keys, "frame_id", *cols, *[err[f"{j}_{x}"].alias(f"{j}_{x}_err") for j in joints for x in "uv"])


def comparison_summary(errors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean absolute and root mean square errors a camera, null where nothing is known, joints and their mean a player."""
    mae = lambda c: F.avg(F.abs(F.col(c)))
    joints = sorted({c[:-6] for c in errors.columns if c.endswith("_u_err") and c != "u_err"})
    aggs = [mae("ball_err").alias("ball_interp_mae_px"), F.sqrt(F.avg(F.col("ball_err") * F.col("ball_err"))).alias("ball_interp_rmse_px"), mae("u_err").alias("ball_interp_u_mae"), mae("v_err").alias("ball_interp_v_mae"), F.avg("is_outlier_agree").alias("outlier_agree_rate"), F.avg("was_interpolated_agree").alias("interp_agree_rate")]
    aggs += [mean_of([mae(f"{j}_u_err"), mae(f"{j}_v_err")]).alias(f"{j}_mae_px") for j in joints]
    out = errors.groupBy(*keys).agg(*aggs)
    for p in PLAYERS:
        if own := [F.col(f"{j}_mae_px") for j in joints if j.startswith(p)]:
            out = out.withColumn(f"{p}_avg_joint_mae_px", mean_of(own))
    return out


def mean_of(columns):
    """Mean of the columns that aren't null."""
    total, n = F.lit(0.0), F.lit(0)
    for c in columns:
        total, n = total + F.coalesce(c, F.lit(0.0)), n + c.isNotNull().cast("int")
    return total / F.when(n > 0, n)


def flush_decision(buffers: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row: whether to flush now. buffers: a row a camera with n_rows, quiet_s (null if it never detected) and since_flush_s.

    Needs s.min_rows in every camera; then if all that ever detected are quiet, or too long passed since the last.
    """
    ever = F.col("quiet_s").isNotNull()
    quiet = F.coalesce(F.bool_and(F.when(ever, F.col("quiet_s") >= s.quiet_s)), F.lit(False))
    full = F.coalesce(F.min("n_rows") >= s.min_rows, F.lit(False))
    out = buffers.agg(full.alias("enough"), quiet.alias("all_quiet"), F.coalesce(F.max("since_flush_s") >= s.force_s, F.lit(False)).alias("overdue"))
    return out.withColumn("flush", F.col("enough") & (F.col("all_quiet") | F.col("overdue")))


