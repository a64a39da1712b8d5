"""Ordered rules that flag implausible ball detections, and gap filling.

Each rule sees the detections that survived the rules before it; the first rule that hits a row names it.
A whole run judges the rules on survivors beside each other in pieces of bounded size, in one go (survivor_rules); each
rule alone is a window too, in which survivors and the rest lie in different partitions of the same hash partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cosine, distance, rounded, speed, thresholds
from ..plans.storage import stored
from ..settings import DEFAULTS, KEYS, Settings
from .windows import along, carried, in_chunks, in_pieces, islands, spaced

FLAGS = ("clean_u", "clean_v", "is_outlier", "outlier_rule")


def gate(df: DataFrame) -> DataFrame:
    """Starts the flags: a detected ball's place is clean until a rule hits it."""
    seen = F.col("detected") == 1
    return df.withColumns({"clean_u": F.when(seen, F.col("ball_u")), "clean_v": F.when(seen, F.col("ball_v")), "is_outlier": F.lit(False), "outlier_rule": F.lit("")})


def alive() -> Column:
    return (F.coalesce(F.col("detected"), F.lit(0)) == 1) & ~F.col("is_outlier")


def flag(df: DataFrame, hit: Column, rule: str | Column) -> DataFrame:
    """Marks surviving rows where `hit` is true."""
    hit = alive() & F.coalesce(hit, F.lit(False))
    rule = F.lit(rule) if isinstance(rule, str) else rule
    df = df.withColumn("_hit", hit)
    out = {"clean_u": F.when(~F.col("_hit"), F.col("clean_u")), "clean_v": F.when(~F.col("_hit"), F.col("clean_v")), "outlier_rule": F.when(F.col("_hit"), rule).otherwise(F.col("outlier_rule")), "is_outlier": F.col("is_outlier") | F.col("_hit")}
    return df.withColumns(out).drop("_hit")


def low_conf(df: DataFrame, threshold: float | None = None, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """Detections below the confidence threshold; without a given one, off where confidences exceed 1.5."""
    if threshold is not None:
        return flag(df, F.col("ball_conf") < threshold, "low_conf") if threshold > 0 else df
    # The highest of each camera is a row a camera beside the rows, not a window along the camera.
    top = df.groupBy(*keys).agg(F.max("ball_conf").alias("_top"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    df = df.alias("l").join(F.broadcast(top.alias("r")), same, "left").select("l.*", "r._top")
    return flag(df, (F.coalesce("_top", F.lit(0.0)) <= 1.5) & (F.col("ball_conf") < s.conf_thr), "low_conf").drop("_top")


def out_of_bounds(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Places outside the picture, or missing; the bounds are inside."""
    inside = F.col("ball_u").between(s.u_min, s.u_max) & F.col("ball_v").between(s.v_min, s.v_max)
    return flag(df, ~F.coalesce(inside, F.lit(False)), "out_of_bounds")


def kinematic_rule(s: Settings = DEFAULTS) -> Column:
    """Which rule a survivor breaks against its neighbours _p and _q; null if none."""
    p, q, u, v, f = F.col("_p"), F.col("_q"), F.col("ball_u"), F.col("ball_v"), F.col("frame_id")
    snap, iso = thresholds(v, F.col("_alpha"), F.col("_beta"), s)
    zero = F.lit(0.0)
    du_in, dv_in, du_out, dv_out = u - p["u"], v - p["v"], q["u"] - u, q["v"] - v
    into, out = F.coalesce(speed(du_in, dv_in, f - p["f"]), zero), F.coalesce(speed(du_out, dv_out, q["f"] - f), zero)
    turns = F.coalesce(cosine(du_in, dv_in, du_out, dv_out), zero) <= s.snap_cos
    away = (distance(du_in, dv_in) > iso) & (distance(du_out, dv_out) > iso)
    return F.when((into > snap) & (out > snap) & turns, "snap_back").when((into > iso) & (out > iso), "speed_spike").when(p.isNotNull() & q.isNotNull() & away, "spatial_isolation")


def with_calibration(df: DataFrame, cameras: DataFrame | None) -> DataFrame:
    """_alpha, _beta, _y_near, _y_far and _y_net of each row's camera; the dimension has a row a camera."""
    if cameras is None:
        return df.withColumns({c: F.lit(None).cast("double") for c in ("_alpha", "_beta", "_y_near", "_y_far", "_y_net")})
    dim = cameras.select("camera_name", *[F.col(c).alias(f"_{c}") for c in ("alpha", "beta", "y_near", "y_far", "y_net")])
    return df.join(F.broadcast(dim), "camera_name", "left")


def kinematic_pass(df: DataFrame, cameras: DataFrame | None = None, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """One pass of the snap-back, spike and isolation rules, as a pure window."""
    w = along(keys, "frame_id", "_alive")
    at = F.struct(F.col("frame_id").alias("f"), F.col("ball_u").alias("u"), F.col("ball_v").alias("v"))
    df = with_calibration(df, cameras).withColumn("_alive", alive())
    df = df.withColumns({"_p": F.lag(at).over(w), "_q": F.lead(at).over(w)})
    df = df.withColumn("_rule", F.when(F.col("_alive"), kinematic_rule(s)))
    return flag(df, F.col("_rule").isNotNull(), F.col("_rule")).drop("_alive", "_p", "_q", "_rule", "_alpha", "_beta", "_y_near", "_y_far", "_y_net")


def kinematic_fixpoint(df: DataFrame, cameras: DataFrame | None = None, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS, size: int = 8192, halo: int = 256) -> DataFrame:
    """Passes until none flags a row, at most s.passes, over pieces of the survivors, each pass vectorised."""
    return _settled(df, cameras, None, keys, s, size, halo)


def survivor_rules(df: DataFrame, cameras: DataFrame | None = None, net_rule: bool = True, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS, size: int = 8192, halo: int = 256) -> DataFrame:
    """The fixpoint, then static runs, short segments, crossing times and half-court runs, in that order, in one go over pieces.

    The rows are those of kinematic_fixpoint(), static_cluster(), short_segment(), crossing_time() and, with net_rule, half_court()
    one after the other; but no window runs along a camera, and no table is shuffled between rules.
    """
    return _settled(df, cameras, net_rule, keys, s, size, halo)


def _settled(df: DataFrame, cameras: DataFrame | None, net_rule: bool | None, keys: Sequence[str], s: Settings, size: int, halo: int) -> DataFrame:
    """The fixpoint, and unless net_rule is None the rules after it.

    A pass looks at the survivors beside a row, so what is unknown beyond a piece reaches one survivor further in each pass; a
    rule on runs of fewer or more than n survivors needs to see n. So a piece is sure of its own rows if more survivors than all
    that together are left in the halo.
    """
    import numpy as np

    reach = s.passes + (0 if net_rule is None else s.static_len + s.seg_len + s.half_court_len + 4)

    def run_sizes(starts):
        """Of each row the number of its run, and the size of that."""
        run = np.cumsum(starts) - 1
        return run, np.bincount(run, minlength=1)[run]

    def settle(pdf, inside, first, last):
        u, v, f, a, b = (pdf[c].to_numpy(float) for c in ("ball_u", "ball_v", "frame_id", "_alpha", "_beta"))
        live, rule = np.arange(len(pdf)), np.full(len(pdf), "", object)
        top = np.maximum(s.floor_px, a * v + b)
        snap, iso = np.where(np.isnan(a + b), s.flat_snap, top * s.snap_mult), np.where(np.isnan(a + b), s.flat_iso, top * s.iso_mult)
        for _ in range(s.passes):
            du, dv, dt = np.diff(u[live]), np.diff(v[live]), np.maximum(np.diff(f[live]), 1)
            d = np.sqrt(du * du + dv * dv)
            into, out = np.concatenate(([0.0], d / dt)), np.concatenate((d / dt, [0.0]))
            d_in, d_out = np.concatenate(([0.0], d)), np.concatenate((d, [0.0]))
            norm = d_in * d_out
            dot = np.concatenate(([0.0], du)) * np.concatenate((du, [0.0])) + np.concatenate(([0.0], dv)) * np.concatenate((dv, [0.0]))
            cos = np.where((d_in < 1e-9) | (d_out < 1e-9), 0.0, dot / np.where(norm == 0, 1.0, norm))
            near_snap, near_iso = snap[live], iso[live]
            inner = np.zeros(len(live), bool)
            inner[1:-1] = True
            back = (into > near_snap) & (out > near_snap) & (cos <= s.snap_cos)
            spike = (into > near_iso) & (out > near_iso)
            apart = inner & (d_in > near_iso) & (d_out > near_iso)
            hit = np.where(back, "snap_back", np.where(spike, "speed_spike", np.where(apart, "spatial_isolation", "")))[: len(live)]
            if not (hit != "").any():
                break
            rule[live[hit != ""]] = hit[hit != ""]
            live = live[hit == ""]

        def mark(hit, name):
            nonlocal live
            rule[live[hit]] = name
            live = live[~hit]

        if net_rule is not None and len(live):
            du, dv = np.diff(u[live]), np.diff(v[live])
            mark(run_sizes(np.concatenate(([True], np.sqrt(du * du + dv * dv) >= s.static_px)))[1] >= s.static_len, "static_cluster")
        if net_rule is not None and len(live):
            mark(run_sizes(np.concatenate(([True], np.diff(f[live]) > s.seg_gap)))[1] < s.seg_len, "short_segment")
        if net_rule is not None and len(live):
            far = np.abs(pdf["_y_near"].to_numpy(float) - pdf["_y_far"].to_numpy(float))[live] * s.cross_part
            mark(np.concatenate(([False], np.diff(f[live]) < s.cross_frames)) & (np.abs(np.diff(v[live], prepend=np.nan)) >= far), "crossing_time")
        if net_rule and len(live):
            net = pdf["_y_net"].to_numpy(float)[live]
            near = v[live] > net
            run, n = run_sizes(np.concatenate(([True], near[1:] != near[:-1])))
            # A run that is cut by the piece is longer than a short one where the piece is sure.
            inner = ((run > 0) | (not first)) & ((run < run[-1]) | (not last))
            mark(~np.isnan(net) & inner & (n < s.half_court_len), "half_court_excursion")
        own = np.flatnonzero(inside)
        low, high = (own[0], own[-1]) if len(own) else (0, 0)
        sure = (first or (live < low).sum() > reach) and (last or (live > high).sum() > reach)
        return pdf.assign(_rule=rule)[inside & (rule != "")][[*keys, "frame_id", "_rule"]], sure

    df = stored(df, "gated")  # read several times below
    live = with_calibration(df.filter(alive()).select(*keys, "frame_id", "ball_u", "ball_v"), cameras)
    live = carried(live, keys, ["frame_id"], number="_pos", of=df)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    found = in_pieces(live, keys, "_pos", settle, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"frame_id {kinds['frame_id']}", "_rule string"]), size, halo)
    return flag(df.join(found, [*keys, "frame_id"], "left"), F.col("_rule").isNotNull(), F.col("_rule")).drop("_rule")


def static_cluster(df: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """Runs of survivors, each within s.static_px of the one before, of s.static_len or more."""
    w = along(keys, "frame_id", "_alive")
    df = df.withColumn("_alive", alive())
    df = df.withColumn("_d", distance(F.col("ball_u") - F.lag("ball_u").over(w), F.col("ball_v") - F.lag("ball_v").over(w)))
    df = islands(df, F.coalesce(F.col("_d") >= s.static_px, F.lit(True)), "_run", w)
    df = df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_alive", "_run")))
    return flag(df, F.col("_n") >= s.static_len, "static_cluster").drop("_alive", "_d", "_run", "_n")


def short_segment(df: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """Segments of fewer than s.seg_len survivors, cut where frames are more than s.seg_gap apart."""
    w = along(keys, "frame_id", "_alive")
    df = df.withColumn("_alive", alive())
    df = df.withColumn("_d", F.col("frame_id") - F.lag("frame_id").over(w))
    df = islands(df, F.coalesce(F.col("_d") > s.seg_gap, F.lit(True)), "_run", w)
    df = df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_alive", "_run")))
    return flag(df, F.col("_n") < s.seg_len, "short_segment").drop("_alive", "_d", "_run", "_n")


def crossing_time(df: DataFrame, cameras: DataFrame | None, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """A survivor that is most of the court's length away from the one before, too soon; off without calibration."""
    if cameras is None:
        return df
    w = along(keys, "frame_id", "_alive")
    df = with_calibration(df, cameras).withColumn("_alive", alive())
    df = df.withColumns({"_dt": F.col("frame_id") - F.lag("frame_id").over(w), "_dv": F.abs(F.col("ball_v") - F.lag("ball_v").over(w))})
    far = F.col("_dv") >= F.abs(F.col("_y_near") - F.col("_y_far")) * s.cross_part
    return flag(df, (F.col("_dt") < s.cross_frames) & far, "crossing_time").drop("_alive", "_dt", "_dv", "_alpha", "_beta", "_y_near", "_y_far", "_y_net")


def half_court(df: DataFrame, cameras: DataFrame | None, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """Short runs on one side of the net between runs on the other; off where the net is unknown."""
    if cameras is None:
        return df
    w = along(keys, "frame_id", "_alive")
    df = df.join(F.broadcast(cameras.select("camera_name", F.col("y_net").alias("_net"))), "camera_name", "left").withColumn("_alive", alive())
    df = df.withColumn("_near", F.col("ball_v") > F.col("_net"))
    df = islands(df, F.coalesce(F.col("_near") != F.lag("_near").over(w), F.lit(True)), "_run", w)
    df = df.withColumns({"_n": F.count("*").over(Window.partitionBy(*keys, "_alive", "_run")), "_last": F.max("_run").over(Window.partitionBy(*keys, "_alive"))})
    inner = (F.col("_run") > 1) & (F.col("_run") < F.col("_last"))
    return flag(df, F.col("_net").isNotNull() & inner & (F.col("_n") < s.half_court_len), "half_court_excursion").drop("_alive", "_net", "_near", "_run", "_n", "_last")


def low_conf_path(df: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """Where survivors jump between two heights, the cluster of lower mean confidence in a short look-ahead.

    A decision covers s.path_window survivors, and the next is looked for after them: of the jumps those count that are
    spaced by so many survivors.
    """
    v = F.col("ball_v")
    df = stored(df, "rules")  # read several times below
    live = df.filter(alive()).select(*keys, "frame_id", "ball_v", "ball_conf")
    n = live.groupBy(*keys).agg(F.count("*").alias("_n"))
    live = stored(carried(live, keys, ["frame_id"], number="_pos", of=df), "survivors")
    jumps = in_chunks(live, keys, "_pos", lambda d, k: d.withColumn("_next", F.lead("ball_v").over(along(k, "_pos"))), 0, 1)
    jumps = jumps.filter(F.abs(v - F.col("_next")) >= s.path_px).select(*keys, "_pos", F.col("ball_v").alias("_a"), F.col("_next").alias("_b"))
    jumps = jumps.join(n.filter("_n >= 4").drop("_n"), list(keys), "left_semi")
    jumps = spaced(jumps, keys, "_pos", s.path_window).withColumn("_jump", F.col("_pos"))
    at = F.when(F.col("_jump").isNotNull(), F.struct("_jump", "_a", "_b"))
    judged = live.join(jumps, [*keys, "_pos"], "left").withColumn("_at", at)

    def within(d: DataFrame, k: list[str]) -> DataFrame:
        return d.withColumn("_at", F.last("_at", ignorenulls=True).over(along(k, "_pos").rowsBetween(1 - s.path_window, 0)))

    judged = in_chunks(judged, keys, "_pos", within, s.path_window - 1, 0)
    judged = judged.filter("_at is not null").select(*keys, "frame_id", "ball_conf", F.col("_at._jump").alias("_jump"), (F.abs(v - F.col("_at._a")) <= F.abs(v - F.col("_at._b"))).alias("_first"))
    window = Window.partitionBy(*keys, "_jump")
    mean = lambda which: F.avg(F.when(which, F.col("ball_conf"))).over(window)
    judged = judged.withColumn("_wins", mean(F.col("_first")) >= mean(~F.col("_first")))
    lost = judged.filter(F.col("_wins") != F.col("_first")).select(*keys, "frame_id", F.lit(True).alias("_lost"))
    return flag(df.join(lost, [*keys, "frame_id"], "left"), F.col("_lost"), "low_conf_path").drop("_lost")


def interpolate(df: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS, of: DataFrame | None = None) -> DataFrame:
    """Fills gaps of at most s.fill_gap frames between clean places, on a line; 2 places. of: a table with as many rows a key, if that is cheaper to count."""
    at = F.when(F.col("clean_u").isNotNull(), F.struct(F.col("frame_id").alias("f"), F.col("clean_u").alias("u"), F.col("clean_v").alias("v")))
    df = carried(df, keys, ["frame_id"], {"_p": at}, {"_q": at}, of=of)
    p, q = F.col("_p"), F.col("_q")
    fill = F.col("clean_u").isNull() & p.isNotNull() & q.isNotNull() & (q["f"] - p["f"] - 1 <= s.fill_gap)
    t = (F.col("frame_id") - p["f"]) / F.when(q["f"] != p["f"], q["f"] - p["f"])
    u, v = F.when(fill, p["u"] + t * (q["u"] - p["u"])).otherwise(F.col("clean_u")), F.when(fill, p["v"] + t * (q["v"] - p["v"])).otherwise(F.col("clean_v"))
    return df.withColumns({"interp_u": rounded(u, 2), "interp_v": rounded(v, 2), "was_interpolated": fill}).drop("_p", "_q")


def clean(df: DataFrame, cameras: DataFrame | None = None, net_rule: bool = True, threshold: float | None = None, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """All rules in order, then gap filling. net_rule: whether runs across the net are judged.

    Rules see the ball's columns only; others are joined to the result by camera and frame, of which each
    row must be the only one.
    """
    ball = [*keys, "frame_id", "detected", "ball_u", "ball_v", "ball_conf"]
    out = out_of_bounds(low_conf(gate(df.select(*ball)), threshold, keys, s), s)
    out = survivor_rules(out, cameras, net_rule, keys, s)
    out = interpolate(low_conf_path(out, keys, s), keys, s, df)
    rest = [c for c in df.columns if c not in ball]
    return out.join(df.select(*keys, "frame_id", *rest), [*keys, "frame_id"]) if rest else out


def summary(cleaned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts per camera, and how often each rule hit as a map."""
    n = lambda c: F.count_if(c)
    raw, out = n(F.col("detected") == 1), n(F.col("is_outlier"))
    base = cleaned.groupBy(*keys).agg(raw.alias("raw_detections"), out.alias("outliers"), (raw - out).alias("clean"), n(F.col("was_interpolated")).alias("interpolated"), n(F.col("interp_u").isNotNull()).alias("final_valid"))
    base = base.withColumn("outlier_pct", rounded(F.lit(100.0) * F.col("outliers") / F.greatest("raw_detections", F.lit(1)), 1))
    by = rule_counts(cleaned, keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outlier_rule", "n")))).alias("by_rule"))
    return base.join(by, list(keys), "left")


def rule_counts(cleaned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return cleaned.filter("is_outlier").groupBy(*keys, "outlier_rule").agg(F.count("*").alias("n"))


def rule_pivot(cleaned: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A row a rule, a column a camera, 0 where it never hit."""
    return rule_counts(cleaned).groupBy("outlier_rule").pivot("camera_name", list(labels)).sum("n").fillna(0)


