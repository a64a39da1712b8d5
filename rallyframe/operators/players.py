"""Players: who is near, where they stand, how far they move; shots, speeds and statistics of rallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ball_kmh, distance, iso_seconds, rounded, to_court, to_world
from ..plans.storage import stored
from ..settings import DEFAULTS, KEYS, Settings
from .rallies import rally_of_frames
from .windows import along, before, carried, in_chunks


def is_visible(p: str) -> Column:
    """Both shoulders known and right of the marker for none."""
    return F.coalesce((F.col(f"{p}_ls_u") > 20) & (F.col(f"{p}_rs_u") > 20), F.lit(False))


def shoulder_height(p: str) -> Column:
    """Mean of the shoulders' v that are known."""
    a, b = F.col(f"{p}_ls_v"), F.col(f"{p}_rs_v")
    return F.coalesce((a + b) / 2, a, b)


def near_player() -> Column:
    """p0 or p1: the visible one lower in the picture, p1 if they are level; null if none is visible."""
    v0, v1 = shoulder_height("p0"), shoulder_height("p1")
    both = F.when(v0.isNull() & v1.isNull(), None).when(v0.isNull(), "p1").when(v1.isNull(), "p0").when(v0 > v1, "p0").otherwise("p1")
    return F.when(~is_visible("p0") & ~is_visible("p1"), None).when(~is_visible("p0"), "p1").when(~is_visible("p1"), "p0").otherwise(both)


def far_player(near: Column) -> Column:
    """The other one, even if it isn't visible itself."""
    return F.when(near == "p0", "p1").when(near == "p1", "p0")


def player_world(p: str, h: Column) -> Column:
    """Place of the middle between the shoulders; null unless all four values are known and none is a marker."""
    lu, lv, ru, rv = (F.col(f"{p}_{c}") for c in ("ls_u", "ls_v", "rs_u", "rs_v"))
    return F.when((lu >= 5) & (ru >= 5) & lv.isNotNull() & rv.isNotNull(), to_world((lu + ru) / 2, (lv + rv) / 2, h))


def located(df: DataFrame, cameras: DataFrame) -> DataFrame:
    """Adds near, far (p0 or p1) and the places ball_w, p0_w, p1_w, near_w, far_w; cameras without a matrix are dropped."""
    dim = F.broadcast(cameras.filter("h is not null").select("camera_name", F.col("h").alias("_h")))
    df = df.join(dim, "camera_name").withColumn("near", near_player()).withColumn("far", far_player(F.col("near")))
    h = F.col("_h")
    df = df.withColumns({"ball_w": to_world(F.col("interp_u"), F.col("interp_v"), h), "p0_w": player_world("p0", h), "p1_w": player_world("p1", h)})
    pick = lambda c: F.when(F.col(c) == "p0", F.col("p0_w")).when(F.col(c) == "p1", F.col("p1_w"))
    return df.withColumns({"near_w": pick("near"), "far_w": pick("far")}).drop("_h")


def ball_speeds(df: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """Adds ball_kmh: from the last known place in the s.lookback rows before; needs ball_w and row_idx, the row's place in its camera."""

    def seen(df: DataFrame, keys: list[str]) -> DataFrame:
        known = F.when(F.col("ball_w").isNotNull(), F.struct("row_idx", "ball_w"))
        return df.withColumn("_p", F.last(known, ignorenulls=True).over(before(along(keys, "row_idx"))))

    df = in_chunks(df, keys, "row_idx", seen, s.lookback, 0)
    p = F.when(F.col("row_idx") - F.col("_p.row_idx") <= s.lookback, F.col("_p"))
    d = distance(F.col("ball_w.x") - p["ball_w"]["x"], F.col("ball_w.y") - p["ball_w"]["y"])
    return df.withColumn("ball_kmh", ball_kmh(d, F.col("row_idx") - p["row_idx"], s.fps, s)).drop("_p")


def hit_events(moving: DataFrame, hits: DataFrame, found: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """(keys, frame, time_s, rally_id, speed_kmh, near_player) of each crossing inside a rally. moving has ball_kmh and near."""
    at = hits.select(*keys, "frame_id").join(moving, [*keys, "frame_id"])
    return rally_of_frames(at, found, keys).filter("rally_id is not null").select(*keys, F.col("frame_id").alias("frame"), rounded(F.col("frame_id") / F.lit(s.fps), 3).alias("time_s"), "rally_id", rounded(F.col("ball_kmh"), 1).alias("speed_kmh"), F.coalesce("near", F.lit("unknown")).alias("near_player"))


def step(now: Column, was: Column, s: Settings = DEFAULTS) -> Column:
    """Distance of a step that is neither jitter nor a swap of players; else 0."""
    d = distance(now["x"] - was["x"], now["y"] - was["y"])
    return F.coalesce(F.when((d > s.move_least) & (d < s.move_most), d), F.lit(0.0))


ROLES, EACH = ("near", "far"), ("p0", "p1")


def moves(placed: DataFrame, names: Sequence[str] = (*ROLES, *EACH), keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """Adds near_m, far_m, p0_m and p1_m, of those named, in one go; placed should be a stored table.

    A role's is from the row before in the rally, whoever it was; 0 after a row without a place. A player's is from the last
    known place in the rally; 0 outside of rallies.
    """
    # A row before without a place counts for a role, so it is carried as a struct that holds none.
    was = {f"_w_{n}": F.struct(F.col(f"{n}_w").alias("w")) if n in ROLES else F.when(F.col(f"{n}_w").isNotNull(), F.struct(F.col(f"{n}_w").alias("w"))) for n in names}
    out = carried(placed, [*keys, "rally_id"], ["frame_id"], prior=was)
    m = {n: step(F.col(f"{n}_w"), F.col(f"_w_{n}")["w"], s) for n in names}
    m = {f"{n}_m": x if n in ROLES else F.when(F.col("rally_id").isNotNull(), x).otherwise(0.0) for n, x in m.items()}
    return out.withColumns(m).drop(*was)


def moves_by_role(placed: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """Adds near_m and far_m: from the row before in the rally, whoever it was; 0 after a row without a place."""
    return moves(placed, ROLES, keys, s)


def moves_by_player(placed: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """Adds p0_m and p1_m: from the player's last known place in the rally."""
    return moves(placed, EACH, keys, s)


def player_stats(moved: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """(keys, rally_id, role, total_distance, avg_move_speed, max_move_speed) of both roles; time is rows over fps."""
    each = moved.filter("rally_id is not null").select(*keys, "rally_id", F.expr("stack(2, 'near', near_m, 'far', far_m) as (role, m)"))
    sums = each.groupBy(*keys, "rally_id", "role").agg(F.sum("m").alias("d"), F.max("m").alias("m"), F.count("*").alias("n"))
    return sums.select(*keys, "rally_id", "role", rounded(F.col("d"), 2).alias("total_distance"), rounded(F.col("d") / (F.col("n") / F.lit(s.fps)), 3).alias("avg_move_speed"), rounded(F.col("m") * s.fps, 3).alias("max_move_speed"))


def rally_stats(found: DataFrame, shots: DataFrame, moved: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rallies with shots and the distance both players went, 0 if none. moved has p0_m and p1_m."""
    n = shots.groupBy(*keys, "rally_id").agg(F.count("*").alias("shots"))
    d = moved.filter("rally_id is not null").groupBy(*keys, "rally_id").agg(F.sum(F.col("p0_m") + F.col("p1_m")).alias("d"))
    out = found.join(n, [*keys, "rally_id"], "left").join(d, [*keys, "rally_id"], "left")
    return out.select(*keys, "rally_id", "start_frame", "end_frame", F.col("rally_start").alias("rally_start_s"), F.col("rally_end").alias("rally_end_s"), rounded(F.col("rally_end") - F.col("rally_start"), 3).alias("duration_s"), F.coalesce("shots", F.lit(0)).cast("int").alias("shots"), rounded(F.coalesce("d", F.lit(0.0)), 2).alias("dist_m"))


def ball_stats(found: DataFrame, shots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, rally_id, total_shots, avg_ball_speed, max_ball_speed); shots without a speed count as 0. shots has ball_kmh."""
    n = shots.groupBy(*keys, "rally_id").agg(F.count("*").alias("n"), F.avg("ball_kmh").alias("a"), F.max("ball_kmh").alias("m"))
    return found.select(*keys, "rally_id").join(n, [*keys, "rally_id"], "left").select(*keys, "rally_id", F.coalesce("n", F.lit(0)).cast("int").alias("total_shots"), rounded(F.coalesce("a", F.lit(0.0)), 1).alias("avg_ball_speed"), rounded(F.coalesce("m", F.lit(0.0)), 1).alias("max_ball_speed"))


def session_summary(stats: DataFrame, shots: DataFrame, cameras: DataFrame) -> DataFrame:
    """One row a camera, zeros where it has no rally. shots has speed_kmh."""
    r = stats.groupBy("camera_name").agg(F.count("*").alias("n"), F.sum("dist_m").alias("d"))
    h = shots.groupBy("camera_name").agg(F.count("*").alias("hits"), F.avg("speed_kmh").alias("speed"))
    out = cameras.select("camera_name", "y_net").join(r, "camera_name", "left").join(h, "camera_name", "left").fillna(0, ["n", "hits"]).fillna(0.0, ["d", "speed"])
    per = F.when(F.col("n") > 0, F.col("hits") / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0)
    return out.select(F.col("camera_name").alias("camera"), F.col("n").cast("int").alias("total_rallies"), F.col("hits").cast("int").alias("total_hits"), rounded(per, 2).alias("avg_hits_per_rally"), rounded(F.col("d"), 2).alias("total_dist_m"), rounded(F.col("speed"), 1).alias("avg_speed_kmh"), F.coalesce("y_net", F.lit(260.0)).alias("y_net_px"))


def panel(moved: DataFrame, hits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What a display shows at each frame: the rally last begun, its shots and distance up to the frame before, the last shot's speed.

    moved has rally_id, ball_kmh, p0_m and p1_m. Values stay on between rallies.
    """
    flags = hits.select(*keys, "frame_id", F.lit(True).alias("_hit"))
    df = moved.select(*keys, "frame_id", "rally_id", "ball_kmh", "p0_m", "p1_m").join(flags, [*keys, "frame_id"], "left")
    df = df.withColumn("_hit", F.coalesce("_hit", F.lit(False)) & F.col("rally_id").isNotNull())
    speed = F.when(F.col("_hit"), F.col("ball_kmh"))
    df = stored(carried(stored(df, "hits"), keys, ["frame_id"], {"shown_rally": F.col("rally_id")}, prior={"last_speed": speed}), "shown")
    added = F.when(F.col("rally_id").isNotNull(), F.col("p0_m") + F.col("p1_m")).otherwise(0.0)
    out = carried(df, [*keys, "shown_rally"], ["frame_id"], sums={"shots": F.col("_hit").cast("int"), "dist_m": added})
    shown = F.col("shown_rally").isNotNull()
    return out.select(*keys, "frame_id", "shown_rally", F.when(shown, F.col("shots")).otherwise(0).cast("int").alias("shots"), F.when(shown, F.col("dist_m")).otherwise(0.0).alias("dist_m"), F.coalesce("last_speed", F.lit(0.0)).alias("last_speed"))


#: Fields of a report that are always 0; the names in payloads() are as fixed.
ZEROS = ("firstServeSuccessRate", "returnFirstSuccessRate", "baselineShotRate", "baselineWinRate", "netPointRate", "netPointWinRate", "aceCount", "netApproaches")


def payloads(found: DataFrame, frames: DataFrame, shots: DataFrame, stats: DataFrame, cameras: DataFrame, video_start: Column, s: Settings = DEFAULTS) -> DataFrame:
    """(camera_name, rally_id, start_frame, payload): one nested report a rally, as JSON with nulls kept.

    frames: located rows with rally_id; shots: located crossings with rally_id and ball_kmh. Lists are collected
    per rally, so a task holds one rally's frames.
    """
    keys = ["camera_name", "rally_id"]
    x, y = to_court(F.col("ball_w"), s)
    hit = F.struct("frame_id", x.alias("x"), y.alias("y"), F.lit("hit").alias("type"), rounded(F.col("ball_kmh"), 1).alias("speed"), F.lit("forehand").alias("handType"))
    result = shots.filter("ball_w is not null and rally_id is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(hit)).alias("r"))
    (fx, fy), (nx, ny) = to_court(F.col("far_w"), s), to_court(F.col("near_w"), s)
    row = F.struct("frame_id", x.alias("x"), y.alias("y"), F.lit("running").alias("type"), F.lit(0).alias("speed"), F.col("frame_id").alias("timestamp"), fx.alias("farCountPerson_x"), fy.alias("farCountPerson_y"), nx.alias("nearCountPerson_x"), ny.alias("nearCountPerson_y"))
    track = frames.filter("ball_w is not null and rally_id is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("t"))
    drop = lambda c, names: F.coalesce(F.transform(c, lambda e: F.struct(*[e[n].alias(n) for n in names])), F.array())
    result = result.select(*keys, drop("r", ("x", "y", "type", "speed", "handType")).alias("resultmatrix"))
    track = track.select(*keys, drop("t", ("x", "y", "type", "speed", "timestamp", "farCountPerson_x", "farCountPerson_y", "nearCountPerson_x", "nearCountPerson_y")).alias("trackMatrix"))
    ball = ball_stats(found, shots.filter("rally_id is not null"), ("camera_name",))
    move = stats.groupBy(*keys).pivot("role", ["far", "near"]).agg(F.first("total_distance").alias("d"), F.first("avg_move_speed").alias("a"), F.first("max_move_speed").alias("m"))
    side = lambda r: F.struct(F.col("total_shots").alias("totalShots"), F.col("avg_ball_speed").alias("avgBallSpeed"), F.col("max_ball_speed").alias("maxBallSpeed"), F.coalesce(f"{r}_d", F.lit(0.0)).alias("totalDistance"), F.coalesce(f"{r}_a", F.lit(0.0)).alias("avgMoveSpeed"), F.coalesce(f"{r}_m", F.lit(0.0)).alias("maxMoveSpeed"), *[F.lit(0).alias(z) for z in ZEROS])
    at = lambda c: iso_seconds(F.timestamp_micros(F.unix_micros(video_start) + F.floor(F.col(c) * 1_000_000 / s.fps).cast("long")))
    all_ = found.join(ball, keys).join(move, keys, "left").join(result, keys, "left").join(track, keys, "left").join(F.broadcast(cameras.select("camera_name", "serial")), "camera_name", "left")
    content = F.struct(F.struct(side("far").alias("farCount"), side("near").alias("nearCount")).alias("mete"), F.coalesce("resultmatrix", F.array()).alias("resultmatrix"), F.coalesce("trackMatrix", F.array()).alias("trackMatrix"))
    whole = F.struct(F.coalesce("serial", F.concat(F.lit("UNKNOWN_"), F.col("camera_name"))).alias("serial_number"), at("start_frame").alias("startTime"), at("end_frame").alias("endTime"), content.alias("content"))
    return all_.select("camera_name", "rally_id", "start_frame", F.to_json(whole, {"ignoreNullFields": "false"}).alias("payload"))


