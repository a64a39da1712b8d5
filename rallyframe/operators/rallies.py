"""Motion, net crossings and rallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import rounded
from ..settings import DEFAULTS, KEYS, Settings
from .windows import along, backwards, before, carried, in_chunks, islands, so_far, spaced


def numbered(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """row_idx: the row's place in its camera, from 0."""
    return carried(df, keys, ["frame_id"], number="row_idx")


def fill_by_rows(df: DataFrame, columns: Sequence[str], limit: int = DEFAULTS.motion_limit, keys: Sequence[str] = KEYS, of: DataFrame | None = None) -> DataFrame:
    """Fills the first `limit` rows of each gap on the line, by rows, between its ends; after the last value with that."""
    at = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("row_idx").alias("i"), F.col(c).alias("x"))) for c in columns}
    df = carried(df, keys, ["row_idx"], {f"_p_{c}": x for c, x in at.items()}, {f"_q_{c}": x for c, x in at.items()}, of=of)
    out = {}
    for c in columns:
        p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
        step = F.col("row_idx") - p["i"]
        line = p["x"] + (q["x"] - p["x"]) / F.when(q["i"] != p["i"], q["i"] - p["i"]) * step
        out[c] = F.coalesce(F.col(c), F.when(step <= limit, F.coalesce(line, p["x"])))
    return df.withColumns(out).drop(*[f"_{x}_{c}" for x in "pq" for c in columns])


def motion(df: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """Adds row_idx, time, v_px and is_valid: in motion, neither long silent nor long slow; gaps are filled by rows first."""
    df = fill_by_rows(numbered(df, keys), ["interp_u", "interp_v"], s.motion_limit, keys, of=df)
    if "time" not in df.columns:
        df = df.withColumn("time", F.col("frame_id") / F.lit(s.fps))

    def judged(df: DataFrame, keys: list[str]) -> DataFrame:
        w, down = along(keys, "row_idx"), backwards(keys, "row_idx")
        du, dv = (F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in ("interp_u", "interp_v"))
        df = df.withColumn("v_px", F.sqrt(du * du + dv * dv)).withColumns({"_missing": F.col("interp_u").isNull(), "_slow": F.col("v_px") < s.slow_px})
        edge = lambda c, f: F.when(F.coalesce(F.col(c) != f(c).over(w), F.lit(True)), F.col("row_idx"))
        df = df.withColumns({f"{c}_{k}": edge(c, f) for c in ("_missing", "_slow") for k, f in (("a", F.lag), ("b", F.lead))})
        df = df.withColumns({f"{c}_a": F.last(f"{c}_a", ignorenulls=True).over(so_far(w)) for c in ("_missing", "_slow")})
        df = df.withColumns({f"{c}_b": F.last(f"{c}_b", ignorenulls=True).over(so_far(down)) for c in ("_missing", "_slow")})
        longer = lambda c, n: F.col(c) & (F.col(f"{c}_b") - F.col(f"{c}_a") + 1 > n)
        valid = ~(longer("_missing", s.silence_rows) | longer("_slow", s.slow_rows) | F.col("_missing"))
        return df.withColumn("is_valid", valid).drop(*[f"{c}{k}" for c in ("_missing", "_slow") for k in ("", "_a", "_b")])

    # Of a run only counts whether it is longer than a limit; the outermost row of a halo doesn't know the row before it.
    halo = max(s.silence_rows, s.slow_rows) + 2
    return in_chunks(df, keys, "row_idx", judged, halo, halo)


def trajectory_rallies(moving: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """Maximal runs in motion of s.rally_rows rows or more, numbered from 1."""
    runs = moving.select(*keys, "frame_id", "time", "is_valid")
    # Rows in motion with the same last row before them that isn't are a run.
    runs = carried(runs, keys, ["frame_id"], {"_run": F.when(~F.coalesce("is_valid", F.lit(False)), F.col("frame_id"))}, of=moving).filter("is_valid")
    runs = runs.groupBy(*keys, "_run").agg(F.count("*").alias("n"), F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.min("time").alias("rally_start"), F.max("time").alias("rally_end")).filter(F.col("n") >= s.rally_rows)
    return runs.withColumn("rally_id", F.row_number().over(along(keys, "start_frame"))).select(*keys, "rally_id", "start_frame", "end_frame", "rally_start", "rally_end")


def crossings(df: DataFrame, cameras: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """(keys, frame_id, row_idx) where the ball passes the net to the far side, stays there, and not too soon after the last.

    df has row_idx. Cameras without a known net have no crossing.
    """
    net = F.broadcast(cameras.filter("y_net is not null").select("camera_name", F.col("y_net").alias("_net")))
    v = df.join(net, "camera_name").filter("interp_v is not null").select(*keys, "frame_id", "row_idx", F.col("interp_v").alias("_v"), "_net")
    v = v.withColumn("_far", F.col("_v") < F.col("_net"))

    def judged(v: DataFrame, keys: list[str]) -> DataFrame:
        w, stays = along(keys, "row_idx"), F.col("_far")
        for k in range(1, s.far_count):
            stays &= F.coalesce(F.lead("_far", k).over(w) & (F.lead("row_idx", k).over(w) < F.col("row_idx") + s.debounce), F.lit(False))
        came = (F.lag("_v").over(w) > F.col("_net")) & (F.col("row_idx") - F.lag("row_idx").over(w) <= s.cross_gap)
        return v.withColumn("_hit", F.coalesce(came, F.lit(False)) & stays)

    found = in_chunks(v, keys, "row_idx", judged, s.cross_gap, s.debounce).filter("_hit").select(*keys, "frame_id", "row_idx")
    # The first is measured from one debounce before frame 0.
    return spaced(found.filter(F.col("frame_id") >= 0), keys, "frame_id", s.debounce)


def rallies(df: DataFrame, hits: DataFrame, keys: Sequence[str] = KEYS, s: Settings = DEFAULTS) -> DataFrame:
    """Crossings grouped by time, each group widened and held to frames that exist; neighbours that overlap are cut at the middle."""
    w = along(keys)
    gap, pre, post = int(s.rally_gap_s * s.fps), int(s.before_s * s.fps), int(s.after_s * s.fps)
    groups = islands(hits, F.coalesce(F.col("frame_id") - F.lag("frame_id").over(w) > gap, F.lit(True)), "rally_id", w)
    groups = groups.groupBy(*keys, "rally_id").agg((F.min("frame_id") - pre).alias("_a"), (F.max("frame_id") + post).alias("_b"))
    # Frames of a camera may have holes: the next that exists after a group's start, and the last before its end, are carried along.
    frames = df.select(*keys, "frame_id", F.lit(0).alias("_k"), F.lit(None).cast("long").alias("rally_id"))
    marks = groups.select(*keys, F.explode(F.array(F.struct(F.col("_a").alias("frame_id"), F.lit(1).alias("_k")), F.struct(F.col("_b").alias("frame_id"), F.lit(2).alias("_k")))).alias("_m"), F.col("rally_id").cast("long").alias("rally_id"))
    both = frames.unionByName(marks.select(*keys, "_m.frame_id", "_m._k", "rally_id"))
    frame = F.when(F.col("_k") == 0, F.col("frame_id"))
    # Of rows of one frame a start comes first and an end last, so both see that frame.
    both = both.withColumn("_o", F.when(F.col("_k") == 1, 0).when(F.col("_k") == 0, 1).otherwise(2))
    both = carried(both, keys, ["frame_id", "_o"], {"_end": frame}, {"_start": frame}, of=df)
    out = both.filter("_k > 0").groupBy(*keys, "rally_id").agg(F.max(F.when(F.col("_k") == 1, F.col("_start"))).alias("start_frame"), F.max(F.when(F.col("_k") == 2, F.col("_end"))).alias("end_frame")).filter("start_frame <= end_frame")
    r = along(keys, "rally_id")
    out = out.withColumns({"_next": F.lead("start_frame").over(r), "_last": F.lag("end_frame").over(r)})
    end = F.when(F.col("end_frame") >= F.col("_next"), F.floor((F.col("end_frame") + F.col("_next")) / 2)).otherwise(F.col("end_frame"))
    start = F.when(F.col("_last") >= F.col("start_frame"), F.floor((F.col("_last") + F.col("start_frame")) / 2) + 1).otherwise(F.col("start_frame"))
    out = out.select(*keys, F.col("rally_id").cast("int").alias("rally_id"), start.cast("long").alias("start_frame"), end.cast("long").alias("end_frame"))
    return out.withColumns({"rally_start": rounded(F.col("start_frame") / F.lit(s.fps), 3), "rally_end": rounded(F.col("end_frame") / F.lit(s.fps), 3)})


def rally_of_frames(df: DataFrame, found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with the rally each frame lies in, the later one where two overlap, else null.

    Rallies of a camera don't overlap but in hand-made tables, so the last that started decides; it is carried
    forward over frames and starts together, not by a range join.
    """
    starts = found.select(*keys, F.col("start_frame").alias("frame_id"), F.struct("rally_id", "start_frame", "end_frame").alias("_r"))
    both = df.withColumn("_r", F.lit(None).cast(starts.schema["_r"].dataType)).withColumn("_k", F.lit(1)).unionByName(starts.withColumn("_k", F.lit(0)), allowMissingColumns=True)
    both = carried(both.withColumn("_id", F.col("_r.rally_id")), keys, ["frame_id", "_k", "_id"], {"_r": F.col("_r")}, of=df).filter("_k = 1").drop("_id")
    return both.withColumn("rally_id", F.when(F.col("frame_id") <= F.col("_r.end_frame"), F.col("_r.rally_id"))).drop("_r", "_k")


def frames_inside(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of the frames from start to end; a range without any raises."""
    out = df.filter(F.col("frame_id").between(start, end))
    if not out.limit(1).count():
        raise ValueError(f"no frame from {start} to {end}")
    return out


def crossings_per_rally(found: DataFrame, hits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """shots of each rally, 0 if none."""
    inside = rally_of_frames(hits, found, keys).filter("rally_id is not null").groupBy(*keys, "rally_id").agg(F.count("*").alias("shots"))
    return found.join(inside, [*keys, "rally_id"], "left").fillna(0, ["shots"])


def merge_empty(counted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rallies without a shot join the next that has one, at the end the last; numbered anew. All empty stay apart."""
    r = along(keys, "rally_id")
    full = F.when(F.col("shots") > 0, 1).otherwise(0)
    merged = counted.withColumns({"_g": F.coalesce(F.sum(full).over(before(r)), F.lit(0)), "_n": F.sum(full).over(Window.partitionBy(*keys))})
    merged = merged.withColumn("_g", F.when(F.col("_n") == 0, F.col("rally_id") - 1).otherwise(F.least("_g", F.col("_n") - 1)))
    out = merged.groupBy(*keys, "_g").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.sum("shots").alias("shots"))
    return out.withColumn("rally_id", F.row_number().over(along(keys, "_g"))).drop("_g")
