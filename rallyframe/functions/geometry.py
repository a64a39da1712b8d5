"""Column functions: speeds, angles, the court's coordinates, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings


def rounded(x: Column, places: int) -> Column:
    """Scaled, rounded half to even, scaled back."""
    return F.rint(x * float(10**places)) / float(10**places)


def distance(du: Column, dv: Column) -> Column:
    return F.sqrt(du * du + dv * dv)


def speed(du: Column, dv: Column, dt: Column) -> Column:
    return distance(du, dv) / F.greatest(dt, F.lit(1))


def cosine(du1: Column, dv1: Column, du2: Column, dv2: Column) -> Column:
    n1, n2 = distance(du1, dv1), distance(du2, dv2)
    product = n1 * n2
    return F.when((n1 < 1e-9) | (n2 < 1e-9), 0.0).otherwise((du1 * du2 + dv1 * dv2) / F.when(product != 0, product))


def thresholds(v: Column, alpha: Column, beta: Column, s: Settings = DEFAULTS) -> tuple[Column, Column]:
    """Speeds beyond which a ball snaps back, and is isolated; flat without calibration."""
    top = F.when(alpha.isNotNull() & beta.isNotNull(), F.greatest(F.lit(s.floor_px), alpha * v + beta))
    return F.coalesce(top * s.snap_mult, F.lit(s.flat_snap)), F.coalesce(top * s.iso_mult, F.lit(s.flat_iso))


def calibration(clicks: Column, fps: Column, v_max_ms: Column, width_m: Column) -> Column:
    """alpha and beta from clicks at far left, far right, near left, near right."""
    at = lambda i, j: F.get(F.get(clicks, F.lit(i)), F.lit(j))
    y_far, y_near = (at(0, 1) + at(1, 1)) / 2, (at(2, 1) + at(3, 1)) / 2
    far, near = F.abs(at(1, 0) - at(0, 0)), F.abs(at(3, 0) - at(2, 0))
    k = v_max_ms / (fps * width_m)
    alpha = k * ((near - far) / F.when(y_near != y_far, y_near - y_far))
    return F.struct(y_far.alias("y_far"), far.alias("px_width_far"), y_near.alias("y_near"), near.alias("px_width_near"), alpha.alias("alpha"), (k * far - alpha * y_far).alias("beta"))


def calibrated(clicks: DataFrame, cameras: DataFrame, more: list[str]) -> DataFrame:
    """(camera_name, more, y_far, px_width_far, y_near, px_width_near, alpha, beta) from a table of clicks (camera_name, more, click_no, u, v).

    A calibration has four clicks, in order of click_no: far left, far right, near left, near right. Others are left out; where far and
    near are one line alpha and beta are null. cameras: a row a camera, with fps, v_max_ms and court_width_m.
    """
    keys = ["camera_name", *more]
    four = clicks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("click_no", "u", "v"))).alias("_c")).filter("size(_c) = 4")
    about = cameras.select("camera_name", "fps", "v_max_ms", "court_width_m")
    places = F.transform("_c", lambda c: F.array(c["u"], c["v"]))
    found = four.join(F.broadcast(about), "camera_name").select(*keys, calibration(places, F.col("fps"), F.col("v_max_ms"), F.col("court_width_m")).alias("_k"))
    return found.select(*keys, "_k.*")


def to_world(u: Column, v: Column, h: Column) -> Column:
    """The court's place of a pixel, as struct<x, y>; null if a value is missing or the point is at infinity."""
    m = [F.get(h, F.lit(k)) for k in range(9)]
    w = m[6] * u + m[7] * v + m[8]
    safe = F.when(F.abs(w) >= 1e-10, w)
    x, y = (m[0] * u + m[1] * v + m[2]) / safe, (m[3] * u + m[4] * v + m[5]) / safe
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def to_court(world: Column, s: Settings = DEFAULTS) -> tuple[Column, Column]:
    """x across and y from the far baseline, both from 0 to 1, 3 places."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), world["x"] / s.court_width))
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - world["y"] / s.court_length))
    return F.when(world.isNotNull(), rounded(x, 3)), F.when(world.isNotNull(), rounded(y, 3))


def ball_kmh(meters: Column, rows: Column, fps: float, s: Settings = DEFAULTS) -> Column:
    """Speed of a ball that went so far in so many rows: corrected, compressed above the knee, capped, 0 if slow."""
    raw = meters * fps * 3.6 / F.greatest(rows, F.lit(1)) / s.net_correction
    bent = F.least(F.when(raw > s.speed_knee, s.speed_knee + (raw - s.speed_knee) * s.speed_slope).otherwise(raw), F.lit(s.speed_cap))
    return F.coalesce(F.when(raw.isNotNull() & (bent >= s.speed_least), bent), F.lit(0.0))  # least() passes over a null


def iso_seconds(ts: Column) -> Column:
    """UTC, with the fraction cut off."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """UTC time of an ISO text, with or without Z."""
    return F.try_to_timestamp(F.concat(F.regexp_replace(text, "Z$", ""), F.lit("Z")))


def interpretation(a: str, b: str, tau: Column) -> Column:
    how = F.when(tau >= 0, F.lit(f"{b} lags {a} by ")).otherwise(F.lit(f"{b} leads {a} by "))
    return F.concat(how, F.abs(tau).cast("string"), F.lit(" frames"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def area(box: Column) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def centre_y(box: Column) -> Column:
    return (box["y1"] + box["y2"]) / 2
