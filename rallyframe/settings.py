"""Parameters of all stages in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass

#: One window partition per value of these. Add a match or flush id to spread more than a few cameras.
KEYS = ("camera_name",)
JOINTS = ("ls", "rs", "le", "re", "lw", "rw")
PLAYERS = ("p0", "p1")


@dataclass(frozen=True)
class Settings:
    # Fixed values, equal for results that agree: thresholds of the cleaning rules.
    conf_thr: float = 0.50
    u_min: float = 10.0
    u_max: float = 1920.0
    v_min: float = 10.0
    v_max: float = 1080.0
    snap_cos: float = -0.80
    snap_mult: float = 1.0
    iso_mult: float = 1.5
    floor_px: float = 20.0
    flat_snap: float = 80.0
    flat_iso: float = 150.0
    passes: int = 10
    static_px: float = 5.0
    static_len: int = 4
    seg_gap: int = 5
    seg_len: int = 5
    cross_frames: int = 8
    cross_part: float = 0.60
    half_court_len: int = 4
    path_window: int = 6
    path_px: float = 150.0
    fill_gap: int = 8
    # Fixed values too: alignment of two cameras.
    max_lag: int = 100
    peak_height: float = 30.0
    peak_distance: int = 5
    peak_prominence: float = 10.0
    # Fixed values too: motion, crossings and rallies.
    fps: float = 25.0
    motion_limit: int = 5
    silence_rows: int = 25
    slow_px: float = 5.0
    slow_rows: int = 30
    rally_rows: int = 150
    far_count: int = 2
    debounce: int = 20
    cross_gap: int = 25
    rally_gap_s: float = 8.0
    before_s: float = 3.0
    after_s: float = 3.0
    # Fixed values too: speeds and distances.
    lookback: int = 30
    net_correction: float = 2.0
    speed_knee: float = 60.0
    speed_slope: float = 0.2
    speed_cap: float = 110.0
    speed_least: float = 10.0
    move_least: float = 0.05
    move_most: float = 2.0
    court_length: float = 23.77
    court_width: float = 8.23
    # Fixed values too: live input.
    min_rows: int = 200
    quiet_s: float = 10.0
    force_s: float = 300.0
    overlap_s: float = 30.0
    # Fixed values too: what the ball's model is given. The mask is top, left, bottom, right; means and deviations are of red, green, blue.
    model_height: int = 288
    model_width: int = 512
    clock_mask: tuple[int, int, int, int] = (0, 0, 41, 603)
    image_mean: tuple[float, float, float] = (0.485, 0.456, 0.406)
    image_std: tuple[float, float, float] = (0.229, 0.224, 0.225)


DEFAULTS = Settings()
