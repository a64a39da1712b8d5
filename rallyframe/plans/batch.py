"""Whole runs: detections to cleaned, aligned tables, rallies and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning, frames, players, rallies, sync
from ..settings import DEFAULTS, Settings
from .storage import stored


@dataclass(frozen=True)
class Match:
    """Tables of an analysed match."""

    moving: DataFrame
    crossings: DataFrame
    rallies: DataFrame
    located: DataFrame
    shots: DataFrame
    moved: DataFrame


def analyse(cleaned: DataFrame, cameras: DataFrame, s: Settings = DEFAULTS) -> Match:
    """Motion, crossings, rallies, places, speeds and moves of cleaned detections; the first four are stored tables."""
    moving = stored(rallies.motion(cleaned, s=s), "moving")
    hits = stored(rallies.crossings(moving, cameras, s=s), "crossings")
    found = stored(rallies.rallies(moving, hits, s=s), "rallies")
    located = stored(players.ball_speeds(players.located(rallies.rally_of_frames(moving, found), cameras), s=s), "located")
    shots = located.join(hits.select("camera_name", "frame_id"), ["camera_name", "frame_id"], "left_semi")
    moved = players.moves(located, s=s)
    return Match(moving, hits, found, located, shots, moved)


def reports(cleaned: DataFrame, cameras: DataFrame, video_start: Column, s: Settings = DEFAULTS) -> DataFrame:
    """(camera_name, rally_id, start_frame, payload) of every rally."""
    m = analyse(cleaned, cameras, s)
    stats = players.player_stats(m.moved, s=s)
    return players.payloads(m.rallies, m.located, m.shots, stats, cameras, video_start, s)


def align(cleaned: DataFrame, a: str, b: str, s: Settings = DEFAULTS) -> DataFrame:
    """cleaned with aligned_frame_id."""
    tau = sync.best_lag(sync.lag_correlation(sync.accel_signal(cleaned), a, b, s.max_lag), s.max_lag)
    return sync.aligned_frames(cleaned, tau, b)


def run(detections: DataFrame, cameras: DataFrame, a: str, b: str, video_start: Column, net_rule: bool = False, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(aligned table, reports) of a batch of two cameras."""
    cleaned = stored(cleaning.clean(frames.dense(detections), cameras, net_rule, s=s), "cleaned")
    return align(cleaned, a, b, s), reports(cleaned, cameras, video_start, s)
