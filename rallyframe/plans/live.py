"""A live run: flushed snapshots through the batch plans, new rallies posted, results written."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import parse_iso
from ..operators import cleaning, frames
from ..settings import DEFAULTS, Settings
from ..sources import sinks
from ..streaming import live
from . import batch
from .storage import stored

PLAYER_FILL = 5


def snapshot(rows: DataFrame, cameras: DataFrame, a: str, b: str, video_start: str | None = None, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(aligned table, reports) of one flush: dense frames, players filled both ways, all rules, alignment, rallies.

    A flush without both cameras raises.
    """
    known = {r.camera_name for r in rows.select("camera_name").distinct().collect()}
    if not {a, b} <= known:
        raise ValueError(f"a flush needs {a} and {b}, not {sorted(known)}")
    players = [c for c in rows.columns if c.startswith(("p0_", "p1_")) and not c.endswith("_conf")]
    dense = frames.fill_both_ways(frames.dense(rows), players, PLAYER_FILL)
    cleaned = stored(cleaning.clean(dense, cameras, True, s=s), "cleaned")
    start = video_start or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return batch.align(cleaned, a, b, s), batch.reports(cleaned, cameras, parse_iso(F.lit(start)), s)


def run(rows: DataFrame, cameras: DataFrame, a: str, b: str, folder: str, sender: Callable[[str, str], int] | None = None, video_start: str | None = None, available_now: bool = True, s: Settings = DEFAULTS, timeout: bool = False):
    """Starts a query that flushes the stream `rows`, posts each rally once and writes the reports to folder/reports.

    folder: in storage that all executors share; it also has the state and the ledger of posts. Without a sender nothing is sent.
    """

    def process(flush: DataFrame) -> None:
        _, reports = snapshot(flush, cameras, a, b, video_start, s)
        reports = stored(reports, "reports")
        sinks.post_new(reports, f"{folder}/posted", sender)
        reports.write.mode("append").json(f"{folder}/reports")

    return live.run_flushes(live.flushes(rows, 2, s, timeout), process, f"{folder}/state", available_now, timeout)
