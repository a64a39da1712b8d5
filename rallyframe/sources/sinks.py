"""Where results go: CSV, JSON, posts (a dry run unless a sender is given)."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .posts import write_posts

log = logging.getLogger(__name__)
#: The order of the columns of result files.
PRIORITY = ("frame_id", "aligned_frame_id", "detected", "ball_u", "ball_v", "ball_conf", "is_outlier", "outlier_rule", "clean_u", "clean_v", "interp_u", "interp_v", "was_interpolated")


def in_order(df: DataFrame) -> DataFrame:
    """The well-known columns first, the rest as they come."""
    first = [c for c in PRIORITY if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def write_csv(df: DataFrame, path: str, by_camera: bool = True) -> None:
    """CSV with a header, a folder a camera."""
    writer = in_order(df).write.mode("overwrite").option("header", True)
    (writer.partitionBy("camera_name") if by_camera and "camera_name" in df.columns else writer).csv(path)


def write_results(cleaned: DataFrame, aligned: DataFrame | None, path: str) -> int:
    """Result files of a run by how many cameras it has: of two the aligned rows, of one the cleaned ones, else none, with a warning.

    Returns how many cameras were written.
    """
    n = cleaned.select("camera_name").distinct().count()
    if n not in (1, 2) or n == 2 and aligned is None:
        log.warning("no result files: %s cameras", n)
        return 0
    write_csv(aligned if n == 2 else cleaned, path)
    return n


def write_calibration(calibration: DataFrame, folder: str) -> None:
    """Calibrations (camera_name and the columns of the file) as JSON, a folder a camera."""
    calibration.write.mode("overwrite").partitionBy("camera_name").option("ignoreNullFields", "false").json(folder)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def post(payloads: DataFrame, sender: Callable[[str, str], int] | None = None) -> DataFrame:
    """(camera_name, rally_id, start_frame, sent): each payload. Without a sender all count as sent; errors don't stop others.

    sender(text, key) returns an HTTP status; 200, 201 and 204 are successes. The key is that of camera and first frame, so a
    receiver can tell a payload that a repeated task sends again.
    """
    if sender is None:
        return payloads.select("camera_name", "rally_id", "start_frame", F.lit(True).alias("sent"))

    def run(batches):
        for pdf in batches:
            sent = []
            for camera, frame, text in zip(pdf["camera_name"], pdf["start_frame"], pdf["payload"], strict=True):
                try:
                    sent.append(sender(text, f"{camera}-{frame}") in (200, 201, 204))
                except Exception:  # noqa: BLE001  a failed post is a row, not the end of the run
                    sent.append(False)
            yield pdf[["camera_name", "rally_id", "start_frame"]].assign(sent=sent)

    return payloads.select("camera_name", "rally_id", "start_frame", "payload").mapInPandas(run, "camera_name string, rally_id int, start_frame long, sent boolean")


def post_new(payloads: DataFrame, ledger: str, sender: Callable[[str, str], int] | None = None) -> DataFrame:
    """Posts the payloads that the ledger, a folder of Parquet, doesn't list by camera and first frame, and lists those that were sent.

    (camera_name, rally_id, start_frame, sent) of those it tried. Flushes overlap, so a rally comes with several of them; each is
    posted until it is sent once, by the transactional sink of sources.posts.
    """
    spark, key = payloads.sparkSession, ["camera_name", "start_frame"]

    def listed() -> DataFrame:
        try:
            return spark.read.schema("camera_name string, start_frame long").parquet(ledger).distinct()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], "camera_name string, start_frame long")

    new = stored(payloads.join(listed(), key, "left_anti").select("camera_name", "rally_id", "start_frame", "payload"), "to-post")
    write_posts(new, ledger, sender)
    done = new.join(listed().withColumn("sent", F.lit(True)), key, "left")
    return stored(done.select("camera_name", "rally_id", "start_frame", F.coalesce("sent", F.lit(False)).alias("sent")), "posted")


def http_sender(url: str, timeout: float = 30.0) -> Callable[[str, str], int]:
    """A sender that posts JSON to url; to be passed to post() on purpose."""

    def send(text: str, key: str) -> int:
        from urllib.request import Request, urlopen

        json.loads(text)
        with urlopen(Request(url, text.encode(), {"Content-Type": "application/json", "Idempotency-Key": key}), timeout=timeout) as answer:
            return answer.status

    return send


def sent_counts(sent: DataFrame) -> DataFrame:
    """Payloads sent per camera, and in all (camera_name null)."""
    return sent.rollup("camera_name").agg(F.count_if("sent").alias("n_sent"))
