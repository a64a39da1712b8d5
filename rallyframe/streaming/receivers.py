"""Receivers: a task a camera that takes rows from a network decoder and lands them in the folder that the live source reads.

A socket can't be read again, so what comes from it is written down first: a query that starts again, or a lost executor, reads the
files. A receiver connects again RETRY_S seconds after its decoder is gone or doesn't answer, and frame numbers go on across
connections, tasks and runs: the next number follows the last one that was landed for the camera.
"""

from __future__ import annotations

import json
import logging
import socket
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)
RETRY_S, OPEN_S, READ_S = 3.0, 10.0, 10.0
STOP = "_stop"


def lines_of(connection: socket.socket, stopped: Callable[[], bool]) -> Iterator[bytes]:
    """Whole lines until the other side closes, or is silent for READ_S; a last line without an end is left out."""
    held, heard = b"", time.monotonic()
    connection.settimeout(0.2)
    while not stopped():
        try:
            part = connection.recv(1 << 16)
        except TimeoutError:
            if time.monotonic() - heard > READ_S:
                return
            continue
        if not part:
            return
        heard = time.monotonic()
        *whole, held = (held + part).split(b"\n")
        yield from whole


def _place(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def last_frame(system, folder: str, camera: str) -> int:
    """The last frame number that any receiver of this camera has landed; -1 if none."""
    from pyarrow import fs

    last = -1
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.is_file and info.base_name.rsplit("-", 1)[0] == quote(camera, safe=""):
            with system.open_input_file(info.path) as f:
                *whole, _ = f.read_at(min(info.size, 1 << 16), max(0, info.size - (1 << 16))).split(b"\n")
            for line in reversed(whole):
                try:
                    last = max(last, int(json.loads(line)["frame_id"]))
                    break
                except (ValueError, TypeError, KeyError):  # the end of a session, or a line that a lost task left half written
                    continue
    return last


def receive(camera: str, host: str, port: int, session: str, folder: str, seconds: float | None = None, clock: Callable[[], float] = time.time, retry_s: float = RETRY_S) -> tuple[int, int]:
    """(rows landed, connections made) until the folder has a file named STOP, or for some seconds.

    The decoder sends JSON objects, a line each; session, time of arrival, camera and frame number are set here. Lines that are no
    objects are left out, with a warning, and have no number.
    """
    system, root = _place(folder)
    system.create_dir(root, recursive=True)
    began = time.monotonic()

    def stopped() -> bool:
        return (seconds is not None and time.monotonic() - began >= seconds) or system.get_file_info(f"{root}/{STOP}").is_file

    frame, rows, connections = last_frame(system, root, camera) + 1, 0, 0
    while not stopped():
        try:
            with socket.create_connection((host, port), timeout=OPEN_S) as connection:
                connections += 1
                # Each connection has a file of its own, so that no two tasks ever write to one.
                with system.open_output_stream(f"{root}/{quote(camera, safe='')}-{uuid.uuid4().hex}.jsonl", buffer_size=0) as out:
                    for line in lines_of(connection, stopped):
                        try:
                            x = json.loads(line)
                            row = {**x, "session": session, "arrived": clock(), "camera_name": camera, "frame_id": frame}
                        except (ValueError, TypeError):
                            log.warning("%s sent a line that is no row: %.80r", camera, line)
                            continue
                        out.write((json.dumps(row) + "\n").encode())
                        frame, rows = frame + 1, rows + 1
        except OSError as error:
            log.warning("%s at %s:%s: %s; again in %s s", camera, host, port, error, retry_s)
        until = time.monotonic() + retry_s
        while time.monotonic() < until and not stopped():
            time.sleep(min(0.1, retry_s))
    return rows, connections


def receivers(sources: DataFrame, session: str, folder: str, seconds: float | None = None, retry_s: float = RETRY_S) -> DataFrame:
    """(camera_name, rows, connections) of receivers for sources (camera_name, host, port), a task each; ends when they stop.

    A task that Spark runs again goes on after what the lost one landed.
    """

    def run(batches):
        for pdf in batches:
            done = [(r.camera_name, *receive(r.camera_name, r.host, int(r.port), session, folder, seconds, retry_s=retry_s)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(done, columns=["camera_name", "rows", "connections"])

    system, root = _place(folder)
    if system.get_file_info(f"{root}/{STOP}").is_file:  # of an earlier run
        system.delete_file(f"{root}/{STOP}")
    # Rows of one partition are dealt out in turn: one to a task.
    dealt = sources.select("camera_name", "host", "port").coalesce(1).repartition(max(1, sources.count()))
    return dealt.mapInPandas(run, "camera_name string, rows long, connections long")


def stop(folder: str) -> None:
    """Tells the receivers of a folder to end, once the line they are at is written."""
    system, root = _place(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{STOP}"):
        pass

