"""Live input: a source that reads frames as decoders write them, buffers per session, and flushes through the batch plans."""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor

from ..settings import DEFAULTS, JOINTS, Settings
from ..sources.tables import DETECTIONS, KEYPOINTS

log = logging.getLogger(__name__)
ROWS = f"session string, arrived double, {DETECTIONS}"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
VALUES = NAMES[4:]
TEXT = ("session", "camera_name")


#: Bytes of a file's first line, and before an offset, that tell a file from one that took its place.
MARK = 512


class FrameSource(DataSource):
    """Rows of JSON lines that decoders append to the files of a folder, a file a camera.

    Options: path, the folder or a file, in storage that driver and executors share; maxBytesPerFile, about how much of a file a
    batch takes at most (64 MB; a line is never split). An available-now run is one batch.

    The offset has, of each file, how many bytes were read, up to the last whole line, with the file's epoch and a mark: hashes of
    its first line and of the bytes before that place. So nothing is read twice, and a half-written line waits. A file that was
    cut short or replaced no longer bears its mark: its next epoch begins, and it is read from the start. Bytes of an epoch that had not been read
    when the file was replaced are gone; a batch that is repeated after that finds the mark missing, and leaves the file out with a
    warning rather than reading from the middle of other rows. A file that was removed keeps its place, so that it isn't read again
    if it comes back as it was. Each file of a batch is a partition of its own.

    Defined cases: a folder that doesn't exist yet is empty; lines that aren't JSON objects, as a decoder that crashed leaves, are
    left out with a warning; null detections count as 0; other fields are not read.
    """

    @classmethod
    def name(cls) -> str:
        return "court_frames"

    def schema(self) -> str:
        return ROWS

    def streamReader(self, schema):  # noqa: N802
        return FrameReader(self.options["path"], int(self.options.get("maxBytesPerFile", 64 << 20)))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, as court_frames."""
    spark.dataSource.register(FrameSource)


class Span(InputPartition):
    """Bytes start to end of a file that bears a mark."""

    def __init__(self, path: str, start: int, end: int, mark: list):
        self.path, self.start, self.end, self.mark = path, start, end, mark


class FrameReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, max(1, most)
        self.seen: dict[str, dict] | None = None

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def initialOffset(self):  # noqa: N802
        return {}

    @staticmethod
    def _mark(f, at: int) -> list:
        """What the file holds at its start and before a place; its first line is whole if the place is the end of a line."""
        digest = lambda x: blake2b(x, digest_size=8).hexdigest()
        return [digest(f.read_at(min(MARK, at), 0).split(b"\n", 1)[0]), digest(f.read_at(min(MARK, at), max(0, at - MARK)))]

    def _bears(self, f, size: int, at: int, mark: list) -> bool:
        return size >= at and (not at or self._mark(f, at) == mark)

    def latestOffset(self):  # noqa: N802
        from pyarrow import fs

        # Spark plans the last batch again when a query starts from a checkpoint, which tells where it was.
        self.seen = self.seen or {}
        system, root = self._system()
        info = system.get_file_info(root)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        for info in files:
            if not info.is_file or info.base_name.startswith(("_", ".")):
                continue
            was = self.seen.get(info.path, {"epoch": 0, "at": 0, "mark": None})
            with system.open_input_file(info.path) as f:
                if not self._bears(f, info.size, was["at"], was["mark"]):
                    was = {"epoch": was["epoch"] + 1, "at": 0, "mark": None}
                if (at := self._whole_lines(f, was["at"], info.size)) > was["at"]:
                    was = {"epoch": was["epoch"], "at": at, "mark": self._mark(f, at)}
                self.seen[info.path] = was
        return dict(self.seen)

    def _whole_lines(self, f, start: int, size: int) -> int:
        """Where the last whole line ends that is within reach of start; if none is, where the first does."""
        end = low = min(size, start + self.most)
        while low > start:
            part = f.read_at(min(1 << 16, low - start), max(start, low - (1 << 16)))
            if (at := part.rfind(b"\n")) >= 0:
                return low - len(part) + at + 1
            low -= len(part)
        while end < size:
            part = f.read_at(min(1 << 16, size - end), end)
            if (at := part.find(b"\n")) >= 0:
                return end + at + 1
            end += len(part)
        return start

    def partitions(self, start, end):
        self.seen = {**end, **(self.seen or {})}
        out = []
        for path, now in sorted(end.items()):
            was = start.get(path, {"epoch": now["epoch"], "at": 0})
            begin = was["at"] if was["epoch"] == now["epoch"] else 0
            if now["at"] > begin:
                out.append(Span(path, begin, now["at"], now["mark"]))
        return out

    def read(self, partition):
        system, _ = self._system()
        size = system.get_file_info(partition.path).size or 0
        lines: list[bytes] = []
        if size:
            with system.open_input_file(partition.path) as f:
                if self._bears(f, size, partition.end, partition.mark):
                    lines = f.read_at(partition.end - partition.start, partition.start).splitlines()
        if not lines:
            log.warning("%s was replaced before bytes %s to %s were read", partition.path, partition.start, partition.end)
        for line in lines:
            try:
                x = json.loads(line)
                if x.get("frame_id") is not None:
                    x["detected"], x["ball_conf"] = int(x.get("detected") or 0), float(x.get("ball_conf") or 0.0)
                row = tuple(None if x.get(c) is None else x[c] if c in (*TEXT, "frame_id", "detected") else float(x[c]) for c in NAMES)
            except (ValueError, TypeError, AttributeError):
                log.warning("%s: a line that is no row: %.80r", partition.path, line)
                continue
            yield row


FLUSHED = f"session string, flush_no int, {DETECTIONS}"
BUFFERED = f"camera_name string, frame_id bigint, {DETECTIONS.split(', ', 2)[2]}"
#: Settings of a query with state: only changes are written on a trigger, not the whole state.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Flusher(StatefulProcessor):
    """The buffers of a session: a list of rows, a map of what is known of each camera, and a record of the session.

    A trigger appends its rows to the list and reads none of it; only a flush reads the list, and puts back what stays.
    """

    def __init__(self, cameras: int, s: Settings, timers: bool, ttl_s: float | None):
        self.cameras, self.s, self.timers, self.ttl = cameras, s, timers, ttl_s

    def init(self, handle) -> None:
        ttl = int(1000 * self.ttl) if self.timers and self.ttl else None
        self.handle = handle
        self.rows = handle.getListState("rows", BUFFERED, ttl)
        self.known = handle.getMapState("cameras", "camera_name string", "n bigint, detected double")
        self.session = handle.getValueState("session", "flush_no int, flushed double, latest double, waited double, fresh boolean")

    # What is known of the session is read once a call, and written back once.

    def _load(self) -> None:
        self.flush_no, self.flushed, self.latest, self.waited, self.fresh = self.session.get() if self.session.exists() else (0, None, None, 0.0, False)
        self.n, self.seen = {}, {}
        for (camera,), (n, at) in self.known.iterator() if self.known.exists() else ():
            self.n[camera] = n
            if at is not None:
                self.seen[camera] = at
        self.was = dict(self.n), dict(self.seen)

    def _save(self) -> None:
        for camera, n in self.n.items():
            if (n, self.seen.get(camera)) != (self.was[0].get(camera), self.was[1].get(camera)):
                self.known.updateValue((camera,), (n, self.seen.get(camera)))
        self.session.update((self.flush_no, self.flushed, self.latest, self.waited, self.fresh))

    def _forget(self) -> None:
        """After the end of a session; the number of flushes stays, so that later rows of it don't repeat one."""
        self.rows.clear()
        for camera in {*self.n, *self.was[0]}:
            self.known.removeKey((camera,))
        self.n, self.seen, self.was = {}, {}, ({}, {})
        self.flushed, self.fresh = None, False

    def _append(self, part: pd.DataFrame) -> None:
        if len(part):
            part = part.astype({"frame_id": "int64", "detected": "int32"})  # floats where a batch has null ones
            self.rows.appendList(list(part.astype(object).where(part.notna(), None).itertuples(index=False, name=None)))
            for camera, n in part["camera_name"].value_counts().items():
                self.n[camera] = self.n.get(camera, 0) + int(n)
            self.fresh = True

    def _flush(self, key, now: float, final: bool = False) -> pd.DataFrame:
        """The buffered rows, the last of a camera and frame; all but the last s.overlap_s of them leave the buffer."""
        held = pd.DataFrame(list(self.rows.get()) if self.rows.exists() else [], columns=[x.split()[0] for x in BUFFERED.split(", ")])
        held = held.drop_duplicates(["camera_name", "frame_id"], keep="last").sort_values(["camera_name", "frame_id"], ignore_index=True)
        self.flush_no, self.flushed, self.fresh = self.flush_no + 1, now, False
        out = held.copy()
        out.insert(0, "session", key[0])
        out.insert(1, "flush_no", self.flush_no)
        if not final:
            rest = held.groupby("camera_name", sort=False).tail(int(self.s.fps * self.s.overlap_s))
            # Counts follow the list, also where rows have outlived their time.
            self.n = dict.fromkeys(self.n, 0)
            self.rows.clear()
            self._append(rest)
            self.fresh = False
        return out.astype({"flush_no": "int32", "frame_id": "int64", "detected": "int32"} | {c: "float64" for c in out.columns[5:]})

    def _due(self, pdf: pd.DataFrame):
        """For each row, whether a flush is due once it has come: enough rows of every camera, and all quiet or too long since the last."""
        now, camera, hit = pdf["arrived"].to_numpy(float), pdf["camera_name"].to_numpy(object), pdf["detected"].to_numpy(float) > 0
        enough, quiet, met, any_seen = np.ones(len(pdf), bool), np.ones(len(pdf), bool), np.zeros(len(pdf), int), np.zeros(len(pdf), bool)
        for c in {*self.n, *camera}:
            own = camera == c
            count = self.n.get(c, 0) + np.cumsum(own)
            met += count > 0
            enough &= (count >= self.s.min_rows) | (count == 0)
            # The clock of rows that come in order of arrival only grows.
            last = np.maximum.accumulate(np.where(own & hit, now, self.seen.get(c, -np.inf)))
            any_seen |= last > -np.inf
            quiet &= now - last >= self.s.quiet_s
        return (met >= self.cameras) & enough & ((any_seen & quiet) | (now - self.flushed >= self.s.force_s))

    def _take(self, key, pdf: pd.DataFrame):
        """Buffers rows of one session in order of arrival, and yields flushes between them."""
        columns = [x.split()[0] for x in BUFFERED.split(", ")]
        while len(pdf):
            self.flushed = float(pdf["arrived"].iloc[0]) if self.flushed is None else self.flushed
            due = np.flatnonzero(self._due(pdf))
            part = pdf.iloc[: due[0] + 1] if len(due) else pdf
            hits = part[part["detected"] > 0].groupby("camera_name")["arrived"].max()
            self._append(part[columns])
            self.seen.update({c: max(float(t), self.seen.get(c, -np.inf)) for c, t in hits.items()})
            self.latest, self.waited = float(part["arrived"].iloc[-1]), 0.0
            if len(due):
                yield self._flush(key, self.latest)
            pdf = pdf.iloc[len(part) :]

    def _end(self, key):
        if self.fresh:
            yield self._flush(key, self.latest, final=True)
        self._forget()

    def _set_timer(self, timer_values) -> None:
        """A timer for the next moment at which silence alone makes a flush due, or ends the session."""
        if not self.timers:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not self.n:
            return
        now = (self.latest or 0.0) + self.waited
        moments = [self.flushed + self.s.force_s, (self.latest or 0.0) + self.s.force_s, max(self.seen.values(), default=now) + self.s.quiet_s]
        wait = min((m for m in moments if m > now + 0.001), default=now + self.s.force_s) - now
        self.waited += wait
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + max(1, int(1000 * wait)))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        self._load()
        for pdf in rows:
            pdf = pdf.sort_values("arrived", kind="stable", ignore_index=True)
            pdf["detected"] = pdf["detected"].fillna(0)
            ends, at = np.flatnonzero(pdf["frame_id"].isna()), 0
            for end in (*ends, len(pdf)):
                yield from self._take(key, pdf.iloc[at:end])
                if end < len(pdf):
                    yield from self._end(key)
                at = end + 1
        self._set_timer(timerValues)
        self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self._load()
        now = (self.latest or 0.0) + self.waited
        enough = len(self.n) >= self.cameras and min(self.n.values()) >= self.s.min_rows
        quiet = bool(self.seen) and all(now - t >= self.s.quiet_s for t in self.seen.values())
        if self.n and self.fresh and enough and (quiet or now - self.flushed >= self.s.force_s):
            yield self._flush(key, now)
        if self.waited >= self.s.force_s:  # the session is over
            yield from self._end(key)
        self._set_timer(timerValues)
        self._save()


def flushes(rows: DataFrame, cameras: int = 2, s: Settings = DEFAULTS, timeout: bool = False, ttl_s: float | None = 86_400.0) -> DataFrame:
    """Snapshots of the buffered rows, whenever a flush is due, numbered; a stream of (session, flush_no, detection).

    rows: a stream of detections with session and arrived (seconds); columns of ROWS that it lacks are null. All cameras of a
    session share one state, since a flush needs all of them: enough rows in each, then all quiet, or too long since the last.
    After a flush the last s.overlap_s stay buffered. Of rows of one frame the last counts. A trigger writes its new rows to the
    state, and reads the buffer only to flush it.

    The end of a session is a row with a null frame_id. With timeout, silence counts too, by timers: when the cameras would have been
    quiet long enough, or the last flush is too long ago, a flush comes without a further row; no row for s.force_s ends the
    session; and rows that no flush took for ttl_s, say because the other camera never came, are dropped. Timers outlive a run: what a
    run that ends has left is flushed, if it is due by then, by the next that has any new row; without one Spark plans no batch. What is buffered at the end of a session makes a final
    flush, however little it is, if anything came since the last.

    Defined cases: a null number of detections counts as 0; rows of a null session are a session of their own; an empty stream gives nothing.
    """
    rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in ROWS.split(", "))])
    return rows.groupBy("session").transformWithStateInPandas(Flusher(cameras, s, timeout, ttl_s), FLUSHED, "Append", "ProcessingTime" if timeout else "None")


def run_flushes(flushed: DataFrame, process: Callable[[DataFrame], None], checkpoint: str, available_now: bool = True, timeout: bool = False):
    """Feeds each snapshot to `process`, the batch plan. One that fails is logged and left; the others, and the stream, go on.

    The rows of the last s.overlap_s of a snapshot that failed come again with the next one; the earlier ones don't. An available-now
    run takes what has come, and ends; with timeout, as for flushes(), it also makes the flushes that are due by their timers, in a
    last batch without rows.
    """
    for name, value in STATE_STORE.items():
        flushed.sparkSession.conf.set(name, value)

    def each(df: DataFrame, _batch: int) -> None:
        df = df.persist()
        try:
            for row in df.select("session", "flush_no").distinct().orderBy("session", "flush_no").collect():  # a few flushes a batch
                try:
                    process(df.filter(F.col("session").eqNullSafe(row.session) & (F.col("flush_no") == row.flush_no)).drop("session", "flush_no"))
                except Exception:  # noqa: BLE001  a failed flush must not end the stream
                    log.exception("flush %s of session %s failed", row.flush_no, row.session)
        finally:
            df.unpersist()

    writer = flushed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if not available_now:
        return writer.trigger(processingTime="2 seconds").start()
    if not timeout:
        return writer.trigger(availableNow=True).start()
    # With timers Spark always plans another batch: the run is over when one had no rows, in which due timers fired.
    query = writer.trigger(processingTime="2 seconds").start()
    threading.Thread(target=_stop_when_idle, args=(query,), daemon=True).start()
    return query


def _stop_when_idle(query) -> None:
    """Stops the query between two triggers, after one without rows."""
    while query.isActive:
        status, last = query.status, query.lastProgress
        between = not status["isTriggerActive"] and status["message"].startswith("Waiting")
        if between and not status["isDataAvailable"] and (last is None or last["numInputRows"] == 0):
            query.stop()
        time.sleep(0.2)


BALLS = "camera_name string, frame_id long, detected int, ball_u double, ball_v double, ball_conf double"


def _windows(rows, size: int):
    """Runs of rows (camera, frame, ...) of one camera whose frames fall to one window of `size` frame numbers, in order."""
    window: list = []
    for r in rows:
        if window and (window[0][0] != r[0] or window[0][1] // size != r[1] // size):
            yield window
            window = []
        window.append(r)
    if window:
        yield window


def _detected(window: list, detector, threshold: float) -> list[tuple]:
    got = detector([r[2] for r in window])
    return [(r[0], r[1], int(c >= threshold), u if c >= threshold else None, v if c >= threshold else None, c) for r, (u, v, c) in zip(window, got, strict=True)]


def detect_balls(images: DataFrame, detector: Callable[[list[bytes]], list[tuple]], schema: str = BALLS, threshold: float = DEFAULTS.conf_thr, size: int = 3, run_of: int = 256) -> DataFrame:
    """Detections of images (camera_name, frame_id, image) by a plug-in model, a window of `size` frames at a time.

    detector(images) returns (u, v, conf) of each; below the threshold nothing is detected. Windows are the frames whose numbers have
    one floor(frame / size), so they don't depend on how rows are dealt out, and don't mix cameras; where frames are missing a
    window has fewer. Rows are dealt out by runs of `run_of` windows, so a camera is many tasks. Images are shuffled for that: where
    they come from video files, detect_in_videos() decodes beside the model instead.
    """

    def run(batches):
        rows = (r for pdf in batches for r in pdf.itertuples(index=False, name=None))
        for window in _windows(rows, size):
            yield pd.DataFrame(_detected(window, detector, threshold), columns=[x.split()[0] for x in schema.split(", ")])

    run_no = F.floor(F.col("frame_id") / (size * run_of))
    dealt = images.select("camera_name", "frame_id", "image").repartition("camera_name", run_no).sortWithinPartitions("camera_name", "frame_id")
    return dealt.mapInPandas(run, schema)


def detect_in_videos(videos: DataFrame, decode: Callable[[str, int, int], Iterator[tuple[int, bytes]]], detector: Callable[[list[bytes]], list[tuple]], schema: str = BALLS, threshold: float = DEFAULTS.conf_thr, size: int = 3, halo: int = 0, split: int = 3000) -> DataFrame:
    """Detections of video files (camera_name, path, frames), decoded and judged in one task a split; no image is ever shuffled.

    decode(path, first, end) yields (frame_id, image) of the frames from first up to end, which is outside; it and the detector are plug-ins. A
    split is about `split` frames of a file, and ends between windows, so rows are the same for any split. With a halo, the
    detector is given that many frames before the window too, and returns a result of each; those of the halo are left out.

    Defined cases: a file of no or unknown length gives no row; frames that the decoder leaves out are left out; frames are
    decoded in order, as a decoder that comes to an earlier one is an error.
    """
    aligned = max(size, split // size * size)
    splits = videos.filter("frames > 0").select("camera_name", "path", "frames", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(aligned).cast("long"))).alias("first"))
    splits = splits.select("camera_name", "path", "first", F.least(F.col("first") + aligned, "frames").alias("end"))

    def run(batches):
        for pdf in batches:
            for camera, path, first, end in pdf.itertuples(index=False, name=None):
                before, part, last = [], [], -1
                for window in _windows(((camera, frame, image) for frame, image in decode(path, max(0, first - halo), end)), size):
                    if window[0][1] <= last:
                        raise ValueError(f"{path}: frame {window[0][1]} after {last}")
                    last = window[-1][1]
                    if last >= first:  # not a window of the halo
                        near = [r for r in before if r[1] >= window[0][1] - halo]
                        part += _detected(near + window, detector, threshold)[len(near) :]
                    before = [*before, *window][-halo:] if halo else []
                    if len(part) >= 1000:
                        yield pd.DataFrame(part, columns=[x.split()[0] for x in schema.split(", ")])
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=[x.split()[0] for x in schema.split(", ")])

    # The rows dealt out are splits: a path and two numbers each.
    return splits.repartition(max(1, videos.sparkSession.sparkContext.defaultParallelism), "path", "first").mapInPandas(run, schema)


def estimate_poses(images: DataFrame, estimator: Callable[[bytes], list[dict]], most: int = 2) -> DataFrame:
    """(camera_name, frame_id, players) by a plug-in model: the largest boxes, lowest in the picture first.

    estimator(image) returns dicts with the joints (u, v, conf) and bbox (x1, y1, x2, y2) that it saw.
    """
    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                seen = sorted(estimator(r.image), key=lambda p: -(p["bbox"][2] - p["bbox"][0]) * (p["bbox"][3] - p["bbox"][1]))[:most]
                seen.sort(key=lambda p: -(p["bbox"][1] + p["bbox"][3]))
                rows.append((r.camera_name, r.frame_id, [{j: dict(zip(("u", "v", "conf"), p[j], strict=True)) if p.get(j) else None for j in JOINTS} | {"bbox": dict(zip(("x1", "y1", "x2", "y2"), p["bbox"], strict=True))} for p in seen]))
            yield pd.DataFrame(rows, columns=["camera_name", "frame_id", "players"])

    return images.select("camera_name", "frame_id", "image").mapInPandas(run, f"camera_name string, frame_id long, players array<{KEYPOINTS}>")
