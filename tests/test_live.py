"""The live source, receivers and buffers: files that change, decoders that go away, timers, and what a trigger writes."""

import dataclasses
import json
import os
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from rallyframe.settings import DEFAULTS
from rallyframe.streaming import live, receivers

LIVE = "session string, arrived double, camera_name string, frame_id long, detected int, ball_u double, ball_v double, ball_conf double"


def lines(rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def row(camera, k, u=0.0):
    return {"session": "s", "arrived": float(k), "camera_name": camera, "frame_id": k, "detected": 1, "ball_u": u + k}


@pytest.fixture
def source(spark, tmp_path):
    """Runs the source to its end, as often as called, and returns what was new, by batch."""
    live.register(spark)

    def go(**options):
        batches = []
        stream = spark.readStream.format("court_frames").option("path", str(tmp_path / "in")).options(**options).load()
        query = stream.writeStream.foreachBatch(lambda df, _: batches.append(sorted((r.camera_name, r.frame_id, r.ball_u) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        return [b for b in batches if b]

    (tmp_path / "in").mkdir()
    return go


def test_a_replaced_or_shortened_file_is_read_from_its_start(source, tmp_path):
    a, b = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"
    a.write_text(lines(row("a", k) for k in range(5)))
    b.write_text(lines(row("b", k) for k in range(5)))
    assert sum(map(len, source())) == 10
    # a is replaced by a file as long; b is cut short and written anew.
    size = a.stat().st_size
    a.write_text(lines(row("a", k, 0.5) for k in range(5)))
    assert a.stat().st_size == size
    b.write_text(lines([row("b", 7)]))
    assert sum(source(), []) == [("a", k, 0.5 + k) for k in range(5)] + [("b", 7, 7.0)]
    with open(a, "a") as f:
        f.write(lines([row("a", 5, 0.5)]) + '{"sess')
    with open(b, "a") as f:
        f.write("no json\n[1]\n" + lines([row("b", 8)]))
    assert sum(source(), []) == [("a", 5, 5.5), ("b", 8, 8.0)]
    os.remove(b)
    assert source() == []


def test_batches_are_bounded_and_go_on_after_a_restart(source, tmp_path):
    a = tmp_path / "in" / "a.jsonl"
    text = lines(row("a", k) for k in range(20))
    a.write_text(text + '{"half')
    most = len(text) // 6
    got = source(maxBytesPerFile=most)
    assert sum(got, []) == [("a", k, float(k)) for k in range(20)] and len(got) >= 6
    assert max(map(len, got)) <= 4
    a.write_text(text + lines(row("a", k) for k in range(20, 32)))
    got = source(maxBytesPerFile=most)
    assert sum(got, []) == [("a", k, float(k)) for k in range(20, 32)] and len(got) >= 3
    # A line longer than the bound is a batch of its own.
    with open(a, "a") as f:
        f.write(lines([row("a", 32) | {"note": "x" * 3 * most}, row("a", 33)]))
    assert sum(source(maxBytesPerFile=most), []) == [("a", 32, 32.0), ("a", 33, 33.0)]


def test_a_repeated_batch_of_a_replaced_file_reads_no_other_rows(tmp_path, caplog):
    path = tmp_path / "a.jsonl"
    path.write_text(lines(row("a", k) for k in range(6)))
    reader = live.FrameReader(str(tmp_path), 1 << 20)
    start, end = reader.initialOffset(), reader.latestOffset()
    (span,) = reader.partitions(start, end)
    assert len(list(reader.read(span))) == 6
    path.write_text(lines(row("a", k, 9.0) for k in range(9)))
    assert list(reader.read(span)) == [] and "was replaced" in caplog.text


class Decoder:
    """Sends the lines of each connection in turn, then hangs up."""

    def __init__(self, *connections):
        self.server = socket.create_server(("127.0.0.1", 0))
        self.port = self.server.getsockname()[1]
        threading.Thread(target=self.serve, args=(connections,), daemon=True).start()

    def serve(self, connections):
        for text in connections:
            peer, _ = self.server.accept()
            peer.sendall(text.encode())
            peer.close()
        self.server.close()


def test_a_receiver_connects_again_and_numbers_go_on(tmp_path):
    folder = str(tmp_path / "landed")
    decoder = Decoder('{"detected": 1}\n{"detected": 0}\nnoise\n{"det', '{"detected": 1, "frame_id": 0}\n')
    began = time.monotonic()
    assert receivers.receive("a-b", "127.0.0.1", decoder.port, "s", folder, 1.5, clock=lambda: 5.0, retry_s=0.3) == (3, 2)
    assert time.monotonic() - began < 5
    # A later receiver, and one of a camera whose name begins alike, find their own numbers.
    assert receivers.receive("a-b", "127.0.0.1", Decoder('{"detected": 1}\n').port, "s", folder, 0.6, retry_s=0.3)[0] == 1
    assert receivers.receive("a", "127.0.0.1", Decoder('{"detected": 1}\n').port, "s", folder, 0.6, retry_s=0.3)[0] == 1
    found = sorted((x["camera_name"], x["frame_id"]) for f in os.listdir(folder) for x in map(json.loads, open(f"{folder}/{f}")))
    assert found == [("a", 0), ("a-b", 0), ("a-b", 1), ("a-b", 2), ("a-b", 3)]


def test_receivers_run_as_tasks_until_they_are_stopped(spark, tmp_path):
    folder = str(tmp_path / "in")
    cameras = {c: Decoder(*['{"detected": 1}\n' * 3] * 2) for c in "ab"}
    receivers.stop(folder)  # what an earlier run left doesn't end this one
    sources = spark.createDataFrame([(c, "127.0.0.1", d.port) for c, d in cameras.items()], "camera_name string, host string, port int")
    df = receivers.receivers(sources, "s", folder, 60.0, retry_s=0.2)
    assert df.rdd.getNumPartitions() == 2
    threading.Timer(6.0, receivers.stop, [folder]).start()
    assert {(r.camera_name, r.rows, r.connections) for r in df.collect()} == {("a", 6, 2), ("b", 6, 2)}
    live.register(spark)
    seen = []
    query = spark.readStream.format("court_frames").option("path", folder).load().writeStream.foreachBatch(lambda df, _: seen.extend((r.camera_name, r.frame_id) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(seen) == [(c, k) for c in "ab" for k in range(6)]


def buffered(spark, tmp_path, batches, s, timeout=False, pause=0.0, ttl_s=None):
    """Flushes of one run a batch: lists of (camera, frame), and the progress of the last run."""
    seen, last = [], None
    for k, rows in enumerate(batches):
        if rows:
            spark.createDataFrame(rows, LIVE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live.flushes(spark.readStream.schema(LIVE).parquet(f"{tmp_path}/in"), s=s, timeout=timeout, ttl_s=ttl_s)
        query = live.run_flushes(stream, lambda df, k=k: seen.append((k, sorted((r.camera_name, r.frame_id) for r in df.collect()))), f"{tmp_path}/state", timeout=timeout)
        assert query.awaitTermination(120)
        last = query.recentProgress
        time.sleep(pause)
    return seen, last


def frames(a, b, cameras="xy", detected=1):
    return [("s", k / 25.0, c, k, detected, 1.0, 2.0, 0.9) for k in range(a, b) for c in cameras]


def test_a_run_that_ends_keeps_the_rest_and_timers_fire_in_the_next(spark, tmp_path):
    s = dataclasses.replace(DEFAULTS, quiet_s=1.0, force_s=60.0, min_rows=10, overlap_s=0.2)
    other = lambda k: [("other", 0.0, "x", k, 1, 1.0, 2.0, 0.9)]
    # Nothing is due while rows come: both cameras are found quiet at the end of a run that took long, or in the next one. What stays
    # as overlap, five frames, comes again with the new ones.
    seen, _ = buffered(spark, tmp_path, [frames(0, 12), other(0), frames(12, 20), other(1)], s, timeout=True, pause=1.5)
    assert [rows for _, rows in seen] == [[(c, k) for c in "xy" for k in range(12)], [(c, k) for c in "xy" for k in range(7, 20)]]


def test_a_run_without_timers_keeps_the_rest_for_the_next(spark, tmp_path):
    s = dataclasses.replace(DEFAULTS, quiet_s=1.0, force_s=60.0, min_rows=10, overlap_s=0.2)
    seen, _ = buffered(spark, tmp_path, [frames(0, 12), frames(12, 14), frames(40, 41, detected=0)], s)
    # The row of the first camera after a second of silence is enough.
    assert seen == [(2, [*(("x", k) for k in (*range(14), 40)), *(("y", k) for k in range(14))])]


def test_the_buffer_of_a_lone_camera_outlives_its_time(spark, tmp_path):
    s = dataclasses.replace(DEFAULTS, quiet_s=600.0, force_s=600.0, min_rows=5)
    seen, _ = buffered(spark, tmp_path, [frames(0, 6, "x"), frames(6, 7, "x"), [*frames(7, 13, "x"), *frames(0, 6, "y"), ("s", 900.0, None, None, None, None, None, None)]], s, timeout=True, pause=2.5, ttl_s=2.0)
    assert seen == [(2, [*(("x", k) for k in range(7, 13)), *(("y", k) for k in range(6))])]


def test_a_trigger_writes_its_new_rows_only(spark, tmp_path):
    def changes():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{tmp_path}/state/state") for f in files if f.endswith((".changelog", ".zip", ".sst")))

    sizes, at = [], 0
    for k, n in enumerate((4000, 20, 20)):
        buffered(spark, tmp_path, [frames(at, at + n, "x")], DEFAULTS)
        at += n
        sizes.append(changes())
    first, second, third = sizes[0], sizes[1] - sizes[0], sizes[2] - sizes[1]
    assert second < first / 5 and third < first / 5, sizes


def test_frames_that_repeat_and_null_sessions(spark, tmp_path):
    rows = [(None, 1.0, "x", 3, 1, 1.0, 2.0, 0.9), (None, 2.0, "x", 3, None, 7.0, 2.0, None), (None, 3.0, None, None, None, None, None, None)]
    spark.createDataFrame(rows, LIVE).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    query = live.run_flushes(live.flushes(spark.readStream.schema(LIVE).parquet(f"{tmp_path}/in")), lambda df: seen.extend(df.select("frame_id", "detected", "ball_u", "ball_conf", F.col("p0_ls_u")).collect()), f"{tmp_path}/state")
    assert query.awaitTermination(120)
    assert [tuple(r) for r in seen] == [(3, 0, 7.0, None, None)]
