"""Alignment, crossings, rallies, sources and live flushes on small tables."""

import dataclasses
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe import catalogue
from rallyframe.functions import geometry as G
from rallyframe.operators import frames as R
from rallyframe.operators import rallies as L
from rallyframe.operators import sync as Y
from rallyframe.operators.windows import spaced
from rallyframe.plans import live as live_plan
from rallyframe.settings import DEFAULTS
from rallyframe.sources import sinks
from rallyframe.sources import tables as T
from rallyframe.streaming import live


@pytest.mark.parametrize(("gap", "n"), [(19, 1), (20, 2)])
def test_debounce(spark, gap, n):
    df = spark.createDataFrame([("a", 100), ("a", 100 + gap)], "camera_name string, frame_id long")
    assert spaced(df, ["camera_name"], "frame_id", 20).count() == n


@pytest.mark.parametrize(("gap", "n"), [(200, 1), (201, 2)])
def test_rally_gap(spark, gap, n):
    frames = spark.range(0, 600).selectExpr("'a' as camera_name", "id as frame_id")
    hits = spark.createDataFrame([("a", 100), ("a", 100 + gap)], "camera_name string, frame_id long")
    got = L.rallies(frames, hits).orderBy("rally_id").collect()
    assert len(got) == n and got[0].start_frame == 25 and got[-1].end_frame == 100 + gap + 75


def test_lag_of_seven(spark):
    rnd = random.Random(1)
    a = [rnd.random() for _ in range(120)]
    rows = [("x", k, v) for k, v in enumerate(a)] + [("y", k, a[k - 7] if k >= 7 else 0.0) for k in range(120)]
    signal = spark.createDataFrame(rows, "camera_name string, frame_id long, accel double")
    assert Y.best_lag(Y.lag_correlation(signal, "x", "y")).first().tau == -7


def test_signal_to_noise_over_all_lags(spark):
    rnd = random.Random(8)
    x, y = ([rnd.random() for _ in range(1200)] for _ in "xy")
    for k in range(40):  # the same burst, 900 frames apart
        x[1100 + k] = y[200 + k] = 30.0 * rnd.random()
    signal = spark.createDataFrame([(c, k, v) for c, s in (("x", x), ("y", y)) for k, v in enumerate(s)], "camera_name string, frame_id long, accel double")
    z = [(np.array(s) - np.mean(s)) / np.std(s) for s in (x, y)]
    want = {lag: sum(z[0][f] * z[1][f - lag] for f in range(max(0, lag), min(1200, 1200 + lag))) for lag in range(-1199, 1200)}
    corr = Y.full_correlation(signal, "x", "y")
    got = {r.lag: r["corr"] for r in corr.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want) and max(got, key=got.get) == 900
    snr = max(want.values()) / (np.mean(np.abs(list(want.values()))) + 1e-9)
    r = Y.signal_to_noise(corr).first()
    assert abs(r.snr - snr) < 1e-6 and r.weak == (snr < 3)
    assert Y.full_correlation(signal.filter("camera_name = 'x'"), "x", "y").count() == 0


def test_signal_to_noise_query_takes_all_lags(spark, monkeypatch):
    x = [float(k % 97 == 0) * k + (k * 7919 % 13) for k in range(1500)]
    signal = spark.createDataFrame([(c, k + 700 * (c == catalogue.A), v) for c in (catalogue.A, catalogue.B) for k, v in enumerate(x)], "camera_name string, frame_id long, accel double")
    monkeypatch.setattr(catalogue, "cleaned_of", lambda *_: None)
    monkeypatch.setattr(Y, "accel_signal", lambda _: signal)
    r = catalogue.QUERIES["signal_to_noise"](spark, "").first()
    z = (np.array(x) - np.mean(x)) / np.std(x)
    corr = np.correlate(z, z, "full")
    assert abs(r.snr - corr.max() / (np.abs(corr).mean() + 1e-9)) < 1e-3


def test_silent_cameras_take_the_smallest_lag(spark):
    signal = spark.createDataFrame([(c, k, 0.0) for c in "xy" for k in range(150)], "camera_name string, frame_id long, accel double")
    assert Y.best_lag(Y.lag_correlation(signal, "x", "y")).first().tau == -100


def test_peaks(spark):
    x = [0.0] * 40
    x[5], x[8], x[20], x[21], x[30] = 50.0, 60.0, 40.0, 40.0, 35.0
    got = Y.peaks(spark.createDataFrame([("a", k, v) for k, v in enumerate(x)], "camera_name string, frame_id long, accel double"))
    assert [r.frame_id for r in got.orderBy("frame_id").collect()] == [8, 20, 30]


def test_fill_by_rows_like_a_limited_line(spark):
    x = [None, 1.0, *[None] * 7, 9.0, *[None] * 6]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(x)], "camera_name string, frame_id long, interp_u double")
    got = [r.interp_u for r in L.fill_by_rows(L.numbered(df), ["interp_u"]).orderBy("frame_id").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, None, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, None]


def test_frames_inside_a_range(spark):
    df = spark.range(10).withColumnRenamed("id", "frame_id")
    assert L.frames_inside(df, 3, 5).count() == 3
    with pytest.raises(ValueError, match="no frame"):
        L.frames_inside(df, 20, 30)


def test_rallies_over_frames_with_holes(spark):
    rnd = random.Random(6)
    rows, hits = [], []
    for c in "abc":
        own = sorted(rnd.sample(range(3000), 1200))
        rows += [(c, f) for f in own]
        hits += [(c, f) for f in sorted(rnd.sample(own, 9))]
    schema = "camera_name string, frame_id long"
    got = {(r.camera_name, r.rally_id): (r.start_frame, r.end_frame) for r in L.rallies(spark.createDataFrame(rows, schema), spark.createDataFrame(hits, schema)).collect()}
    want = {}
    for c in "abc":
        groups: list[list[int]] = []
        for f in (f for k, f in hits if k == c):
            if not groups or f - groups[-1][-1] > 200:
                groups.append([])
            groups[-1].append(f)
        for k, g in enumerate(groups, 1):
            inside = [f for x, f in rows if x == c and g[0] - 75 <= f <= g[-1] + 75]
            want[c, k] = (inside[0], inside[-1])
    assert got == want


def test_merge_empty_rallies(spark):
    df = spark.createDataFrame([("a", k + 1, 10 * k, 10 * k + 9, s) for k, s in enumerate((0, 2, 0, 0, 1, 0))], "camera_name string, rally_id int, start_frame long, end_frame long, shots long")
    got = [(r.rally_id, r.start_frame, r.end_frame, r.shots) for r in L.merge_empty(df).orderBy("rally_id").collect()]
    assert got == [(1, 0, 19, 2), (2, 20, 59, 1)]


def test_world_is_null_at_infinity(spark):
    h = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 0)])
    assert spark.range(1).select(G.to_world(F.lit(1.0), F.lit(2.0), h).alias("w")).first().w is None


def test_unknown_speed_is_zero(spark):
    assert spark.range(1).select(G.ball_kmh(F.lit(None).cast("double"), F.lit(1), 25.0).alias("s")).first().s == 0.0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("cam1", 0, 1, 10.5, 20.25, 0.9), ("cam1", 1, 0, None, None, 0.0)], "camera_name string, frame_id long, detected int, ball_u double, ball_v double, ball_conf double")
    sinks.write_csv(df.drop("camera_name"), f"{tmp_path}/out")
    got = T.read_detections_csv(spark, f"{tmp_path}/out", "cam1").select(*df.columns).orderBy("frame_id").collect()
    assert got == df.orderBy("frame_id").collect()


def test_rows_without_players(spark):
    got = T.rows_to_detections(spark, [{"camera_name": "a", "frame_id": 3, "detected": 1, "ball_u": 5, "ball_v": float("nan")}])
    row = got.first()
    assert (row.ball_u, row.ball_v, row.ball_conf, row.p0_ls_u) == (5.0, None, 0.0, None)
    assert T.rows_to_detections(spark, []).count() == 0


def test_calibration_sources(spark, tmp_path):
    assert T.read_calibration(spark, f"{tmp_path}/none.json").first().alpha is None
    assert T.read_calibration(spark, None, 1.0, 2.0).first().beta == 2.0
    (tmp_path / "cal.json").write_text(json.dumps({"alpha": 0.1}))
    with pytest.raises(Exception, match="lacks a key"):
        T.read_calibration(spark, f"{tmp_path}/cal.json").collect()


def test_source_resolution(tmp_path):
    (tmp_path / "a.mp4").write_text("")
    local = str(tmp_path / "a.mp4")
    assert T.resolve_source(None, False, "rtsp://x", local, lambda _: True) == ("rtsp://x", True)
    assert T.resolve_source(None, False, "rtsp://x", local, lambda _: False) == (local, False)
    assert T.resolve_source(None, True, "rtsp://x", local, lambda _: True) == (local, False)
    with pytest.raises(FileNotFoundError):
        T.resolve_source(None, True, None, None, lambda _: True)


def test_post_is_dry_without_a_sender_and_survives_errors(spark):
    df = spark.createDataFrame([("a", 1, 10, "{}"), ("a", 2, 20, "bad")], "camera_name string, rally_id int, start_frame long, payload string")
    assert sinks.post(df).filter("sent").count() == 2

    def sender(text, key):
        if text == "bad":
            raise OSError
        return 201 if key == "a-10" else 500

    assert sinks.sent_counts(sinks.post(df, sender)).filter("camera_name is null").first().n_sent == 1


def test_tail_window_of_triples(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(5)], "camera_name string, frame_id long, x double")
    got = R.tumbling(df, "x").orderBy("window").collect()
    assert [r["values"] for r in got] == [[0.0, 1.0, 2.0], [3.0, 4.0]]
    assert R.sliding(df, "x").orderBy("frame_id").first()["values"] == [0.0, 0.0, 0.0]


def test_detector_plug_in(spark):
    images = spark.createDataFrame([(c, k, bytes([k])) for c in "ab" for k in range(4)], "camera_name string, frame_id long, image binary")
    got = live.detect_balls(images, lambda batch: [(float(i[0]), 1.0, 0.9 if i[0] else 0.1) for i in batch])
    assert got.count() == 8 and got.filter("detected = 0").count() == 2


def test_live_flush_equals_the_batch_rows(spark, tmp_path):
    rows = [("s", k / 25.0, c, k, 1 if k < 260 else 0, 1.0 * k, 2.0, 0.9) for k in range(560) for c in ("a", "b")]
    schema = "session string, arrived double, camera_name string, frame_id long, detected int, ball_u double, ball_v double, ball_conf double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.flushes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    seen = []
    live.run_flushes(stream, lambda df: seen.append(sorted((r.camera_name, r.frame_id, r.ball_u) for r in df.collect())), f"{tmp_path}/state").awaitTermination(120)
    # Detections end at frame 259; ten seconds later both cameras are quiet and all rows so far are flushed: camera a's come first.
    assert seen[0] == [(c, k, 1.0 * k) for c, last in (("a", 509), ("b", 508)) for k in range(last + 1)]


LIVE = "session string, arrived double, camera_name string, frame_id long, detected int, ball_u double, ball_v double, ball_conf double"


def test_final_flush_has_the_rest(spark, tmp_path):
    rows = [("s", k / 25.0, c, k, 1 if k < 260 else 0, 1.0 * k, 2.0, 0.9) for k in range(560) for c in ("a", "b")] + [("s", 99.0, None, None, None, None, None, None)]
    rows += [("short", 1.0 + k, "a", k, 1, 1.0, 2.0, 0.9) for k in range(5)] + [("short", 9.0, None, None, None, None, None, None)]
    spark.createDataFrame(rows, LIVE).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    q = live.run_flushes(live.flushes(spark.readStream.schema(LIVE).parquet(f"{tmp_path}/in")), lambda df: seen.append({(r.camera_name, r.frame_id) for r in df.collect()}), f"{tmp_path}/state")
    assert q.awaitTermination(120)
    assert {(c, k) for c in "ab" for k in range(560)} == set().union(*(x for x in seen if len(x) > 5))
    assert {("a", k) for k in range(5)} in seen


def test_a_silent_session_is_flushed(spark, tmp_path):
    rows = [("s", 1.0 + k, "a", k, 1, 1.0, 2.0, 0.9) for k in range(5)]
    spark.createDataFrame(rows, LIVE).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    settings = dataclasses.replace(DEFAULTS, force_s=2.0)
    q = live.run_flushes(live.flushes(spark.readStream.schema(LIVE).parquet(f"{tmp_path}/in"), s=settings, timeout=True), lambda df: seen.append({r.frame_id for r in df.collect()}), f"{tmp_path}/state", available_now=False)
    try:
        for _ in range(60):
            if seen:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert seen == [set(range(5))]


def written_lines(rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def test_frame_source_reads_whole_lines_once(spark, tmp_path):
    folder, state = tmp_path / "frames", str(tmp_path / "state")
    folder.mkdir()
    row = lambda c, k: {"session": "s", "arrived": float(k), "camera_name": c, "frame_id": k, "detected": 1, "ball_u": 1.0 * k, "p0_ls_u": 5}
    (folder / "a.jsonl").write_text(written_lines([row("a", k) for k in range(4)]) + '{"session": "s", "arr')
    live.register(spark)
    seen = []

    def go():
        stream = spark.readStream.format("court_frames").option("path", str(folder)).load()
        q = stream.writeStream.foreachBatch(lambda df, _: seen.extend((r.camera_name, r.frame_id, r.ball_u, r.p0_ls_u, r.ball_conf) for r in df.collect())).option("checkpointLocation", state).start()
        q.processAllAvailable()
        q.stop()

    go()
    want = [("a", k, 1.0 * k, 5.0, 0.0) for k in range(4)]
    assert sorted(seen) == want
    # The decoder finishes its line and reconnects, with a file of its own; another camera comes. The query starts again.
    with open(folder / "a.jsonl", "a") as f:
        f.write('ived": 4, "camera_name": "a", "frame_id": 4, "detected": 1, "ball_u": 4.0, "p0_ls_u": 5}\n')
    (folder / "a2.jsonl").write_text(written_lines([row("a", 5)]))
    (folder / "b.jsonl").write_text(written_lines([row("b", 0)]))
    go()
    assert sorted(seen) == [*want, ("a", 4, 4.0, 5.0, 0.0), ("a", 5, 5.0, 5.0, 0.0), ("b", 0, 0.0, 5.0, 0.0)]


def test_live_run_equals_the_batch_run(spark, sf_dir, tmp_path):
    """Two cameras streamed to the end, with a flush that fails; the payloads are those of the batch."""
    rows = catalogue.detections_of(spark, sf_dir)
    start = "2024-05-01T10:00:00Z"
    stream = rows.select(F.lit("s").alias("session"), (F.col("frame_id") / 25.0).alias("arrived"), "*")
    one = stream.filter("camera_name = 'cam1' and frame_id < 30").withColumn("session", F.lit("broken"))
    ends = spark.createDataFrame([("s", 1e6), ("broken", 1e6)], "session string, arrived double")
    stream.unionByName(one).unionByName(ends, allowMissingColumns=True).coalesce(1).write.parquet(f"{tmp_path}/in")
    live_rows = spark.readStream.schema(stream.schema).parquet(f"{tmp_path}/in")
    q = live_plan.run(live_rows, T.cameras(spark), "cam1", "cam2", f"{tmp_path}/out", None, start)
    assert q.awaitTermination(300) and q.exception() is None
    got = {(r.camera_name, r.start_frame): json.loads(r.payload) for r in spark.read.json(f"{tmp_path}/out/reports").collect()}
    _, reports = live_plan.snapshot(rows, T.cameras(spark), "cam1", "cam2", start)
    want = {(r.camera_name, r.start_frame): json.loads(r.payload) for r in reports.collect()}
    assert got == want and got
    assert {(r.camera_name, r.start_frame) for r in spark.read.parquet(f"{tmp_path}/out/posted").collect()} == set(want)
    # A later flush with the same rallies posts nothing.
    assert sinks.post_new(reports, f"{tmp_path}/out/posted").count() == 0


def test_post_new_tries_again_what_was_not_sent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 10, "{}"), ("a", 2, 20, "{}")], "camera_name string, rally_id int, start_frame long, payload string")
    first = sinks.post_new(df, f"{tmp_path}/ledger", lambda text, key: 200 if key == "a-10" else 500)
    assert {(r.start_frame, r.sent) for r in first.collect()} == {(10, True), (20, False)}
    assert [r.start_frame for r in sinks.post_new(df, f"{tmp_path}/ledger", lambda text, key: 204).collect()] == [20]
    assert sinks.post_new(df, f"{tmp_path}/ledger").count() == 0


def test_results_by_number_of_cameras(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "camera_name string, frame_id long")
    aligned = df.withColumn("aligned_frame_id", F.col("frame_id"))
    assert sinks.write_results(df, aligned, f"{tmp_path}/none") == 0 and not (tmp_path / "none").exists()
    assert sinks.write_results(df.filter("camera_name <> 'c'"), aligned.filter("camera_name <> 'c'"), f"{tmp_path}/two") == 2
    assert "aligned_frame_id" in spark.read.option("header", True).csv(f"{tmp_path}/two").columns
    assert sinks.write_results(df.filter("camera_name = 'a'"), None, f"{tmp_path}/one") == 1


def test_camera_dimension_from_files(spark, tmp_path):
    cal = {"y_far": 90.0, "px_width_far": 400.0, "y_near": 570.0, "px_width_near": 900.0, "alpha": 0.05, "beta": 30.0, "fps": 25.0, "v_max_ms": 55.6, "court_width_m": 10.97, "clicks_px": [[1.0, 2.0]]}
    (tmp_path / "cal_a.json").write_text(json.dumps(cal, indent=1))
    (tmp_path / "h.json").write_text(json.dumps({"a": {"H_image_to_world": [[1, 2, 3], [4, 5, 6], [7, 8, 9]]}, "court_dimensions": {"x": 1}}))
    got = {r.camera_name: r for r in T.read_cameras(spark, [("a", "S1", 330.0), ("b", None, None)], str(tmp_path), f"{tmp_path}/h.json").collect()}
    assert (got["a"].alpha, got["a"].y_net, got["a"].h) == (0.05, 330.0, [float(k) for k in range(1, 10)]) and got["b"].alpha is None and got["b"].h is None
    assert T.read_cameras(spark, [("a", "S1", 1.0)], f"{tmp_path}/no", f"{tmp_path}/h.json").first().alpha is None


def test_nested_config(tmp_path):
    (tmp_path / "c.yaml").write_text("home: ''\n# note\ncameras:\n  a:\n    serial: 'S #1'\n    y_net: 238\n    local: true\n  b:\n    y_net: 2.5  # net\nfps: 25\n")
    got = T.load_config(str(tmp_path / "c.yaml"))
    assert got["cameras"] == {"a": {"serial": "S #1", "y_net": 238, "local": True}, "b": {"y_net": 2.5}} and got["fps"] == 25 and got["home"] == str(tmp_path)
    (tmp_path / "d.yaml").write_text("a:\n  - 1\n")
    with pytest.raises(ValueError, match="mappings"):
        T.load_config(str(tmp_path / "d.yaml"))


def test_columns_by_other_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "frame int, x double, y double")
    assert tuple(T.named_as_usual(df).select("frame_id", "interp_u", "interp_v").first()) == (1, 2.0, 3.0)
    with pytest.raises(ValueError, match="frame_id"):
        T.named_as_usual(df.drop("frame"))


def test_joints_of_a_pose_and_text(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: F.struct((k * 1.0).alias("u"), F.lit(2.0).alias("v"), F.lit(0.5).alias("conf"))).alias("k"))
    j = df.select(T.joints_of(F.col("k")).alias("j")).first().j
    assert [j[n].u for n in ("ls", "rs", "le", "re", "lw", "rw")] == [5.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    row = T.as_text(spark.createDataFrame([(1.5, None, 0.25)], "ball_u double, ball_v double, ball_conf double")).first()
    assert tuple(row) == ("1.50", "", "0.2500")


def test_probe_needs_an_answer():
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))
    port = server.getsockname()[1]
    threading.Thread(target=lambda: (c := server.accept()[0]).sendall(b"RTSP/1.0 200 OK\r\n") or c.close(), daemon=True).start()
    assert T.probe_stream(f"rtsp://127.0.0.1:{port}/x", 3.0)
    server.close()
    assert not T.probe_stream(f"rtsp://127.0.0.1:{port}/x", 0.5)


def test_peaks_in_pieces_equal_those_of_the_whole(spark):
    rnd = random.Random(17)
    x = [0.0] * 3000
    for _ in range(500):
        k = rnd.randrange(2990)
        for i in range(rnd.randrange(1, 6)):
            x[k + i] = float(rnd.randrange(0, 90, 10))
    signal = spark.createDataFrame([(c, k, v) for c in "ab" for k, v in enumerate(x)], "camera_name string, frame_id long, accel double")
    whole = sorted((r.camera_name, r.frame_id) for r in Y.peaks(signal).collect())
    assert sorted((r.camera_name, r.frame_id) for r in Y.peaks(signal, size=100, halo=8).collect()) == whole
    # The same by the definition: plateaus, height, distance by height, prominence.
    tops, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
        i = j + 1
    tops = [t for t in tops if x[t] >= 30]
    gone = set()
    for t in sorted(tops, key=lambda t: (x[t], t), reverse=True):
        if t not in gone:
            gone |= {o for o in tops if o != t and abs(o - t) < 5}
    want = []
    for t in (t for t in tops if t not in gone):
        left, right = t, t
        while left > 0 and x[left - 1] <= x[t]:
            left -= 1
        while right < len(x) - 1 and x[right + 1] <= x[t]:
            right += 1
        if x[t] - max(min(x[left : t + 1]), min(x[t : right + 1])) >= 10:
            want.append(t)
    assert [f for c, f in whole if c == "a"] == want and len(want) > 100


def test_correlation_by_blocks(spark):
    rnd = random.Random(3)
    a, b = ([rnd.random() for _ in range(700)] for _ in "ab")
    signal = spark.createDataFrame([(c, k, v) for c, s in (("x", a), ("y", b)) for k, v in enumerate(s)], "camera_name string, frame_id long, accel double")
    z = [(np.array(s) - np.mean(s)) / np.std(s) for s in (a, b)]
    want = np.correlate(z[0], z[1], "full")
    for corr, lags in ((Y.lag_correlation(signal, "x", "y", 40, block=100), range(-40, 41)), (Y.full_correlation(signal, "x", "y", block=128), range(-699, 700))):
        got = {r.lag: r["corr"] for r in corr.collect()}
        assert set(got) == set(lags) and all(abs(got[k] - want[k + 699]) < 1e-6 for k in lags)


def test_csv_folder_with_varying_headers(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("frame_id,detected,ball_u,ball_v,ball_conf\n1,1,10.0,20.0,0.9\n2,0,,,\n")
    (folder / "b.csv").write_text("ball_conf,ball_u,frame_id,ball_v,detected\n0.8,11.0,3,21.0,1\n")
    (folder / "c.csv").write_text('note,"frame_id",detected,ball_v,ball_u\nhello,4,1,22.0,12.0\n')  # no confidence, and a column of its own
    (folder / "d.csv").write_text("frame_id,detected,ball_u,ball_v,ball_conf\n5,1,x,23.0,0.7\n")  # as a
    (folder / "e.csv").write_text("")
    (folder / "f.csv").write_text("ball_u,frame_id\n")
    got = T.read_detections_csv(spark, str(folder), "cam1")
    rows = {r.frame_id: (r.camera_name, r.detected, r.ball_u, r.ball_v, r.ball_conf, r.note) for r in got.collect()}
    assert rows == {1: ("cam1", 1, 10.0, 20.0, 0.9, None), 2: ("cam1", 0, None, None, 0.0, None), 3: ("cam1", 1, 11.0, 21.0, 0.8, None), 4: ("cam1", 1, 12.0, 22.0, 0.0, "hello"), 5: ("cam1", 1, None, 23.0, 0.7, None)}
    assert [len(files) for _, files in T.header_groups(spark, str(folder))] == [1, 1, 2, 1]
    (folder / "g.csv").write_text("1,2\n3,4\n")
    with pytest.raises(ValueError, match="no header"):
        T.read_detections_csv(spark, str(folder))
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "x.csv").write_text("")
    assert T.read_detections_csv(spark, str(empty), "cam1").count() == 0
