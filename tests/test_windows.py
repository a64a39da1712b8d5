"""Chunked ranges, decisions by transducers, correlation by a distributed transform, prominence by a stack."""

import random
import time

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from rallyframe import catalogue
from rallyframe.operators import cleaning as C
from rallyframe.operators import frames as R
from rallyframe.operators import players as P
from rallyframe.operators import rallies as L
from rallyframe.operators import sync as Y
from rallyframe.operators import windows
from rallyframe.operators.windows import carried, chunked_range, spaced
from rallyframe.plans import batch
from rallyframe.plans.storage import stored
from rallyframe.sources import tables as T


def accepted(places, gap):
    out = []
    for p in sorted(set(places)):
        if not out or p - out[-1] >= gap:
            out.append(p)
    return out


@pytest.mark.parametrize(("gap", "size"), [(20, 64), (7, 7), (1, 16), (30, 8), (5, 1 << 16)])
def test_spaced_like_the_loop(spark, gap, size):
    rnd = random.Random(gap * size)
    rows = [("a", k) for k in range(0, 900, 1)] + [("b", k) for k in sorted(rnd.sample(range(-500, 3000), 700))] + [("c", rnd.randrange(40_000)) for _ in range(60)] + [("d", 5), ("d", 5), ("d", None), (None, 3), (None, 4), (None, 3 + gap)]
    df = spark.createDataFrame([(c, k, float(i)) for i, (c, k) in enumerate(rows)], "camera_name string, frame_id long, x double")
    got = spaced(df, ["camera_name"], "frame_id", gap, size)
    assert got.schema == df.schema
    found = {}
    for r in got.collect():
        found.setdefault(r.camera_name, []).append(r.frame_id)
    assert {c: sorted(v) for c, v in found.items()} == {c: accepted([k for d, k in rows if d == c and k is not None], gap) for c in ("a", "b", "c", "d", None)}
    assert spaced(df.limit(0), ["camera_name"], "frame_id", gap, size).count() == 0


def test_spaced_takes_dense_rows_in_linear_time(spark):
    df = spark.range(2_000_000).selectExpr("'a' as camera_name", "id as frame_id")
    spaced(df.limit(10), ["camera_name"], "frame_id", 20).count()
    began = time.monotonic()
    r = spaced(df, ["camera_name"], "frame_id", 20).agg(F.count("*").alias("n"), F.max("frame_id").alias("m"), F.count_if(F.col("frame_id") % 20 == 0).alias("k")).first()
    assert tuple(r) == (100_000, 1_999_980, 100_000) and time.monotonic() - began < 30


def test_ranges_in_chunks(spark):
    ends = spark.createDataFrame([("a", 3, 3), ("b", -2, 40), ("c", 5, 4), ("d", None, 4), ("e", 0, 2999)], "k string, a long, b long")
    got = {}
    for r in chunked_range(ends, "a", "b", "n", size=10).select("k", "n").collect():
        got.setdefault(r.k, []).append(r.n)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [3], "b": list(range(-2, 41)), "e": list(range(3000))}


def test_a_stray_frame_number_is_no_array(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 3_000_000_000, 1)], "camera_name string, frame_id long, detected int")
    # The plan holds; only some of its chunks are looked at here.
    plan = R.dense(df).filter("frame_id between 2999999990 and 3000000000")
    low = chunked_range(df.groupBy("camera_name").agg(F.min("frame_id").alias("a"), F.max("frame_id").alias("b")), "a", "b", "n")
    assert "sequence" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert low.limit(5).count() == 5


@pytest.mark.parametrize(("n", "m", "gap", "cells"), [(700, 500, 3, 64), (1, 9, 0, 1 << 18), (900, 900, 40, 256)])
def test_correlation_over_all_lags_in_columns_and_rows(spark, n, m, gap, cells):
    rnd = random.Random(n + m)
    signal = {"x": {k + 11: rnd.random() for k in range(n) if k % 7 or not gap}, "y": {k - gap: rnd.random() for k in range(m)}}
    df = spark.createDataFrame([(c, k, v) for c, s in signal.items() for k, v in s.items()], "camera_name string, frame_id long, accel double")
    z = {}
    for c, s in signal.items():
        v = np.array(list(s.values()))
        z[c] = dict(zip(s, (v - v.mean()) / v.std() if v.std() >= 1e-9 else v - v.mean(), strict=True))
    want = {}
    for f, a in z["x"].items():
        for g, b in z["y"].items():
            want[f - g] = want.get(f - g, 0.0) + a * b
    got = {r.lag: r["corr"] for r in Y.full_correlation(df, "x", "y", block=cells).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_a_million_frames_equal_one_transform(spark):
    n = 1 << 19
    rng = np.random.default_rng(1)
    x, y = rng.random(n), rng.random(n)
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"frame_id": np.arange(n), "x": x, "y": y}))
    df = rows.selectExpr("stack(2, 'x', x, 'y', y) as (camera_name, accel)", "frame_id").select("camera_name", "frame_id", "accel")
    got = Y.full_correlation(df, "x", "y").toPandas().sort_values("lag")
    zx, zy = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    size = 1 << 20
    want = np.roll(np.fft.irfft(np.fft.rfft(zx, size) * np.conj(np.fft.rfft(zy, size)), size), n - 1)[: 2 * n - 1]
    assert (got["lag"].to_numpy() == np.arange(-n + 1, n)).all() and np.abs(got["corr"].to_numpy() - want).max() < 1e-6


def plain_peaks(x, height=30, distance=5, prominence=10):
    tops, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
        i = j + 1
    tops, gone, out = [t for t in tops if x[t] >= height], set(), []
    for t in sorted(tops, key=lambda t: (x[t], t), reverse=True):
        if t not in gone:
            gone |= {o for o in tops if o != t and abs(o - t) < distance}
    for t in (t for t in tops if t not in gone):
        sides = []
        for step in (-1, 1):
            k, low = t, x[t]
            while 0 <= k < len(x) and x[k] <= x[t]:
                low, k = min(low, x[k]), k + step
            sides.append(low)
        if x[t] - max(sides) >= prominence:
            out.append(t)
    return out


def test_peaks_equal_their_definition_in_pieces(spark):
    rnd = random.Random(3)
    signals = {"walk": [0.0], "steps": [float(rnd.randrange(0, 90, 10)) for _ in range(1500)], "flat": [50.0] * 300}
    for _ in range(2000):
        signals["walk"].append(max(0.0, signals["walk"][-1] + rnd.randrange(-12, 13)))
    df = spark.createDataFrame([(c, k, v) for c, x in signals.items() for k, v in enumerate(x)], "camera_name string, frame_id long, accel double")
    got = {}
    for r in Y.peaks(df, size=150, halo=10).collect():
        got.setdefault(r.camera_name, []).append(r.frame_id)
    assert {c: sorted(v) for c, v in got.items()} == {c: p for c, x in signals.items() if (p := plain_peaks(x))} and len(got["walk"]) > 10


def test_prominence_on_a_long_ramp_in_linear_time():
    x = np.arange(1_000_000) / 100.0
    x[1::2] -= 3.0  # every second frame is a top, a little higher than the one before
    tops = np.arange(2, len(x) - 1, 2)
    began = time.monotonic()
    left, right, left_open, right_open = Y.saddles(x, tops)
    assert time.monotonic() - began < 20
    assert (left[10:] == x[:-1].min()).all() and left_open.all() and not right_open[:-1].any()
    assert np.allclose(x[tops[:-1]] - right[:-1], 2.99 + 0.0, atol=0.02)


def test_sync_report_against_its_parts(spark):
    rnd = random.Random(2)
    a = [0.0] * 400
    for k in range(20, 390, 37):
        a[k] = 40.0 + rnd.randrange(40)
    rows = [("x", k, v) for k, v in enumerate(a)] + [("y", k, a[k - 6] if k >= 6 else 0.0) for k in range(400)]
    signal = spark.createDataFrame(rows, "camera_name string, frame_id long, accel double")
    tau = Y.best_lag(Y.lag_correlation(signal, "x", "y"))
    r = Y.sync_report(tau, Y.peaks(Y.shifted(signal, tau, "y")), "x", "y").first()
    impacts = plain_peaks(a)
    assert r.tau_offset == -6 and r.interpretation == "y leads x by 6 frames" and len(impacts) == 10
    assert r.frames_a == impacts and r.frames_b_aligned == [k for k in impacts if k + 6 < 400]
    assert abs(r.corr_peak_value - tau.first().peak) < 1e-4


@pytest.mark.parametrize("long", [0, 10_000])
def test_carried_like_the_loop(spark, long):
    rnd = random.Random(5)
    rows = [(c, k, j, rnd.choice((None, None, None, float(k))), rnd.choice((None, f"v{k}"))) for c in ("a", "b", None) for k in sorted(rnd.sample(range(-300, 2000), 300)) for j in range(rnd.choice((1, 1, 2)))]
    rows += [("gap", k, 0, 1.0 if k in (3, 90_000) else None, None) for k in (1, 3, 5, 50_000, 90_000, 90_001)]
    df = spark.createDataFrame(rows, "camera_name string, frame_id long, j int, x double, y string")
    got = carried(df, ["camera_name"], ["frame_id", "j"], {"p": F.col("x"), "py": F.col("y")}, {"q": F.col("x")}, "row_idx", size=64, long=long)
    assert got.columns == [*df.columns, "p", "py", "q", "row_idx"]
    want = set()
    for c in ("a", "b", None, "gap"):
        own = sorted(((k, j, x, y) for d, k, j, x, y in rows if d == c), key=lambda r: r[:2])
        for i, (k, j, x, y) in enumerate(own):
            known = lambda part, n: next((r[n] for r in part if r[n] is not None), None)
            want.add((c, k, j, x, y, known(own[i::-1], 2), known(own[i::-1], 3), known(own[i:], 2), i))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(rows)
    assert carried(df.limit(0), ["camera_name"], ["frame_id"], {"p": F.col("x")}).count() == 0


def test_one_camera_is_many_tasks(spark):
    df = spark.range(1_000_000).selectExpr("'a' as camera_name", "id as frame_id", "if(id % 1000 = 0, id, null) as x")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = carried(df, ["camera_name"], ["frame_id"], {"p": F.col("x")}, {"q": F.col("x")}, "i", size=4096)
        tasks = got.groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n"), F.count_if((F.col("p") != F.col("frame_id") - F.col("frame_id") % 1000) | (F.col("i") != F.col("frame_id"))).alias("bad")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(t.n for t in tasks) == 1_000_000 and not sum(t.bad for t in tasks)
    assert len(tasks) == 16 and max(t.n for t in tasks) < 200_000


def test_long_cameras_have_the_same_rows(spark, sf_dir, monkeypatch):
    """Filling, motion, rallies and the rally of a frame, by scans and by plain windows."""
    det = catalogue.detections_of(spark, sf_dir).filter("frame_id % 37 <> 5")
    flagged = C.out_of_bounds(C.low_conf(C.gate(det.select(*catalogue.BALLS))))
    found = []
    for long in (0, 1 << 18):
        monkeypatch.setattr(windows, "LONG", long)
        moving = stored(L.motion(C.interpolate(C.survivor_rules(flagged, T.cameras(spark)))), "moving")
        hits = stored(L.crossings(moving, T.cameras(spark)), "hits")
        rallies = stored(L.rallies(moving, hits), "rallies")
        key = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
        found.append([key(moving), key(rallies), key(L.rally_of_frames(moving, rallies).select("camera_name", "frame_id", "rally_id"))])
    assert found[0] == found[1] and all(found[0])


def test_one_camera_is_many_tasks_in_every_step_of_a_match(spark, sf_dir, monkeypatch):
    """Cleaning, motion, crossings, speeds, moves and the panel in chunks have the rows of one window, and no task has most rows of a camera."""
    df, cams, found = stored(catalogue.detections_of(spark, sf_dir), "detections"), T.cameras(spark), []

    def share(df):
        own = df.filter("camera_name = 'cam1'").groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n")).collect()
        return max(r.n for r in own) / sum(r.n for r in own)

    key = lambda df: sorted(map(repr, df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for long, chunk in ((0, 16), (1 << 18, 1 << 16)):
            monkeypatch.setattr(windows, "LONG", long)
            monkeypatch.setattr(windows, "CHUNK", chunk)
            cleaned = stored(C.clean(df, cams), "cleaned")
            m = batch.analyse(cleaned, cams)
            shown = P.panel(m.moved, m.crossings)
            if chunk == 16:
                steps = {"motion": L.motion(cleaned), "speeds": P.ball_speeds(m.located.drop("ball_kmh")), "moves": m.moved, "panel": shown}
                assert {k: share(x) < 0.7 for k, x in steps.items()} == dict.fromkeys(steps, True)
            found.append([key(x) for x in (m.moving, m.crossings, m.rallies, m.located, m.moved, shown, L.trajectory_rallies(m.moving))])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] and all(found[0][:-1])


def test_pieces_of_a_camera_are_many_tasks(spark):
    """Neither a join by camera nor a sort puts all pieces of a camera into one task."""
    df = stored(spark.range(200_000).selectExpr("'a' as camera_name", "id as pos"), "places")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where statistics are unknown
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        step = lambda pdf, inside, first, last: (pdf[inside].assign(task=TaskContext.get().partitionId())[["camera_name", "pos", "task"]], True)
        out = windows.in_pieces(df, ["camera_name"], "pos", step, "camera_name string, pos long, task int")
        tasks = [r.n for r in out.groupBy("task").agg(F.count("*").alias("n")).collect()]
    finally:
        for c in ("coalescePartitions.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.adaptive.{c}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(tasks) == 200_000 and len(tasks) > 1
