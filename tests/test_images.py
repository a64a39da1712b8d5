"""Images: tensors against plain loops, frames read by number, detection beside decoding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.functions import geometry as G
from rallyframe.functions import tensors as N
from rallyframe.settings import Settings
from rallyframe.sources import images as I
from rallyframe.sources import sinks
from rallyframe.sources import tables as T
from rallyframe.streaming import live

FRAME = "camera_name string, frame_id long, height int, width int, image binary"


def pictures(n, h, w, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (n, h, w, 3), dtype=np.uint8)


def plain(image, s, mask=True):
    """A pixel at a time."""
    h, w, _ = image.shape
    top, left, bottom, right = s.clock_mask
    get = lambda y, x, c: 0.0 if mask and top <= y < bottom and left <= x < right else float(image[y, x, c])
    out = np.zeros((3, s.model_height, s.model_width))
    for y in range(s.model_height):
        fy = min(max((y + 0.5) * (h / s.model_height) - 0.5, 0), h - 1)
        y0 = int(fy)
        y1 = min(y0 + 1, h - 1)
        for x in range(s.model_width):
            fx = min(max((x + 0.5) * (w / s.model_width) - 0.5, 0), w - 1)
            x0 = int(fx)
            x1 = min(x0 + 1, w - 1)
            for c in range(3):
                a = get(y0, x0, c) * (1 - (fy - y0)) + get(y1, x0, c) * (fy - y0)
                b = get(y0, x1, c) * (1 - (fy - y0)) + get(y1, x1, c) * (fy - y0)
                value = round(a * (1 - (fx - x0)) + b * (fx - x0))
                out[2 - c, y, x] = (value / 255 - s.image_mean[2 - c]) / s.image_std[2 - c]
    return out


@pytest.mark.parametrize("size", [(9, 14), (5, 7), (23, 31), (1, 1)])
def test_tensors_equal_a_plain_loop(spark, size):
    s = Settings(model_height=9, model_width=14, clock_mask=(0, 0, 2, 5))
    frames = [("a", k, *size, x.tobytes()) for k, x in enumerate(pictures(20, *size))]
    frames += [("a", 100, *size, None), ("a", 101, size[0] + 1, size[1], frames[0][4]), ("b", 102, None, 3, b"x"), ("b", 103, 2, 2, pictures(1, 2, 2).tobytes())]
    df = spark.createDataFrame(frames, FRAME).selectExpr("*", "'x' as tensor2", "1 as Height2").coalesce(2)
    out = N.tensors(df, s)
    assert out.columns == ["camera_name", "frame_id", "tensor"] and out.schema["tensor"].metadata["shape"] == [3, 9, 14]
    got = {r.frame_id: r.tensor for r in out.collect()}
    assert len(got) == 24 and got[100] is None and got[101] is None and got[102] is None
    for _, k, h, w, image in frames[:20] + frames[-1:]:
        want = plain(np.frombuffer(image, np.uint8).reshape(h, w, 3), s)
        assert np.abs(np.array(got[k]).reshape(3, 9, 14) - want).max() < 1e-5
    unmasked = N.tensors(df.filter("frame_id = 3"), s, mask=False).first().tensor
    assert np.abs(np.array(unmasked).reshape(3, 9, 14) - plain(np.frombuffer(frames[3][4], np.uint8).reshape(*size, 3), s, False)).max() < 1e-5
    assert N.tensors(df.limit(0), s).count() == 0


def test_what_a_model_is_given(spark):
    full = N.prepared(pictures(2, 108, 192))
    assert full.shape == (2, 3, 288, 512) and full.dtype == np.float32


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "frames")
    rows = [(c, k, 2, 3, None if k % 50 == 7 else (f"{c}{k}".encode() * 3)[:18]) for c in ("cam1", "cam2") for k in range(3000)] + [("cam2", 5, 2, 3, b"twice"), (None, 1, 2, 3, b"none")]
    I.write_frames(spark.createDataFrame(rows, FRAME).repartition(3), path, index_files=2)
    return path, rows


def test_stored_frames_come_back_whole(spark, store):
    path, rows = store
    got = I.read_frames(spark, path).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((*r[:4], None if r[4] is None else bytearray(r[4])) for r in rows), key=key)


def test_filters_reach_the_scan(spark, store):
    path, _ = store
    df = I.read_frames(spark, path).filter("camera_name = 'cam1' and frame_id in (7, 8, 2999) and length(image) > 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "length" in plan.split("Filter", 1)[1].split("\n")[0] and "cam1" not in plan.split("Filter", 1)[1].split("\n")[0]
    assert sorted(r.frame_id for r in df.collect()) == [8, 2999]
    assert I.read_frames(spark, path).filter("camera_name = 'cam2' and frame_id = 5").count() == 2
    assert I.read_frames(spark, path).filter("frame_id >= 10 and frame_id < 13 and camera_name > 'cam1'").count() == 3
    assert I.read_frames(spark, path).filter("camera_name = 'cam3'").count() == 0
    assert I.read_frames(spark, path).filter("camera_name is null").count() == 1


def test_bytes_read_follow_the_frames_asked_for(spark, store, monkeypatch):
    path, _ = store
    read = []

    def images(system, root, rows, real=I.FrameStoreReader._images):
        read.append(sum(max(0, r["length"]) for r in rows))
        return real(system, root, rows)

    monkeypatch.setattr(I.FrameStoreReader, "_images", staticmethod(images))
    everything = I.FrameStoreReader(path)
    n_groups = len(everything.partitions())
    point = I.FrameStoreReader(path)
    left = list(point.pushFilters([I.EqualTo(("camera_name",), "cam1"), I.EqualTo(("frame_id",), 1234), I.EqualTo(("height",), 2)]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and left[0].attribute == ("height",)
    groups = point.partitions()
    assert 1 <= len(groups) <= 2 <= n_groups  # the one that holds the frame, or two that meet there
    rows = [r for g in groups for r in point.read(g)]
    assert [(r[0], r[1]) for r in rows] == [("cam1", 1234)] and read == [len(rows[0][4])]


def test_a_store_of_no_frames(spark, tmp_path):
    I.write_frames(spark.createDataFrame([], FRAME), str(tmp_path / "none"))
    assert I.read_frames(spark, str(tmp_path / "none")).count() == 0


def plug_ins():
    """A decoder and a detector, made here so that they travel to tasks by value."""

    def decode(path, first, end):
        n, missing = int(path.split("-")[1]), 5
        for k in range(first, min(n, end)):
            if k != missing:
                yield k, bytes([k % 256])

    def detector(images):
        # Depends on the whole window, so that windows that are cut otherwise would show.
        total = sum(i[0] for i in images)
        return [(float(i[0]), float(total), 0.9 if i[0] % 4 else 0.1) for i in images]

    return decode, detector


def test_detection_beside_decoding_for_any_split(spark):
    decode, detector = plug_ins()
    videos = spark.createDataFrame([("a", "v-100", 100), ("b", "v-7", 7), ("c", "v-0", 0), ("d", "v-9", None)], "camera_name string, path string, frames long")
    outs = []
    for halo in (0, 2):
        results = []
        for split in (1, 3, 10, 64, 1000):
            df = live.detect_in_videos(videos, decode, detector, split=split, halo=halo)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "image" not in plan and "first" in plan
            results.append(sorted(tuple(r) for r in df.collect()))
        assert all(r == results[0] for r in results) and len(results[0]) == 105
        outs.append(results[0])
    assert outs[0] != outs[1]
    images = spark.createDataFrame([(c, k, i) for c, p in (("a", "v-100"), ("b", "v-7")) for k, i in decode(p, 0, 1000)], "camera_name string, frame_id long, image binary").repartition(5)
    for run_of in (1, 4, 256):
        assert sorted(tuple(r) for r in live.detect_balls(images, detector, run_of=run_of).collect()) == outs[0]


def test_poses_of_stored_frames(spark, store):
    path, _ = store

    def estimator(image):
        size = len(image)
        return [{"ls": (1.0, 2.0, 0.5), "bbox": (0.0, 0.0, 1.0, 1.0)}, {"bbox": (0.0, 5.0, size, 9.0)}, {"bbox": (0.0, 1.0, 3.0, 8.0)}]

    frames = I.read_frames(spark, path).filter("camera_name = 'cam1' and frame_id between 20 and 22")
    got = {r.frame_id: r.players for r in live.estimate_poses(frames, estimator).collect()}
    assert sorted(got) == [20, 21, 22] and [p.bbox.y1 for p in got[20]] == [5.0, 1.0] and got[20][0].ls is None


def test_frames_of_video_files(spark, tmp_path):
    for name, n in (("cam1_a.mp4", 70), ("cam2_b.mp4", 3), ("cam3_c.mp4", 0)):
        (tmp_path / name).write_text("x" * n)
    got = T.video_frames(spark, str(tmp_path / "*.mp4"), lambda file: enumerate(open(file.removeprefix("file:"), "rb").read()[k : k + 1] for k in range(len(open(file.removeprefix("file:"), "rb").read()))))
    assert {(r.camera_name, r.n, r.last) for r in got.groupBy("camera_name").agg(F.count("*").alias("n"), F.max("frame_id").alias("last")).collect()} == {("cam1", 70, 69), ("cam2", 3, 2)}


def test_calibration_files_and_camera_choice(spark, tmp_path):
    clicks = spark.createDataFrame([(c, k, u, v) for c in ("cam1", "cam2") for k, (u, v) in enumerate([(100.0, 90.0), (500.0, 92.0), (20.0, 570.0), (920.0, 574.0)])] + [("cam1", 9, 0.0, 0.0)], "camera_name string, click_no int, u double, v double")
    found = G.calibrated(clicks.filter("click_no < 4"), T.cameras(spark), [])
    sinks.write_calibration(found, str(tmp_path / "cal"))
    back = {r.camera_name: r for r in spark.read.json(str(tmp_path / "cal")).collect()}
    assert (back["cam1"].y_far, back["cam1"].px_width_far, back["cam1"].y_near, back["cam1"].px_width_near) == (91.0, 400.0, 572.0, 900.0)
    k = 1 / (25.0 * 10.97)
    assert abs(back["cam2"].alpha / (500.0 / 481.0) - back["cam2"].beta / (400.0 - 500.0 / 481.0 * 91.0)) < 1e-9 and back["cam2"].alpha > k
    # Five clicks are no calibration, and one line has none.
    assert G.calibrated(clicks, T.cameras(spark), []).filter("camera_name = 'cam1'").count() == 0
    flat = clicks.filter("camera_name = 'cam2'").withColumn("v", F.lit(5.0))
    assert G.calibrated(flat, T.cameras(spark), []).first().alpha is None
    assert T.of_cameras(clicks, ["cam2"]).select("camera_name").distinct().first().camera_name == "cam2"
