"""Alignment of two cameras: acceleration signals, their correlation by lag, the best lag, impact peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance, interpretation
from ..settings import DEFAULTS, Settings
from .windows import along, chunked_range, in_pieces


def length_of(df: DataFrame) -> DataFrame:
    """One row: frames from 0 to the last of any camera."""
    return df.agg((F.coalesce(F.max("frame_id"), F.lit(-1)) + 1).alias("n_frames"))


def accel_signal(df: DataFrame, n_frames: DataFrame | None = None) -> DataFrame:
    """(camera_name, frame_id, accel) of every frame from 0: change of velocity where three frames in a row are known, else 0.

    Of rows that share a frame the last in order of ingest_seq, if there is one, counts.
    """
    size = length_of(df) if n_frames is None else n_frames
    spine = df.select("camera_name").distinct().crossJoin(F.broadcast(size)).select("camera_name", F.lit(0).alias("_a"), (F.col("n_frames") - 1).alias("_b"))
    spine = chunked_range(spine, "_a", "_b", "frame_id").select("camera_name", "frame_id")
    order = F.col("ingest_seq") if "ingest_seq" in df.columns else F.lit(0)
    known = df.filter("interp_u is not null and frame_id >= 0").groupBy("camera_name", "frame_id").agg(F.max_by(F.struct("interp_u", "interp_v"), order).alias("at"))
    dense = spine.join(known, ["camera_name", "frame_id"], "left").select("camera_name", "frame_id", F.col("at.interp_u").alias("u"), F.col("at.interp_v").alias("v"))
    w = along()
    p, q = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    du, dv = (q("u") - F.col("u")) - (F.col("u") - p("u")), (q("v") - F.col("v")) - (F.col("v") - p("v"))
    return dense.select("camera_name", "frame_id", F.coalesce(distance(du, dv), F.lit(0.0)).alias("accel"))


def z_score(signal: DataFrame) -> DataFrame:
    """With z: less the mean, over the population deviation unless that is next to nothing."""
    stats = signal.groupBy("camera_name").agg(F.avg("accel").alias("_m"), F.stddev_pop("accel").alias("_s"))
    own = signal.join(F.broadcast(stats), "camera_name")  # a row a camera
    return own.withColumn("z", F.when(F.col("_s") < 1e-9, F.col("accel") - F.col("_m")).otherwise((F.col("accel") - F.col("_m")) / F.when(F.col("_s") >= 1e-9, F.col("_s")))).drop("_m", "_s")


def lag_correlation(signal: DataFrame, a: str, b: str, max_lag: int = DEFAULTS.max_lag, block: int = 1024) -> DataFrame:
    """(lag, corr): sum over frames of a at f times b at f - lag, for lags up to max_lag both ways.

    Blocks of a's frames meet the frames of b within reach, which are at most two blocks' rows; each block gives a row a lag.
    """
    import numpy as np
    import pandas as pd

    block = max(block, 2 * max_lag)

    def correlate(pdf):
        first = int(pdf["_block"].iloc[0]) * block
        rows = {}
        for name, camera, low, size in (("a", a, first, block), ("b", b, first - max_lag, block + 2 * max_lag)):
            own = pdf[pdf["camera_name"] == camera]
            rows[name], rows[f"{name}_known"] = np.zeros(size), np.zeros(size)
            at = own["frame_id"].to_numpy() - low
            rows[name][at], rows[f"{name}_known"][at] = own["z"].to_numpy(float), 1.0
        # Of b, frame f - lag stands at f - first - lag + max_lag.
        lags = np.arange(-max_lag, max_lag + 1)
        sums, met = (np.correlate(rows[f"b{k}"], rows[f"a{k}"], "valid")[::-1] for k in ("", "_known"))
        return pd.DataFrame({"lag": lags[met > 0], "corr": sums[met > 0]})

    z = z_score(signal).filter(F.col("camera_name").isin(a, b)).select("camera_name", "frame_id", "z")
    f = F.col("frame_id")
    own = F.array(F.floor(f / block))
    reach = F.sequence(F.floor((f - max_lag) / block), F.floor((f + max_lag) / block))
    dealt = z.withColumn("_block", F.explode(F.when(F.col("camera_name") == a, own).otherwise(reach)))
    return dealt.groupBy("_block").applyInPandas(correlate, "lag int, corr double").groupBy("lag").agg(F.sum("corr").alias("corr"))


def full_correlation(signal: DataFrame, a: str, b: str, block: int = 1 << 18) -> DataFrame:
    """(lag, corr) over all lags at which a frame of a meets one of b.

    By a Fourier transform that is dealt out: the signal's places are a matrix, row by row. Groups of columns are transformed and
    turned by their place; after a shuffle groups of rows are, which gives the spectrum; there the two signals are multiplied, and
    the way back is the same in the other order. So a task holds groups of about `block` places, or one column or row, however long
    the signals are, and what is shuffled grows in proportion to the frames: blocks of numbers, three times. How many frames
    meet at a lag is computed beside the sum, from signals that are 1 where a frame is known.

    Defined cases: without a frame of either camera there is no lag; frames may be missing, and cameras may cover other ranges; of frames
    that are there twice the values are summed.
    """
    import numpy as np
    import pandas as pd

    spark = signal.sparkSession
    z = z_score(signal).filter(F.col("camera_name").isin(a, b) & F.col("frame_id").isNotNull()).select("camera_name", "frame_id", "z")
    ends = {r.camera_name: (r.low, r.high) for r in z.groupBy("camera_name").agg(F.min("frame_id").alias("low"), F.max("frame_id").alias("high")).collect()}  # two rows
    if len(ends) < 2:
        return spark.createDataFrame([], "lag long, corr double")
    (low_a, high_a), (low_b, high_b) = ends[a], ends[b]
    n_a, n_b = high_a - low_a + 1, high_b - low_b + 1
    bits = (n_a + n_b - 2).bit_length()
    n1, n2 = 1 << (bits + 1) // 2, 1 << bits // 2
    wide, high = min(n2, max(1, block // n1)), min(n1, max(1, block // n2))  # columns of a group, rows of a group

    def turned(rows: np.ndarray, columns: np.ndarray, sign: int) -> np.ndarray:
        return np.exp(sign * 2j * np.pi * ((rows[:, None] * columns[None]) % (n1 * n2)) / (n1 * n2))

    def parts_of(values: np.ndarray, own: int, axis: int, step: int) -> pd.DataFrame:
        """Parts of (signals, rows, columns) along an axis, for the groups there."""
        parts = np.split(values, values.shape[axis] // step, axis)
        return pd.DataFrame({"to_group": range(len(parts)), "from_group": own, "part": [np.ascontiguousarray(p).tobytes() for p in parts]})

    def joined(pdf: pd.DataFrame, signals: int, rows: int, columns: int, axis: int) -> np.ndarray:
        out = np.zeros((signals, rows, columns), complex)
        step = high if axis == 1 else wide
        for g, held in zip(pdf["from_group"], pdf["part"], strict=True):
            where = [slice(None)] * 3
            where[axis] = slice(g * step, (g + 1) * step)
            out[tuple(where)] = np.frombuffer(held, complex).reshape(out[tuple(where)].shape)
        return out

    def columns_forward(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["group"].iloc[0])
        out = np.zeros((4, n1, wide), complex)
        for k, (camera, low) in enumerate(((a, low_a), (b, low_b))):
            own = pdf[pdf["camera_name"] == camera]
            place = own["frame_id"].to_numpy() - low
            at = (place // n2, place % n2 - g * wide)
            np.add.at(out[k], at, own["z"].to_numpy(float))
            np.add.at(out[2 + k], at, 1.0)
        out = np.fft.fft(out, axis=1) * turned(np.arange(n1), np.arange(g * wide, (g + 1) * wide), -1)
        return parts_of(out, g, 1, high)

    def rows_there_and_back(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["to_group"].iloc[0])
        spectrum = np.fft.fft(joined(pdf, 4, high, n2, 2), axis=2)
        product = np.stack([spectrum[0] * np.conj(spectrum[1]), spectrum[2] * np.conj(spectrum[3])])
        back = np.fft.ifft(product, axis=2) * turned(np.arange(g * high, (g + 1) * high), np.arange(n2), 1)
        return parts_of(back, g, 2, wide)

    def columns_back(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["to_group"].iloc[0])
        sums, met = np.fft.ifft(joined(pdf, 2, n1, wide, 1), axis=1).real
        place = np.arange(n1)[:, None] * n2 + np.arange(g * wide, (g + 1) * wide)[None]
        lag = np.where(place < n_a, place, place - n1 * n2)
        there = np.rint(met) > 0
        return pd.DataFrame({"lag": lag[there] + (low_a - low_b), "corr": sums[there]})

    low = F.when(F.col("camera_name") == a, F.lit(low_a)).otherwise(F.lit(low_b))
    dealt = z.withColumn("group", F.floor((F.col("frame_id") - low) % n2 / wide).cast("long"))
    kind = "to_group long, from_group long, part binary"
    spectra = dealt.groupBy("group").applyInPandas(columns_forward, kind)
    return spectra.groupBy("to_group").applyInPandas(rows_there_and_back, kind).groupBy("to_group").applyInPandas(columns_back, "lag long, corr double")


def best_lag(corr: DataFrame, max_lag: int = DEFAULTS.max_lag) -> DataFrame:
    """(tau, peak): the lag of the largest correlation, the smallest of equals."""
    top = F.max(F.struct(F.col("corr"), (-F.col("lag")).alias("m")))
    return corr.filter(F.abs("lag") <= max_lag).agg(top.alias("t")).select((-F.col("t.m")).alias("tau"), F.col("t.corr").alias("peak"))


def signal_to_noise(corr: DataFrame) -> DataFrame:
    """(snr, weak): the peak over all lags against the mean of their absolute values; weak below 3."""
    return corr.agg((F.max("corr") / (F.avg(F.abs("corr")) + 1e-9)).alias("snr")).withColumn("weak", F.col("snr") < 3.0)


def aligned_frames(df: DataFrame, tau: DataFrame, b: str) -> DataFrame:
    """aligned_frame_id: camera b's frames less tau, others as they are; may be negative."""
    own = df.crossJoin(F.broadcast(tau.select(F.col("tau").alias("_tau"))))
    return own.withColumn("aligned_frame_id", F.when(F.col("camera_name") == b, F.col("frame_id") - F.col("_tau")).otherwise(F.col("frame_id"))).drop("_tau")


def shifted(signal: DataFrame, tau: DataFrame, b: str) -> DataFrame:
    """The signal with camera b's moved by tau frames, 0 where nothing moves in."""
    moved = signal.crossJoin(F.broadcast(tau.select(F.col("tau").alias("_tau"))))
    moved = moved.select("camera_name", F.when(F.col("camera_name") == b, F.col("frame_id") + F.col("_tau")).otherwise(F.col("frame_id")).alias("frame_id"), "accel")
    return signal.select("camera_name", "frame_id").join(moved, ["camera_name", "frame_id"], "left").fillna(0.0, ["accel"])


def saddles(x, tops):
    """Of each top the lowest value up to the next higher one, to the left and to the right, and whether instead an end was met.

    A stack holds the values still without a higher one, each with the lowest since the one below it, so each value is looked at twice.
    """
    import numpy as np

    def one_way(values: list, wanted: set):
        lows, ends, stack = {}, {}, []
        for k, v in enumerate(values):
            low = v
            while stack and stack[-1][0] <= v:
                low = min(low, stack.pop()[1])
            if k in wanted:
                lows[k], ends[k] = low, not stack
            stack.append((v, low))
        return lows, ends

    n, places = len(x), tops.tolist()
    lows, ends = one_way(x.tolist(), set(places))
    left, left_end = np.array([lows[t] for t in places], float), np.array([ends[t] for t in places], bool)
    lows, ends = one_way(x[::-1].tolist(), {n - 1 - t for t in places})
    return left, np.array([lows[n - 1 - t] for t in places], float), left_end, np.array([ends[n - 1 - t] for t in places], bool)


def peaks(signal: DataFrame, s: Settings = DEFAULTS, size: int = 8192, halo: int = 512) -> DataFrame:
    """(camera_name, frame_id, accel) of impacts: local maxima, high and prominent enough, the higher first where two are near.

    Which of near ones stay depends on those already taken, so it runs on pieces of a camera's frames. A piece is sure if
    on both sides of its frames there is a stretch without maxima in the halo, and each maximum has fallen far enough, or met a
    higher one, before the halo ends. A piece takes linear time, but for sorting its maxima by height.
    """
    import numpy as np

    def tops_of(x):
        """Middles of plateaus that are higher than what is beside them."""
        start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        end = np.concatenate((start[1:], [len(x)])) - 1
        level = x[start]
        top = np.zeros(len(start), bool)
        top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
        return (start[top] + end[top]) // 2

    def pick(pdf, inside, first, last):
        x = pdf["accel"].to_numpy(float)
        tops = tops_of(x)
        tops = tops[x[tops] >= s.peak_height]
        keep, order = [True] * len(tops), tops.tolist()
        for k in np.argsort(x[tops], kind="stable")[::-1].tolist():
            if keep[k]:  # near ones are neighbours
                for step in (-1, 1):
                    i = k + step
                    while 0 <= i < len(order) and abs(order[i] - order[k]) < s.peak_distance:
                        keep[i] = False
                        i += step
        own = np.flatnonzero(inside)
        a, b = (own[0], own[-1]) if len(own) else (0, 0)
        # Gaps without a maximum that reach into the halo: beyond them nothing bears on the piece.
        marks = np.concatenate(([0], tops, [len(x) - 1]))
        gaps = marks[:-1][np.diff(marks) >= s.peak_distance], marks[1:][np.diff(marks) >= s.peak_distance]
        sure = (first or (gaps[1] <= a).any() or not (tops <= a).any()) and (last or (gaps[0] >= b).any() or not (tops >= b).any())
        tops = tops[np.array(keep, bool)]
        tops = tops[inside[tops]]
        left, right, left_end, right_end = saddles(x, tops)
        # Beyond an end it could only fall further; where it has fallen far enough that doesn't matter.
        sure &= (first or not (left_end & (x[tops] - left < s.peak_prominence)).any()) and (last or not (right_end & (x[tops] - right < s.peak_prominence)).any())
        out = tops[x[tops] - np.maximum(left, right) >= s.peak_prominence]
        return pdf.loc[out, ["camera_name", "frame_id", "accel"]], bool(sure)

    return in_pieces(signal.select("camera_name", "frame_id", "accel"), ["camera_name"], "frame_id", pick, "camera_name string, frame_id long, accel double", size, halo)


def sync_report(tau: DataFrame, found: DataFrame, a: str, b: str) -> DataFrame:
    """One row: tau, how to read it, the peak's value to 4 places, and the impact frames of both."""
    listed = lambda c: F.sort_array(F.collect_list(F.when(F.col("camera_name") == c, F.col("frame_id"))))
    frames = found.agg(listed(a).alias("frames_a"), listed(b).alias("frames_b_aligned"))
    return tau.crossJoin(F.broadcast(frames)).select(F.col("tau").alias("tau_offset"), interpretation(a, b, F.col("tau")).alias("interpretation"), F.round("peak", 4).alias("corr_peak_value"), "frames_a", "frames_b_aligned")
