"""All queries of the engine itself, by name, with their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import tensors as N
from .operators import cleaning as C
from .operators import frames as R
from .operators import players as P
from .operators import rallies as L
from .operators import sync as Y
from .oracle import BALL, S, r, sql
from .plans import batch
from .plans.storage import fresh_path, stored
from .sources import images as I
from .sources import sinks
from .sources import tables as T
from .streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
A, B = "cam1", "cam2"
BALLS = ("camera_name", "frame_id", "detected", "ball_u", "ball_v", "ball_conf")
SHOULDERS = [f"{p}_{j}_{x}" for p in ("p0", "p1") for j in ("ls", "rs") for x in "uv"]


def query(select: str | None = None, chain: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if select:
            ORACLE_SQL[f.__name__] = sql(select) if chain else select
        return f

    return add


def detections_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.events_to_detections(spark.read.parquet(f"{sf_dir}/events.parquet"))


def rule_rows(df: DataFrame) -> DataFrame:
    return df.select(*BALLS, F.col("outlier_rule").alias("rule"))


def upto(df: DataFrame, cams: DataFrame, stage: int) -> DataFrame:
    """Cleaning up to a stage: 2 bounds, 5 the fixpoint, 6 static, 7 segments, 8 crossing time, 9 half court."""
    df = C.out_of_bounds(C.low_conf(C.gate(df.select(*BALLS))))
    steps = {5: lambda d: C.kinematic_fixpoint(d, cams), 6: C.static_cluster, 7: C.short_segment, 8: lambda d: C.crossing_time(d, cams), 9: lambda d: C.half_court(d, cams)}
    for k, f in steps.items():
        if k <= stage:
            df = f(df)
    return df


def cleaned_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(C.clean(stored(detections_of(spark, sf_dir), "detections"), T.cameras(spark)), "cleaned")


def match_of(spark: SparkSession, sf_dir: str) -> batch.Match:
    return batch.analyse(cleaned_of(spark, sf_dir), T.cameras(spark))


@query("SELECT * FROM det")
def detections(spark, sf_dir):
    return detections_of(spark, sf_dir)


@query(f"SELECT {BALL}, rule FROM r1")
def r1_low_conf(spark, sf_dir):
    return rule_rows(C.low_conf(C.gate(detections_of(spark, sf_dir))))


@query(f"SELECT {BALL}, rule FROM f0")
def r2_bounds(spark, sf_dir):
    return rule_rows(upto(detections_of(spark, sf_dir), T.cameras(spark), 2))


@query(f"SELECT {BALL}, rule FROM f1")
def r345_pass1(spark, sf_dir):
    return rule_rows(C.kinematic_pass(upto(detections_of(spark, sf_dir), T.cameras(spark), 2), T.cameras(spark)))


@query(f"SELECT {BALL}, rule FROM f{S.passes}")
def r345_fixpoint(spark, sf_dir):
    return rule_rows(upto(detections_of(spark, sf_dir), T.cameras(spark), 5))


@query(f"SELECT {BALL}, rule FROM st")
def r6_static(spark, sf_dir):
    return rule_rows(upto(detections_of(spark, sf_dir), T.cameras(spark), 6))


@query(f"SELECT {BALL}, rule FROM sg")
def r7_segments(spark, sf_dir):
    return rule_rows(upto(detections_of(spark, sf_dir), T.cameras(spark), 7))


@query(f"SELECT {BALL}, rule FROM ct")
def r8_crossing_time(spark, sf_dir):
    return rule_rows(upto(detections_of(spark, sf_dir), T.cameras(spark), 8))


@query(f"SELECT {BALL}, rule FROM hc")
def r9_half_court(spark, sf_dir):
    return rule_rows(upto(detections_of(spark, sf_dir), T.cameras(spark), 9))


@query(f"SELECT {BALL}, rule FROM lp")
def disambiguate(spark, sf_dir):
    return rule_rows(C.low_conf_path(upto(detections_of(spark, sf_dir), T.cameras(spark), 9)))


@query("SELECT camera_name, frame_id, clean_u, clean_v, interp_u, interp_v, was_interpolated, is_outlier, outlier_rule FROM it")
def interpolate(spark, sf_dir):
    return cleaned_of(spark, sf_dir).select("camera_name", "frame_id", "clean_u", "clean_v", "interp_u", "interp_v", "was_interpolated", "is_outlier", "outlier_rule")


@query(f"SELECT camera_name, raw_detections, outliers, raw_detections - outliers AS clean, interpolated, final_valid, {r('100.0::DOUBLE * outliers / greatest(raw_detections, 1)', 1)} AS outlier_pct FROM (SELECT camera_name, count(*) FILTER (detected = 1) AS raw_detections, count(*) FILTER (is_outlier) AS outliers, count(*) FILTER (was_interpolated) AS interpolated, count(interp_u) AS final_valid FROM it GROUP BY 1)")
def clean_summary(spark, sf_dir):
    return C.summary(cleaned_of(spark, sf_dir)).drop("by_rule")


@query("SELECT camera_name, outlier_rule, count(*) AS n FROM it WHERE is_outlier GROUP BY 1, 2")
def rule_counts(spark, sf_dir):
    return C.rule_counts(cleaned_of(spark, sf_dir))


@query("SELECT outlier_rule, count(*) FILTER (camera_name = 'cam1') AS cam1, count(*) FILTER (camera_name = 'cam2') AS cam2 FROM it WHERE is_outlier GROUP BY 1")
def rule_pivot(spark, sf_dir):
    return C.rule_pivot(cleaned_of(spark, sf_dir), [A, B])


HOLES = "frame_id % 50 NOT BETWEEN 20 AND 24 AND frame_id % 97 < 90"


@query(f"SELECT s.camera_name, s.frame_id, coalesce(d.detected, 0) AS detected, d.ball_u, d.ball_v, coalesce(d.ball_conf, 0.0) AS ball_conf FROM (SELECT camera_name, CAST(unnest(generate_series(min(frame_id), max(frame_id))) AS BIGINT) AS frame_id FROM det WHERE {HOLES} GROUP BY 1) s LEFT JOIN (SELECT * FROM det WHERE {HOLES}) d USING (camera_name, frame_id)")
def dense_spine(spark, sf_dir):
    return R.dense(detections_of(spark, sf_dir).filter(HOLES).select(*BALLS))


_F = "coalesce(x, last_value(x IGNORE NULLS) OVER (PARTITION BY camera_name ORDER BY frame_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"


@query(f"SELECT camera_name, frame_id, first_value(x IGNORE NULLS) OVER (PARTITION BY camera_name ORDER BY frame_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS p0_ls_u FROM (SELECT camera_name, frame_id, {_F} AS x FROM (SELECT camera_name, frame_id, CASE WHEN frame_id % 60 < 40 THEN p0_ls_u END AS x FROM det))")
def ffill_bfill(spark, sf_dir):
    gaps = detections_of(spark, sf_dir).select("camera_name", "frame_id", F.when(F.col("frame_id") % 60 < 40, F.col("p0_ls_u")).alias("p0_ls_u"))
    return R.fill_both_ways(gaps, ["p0_ls_u"])


@query("SELECT camera_name, frame_id, accel FROM sig")
def accel_signal(spark, sf_dir):
    return Y.accel_signal(cleaned_of(spark, sf_dir))


@query("SELECT camera_name, count(*) FILTER (accel > 0) AS n_moving, round(avg(accel), 6) AS mean, round(stddev_pop(accel), 6) AS deviation FROM sig GROUP BY 1")
def accel_stats(spark, sf_dir):
    return Y.accel_signal(cleaned_of(spark, sf_dir)).groupBy("camera_name").agg(F.count_if(F.col("accel") > 0).alias("n_moving"), F.round(F.avg("accel"), 6).alias("mean"), F.round(F.stddev_pop("accel"), 6).alias("deviation"))


@query("SELECT camera_name, frame_id, round(z, 6) AS z FROM zs")
def z_scores(spark, sf_dir):
    return Y.z_score(Y.accel_signal(cleaned_of(spark, sf_dir))).select("camera_name", "frame_id", F.round("z", 6).alias("z"))


@query("SELECT lag, round(corr, 4) AS corr FROM corr")
def lag_correlation(spark, sf_dir):
    return Y.lag_correlation(Y.accel_signal(cleaned_of(spark, sf_dir)), A, B).select("lag", F.round("corr", 4).alias("corr"))


def tau_of(spark, sf_dir) -> DataFrame:
    return Y.best_lag(Y.lag_correlation(Y.accel_signal(cleaned_of(spark, sf_dir)), A, B))


@query("SELECT tau, round(peak, 4) AS peak, CASE WHEN tau >= 0 THEN 'cam2 lags cam1 by ' ELSE 'cam2 leads cam1 by ' END || abs(tau) || ' frames' AS interpretation FROM tau")
def sync_offset(spark, sf_dir):
    return tau_of(spark, sf_dir).select("tau", F.round("peak", 4).alias("peak"), G.interpretation(A, B, F.col("tau")).alias("interpretation"))


@query("SELECT round(max(corr) / (avg(abs(corr)) + 1e-9), 4) AS snr, max(corr) / (avg(abs(corr)) + 1e-9) < 3.0 AS weak FROM (SELECT a.frame_id - b.frame_id AS lag, sum(a.z * b.z) AS corr FROM zs a, zs b WHERE a.camera_name = 'cam1' AND b.camera_name = 'cam2' GROUP BY 1)")
def signal_to_noise(spark, sf_dir):
    return Y.signal_to_noise(Y.full_correlation(Y.accel_signal(cleaned_of(spark, sf_dir)), A, B)).withColumn("snr", F.round("snr", 4))


@query("SELECT camera_name, frame_id, CASE WHEN camera_name = 'cam2' THEN frame_id - tau ELSE frame_id END AS aligned_frame_id FROM it, tau")
def aligned_frames(spark, sf_dir):
    return batch.align(cleaned_of(spark, sf_dir), A, B).select("camera_name", "frame_id", "aligned_frame_id")


@query("SELECT s.camera_name, s.frame_id, coalesce(m.accel, 0.0) AS accel FROM sig s LEFT JOIN (SELECT camera_name, CASE WHEN camera_name = 'cam2' THEN frame_id + tau ELSE frame_id END AS frame_id, accel FROM sig, tau) m USING (camera_name, frame_id)")
def shifted_signal(spark, sf_dir):
    return Y.shifted(Y.accel_signal(cleaned_of(spark, sf_dir)), tau_of(spark, sf_dir), B)


@query()
def impact_peaks(spark, sf_dir):
    return Y.peaks(Y.accel_signal(cleaned_of(spark, sf_dir)))


@query()
def sync_report(spark, sf_dir):
    signal, tau = Y.accel_signal(cleaned_of(spark, sf_dir)), tau_of(spark, sf_dir)
    return Y.sync_report(tau, Y.peaks(Y.shifted(signal, tau, B)), A, B)


@query("SELECT camera_name, frame_id, row_idx, time, interp_u, interp_v, v_px, is_valid FROM mv")
def motion_valid(spark, sf_dir):
    return L.motion(cleaned_of(spark, sf_dir)).select("camera_name", "frame_id", "row_idx", "time", "interp_u", "interp_v", "v_px", "is_valid")


@query("SELECT camera_name, rally_id, start_frame, end_frame, rally_start, rally_end FROM tr")
def trajectory_rallies(spark, sf_dir):
    return L.trajectory_rallies(stored(L.motion(cleaned_of(spark, sf_dir)), "moving"))


@query("SELECT camera_name, frame_id, row_idx FROM cr")
def crossings(spark, sf_dir):
    return match_of(spark, sf_dir).crossings


@query("SELECT camera_name, rally_id, start_frame, end_frame, rally_start, rally_end FROM ra")
def rallies(spark, sf_dir):
    return match_of(spark, sf_dir).rallies


@query("SELECT camera_name, frame_id, rally_id FROM fr")
def rally_of_frames(spark, sf_dir):
    m = match_of(spark, sf_dir)
    return L.rally_of_frames(m.moving.select("camera_name", "frame_id"), m.rallies)


@query("SELECT camera_name, rally_id, count(*) AS n_frames, min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM fr WHERE rally_id IS NOT NULL GROUP BY 1, 2")
def frames_of_rallies(spark, sf_dir):
    m = match_of(spark, sf_dir)
    inside = L.rally_of_frames(m.moving.select("camera_name", "frame_id"), m.rallies).filter("rally_id is not null")
    return inside.groupBy("camera_name", "rally_id").agg(F.count("*").alias("n_frames"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))


@query("SELECT tr.camera_name, tr.rally_id, tr.start_frame, tr.end_frame, count(cr.frame_id) AS shots FROM tr LEFT JOIN cr ON cr.camera_name = tr.camera_name AND cr.frame_id BETWEEN tr.start_frame AND tr.end_frame GROUP BY 1, 2, 3, 4")
def crossings_per_rally(spark, sf_dir):
    m = match_of(spark, sf_dir)
    return L.crossings_per_rally(L.trajectory_rallies(m.moving), m.crossings).select("camera_name", "rally_id", "start_frame", "end_frame", "shots")


_EMPTY = "SELECT camera_name, CAST(row_number() OVER (PARTITION BY camera_name ORDER BY g) AS INTEGER) AS rally_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame, CAST(sum(shots) AS BIGINT) AS shots FROM (SELECT *, CASE WHEN n = 0 THEN rally_id - 1 ELSE least(g0, n - 1) END AS g FROM (SELECT *, coalesce(sum(CASE WHEN shots > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_name ORDER BY rally_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g0, sum(CASE WHEN shots > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_name) AS n FROM ({})))  GROUP BY camera_name, g"
_WINDOWS = "SELECT camera_name, CAST(frame_id // 40 + 1 AS INTEGER) AS rally_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) FILTER (frame_id IN (SELECT frame_id FROM cr WHERE cr.camera_name = mv.camera_name)) AS shots FROM mv GROUP BY 1, 2"


@query(_EMPTY.format(_WINDOWS))
def merged_rallies(spark, sf_dir):
    m = match_of(spark, sf_dir)
    hit = m.crossings.select("camera_name", "frame_id", F.lit(1).alias("hit"))
    even = m.moving.select("camera_name", "frame_id").join(hit, ["camera_name", "frame_id"], "left").groupBy("camera_name", (F.floor(F.col("frame_id") / 40) + 1).cast("int").alias("rally_id")).agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.count("hit").alias("shots"))
    return L.merge_empty(even)


@query("SELECT camera_name, frame_id, ball_kmh FROM sp")
def ball_speed(spark, sf_dir):
    return match_of(spark, sf_dir).located.select("camera_name", "frame_id", "ball_kmh")


@query("SELECT camera_name, frame, time_s, rally_id, speed_kmh, near_player FROM ht")
def hit_events(spark, sf_dir):
    m = match_of(spark, sf_dir)
    return P.hit_events(m.located.drop("rally_id"), m.crossings, m.rallies)


@query("SELECT camera_name, frame_id, near, CASE near WHEN 'p0' THEN 'p1' WHEN 'p1' THEN 'p0' END AS far, p0_x, p0_y, p1_x, p1_y FROM pl")
def player_places(spark, sf_dir):
    df = detections_of(spark, sf_dir).withColumns({"interp_u": F.col("ball_u"), "interp_v": F.col("ball_v")})
    at = P.located(df, T.cameras(spark))
    return at.select("camera_name", "frame_id", "near", "far", *[F.col(f"{p}_w.{c}").alias(f"{p}_{c}") for p in ("p0", "p1") for c in "xy"])


_COURT = lambda x, y: f"CASE WHEN {x} IS NOT NULL THEN {r(f'greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x} / {S.court_width}::DOUBLE))', 3)} END AS x, CASE WHEN {x} IS NOT NULL THEN {r(f'greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - {y} / {S.court_length}::DOUBLE))', 3)} END AS y"


@query(f"SELECT camera_name, frame_id, {_COURT('ball_x', 'ball_y')} FROM lo")
def world_coords(spark, sf_dir):
    x, y = G.to_court(F.col("ball_w"))
    return match_of(spark, sf_dir).located.select("camera_name", "frame_id", x.alias("x"), y.alias("y"))


@query("SELECT camera_name, rally_id, role, total_distance, avg_move_speed, max_move_speed FROM ps")
def player_stats(spark, sf_dir):
    return P.player_stats(match_of(spark, sf_dir).moved)


@query("SELECT camera_name, frame_id, near_m, far_m, p0_m, p1_m FROM mo WHERE rally_id IS NOT NULL")
def player_moves(spark, sf_dir):
    return match_of(spark, sf_dir).moved.filter("rally_id is not null").select("camera_name", "frame_id", "near_m", "far_m", "p0_m", "p1_m")


@query("SELECT camera_name, rally_id, start_frame, end_frame, rally_start_s, rally_end_s, duration_s, shots, dist_m FROM rs")
def rally_stats(spark, sf_dir):
    m = match_of(spark, sf_dir)
    return P.rally_stats(m.rallies, m.shots.filter("rally_id is not null"), m.moved)


@query("SELECT camera_name, rally_id, total_shots, avg_ball_speed, max_ball_speed FROM bs")
def rally_ball_stats(spark, sf_dir):
    m = match_of(spark, sf_dir)
    return P.ball_stats(m.rallies, m.shots.filter("rally_id is not null"))


@query("SELECT rs.*, b.avg_ball_speed, b.max_ball_speed FROM rs JOIN bs b USING (camera_name, rally_id)")
def rally_report(spark, sf_dir):
    m = match_of(spark, sf_dir)
    shots = m.shots.filter("rally_id is not null")
    return P.rally_stats(m.rallies, shots, m.moved).join(P.ball_stats(m.rallies, shots).drop("total_shots"), ["camera_name", "rally_id"])


@query(f"SELECT c.camera_name AS camera, CAST(coalesce(n, 0) AS INTEGER) AS total_rallies, CAST(coalesce(hits, 0) AS INTEGER) AS total_hits, {r('CASE WHEN coalesce(n, 0) > 0 THEN coalesce(hits, 0) / n ELSE 0.0 END', 2)} AS avg_hits_per_rally, {r('coalesce(d, 0.0)', 2)} AS total_dist_m, {r('coalesce(speed, 0.0)', 1)} AS avg_speed_kmh, coalesce(y_net, 260.0) AS y_net_px FROM cams c LEFT JOIN (SELECT camera_name, count(*) AS n, sum(dist_m) AS d FROM rs GROUP BY 1) USING (camera_name) LEFT JOIN (SELECT camera_name, count(*) AS hits, avg(speed_kmh) AS speed FROM ht GROUP BY 1) USING (camera_name)")
def session_summary(spark, sf_dir):
    m = match_of(spark, sf_dir)
    stats = P.rally_stats(m.rallies, m.shots.filter("rally_id is not null"), m.moved)
    return P.session_summary(stats, P.hit_events(m.located.drop("rally_id"), m.crossings, m.rallies), T.cameras(spark))


_PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(f"SELECT camera_name, frame_id, shown AS shown_rally, CAST(CASE WHEN shown IS NULL THEN 0 ELSE coalesce(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER r, 0) END AS INTEGER) AS shots, CASE WHEN shown IS NULL THEN 0.0 ELSE round(coalesce(sum(CASE WHEN rally_id IS NOT NULL THEN p0_m + p1_m ELSE 0.0 END) OVER r, 0.0), 6) END AS dist_m, coalesce(last_value(CASE WHEN hit THEN ball_kmh END IGNORE NULLS) OVER (PARTITION BY camera_name ORDER BY frame_id {_PREV}), 0.0) AS last_speed FROM (SELECT *, last_value(rally_id IGNORE NULLS) OVER (PARTITION BY camera_name ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS shown, rally_id IS NOT NULL AND (camera_name, frame_id) IN (SELECT (camera_name, frame_id) FROM cr) AS hit FROM mo) WINDOW r AS (PARTITION BY camera_name, shown ORDER BY frame_id {_PREV})")
def panel_state(spark, sf_dir):
    m = match_of(spark, sf_dir)
    return P.panel(m.moved, m.crossings).withColumn("dist_m", F.round("dist_m", 6))


def payloads_of(spark, sf_dir) -> DataFrame:
    return batch.reports(cleaned_of(spark, sf_dir), T.cameras(spark), G.parse_iso(F.lit("2024-05-01T10:00:00Z")))


@query("SELECT ra.camera_name, ra.rally_id, c.serial AS serial_number, strftime(TIMESTAMP '2024-05-01 10:00:00' + to_microseconds(CAST(floor(start_frame * 1000000 / 25.0) AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS start_time, (SELECT count(*) FROM lo WHERE lo.camera_name = ra.camera_name AND lo.rally_id = ra.rally_id AND ball_x IS NOT NULL) AS n_track, (SELECT count(*) FROM ht WHERE ht.camera_name = ra.camera_name AND ht.rally_id = ra.rally_id) AS n_result, b.avg_ball_speed FROM ra JOIN cams c USING (camera_name) JOIN bs b USING (camera_name, rally_id)")
def payload_digest(spark, sf_dir):
    j = lambda path: F.get_json_object("payload", path)
    n = lambda path: F.json_array_length(j(path)).cast("long")
    return payloads_of(spark, sf_dir).select("camera_name", "rally_id", j("$.serial_number").alias("serial_number"), j("$.startTime").alias("start_time"), n("$.content.trackMatrix").alias("n_track"), n("$.content.resultmatrix").alias("n_result"), j("$.content.mete.nearCount.avgBallSpeed").cast("double").alias("avg_ball_speed"))


@query()
def payload_json(spark, sf_dir):
    return payloads_of(spark, sf_dir)


def court(x: str, y: str, a: str = "x", b: str = "y") -> str:
    return _COURT(x, y).replace(" AS x,", f" AS {a},").removesuffix(" AS y") + f" AS {b}"


_SIDE = "struct<totalShots:int,totalDistance:double,avgMoveSpeed:double,maxMoveSpeed:double,aceCount:int>"
_HITS = "array<struct<x:double,y:double,type:string,speed:double,handType:string>>"
_TRACK = "array<struct<x:double,y:double,type:string,speed:int,timestamp:bigint,farCountPerson_x:double,farCountPerson_y:double,nearCountPerson_x:double,nearCountPerson_y:double>>"
_REPORT = f"struct<content:struct<mete:struct<farCount:{_SIDE},nearCount:{_SIDE}>,resultmatrix:{_HITS},trackMatrix:{_TRACK}>>"


def parsed_payloads(spark, sf_dir) -> DataFrame:
    return payloads_of(spark, sf_dir).select("camera_name", "rally_id", F.from_json("payload", _REPORT).alias("p")).select("camera_name", "rally_id", "p.content.*")


@query(f"SELECT camera_name, rally_id, CAST(row_number() OVER (PARTITION BY camera_name, rally_id ORDER BY frame_id) - 1 AS INTEGER) AS place, frame_id AS timestamp, 'running' AS type, 0 AS speed, {court('ball_x', 'ball_y')}, {court('far_x', 'far_y', 'farCountPerson_x', 'farCountPerson_y')}, {court('near_x', 'near_y', 'nearCountPerson_x', 'nearCountPerson_y')} FROM lo WHERE rally_id IS NOT NULL AND ball_x IS NOT NULL")
def payload_tracks(spark, sf_dir):
    return parsed_payloads(spark, sf_dir).select("camera_name", "rally_id", F.posexplode("trackMatrix").alias("place", "t")).select("camera_name", "rally_id", "place", "t.*")


@query(f"SELECT camera_name, rally_id, CAST(row_number() OVER (PARTITION BY camera_name, rally_id ORDER BY frame_id) - 1 AS INTEGER) AS place, 'hit' AS type, 'forehand' AS handType, {r('ball_kmh', 1)} AS speed, {court('ball_x', 'ball_y')} FROM sp WHERE rally_id IS NOT NULL AND ball_x IS NOT NULL AND (camera_name, frame_id) IN (SELECT (camera_name, frame_id) FROM cr)")
def payload_hits(spark, sf_dir):
    return parsed_payloads(spark, sf_dir).select("camera_name", "rally_id", F.posexplode("resultmatrix").alias("place", "t")).select("camera_name", "rally_id", "place", "t.*")


@query("SELECT p.camera_name, p.rally_id, p.role, b.total_shots, p.total_distance, p.avg_move_speed, p.max_move_speed, 0 AS ace_count FROM ps p JOIN bs b USING (camera_name, rally_id)")
def payload_players(spark, sf_dir):
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("role"), F.col(f"mete.{n}Count").alias("s")) for n in ("far", "near")]))
    rows = parsed_payloads(spark, sf_dir).select("camera_name", "rally_id", both.alias("b")).select("camera_name", "rally_id", "b.role", "b.s.*")
    return rows.toDF("camera_name", "rally_id", "role", "total_shots", "total_distance", "avg_move_speed", "max_move_speed", "ace_count")


@query("SELECT camera_name, count(*) AS n_sent FROM ra GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM ra")
def payloads_sent(spark, sf_dir):
    return sinks.sent_counts(sinks.post(payloads_of(spark, sf_dir)))


_EXP = "SELECT camera_name, frame_id, interp_u + (frame_id % 5) AS eu, interp_v - (frame_id % 3) AS ev, is_outlier AS eo, was_interpolated AS ew, frame_id FROM it WHERE frame_id % 7 <> 0"


def expected_of(cleaned: DataFrame) -> DataFrame:
    """The cleaned table with known errors and missing frames."""
    return cleaned.filter("frame_id % 7 <> 0").withColumns({"interp_u": F.col("interp_u") + F.col("frame_id") % 5, "interp_v": F.col("interp_v") - F.col("frame_id") % 3, "was_interpolated": F.col("was_interpolated") & (F.col("frame_id") % 2 == 0)})


_ERR = "SELECT i.camera_name, i.frame_id, abs(i.interp_u - (i.interp_u + frame_id % 5)) AS u_err, abs(i.interp_v - (i.interp_v - frame_id % 3)) AS v_err, i.interp_u - (i.interp_u + frame_id % 5) AS a, i.interp_v - (i.interp_v - frame_id % 3) AS b, 1 AS is_outlier_agree, CASE WHEN was_interpolated = (was_interpolated AND frame_id % 2 = 0) THEN 1 ELSE 0 END AS was_interpolated_agree FROM it i WHERE frame_id % 7 <> 0"


@query(f"SELECT camera_name, frame_id, u_err, v_err, sqrt(a*a + b*b) AS ball_err, CAST(is_outlier_agree AS INTEGER) AS is_outlier_agree, CAST(was_interpolated_agree AS INTEGER) AS was_interpolated_agree FROM ({_ERR})")
def compare_errors(spark, sf_dir):
    cleaned = cleaned_of(spark, sf_dir).drop(*SHOULDERS)
    return R.compared(cleaned, expected_of(cleaned))


@query(f"SELECT camera_name, round(avg(sqrt(a*a + b*b)), 6) AS ball_interp_mae_px, round(sqrt(avg(a*a + b*b)), 6) AS ball_interp_rmse_px, round(avg(u_err), 6) AS ball_interp_u_mae, round(avg(v_err), 6) AS ball_interp_v_mae, round(avg(is_outlier_agree), 6) AS outlier_agree_rate, round(avg(was_interpolated_agree), 6) AS interp_agree_rate FROM ({_ERR}) GROUP BY 1")
def compare_mae(spark, sf_dir):
    cleaned = cleaned_of(spark, sf_dir).drop(*SHOULDERS)
    out = R.comparison_summary(R.compared(cleaned, expected_of(cleaned)))
    return out.select("camera_name", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_JOINT = " , ".join(f"avg(abs({p}_{j}_{x} - ({p}_{j}_{x} + frame_id % {3 + k}))) AS {p}_{j}_{x}" for p in ("p0", "p1") for j in ("ls", "rs") for k, x in enumerate("uv"))


@query(f"SELECT camera_name, round((p0_ls_u + p0_ls_v) / 2, 6) AS p0_ls_mae_px, round((p0_rs_u + p0_rs_v) / 2, 6) AS p0_rs_mae_px, round(((p0_ls_u + p0_ls_v) / 2 + (p0_rs_u + p0_rs_v) / 2) / 2, 6) AS p0_avg_joint_mae_px, round(((p1_ls_u + p1_ls_v) / 2 + (p1_rs_u + p1_rs_v) / 2) / 2, 6) AS p1_avg_joint_mae_px FROM (SELECT camera_name, {_JOINT} FROM det GROUP BY 1)")
def compare_joints(spark, sf_dir):
    cleaned = cleaned_of(spark, sf_dir)
    other = cleaned.withColumns({c: F.col(c) + F.col("frame_id") % (4 if c.endswith("v") else 3) for c in SHOULDERS})
    out = R.comparison_summary(R.compared(cleaned, other))
    return out.select("camera_name", *[F.round(c, 6).alias(c) for c in ("p0_ls_mae_px", "p0_rs_mae_px", "p0_avg_joint_mae_px", "p1_avg_joint_mae_px")])


@query("SELECT count(*) AS n_common FROM (SELECT frame_id FROM det WHERE camera_name = 'cam1' INTERSECT SELECT frame_id FROM det WHERE camera_name = 'cam2')")
def frame_intersection(spark, sf_dir):
    df = detections_of(spark, sf_dir)
    return R.common_frames(df.filter(F.col("camera_name") == A), df.filter(F.col("camera_name") == B))


@query("SELECT DISTINCT outlier_rule AS rule FROM it WHERE camera_name = 'cam1' AND is_outlier UNION SELECT DISTINCT outlier_rule FROM it WHERE camera_name = 'cam2' AND is_outlier")
def rule_union(spark, sf_dir):
    hit = cleaned_of(spark, sf_dir).filter("is_outlier").select("camera_name", F.col("outlier_rule").alias("rule"))
    return hit.filter(F.col("camera_name") == A).select("rule").union(hit.filter(F.col("camera_name") == B).select("rule")).distinct()


@query("SELECT x AS camera_name FROM (VALUES ('cam1'), ('cam2'), ('cam3')) t(x) EXCEPT SELECT DISTINCT camera_name FROM det")
def missing_cameras(spark, sf_dir):
    return R.missing_cameras(spark.createDataFrame([("cam1",), ("cam2",), ("cam3",)], "camera_name string"), detections_of(spark, sf_dir))


@query("SELECT d.camera_name, d.frame_id, coalesce(c.serial, 'UNKNOWN_' || d.camera_name) AS serial, coalesce(c.y_net, 260.0) AS y_net FROM det d LEFT JOIN (SELECT * FROM cams WHERE camera_name = 'cam1') c USING (camera_name)")
def camera_lookup(spark, sf_dir):
    dim = F.broadcast(T.cameras(spark, T.DEMO_CAMERAS[:1]).select("camera_name", "serial", "y_net"))
    return detections_of(spark, sf_dir).select("camera_name", "frame_id").join(dim, "camera_name", "left").select("camera_name", "frame_id", F.coalesce("serial", F.concat(F.lit("UNKNOWN_"), F.col("camera_name"))).alias("serial"), F.coalesce("y_net", F.lit(260.0)).alias("y_net"))


@query("SELECT a.camera_name, a.frame_id, b.ball_conf FROM (SELECT camera_name, frame_id, row_number() OVER (PARTITION BY camera_name ORDER BY frame_id) AS i FROM det) a JOIN (SELECT camera_name, ball_conf, row_number() OVER (PARTITION BY camera_name ORDER BY frame_id) AS i FROM det WHERE detected = 1) b USING (camera_name, i)")
def zipped_results(spark, sf_dir):
    df = detections_of(spark, sf_dir)
    return R.zipped(df.select("camera_name", "frame_id"), df.filter("detected = 1").select("camera_name", "frame_id", "ball_conf"))


@query("SELECT camera_name, frame_id, (camera_name, frame_id) IN (SELECT (camera_name, frame_id) FROM cr) AS is_crossing FROM mv")
def crossing_members(spark, sf_dir):
    m = match_of(spark, sf_dir)
    hit = m.crossings.select("camera_name", "frame_id", F.lit(True).alias("is_crossing"))
    return m.moving.select("camera_name", "frame_id").join(hit, ["camera_name", "frame_id"], "left").fillna(False, ["is_crossing"])


_BOX = "SELECT camera_name, frame_id, k, CAST(100 + frame_id * 7 * k % 300 AS DOUBLE) AS x1, CAST(50 + frame_id * 5 * k % 200 AS DOUBLE) AS y1, CAST(100 + frame_id * 7 * k % 300 + 20 + frame_id * 3 * k % 90 AS DOUBLE) AS x2, CAST(50 + frame_id * 5 * k % 200 + 40 + frame_id * k % 70 AS DOUBLE) AS y2 FROM {0}, (SELECT unnest([1, 2, 3]) AS k)"


@query(f"SELECT camera_name, frame_id, x1, y1, x2, y2, CAST(row_number() OVER (PARTITION BY camera_name, frame_id ORDER BY (y1 + y2) / 2 DESC, x1, y1, x2, y2) - 1 AS INTEGER) AS player FROM (SELECT *, row_number() OVER (PARTITION BY camera_name, frame_id ORDER BY (x2 - x1) * (y2 - y1) DESC, x1, y1, x2, y2) AS rk FROM ({_BOX.format('det')})) WHERE rk <= 2")
def top2_dedup(spark, sf_dir):
    boxes = detections_of(spark, sf_dir).select("camera_name", "frame_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    boxes = boxes.selectExpr("camera_name", "frame_id", "struct(cast(100 + frame_id * 7 * k % 300 as double) as x1, cast(50 + frame_id * 5 * k % 200 as double) as y1, cast(100 + frame_id * 7 * k % 300 + 20 + frame_id * 3 * k % 90 as double) as x2, cast(50 + frame_id * 5 * k % 200 + 40 + frame_id * k % 70 as double) as y2) as box")
    return R.top_players(boxes).select("camera_name", "frame_id", "box.*", "player")


@query("SELECT camera_name, frame_id, ball_u, seq AS ingest_seq FROM (SELECT *, row_number() OVER (PARTITION BY camera_name, frame_id ORDER BY seq DESC) AS rk FROM (SELECT camera_name, frame_id // 2 AS frame_id, ball_u, frame_id AS seq FROM det)) WHERE rk = 1")
def last_of_frame(spark, sf_dir):
    twice = detections_of(spark, sf_dir).select("camera_name", F.floor(F.col("frame_id") / 2).alias("frame_id"), "ball_u", F.col("frame_id").alias("ingest_seq"))
    return R.last_of_frame(twice)


@query(f"SELECT camera_name, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY camera_name ORDER BY frame_id DESC) AS rk FROM det) WHERE rk <= {int(S.fps * S.overlap_s)}")
def overlap_tail(spark, sf_dir):
    return R.tail(detections_of(spark, sf_dir).select("camera_name", "frame_id"), int(S.fps * S.overlap_s))


@query("SELECT camera_name, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY camera_name ORDER BY frame_id) AS rk FROM det) WHERE rk <= 500")
def first_rows(spark, sf_dir):
    return R.head(detections_of(spark, sf_dir).select("camera_name", "frame_id"), 500)


@query("SELECT camera_name, CAST(i // 3 AS BIGINT) AS window, min(frame_id) AS first_frame, count(*) AS n, sum(ball_u) AS total FROM (SELECT *, row_number() OVER (PARTITION BY camera_name ORDER BY frame_id) - 1 AS i FROM det) GROUP BY 1, 2")
def tumbling_triples(spark, sf_dir):
    return R.tumbling(detections_of(spark, sf_dir), "ball_u").select("camera_name", "window", "first_frame", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT camera_name, frame_id, coalesce(lag(ball_u, 2) OVER w, first_value(ball_u) OVER w) AS a, coalesce(lag(ball_u) OVER w, first_value(ball_u) OVER w) AS b, ball_u AS c FROM det WINDOW w AS (PARTITION BY camera_name ORDER BY frame_id)")
def sliding_triples(spark, sf_dir):
    return R.sliding(detections_of(spark, sf_dir), "ball_u").select("camera_name", "frame_id", *[F.get("values", F.lit(k)).alias(n) for k, n in enumerate("abc")])


_HEAT = "SELECT camera_name, frame_id, cell, CAST((frame_id * 31 + cell * 17) % 101 - 60 AS DOUBLE) / 10 AS logit FROM {0}, (SELECT CAST(unnest(generate_series(0, 11)) AS INTEGER) AS cell)"


@query(f"SELECT camera_name, frame_id, CAST(CASE WHEN conf >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS detected, CASE WHEN conf >= 0.5 THEN (cell % 4) * 480.0::DOUBLE END AS ball_u, CASE WHEN conf >= 0.5 THEN (cell // 4) * 360.0::DOUBLE END AS ball_v, round(conf, 9) AS ball_conf FROM (SELECT camera_name, frame_id, cell, 1 / (1 + exp(-logit)) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY camera_name, frame_id ORDER BY logit DESC, cell) AS rk FROM ({_HEAT.format('det')})) WHERE rk = 1)")
def heat_peaks(spark, sf_dir):
    heat = detections_of(spark, sf_dir).select("camera_name", "frame_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("cell"))
    heat = heat.selectExpr("camera_name", "frame_id", "cell", "cast((frame_id * 31 + cell * 17) % 101 - 60 as double) / 10 as logit")
    return R.from_heat(R.heat_peak(heat), 4, 3, 1920, 1080, 0.5).withColumn("ball_conf", F.round("ball_conf", 9))


_BUF = "SELECT camera_name, count(*) AS n_rows, CAST(max(frame_id) FILTER (true) - max(frame_id) FILTER (detected = 1) AS DOUBLE) / 25 AS quiet_s, CAST(max(frame_id) AS DOUBLE) / 25 AS since_flush_s FROM det GROUP BY 1"


@query(f"SELECT min(n_rows) >= 200 AS enough, coalesce(bool_and(quiet_s >= 10) FILTER (quiet_s IS NOT NULL), false) AS all_quiet, max(since_flush_s) >= 300 AS overdue, min(n_rows) >= 200 AND (coalesce(bool_and(quiet_s >= 10) FILTER (quiet_s IS NOT NULL), false) OR max(since_flush_s) >= 300) AS flush FROM ({_BUF})")
def flush_decision(spark, sf_dir):
    last = F.max("frame_id")
    buffers = detections_of(spark, sf_dir).groupBy("camera_name").agg(F.count("*").alias("n_rows"), ((last - F.max(F.when(F.col("detected") == 1, F.col("frame_id")))).cast("double") / 25).alias("quiet_s"), (last.cast("double") / 25).alias("since_flush_s"))
    return R.flush_decision(buffers)


_CLICKS = "SELECT camera_name, fps, v_max_ms, court_width_m, list(ball_u ORDER BY frame_id) AS u, list(ball_v ORDER BY frame_id) AS v FROM (SELECT *, row_number() OVER (PARTITION BY camera_name, frame_id // 40 ORDER BY ball_v, ball_u, frame_id) AS k, frame_id // 40 AS session FROM det WHERE detected = 1) JOIN cams USING (camera_name) WHERE k <= 4 GROUP BY camera_name, session, fps, v_max_ms, court_width_m HAVING count(*) = 4"
_ENDS = "SELECT camera_name, fps, v_max_ms, court_width_m, (v[1] + v[2]) / 2 AS y_far, abs(u[2] - u[1]) AS px_width_far, (v[3] + v[4]) / 2 AS y_near, abs(u[4] - u[3]) AS px_width_near FROM clicks"
_ALPHA = "k * ((px_width_near - px_width_far) / nullif(y_near - y_far, 0))"


@query(f"SELECT camera_name, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('y_far', 'px_width_far', 'y_near', 'px_width_near'))}, round(avg({_ALPHA}), 6) AS alpha, round(avg(k * px_width_far - {_ALPHA} * y_far), 6) AS beta FROM (SELECT *, v_max_ms / (fps * court_width_m) AS k FROM ({_ENDS.replace('clicks', f'({_CLICKS})')})) GROUP BY 1")
def calibration(spark, sf_dir):
    """Four clicks a session, taken from the table: of each stretch of 40 frames the four highest places. Means over a camera's sessions."""
    w = Window.partitionBy("camera_name", "session").orderBy("ball_v", "ball_u", "frame_id")
    seen = detections_of(spark, sf_dir).filter("detected = 1").withColumn("session", F.floor(F.col("frame_id") / 40))
    clicks = seen.withColumn("k", F.row_number().over(w)).filter("k <= 4").select("camera_name", "session", F.col("frame_id").alias("click_no"), F.col("ball_u").alias("u"), F.col("ball_v").alias("v"))
    out = G.calibrated(clicks, T.cameras(spark), ["session"])
    values = ("y_far", "px_width_far", "y_near", "px_width_near", "alpha", "beta")
    return out.groupBy("camera_name").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in values])


#: A vector's components as bytes: three channels of an image of 8 by 8.
_BYTE = "pmod(cast(floor(x * {0}) as long), 256)"
_SMALL = replace(S, model_height=5, model_width=6, clock_mask=(0, 0, 2, 3))


def pictures_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small image of every embedding of 64 components: (camera_name, frame_id, height, width, image)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x) or abs(x) > 1e6)")
    pixel = ", ".join(_BYTE.format(k) for k in (400, 700, 1000))
    text = f"array_join(transform(flatten(transform(transform(embedding, x -> cast(x as double)), x -> array({pixel}))), b -> lpad(hex(b), 2, '0')), '')"
    return e.selectExpr("concat('cam', label) as camera_name", "vec_id as frame_id", "8 as height", "8 as width", f"unhex({text}) as image")


def _taps_sql(size: int, out: int, name: str) -> str:
    """The two neighbours of each place of a resized axis, and the part of the way."""
    at = f"least(greatest((o + 0.5::DOUBLE) * ({size}.0::DOUBLE / {out}) - 0.5::DOUBLE, 0), {size - 1})"
    return f"(SELECT o AS {name}, CAST(floor({at}) AS INTEGER) AS {name}0, least(CAST(floor({at}) AS INTEGER) + 1, {size - 1}) AS {name}1, {at} - floor({at}) AS f{name} FROM range({out}) r(o))"


def _pixel_sql(y: str, x: str) -> str:
    inside = f"{y} >= {_SMALL.clock_mask[2]} OR {x} >= {_SMALL.clock_mask[3]}"
    value = f"floor(CAST(embedding[{y} * 8 + {x} + 1] AS DOUBLE) * (400 + 300 * (2 - c)))"
    return f"CASE WHEN {inside} THEN CAST((CAST({value} AS BIGINT) % 256 + 256) % 256 AS DOUBLE) ELSE 0.0::DOUBLE END"


_ROW = lambda x: f"({_pixel_sql('y0', x)}) * (1 - fy) + ({_pixel_sql('y1', x)}) * fy"
_MEAN = ", ".join(f"{m}::DOUBLE" for m in _SMALL.image_mean)
_DEVIATION = ", ".join(f"{m}::DOUBLE" for m in _SMALL.image_std)


@query(
    f"""SELECT 'cam' || label AS camera_name, vec_id AS frame_id, c AS plane, y, x, round((round_even(({_ROW('x0')}) * (1 - fx) + ({_ROW('x1')}) * fx, 0) / 255 - [{_MEAN}][c + 1]) / [{_DEVIATION}][c + 1], 4) AS value
FROM embeddings, range(3) p(c), {_taps_sql(8, 5, 'y')}, {_taps_sql(8, 6, 'x')} WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR abs(e) > 1e6)) = 0""",
    False,
)
def frame_tensors(spark, sf_dir):
    tensors = N.tensors(pictures_of(spark, sf_dir), _SMALL)
    cells = tensors.select("camera_name", "frame_id", F.posexplode("tensor").alias("at", "value"))
    return cells.selectExpr("camera_name", "frame_id", "cast(at div 30 as long) as plane", "cast(at % 30 div 6 as long) as y", "cast(at % 6 as long) as x", "round(cast(value as double), 4) as value")


@query("SELECT 'cam' || label AS camera_name, vec_id AS frame_id, 8 AS height, 8 AS width, 192::BIGINT AS n_bytes, CAST((CAST(floor(CAST(embedding[64] AS DOUBLE) * 1000) AS BIGINT) % 256 + 256) % 256 AS BIGINT) AS last_byte FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR abs(e) > 1e6)) = 0 AND label IN (1, 2) AND vec_id >= 100", False)
def frames_by_number(spark, sf_dir):
    """All images are stored; those of two cameras from a number on are read back, by filters that reach the scan."""
    path = fresh_path(spark, "frames")
    I.write_frames(pictures_of(spark, sf_dir), path)
    found = I.read_frames(spark, path).filter(F.col("camera_name").isin("cam1", "cam2") & (F.col("frame_id") >= 100))
    return found.select("camera_name", "frame_id", "height", "width", F.length("image").cast("long").alias("n_bytes"), F.conv(F.hex(F.substring("image", -1, 1)), 16, 10).cast("long").alias("last_byte"))


@query(f"SELECT camera_name, frame_id, CASE WHEN conf >= {S.conf_thr} THEN 1 ELSE 0 END AS detected, CASE WHEN conf >= {S.conf_thr} THEN b END AS ball_u, CASE WHEN conf >= {S.conf_thr} THEN most END AS ball_v, conf AS ball_conf FROM (SELECT *, max(b) OVER (PARTITION BY camera_name, frame_id // 3) AS most, b / 255 AS conf FROM (SELECT camera_name, frame_id, CAST((frame_id * 37 + 11) % 256 AS DOUBLE) AS b FROM det))")
def detected_windows(spark, sf_dir):
    """A stand-in model sees three frames at a time: a frame's brightness, and the most of its window."""

    def model(images):
        most = float(max(i[0] for i in images))
        return [(float(i[0]), most, i[0] / 255) for i in images]

    images = detections_of(spark, sf_dir).selectExpr("camera_name", "frame_id", "unhex(lpad(hex((frame_id * 37 + 11) % 256), 2, '0')) as image")
    return live.detect_balls(images, model)


@query("SELECT camera_name, frame_id, detected, ball_u, ball_v, CASE WHEN frame_id % 3 = 2 THEN 0.0::DOUBLE ELSE ball_conf END AS ball_conf FROM det")
def csv_by_headers(spark, sf_dir):
    """Detections written as CSV files of three headers, one without confidences, and read back as one folder."""
    path, det = fresh_path(spark, "csv"), detections_of(spark, sf_dir).select(*BALLS)
    orders = (BALLS, BALLS[::-1], ("ball_v", "frame_id", "camera_name", "detected", "ball_u"))
    for k, columns in enumerate(orders):
        det.filter(F.col("frame_id") % 3 == k).select(*columns).write.mode("append").option("header", True).csv(path)
    return T.read_detections_csv(spark, path).select(*BALLS)


@query("SELECT label, 'uploads/cal_' || label || '.json' AS path, count(*) AS n, bool_or(stream) AS stream FROM (SELECT regexp_extract('out/x/' || camera_name || '_video_' || event_id || '.mp4', '([^/_]*)_[^/]*$', 1) AS label, lower('RTSP://h/' || camera_name) LIKE 'rtsp://%' AS stream FROM ev) GROUP BY 1", True)
def labels_of_files(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CASE WHEN user_id % 4 < 2 THEN 'cam1' ELSE 'cam2' END AS camera_name")
    label = T.camera_label(F.concat(F.lit("out/x/"), F.col("camera_name"), F.lit("_video_"), F.col("event_id").cast("string"), F.lit(".mp4")))
    e = e.select(label.alias("label"), T.is_stream(F.concat(F.lit("RTSP://h/"), F.col("camera_name"))).alias("stream"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.bool_or("stream").alias("stream")).select("label", T.calibration_path(F.col("label")).alias("path"), "n", "stream")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events", False)
def iso_times(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", G.iso_seconds(F.col("ts")).alias("iso"))
    return e.withColumn("seconds", F.unix_seconds(G.parse_iso(F.col("iso"))))


_KNOWN = {f"{p}_{j}" for p in ("p0", "p1") for j in ("ls", "rs")}


def _joint(c: str) -> str:
    known = c.rsplit("_", 1)[0] in _KNOWN
    return f"{'NULL::DOUBLE' if not known else '0.87654::DOUBLE' if c.endswith('conf') else f'{c} / 3'} AS {c}"


_JOINTS_SQL = ", ".join(_joint(c) for c, _ in T.JOINT_COLUMNS)
_ROUNDED = ", ".join(f"{r(c, 4 if c.endswith('conf') else 2)} AS {c}" for c, _ in T.JOINT_COLUMNS)
_BOXES = ", ".join(f"{r(f'CASE WHEN frame_id % 2 = 0 THEN frame_id * {k + 1} / 7.0::DOUBLE END', 1)} AS {c}" for k, (c, _) in enumerate(T.BOX_COLUMNS))


@query(f"SELECT camera_name, frame_id, detected, CASE WHEN detected = 1 THEN {r('ball_u / 7', 2)} END AS ball_u, CASE WHEN detected = 1 THEN {r('ball_v / 7', 2)} END AS ball_v, {r('ball_conf / 3', 4)} AS ball_conf, {_ROUNDED}, {_BOXES} FROM (SELECT camera_name, frame_id, detected, ball_u, ball_v, ball_conf, {_JOINTS_SQL} FROM det)")
def flattened_frames(spark, sf_dir):
    joint = lambda p, j: f"named_struct('u', {p}_{j}_u / 3, 'v', {p}_{j}_v / 3, 'conf', cast(0.87654 as double))"
    none = "cast(null as struct<u:double,v:double,conf:double>)"
    box = lambda k: "if(frame_id % 2 = 0, named_struct(" + ", ".join(f"'{x}', frame_id * {k + i} / cast(7 as double)" for i, x in enumerate(("x1", "y1", "x2", "y2"), 1)) + "), null)"
    player = lambda p, k: f"named_struct('ls', {joint(p, 'ls')}, 'rs', {joint(p, 'rs')}, 'le', {none}, 're', {none}, 'lw', {none}, 'rw', {none}, 'bbox', {box(k)})"
    nested = detections_of(spark, sf_dir).selectExpr("camera_name", "frame_id", "named_struct('detected', detected = 1, 'u', ball_u / 7, 'v', ball_v / 7, 'conf', ball_conf / 3) as ball", f"array({player('p0', 0)}, {player('p1', 4)}) as players")
    return T.flatten_frames(nested)


_SEEN = f"detected = 1 AND ball_conf >= {S.conf_thr}"


@query(f"SELECT camera_name, frame_id, CASE WHEN {_SEEN} THEN 1 ELSE 0 END AS detected, CASE WHEN {_SEEN} THEN ball_u END AS ball_u, CASE WHEN {_SEEN} THEN ball_v END AS ball_v, ball_conf FROM det")
def detection_gate(spark, sf_dir):
    return R.gated(detections_of(spark, sf_dir).select(*BALLS))
