"""The queries' rows in SQL for DuckDB: a chain of common table expressions, stage by stage."""

from __future__ import annotations

from .settings import DEFAULTS as S
from .sources.tables import DEMO_CAMERAS


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]"
    return f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE"


def r(x: str, places: int) -> str:
    scale = f"{10**places}.0::DOUBLE"
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


STAGES: dict[str, str] = {}
STAGES["cams"] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in DEMO_CAMERAS) + ") t(camera_name, serial, y_net, y_far, px_width_far, y_near, px_width_near, alpha, beta, fps, v_max_ms, court_width_m, h)"
STAGES["ev"] = "SELECT event_id, CASE WHEN user_id % 4 < 2 THEN 'cam1' ELSE 'cam2' END AS camera_name, event_type, value, user_id FROM events"
STAGES["en"] = "SELECT camera_name, CAST(row_number() OVER (PARTITION BY camera_name ORDER BY event_id) - 1 AS BIGINT) AS rn, event_type, value, user_id FROM ev"
STAGES["det"] = """SELECT camera_name, rn + CASE WHEN camera_name='cam2' THEN 7 ELSE 0 END AS frame_id,
 CAST(CASE WHEN event_type='error' AND user_id % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS detected,
 CAST(CASE WHEN rn % 400 >= 380 THEN 900 ELSE 900 + 4*abs((rn*2) % 120 - 60) + CASE WHEN value > 160 THEN 600 ELSE 0 END + user_id % 5 END AS DOUBLE) AS ball_u,
 CAST(CASE WHEN rn % 400 >= 380 THEN 500 ELSE 90 + 6*abs(rn % 160 - 80) + user_id % 7 + CASE WHEN value > 220 THEN 700 ELSE 0 END END AS DOUBLE) AS ball_v,
 CASE WHEN value < 2 THEN CAST(0.3 AS DOUBLE) ELSE (90 - user_id % 10) / CAST(100 AS DOUBLE) END AS ball_conf,
 CAST(CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 13 = 0 THEN 0 ELSE 500 + (rn * 3) % 200 END AS DOUBLE) AS p0_ls_u,
 CAST(CASE WHEN user_id % 11 = 0 THEN NULL ELSE 700 + rn % 50 END AS DOUBLE) AS p0_ls_v,
 CAST(CASE WHEN user_id % 13 = 0 THEN 0 ELSE 540 + (rn * 3) % 200 END AS DOUBLE) AS p0_rs_u,
 CAST(702 + rn % 50 AS DOUBLE) AS p0_rs_v,
 CAST(CASE WHEN user_id % 17 = 0 THEN 12 ELSE 800 - (rn * 2) % 150 END AS DOUBLE) AS p1_ls_u,
 CAST(200 + rn % 30 + CASE WHEN user_id % 19 = 0 THEN 600 ELSE 0 END AS DOUBLE) AS p1_ls_v,
 CAST(835 - (rn * 2) % 150 AS DOUBLE) AS p1_rs_u,
 CAST(CASE WHEN user_id % 23 = 0 THEN NULL ELSE 201 + rn % 30 END AS DOUBLE) AS p1_rs_v FROM en"""
BALL = "camera_name, frame_id, detected, ball_u, ball_v, ball_conf"
STAGES["r1"] = f"SELECT {BALL}, CASE WHEN detected = 1 AND ball_conf < {S.conf_thr} AND coalesce(max(ball_conf) OVER (PARTITION BY camera_name), 0) <= 1.5 THEN 'low_conf' ELSE '' END AS rule FROM det"
STAGES["f0"] = f"SELECT {BALL}, CASE WHEN detected = 1 AND rule = '' AND NOT coalesce(ball_u BETWEEN {S.u_min} AND {S.u_max} AND ball_v BETWEEN {S.v_min} AND {S.v_max}, false) THEN 'out_of_bounds' ELSE rule END AS rule FROM r1"
ALIVE = "(detected = 1 AND rule = '')"


def window(name: str = "w", more: str = "") -> str:
    return f"WINDOW {name} AS (PARTITION BY camera_name, {ALIVE} ORDER BY frame_id){more}"


def speed_pass(before: str) -> str:
    hyp = lambda a, b: f"sqrt(({a})*({a}) + ({b})*({b}))"
    ia, ib, oa, ob = "ball_u - pu", "ball_v - pv", "qu - ball_u", "qv - ball_v"
    return f"""SELECT {BALL}, CASE WHEN NOT alive THEN rule
 WHEN s_in > snap AND s_out > snap AND (CASE WHEN {hyp(ia, ib)} < 1e-9 OR {hyp(oa, ob)} < 1e-9 THEN 0.0 ELSE (({ia})*({oa}) + ({ib})*({ob})) / nullif({hyp(ia, ib)} * {hyp(oa, ob)}, 0) END) <= {S.snap_cos} THEN 'snap_back'
 WHEN s_in > iso AND s_out > iso THEN 'speed_spike'
 WHEN pf IS NOT NULL AND qf IS NOT NULL AND {hyp(ia, ib)} > iso AND {hyp(oa, ob)} > iso THEN 'spatial_isolation' ELSE rule END AS rule
 FROM (SELECT *, coalesce({hyp(ia, ib)} / greatest(frame_id - pf, 1), 0.0) AS s_in, coalesce({hyp(oa, ob)} / greatest(qf - frame_id, 1), 0.0) AS s_out,
  greatest({S.floor_px}::DOUBLE, alpha * ball_v + beta) * {S.snap_mult}::DOUBLE AS snap, greatest({S.floor_px}::DOUBLE, alpha * ball_v + beta) * {S.iso_mult}::DOUBLE AS iso
  FROM (SELECT {BALL}, rule, {ALIVE} AS alive, lag(frame_id) OVER w AS pf, lag(ball_u) OVER w AS pu, lag(ball_v) OVER w AS pv, lead(frame_id) OVER w AS qf, lead(ball_u) OVER w AS qu, lead(ball_v) OVER w AS qv FROM {before} {window()}) JOIN (SELECT camera_name, alpha, beta FROM cams) USING (camera_name))"""


for _k in range(1, S.passes + 1):
    STAGES[f"f{_k}"] = speed_pass(f"f{_k - 1}")
LAST = f"f{S.passes}"


def runs(before: str, start: str, inner: str, rule: str, hit: str, more: str = "") -> str:
    """Flags runs of survivors: `inner` adds columns, a run starts where `start` holds, `hit` looks at its length n."""
    return f"""SELECT {BALL}, CASE WHEN alive AND {hit} THEN '{rule}' ELSE rule END AS rule FROM (
 SELECT *, count(*) OVER (PARTITION BY camera_name, alive, run) AS n, max(run) OVER (PARTITION BY camera_name, alive) AS last FROM (
 SELECT *, sum(CASE WHEN coalesce({start}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY camera_name, alive ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS run FROM (
 SELECT {BALL}, rule, {ALIVE} AS alive, {inner} FROM {before} {more} {window()})))"""


STAGES["st"] = runs(LAST, f"sqrt(du*du + dv*dv) >= {S.static_px}", "ball_u - lag(ball_u) OVER w AS du, ball_v - lag(ball_v) OVER w AS dv", "static_cluster", f"n >= {S.static_len}")
STAGES["sg"] = runs("st", f"df > {S.seg_gap}", "frame_id - lag(frame_id) OVER w AS df", "short_segment", f"n < {S.seg_len}")
STAGES["ct"] = f"""SELECT {BALL}, CASE WHEN alive AND dt < {S.cross_frames} AND dv >= reach THEN 'crossing_time' ELSE rule END AS rule FROM (
 SELECT {BALL}, rule, {ALIVE} AS alive, frame_id - lag(frame_id) OVER w AS dt, abs(ball_v - lag(ball_v) OVER w) AS dv, abs(y_near - y_far) * {S.cross_part}::DOUBLE AS reach FROM sg JOIN (SELECT camera_name, y_near, y_far FROM cams) USING (camera_name) {window()})"""
STAGES["hc"] = runs("ct", "near <> before", "ball_v > y_net AS near, lag(ball_v > y_net) OVER w AS before", "half_court_excursion", f"run > 1 AND run < last AND n < {S.half_court_len}", "JOIN (SELECT camera_name, y_net FROM cams) USING (camera_name)")
STAGES["sv"] = "SELECT *, row_number() OVER (PARTITION BY camera_name ORDER BY frame_id) AS pos, lead(ball_v) OVER (PARTITION BY camera_name ORDER BY frame_id) AS nv, count(*) OVER (PARTITION BY camera_name) AS n FROM hc WHERE detected = 1 AND rule = ''"
STAGES["jp"] = f"SELECT camera_name, pos, ball_v AS va, nv AS vb FROM sv WHERE n >= 4 AND abs(ball_v - nv) >= {S.path_px}"
STAGES["jn"] = f"SELECT a.camera_name, a.pos, min(b.pos) AS nxt FROM jp a LEFT JOIN jp b ON a.camera_name = b.camera_name AND b.pos >= a.pos + {S.path_window} GROUP BY 1, 2"
STAGES["jw"] = "SELECT camera_name, min(pos) AS pos FROM jp GROUP BY 1 UNION ALL SELECT jw.camera_name, jn.nxt FROM jw JOIN jn ON jw.camera_name = jn.camera_name AND jw.pos = jn.pos WHERE jn.nxt IS NOT NULL"
STAGES["jm"] = f"SELECT jw.camera_name, jw.pos AS j, sv.frame_id, sv.ball_conf, abs(sv.ball_v - jp.va) <= abs(sv.ball_v - jp.vb) AS first FROM jw JOIN jp USING (camera_name, pos) JOIN sv ON sv.camera_name = jw.camera_name AND sv.pos >= jw.pos AND sv.pos < jw.pos + {S.path_window}"
STAGES["jl"] = "SELECT jm.camera_name, jm.frame_id FROM jm JOIN (SELECT camera_name, j, avg(ball_conf) FILTER (first) >= avg(ball_conf) FILTER (NOT first) AS a_wins FROM jm GROUP BY 1, 2) x USING (camera_name, j) WHERE first <> a_wins"
STAGES["lp"] = f"SELECT {BALL}, CASE WHEN rule = '' AND detected = 1 AND (camera_name, frame_id) IN (SELECT (camera_name, frame_id) FROM jl) THEN 'low_conf_path' ELSE rule END AS rule FROM hc"
STAGES["cv"] = f"SELECT {BALL}, rule, rule <> '' AS is_outlier, CASE WHEN {ALIVE} THEN ball_u END AS clean_u, CASE WHEN {ALIVE} THEN ball_v END AS clean_v FROM lp"


def interpolated(before: str) -> str:
    p, q = "(ORDER BY frame_id ROWS UNBOUNDED PRECEDING)", "(ORDER BY frame_id DESC ROWS UNBOUNDED PRECEDING)"
    ends = ", ".join(f"last_value(CASE WHEN clean_u IS NOT NULL THEN {c} END IGNORE NULLS) OVER {w.replace('(', '(PARTITION BY camera_name ')} AS {n}{x}" for n, w in (("p", p), ("q", q)) for c, x in (("frame_id", "f"), ("clean_u", "u"), ("clean_v", "v")))
    line = lambda x: f"CASE WHEN fill THEN p{x} + ((frame_id - pf) / nullif(qf - pf, 0)) * (q{x} - p{x}) ELSE clean_{x} END"
    return f"""SELECT {BALL}, rule AS outlier_rule, is_outlier, clean_u, clean_v, {r(line("u"), 2)} AS interp_u, {r(line("v"), 2)} AS interp_v, fill AS was_interpolated FROM (
 SELECT *, clean_u IS NULL AND pf IS NOT NULL AND qf IS NOT NULL AND coalesce(qf - pf - 1 <= {S.fill_gap}, false) AS fill FROM (SELECT *, {ends} FROM {before}))"""


STAGES["it"] = interpolated("cv")
# Alignment.
STAGES["nf"] = "SELECT coalesce(max(frame_id), -1) + 1 AS n FROM it"
STAGES["ds"] = "SELECT c.camera_name, CAST(g.f AS BIGINT) AS frame_id FROM (SELECT DISTINCT camera_name FROM it) c, (SELECT unnest(generate_series(0, (SELECT n FROM nf) - 1)) AS f) g"
STAGES["sig"] = "SELECT camera_name, frame_id, coalesce(sqrt(du*du + dv*dv), 0.0) AS accel FROM (SELECT camera_name, frame_id, (lead(u) OVER w - u) - (u - lag(u) OVER w) AS du, (lead(v) OVER w - v) - (v - lag(v) OVER w) AS dv FROM (SELECT ds.camera_name, ds.frame_id, interp_u AS u, interp_v AS v FROM ds LEFT JOIN (SELECT * FROM it WHERE interp_u IS NOT NULL) k USING (camera_name, frame_id)) WINDOW w AS (PARTITION BY camera_name ORDER BY frame_id))"
STAGES["zs"] = "SELECT camera_name, frame_id, accel, CASE WHEN s < 1e-9 THEN accel - m ELSE (accel - m) / s END AS z FROM (SELECT *, avg(accel) OVER (PARTITION BY camera_name) AS m, stddev_pop(accel) OVER (PARTITION BY camera_name) AS s FROM sig)"
STAGES["corr"] = f"SELECT l.lag, sum(a.z * b.z) AS corr FROM (SELECT CAST(unnest(generate_series(-{S.max_lag}, {S.max_lag})) AS INTEGER) AS lag) l, zs a, zs b WHERE a.camera_name = 'cam1' AND b.camera_name = 'cam2' AND b.frame_id = a.frame_id - l.lag GROUP BY l.lag"
STAGES["tau"] = "SELECT lag AS tau, corr AS peak FROM corr ORDER BY corr DESC, lag LIMIT 1"
# Motion.
STAGES["rx"] = "SELECT *, CAST(row_number() OVER (PARTITION BY camera_name ORDER BY frame_id) - 1 AS BIGINT) AS row_idx FROM it"


def by_rows(x: str) -> str:
    return f"coalesce(interp_{x}, CASE WHEN row_idx - pi{x} <= {S.motion_limit} THEN coalesce(p{x} + (q{x} - p{x}) / nullif(qi{x} - pi{x}, 0) * (row_idx - pi{x}), p{x}) END) AS interp_{x}"


_ends = ", ".join(f"last_value(CASE WHEN interp_{x} IS NOT NULL THEN {c} END IGNORE NULLS) OVER (PARTITION BY camera_name ORDER BY frame_id {d} ROWS UNBOUNDED PRECEDING) AS {n}{y}" for x in "uv" for n, d in (("p", ""), ("q", "DESC")) for c, y in (("row_idx", f"i{x}"), (f"interp_{x}", x)))
STAGES["fl"] = f"SELECT camera_name, frame_id, row_idx, frame_id / {S.fps}::DOUBLE AS time, {by_rows('u')}, {by_rows('v')} FROM (SELECT *, {_ends} FROM rx)"
STAGES["vp"] = "SELECT *, interp_u IS NULL AS missing, sqrt(du*du + dv*dv) AS v_px FROM (SELECT *, coalesce(interp_u - lag(interp_u) OVER w, 0.0) AS du, coalesce(interp_v - lag(interp_v) OVER w, 0.0) AS dv FROM fl WINDOW w AS (PARTITION BY camera_name ORDER BY frame_id))"
STAGES["mr"] = f"SELECT *, sum(CASE WHEN coalesce(missing <> lag_m, true) THEN 1 ELSE 0 END) OVER w AS mrun, sum(CASE WHEN coalesce(slow <> lag_s, true) THEN 1 ELSE 0 END) OVER w AS srun FROM (SELECT *, v_px < {S.slow_px} AS slow, lag(missing) OVER w AS lag_m, lag(v_px < {S.slow_px}) OVER w AS lag_s FROM vp WINDOW w AS (PARTITION BY camera_name ORDER BY frame_id)) WINDOW w AS (PARTITION BY camera_name ORDER BY frame_id ROWS UNBOUNDED PRECEDING)"
STAGES["mv"] = f"SELECT camera_name, frame_id, row_idx, time, interp_u, interp_v, v_px, NOT ((missing AND mn > {S.silence_rows}) OR (slow AND sn > {S.slow_rows}) OR missing) AS is_valid FROM (SELECT *, count(*) OVER (PARTITION BY camera_name, mrun) AS mn, count(*) OVER (PARTITION BY camera_name, srun) AS sn FROM mr)"
STAGES["tr"] = f"SELECT camera_name, CAST(row_number() OVER (PARTITION BY camera_name ORDER BY start_frame) AS INTEGER) AS rally_id, start_frame, end_frame, rally_start, rally_end FROM (SELECT camera_name, run, count(*) AS n, min(frame_id) AS start_frame, max(frame_id) AS end_frame, min(time) AS rally_start, max(time) AS rally_end FROM (SELECT *, sum(CASE WHEN coalesce(is_valid <> was, true) THEN 1 ELSE 0 END) OVER (PARTITION BY camera_name ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(is_valid) OVER (PARTITION BY camera_name ORDER BY frame_id) AS was FROM mv)) WHERE is_valid GROUP BY 1, 2) WHERE n >= {S.rally_rows}"
# Crossings and rallies.
STAGES["xv"] = "SELECT camera_name, frame_id, row_idx, interp_v AS v, y_net FROM mv JOIN (SELECT camera_name, y_net FROM cams) USING (camera_name) WHERE interp_v IS NOT NULL"
STAGES["xc"] = f"SELECT camera_name, frame_id, row_idx FROM (SELECT *, lag(v) OVER w > y_net AND row_idx - lag(row_idx) OVER w <= {S.cross_gap} AND v < y_net AND lead(v) OVER w < y_net AND lead(row_idx) OVER w < row_idx + {S.debounce} AS hit FROM xv WINDOW w AS (PARTITION BY camera_name ORDER BY row_idx)) WHERE hit"
STAGES["xn"] = f"SELECT a.camera_name, a.frame_id, min(b.frame_id) AS nxt FROM xc a LEFT JOIN xc b ON a.camera_name = b.camera_name AND b.frame_id >= a.frame_id + {S.debounce} GROUP BY 1, 2"
STAGES["xw"] = "SELECT camera_name, min(frame_id) AS frame_id FROM xc GROUP BY 1 UNION ALL SELECT xw.camera_name, xn.nxt FROM xw JOIN xn ON xw.camera_name = xn.camera_name AND xw.frame_id = xn.frame_id WHERE xn.nxt IS NOT NULL"
STAGES["cr"] = "SELECT camera_name, frame_id, row_idx FROM xc WHERE (camera_name, frame_id) IN (SELECT (camera_name, frame_id) FROM xw)"
STAGES["rg"] = f"SELECT camera_name, rally_id, min(frame_id) - {int(S.before_s * S.fps)} AS a, max(frame_id) + {int(S.after_s * S.fps)} AS b FROM (SELECT *, sum(CASE WHEN coalesce(frame_id - was > {int(S.rally_gap_s * S.fps)}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY camera_name ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS rally_id FROM (SELECT *, lag(frame_id) OVER (PARTITION BY camera_name ORDER BY frame_id) AS was FROM cr)) GROUP BY 1, 2"
STAGES["ri"] = "SELECT rg.camera_name, rally_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame FROM rg JOIN mv ON mv.camera_name = rg.camera_name AND frame_id BETWEEN a AND b GROUP BY 1, 2"
STAGES["ra"] = f"SELECT camera_name, rally_id, start_frame, end_frame, {r(f'start_frame / {S.fps}::DOUBLE', 3)} AS rally_start, {r(f'end_frame / {S.fps}::DOUBLE', 3)} AS rally_end FROM (SELECT camera_name, CAST(rally_id AS INTEGER) AS rally_id, CAST(CASE WHEN prev >= start_frame THEN (prev + start_frame) // 2 + 1 ELSE start_frame END AS BIGINT) AS start_frame, CAST(CASE WHEN end_frame >= nxt THEN (end_frame + nxt) // 2 ELSE end_frame END AS BIGINT) AS end_frame FROM (SELECT *, lead(start_frame) OVER w AS nxt, lag(end_frame) OVER w AS prev FROM ri WINDOW w AS (PARTITION BY camera_name ORDER BY rally_id)))"
STAGES["fr"] = "SELECT mv.*, x.rally_id FROM mv LEFT JOIN ra x ON x.camera_name = mv.camera_name AND mv.frame_id BETWEEN x.start_frame AND x.end_frame"
# Players and speeds.
_vis = lambda p: f"coalesce({p}_ls_u > 20 AND {p}_rs_u > 20, false)"
_height = lambda p: f"coalesce(({p}_ls_v + {p}_rs_v) / 2, {p}_ls_v, {p}_rs_v)"
_world = lambda u, v, x: f"((h[{3 * x + 1}] * ({u}) + h[{3 * x + 2}] * ({v}) + h[{3 * x + 3}]) / CASE WHEN abs(h[7] * ({u}) + h[8] * ({v}) + h[9]) >= 1e-10 THEN h[7] * ({u}) + h[8] * ({v}) + h[9] END)"
_place = lambda p, x: f"CASE WHEN {p}_ls_u >= 5 AND {p}_rs_u >= 5 AND {p}_ls_v IS NOT NULL AND {p}_rs_v IS NOT NULL THEN {_world(f'({p}_ls_u + {p}_rs_u) / 2', f'({p}_ls_v + {p}_rs_v) / 2', x)} END"
STAGES["pl"] = f"""SELECT d.*, h, CASE WHEN NOT {_vis("p0")} AND NOT {_vis("p1")} THEN NULL WHEN NOT {_vis("p0")} THEN 'p1' WHEN NOT {_vis("p1")} THEN 'p0'
 WHEN {_height("p0")} IS NULL AND {_height("p1")} IS NULL THEN NULL WHEN {_height("p0")} IS NULL THEN 'p1' WHEN {_height("p1")} IS NULL THEN 'p0' WHEN {_height("p0")} > {_height("p1")} THEN 'p0' ELSE 'p1' END AS near,
 {_place("p0", 0)} AS p0_x, {_place("p0", 1)} AS p0_y, {_place("p1", 0)} AS p1_x, {_place("p1", 1)} AS p1_y FROM det d JOIN (SELECT camera_name, h FROM cams) USING (camera_name)"""
STAGES["lo"] = f"""SELECT f.*, near, CASE near WHEN 'p0' THEN 'p1' WHEN 'p1' THEN 'p0' END AS far, {_world("interp_u", "interp_v", 0)} AS ball_x, {_world("interp_u", "interp_v", 1)} AS ball_y, p0_x, p0_y, p1_x, p1_y,
 CASE near WHEN 'p0' THEN p0_x WHEN 'p1' THEN p1_x END AS near_x, CASE near WHEN 'p0' THEN p0_y WHEN 'p1' THEN p1_y END AS near_y, CASE near WHEN 'p0' THEN p1_x WHEN 'p1' THEN p0_x END AS far_x, CASE near WHEN 'p0' THEN p1_y WHEN 'p1' THEN p0_y END AS far_y FROM fr f JOIN pl USING (camera_name, frame_id)"""
_w30 = f"OVER (PARTITION BY camera_name ORDER BY row_idx ROWS BETWEEN {S.lookback} PRECEDING AND 1 PRECEDING)"
STAGES["s0"] = f"SELECT *, sqrt((ball_x - bx)*(ball_x - bx) + (ball_y - by_)*(ball_y - by_)) * {S.fps}::DOUBLE * 3.6::DOUBLE / greatest(row_idx - bi, 1) / {S.net_correction}::DOUBLE AS raw FROM (SELECT *, last_value(CASE WHEN ball_x IS NOT NULL THEN ball_x END IGNORE NULLS) {_w30} AS bx, last_value(CASE WHEN ball_x IS NOT NULL THEN ball_y END IGNORE NULLS) {_w30} AS by_, last_value(CASE WHEN ball_x IS NOT NULL THEN row_idx END IGNORE NULLS) {_w30} AS bi FROM lo)"
_bent = f"least(CASE WHEN raw > {S.speed_knee} THEN {S.speed_knee}::DOUBLE + (raw - {S.speed_knee}::DOUBLE) * {S.speed_slope}::DOUBLE ELSE raw END, {S.speed_cap}::DOUBLE)"
STAGES["sp"] = f"SELECT * EXCLUDE (bx, by_, bi, raw), coalesce(CASE WHEN raw IS NOT NULL AND {_bent} >= {S.speed_least} THEN {_bent} END, 0.0) AS ball_kmh FROM s0"
STAGES["ht"] = f"SELECT camera_name, frame_id AS frame, {r(f'frame_id / {S.fps}::DOUBLE', 3)} AS time_s, rally_id, {r('ball_kmh', 1)} AS speed_kmh, coalesce(near, 'unknown') AS near_player, ball_kmh FROM sp WHERE rally_id IS NOT NULL AND (camera_name, frame_id) IN (SELECT (camera_name, frame_id) FROM cr)"


def moved(p: str, was: str) -> str:
    d = f"sqrt(({p}_x - {was}_x)*({p}_x - {was}_x) + ({p}_y - {was}_y)*({p}_y - {was}_y))"
    return f"coalesce(CASE WHEN {d} > {S.move_least} AND {d} < {S.move_most} THEN {d} END, 0.0)"


_wr = "(PARTITION BY camera_name, rally_id ORDER BY frame_id)"
STAGES["mw"] = "SELECT *, " + ", ".join(f"lag({p}_{c}) OVER {_wr} AS w{p}_{c}" for p in ("near", "far") for c in "xy") + ", " + ", ".join(f"last_value({p}_{c} IGNORE NULLS) OVER (PARTITION BY camera_name, rally_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w{p}_{c}" for p in ("p0", "p1") for c in "xy") + " FROM sp"
STAGES["mo"] = f"SELECT *, {moved('near', 'wnear')} AS near_m, {moved('far', 'wfar')} AS far_m, CASE WHEN rally_id IS NULL THEN 0.0 ELSE {moved('p0', 'wp0')} END AS p0_m, CASE WHEN rally_id IS NULL THEN 0.0 ELSE {moved('p1', 'wp1')} END AS p1_m FROM mw"
STAGES["ps"] = f"SELECT camera_name, rally_id, role, {r('d', 2)} AS total_distance, {r(f'd / (n / {S.fps}::DOUBLE)', 3)} AS avg_move_speed, {r(f'm * {S.fps}::DOUBLE', 3)} AS max_move_speed FROM (SELECT camera_name, rally_id, role, sum(m) AS d, max(m) AS m, count(*) AS n FROM (SELECT camera_name, rally_id, 'near' AS role, near_m AS m FROM mo UNION ALL SELECT camera_name, rally_id, 'far', far_m FROM mo) WHERE rally_id IS NOT NULL GROUP BY 1, 2, 3)"
STAGES["rs"] = f"SELECT ra.camera_name, ra.rally_id, start_frame, end_frame, rally_start AS rally_start_s, rally_end AS rally_end_s, {r('rally_end - rally_start', 3)} AS duration_s, CAST(coalesce(n, 0) AS INTEGER) AS shots, {r('coalesce(d, 0.0)', 2)} AS dist_m FROM ra LEFT JOIN (SELECT camera_name, rally_id, count(*) AS n FROM ht GROUP BY 1, 2) USING (camera_name, rally_id) LEFT JOIN (SELECT camera_name, rally_id, sum(p0_m + p1_m) AS d FROM mo WHERE rally_id IS NOT NULL GROUP BY 1, 2) USING (camera_name, rally_id)"
STAGES["bs"] = f"SELECT ra.camera_name, ra.rally_id, CAST(coalesce(n, 0) AS INTEGER) AS total_shots, {r('coalesce(a, 0.0)', 1)} AS avg_ball_speed, {r('coalesce(m, 0.0)', 1)} AS max_ball_speed FROM ra LEFT JOIN (SELECT camera_name, rally_id, count(*) AS n, avg(ball_kmh) AS a, max(ball_kmh) AS m FROM ht GROUP BY 1, 2) USING (camera_name, rally_id)"


def sql(select: str) -> str:
    """The chain up to the last stage that `select` needs, and select."""
    import re

    need: set[str] = set()

    def add(text: str) -> None:
        for name in STAGES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                add(STAGES[name])

    add(select)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in STAGES.items() if n in need) + "\n" + select
