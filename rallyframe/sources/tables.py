"""Schemas and readers: detections from CSV, rows or the events table; calibration, homography, cameras."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import rounded
from ..operators.windows import carried
from ..settings import JOINTS, PLAYERS

BALL = [("frame_id", "bigint"), ("detected", "int"), ("ball_u", "double"), ("ball_v", "double"), ("ball_conf", "double")]
JOINT_COLUMNS = [(f"{p}_{j}_{x}", "double") for p in PLAYERS for j in JOINTS for x in ("u", "v", "conf")]
BOX_COLUMNS = [(f"{p}_b{x}", "double") for p in PLAYERS for x in ("x1", "y1", "x2", "y2")]


def ddl(columns: Iterable[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns)


DETECTIONS = ddl([("camera_name", "string"), *BALL, *JOINT_COLUMNS, *BOX_COLUMNS])
KEYPOINTS = "struct<" + ",".join(f"{j}:struct<u:double,v:double,conf:double>" for j in JOINTS) + ",bbox:struct<x1:double,y1:double,x2:double,y2:double>>"
FRAME_RESULTS = f"camera_name string, frame_id bigint, ball struct<detected:boolean,u:double,v:double,conf:double>, players array<{KEYPOINTS}>"


#: Kinds of header that a folder may have; each is a scan of its files.
MOST_HEADERS = 200


def header_groups(spark: SparkSession, path: str, must_have: str = "frame_id") -> list[tuple[list[str], list[str]]]:
    """(column names, files) of each kind of header among the CSV files of a path: one scan as text, a row a file.

    The header is a file's first line that isn't blank; it names the column `must_have`. A file whose first line doesn't raises an error, as rows can't
    be told from it; files without any line are left out.
    """
    # A line's place is where its block starts, then its order within that; a task keeps one line a file.
    at = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at")
    lines = spark.read.text(path).select("value", "_metadata.file_path", at).filter("trim(value) <> ''")
    first = lines.groupBy("file_path").agg(F.min_by("value", "at").alias("header"))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("files")).orderBy("header").limit(MOST_HEADERS + 1).collect()
    if len(groups) > MOST_HEADERS:
        raise ValueError(f"{path} has more than {MOST_HEADERS} kinds of header")
    out = []
    for row in groups:
        names = [c.strip().strip('"') for c in row.header.lstrip("\ufeff").split(",")]
        if must_have not in names:
            raise ValueError(f"{row.files[0]} has no header with {must_have}: {row.header:.80}")
        if len({c.lower() for c in names}) < len(names):
            raise ValueError(f"{row.files[0]} names a column twice: {row.header:.80}")
        out.append((names, row.files))
    return out


def read_detections_csv(spark: SparkSession, path: str, camera: str | None = None, columns: str | None = None) -> DataFrame:
    """Detections of CSV files with their fixed schema; columns a file lacks are null, and blanks and values of another type too.

    Files may have their columns in any order, and other columns too, which are kept as text: files of one header are one scan, and
    scans are put together by name. A folder without rows gives an empty table.
    """
    schema = columns or DETECTIONS
    known = dict(x.split(" ", 1) for x in schema.split(", "))
    out = None
    for have, files in header_groups(spark, path):
        raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in have])).option("header", True).csv(files)
        casts = [F.col(f"`{c}`").try_cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in have]
        part = with_defaults(complete(raw.select(*casts), schema, camera))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return with_defaults(complete(spark.createDataFrame([], schema), schema, camera)) if out is None else out


def complete(df: DataFrame, columns: str = DETECTIONS, camera: str | None = None) -> DataFrame:
    """All columns of the schema, in its order, missing ones as nulls; then whatever else df has."""
    if camera is not None:
        df = df.withColumn("camera_name", F.lit(camera))
    known = [tuple(x.split(" ", 1)) for x in columns.split(", ")]
    names = {n for n, _ in known}
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in known], *[c for c in df.columns if c not in names])


def with_defaults(df: DataFrame) -> DataFrame:
    """Null detected is 0, null confidence 0.0, and NaN is null."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})
    return df.withColumns({"detected": F.coalesce(F.col("detected").cast("int"), F.lit(0)), "ball_conf": F.coalesce("ball_conf", F.lit(0.0))})


def rows_to_detections(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Live row dicts, whose keys may be absent; no rows give an empty table with all columns."""
    names = [x.split(" ", 1)[0] for x in DETECTIONS.split(", ")]
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], DETECTIONS).schema}
    fix = {T.DoubleType: float, T.LongType: int, T.IntegerType: int, T.StringType: str}

    def value(row: dict, n: str):
        x = row.get(n)
        return None if x is None or isinstance(x, float) and math.isnan(x) else fix[type(kinds[n])](x)

    return with_defaults(spark.createDataFrame([tuple(value(r, n) for n in names) for r in rows], DETECTIONS))


def flatten_frames(frames: DataFrame) -> DataFrame:
    """Nested frame results as detections, rounded as they are written: 2 places, confidences 4, boxes 1.

    Absent joints are null. A ball that isn't detected has no place.
    """

    seen = F.coalesce(F.col("ball.detected"), F.lit(False))
    cols = [F.col("camera_name"), F.col("frame_id"), seen.cast("int").alias("detected"), *[F.when(seen, rounded(F.col(f"ball.{x}"), 2)).alias(f"ball_{x}") for x in ("u", "v")], F.coalesce(rounded(F.col("ball.conf"), 4), F.lit(0.0)).alias("ball_conf")]
    for k, p in enumerate(PLAYERS):
        player = F.get("players", F.lit(k))
        cols += [rounded(player[j][x], 4 if x == "conf" else 2).alias(f"{p}_{j}_{x}") for j in JOINTS for x in ("u", "v", "conf")]
        cols += [rounded(player["bbox"][x], 1).alias(f"{p}_b{x}") for x in ("x1", "y1", "x2", "y2")]
    return frames.select(*cols)


def events_to_detections(events: DataFrame) -> DataFrame:
    """A synthetic ball track and two players' shoulders from the events table, by integer arithmetic.

    Two cameras; one starts 7 frames late. There are misses, low confidences, jumps and still phases.
    """
    camera = F.when(F.col("user_id") % 4 < 2, "cam1").otherwise("cam2")
    e = events.select("event_id", camera.alias("camera_name"), "event_type", "value", "user_id")
    e = carried(e, ["camera_name"], ["event_id"], number="rn")
    still = "rn % 400 >= 380"
    return e.selectExpr(
        "camera_name",
        "rn + CASE WHEN camera_name = 'cam2' THEN 7 ELSE 0 END AS frame_id",
        "CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 0 ELSE 1 END AS detected",
        f"CAST(CASE WHEN {still} THEN 900 ELSE 900 + 4 * abs((rn * 2) % 120 - 60) + CASE WHEN value > 160 THEN 600 ELSE 0 END + user_id % 5 END AS DOUBLE) AS ball_u",
        f"CAST(CASE WHEN {still} THEN 500 ELSE 90 + 6 * abs(rn % 160 - 80) + user_id % 7 + CASE WHEN value > 220 THEN 700 ELSE 0 END END AS DOUBLE) AS ball_v",
        "CASE WHEN value < 2 THEN CAST(0.3 AS DOUBLE) ELSE (90 - user_id % 10) / CAST(100 AS DOUBLE) END AS ball_conf",
        "CAST(CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 13 = 0 THEN 0 ELSE 500 + (rn * 3) % 200 END AS DOUBLE) AS p0_ls_u",
        "CAST(CASE WHEN user_id % 11 = 0 THEN NULL ELSE 700 + rn % 50 END AS DOUBLE) AS p0_ls_v",
        "CAST(CASE WHEN user_id % 13 = 0 THEN 0 ELSE 540 + (rn * 3) % 200 END AS DOUBLE) AS p0_rs_u",
        "CAST(702 + rn % 50 AS DOUBLE) AS p0_rs_v",
        "CAST(CASE WHEN user_id % 17 = 0 THEN 12 ELSE 800 - (rn * 2) % 150 END AS DOUBLE) AS p1_ls_u",
        "CAST(200 + rn % 30 + CASE WHEN user_id % 19 = 0 THEN 600 ELSE 0 END AS DOUBLE) AS p1_ls_v",
        "CAST(835 - (rn * 2) % 150 AS DOUBLE) AS p1_rs_u",
        "CAST(CASE WHEN user_id % 23 = 0 THEN NULL ELSE 201 + rn % 30 END AS DOUBLE) AS p1_rs_v",
    )


CAMERA = "camera_name string, serial string, y_net double, y_far double, px_width_far double, y_near double, px_width_near double, alpha double, beta double, fps double, v_max_ms double, court_width_m double, h array<double>"
#: Two cameras that go with the synthetic track: the far baseline at v = 90, the near one at v = 570.
DEMO_CAMERAS = [
    ("cam1", "SN-1", 330.0, 90.0, 400.0, 570.0, 900.0, 0.05, 30.0, 25.0, 55.6, 10.97, [0.0105, 0.0002, -4.2, 0.0004, 0.047, -3.9, 0.00001, 0.0002, 1.0]),
    ("cam2", "SN-2", 300.0, 95.0, 410.0, 580.0, 880.0, 0.06, 28.0, 25.0, 55.6, 10.97, [0.0098, -0.0001, -3.8, 0.0001, 0.049, -4.1, -0.00002, 0.00015, 1.0]),
]


def cameras(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The camera dimension: calibration and the image-to-court matrix, row by row; null where unknown."""
    return spark.createDataFrame(DEMO_CAMERAS if rows is None else rows, CAMERA)


CALIBRATION = "y_far double, px_width_far double, y_near double, px_width_near double, alpha double, beta double, fps double, v_max_ms double, court_width_m double, clicks_px array<array<double>>"


def read_calibration(spark: SparkSession, path: str | None, alpha: float | None = None, beta: float | None = None) -> DataFrame:
    """One row: given alpha and beta win over the file, the file over none (all null).

    A file without the keys that speeds need raises.
    """
    kinds = [tuple(x.split(" ", 1)) for x in CALIBRATION.split(", ")]
    if alpha is not None and beta is not None:
        return spark.createDataFrame([(alpha, beta)], "alpha double, beta double").transform(complete, CALIBRATION)
    found = None if path is None else read_json(spark, path, CALIBRATION)
    if found is None:
        return spark.createDataFrame([tuple(None for _ in kinds)], CALIBRATION)
    need = [F.col(c) for c in ("alpha", "beta", "y_far", "y_near", "fps")]
    ok = need[0].isNotNull()
    for c in need[1:]:
        ok &= c.isNotNull()
    return found.withColumn("alpha", F.when(ok, F.col("alpha")).otherwise(F.raise_error(F.lit(f"{path} lacks a key"))))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON document as rows of the schema; None if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_homography(spark: SparkSession, path: str) -> DataFrame:
    """(camera_name, h): the nine numbers of each camera's image-to-court matrix, row by row."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", "map<string, struct<H_image_to_world: array<array<double>>>>").alias("m"))
    return parsed.select(F.explode("m").alias("camera_name", "x")).select("camera_name", F.flatten("x.H_image_to_world").alias("h")).filter(F.size("h") == 9)


def read_cameras(spark: SparkSession, registry: list[tuple], folder: str, homography: str) -> DataFrame:
    """The camera dimension from files. registry: (camera_name, serial, y_net); folder: cal_<camera>.json of each.

    A camera without a calibration file, or without a matrix, has nulls there.
    """
    own = spark.createDataFrame(registry, "camera_name string, serial string, y_net double")
    found = read_json(spark, f"{folder}/cal_*.json", CALIBRATION)
    known = [c.split(" ")[0] for c in CALIBRATION.split(", ")]
    if found is None:
        found = spark.createDataFrame([], f"camera_name string, {CALIBRATION}")
    else:
        found = found.select(F.regexp_extract(F.input_file_name(), r"cal_([^/]*)\.json$", 1).alias("camera_name"), *known)
    out = own.join(found, "camera_name", "left").join(read_homography(spark, homography), "camera_name", "left")
    return out.select(*[c.split(" ")[0] for c in CAMERA.split(", ")])


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of these columns that df has."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise ValueError(f"none of {', '.join(names)} is a column")


def named_as_usual(df: DataFrame) -> DataFrame:
    """df with frame_id, interp_u and interp_v, from the other names that they may have."""
    return df.withColumns({"frame_id": first_of(df, "frame_id", "frame").cast("long"), "interp_u": first_of(df, "interp_u", "x").cast("double"), "interp_v": first_of(df, "interp_v", "y").cast("double")})


#: Places of the joints among the 17 of a pose model, from 0.
POSE_JOINTS = {"ls": 5, "rs": 6, "le": 7, "re": 8, "lw": 9, "rw": 10}


def joints_of(points: Column) -> Column:
    """The six joints of a pose of 17 points, array<struct<u, v, conf>>; null where the model gave none."""
    return F.struct(*[F.get(points, F.lit(POSE_JOINTS[j])).alias(j) for j in JOINTS])


def of_cameras(df: DataFrame, labels: Iterable[str] | None) -> DataFrame:
    """Rows of the named cameras; of all, if none is named."""
    return df if not labels else df.filter(F.col("camera_name").isin(*labels))


def as_text(df: DataFrame) -> DataFrame:
    """Detections as they are written to text: fixed decimals, 2 for places, 4 for confidences, 1 for boxes; null is empty."""
    places = {"ball_u": 2, "ball_v": 2, "ball_conf": 4} | {c: 4 if c.endswith("conf") else 2 for c, _ in JOINT_COLUMNS} | {c: 1 for c, _ in BOX_COLUMNS}
    return df.withColumns({c: F.when(F.col(c).isNull(), "").otherwise(F.format_string(f"%.{n}f", F.col(c))) for c, n in places.items() if c in df.columns})


def nested_yaml(text: str) -> dict:
    """Mappings by indentation, with numbers, truth values and strings as leaves; no lists."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        body = re.match(r"""(?:[^'"#]|'[^']*'|"[^"]*"|(?<=\S)#|['"])*""", line)[0].rstrip()  # up to a comment
        if not body.strip():
            continue
        depth = len(body) - len(body.lstrip())
        name, colon, value = body.strip().partition(":")
        if not colon or name.startswith("-"):
            raise ValueError(f"only mappings are read: {line!r}")
        while stack[-1][0] >= depth:
            stack.pop()
        value = value.strip()
        if value:
            quoted = value[0] in "'\"" and value[-1] == value[0]
            stack[-1][1][name] = value[1:-1] if quoted else plain(value)
        else:
            stack[-1][1][name] = {}
            stack.append((depth, stack[-1][1][name]))
    return root


def plain(value: str):
    if value.lower() in ("true", "false", "null", "~"):
        return {"true": True, "false": False}.get(value.lower())
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def load_config(path: str) -> dict:
    """Settings from JSON or YAML mappings. A blank home is the file's folder; a relative one starts there."""
    with open(path) as f:
        text = f.read()
    try:
        found = json.loads(text)
    except ValueError:
        found = nested_yaml(text)
    base = os.path.dirname(os.path.abspath(path))
    home = os.path.normpath(os.path.join(base, found.get("home") or "."))
    return found | {"home": home}


def in_home(config: dict, path: str) -> str:
    return os.path.normpath(os.path.join(config["home"], path))


def resolve_source(override: str | None, force_local: bool, stream: str | None, local: str | None, probe) -> tuple[str, bool]:
    """(address, whether it is a stream): the override, else the stream if it answers, else the local file."""
    if override:
        return override, override.lower().startswith("rtsp://")
    if not force_local and stream and probe(stream):
        return stream, True
    if local and os.path.exists(local):
        return local, False
    raise FileNotFoundError(local or "no local file is configured")


def probe_stream(url: str, timeout: float = 5.0) -> bool:
    """Whether a stream's server answers within the timeout; a probe for resolve_source."""
    import socket
    from urllib.parse import urlsplit

    at = urlsplit(url)
    try:
        with socket.create_connection((at.hostname, at.port or 554), timeout) as s:
            s.settimeout(timeout)
            s.sendall(f"OPTIONS {at.scheme}://{at.hostname}{at.path} RTSP/1.0\r\nCSeq: 1\r\n\r\n".encode())
            return s.recv(64).startswith(b"RTSP/")
    except OSError:
        return False


def camera_label(path: Column) -> Column:
    """The file name's stem up to its first underscore."""
    return F.substring_index(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""), "_", 1)


def calibration_path(label: Column, folder: str = "uploads") -> Column:
    return F.concat(F.lit(f"{folder}/cal_"), label, F.lit(".json"))


def is_stream(url: Column) -> Column:
    return F.lower(url).startswith("rtsp://")


def video_frames(spark: SparkSession, path: str, decode, schema: str = "camera_name string, frame_id bigint, image binary") -> DataFrame:
    """Frames of video files. decode(path) yields (frame_id, image bytes); it is a plug-in, and opens the file itself.

    Only paths are listed and dealt out, a file a task, so files may be of any size.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for file in pdf["path"]:
                label = os.path.splitext(os.path.basename(file))[0].split("_")[0]
                part = []
                for frame_id, image in decode(file):
                    part.append((label, frame_id, image))
                    if len(part) >= 64:
                        yield pd.DataFrame(part, columns=["camera_name", "frame_id", "image"])
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=["camera_name", "frame_id", "image"])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(max(1, files.count()), "path").mapInPandas(run, schema)
