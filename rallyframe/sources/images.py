"""Stored frame images that are read by number: segment files of images, and an index of where each frame lies.

A segment holds images one after the other. The index is a Parquet table, a row a frame, sorted by camera and frame, so that the
statistics of its row groups tell where a frame can be. The source takes filters on camera and frame into the scan: row groups that
can't match are never planned, the others are read in tasks, and of segments only the wanted ranges, neighbours in one read. A point
read opens one row group and one segment, at one place.

At scale: writing is one pass; images are never shuffled, only their index rows are. The driver sees the footers of the index, not its rows;
a task reads one row group of it, of about ROWS frames, and holds one range of images, of MOST bytes or one image, at a time. A segment is named by the index
only once its task succeeded, so what a lost task left behind is never read.

Defined cases: a null image is a frame without bytes, and comes back null; of frames stored twice both come back; a camera or frame
that isn't there gives no row; null keys are stored, and only met without a filter; an empty table gives an empty store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

INDEX = "camera_name string, frame_id bigint, height int, width int, segment string, at bigint, length bigint"
FRAMES = "camera_name string, frame_id bigint, height int, width int, image binary"
#: Bytes of a read, and of a segment; frames of a row group of the index.
MOST, SEGMENT, ROWS = 8 << 20, 1 << 30, 20_000
KEYS = ("camera_name", "frame_id")


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_frames(frames: DataFrame, path: str, index_files: int = 8) -> None:
    """Stores frames (camera_name, frame_id, height, width, image) in a new folder that driver and executors share."""

    def segments(batches):
        import pandas as pd

        system, root = _place(path)
        system.create_dir(f"{root}/segments", recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            rows = []
            for camera, frame, height, width, image in batch.itertuples(index=False, name=None):
                if out is None or at >= SEGMENT:
                    if out is not None:
                        out.close()
                    name, at = uuid.uuid4().hex, 0
                    out = system.open_output_stream(f"{root}/segments/{name}")
                rows.append((camera, frame, height, width, name, at, -1 if image is None else len(image)))
                if image is not None:
                    out.write(image)
                    at += len(image)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"frame_id": "Int64", "height": "Int32", "width": "Int32"})
        if out is not None:
            out.close()

    index = frames.selectExpr("camera_name", "cast(frame_id as bigint) as frame_id", "cast(height as int) as height", "cast(width as int) as width", "image").mapInPandas(segments, INDEX)
    # The segments are written once: sampling for the ranges must not write them again.
    index.write.parquet(f"{path}/unsorted")
    spark = frames.sparkSession
    ranged = spark.read.schema(INDEX).parquet(f"{path}/unsorted").repartitionByRange(index_files, *KEYS).sortWithinPartitions(*KEYS)
    # A group of rows ends by its size: some 50 bytes of index a frame.
    ranged.write.option("parquet.block.size", 50 * ROWS).option("parquet.block.size.row.check.min", 100).option("parquet.block.size.row.check.max", ROWS).parquet(f"{path}/index")


class FrameStore(DataSource):
    """Stored frames; option path: the folder of write_frames."""

    @classmethod
    def name(cls) -> str:
        return "court_images"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema):
        return FrameStoreReader(self.options["path"])


class Group(InputPartition):
    """A row group of an index file, and the filters on it."""

    def __init__(self, file: str, group: int, wanted: list):
        self.file, self.group, self.wanted = file, group, wanted


TESTS = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}


class FrameStoreReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if type(f) in TESTS and f.attribute in [(k,) for k in KEYS]:
                self.wanted.append((f.attribute[0], TESTS[type(f)], f.value if not isinstance(f, In) else sorted(v for v in f.value if v is not None)))
            else:
                yield f

    @staticmethod
    def _can_match(low, high, test: str, value) -> bool:
        if low is None or high is None:
            return True
        if test == "in":
            return any(low <= v <= high for v in value)
        return {"==": low <= value <= high, ">": high > value, ">=": high >= value, "<": low < value, "<=": low <= value}[test]

    def partitions(self):
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = _place(self.path)
        out = []
        for info in sorted(system.get_file_info(fs.FileSelector(f"{root}/index")), key=lambda i: i.path):
            if not info.base_name.endswith(".parquet"):
                continue
            with system.open_input_file(info.path) as f:
                about = pq.ParquetFile(f).metadata
            for g in range(about.num_row_groups):
                stats = {c.path_in_schema: c.statistics for c in (about.row_group(g).column(k) for k in range(len(KEYS)))}
                ends = {k: (s.min, s.max) if s is not None and s.has_min_max else (None, None) for k, s in stats.items()}
                if all(self._can_match(*ends[c], test, value) for c, test, value in self.wanted):
                    out.append(Group(info.path, g, self.wanted))
        return out

    def read(self, partition):
        import operator

        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        if partition is None:  # so Spark reads where nothing is planned
            return
        system, root = _place(self.path)
        with system.open_input_file(partition.file) as f:
            rows = pq.ParquetFile(f).read_row_group(partition.group)
        compare = {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}
        for column, test, value in partition.wanted:
            hit = pc.is_in(rows[column], pa.array(value, rows[column].type)) if test == "in" else compare[test](rows[column], value)
            rows = rows.filter(hit)
        held: list[tuple] = []
        for row in sorted(rows.to_pylist(), key=operator.itemgetter("segment", "at")):
            end = held[-1]["at"] + max(0, held[-1]["length"]) if held else 0
            if held and (row["segment"] != held[0]["segment"] or row["at"] != end or end + row["length"] - held[0]["at"] > MOST):
                yield from self._images(system, root, held)
                held = []
            held.append(row)
        if held:
            yield from self._images(system, root, held)

    @staticmethod
    def _images(system, root: str, rows: list[dict]):
        """Images that lie one after the other, in one read."""
        start = rows[0]["at"]
        with system.open_input_file(f"{root}/segments/{rows[0]['segment']}") as f:
            held = f.read_at(sum(max(0, r["length"]) for r in rows), start)
        for r in rows:
            at = r["at"] - start
            yield r["camera_name"], r["frame_id"], r["height"], r["width"], held[at : at + r["length"]] if r["length"] >= 0 else None


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Stored frames; filters on camera and frame reach the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameStore)
    return spark.read.format("court_images").option("path", path).load()
