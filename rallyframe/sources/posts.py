"""Posting payloads as a transactional sink, for batches and streams.

A payload is posted under a key, its camera and first frame. As soon as the receiver has it, a receipt, a small file named by the
key, says so; a payload with a receipt isn't posted again, so a task, a write or a stream's batch that is repeated posts only what
is left. What a task has posted is its commit message; when all tasks are done the commit writes them to the ledger, a folder of
Parquet (camera_name, start_frame), as one file, a stream's under the batch's number, so a repeated batch writes the same file again. A write
that fails leaves no entry in the ledger, but its receipts: what was posted was posted.

A task that is lost after the receiver's answer and before the receipt posts that one payload again, under the same key, by which the
receiver can tell. Of tasks that run twice at a time both may: speculative execution should be off.

Defined cases: without a sender nothing is posted, and all counts as sent; a sender that raises, or answers with another status than
200, 201 and 204, leaves that payload for the next write; a null payload is posted as an empty text; a null camera or frame is part
of a key as the word null; nothing to post is a commit without entries.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

log = logging.getLogger(__name__)
POST = "camera_name string, start_frame bigint, payload string"
DONE = (200, 201, 204)


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Posted(WriterCommitMessage):
    """What a task found posted, by itself or before: (camera_name, start_frame)."""

    keys: list[tuple[str | None, int | None]]


class PostSink(DataSource):
    """Options: ledger, a folder that driver and executors share; sender, as packed by packed_sender()."""

    @classmethod
    def name(cls) -> str:
        return "court_posts"

    def schema(self) -> str:
        return POST

    def writer(self, schema, overwrite):
        return PostWriter(self.options["ledger"], self.options.get("sender"))

    def streamWriter(self, schema, overwrite):  # noqa: N802
        return PostStreamWriter(self.options["ledger"], self.options.get("sender"))


class _Writing:
    def __init__(self, ledger: str, sender: str | None):
        self.ledger, self.sender = ledger, sender

    def write(self, iterator: Iterator) -> Posted:
        from pyspark import cloudpickle

        sender = cloudpickle.loads(bytes.fromhex(self.sender)) if self.sender else lambda text, key: DONE[0]
        system, root = _place(self.ledger)
        system.create_dir(f"{root}/_receipts", recursive=True)
        keys = []
        for row in iterator:
            camera, frame = row["camera_name"], row["start_frame"]
            key = f"{'null' if camera is None else camera}-{'null' if frame is None else frame}"
            receipt = f"{root}/_receipts/{quote(key, safe='')}"
            if not system.get_file_info(receipt).is_file:
                try:
                    if sender(row["payload"] or "", key) not in DONE:
                        continue
                except Exception as error:  # noqa: BLE001  a failed post is left for the next write, not the end of this one
                    log.warning("%s wasn't posted: %s", key, error)
                    continue
                with system.open_output_stream(receipt) as f:
                    f.write(json.dumps({"camera_name": camera, "start_frame": frame}).encode())
            keys.append((camera, frame))
        return Posted(keys)

    def _list(self, messages: list, name: str) -> None:
        """One file of the ledger, in place as a whole or not at all."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        keys = sorted({k for m in messages if m is not None for k in m.keys}, key=repr)
        if not keys:
            return
        system, root = _place(self.ledger)
        system.create_dir(root, recursive=True)
        table = pa.table([pa.array([c for c, _ in keys], pa.string()), pa.array([f for _, f in keys], pa.int64())], ["camera_name", "start_frame"])
        unfinished = f"{root}/_{uuid.uuid4().hex}"
        with system.open_output_stream(unfinished) as f:
            pq.write_table(table, f)
        system.move(unfinished, f"{root}/{name}.parquet")


class PostWriter(_Writing, DataSourceWriter):
    def commit(self, messages) -> None:
        self._list(messages, f"write-{uuid.uuid4().hex}")

    def abort(self, messages) -> None:
        log.warning("a write of posts failed; %s payloads of its finished tasks were posted", sum(len(m.keys) for m in messages if m is not None))


class PostStreamWriter(_Writing, DataSourceStreamWriter):
    def commit(self, messages, batchId) -> None:  # noqa: N803
        self._list(messages, f"batch-{batchId}")

    def abort(self, messages, batchId) -> None:  # noqa: N803
        log.warning("batch %s of posts failed; %s payloads of its finished tasks were posted", batchId, sum(len(m.keys) for m in messages if m is not None))


def packed_sender(sender: Callable[[str, str], int]) -> str:
    """A sender as the text of an option: options of a sink are texts."""
    from pyspark import cloudpickle

    return cloudpickle.dumps(sender).hex()


def _options(ledger: str, sender: Callable[[str, str], int] | None) -> dict[str, str]:
    return {"ledger": ledger} | ({"sender": packed_sender(sender)} if sender else {})


def write_posts(payloads: DataFrame, ledger: str, sender: Callable[[str, str], int] | None = None) -> None:
    """Posts the payloads (camera_name, start_frame, payload) that have no receipt, and lists those that were sent."""
    payloads.sparkSession.dataSource.register(PostSink)
    payloads.select("camera_name", "start_frame", "payload").write.format("court_posts").options(**_options(ledger, sender)).mode("append").save()


def stream_posts(payloads: DataFrame, ledger: str, checkpoint: str, sender: Callable[[str, str], int] | None = None, available_now: bool = True):
    """A query that posts a stream of payloads."""
    payloads.sparkSession.dataSource.register(PostSink)
    writer = payloads.select("camera_name", "start_frame", "payload").writeStream.format("court_posts").options(**_options(ledger, sender)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()
