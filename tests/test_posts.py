"""The sink of posts: failed and repeated tasks, writes and batches each post once."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from rallyframe.sources import posts


def receiver(folder, bad=()):
    """A fake receiver: each post is a file, numbered by how often its key came."""
    os.makedirs(folder, exist_ok=True)

    def send(text, key):
        if key in bad:
            raise OSError("no answer")
        n = len([f for f in os.listdir(folder) if f.startswith(f"{key}.")])
        with open(f"{folder}/{key}.{n}", "w") as f:
            f.write(text)
        return 204

    return send


def payloads(spark, n, parts=3):
    return spark.range(n).selectExpr("'a' as camera_name", "id * 10 as start_frame", "concat('{', id, '}') as payload", "1 as other").repartitionByRange(parts, "start_frame")


def listed(spark, ledger):
    return sorted(r.start_frame for r in spark.read.parquet(ledger).collect())


def test_a_write_that_fails_posts_nothing_twice(spark, tmp_path):
    ledger, got = str(tmp_path / "ledger"), str(tmp_path / "got")
    boom = F.when(F.col("start_frame") == 80, F.raise_error(F.lit("lost"))).otherwise(F.col("payload"))
    with pytest.raises(Exception, match="lost"):
        posts.write_posts(payloads(spark, 12).withColumn("payload", boom), ledger, receiver(got))
    before = set(os.listdir(got))
    assert before and not [f for f in os.listdir(ledger) if f.endswith(".parquet")]
    posts.write_posts(payloads(spark, 12), ledger, receiver(got))
    assert sorted(os.listdir(got)) == sorted(f"a-{10 * k}.0" for k in range(12)) and listed(spark, ledger) == [10 * k for k in range(12)]
    assert open(f"{got}/a-70.0").read() == "{7}"


def test_a_task_that_is_repeated_posts_nothing_twice(tmp_path):
    ledger, got = str(tmp_path / "ledger"), str(tmp_path / "got")
    writer = posts.PostWriter(ledger, posts.packed_sender(receiver(got, bad=("a-20",))))
    rows = [{"camera_name": "a", "start_frame": k, "payload": None} for k in (10, 20)] + [{"camera_name": None, "start_frame": None, "payload": "x"}]
    first, second = writer.write(iter(rows)), writer.write(iter(rows))
    assert first.keys == second.keys == [("a", 10), (None, None)]
    assert sorted(os.listdir(got)) == ["a-10.0", "null-null.0"]
    writer.commit([first, None, second])
    assert len([f for f in os.listdir(ledger) if f.endswith(".parquet")]) == 1


def test_a_batch_of_a_stream_that_is_repeated_posts_nothing_twice(spark, tmp_path):
    ledger, got, state = (str(tmp_path / x) for x in ("ledger", "got", "state"))
    payloads(spark, 6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("camera_name string, start_frame long, payload string").parquet(f"{tmp_path}/in")
    assert posts.stream_posts(stream, ledger, state, receiver(got, bad=("a-50",))).awaitTermination(60)
    assert listed(spark, ledger) == [0, 10, 20, 30, 40]
    # The batch's commit is lost: it runs again, and the receiver answers now.
    shutil.rmtree(f"{state}/commits")
    os.mkdir(f"{state}/commits")
    assert posts.stream_posts(stream, ledger, state, receiver(got)).awaitTermination(60)
    assert sorted(os.listdir(got)) == sorted(f"a-{10 * k}.0" for k in range(6))
    assert [f for f in os.listdir(ledger) if f.endswith(".parquet")] == ["batch-0.parquet"] and listed(spark, ledger) == [10 * k for k in range(6)]


def test_a_dry_run_and_no_payloads(spark, tmp_path):
    posts.write_posts(payloads(spark, 0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or not [f for f in os.listdir(tmp_path / "none") if f.endswith(".parquet")]
    posts.write_posts(payloads(spark, 3), str(tmp_path / "dry"))
    assert listed(spark, str(tmp_path / "dry")) == [0, 10, 20]
