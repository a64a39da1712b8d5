"""Queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from rallyframe import catalogue

#: A spread over all stages; the driver compares the rest too.
SOME = ("detections", "r1_low_conf", "r345_pass1", "interpolate", "clean_summary", "rule_pivot", "dense_spine", "ffill_bfill", "sync_offset", "motion_valid", "crossings", "rally_report", "player_places", "payload_digest", "payload_tracks", "payload_hits", "payload_players", "flattened_frames", "detection_gate", "iso_times", "signal_to_noise", "disambiguate", "compare_joints", "top2_dedup", "heat_peaks", "flush_decision", "calibration", "csv_by_headers", "frame_tensors", "frames_by_number", "detected_windows")


def norm(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


def rows(names, columns, found):
    return sorted((tuple(norm(dict(zip(columns, x, strict=True))[n]) for n in names) for x in found), key=repr)


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in ("events", "documents", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, sf_dir, db, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    r = db.sql(catalogue.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(r.columns)
    assert rows(names, df.columns, df.collect()) == rows(names, r.columns, r.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
