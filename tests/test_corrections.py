"""Outcomes that settle by a timer, with corrections before and after the delay."""

from datetime import datetime, timedelta

import pytest
from oddslake.streaming import corrections, live

SCHEMA = "match string, at timestamp, outcome string, other int"
T0 = datetime(2024, 5, 1, 12)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture
def run(spark, tmp_path):
    def play(*batches, late="0 seconds"):
        """The rows that come out of batches of (match, minute, outcome), one file a batch."""
        for k, rows in enumerate(batches):
            spark.createDataFrame([(m, None if t is None else at(t), o, k) for m, t, o in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/b0").schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
        out = corrections.settled_after(stream, "match", "at", "outcome", timedelta(minutes=30), late)
        name = f"settled_{abs(hash(str(tmp_path)))}"
        rows = live.run_available(out, f"{tmp_path}/checkpoint", name).collect()
        return sorted((r["match"], (r["at"] - T0).total_seconds() / 60, r["status"], r["outcome"], (r["since"] - T0).total_seconds() / 60) for r in rows)

    return play


def test_an_outcome_settles_when_the_watermark_reaches_its_time(run):
    assert run([("m", 0, "home")], [("x", 29, "a")], [("x", 31, "a")]) == [("m", 30, "settled", "home", 0)]


def test_a_correction_before_the_delay_settles_only_the_corrected_one(run):
    got = run([("m", 0, "home")], [("m", 20, "away")], [("x", 49, "a")], [("x", 51, "a")])
    assert got == [("m", 50, "settled", "away", 20)]


def test_a_correction_after_the_delay_withdraws_and_settles_again(run):
    got = run([("m", 0, "home")], [("x", 40, "a")], [("m", 45, "away")], [("x", 76, "a")])
    assert [r for r in got if r[0] == "m"] == [("m", 30, "settled", "home", 0), ("m", 45, "withdrawn", "home", 0), ("m", 75, "settled", "away", 45)]


def test_what_stands_in_one_batch_settles_as_it_would_in_many(run):
    rows = [("m", 0, "home"), ("m", 10, "home"), ("m", 30, "away"), ("m", 40, "home"), ("m", 75, "home"), ("m", None, "away"), ("m", 76, None)]
    got = run(rows, [("x", 200, "a")])
    assert [r for r in got if r[0] == "m"] == [("m", 30, "settled", "home", 0), ("m", 30, "withdrawn", "home", 0), ("m", 70, "settled", "home", 40)]


def test_late_readings_do_not_rewind(run):
    got = run([("m", 50, "home")], [("m", 40, "away")], [("x", 90, "a")], late="1 hour")
    assert got == []  # the watermark is an hour behind


def test_readings_out_of_order_within_the_watermark(run):
    got = run([("m", 50, "home")], [("m", 40, "away")], [("x", 141, "a")], late="1 hour")
    assert [r for r in got if r[0] == "m"] == [("m", 80, "settled", "home", 50)]
