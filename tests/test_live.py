"""Stateful streams over files that arrive one by one."""

from datetime import datetime, timedelta

import pytest
from oddslake.streaming import live
from pyspark.sql import functions as F

T0 = datetime(2024, 5, 1, 12)
SCHEMA = "k string, at timestamp, v string"


@pytest.fixture
def play(spark, tmp_path):
    def run(build, *batches, mode="append"):
        for n, rows in enumerate(batches):
            spark.createDataFrame([(k, T0 + timedelta(minutes=m), v) for k, m, v in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
        stream = live.event_stream(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/b0").schema, files_a_batch=1)
        return live.run_available(build(stream), f"{tmp_path}/checkpoint", f"live_{abs(hash(str(tmp_path)))}", mode).collect()

    return run


def minutes(x):
    return (x - T0).total_seconds() / 60


def test_late_rows_never_rewind_the_latest_state(play):
    rows = play(lambda s: live.latest_state(s, "k", "at", "v"), [("a", 5, "new")], [("a", 1, "old"), ("b", 2, "x")], mode="complete")
    assert sorted((r["k"], r["v"], minutes(r["at"])) for r in rows) == [("a", "new", 5), ("b", "x", 2)]


def test_changes_across_batches(play):
    rows = play(lambda s: live.changed_values(s, "k", "at", "v"), [("a", 2, "A"), ("a", 1, "A")], [("a", 3, "A"), ("a", 4, "B")], [("a", 2, "late"), ("a", 5, "A"), ("b", 1, "A")])
    assert sorted((r["k"], minutes(r["at"]), r["v"]) for r in rows) == [("a", 1, "A"), ("a", 4, "B"), ("a", 5, "A"), ("b", 1, "A")]


def test_content_is_kept_once(play):
    rows = play(lambda s: live.first_of_content(s.withColumn("sha", F.sha2("v", 256)), "at", "sha"), [("a", 0, "x"), ("b", 1, "y")], [("c", 2, "x"), ("d", 3, "z")])
    assert sorted(r["v"] for r in rows) == ["x", "y", "z"]


def test_windows_close_with_the_watermark(play):
    rows = play(lambda s: live.window_counts(s, "at", "10 minutes", "5 minutes"), [("a", 1, "x"), ("a", 2, "x")], [("a", 12, "x"), ("a", 9, "x")], [("a", 40, "x")], [("a", 41, "x")], [("a", 3, "too late")])
    assert sorted((minutes(r["since"]), r["n"]) for r in rows) == [(0, 3), (10, 1)]


def test_sliding_windows_and_budgets(play):
    rows = play(lambda s: live.over_budget(s, "at", "10 minutes", "0 minutes", 2), [("a", m, "x") for m in (1, 2, 3, 11, 12)], [("a", 60, "x")])
    assert [(minutes(r["since"]), r["n"]) for r in rows] == [(0, 3)]


def test_slides(play):
    rows = play(lambda s: live.window_counts(s, "at", "10 minutes", "0 minutes", "5 minutes"), [("a", 7, "x")], [("a", 60, "x")])
    assert sorted((minutes(r["since"]), r["n"]) for r in rows) == [(0, 1), (5, 1)]


def test_sessions_end_with_a_gap(play):
    rows = play(lambda s: live.sessions(s, "k", "at", "10 minutes", "0 minutes"), [("a", 0, "x"), ("b", 1, "x")], [("a", 9, "x")], [("a", 30, "x")], [("a", 90, "x")])
    assert sorted((r["k"], minutes(r["since"]), minutes(r["until"]), r["n"]) for r in rows) == [("a", 0, 19, 2), ("a", 30, 40, 1), ("b", 1, 11, 1)]


def test_upserts_by_batch(spark, play, tmp_path):
    write = live.upsert_batches(f"{tmp_path}/table", ["k"], "at")
    schema = "k string, at int, v string"
    write(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], schema), 0)
    for _ in range(2):  # a batch that runs again replaces its own output
        write(spark.createDataFrame([("a", 1, "late"), ("b", 3, "new")], schema), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/table/v2").collect()) == [("a", 2, "y"), ("b", 3, "new")]
