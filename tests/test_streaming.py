"""Streaming state and maintained seasons: expiry, replays, and what a refresh reads."""

import datetime as dt
import os

import pytest

from jointedge.streaming import refresh

REQUEST = "request_id long, ts timestamp, fingerprint string, ok boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute, seconds=second)


@pytest.fixture
def rocks(spark):
    conf = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(conf)
    spark.conf.set(conf, ROCKS)
    yield
    spark.conf.set(conf, held)


def run(spark, folder, batches):
    """The answers of each batch, a file of its own, and the rows of state after it."""
    os.makedirs(f"{folder}/in")
    source = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    sizes = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = refresh.keep_windows(refresh.reused_requests(source), f"{folder}/out", f"{folder}/checkpoint")
        q.awaitTermination()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    found = {r.request_id: (r.cached, r.age_s) for r in spark.read.parquet(f"{folder}/out").collect()}
    return found, sizes


def test_a_success_answers_ten_minutes_and_a_failure_none(spark, rocks, tmp_path):
    rows = [
        (1, at(0), "a", False), (2, at(1), "a", True), (3, at(5, 20), "a", False), (4, at(10, 59), "a", True), (5, at(11), "a", True), (6, at(12), "a", None),
        (7, at(3), "b", False), (8, at(4), "b", None), (9, at(0), "c", True), (10, at(9, 59), "c", True), (11, at(20), "c", False), (12, at(21), "c", True),
    ]
    found, _ = run(spark, tmp_path, [rows])
    assert found == {1: (False, 0), 2: (False, 0), 3: (True, 260), 4: (True, 599), 5: (False, 0), 6: (True, 60), 7: (False, 0), 8: (False, 0), 9: (False, 0), 10: (True, 599), 11: (False, 0), 12: (False, 0)}


def test_state_lives_across_batches_and_goes_by_its_timer(spark, rocks, tmp_path):
    first = [(i, at(0, i % 60), f"f{i}", True) for i in range(200)]
    second = [(1000, at(8), "f3", True), (1001, at(8), "new", False)]
    third = [(2000, at(200), "f3", True), (2001, at(200), "g", True)]
    fourth = [(3000, at(201), "f3", False), (3001, at(400), "g", True)]
    found, sizes = run(spark, tmp_path, [first, second, third, fourth])
    assert found[1000] == (True, 477) and found[1001] == (False, 0) and found[2000] == (False, 0) and found[3000] == (True, 60) and found[3001] == (False, 0)
    assert sizes[0] >= 200 and sizes[2] <= 12  # the timers of the first fingerprints have fired by then


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "season int, p long, h1 int, h2 int")


def test_a_refresh_touches_its_season_and_a_replay_counts_once(spark, tmp_path):
    kept = refresh.SeasonMoments(spark, f"file://{tmp_path}/kept")
    old, new, late = [(s, p, p % 2, 1) for s in (2020, 2021) for p in range(20)], [(2022, p, 1, 0) for p in range(5)], [(2022, 3, 0, 1), (2021, 3, 1, 1)]
    assert kept.apply(rows_of(spark, old), 0) == [2020, 2021]
    untouched = kept.versions(2020)
    for _ in range(2):  # a batch that runs again
        assert kept.apply(rows_of(spark, new), 1) == [2022]
    assert kept.versions(2020) == untouched == [0] and kept.versions(2022) == [1]
    read = kept.read([2022])
    assert {f.split("season=")[1].split("/")[0] for f in read.inputFiles()} == {"2022"}
    for _ in range(2):
        assert kept.apply(rows_of(spark, late), 2) == [2021, 2022]
    whole = refresh.moments_of(rows_of(spark, old + new + late))
    tell = lambda df: sorted(tuple(r) for r in df.select("season", "p", "n", "n1", "n2", "n11").collect())
    assert tell(kept.read()) == tell(whole)
    assert tell(kept.read([2021], before=2)) == tell(refresh.moments_of(rows_of(spark, old)).where("season = 2021"))
    for batch in (3, 4):
        kept.apply(rows_of(spark, late), batch)
    assert kept.versions(2022) == [3, 4] and kept.apply(rows_of(spark, []), 5) == []


def test_a_stream_keeps_seasons(spark, tmp_path):
    schema = "season int, p long, h1 int, h2 int"
    kept = refresh.SeasonMoments(spark, f"file://{tmp_path}/kept")
    os.makedirs(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    parts = [[(2020, 1, 1, 1)], [(2020, 1, 1, 0), (2021, 2, 0, 1)]]
    for part in parts:
        rows_of(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        kept.follow(source, f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(tuple(r) for r in kept.read().collect()) == [(2020, 1, 2, 2, 1, 1), (2021, 2, 1, 0, 1, 0)]
    assert kept.versions(2020) == [0, 1]
