"""Commits of several writers, and snapshots that readers hold."""

import threading

import pytest

from lexispark.sources import commits
from lexispark.sources.shared import expire_snapshots, load_snapshot, save_snapshot


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/log of writers"

    def write(name):
        for k in range(8):
            commits.commit(spark, folder, lambda before: {"all": [*(before or {"all": []})["all"], f"{name}{k}"]})

    writers = [threading.Thread(target=write, args=(n,)) for n in "abc"]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    number, content = commits.load(spark, folder)
    assert number == 24 and sorted(content["all"]) == sorted(f"{n}{k}" for n in "abc" for k in range(8))
    for n in "abc":  # each writer's own order stays
        assert [x for x in content["all"] if x[0] == n] == [f"{n}{k}" for k in range(8)]


def test_a_taken_name_is_refused(spark, tmp_path):
    assert commits.create(spark, f"{tmp_path}/x/1.json", "é") and not commits.create(spark, f"{tmp_path}/x/1.json", "b")
    assert commits.read(spark, f"{tmp_path}/x/1.json") == "é"
    assert commits.versions(spark, f"{tmp_path}/none") == []
    with pytest.raises(FileNotFoundError):
        commits.load(spark, f"{tmp_path}/none")


def test_readers_keep_their_version(spark, tmp_path):
    folder = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        load_snapshot(spark, folder)
    save_snapshot(spark.range(3), folder)
    held, stop, seen = load_snapshot(spark, folder), threading.Event(), []

    def read():
        while not stop.is_set():
            seen.append(load_snapshot(spark, folder).count())

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(4, 8):
        save_snapshot(spark.range(n), folder)
    stop.set()
    reader.join()
    assert seen and set(seen) <= {3, 4, 5, 6, 7} and seen == sorted(seen)
    assert held.count() == 3 and load_snapshot(spark, folder).count() == 7 and load_snapshot(spark, folder, 2).count() == 4
    assert expire_snapshots(spark, folder, keep=2) == [1, 2, 3]
    assert load_snapshot(spark, folder).count() == 7
    with pytest.raises(FileNotFoundError):
        load_snapshot(spark, folder, 1)
