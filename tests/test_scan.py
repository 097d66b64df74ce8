"""Scans in rounds, against a plain walk."""

import os

import pytest

from foliant.sources import files


def walked(root):
    found = []
    for at, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not files.skips(f, f"{at}/{f}", True)]
        found += [(n, at) for n in folders] + [(n, at) for n in names if not files.skips(n, f"{at}/{n}", False)]
    return sorted(found)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for k in range(700):  # many folders right under the root
        (root / f"w{k}").mkdir()
        (root / f"w{k}" / f"f{k}.txt").write_text("x")
    at = root
    for k in range(120):  # one deep chain
        at = at / f"d{k}"
        at.mkdir()
        (at / ".hidden").write_text("x")
        (at / "é").write_text("x")
    (root / "node_modules" / "p").mkdir(parents=True)
    (root / "empty").mkdir()
    return root


@pytest.mark.parametrize("budget", [0, 7, 4096])
def test_rounds_find_what_a_walk_finds(spark, tree, budget, monkeypatch):
    def on_the_driver(folder):
        raise AssertionError(folder)

    monkeypatch.setattr(files, "scan_one", on_the_driver)  # tasks run in other processes
    root = tree if budget else tree / "d0" / "d1" / "d2" / "d3"
    if not budget:
        root = tree / "w5"
    got = files.scan(spark, str(root), partitions=3, budget=budget)
    assert sorted((r.name, r.dir_path) for r in got.collect()) == walked(str(root))


def test_the_number_of_tasks_is_fixed(spark, tree):
    """Folders are dealt out to as many tasks as asked for, however many there are."""
    jobs = spark.sparkContext.statusTracker()
    before = set(jobs.getJobIdsForGroup(None))
    files.scan(spark, str(tree), partitions=3, budget=0 + 50)
    stages = [s for j in set(jobs.getJobIdsForGroup(None)) - before for s in jobs.getJobInfo(j).stageIds]
    tasks = [info.numTasks for s in stages if (info := jobs.getStageInfo(s))]
    assert tasks and max(tasks) <= 4


def test_empty_missing_and_odd_roots(spark, tree, tmp_path):
    assert files.scan(spark, str(tree / "empty")).count() == 0
    assert files.scan(spark, str(tree / "w3") + "/").collect()[0].dir_path == str(tree / "w3")
    with pytest.raises(Exception, match="No such file"):
        files.scan(spark, str(tmp_path / "gone"))
