import os
import subprocess
import sys
import time
import threading

from conftest import ROOT
from foliant.sources.shared import Run, shared_dir, written


def names(spark):
    return {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("part")}


def test_a_run_drops_its_own_folders_alone(spark):
    before = names(spark)
    with Run(spark) as outer:
        first = written(spark.range(3), "part-a")
        with Run(spark) as inner:
            second = written(spark.range(4), "part-b")
            written(spark.range(5), "part-c")
            inner.drop(but=1)
        assert len(names(spark) - before) == 2 and first.count() == 3
        outer.drop()
    assert names(spark) == before and second is not None


def test_runs_in_two_threads_do_not_meet(spark):
    """One thread drops all it has while the other one's rows are still unread."""
    ready, dropped, counts = threading.Barrier(2), threading.Event(), []

    def reads():
        with Run(spark) as mine:
            held = written(spark.range(100), "part-x")
            ready.wait(60)
            assert dropped.wait(60)
            counts.append(held.count())
            mine.drop()

    def drops():
        with Run(spark) as mine:
            written(spark.range(7), "part-y")
            ready.wait(60)
            mine.drop()
            dropped.set()

    before = names(spark)
    threads = [threading.Thread(target=f) for f in (reads, drops)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert counts == [100] and names(spark) == before


SCRIPT = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).config("spark.sql.shuffle.partitions", "2").getOrCreate()
from foliant.operators.search import rank_rows
assert rank_rows(spark.range(9), [F.desc("id")]).where("rank = 1").first().id == 8
"""


def test_nothing_stays_when_the_driver_ends(tmp_path):
    subprocess.run([sys.executable, "-c", SCRIPT, f"file:{tmp_path}"], check=True, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, timeout=180, capture_output=True)
    for _ in range(100):  # its JVM ends a little later
        if not (left := [f for _, _, files in os.walk(tmp_path) for f in files]):
            break
        time.sleep(0.2)
    assert not left
