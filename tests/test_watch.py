"""The trigger's memory: restarts, batches that come twice, rebuilds that were cut off, and time without changes."""

import json
import time

import pytest

from foliant.streaming import watch


def feed(tmp_path, name, n):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps({"path": f"/u/{name}/{k}"}) for k in range(n)))


def changes(spark, tmp_path):
    return spark.readStream.schema("path string").json(f"file://{tmp_path}/in")


def run(spark, tmp_path, trigger, now):
    watch.watch(changes(spark, tmp_path), "path", trigger, None, f"file://{tmp_path}/ck", lambda: now, available_now=True).awaitTermination(90)


def test_a_restart_between_999_and_1000_changes(spark, tmp_path):
    built = []
    make = lambda: watch.kept_trigger(spark, lambda: built.append(1), 0.0, f"file://{tmp_path}/ck")
    feed(tmp_path, "a", 999)
    run(spark, tmp_path, make(), 5.0)
    assert not built
    second = make()
    assert (second.dirty, second.batch) == (999, 0)
    run(spark, tmp_path, second, 6.0)  # nothing new
    assert not built and make().dirty == 999
    feed(tmp_path, "b", 1)
    third = make()
    run(spark, tmp_path, third, 7.0)
    assert len(built) == 1 and third.dirty == 0 and third.last == 7.0
    fourth = make()
    assert (fourth.dirty, fourth.last, fourth.full) == (0, 7.0, 0.0)
    feed(tmp_path, "c", 3)
    run(spark, tmp_path, fourth, 36.0)
    assert len(built) == 1
    feed(tmp_path, "d", 1)
    run(spark, tmp_path, make(), 37.0)
    assert len(built) == 2


def kept():
    held = []
    return (lambda: held[-1] if held else None, held.append), held


def test_a_batch_that_comes_twice_counts_once():
    ledger, _ = kept()
    first = watch.RebuildTrigger(lambda: None, 0.0, ledger=ledger)
    assert not first.step(600, 1.0, 0)
    again = watch.RebuildTrigger(lambda: None, 0.0, ledger=ledger)
    assert not again.step(600, 2.0, 0) and again.dirty == 600
    assert again.step(400, 3.0, 1)


def test_a_rebuild_that_was_cut_off_is_done_again():
    class Killed(BaseException):
        pass

    def dies():
        raise Killed

    ledger, _ = kept()
    for changes, now in ((1000, 5.0), (0, watch.DAILY)):
        first = watch.RebuildTrigger(dies, 0.0, ledger=ledger)
        with pytest.raises(Killed):
            first.step(changes, now, first.batch + 1)
        again = watch.RebuildTrigger(lambda: None, 0.0, ledger=ledger)
        assert again.cut_off and again.step(changes, now + 1, again.batch)  # the same batch is delivered again
        assert not again.step(0, now + 2, again.batch + 1) and again.rebuilds == 1
    assert again.full == watch.DAILY + 1

    def fails():
        raise OSError

    ledger, held = kept()
    broken = watch.RebuildTrigger(fails, 0.0, ledger=ledger)
    assert not broken.step(1, 40.0, 0)
    later = watch.RebuildTrigger(lambda: None, 0.0, ledger=ledger)
    assert not later.cut_off and not later.step(0, 90.0, 1) and later.last == 0.0  # waits for a new change, as in one life
    assert later.step(1, 91.0, 2) and json.loads(held[-1])["last"] == 91.0


def test_few_changes_do_not_wait_for_the_next(spark, tmp_path):
    """One change, and no other: the heartbeat brings the rebuild when its time has come."""
    feed(tmp_path, "a", 1)
    now, built = [10.0], []
    trigger = watch.kept_trigger(spark, lambda: built.append(1), 0.0, f"file://{tmp_path}/ck")
    query = watch.watch(changes(spark, tmp_path), "path", trigger, None, f"file://{tmp_path}/ck", lambda: now[0])
    try:
        end = time.time() + 90
        while trigger.dirty < 1 and time.time() < end:
            time.sleep(0.2)
        assert trigger.dirty == 1 and not built
        now[0] = 31.0
        while not built and time.time() < end:
            time.sleep(0.2)
        assert built and trigger.dirty == 0
    finally:
        query.stop()
