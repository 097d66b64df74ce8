"""The stream of logged changes: windows, restarts, chunks, what is left out."""

import random
import time

import pytest

from foliant.streaming import changelog, watch
from foliant.streaming.changelog import WINDOW, line_of


def append(folder, name, rows, cut=0):
    data = b"".join(line_of(*r) for r in rows)
    with open(folder / name, "ab") as f:
        f.write(data[: len(data) - cut])


def rows_of(rows):
    return {(path, s // WINDOW * WINDOW) for s, _, path in rows}


def run(spark, folder, check, sink, **named):
    """Until nothing is left; batches go to ``sink`` by number."""
    df = changelog.changes(spark, str(folder), **named)

    def batch(part, number):
        got = [(r.path, r.at.timestamp()) for r in changelog.coalesced(part).collect()]
        sink(number, got)

    q = df.writeStream.foreachBatch(batch).option("checkpointLocation", f"file://{check}").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "logs").mkdir()
    return tmp_path / "logs"


def some(rng, start, n):
    at = sorted(start + rng.random() * 400 for _ in range(n))
    return [(round(t, 3), rng.choice(("added", "modified")), rng.choice(("/a/x", "/a/y", "/b", "/own/log", "/t\tab\\n\nl", "/é"))) for t in at]


def test_positions_by_bisection(tmp_path):
    rng = random.Random(1)
    rows = some(rng, 1000, 300)
    path = tmp_path / "x.log"
    path.write_bytes(b"".join(line_of(*r) for r in rows) + b"1300.0\tadd")
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(line_of(*r)))
    for before in [0, 1000, 5000] + [rng.random() * 420 + 990 for _ in range(60)] + [r[0] for r in rows[::40]]:
        want = ends[sum(r[0] < before for r in rows)]
        for start in (0, ends[40]):
            assert changelog.position(str(path), start, before) == max(want, start), before


def test_windows_once_over_restarts_and_chunks(spark, folder, tmp_path, monkeypatch):
    rng, old = random.Random(2), time.time() - 5000
    a, b = some(rng, old, 400), some(rng, old + 100, 300)
    append(folder, "a.log", a)
    append(folder, "b.log", b[:200], cut=5)  # the last line has no end yet
    monkeypatch.setattr(changelog, "CHUNK", 700)
    batches = {}
    sink = lambda n, got: batches.setdefault(n, got)
    run(spark, folder, tmp_path / "ck", sink)
    assert sorted(p for part in batches.values() for p in part) == sorted(rows_of(a) | rows_of(b[:199]))

    def fails(n, got):
        raise OSError

    with open(folder / "b.log", "ab") as f:
        f.write(line_of(*b[199])[-5:])
    later = some(rng, old + 1000, 100)
    append(folder, "c.log", later)
    with pytest.raises(Exception, match="OSError"):
        run(spark, folder, tmp_path / "ck", fails)
    run(spark, folder, tmp_path / "ck", sink)  # the batch that failed comes again
    got = [p for part in batches.values() for p in part]
    assert set(got) == rows_of(a) | rows_of(b[:200]) | rows_of(later) and len(got) - len(set(got)) <= 1  # b's last row came in a batch of its own
    before = len(got)
    late = [(s - 500, c, p) for s, c, p in some(rng, old, 30)]
    append(folder, "late.log", late)
    run(spark, folder, tmp_path / "ck", sink)
    got = [p for part in batches.values() for p in part]
    assert sorted(got[before:]) == sorted(rows_of(late))


def test_what_is_left_out_and_what_is_not_over(spark, folder, tmp_path):
    now = time.time()
    append(folder, "a.log", [(now - 50, "added", "/own/log"), (now - 50, "added", "/own"), (now - 50, "added", "/owner"), (now - 40, "removed", "/b"), (now + 500, "added", "/later")])
    got = []
    run(spark, folder, tmp_path / "ck", lambda n, part: got.extend(part), exclude=("/own",))
    assert sorted(p for p, _ in got) == ["/b", "/owner"]
    with pytest.raises(Exception, match="over 8 paths"):
        run(spark, folder, tmp_path / "ck2", lambda n, part: None, exclude=tuple(f"/{k}" for k in range(9)))


def test_logged_changes_drive_the_watch(spark, folder, tmp_path):
    append(folder, "a.log", [(time.time() - 100, "added", f"/a/{k // 2}") for k in range(2000)])
    append(folder, "b.log", [(time.time() - 100, "added", "/a/0")])
    built = []
    trigger = watch.kept_trigger(spark, lambda: built.append(1), 0.0, f"file://{tmp_path}/ck")
    q = watch.watch(changelog.changes(spark, str(folder)), "path", trigger, None, f"file://{tmp_path}/ck", lambda: 1.0)
    try:
        end = time.time() + 60
        while not built and time.time() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    assert built == [1] and trigger.dirty == 0
