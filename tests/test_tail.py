"""Tailing growing files, late rows and exact delivery."""

import json
from datetime import datetime, timedelta

from tidewatch.sources import tail
from tidewatch.streaming import live


def append(path, *lines, end="\n"):
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n".join(lines) + end)


def drain(spark, pattern, folder, from_start=False):
    lines = tail.tail_lines(spark, pattern, from_start)
    query = live.write_batches(lines, live.replacing(str(folder / "out")), str(folder / "check"))
    query.processAllAvailable()
    query.stop()
    query.awaitTermination(60)
    return query


def taken(spark, folder):
    return sorted(r["value"] for r in spark.read.schema("value string").json(str(folder / "out")).collect())


def test_appended_lines_arrive_once_and_a_restart_continues(spark, tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    append(a, "old 1", "old 2")
    pattern = str(tmp_path / "*.log")
    lines = tail.tail_lines(spark, pattern)
    query = live.write_batches(lines, live.replacing(str(tmp_path / "out")), str(tmp_path / "check"))
    query.processAllAvailable()
    append(a, "new 1", "näxt 2")
    append(a, "half a li", end="")
    append(b, "b 1", "", "b 2\r")
    query.processAllAvailable()
    query.stop()
    query.awaitTermination(60)
    assert taken(spark, tmp_path) == sorted(["new 1", "näxt 2", "b 1", "", "b 2"])
    append(a, "ne", "after")
    append(b, "b 3")
    drain(spark, pattern, tmp_path)
    assert taken(spark, tmp_path) == sorted(["new 1", "näxt 2", "b 1", "", "b 2", "half a line", "after", "b 3"])


def test_ranges_of_bytes_cut_between_lines(tmp_path):
    path = tmp_path / "x.log"
    lines = [f"line {i} " + "é" * (i % 7) for i in range(100)]
    append(path, *lines)
    for size in (1, 3, 10, 64, 10_000):
        reader = tail.TailReader(str(path), True, size)
        pieces = reader.partitions(reader.initialOffset(), reader.latestOffset())
        assert [r[0] for p in pieces for r in reader.read(p)] == lines
    shrunk = {"files": json.dumps({str(path): 10**6})}
    assert reader.partitions(shrunk, reader.latestOffset())[0].first == 0
    assert tail.TailReader(str(tmp_path / "none*"), False, 5).latestOffset() == {"files": "{}"}


def test_a_batch_run_again_leaves_one_copy(spark, tmp_path):
    write = live.replacing(str(tmp_path / "out"))
    rows = spark.createDataFrame([("a",), ("b",)], "value string")
    write(rows, 0)
    write(rows, 1)
    write(rows.limit(1), 1)
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_late_rows_are_split_off_the_same_way_again(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    frame = lambda rows: spark.createDataFrame([(i, None if s is None else at(s)) for i, s in rows], "id int, ts timestamp")
    ready, late = {}, {}
    keep = lambda where: lambda rows, n: where.__setitem__(n, sorted(r["id"] for r in rows.collect()))
    write = live.split_late("ts", 30, str(tmp_path / "state"), keep(ready), keep(late))
    batches = [frame([(1, 100), (2, 5)]), frame([(3, 69), (4, 70), (5, None)]), frame([(6, 500)]), frame([(7, 469), (8, 471)])]
    for n, b in enumerate(batches):
        write(b, n)
    for n in (1, 2):  # after a failure
        write(batches[n], n)
    assert ready == {0: [1, 2], 1: [4, 5], 2: [6], 3: [8]} and late == {0: [], 1: [3], 2: [], 3: [7]}
