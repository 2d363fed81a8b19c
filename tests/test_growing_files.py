"""The tail of growing files: appended, unfinished, truncated and renamed ones."""

import gzip
import json
import os

from pyspark.sql import functions as F

from logweave.streaming import growing, tail


def line(i):
    return json.dumps({"time": f"2026-05-14T10:00:{i % 60:02}Z", "level": "INFO", "message": f"handled request {i}"}) + "\n"


def test_appended_lines_are_read_once(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    log = src / "a.log"
    run = lambda: tail.materialize(tail.stream_lines(spark, str(src)), str(out), str(tmp_path / "ck"), "gw", "r").awaitTermination(120)
    events = lambda: spark.read.parquet(f"{out}/events")
    log.write_text(line(0) + line(1) + line(2)[:20])
    with gzip.open(src / "old.log.gz", "wt") as f:
        f.write(line(50))
    run()
    assert events().count() == 3  # not the line being written
    with log.open("a") as f:
        f.write(line(2)[20:] + line(3))
    run()
    assert events().count() == 5
    got = events().where("source like '%a.log'")
    assert sorted(r.offset for r in got.collect()) == sorted({r.offset for r in got.collect()}) and got.select("event_id").distinct().count() == 4
    log.write_text(line(9))  # truncated and written anew
    run()
    assert events().count() == 6
    assert spark.read.parquet(f"{out}/templates.parquet").agg(F.sum("event_count")).first()[0] == 6


def test_positions(tmp_path):
    p, r = tmp_path / "a.log", growing.Reader(str(tmp_path), 60.0)
    texts = lambda s, e: [(b["first_line"][0].as_py(), b["text"][0].as_py()) for x in r.partitions(s, e) for b in r.read(x)]
    p.write_bytes(b"half")
    assert r.latestOffset() == {}
    p.write_bytes(b"one\ntwo\nhalf")
    first = r.latestOffset()
    assert texts({}, first) == [(1, "one\ntwo\n")]
    p.rename(tmp_path / "a.log.1")
    with (tmp_path / "a.log.1").open("ab") as f:
        f.write(b" done\n" + b"x" * 70000)
    p.write_bytes(b"new\n")
    second = r.latestOffset()
    assert sorted(texts(first, second)) == [(1, "new\n"), (3, "half done\n")]
    assert texts(second, r.latestOffset()) == []
    os.utime(tmp_path / "a.log.1", (0, 0))  # not changed for long: its last line is whole
    assert texts(second, r.latestOffset()) == [(4, "x" * 70000)]
