import json

import pyarrow as pa
from pyspark.sql import functions as F

from logweave.functions import layouts as L
from logweave.operators import log_entries as le

HEADS = [
    ("W1103 08:19:56.194579   73234 ring.go:740] Queue closed", "1103 08:19:56.194579", "WARNING", "ring.go", "Queue closed"),
    ("2025-11-03T22:09:47Z\tINFO Worker Main\tsync.py:304\tload\tFailed to get", "2025-11-03T22:09:47Z", "INFO", "sync.py", "Failed to get"),
    ("2025-10-03 22:29:39,685 WARN  [pool-1] org.quill.Spool - [invoice] drained", "2025-10-03 22:29:39,685", "WARNING", "org.quill.Spool", "[invoice] drained"),
    ("2025-11-05T05:02:49Z INFO Pool-0 MainProcess router.py:127 load Failed to get", "2025-11-05T05:02:49Z", "INFO", "router.py", "Failed to get"),
    ("Oct 22 03:08:12 node-15 meterctl[1193]: [ERROR] [quota] dropped", "Oct 22 03:08:12", "ERROR", "meterctl", "[quota] dropped"),
    ("<129>Oct  4 03:11:10 node-29 meterctl[1224]: [INFO] [account] x", "Oct  4 03:11:10", "INFO", "meterctl", "[account] x"),
    ("[03/Oct/2025 22:28:04] worker.lease (DEBUG) Manifest", "03/Oct/2025 22:28:04", "DEBUG", "worker.lease", "Manifest"),
    ("[2025-10-31 16:33:40,026] CRITICAL - Rebalanced", "2025-10-31 16:33:40,026", "CRITICAL", "", "Rebalanced"),
    ("[2025/10/31:16:33:42] TRACE - Voucher", "2025/10/31:16:33:42", "TRACE", "", "Voucher"),
    ("WARN | 2025-11-02T02:21:48Z | app.views | Session idle", "2025-11-02T02:21:48Z", "WARNING", "app.views", "Session idle"),
    ('ts=2025-10-04T15:27:01.145Z level=info component=leaser msg="a \\"b\\"\\nc" took=8ms', "2025-10-04T15:27:01.145Z", "INFO", "leaser", 'a "b"\nc'),
    ('level=fatal ts=2025-10-05T01:33:12.957332883+1000 msg="x" component=shard.loop', "2025-10-05T01:33:12.957332883+1000", "FATAL", "shard.loop", "x"),
    ("2026-05-14T09:00:00Z INFO plain message", "2026-05-14T09:00:00Z", "INFO", "", "plain message"),
    # heads of many tokens, of long ones, and pairs in any place
    ("2025-10-03 22:29:39,685 INFO [pool a b c d e f g h i j k l] my.comp - hello", "2025-10-03 22:29:39,685", "INFO", "my.comp", "hello"),
    (f"2025-10-03 22:29:39,685 INFO [{'t' * 2100}] my.comp - hello", "2025-10-03 22:29:39,685", "INFO", "my.comp", "hello"),
    (f"2025-10-03 22:29:39,685 INFO [{'aB9/' * 600}] {'x.' * 300}y - hello", "2025-10-03 22:29:39,685", "INFO", "x." * 300 + "y", "hello"),
    ('ts=2025-10-04T15:27:01.145Z caller=a.go:1 level=info msg="x"', "2025-10-04T15:27:01.145Z", "INFO", "a.go:1", "x"),
    (" ".join(["ts=2025-10-04T15:27:01Z", *(f"k{i}=v{i}" for i in range(40)), 'note="b c" level=warn msg=x']), "2025-10-04T15:27:01Z", "WARNING", "", "x"),
]


def entries_of(spark, texts):
    """Layout and fields of whole entries."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("head", F.substring_index("text", "\n", 1))
    got = le.with_fields(le.with_layout(df, "head").drop("head").withColumnRenamed("_layout", "layout").withColumn("code", F.col("layout")))
    return [(r.code, L.Entry(*[r[f] for f in L.Entry._fields])) for r in got.orderBy("i").collect()]


def test_layouts(spark):
    texts = [x[0] for x in HEADS] + [x[0] + "\nTraceback\n  File" for x in HEADS]
    got = entries_of(spark, texts)
    for (line, ts, level, component, body), (code, one), (_, more) in zip(HEADS, got, got[len(HEADS) :]):
        assert code >= 0, line
        assert one == L.Entry("text", "ok", ts, level, component, body)
        assert more == one._replace(body=body + "\nTraceback\n  File")


CONTINUATIONS = ["", "  File \"x.py\", line 3", "Traceback (most recent call last):", "2025-10-03 backlog of 69 entries", "- queue: 72", "}", '  "level": "INFO",', "0008  33 57 0e", "SELECT a.id", "\tat io.tarn.Worker.load(Voucher.java:247)", "ERROR", "ValueError: bad", " {", "count=3 retry=5 state=info", "a b c ts=2025-10-04T15:27:01Z level=info"]


def test_continuations(spark):
    assert [code for code, _ in entries_of(spark, CONTINUATIONS)] == [-1] * len(CONTINUATIONS)


JSONS = [
    ('{"time":1761212112055,"severity":"warn","msg":"m ","service":"s"}', L.Entry("json", "ok", "1761212112055", "WARNING", "s", "m")),
    ('{"@timestamp":"t","event":"e","resource":{"service.name":"r"}}', L.Entry("json", "ok", "t", "INFO", "r", "e")),
    ("{broken", L.Entry("text", "degraded", "", "INFO", "", "{broken")),
    ('{"a":1} ,"', L.Entry("text", "degraded", "", "INFO", "", '{"a":1} ,"')),
    ('{"a":NaN}', L.Entry("text", "degraded", "", "INFO", "", '{"a":NaN}')),
    ("", L.Entry("text", "ok", "", "INFO", "", "")),
]


def test_json(spark):
    assert [e for _, e in entries_of(spark, [t for t, _ in JSONS])] == [e for _, e in JSONS]


def lines_of(spark, files):
    rows = [(s, i + 1, x, "extra") for s, xs in files.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows + rows[:3], "source string, line_no long, line string, text string")


def brute(spark, files):
    """Entries by a loop over the lines of each file, given the layout of every different line."""
    cleaned = sorted({L.clean_text(x or "") for xs in files.values() for x in xs})
    layout = {x: code for x, (code, _) in zip(cleaned, entries_of(spark, cleaned))}
    keys, texts, codes = [], [], []
    for s, xs in files.items():
        entries = []
        for i, x in enumerate(xs):
            x = L.clean_text(x or "")
            if not entries or layout[x] >= 0:
                entries.append((i + 1, [x]))
            else:
                entries[-1][1].append(x)
        keys += [(s, p, len(e)) for p, e in entries]
        texts += ["\n".join(e) for _, e in entries]
        codes += [layout[e[0]] for _, e in entries]
    fields = L.parse_entries(pa.array(texts, pa.string()), pa.array(codes, pa.int32())).to_pylist()
    return {(*k, *f.values()) for k, f in zip(keys, fields)}


def test_assembly_over_chunks(spark):
    head = "2025-10-03 22:29:39,685 WARN  [pool-1] org.quill.Spool - "
    files = {
        "raw/a/1": ["  stray", None, *[x for i in range(30) for x in ([f"{head}{i}\r"] + ["  more  "] * (i % 5))]],
        "raw/b/2": [f"{head}first", *["\tat x"] * 40, "", "{", '  "time": "2025-10-03T00:00:00Z",', '  "msg": "\\u001b[31mx\\u001b[0m"', "}", f"\x1b[31m{head}\x1b[0mlast"],
        "raw/c/3": [""],
    }
    want = brute(spark, files)
    for chunk in (1, 3, 7, 4096):
        got = {(r.source, r.record_pos, r.line_count, r.parse_format, r.parse_status, r.ts_text, r.severity_text, r.component, r.body) for r in le.log_entries(lines_of(spark, files), chunk).collect()}
        assert got == want


def test_no_rows_and_null_keys(spark):
    schema = "source string, line_no long, line string"
    assert le.found(le.log_entries(spark.createDataFrame([], schema))).count() == 0
    assert le.log_entries(spark.createDataFrame([(None, 1, "x"), ("s", None, "y")], schema)).count() == 0


def test_unsplit_events(spark):
    body = HEADS[0][0] + "  \nmore \n"
    rows = [("e1", "s", 5, None, body), ("e1", "s", 5, None, body), ("e2", "s", 9, "t", "split"), (None, "s", 1, None, "x"), ("e3", "s", 7, None, None), ("e4", "s", 8, None, json.dumps({"msg": "x" * 100_000}))]
    got = {r.record_pos: r for r in le.found(le.unsplit_entries(spark.createDataFrame(rows, "event_id string, source string, offset long, template_id string, body string"))).collect()}
    assert set(got) == {5, 7, 8}
    assert (got[5].line_count, got[5].component, got[5].body_chars) == (3, "ring.go", len("Queue closed\nmore"))
    assert (got[7].body_chars, got[8].body_chars) == (0, 100_000)


def test_whole_tables_against_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/raw_lines.parquet")
    files = {}
    for r in df.dropDuplicates(["source", "line_no"]).orderBy("source", "line_no").collect():
        files.setdefault(r.source, []).append(r.line)
    got = {(r.source, r.record_pos, r.line_count, r.parse_format, r.parse_status, r.ts_text, r.severity_text, r.component, r.body) for r in le.log_entries(df, 16).collect()}
    assert got == brute(spark, files)


def test_more_rules_than_are_broadcast(spark, monkeypatch):
    want = entries_of(spark, [x[0] for x in HEADS])
    monkeypatch.setattr(le, "RULES_BROADCAST", 2)
    assert entries_of(spark, [x[0] for x in HEADS]) == want
