import json

import pytest
from pyspark.sql import functions as F

from logweave import schemas
from logweave.functions import text
from logweave.operators import ingest
from logweave.sources import files


def column(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]


def normalized(spark, *values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.t for r in text.with_normalized(df, "x", "t").orderBy("i").collect()]


def test_normalize(spark):
    out = normalized(
        spark, "Failed user 123e4567-e89b-12d3-a456-426614174000 from 10.0.0.5:443 path /api/accounts/507f1f77bcf86cd799439011 trace 4bf92f3577b34da6a3ce929d0e0e4736 at 2026-05-14T09:00:00Z",
        "conv_50a1442a002b nsclient_1 aBc123Def456GhI789 -5 3.14 x5 0xdeadbeef a@b.example", "port=443", "port=443 a:b", " \x1b[31mred\x1b[0m \n two  ", None, "",
    )
    assert out == [
        "Failed user <UUID> from <IP>:<PORT> path <PATH> trace <TRACE_ID> at <TIMESTAMP>", "conv_<HEX> nsclient_1 <ID> <NUM> <NUM> x5 <HEX> <EMAIL>", "port=<NUM>", "port=<PORT> a:b", "red two", None, "",
    ]


def test_scalars(spark):
    assert column(spark, text.exception_type, "ValueError: x then KeyError", "none", None, "") == ["KeyError", None, None, None]
    assert column(spark, text.canonical_severity, "WARN", "error", "FATAL", None) == ["WARNING", "INFO", "FATAL", "INFO"]
    assert column(spark, text.severity_number, "TRACE", "CRITICAL", "x", None) == [1, 21, 9, 9]
    assert column(spark, text.cut_headline, "got payload {a}", "x" * 300, "end: -", None) == ["got", "x" * 200, "end", None]
    assert column(spark, text.first_line, "\n\n  a b \n c", "", None) == ["a b", "", None]
    assert column(spark, text.slug, "--A b/c--", None) == ["a-b-c", None]
    assert column(spark, text.scenario, "E2E_Soak_1", "BENCH-1", "x", None) == ["soak", "bench", "default", "default"]
    assert column(spark, lambda c: text.scenario(c, r"^x_(\w+?)_"), "x_Own_1", "E2E_a_1") == ["own", "a"]
    assert column(spark, text.trim_sample, "a \n b", "y" * 200) == ["a b", "y" * 139 + "…"]
    assert column(spark, text.shingles, "A b  a", "a", "", None) == [["a", "b", "a b", "b a"], ["a"], [], []]
    assert column(spark, text.epoch_seconds, "2025-01-01T00:00:00,5Z", "1970", "nonsense", None) == [1735689600.5, None, None, None]
    assert column(spark, lambda c: text.server_kind(c, F.lit("svc")), "Starting Gunicorn", "x", None) == ["gunicorn", None, None]
    assert column(spark, lambda c: text.error_kind(c, F.lit("ERROR"), text.exception_type(c)), "ValueError: x", "Traceback (most recent call last):", "plain") == ["ValueError", "traceback", "log_error"]


def test_jaccard(spark):
    j = lambda a, b: spark.range(1).select(text.jaccard(text.shingles(F.lit(a)), text.shingles(F.lit(b)))).first()[0]
    assert (j("", ""), j("a", ""), j("a b", "a b")) == (1.0, 0.0, 1.0) and j("a b", "a c") == pytest.approx(0.2)


LOG = (
    "2026-05-14T09:00:00Z\tERROR main proc\tapp.py:3\trun\tboom user 42\nTraceback (most recent call last):\n  File \"x.py\", line 2, in f\nValueError: bad\n"
    '{malformed-json\n{"time":"2026-05-14T09:00:01Z","level":"WARN","message":"slow","microservice":"gw","pid":"12","attributes":{"worker_id":"w1"},"exception":{"message":"m"}}\r\n'
    "2026-05-14 09:00:02,123 INFO - hello\n  more\n"
)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.log").write_text(LOG)
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "list.inputs.json").write_text(json.dumps([str(tmp_path / "sub")]))
    return tmp_path


def test_inputs(folder):
    a = str(folder / "sub" / "a.log")
    assert files.resolve_inputs([str(folder / "*.inputs.json"), a, str(folder / "sub")])[-1] == a
    assert files.resolve_inputs([str(folder / "list.inputs.json")]) == [a] == files.resolve_inputs([str(folder / "**" / "a.log")])
    with pytest.raises(FileNotFoundError):
        files.resolve_inputs([str(folder / "none*")])


@pytest.mark.parametrize("split", ["128m", "7b", "64b"])
def test_lines_and_offsets(spark, folder, split):
    """The same lines and bytes however a file is split, a lone carriage return ends no line."""
    p = folder / "sub" / "a.log"
    p.write_bytes(p.read_bytes() + "one\rtwo\r\nthr\u00e9e\n\nlast".encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = files.read_lines(spark, files.resolve_inputs([str(folder / "sub"), str(folder / "empty.log")])).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    raw = p.read_bytes().split(b"\n")
    assert [(r.line_no, r.line) for r in got] == [(i + 1, x.decode().removesuffix("\r")) for i, x in enumerate(raw)]
    assert [r.offset for r in got] == [sum(len(x) + 1 for x in raw[:i]) for i in range(len(raw))]


def test_decode(spark, folder):
    recs = ingest.records(files.read_lines(spark, [str(folder / "sub" / "a.log")]))
    ev = ingest.decode(recs, "svc", "run", "now", include_raw=True)
    assert ev.schema.names == schemas.EVENTS.names
    a, b, c, d = ev.orderBy("offset").collect()
    assert (a.line_count, a.severity_text, a.thread_name, a.process_name, a.exception_type, a.parse_format, a.body.split("\n")[0]) == (4, "ERROR", "main", "proc", "ValueError", "text", "boom user 42")
    assert json.loads(a.attributes_json) == {"code.function": "run", "code.location": "app.py:3"}
    assert (b.parse_status, b.severity_text, b.timestamp) == ("degraded", "INFO", None)
    assert (c.parse_format, c.severity_text, c.service_name, c.process_pid, c.worker_id, c.body) == ("json", "WARNING", "gw", 12, "w1", "slow")
    assert (d.timestamp, d.body, d.line_count) == ("2026-05-14 09:00:02,123", "hello\n  more", 2)
    strict = ingest.decode(recs, "svc", "run", "now", strict=True).orderBy("offset").collect()[-1]
    assert (strict.timestamp, strict.severity_text) == (None, "INFO")
    assert len({r.event_id for r in (a, b, c, d)}) == 4


def test_decode_of_no_records(spark):
    assert ingest.decode(ingest.records(spark.createDataFrame([], "source string, line_no long, line string")), "s", "r", "n").count() == 0
