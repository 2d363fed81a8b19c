"""Reports of the command line hold all rows."""

from logweave import cli
from logweave.plans import reports
from logweave.sources import files


def test_compare_writes_all_kinds_in_full(spark, tmp_path):
    schema = "template_id string, event_count long, severity_text string, error_kind string"
    rows = lambda p, n, count: [(f"{p}{i:03}", count, "ERROR", "none") for i in range(n)]
    for name, data in (("l", rows("fixed", 120, 3) + rows("more", 130, 2)), ("r", rows("more", 130, 50) + rows("new", 110, 1))):
        files.write_table(spark.createDataFrame(data, schema), str(tmp_path / name / "templates.parquet"))
    assert cli.main(["compare", "--left", str(tmp_path / "l"), "--right", str(tmp_path / "r"), "--out", str(tmp_path / "c.md")]) == 0
    text = (tmp_path / "c.md").read_text()
    assert [text.count(f"| {p}") for p in ("new", "fixed", "more")] == [110, 120, 130]
    assert text.index("| new") < text.index("| fixed") < text.index("| more")
    assert {(r.kind, r["count"]) for r in files.read_table(spark, str(tmp_path / "c.md.parquet")).groupBy("kind").count().collect()} == {("new", 110), ("fixed", 120), ("frequency", 130)}


def test_page_has_all_runs(spark):
    page = reports.html_report(spark.range(1500).selectExpr("format_string('run%05d', id) run_id"))
    assert page.count("<td>run") == 1500 and "run01499" in page and page.index("run00001") < page.index("run01499")
