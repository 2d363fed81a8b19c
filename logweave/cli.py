"""Command line: scan, compare, export-dataset, index, diff, report-html, tail."""

from __future__ import annotations

import argparse
import json
import os

from logweave import api
from logweave.operators import classify, diff
from logweave.plans import reports, scan
from logweave.session import get_spark
from logweave.sources import files
from logweave.streaming import tail


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logweave")
    sub = p.add_subparsers(dest="verb", required=True)
    s = sub.add_parser("scan", help="log files to events, templates and a report")
    s.add_argument("--input", action="append", required=True, dest="inputs")
    s.add_argument("--service", default="default")
    s.add_argument("--run-id")
    s.add_argument("--rules")
    s.add_argument("--baseline", help="folder of an earlier scan")
    s.add_argument("--instances", default="all", help="all, last or a number of restarts")
    s.add_argument("--include-raw", action="store_true")
    s.add_argument("--out", required=True)
    c = sub.add_parser("compare", help="two scans")
    for a in ("--left", "--right", "--out"):
        c.add_argument(a, required=True)
    c.add_argument("--frequency-ratio", type=float, default=2.0)
    c.add_argument("--min-count", type=int, default=5)
    d = sub.add_parser("export-dataset", help="events as NDJSON")
    d.add_argument("--input", required=True)
    d.add_argument("--out", required=True)
    d.add_argument("--include-body", action="store_true")
    i = sub.add_parser("index", help="registry and baseline of many scans")
    i.add_argument("--runs-root", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--min-green-runs", type=int, default=3)
    i.add_argument("--scenario-regex")
    f = sub.add_parser("diff", help="one scan against the baseline")
    f.add_argument("--runs-root", required=True)
    f.add_argument("--index", required=True)
    f.add_argument("--run-id", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--z-threshold", type=float, default=3.0)
    f.add_argument("--min-observed-count", type=int, default=5)
    h = sub.add_parser("report-html", help="runs of an index as a page")
    h.add_argument("--runs-root", required=True)
    h.add_argument("--index", required=True)
    h.add_argument("--out", required=True)
    t = sub.add_parser("tail", help="new files of a folder to events and templates")
    for a in ("--folder", "--out", "--service"):
        t.add_argument(a, required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = get_spark()
    if a.verb == "scan":
        rules = classify.load_rules(a.rules) if a.rules else classify.DEFAULT_RULES
        base = files.read_table(spark, f"{a.baseline}/templates.parquet", "template_id") if a.baseline else None
        done = scan.scan(spark, a.inputs, a.service, a.run_id, a.include_raw, stage=f"{a.out}/decoded.parquet", rules=rules, baseline_ids=base, instances=a.instances)
        print(json.dumps(scan.write(done, a.out), sort_keys=True))
    elif a.verb == "compare":
        left, right = (files.read_table(spark, f"{x}/templates.parquet") for x in (a.left, a.right))
        saved = f"{a.out}.parquet"
        files.write_table(diff.compare_runs(left, right, a.frequency_ratio, a.min_count), saved)
        with open(a.out, "w") as f:
            f.writelines(f"{line}\n" for line in reports.compare_report(files.read_table(spark, saved)))
    elif a.verb == "export-dataset":
        files.write_dataset(files.read_table(spark, f"{a.input}/events.parquet"), files.read_table(spark, f"{a.input}/templates.parquet"), a.out, a.include_body)
    elif a.verb == "index":
        api.Index(spark, a.runs_root, a.out).build(a.min_green_runs, a.scenario_regex)
    elif a.verb == "diff":
        found = api.Index(spark, a.runs_root, a.index).diff_for(a.run_id, a.z_threshold, a.min_observed_count)
        os.makedirs(a.out, exist_ok=True)
        files.write_table(found, f"{a.out}/diff.parquet")
        found = files.read_table(spark, f"{a.out}/diff.parquet")
        with open(f"{a.out}/diff.md", "w") as f:
            f.write(reports.diff_report(diff.diff_summary(found), found))
    elif a.verb == "report-html":
        with open(a.out, "w") as f:
            f.write(reports.html_report(api.Index(spark, a.runs_root, a.index).runs()))
    else:
        tail.materialize(tail.stream_lines(spark, a.folder), a.out, f"{a.out}/_checkpoint", a.service, "tail").awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
