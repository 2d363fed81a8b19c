"""Markdown and HTML reports, rendered on the driver from top-N frames."""

from __future__ import annotations

import html
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell(v) -> str:
    return "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")


def duration(seconds: float | None) -> str:
    if seconds is None:
        return "open"
    for limit, unit, size in ((1, "ms", 0.001), (60, "s", 1), (3600, "m", 60)):
        if seconds < limit:
            return f"{seconds / size:.0f} {unit}"
    return f"{seconds / 3600:.1f} h"


def table(df: DataFrame, n: int) -> list[str]:
    """The first n rows as a Markdown table."""
    rows = df.limit(n).collect()
    if not rows:
        return ["None.", ""]
    return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""]


def compare_report(compared: DataFrame) -> Iterator[str]:
    """Lines of a comparison, one section per kind, new errors first; all rows, passed through one partition at a time."""
    n = dict(compared.groupBy("kind").count().collect())
    yield from ("# Comparison", "")
    for kind, title in (("new", "New errors"), ("fixed", "Fixed errors"), ("frequency", "Frequency increases")):
        yield from (f"## {title} ({kind}): {n.get(kind, 0)}", "")
        if not n.get(kind):
            yield from ("None.", "")
            continue
        part = compared.where(F.col("kind") == kind).drop("kind").orderBy(F.desc("right_count"), F.desc("left_count"), "template_id")
        yield from ("| " + " | ".join(part.columns) + " |", "|" + " --- |" * len(part.columns))
        for r in part.toLocalIterator():
            yield "| " + " | ".join(map(cell, r)) + " |"
        yield ""


def scan_report(meta: dict, scan) -> str:
    cols = ["template_id", "severity_text", "event_count", "issue_kind", "normalized_template"]
    top = lambda d: d.select(*cols).orderBy(F.desc("event_count"), "template_id")
    out = [f"# Report: {meta['run_id']}", "", "## Summary", "", *(f"- {k}: {meta[k]}" for k in ("event_count", "template_count", "error_count")), ""]
    for k in sorted(x for x in meta if x.endswith("_counts")):
        out += [f"## {k.replace('_', ' ')}", "", *(f"- {a or '(none)'}: {n}" for a, n in sorted(meta[k].items())), ""]
    for title, d in (("Code issues", scan.templates.where("issue_kind = 'code'")), ("Infrastructure issues", scan.templates.where("issue_kind = 'infra'")), ("Warnings", scan.templates.where("severity_text = 'WARNING'"))):
        out += [f"## {title}", "", *table(top(d), 20)]
    out += ["## Outages", "", *table(scan.incidents.orderBy("down_us"), 20), "## Busiest restarts", "", *table(scan.instances.orderBy(F.desc("event_count")), 5)]
    return "\n".join(out + ["## Error templates", "", *table(top(scan.errors), 30), "## Top templates", "", *table(top(scan.templates), 20)])


def diff_report(summary: DataFrame, findings: DataFrame) -> str:
    out = ["# Diff", "", *table(summary.orderBy("run_id"), 1000)]
    for kind in ("code_error", "new_template", "regressed_template", "severity_shifted", "missing_template", "policy_violation", "pinned_missing"):
        out += [f"## {kind}", "", *table(findings.where(F.col("kind") == kind).orderBy(F.desc("observed_count"), "template_id"), 30)]
    return "\n".join(out)


def html_report(summary: DataFrame) -> str:
    rows = summary.orderBy("run_id").toLocalIterator()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in summary.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(cell(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset='utf-8'><title>Runs</title><table><tr>{head}</tr>{body}</table>"


def changelog(path: str, section: str) -> None:
    """Put a section in front of a changelog file."""
    try:
        with open(path) as f:
            old = f.read()
    except FileNotFoundError:
        old = ""
    with open(path, "w") as f:
        f.write(section.rstrip() + "\n\n" + old)
