"""Classification: declarative rules, baselines, issue kinds and error views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_LEVELS = ("ERROR", "CRITICAL", "FATAL")

# Exception classes of failing dependencies and of programming errors.
INFRA_EXCEPTIONS = (
    "KafkaError", "KafkaException", "BrokerNotAvailableError", "NetworkException", "ConnectionError", "ConnectionRefusedError", "ConnectionResetError",
    "ConnectionAbortedError", "TimeoutError", "ReadTimeout", "ReadTimeoutError", "ConnectTimeout", "ConnectTimeoutError", "BrokenPipeError", "OperationFailure",
    "AutoReconnect", "ServerSelectionTimeoutError", "NetworkTimeout", "DNSError", "ESConnectionError", "ESConnectionTimeout", "DisconnectionError",
)
CODE_EXCEPTIONS = (
    "AssertionError", "AttributeError", "KeyError", "IndexError", "TypeError", "ValueError", "NameError", "ZeroDivisionError", "RecursionError", "RuntimeError",
    "NotImplementedError", "ImportError", "ModuleNotFoundError", "UnboundLocalError", "SyntaxError", "IndentationError", "LookupError",
)
# Patterns of messages about dependencies, and about programming errors.
INFRA_PATTERNS = (
    r"(?i)\bbrokers?\s+are\s+down\b", r"(?i)\bconnection\s+refused\b", r"(?i)\bno\s+route\s+to\s+host\b", r"(?i)\bbroker\s+transport\s+failure\b",
    r"\b_ALL_BROKERS_DOWN\b", r"\b_TRANSPORT\b", r"\bGroupCoordinator\b", r"(?i)\bfailed\s+to\s+get\s+metadata\b",
    r"(?i)\bmongo(?:db)?\b.*\b(?:not\s+master|reconnect|topology|closed)\b", r"(?i)\bgetaddrinfo\b", r"(?i)\btemporary\s+failure\s+in\s+name\s+resolution\b",
    r"(?i)\belasticsearch\b.*\b(?:timeout|unreachable|refused)\b", r"(?i)\bredis\b.*\b(?:timeout|unreachable|refused)\b",
    r"(?i)\bkafka\b.*\b(?:rebalanc|reassign|coordinator)\b", r"(?i)\b(?:read|write)\s+timeout\b",
)
CODE_PATTERNS = (r"\bTraceback\s+\(most\s+recent\s+call\s+last\)\b", r"\b(?:in|line)\s+\d+,?\s+in\s+\w+", r"(?i)\bUnhandled\s+exception\b", r"(?i)\bassert(?:ion)?\s+(?:failed|error)\b")

#: Thresholds for what is unexpected, where a rule file gives none.
UNEXPECTED = {"new_error_severities": list(ERROR_LEVELS), "frequency_increase_ratio": 2.0, "min_count": 5}

#: The default catalogue of rules; the first that matches wins.
DEFAULT_RULES = {
    "known_noise": [
        {"id": "peer_went_away", "severity": ["WARNING", "ERROR"], "template_regex": "(BrokenPipeError|connection reset|client disconnected|ConnectionResetError)", "reason": "a client closed its connection"},
        {"id": "probe_timed_out", "severity": ["WARNING", "ERROR"], "template_regex": "(health.?check|readiness|liveness).*(timeout|disconnect)", "reason": "a health probe timed out"},
    ],
    "expected": [
        {"id": "log_level_at_start", "severity": ["INFO"], "template_contains": "LogLevel:", "reason": "a service tells its log level at start"},
        {"id": "scheduler_warning", "severity": ["WARNING"], "template_regex": "apscheduler|scheduler", "reason": "a scheduler warns"},
    ],
}


# Reasons where no rule gives one.
REASONS = {
    "baseline": "template_id exists in baseline",
    "unexpected": "new error template not found in baseline or expected rules",
    "observed": "non-error template observed in this run",
}


def load_rules(path: str) -> dict:
    """Rules from a YAML or JSON file of the form of :data:`DEFAULT_RULES`."""
    with open(path) as f:
        raw = f.read()
    try:
        import yaml

        data = yaml.safe_load(raw)
    except ImportError:
        import json

        data = json.loads(raw)
    return {**{k: list((data or {}).get(k) or []) for k in ("known_noise", "expected")}, "unexpected": {**UNEXPECTED, **((data or {}).get("unexpected") or {})}}


def rule_predicate(rule: dict, body: Column | None = None) -> Column:
    """Conjunction of a rule's conditions; without body a body condition never holds."""
    out = F.lit(True)
    for key in ("template_id", "service_name", "error_kind", "exception_type", "parse_status"):
        if rule.get(key) is not None:
            out = out & F.coalesce(F.col(key) == rule[key], F.lit(False))
    if rule.get("severity"):
        levels = [rule["severity"]] if isinstance(rule["severity"], str) else rule["severity"]
        out = out & F.coalesce(F.upper("severity_text").isin(*[s.upper() for s in levels]), F.lit(False))
    texts = {"template": F.coalesce("normalized_template", F.lit("")), "body": F.lit("") if body is None else F.coalesce(body, F.lit(""))}
    for what, c in texts.items():
        if rule.get(f"{what}_contains"):
            out = out & c.contains(rule[f"{what}_contains"])
        if rule.get(f"{what}_regex"):
            out = out & c.rlike(rule[f"{what}_regex"])
    return out


def _first_match(rules: Sequence[dict], field: str) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule_predicate(rule), F.lit(rule.get(field) or rule.get("id"))).otherwise(out)
    return out


def classify_templates(templates: DataFrame, baseline_ids: DataFrame | None = None, rules: dict = DEFAULT_RULES) -> DataFrame:
    """Add baseline_match, classification and classification_reason: known noise, expected, in the baseline, unexpected, observed, in this order."""
    df = templates.drop("baseline_match", "classification", "classification_reason")
    if baseline_ids is None:
        df = df.withColumn("baseline_match", F.lit(False))
    else:
        b = baseline_ids.select(F.col("template_id").alias("_b")).distinct()
        df = df.join(b, F.col("template_id") == F.col("_b"), "left").withColumn("baseline_match", F.col("_b").isNotNull()).drop("_b")
    noise, expected = _first_match(rules["known_noise"], "reason"), _first_match(rules["expected"], "reason")
    levels = [str(x).upper() for x in (rules.get("unexpected") or UNEXPECTED).get("new_error_severities", ERROR_LEVELS)]
    failing = F.coalesce(F.upper("severity_text").isin(*levels), F.lit(False)) | ~F.coalesce("error_kind", F.lit("")).isin("", "none")
    df = df.withColumn("_n", noise).withColumn("_e", expected).withColumn("_x", failing)
    kind = F.when(F.col("_n").isNotNull(), "known-noise").when(F.col("_e").isNotNull() | F.col("baseline_match"), "expected").when(F.col("_x"), "unexpected").otherwise("observed")
    reason = F.coalesce("_n", "_e", F.when(F.col("baseline_match"), REASONS["baseline"]).when(F.col("_x"), REASONS["unexpected"]).otherwise(REASONS["observed"]))
    return df.withColumn("classification", kind).withColumn("classification_reason", reason).drop("_n", "_e", "_x")


def any_of(patterns: Sequence[str]) -> str:
    """One pattern for several, each with its own case flag: one match instead of many keeps the generated code small."""
    return "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns)


def issue_kind(text: Column, exception: Column, kind: Column, severity: Column) -> Column:
    """``infra``, ``code`` or ``unknown`` from exception class, message, error kind and severity, in this order."""
    body = F.coalesce(text, F.lit(""))
    out = F.when(exception.isin(*INFRA_EXCEPTIONS), "infra").when(exception.isin(*CODE_EXCEPTIONS), "code")
    for patterns, name in ((INFRA_PATTERNS, "infra"), (CODE_PATTERNS, "code")):
        out = out.when(body.rlike(any_of(patterns)), name)
    return out.when(kind == "traceback", "code").when(F.upper(severity).isin(*ERROR_LEVELS), "code").otherwise("unknown")


def error_predicate(classes: Sequence[str] = ("unexpected", "known-noise"), fold: bool = False) -> Column:
    """Failing severity (``fold``: in any letter case), or an error kind, or one of the classes."""
    level = F.upper("severity_text") if fold else F.col("severity_text")
    return F.coalesce(level.isin(*ERROR_LEVELS), F.lit(False)) | ~F.coalesce("error_kind", F.lit("none")).isin("", "none") | F.coalesce(F.col("classification").isin(*classes), F.lit(False))


def focus(templates: DataFrame, what: str) -> DataFrame:
    """Templates of one report focus: ``code``, ``infra``, ``warnings`` or ``all``."""
    if what in ("code", "infra"):
        return templates.where(F.col("issue_kind") == what)
    return templates.where(F.col("severity_text") == "WARNING") if what == "warnings" else templates


def matching(templates: DataFrame, needle: str) -> DataFrame:
    """Free-text search, ignoring case, over exception, error kind, template and id."""
    n = needle.lower()
    hit = F.lit(False)
    for c in ("exception_type", "error_kind", "normalized_template", "template_id"):
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(n)), F.lit(False))
    return templates.where(hit)
