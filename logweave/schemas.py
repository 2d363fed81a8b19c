"""Schemas of the tables, fixed and declared."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


EVENTS = _schema(
    event_id=_S, run_id=_S, source=_S, offset=_L, line_count=_L, timestamp=_S, observed_timestamp=_S, severity_text=_S, severity_number=_L, body=_S,
    normalized_template=_S, template_id=_S, error_kind=_S, exception_type=_S, parse_format=_S, parse_status=_S, classification=_S, classification_reason=_S,
    service_name=_S, service_instance_id=_S, worker_id=_S, thread_name=_S, process_name=_S, process_pid=_L, server_kind=_S, trace_id=_S, span_id=_S,
    container_id=_S, k8s_pod_name=_S, k8s_container_name=_S, attributes_json=_S, resource_json=_S, raw_hash=_S, raw=_S, service_instance_seq=_L,
    service_instance_started_at=_S, issue_kind=_S,
)
TEMPLATES = _schema(
    template_id=_S, service_name=_S, severity_text=_S, severity_number=_L, normalized_template=_S, error_kind=_S, exception_type=_S, event_count=_L,
    first_seen=_S, last_seen=_S, example_event_id=_S, parse_status=_S, classification=_S, classification_reason=_S, baseline_match=_B, issue_kind=_S,
)
BASELINE = _schema(
    service_name=_S, scenario=_S, template_id=_S, normalized_template=_S, severity_text=_S, issue_kind=_S, mean_count=_D, std_count=_D, p50_count=_D,
    p95_count=_D, p99_count=_D, min_count=_L, max_count=_L, runs_in_baseline=_L, baseline_version=_S, last_updated=_S,
)
TEMPLATE_REGISTRY = _schema(
    service_name=_S, template_id=_S, normalized_template=_S, severity_text=_S, severity_number=_L, issue_kind=_S, error_kind=_S, exception_type=_S,
    first_seen_run_id=_S, last_seen_run_id=_S, first_seen_at=_S, last_seen_at=_S, runs_seen_count=_L, green_runs_seen_count=_L, total_event_count=_L,
)
OVERRIDES = _schema(service_name=_S, scenario=_S, template_id=_S, decision=_S, reason=_S, set_by=_S, set_at=_S)
