"""Explicit schemas; nothing here is inferred from data."""

from pyspark.sql import types as T

SPAN_DDL = (
    "trace_id string, span_id bigint, parent_span_id bigint, project_id string, service_id string, environment_id string, "
    "http_method string, http_path string, http_route string, http_status int, http_host string, start_time timestamp, "
    "start_time_ns bigint, duration_us bigint, src_ip string, src_port int, dst_ip string, dst_port int, dst_service_id string, "
    "host_id string, container_id string, is_error boolean, is_root boolean, sample_rate float, arrival_seq bigint"
)
TCP_EVENT_DDL = "seq bigint, timestamp_ns bigint, pid bigint, netns bigint, fd bigint, kind string, src_ip string, src_port int, dst_ip string, dst_port int, payload binary"
MAPPING_DDL = "netns bigint, project_id string, service_id string, service_name string, environment_id string, container_id string"
RULE_DDL = (
    "id string, project_id string, name string, service_id string, rule_type string, metric string, operator string, value double, "
    "window_secs bigint, min_requests bigint, baseline_window_secs bigint, evaluation_window_secs bigint, z_score_threshold double, "
    "change_threshold_pct double, severity string, enabled boolean, cooldown_secs bigint"
)
ALERT_DDL = "id string, rule_id string, rule_name string, project_id string, service_id string, severity string, status string, message string, metric_value double, threshold_value double, fired_at timestamp, resolved_at timestamp"
INSPECT_DDL = "array<struct<Id:string,Name:string,State:struct<Pid:bigint,Running:boolean>,Config:struct<Labels:map<string,string>>>>"


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
