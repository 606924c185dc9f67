"""Schemas of the engine's tables, as DDL."""

COMMANDS = "id bigint, ts timestamp, original_cmd string, filtered_cmd string, input_tokens bigint, output_tokens bigint, saved_tokens bigint, savings_pct double, exec_time_ms bigint, project_path string, project_name string, session_id string, parse_tier int, format_mode string, execution_kind string"
PARSE_FAILURES = "id bigint, ts timestamp, raw_command string, error_message string, fallback_succeeded boolean, project_path string"
TOOL_CALLS = "source string, session_id string, sequence_index bigint, command string, output_len bigint, output_content string, is_error boolean"
USAGE_PERIODS = "granularity string, key string, input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint, total_tokens bigint, total_cost double"
HOOK_AUDIT = "ts timestamp, action string, original_cmd string, rewritten_cmd string"
CORRECTIONS = "wrong string, right string"
