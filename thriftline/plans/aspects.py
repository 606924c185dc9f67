"""Queries that show one expression or step of another query by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thriftline.plans import corrections, discovery, economics, extraction, listings, reduction, sections, streams, telemetry  # noqa: F401
from thriftline.plans.registry import ORACLE, QUERIES

#: Query, the query that computes it among others, and its columns.
ASPECTS = (
    ("fn_estimate_tokens", "fn_numbers", "id tokens"),
    ("fn_savings", "fn_numbers", "id saved"),
    ("fn_compare_savings", "fn_numbers", "id pct"),
    ("fn_format_tokens", "fn_numbers", "id shown_tokens"),
    ("fn_format_duration", "fn_numbers", "id shown_time"),
    ("fn_is_command_error", "fn_errors", "session_id sequence_index failed"),
    ("fn_error_class", "fn_errors", "session_id sequence_index error_class"),
    ("fn_is_tdd_error", "fn_errors", "session_id sequence_index cycle"),
    ("fn_base_command_learn", "fn_command_similarity", "session_id sequence_index base"),
    ("fn_diff_token", "agg_correction_rules", "base_command error_class diff_token wrong_pattern right_pattern"),
    ("fn_base_command_audit", "agg_top_rewrites", "base_cmd entries"),
    ("fn_log_severity", "fn_log_normalize", "output_id line_no severity"),
    ("fn_line_kind", "fn_log_normalize", "output_id line_no kind"),
    ("fn_error_pattern", "fn_log_normalize", "output_id line_no is_error"),
    ("fn_adaptive_level", "agg_output_summary", "output_id tokens lines level"),
    ("fn_output_action", "agg_output_summary", "output_id tokens action"),
    ("fn_strip_env_prefix", "fn_unwrap_runner", "part clean"),
    ("fn_display_command", "fn_unwrap_runner", "part shown"),
    ("fn_base_command_discover", "join_classify_rules", "session_id sequence_index part_index base_cmd"),
    ("flt_ignored_command", "join_classify_rules", "session_id sequence_index part_index kind"),
    ("join_subcmd_override", "join_classify_rules", "session_id sequence_index part_index pct status"),
    ("join_call_result", "src_session_a", "session_id sequence_index output_len is_error"),
    ("win_sequence_index", "src_session_a", "session_id sequence_index command"),
    ("set_union", "src_union_sources", "source calls"),
    ("fn_compact_path", "fn_paths", "id compact"),
    ("fn_shorten_path", "fn_paths", "id short"),
    ("fn_filter_language", "fn_paths", "id language"),
    ("fn_glob_match", "fn_paths", "id globbed"),
    ("fn_validate_reduction", "agg_benchmark", "status pairs"),
    ("win_block_header", "ext_cargo_build", "output_id file line severity"),
)


def _aspect(name: str, of: str, columns: list[str]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return QUERIES[of](spark, sf).select(*columns)

    run.__name__, run.__doc__ = name, f"{' '.join(columns)} of {of}."
    QUERIES[name] = run
    ORACLE[name] = f"SELECT {', '.join(columns)} FROM (\n{ORACLE[of]}\n)"


for _name, _of, _columns in ASPECTS:
    _aspect(_name, _of, _columns.split())
