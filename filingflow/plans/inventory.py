"""SURVEY §2 inventory id -> the catalogue keys that implement and check it."""

from __future__ import annotations

INVENTORY: dict[str, tuple[str, ...]] = {
    # 2.1 scans, sources, sinks
    "S1": ("listing_page_scan", "normalise_listing"),  # scan, then Job N (N1-N8 together)
    "S2": ("attachment_scan",),
    "S3": ("document_scan", "landed_page_scan"),
    "S4": ("registry_scan",),
    "S5": ("legacy_config_scan",),
    "S7": ("listing_csv_export",),
    "S8": ("collective_report_sink",),
    "S9": ("run_result_sink",),
    # 2.2 projections, filters
    "F1": ("search_reports",),
    "F2": ("search_files",),
    "F3": ("file_by_name",),
    "F4": ("search_summary_reports",),
    "F5": ("browse_summary_reports",),
    "F6": ("summary_report_by_id",),
    "F7": ("search_execution_log",),
    "F8": ("list_jobs",),
    "F9": ("job_by_name",),
    "F10": ("recent_searches", "recent_searches_display"),
    "F11": ("company_lookup",),
    "F12": ("list_companies",),
    "F13": ("listing_filter",),
    "F14": ("file_type_filter",),
    "F15": ("required_field_check",),
    "F16": ("execution_history",),
    # 2.3 joins
    "J1": ("resolve_company",),
    "J2": ("company_stats_view",),
    "J3": ("active_jobs",),
    "J4": ("new_files_only",),
    "J5": ("unmigrated_configs",),
    "J6": ("job_activation",),
    "J7": ("attach_summaries",),
    "J8": ("attach_report_id",),
    "J9": ("zip_attachments",),
    "J10": ("execution_with_summary",),
    "J11": ("execution_summary_resolve",),
    "J12": ("referential_delete", "referential_delete_reports", "set_null_on_summary_delete"),
    # 2.4 aggregations
    "A1": ("company_stats",),
    "A2": ("company_file_stats",),
    "A3": ("active_jobs_summary_count",),
    "A4": ("next_jobs",),
    "A5": ("file_exists",),
    "A6": ("run_counts",),
    "A7": ("concat_summaries",),
    "A8": ("job_run_stats",),
    "A9": ("report_tags",),
    # 2.5 windows
    "W1": ("last_status_per_job",),
    "W2": ("filing_and_file_ordinals",),
    "W3": ("first_arrival_dedup",),
    "W4": ("file_i_of_n",),
    "W5": ("nearest_chunk_per_cluster",),
    # 2.6 sorts, limits (T1/T2 are the orders inside these)
    "T1": ("search_reports", "search_execution_log", "recent_searches", "search_summary_reports"),
    "T2": ("list_jobs", "list_companies", "company_stats"),
    "T3": ("per_request_limit",),
    # 2.7 writes
    "U1": ("insert_company",),
    "U2": ("append_reports",),
    "U3": ("register_files",),
    "U4": ("update_file_summary",),
    "U5": ("upsert_jobs", "jobs_snapshot",),
    "U6": ("update_run_stats",),
    "U7": ("delete_jobs", "delete_jobs_existed"),
    "U8": ("start_execution",),
    "U9": ("close_execution",),
    "U10": ("append_search",),
    "U11": ("append_summary_report",),
    "U12": ("set_enabled",),
    "U13": ("log_finished_run", "bump_finished_jobs"),
    "U14": ("add_report_limit",),
    "U15": ("migrate_v1_names",),
    "U16": ("migrate_legacy_configs", "migrated_job_state"),
    # 2.8 scalar logic
    "N1": ("split_header",),
    "N2": ("report_type_enum",),
    "N3": ("report_category_enum",),
    "N4": ("change_value",),
    "N5": ("price_value",),
    "N6": ("title_or_untitled",),
    "N7": ("absolute_link",),
    "N8": ("parse_date_text",),
    "N9": ("format_date_input",),
    "N10": ("date_request_check",),
    "N11": ("range_from_to",),
    "N12": ("filing_and_file_ordinals",),
    "N13": ("wanted_attachment",),
    "N14": ("md5_of_content",),
    "N15": ("human_formats", "execution_history", "browse_summary_reports"),
    "N16": ("json_list_codec",),
    "K1": ("job_row_errors",),
    "K2": ("cron_check",),
    "K5": ("next_fire_time",),
    # 2.9 documents
    "D1": ("chunk_documents", "chunk_documents_1000"),
    "D2": ("size_tier",),
    "D3": ("empty_document",),
    "D4": ("too_few_chunks",),
    "D5": ("embed_chunks",),
    "D6": ("cluster_chunks",),
    "D7": ("select_representatives",),
    "D8": ("build_prompts",),
    "D9": ("summarise_batch",),
    "D10": ("collective_overview",),
    "D11": ("write_back_summaries",),
    "D12": ("pipeline_result", "pipeline_rejected", "pipeline_files", "pipeline_overview", "pipeline_report"),
    # 2.10 streaming
    "R1": ("incremental_feed", "feed_rejects"),
    "R2": ("streaming_registry",),
    "R3": ("execution_pairing",),
}
