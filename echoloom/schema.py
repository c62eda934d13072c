"""Record types as Spark schemas."""

KINDS = ("file", "class", "function", "method")
SYMBOL = "kind string, file_path string, signature string, start_line int, end_line int, raw_code string"
RECORD = f"{SYMBOL}, normalized_code string, md5sum string, intent string, intent_status string, intent_error string"
STORED_RECORD = f"record_id long, run_id long, {RECORD}"
RUN = "run_id long, started_at string, finished_at string, root_path string, provider_url string, model string, scope string, progress_batch_size int, status string, analyzer_error_count int, intent_failed_count int, record_count int"
