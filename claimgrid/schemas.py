"""Column types of the stored relations. Money is decimal(12,2), times are UTC."""

SCHEMAS: dict[str, str] = {
    "claims": (
        "claim_id bigint, claim_tracking_number string, claim_amount decimal(12,2), "
        "max_benefit decimal(12,2), security_deposit_amount decimal(12,2), policyholder_id string, "
        "property_id string, claim_date date, move_out_date date, lease_start_date date, "
        "lease_end_date date, status string, priority int, created_at timestamp, "
        "updated_at timestamp, created_by string, updated_by string, deleted_at timestamp"
    ),
    "claim_documents": (
        "document_id bigint, claim_id bigint, file_path string, original_filename string, "
        "file_hash string, file_size_bytes bigint, mime_type string, document_type string, "
        "classification_confidence double, extracted_text string, ocr_confidence double, "
        "page_count int, processing_status string, created_at timestamp, deleted_at timestamp"
    ),
    "decisions": (
        "decision_id bigint, claim_id bigint, decision_type string, proposed_status string, "
        "proposed_benefit_amount decimal(12,2), eligible_total decimal(12,2), "
        "invoice_total decimal(12,2), cap_amount decimal(12,2), approved_line_items string, "
        "ineligible_line_items string, flags string, missing_data string, "
        "confidence_score double, engine_version string, processing_time_ms int, "
        "decided_by string, decided_at timestamp, superseded_by bigint, is_active boolean"
    ),
    "decision_validation": (
        "validation_id bigint, claim_id bigint, decision_id bigint, actual_status string, "
        "actual_paid_amount decimal(12,2), actual_decision_date date, adjudication_notes string, "
        "adjudicator_id string, validation_source string"
    ),
    "decision_audit_log": (
        "decision_id bigint, claim_id bigint, action string, user_id string, old_values string, "
        "new_values string, created_at timestamp"
    ),
    "processing_queue": (
        "queue_id bigint, batch_id string, claim_id bigint, priority int, status string, "
        "error_message string, scheduled_at timestamp, started_at timestamp, "
        "completed_at timestamp, worker_id string"
    ),
    "user_line_item_overrides": (
        "override_id bigint, decision_id bigint, claim_id bigint, line_item_index int, "
        "line_item_description string, line_item_amount decimal(12,2), "
        "system_should_be_included boolean, system_reasoning string, system_confidence double, "
        "user_should_be_included boolean, user_reasoning string, user_id string, "
        "override_timestamp timestamp, batch_id string, is_applied_to_rules boolean"
    ),
    "rules_changelog": (
        "version string, released_at timestamp, changes_summary string, author string, "
        "is_breaking_change boolean"
    ),
}
