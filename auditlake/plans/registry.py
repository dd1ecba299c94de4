"""All registered queries with the SQL they are checked against."""

from __future__ import annotations

from auditlake.plans import (
    catalog_queries,
    check_queries,
    history_queries,
    metric_queries,
    pii_queries,
    transcript_queries,
    trend_queries,
)

ALL = {
    **transcript_queries.QUERIES,
    **check_queries.QUERIES,
    **pii_queries.QUERIES,
    **metric_queries.QUERIES,
    **catalog_queries.QUERIES,
    **history_queries.QUERIES,
    **trend_queries.QUERIES,
}

FLAGSHIP = "run_metrics"

# Timed by bench.py: each family once, on the tables that grow most.
HEADLINE = (
    "run_metrics", "run_metrics_items", "checks_dispatched", "check_phrases_turn_by_turn", "check_tool_calls",
    "documents_no_pii_leak", "documents_regex", "pii_document_profile", "pii_message_profile", "redacted_documents",
    "redacted_messages", "violations_by_regulation", "price_percentiles", "usage_metrics", "budget_cost",
    "attempt_outcomes", "history_latest_saves", "unknown_regulations", "redacted_turns", "redacted_artifacts",
    "redacted_flat_json", "audit_rows",
)
