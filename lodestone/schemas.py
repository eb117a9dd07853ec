"""The control-plane tables: column types and the rules their rows keep.

Fixed values: names, types, ranges and enumerations are part of the stored format.
Parquet enforces none of the rules, so :func:`violations` reports broken ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import constraints as K

TABLES = {
    "service": "id string, name string, tier short, owner_team string, runtime string, region string, created_at timestamp",
    "service_dependency": "upstream_id string, downstream_id string, kind string",
    "telemetry_event": "id long, service_id string, observed_at timestamp, kind string, name string, value double, payload string",
    "incident": "id string, service_id string, title string, signature string, severity short, status string, opened_at timestamp, resolved_at timestamp, seed long",
    "document": "id string, kind string, title string, source_uri string, created_at timestamp",
    "chunk": "id string, document_id string, ordinal int, heading string, body string, token_count int",
    "chunk_embedding": "chunk_id string, model string, dim int, vec array<double>, created_at timestamp",
    "session": "id string, ip_hash string, created_at timestamp, last_seen_at timestamp",
    "memory_item": "id long, session_id string, kind string, content string, created_at timestamp",
    "run": "id string, incident_id string, session_id string, parent_run_id string, status string, verdict string, confidence double, degraded boolean, tokens_in int, tokens_out int, cost_usd decimal(12,6), started_at timestamp, ended_at timestamp",
    "span": "id string, run_id string, parent_span_id string, trace_id string, name string, kind string, status string, started_at timestamp, ended_at timestamp, attributes string",
    "citation": "id long, run_id string, claim_text string, chunk_id string, score double, ordinal int",
    "approval": "id long, run_id string, action string, risk_level string, requested_at timestamp, decision string, decided_at timestamp, decided_by string",
    "cache_entry": "id long, prompt_hash string, embedding_model string, model_tier string, prompt_vec array<double>, response string, tokens_in int, tokens_out int, hits int, created_at timestamp",
    "provider_event": "id long, provider string, event string, detail string, latency_ms int, occurred_at timestamp",
    "spend_ledger": "id long, run_id string, provider string, model string, estimated_cost_usd decimal(12,6), actual_cost_usd decimal(12,6), tokens_in int, tokens_out int, cache_hit boolean, occurred_at timestamp",
    "eval_run": "id long, suite string, git_sha string, metrics string, passed boolean, warned boolean, started_at timestamp",
    "schema_migration": "version int, name string, checksum string, applied_at timestamp",
}

CHECKS = {
    "service": ["tier BETWEEN 0 AND 3"],
    "service_dependency": ["kind IN ('sync', 'async', 'datastore')", "upstream_id <> downstream_id"],
    "telemetry_event": ["kind IN ('metric', 'log', 'trace')"],
    "incident": ["severity BETWEEN 1 AND 4", "status IN ('open', 'triaging', 'mitigated', 'resolved')", "resolved_at IS NULL OR resolved_at >= opened_at"],
    "document": ["kind IN ('runbook', 'postmortem', 'policy', 'architecture')"],
    "chunk": ["length(body) > 0", "token_count > 0"],
    "chunk_embedding": ["dim > 0", "size(vec) = dim"],
    "session": ["length(ip_hash) = 64"],
    "memory_item": ["kind IN ('fact', 'preference', 'incident_ref')"],
    "run": ["status IN ('running', 'completed', 'refused', 'escalated', 'awaiting_approval', 'failed', 'incomplete')", "confidence IS NULL OR confidence BETWEEN 0 AND 1", "tokens_in >= 0", "tokens_out >= 0", "cost_usd >= 0", "ended_at IS NULL OR ended_at >= started_at"],
    "span": ["kind IN ('internal', 'client', 'server', 'producer', 'consumer')", "status IN ('unset', 'ok', 'error')", "ended_at IS NULL OR ended_at >= started_at"],
    "citation": ["length(claim_text) > 0"],
    "approval": ["risk_level IN ('low', 'medium', 'high', 'critical')", "decision IN ('approved', 'rejected')", "(decision IS NULL) = (decided_at IS NULL)", "(decision IS NULL) = (decided_by IS NULL)"],
    "cache_entry": ["model_tier IN ('fast', 'large')", "tokens_in >= 0", "tokens_out >= 0", "hits >= 0"],
    "provider_event": ["event IN ('success', 'rate_limit', 'error', 'disabled', 'reenabled', 'injected_failure')", "latency_ms IS NULL OR latency_ms >= 0"],
    "spend_ledger": ["estimated_cost_usd >= 0", "actual_cost_usd IS NULL OR actual_cost_usd >= 0"],
    "eval_run": ["suite IN ('core', 'probe')"],
}

KEYS = {
    "service": [("id",), ("name",)],
    "service_dependency": [("upstream_id", "downstream_id")],
    "incident": [("id",)],
    "document": [("id",)],
    "chunk": [("id",), ("document_id", "ordinal")],
    "chunk_embedding": [("chunk_id", "model")],
    "session": [("id",)],
    "run": [("id",)],
    "span": [("id",)],
    "approval": [("run_id",)],
    "cache_entry": [("prompt_hash", "embedding_model", "model_tier")],
    "schema_migration": [("version",)],
}

# child column -> parent table (its id)
REFERENCES = {
    "service_dependency": {"upstream_id": "service", "downstream_id": "service"},
    "telemetry_event": {"service_id": "service"},
    "incident": {"service_id": "service"},
    "chunk": {"document_id": "document"},
    "chunk_embedding": {"chunk_id": "chunk"},
    "memory_item": {"session_id": "session"},
    "run": {"incident_id": "incident", "session_id": "session", "parent_run_id": "run"},
    "span": {"run_id": "run", "parent_span_id": "span"},
    "citation": {"run_id": "run", "chunk_id": "chunk"},
    "approval": {"run_id": "run"},
    "spend_ledger": {"run_id": "run"},
}


def rules(name: str, tables: dict[str, DataFrame]) -> list:
    found: list = [K.Check(f"{name}: {text}", F.expr(text)) for text in CHECKS.get(name, [])]
    found += [K.Unique(f"{name}: unique {', '.join(k)}", k) for k in KEYS.get(name, [])]
    found += [
        K.Reference(f"{name}: {column} in {parent}", (column,), tables[parent], ("id",))
        for column, parent in REFERENCES.get(name, {}).items()
        if parent in tables
    ]
    return found


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """``(rule, n)`` of every broken rule over the tables given."""
    unknown = tables.keys() - TABLES.keys()
    if unknown or not tables:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    out: DataFrame | None = None
    for name, frame in tables.items():
        part = K.violations(frame, rules(name, tables))
        out = part if out is None else out.unionByName(part)
    return out
