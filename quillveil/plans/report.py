"""Reports over summaries that are already small: Markdown texts."""

from __future__ import annotations

import json
from typing import Any


def _lines(*parts: Any) -> str:
    return "\n".join(str(p) for p in parts) + "\n"


def evidence(pack: dict[str, Any]) -> str:
    summary, policy = pack["summary"], pack["policy"]
    return _lines(
        "# Evidence pack", "", f"Generated: {pack['generated_at']}", f"Run: `{pack['run_dir']}`", f"Policy: `{policy['name']}`", f"Summary source: `{pack['summary_source']}`",
        f"Overall status: `{summary.get('status', 'UNKNOWN')}`", f"Failed checks: `{summary.get('failed', 'unknown')}`", "", "## Policy", "", f"- Description: {policy['description']}",
        f"- Required metadata: {', '.join(policy['required_metadata'])}", "", "## Source files", "", "- Machine-readable summary: `evidence-summary.json`", f"- Evidence source: `{pack['summary_source']}`",
    )


def _counts(title: str, counts: dict[str, int]) -> list[str]:
    return [title, *(f"- {k}: {v}" for k, v in sorted(counts.items())), ""] if counts else []


def benchmark(summary: dict[str, Any]) -> str:
    """A run's configuration, throughput, latency, counts and leaks."""
    latency = summary.get("latency_ms") or summary.get("batch_latency_ms") or {}
    return _lines(
        "# Redaction run", "", f"Generated: {summary.get('generated_at', 'unknown')}", f"Status: {summary.get('status', 'unknown')}", "", "## Configuration", "", f"- Backend: {summary.get('backend', 'unknown')}",
        f"- Audit mode: {summary.get('audit_mode', 'n/a')}", f"- Documents: {summary.get('documents', 'n/a')}", "", "## Throughput", "", f"- Total seconds: {summary.get('total_seconds', 0):.4f}",
        f"- Docs/sec: {summary.get('docs_per_second', 0.0):,.2f}", f"- Estimated docs/day: {summary.get('docs_per_day', 0.0):,.2f}", "", "## Latency", "",
        *(f"- {k}: {latency.get(k, 0):.4f} ms" for k in ("min", "mean", "median", "p95", "max")), "", "## Correctness", "",
        *_counts("Expected valid labels:", summary.get("expected_valid_counts", {})), *_counts("Detected labels:", summary.get("detected_counts", {})), "## Privacy", "",
        f"- Leaks checked: {sum(summary.get('leak_checked_counts', {}).values())}", f"- Leaks: {summary.get('leak_count_total', 0)}", *(f"- {k}: {v}" for k, v in sorted(summary.get("leak_counts", {}).items())),
    )


def review_pack(records: list[dict[str, Any]], backend: str = "regex") -> str:
    """Samples side by side for a reviewer; the caller bounds their number."""
    out = ["# Review pack", "", f"Backend: `{backend}`", f"Documents: `{len(records)}`", "", "Note what was redacted wrongly, and what should have been redacted. Paste no real personal data into this file.", ""]
    for k, r in enumerate(records, 1):
        table, labels = (json.dumps(r.get(key, []), indent=2, sort_keys=True, default=str) for key in ("detected", "expected"))
        out += [f"## Sample {k}: {r['document_id']}", "", "```text", r["redacted_text"], "```", "", "Detected:", "", "```json", table, "```", "", "Expected:", "", "```json", labels, "```", "", "False positives:", "", "False negatives:", ""]
    return _lines(*out)


def production_gate(summary: dict[str, Any]) -> str:
    """The verdicts of a release's checks as a table."""
    rows = [f"| `{c['name']}` | `{c['status']}` | {c.get('documents', 0)} docs, {c.get('failed', 0)} failed |" for c in summary["checks"]]
    return _lines("# Production gate", "", f"Generated: {summary.get('generated_at', 'unknown')}", f"Overall: `{summary['status']}`", "", "| Check | Status | Details |", "|---|---|---|", *rows)
