"""Reports as JSON and Markdown. Reports are a few rows: they are rendered by the driver."""

from __future__ import annotations

import json
import math
import os
from typing import Any

from stillwater.functions.text import shown


def safe(value: Any) -> Any:
    """The value with non-finite numbers as strings, at any depth."""
    if isinstance(value, dict):
        return {str(k): safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [safe(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return "nan" if math.isnan(value) else "inf" if value > 0 else "-inf"
    return value


def write_json(value: Any, path: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(safe(value), f, indent=2, sort_keys=True)
        f.write("\n")
    return path


def read_json(path: str) -> Any:
    with open(path, encoding="utf-8-sig") as f:
        return json.load(f)


def table(rows: list[dict], columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    for row in rows:
        lines.append("| " + " | ".join(shown(v) if isinstance(v, float) or v is None else str(v) for v in (row.get(c) for c in columns)) + " |")
    return "\n".join(lines)


def listing(title: str, lines: list[str]) -> list[str]:
    """A section of a list; nothing without lines."""
    return [f"## {title}", "", *(f"- {line}" for line in lines), ""] if lines else []


def metrics_markdown(report: dict) -> str:
    """One report: a summary, a section for each group of metrics, and what is known of its reference and diagnostics."""
    known = report.get("metadata") or {}
    out = [f"# {report.get('algorithm', 'reconstruction')}", "", f"Mode: {known.get('benchmark_mode', 'unknown')}", ""]
    times = {name: known.get(f"{name}_runtime_s") for name in ("reconstruction", "evaluation")}
    out += listing("Runtime", [f"{name}: {shown(v)} s" for name, v in times.items() if v is not None])
    for section in ("image_similarity", "structural_accuracy", "frequency_recovery", "false_detail", "warp_recovery"):
        values = report.get(section)
        if not values:
            continue
        flat = {k: v for k, v in values.items() if not isinstance(v, (list, dict))}
        out += [f"## {section.replace('_', ' ').capitalize()}", "", table([{"metric": k, "value": v} for k, v in flat.items()], ["metric", "value"]), ""]
    out += listing("Reference limitations", [f"`{x}`" for x in known.get("reference_limitations") or []])
    factors = [f"`{f['level']}` `{f['source']}`: {f.get('description') or ''}" for f in report.get("uncertainty") or []]
    out += listing("Reference uncertainty", [f"Risk level: `{report.get('risk_level', 'unknown')}`", *factors] if factors else [])
    for section in ("reference_provenance", "reference_generation", "diagnostics"):
        values = (report if section == "diagnostics" else known).get(section) or {}
        out += listing(section.replace("_", " ").capitalize(), [f"{k}: `{v}`" for k, v in values.items() if v is not None])
    return "\n".join(out)


def comparison_markdown(rows: list[dict], leaders: list[dict]) -> str:
    columns = ["rank", "algorithm", "score", "mse", "psnr_db", "ssim_global", "gradient_correlation", "correlation_0_5_limit_fraction", "unsupported_energy_fraction"]
    return "\n".join(["# Comparison", "", table(rows, columns), "", "## Leaders", "", table(leaders, ["metric", "algorithm", "value"]), ""])
