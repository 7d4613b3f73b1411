"""All queries of the engine's own operators, by name, and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("plans.rollups", "operators.sheets", "operators.summaries", "operators.sequence", "operators.rules", "operators.calculations", "sources.samples", "sinks.roundtrips", "operators.drawings", "streaming.rollups")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__package__}.{m}").ORACLES.items()}
