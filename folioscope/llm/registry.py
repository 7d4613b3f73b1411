"""Queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

import importlib

MODULES = ("token_tree", "decontaminate", "jaccard_join", "url_rules", "cap_filters", "language_id", "license_scan", "toxicity", "quote_links", "bpe_codec")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"{__package__}.{m}").ORACLES.items()}
