"""All queries of the document operators with their SQL."""

from __future__ import annotations

import importlib

from docblocks.plans.registry import ORACLES, QUERIES

for _name in ("text", "rules", "ordered", "tables", "markdown", "readers", "watch", "grammar", "nested"):
    importlib.import_module(f"docblocks.plans.{_name}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
