"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "search_queries", "entity_queries", "scan_queries", "queue_queries", "analysis_queries", "converse_queries", "maintenance_queries")


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"foliant.plans.{module}")
