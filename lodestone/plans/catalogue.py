"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = [
    "text_and_lexical", "retrieval", "statistics", "storage_and_graph", "control_plane",
    "questions_and_telemetry", "streams_and_sets",
]


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"lodestone.plans.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLE")
