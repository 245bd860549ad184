"""Imports every query module so the registry is complete."""

from __future__ import annotations

import importlib

from .registry import QUERIES

MODULES = ["q_anomaly", "q_audit", "q_decisions", "q_revocations", "q_compliance", "q_access", "q_nested", "q_documents"]


def load() -> dict:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")
    return QUERIES
