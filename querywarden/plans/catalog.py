"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["inventory", "metadata", "enrichment", "assessment", "reports", "scalars", "extraction", "streams", "scans"]

for _name in MODULES:
    import_module(f"querywarden.plans.{_name}")

from querywarden.plans.registry import ORACLES, QUERIES  # noqa: E402

__all__ = ["ORACLES", "QUERIES"]
