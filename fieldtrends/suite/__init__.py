"""Registered queries over the driver tables, each with an independent SQL statement where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["cleaning", "places", "selection", "trend", "occupancy", "resolution", "status", "reports", "keys", "releases"]


def load():
    from fieldtrends.suite import registry

    for m in MODULES:
        import_module(f"fieldtrends.suite.{m}")
    return registry.QUERIES, registry.SQL
