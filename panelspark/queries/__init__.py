"""Registered queries: name -> (Spark function, SQL text or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("cleaning", "windows", "calendar", "weather", "spatial", "forecast_error", "scoring", "audits", "sources", "matrix", "models", "streams")


def registered() -> dict:
    out: dict = {}
    for name in MODULES:
        for key, entry in import_module(f"panelspark.queries.{name}").QUERIES.items():
            if key in out:
                raise ValueError(f"query {key} is registered twice")
            out[key] = entry
    return out
