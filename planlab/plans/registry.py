"""All registered queries: name -> (callable(spark, directory), checking SQL or None)."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("tpch", "basics", "featured", "sequenced", "sampled", "learned", "settled", "filed", "jobbed")


def all_queries() -> dict:
    merged: dict = {}
    for family in FAMILIES:
        for name, pair in import_module(f"planlab.plans.{family}").QUERIES.items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = pair
    return merged
