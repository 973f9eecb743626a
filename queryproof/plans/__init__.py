"""Registered queries: each binds an operator to the supplied tables and carries its oracle SQL."""

from importlib import import_module

NAMES = (
    "filters",
    "joins",
    "aggregates",
    "windows",
    "limits",
    "sets",
    "textjobs",
    "equivalence",
    "funnel",
    "reporting",
    "streams",
    "io",
    "kept",
)


def modules() -> list:
    return [import_module(f"queryproof.plans.{name}") for name in NAMES]
