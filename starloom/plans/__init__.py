"""Registered queries, grouped by what they read."""

from importlib import import_module

MODULES = (
    "expressions", "matching", "condensing", "statistics", "chains", "maps", "tables",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"starloom.plans.{name}")
