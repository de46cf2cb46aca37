"""Imports every query module, which registers its queries."""

from importlib import import_module

MODULES = (
    "q_catalog",
    "q_evaluation",
    "q_grouping",
    "q_history",
    "q_layout",
    "q_learning",
    "q_queue",
    "q_streams",
)


def load() -> None:
    for name in MODULES:
        import_module(f"shoebox.plans.{name}")
