"""Named queries, one module per family."""

from importlib import import_module

FAMILIES = ("retrieval", "pages", "markdown", "tasks", "library", "jobs", "memory", "recommend", "sources", "streams")


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"tessaly.plans.{family}")
