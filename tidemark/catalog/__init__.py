"""Registered queries. Importing the section modules fills the registry."""

from tidemark.catalog.registry import REGISTRY, Entry, register  # noqa: F401


def load() -> dict[str, "Entry"]:
    from tidemark.catalog import (  # noqa: F401
        aggregates,
        cutoffs,
        economics,
        evaluation,
        forecasting,
        joins,
        learning,
        ordering,
        predicates,
        scalars,
        sources,
        splits,
        windows,
    )

    return REGISTRY
