"""Composed query plans; importing a module registers its queries."""

import importlib

MODULES = (
    "feature_queries",
    "application_queries",
    "monitoring_queries",
    "evaluation_queries",
    "drift_queries",
    "contract_queries",
    "quality_queries",
    "ml_queries",
    "tree_queries",
    "payload_queries",
    "streaming_queries",
)


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"ledgerlens.plans.{name}")


load_all()
