"""Registered queries: one module per part of the inventory."""

from importlib import import_module

MODULES = ["q_sources", "q_catalogue", "q_projections", "q_tagging", "q_retrieval", "q_separation",
           "q_features", "q_stats", "q_joins", "q_sequence", "q_mashup", "q_streaming"]


def load():
    from importlib.util import find_spec

    from cadenza.plans import registry

    for m in MODULES:
        if find_spec(f"cadenza.plans.{m}"):
            import_module(f"cadenza.plans.{m}")
    return registry
