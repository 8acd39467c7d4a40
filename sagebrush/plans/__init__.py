"""Pipelines and the registry of checked queries."""


def load_catalog():
    """Import every catalog module so its queries register themselves."""
    from sagebrush.plans import (  # noqa: F401
        catalog_embedding, catalog_logs, catalog_profiles, catalog_relations, catalog_reports, catalog_search,
        catalog_streaming, catalog_registry, catalog_scalars)
    from sagebrush.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
