"""All registered queries."""

from __future__ import annotations

from pointweave.plans import catalog_eval, catalog_graph, catalog_pipeline, catalog_values  # noqa: F401


def flagship(spark, d):
    return catalog_pipeline.anomalous_regions(spark, d)
