"""All registered queries, gathered from the query modules."""

from __future__ import annotations

from seqweave.plans import (
    association_queries,
    claim_queries,
    control_queries,
    facts_queries,
    graph_queries,
    hit_queries,
    knockout_queries,
    link_queries,
    region_queries,
    sequence_queries,
    table_queries,
    tree_queries,
    variant_queries,
)

MODULES = (
    graph_queries,
    hit_queries,
    sequence_queries,
    association_queries,
    claim_queries,
    control_queries,
    facts_queries,
    knockout_queries,
    link_queries,
    table_queries,
    tree_queries,
    variant_queries,
    region_queries,
)


def queries():
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracles():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
