"""All named queries. Importing a family registers its queries."""

from spotweave.plans import (  # noqa: F401
    q_totals,
    q_evaluate,
    q_sfmetrics,
    q_projections,
    q_joins,
    q_baselines,
    q_splits,
    q_genesets,
    q_spatial,
    q_models,
    q_sources,
    q_marts,
    q_ordering,
)
from spotweave.plans.registry import ORACLES, QUERIES  # noqa: F401
