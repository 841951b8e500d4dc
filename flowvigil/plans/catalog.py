"""Every registered query, in the order of the operator groups."""

from flowvigil.plans import (  # noqa: F401  (imported to register their queries)
    cleaning,
    detectors,
    features,
    models,
    response,
    rules,
    streams,
)
from flowvigil.plans.registry import all_oracles, all_queries  # noqa: F401
