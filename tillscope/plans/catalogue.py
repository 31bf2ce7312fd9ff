"""All named queries. Importing this module fills the registry."""

from tillscope.plans import (  # noqa: F401
    basket_queries,
    cluster_queries,
    lifetime_queries,
    rfm_queries,
    table_queries,
)
from tillscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
