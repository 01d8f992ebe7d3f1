"""The registered queries: one per operator, each with the SQL that must give the same rows."""

from turnwise.plans import classification, querylog, relational, shaping, tableviews, trajectories
from turnwise.plans.registry import REGISTRY

__all__ = [
    "REGISTRY",
    "classification",
    "querylog",
    "relational",
    "shaping",
    "tableviews",
    "trajectories",
]
