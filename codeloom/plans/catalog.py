"""All registered queries; importing the modules below fills the register."""

from codeloom.plans import context_queries, extraction_queries, memory_queries, mesh_queries, review_queries, store_queries  # noqa: F401
from codeloom.plans.registry import ORACLES, QUERIES  # noqa: F401
