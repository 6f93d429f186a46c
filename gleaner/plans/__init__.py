"""All registered queries of the library proper."""

from gleaner.plans import answers, catalog, chunking, elements, graph, jobs, manuals, retrieval  # noqa: F401
from gleaner.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
