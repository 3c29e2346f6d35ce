"""Imports every query module, so that the registry is complete."""
from . import district_queries, donation_queries, graph_queries, people_queries  # noqa: F401
from .registry import REGISTRY  # noqa: F401
