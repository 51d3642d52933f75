"""Query plans: the tree of flat queries that fills a view."""

from .plan import Query, plan

__all__ = ["Query", "plan"]
