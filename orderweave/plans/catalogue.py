"""The queries of the order verification operators, by name, and their SQL."""

from orderweave.plans import courses, flows, frames, orders, pieces, services, texts, tickets, tracks  # noqa: F401  they register their queries
from orderweave.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
