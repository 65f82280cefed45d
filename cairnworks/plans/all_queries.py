"""All query modules, imported so that they register."""

from cairnworks.plans import aggregates, analytics, derived, graph, joins, links, records, resolution, routes, views  # noqa: F401
from cairnworks.plans.registry import QUERIES, SQL, Tables

__all__ = ["QUERIES", "SQL", "Tables"]
