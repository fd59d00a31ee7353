"""All registered queries with their oracles."""

from titleloom.queries import columns, filters, joins, ranks, sources, statistics, streams  # noqa: F401
from titleloom.queries.base import ORACLES, QUERIES  # noqa: F401
