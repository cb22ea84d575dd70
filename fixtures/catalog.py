"""All registered queries."""

from fixtures import equities, forecasts, geography, ingest, operations, texts  # noqa: F401
from fixtures.registry import ORACLES, QUERIES  # noqa: F401
