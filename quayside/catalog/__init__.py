"""All registered queries. Importing the modules fills the registry."""

from quayside.catalog import cost, extraction, features, quality, records, streams, training
from quayside.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
