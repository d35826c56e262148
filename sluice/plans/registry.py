"""All queries of the library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import digest, intel, market, ops

FLAGSHIP = "market_judgement"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = market.QUERIES | intel.QUERIES | ops.QUERIES | digest.QUERIES
ORACLES: dict[str, str] = market.ORACLES | intel.ORACLES | ops.ORACLES | digest.ORACLES
