"""A training-data pipeline of five stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftstone.llm.stages import STAGES, run  # noqa: F401

#: Some stages can't be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None
