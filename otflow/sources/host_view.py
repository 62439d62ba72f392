"""A host inventory made from the fixed host names, for the test views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from otflow import constants as C

MANAGED = ("EWS-WIN-01", "SCADA-01")


def hosts(spark: SparkSession) -> DataFrame:
    """hostname, ip, is_managed of every named address."""
    rows = [(name, ip, name in MANAGED) for ip, name in sorted(C.HOST_NAMES.items())]
    return spark.createDataFrame(rows, "hostname string, ip string, is_managed boolean")
