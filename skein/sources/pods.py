"""Pod inventory and shipped pod logs; logs that grow are in ``tail``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scalars import after_last_colon

#: Containers that never are the application.
SIDECARS = ("istio-proxy", "daprd")


def inventory(pods: DataFrame) -> DataFrame:
    """(name, version, container) of (name, image, containers): the image's tag, and the first container that is no side-car."""
    own = F.get(F.filter("containers", lambda c: ~c.isin(*SIDECARS)), F.lit(0))
    return pods.select("name", after_last_colon(F.col("image")).alias("version"), own.alias("container"))


def backfill(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that are already there."""
    lines = spark.read.format("text").option("recursiveFileLookup", "true").load(folder)
    return lines.select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("index_identifier"))
