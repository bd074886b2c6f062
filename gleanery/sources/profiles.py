"""Interest profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import schemas

NO_PROFILE = "No reader profile is given. Rank by general news importance."


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROFILES).json(path)


def profile_text(*fields: str) -> Column:
    """The profile as JSON for a ranking model, or a fixed sentence when nothing is set."""
    names = fields or tuple(n for n in schemas.PROFILES.names if n != "profile_id")
    body = F.to_json(F.struct(*names))
    return F.when(body == "{}", F.lit(NO_PROFILE)).otherwise(body)
