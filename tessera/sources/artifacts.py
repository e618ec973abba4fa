"""The five tables as Parquet: written as one generation, read back together."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import ndjson


@dataclass(frozen=True)
class Tables:
    """Five lazy tables."""

    business: DataFrame
    reviews: DataFrame
    users: DataFrame
    checkins: DataFrame
    tips: DataFrame


def save(tables: Tables, base: str) -> str:
    """Write all tables below a new generation, then name it in the manifest; readers never mix generations."""
    spark = tables.business.sparkSession
    generation = uuid.uuid4().hex
    for f in fields(tables):
        getattr(tables, f.name).write.parquet(f"{base}/{generation}/{f.name}")
    spark.sql(f"SELECT '{generation}' AS generation").coalesce(1).write.mode("overwrite").json(f"{base}/manifest")
    return generation


def exists(spark: SparkSession, base: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/manifest/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def load(spark: SparkSession, base: str) -> Tables:
    """The tables of the generation that the manifest names."""
    generation = spark.read.schema("generation string").json(f"{base}/manifest").first()["generation"]
    return Tables(*[spark.read.parquet(f"{base}/{generation}/{f.name}") for f in fields(Tables)])


def build(spark: SparkSession, raw: str, base: str, target: int = 3000, seed: int = 42, rebuild: bool = False) -> Tables:
    """Sample businesses from the raw files and keep what belongs to them; a stored build is reused whole."""
    if rebuild or not exists(spark, base):
        paths = {k: ndjson.find_raw(spark, raw, k) for k in ("business", "review", "user", "checkin", "tip")}
        missing = [k for k, p in paths.items() if p is None]
        if missing:
            raise FileNotFoundError(f"no raw file for {', '.join(missing)} below {raw}")
        business = ndjson.business(spark, paths["business"], target, seed)
        reviews = ndjson.reviews(spark, paths["review"], business)
        users = ndjson.users(spark, paths["user"], reviews.select("user_id").distinct())
        save(Tables(business, reviews, users, ndjson.checkins(spark, paths["checkin"], business), ndjson.tips(spark, paths["tip"], business)), base)
    return load(spark, base)
