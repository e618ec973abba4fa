"""Queries over raw newline-delimited JSON: the tables in their roles, written as a dataset of two versions and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.checkpoint import shared_dir
from tessera.operators import sampling
from tessera.plans.registry import query
from tessera.sources import artifacts, ndjson, roles
from tessera.sources.roles import sql

_DATE = "yyyy-MM-dd HH:mm:ss"


def dataset(spark, sf: str) -> str:
    """The root of a raw dataset: an older version with nothing in it and the newest, one folder of JSON lines an entity."""
    root = f"{shared_dir(spark)}/tessera-raw-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    business = roles.business(spark, sf).withColumn("attributes", F.from_json("attributes", "map<string,string>")).withColumn("hours", F.from_json("hours", "map<string,string>"))
    entities = {
        "business": business,
        "review": roles.reviews(spark, sf).withColumn("date", F.date_format("date", _DATE)),
        "user": roles.users_with_friends(spark, sf).withColumn("yelping_since", F.lit("a day")),
        "checkin": roles.checkins(spark, sf),
        "tip": roles.tips(spark, sf).withColumn("date", F.date_format("date", _DATE)),
    }
    spark.range(1).write.json(f"{root}/2024-01/data_review.json")
    for name, rows in entities.items():
        rows.write.json(f"{root}/2024-02/data_{name}.json")
    return root


def found(spark, sf: str, name: str) -> str:
    """The path of an entity in the newest version."""
    path = ndjson.find_raw(spark, ndjson.newest(spark, dataset(spark, sf)), name)
    assert path, name
    return path


def thirds(spark, sf: str) -> DataFrame:
    return roles.business(spark, sf).where("business_id % 3 = 0").select(F.col("business_id").cast("string").alias("business_id"))


@query("raw_reviews", sql("reviews", tail=" SELECT review_id, CAST(user_id AS VARCHAR) AS user_id, CAST(business_id AS VARCHAR) AS business_id, stars, text, epoch_us(date_trunc('second', date)) AS date_us FROM reviews WHERE business_id % 3 = 0"))
def raw_reviews(spark, sf):
    rows = ndjson.reviews(spark, found(spark, sf, "review"), thirds(spark, sf))
    return rows.select("review_id", "user_id", "business_id", "stars", "text", F.unix_micros("date").alias("date_us"))


@query(
    "raw_users",
    sql("pairs", "users", tail=""" SELECT CAST(user_id AS VARCHAR) AS user_id, name, review_count, average_stars, CAST(count(b) AS INT) AS n_friends_total, CAST(count(b) FILTER (b % 2 = 0) AS INT) AS n_friends_subset,
    coalesce(string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FILTER (b % 2 = 0), '') AS friends_subset FROM users LEFT JOIN pairs ON a = user_id WHERE user_id % 2 = 0 GROUP BY user_id, name, review_count, average_stars"""),
)
def raw_users(spark, sf):
    ids = roles.users(spark, sf).where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("user_id"))
    return ndjson.users(spark, found(spark, sf, "user"), ids).select("user_id", "name", "review_count", "average_stars", "n_friends_total", "n_friends_subset", "friends_subset")


@query(
    "raw_business",
    sql("business", tail=""" SELECT lower(trim(city)) || '|' || state AS stratum, CAST(round_even(least(1.0, 150.0 / (SELECT count(*) FROM business)) * count(*), 0) AS BIGINT) AS n
    FROM business GROUP BY 1 HAVING round_even(least(1.0, 150.0 / (SELECT count(*) FROM business)) * count(*), 0) > 0"""),
)
def raw_business(spark, sf):
    sample = ndjson.business(spark, found(spark, sf, "business"), 150)
    return sample.groupBy(sampling.stratum().alias("stratum")).agg(F.count("*").alias("n"))


@query("raw_attributes", sql("business", tail=""" SELECT CAST(business_id AS VARCHAR) AS business_id, CASE WHEN price_range IS NOT NULL THEN '{"RestaurantsPriceRange2":"' || price_range || '","WiFi":"free"}' END AS attributes, n_days_open FROM business"""))
def raw_attributes(spark, sf):
    """Every business: attributes as JSON text, days open counted from the hours' JSON text."""
    from tessera.operators import cleaning

    rows = ndjson.business(spark, found(spark, sf, "business"), roles.business(spark, sf).count())
    return rows.select("business_id", "attributes", cleaning.days_open(F.col("hours")).alias("n_days_open"))


@query("raw_checkins", sql("checkins", tail=" SELECT CAST(business_id AS VARCHAR) AS business_id, n_checkins FROM checkins WHERE business_id % 3 = 0"))
def raw_checkins(spark, sf):
    from tessera.operators import cleaning

    rows = cleaning.clean_checkins(ndjson.checkins(spark, found(spark, sf, "checkin"), thirds(spark, sf)))
    return rows.select("business_id", F.col("n_checkins").cast("long").alias("n_checkins"))


@query("raw_tips", "SELECT CAST(event_id % 50 AS VARCHAR) AS business_id, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS compliments FROM events WHERE event_id % 50 IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) GROUP BY 1")
def raw_tips(spark, sf):
    rows = ndjson.tips(spark, found(spark, sf, "tip"), thirds(spark, sf))
    return rows.groupBy("business_id").agg(F.count("*").alias("n"), F.sum("compliment_count").alias("compliments"))


@query(
    "artifact_tables",
    sql("reviews", "users", "checkins", tail=""" SELECT 'business' AS name, count(*) AS n FROM part UNION ALL SELECT 'reviews', count(*) FROM reviews WHERE business_id IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'users', count(*) FROM users WHERE user_id IN (SELECT user_id FROM reviews WHERE business_id IN (SELECT p_partkey FROM part)) UNION ALL SELECT 'checkins', count(*) FROM checkins WHERE business_id IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'tips', count(*) FROM events WHERE event_id % 50 IN (SELECT p_partkey FROM part)"""),
)
def artifact_tables(spark, sf):
    """A build from raw files, stored as one generation and loaded again from the store."""
    root = dataset(spark, sf)
    settings = config.Config(sample_target=1 << 40)
    base = f"{root}/{settings.artifacts}"
    artifacts.build(spark, ndjson.newest(spark, root), base, settings.sample_target, settings.seed)
    tables = artifacts.build(spark, "nowhere", base)  # the stored build is reused
    out = None
    for name in ("business", "reviews", "users", "checkins", "tips"):
        row = getattr(tables, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
