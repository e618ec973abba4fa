"""Feature matrix of businesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checkpoint import cut

CONTINUOUS = ["stars", "log_reviews", "price_range", "n_categories", "n_days_open", "log_checkins", "is_open", "rating_std", "business_age", "avg_rev_len"]


def behaviour(reviews: DataFrame) -> DataFrame:
    """Per business: sample deviation of stars (0 for one review), years from its first review to the last of all, mean text length."""
    last = reviews.agg(F.max("date").alias("_last"))
    per = reviews.groupBy("business_id").agg(F.coalesce(F.stddev_samp("stars"), F.lit(0.0)).alias("rating_std"), F.min("date").alias("_first"), F.avg("text_len").alias("avg_review_length"))
    days = F.floor((F.unix_micros("_last") - F.unix_micros("_first")) / 86_400_000_000)
    return per.crossJoin(F.broadcast(last)).select("business_id", "rating_std", (days / 365.25).alias("business_age_years"), "avg_review_length")


def enriched(business: DataFrame, reviews: DataFrame, checkins: DataFrame) -> DataFrame:
    """Businesses with check-in counts, behaviour and the imputed price; what is missing counts 0."""
    counts = checkins.groupBy("business_id").agg(F.sum("n_checkins").alias("n_checkins"))
    rows = business.join(counts, "business_id", "left").join(behaviour(reviews), "business_id", "left")
    rows = rows.fillna(0, ["n_checkins"]).fillna(0.0, ["rating_std", "business_age_years", "avg_review_length"])
    rows = cut(rows, "enriched")  # read for the median, the scale and the matrix
    median = rows.agg(F.median("price_range").alias("_median"))
    return rows.crossJoin(F.broadcast(median)).withColumn("price_range_imp", F.coalesce(F.col("price_range").cast("double"), "_median")).drop("_median")


def continuous(rows: DataFrame) -> dict:
    return {
        "stars": F.col("stars").cast("double"),
        "log_reviews": F.log1p(F.col("review_count").cast("double")),
        "price_range": F.col("price_range_imp"),
        "n_categories": F.col("n_categories").cast("double"),
        "n_days_open": F.col("n_days_open").cast("double"),
        "log_checkins": F.log1p(F.col("n_checkins").cast("double")),
        "is_open": F.col("is_open").cast("double"),
        "rating_std": F.col("rating_std"),
        "business_age": F.col("business_age_years"),
        "avg_rev_len": F.col("avg_review_length"),
    }


def standardised(rows: DataFrame, key: str, columns: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(key, features): population z-scores of the columns (deviation 0 counts as 1), some with a weight."""
    weights = weights or {}
    sides = [e for k, c in enumerate(columns) for e in (F.avg(c).alias(f"_m{k}"), F.stddev_pop(c).alias(f"_s{k}"))]
    scale = rows.agg(*sides)
    z = [((F.col(c) - F.col(f"_m{k}")) / F.when(F.col(f"_s{k}") > 0, F.col(f"_s{k}")).otherwise(1.0)) * weights.get(c, 1.0) for k, c in enumerate(columns)]
    return rows.crossJoin(F.broadcast(scale)).select(key, F.array(*z).alias("features"))


def business_features(business: DataFrame, reviews: DataFrame, checkins: DataFrame, top_categories: int = 18, cat_weight: float = 1.0) -> tuple[DataFrame, list[str], DataFrame]:
    """((business_id, features), names, wide rows): ten continuous columns and the top categories, all z-scored."""
    rows = enriched(business, reviews, checkins)
    wide = rows
    counts = business.select(F.explode("categories_list").alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c").limit(top_categories)
    top = [r["c"] for r in counts.collect()]  # at most top_categories names
    columns = [*continuous(rows).values(), *[F.array_contains("categories_list", c).cast("double") for c in top]]
    names = [*CONTINUOUS, *[f"cat::{c}" for c in top]]  # names may differ by case alone, so columns go by number
    safe = rows.select("business_id", *[c.alias(f"c{k}") for k, c in enumerate(columns)])
    weights = {f"c{k}": cat_weight for k, n in enumerate(names) if n.startswith("cat::")}
    return standardised(safe, "business_id", [f"c{k}" for k in range(len(names))], weights), names, wide
