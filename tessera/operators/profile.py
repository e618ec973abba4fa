"""Profile queries over the cleaned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rating_distribution(reviews: DataFrame) -> DataFrame:
    """Reviews of each star value, with the overall mean beside them."""
    counts = reviews.groupBy("stars").agg(F.count("*").alias("n"), F.sum("stars").alias("_sum"))
    mean = counts.agg((F.sum("_sum") / F.sum(F.when(F.col("stars").isNotNull(), F.col("n")))).alias("mean_stars"))
    return counts.drop("_sum").crossJoin(F.broadcast(mean)).orderBy("stars")


def length_histogram(rows: DataFrame, length: str, cap: float = 2000, bins: int = 50) -> DataFrame:
    """Counts in equal bins over the capped range (the last bin is closed), empty bins as 0, with the median length."""
    capped = rows.select(F.least(F.col(length).cast("double"), F.lit(float(cap))).alias("x"), F.col(length).alias("v")).where(F.col("x").isNotNull())
    range_ = capped.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.median("v").alias("median_length"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(0)
    counts = capped.crossJoin(F.broadcast(range_)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(range_))
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("low"), F.coalesce("n", F.lit(0)).alias("n"), "median_length")


def frequency_of_values(rows: DataFrame, column: str) -> DataFrame:
    """How many rows have each positive value."""
    return rows.where(F.col(column) > 0).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def activity_power_law(reviews: DataFrame, key: str) -> DataFrame:
    """How many keys have each number of reviews."""
    return frequency_of_values(reviews.groupBy(key).agg(F.count("*").alias("reviews")), "reviews")


def top_categories(business: DataFrame, n: int = 15) -> DataFrame:
    """The most frequent categories; one that repeats inside a list counts each time."""
    return business.select(F.explode("categories_list").alias("category")).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(n)


def geography(business: DataFrame) -> DataFrame:
    return business.select("longitude", "latitude", "stars")


def monthly_series(reviews: DataFrame) -> DataFrame:
    """Dated reviews of every month from the first to the last, 0 for months without any."""
    months = reviews.where(F.col("date").isNotNull()).groupBy(F.trunc("date", "month").alias("month")).agg(F.count("*").alias("n"))
    ends = months.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).where("lo is not null")
    every = ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return every.join(months, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def degree_profile(users: DataFrame, degree: str = "n_friends_subset") -> DataFrame:
    """How many users have each positive degree, with the share of users without friends."""
    alone = users.agg(F.avg((F.col(degree) == 0).cast("double")).alias("share_alone"))
    return frequency_of_values(users, degree).crossJoin(F.broadcast(alone))


def segments(business: DataFrame, users: DataFrame) -> DataFrame:
    """Mean stars by open flag and mean user average by elite flag; a missing group has a null mean."""
    flags = business.sparkSession.sql("SELECT * FROM VALUES (0), (1) AS f(flag)")
    by_open = business.groupBy(F.col("is_open").cast("int").alias("flag")).agg(F.avg("stars").alias("mean"))
    by_elite = users.groupBy(F.col("is_elite").cast("int").alias("flag")).agg(F.avg("average_stars").alias("mean"))
    one = flags.join(by_open, "flag", "left").select(F.lit("is_open").alias("segment"), "flag", "mean")
    return one.unionByName(flags.join(by_elite, "flag", "left").select(F.lit("is_elite").alias("segment"), "flag", "mean"))


def profile(clean) -> dict[str, DataFrame]:
    """All profile frames of cleaned tables, lazily."""
    return {
        "rating_distribution": rating_distribution(clean.reviews),
        "length_histogram": length_histogram(clean.reviews, "text_len"),
        "business_review_counts": frequency_of_values(clean.business, "review_count"),
        "user_activity": activity_power_law(clean.reviews, "user_id"),
        "top_categories": top_categories(clean.business),
        "geography": geography(clean.business),
        "monthly_series": monthly_series(clean.reviews),
        "degree_profile": degree_profile(clean.users),
        "segments": segments(clean.business, clean.users),
    }
