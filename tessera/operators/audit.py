"""Concentration and fairness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.checkpoint import cut


def spread(groups: DataFrame) -> DataFrame:
    """One row (rows, total, gini, top_share, single, below_10) of values `x` that `n` rows each have.

    Equal values are one group, so the ranks that the formulas need come from one
    running sum over distinct values: a table as long as the number of distinct
    counts, not of rows.  Without rows or with a zero total the coefficient is 0;
    the top share is that of the top 1 % of rows, one at least.
    """
    ranked = running(groups.where(F.col("x").isNotNull()).select(F.col("x").cast("double").alias("x"), "n"), "x", {"upto": F.col("n")})
    whole = groups.where(F.col("x").isNotNull()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("x") * F.col("n")).cast("double"), F.lit(0.0)).alias("total"))
    before, rows, total = F.col("upto") - F.col("n"), F.col("rows"), F.col("total")
    # the ranks of a group of n equal values after `before` others sum to n * before + n (n + 1) / 2
    rank_sum = F.coalesce(F.sum(F.col("x") * (F.col("n") * before + F.col("n") * (F.col("n") + 1) / 2)), F.lit(0.0))
    above = rows - F.col("upto")
    used = F.greatest(F.lit(0), F.least(F.col("n"), F.greatest(F.lit(1), F.floor(rows / 100)) - above))
    sums = ranked.crossJoin(F.broadcast(whole)).agg(
        rank_sum.alias("ranked"), F.sum(used * F.col("x")).alias("top"), F.sum(F.when(F.col("x") == 1, F.col("n")).otherwise(0)).alias("ones"), F.sum(F.when(F.col("x") < 10, F.col("n")).otherwise(0)).alias("few")
    )
    value = F.when(total == 0, 0.0).otherwise(2 * F.col("ranked") / (rows * total) - (rows + 1) / rows)
    return sums.crossJoin(whole).select("rows", "total", value.alias("gini"), (F.col("top") / total).alias("top_share"), (F.col("ones") / rows).alias("single"), (F.col("few") / rows).alias("below_10"))


def grouped(rows: DataFrame, column: str) -> DataFrame:
    """(x, n): how many rows have each value."""
    return rows.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))


def gini(rows: DataFrame, column: str) -> DataFrame:
    """One row: the Gini coefficient of the values; none or a zero total give 0."""
    return spread(grouped(rows, column)).select("gini")


def running(rows: DataFrame, order: str, sums: dict) -> DataFrame:
    """Running sums (own row included) of a frame in an order without a single-task window."""
    dealt = rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt, "running")  # partition numbers must not change between the two reads
    parts = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_s{k}") for k, c in enumerate(sums.values())])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = parts.select("_part", *[F.coalesce(F.sum(f"_s{k}").over(ahead), F.lit(0)).alias(f"_o{k}") for k in range(len(sums))])
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), "_part")
    return out.select(*[c for c in rows.columns], *[(F.sum(c).over(inside) + F.col(f"_o{k}")).alias(n) for k, (n, c) in enumerate(sums.items())])


def top_share(counts: DataFrame, column: str) -> DataFrame:
    """One row: what share of the total the top 1 % of rows (one at least) hold."""
    return spread(grouped(counts, column)).select("top_share")


def concentration(reviews: DataFrame, users: DataFrame, business: DataFrame) -> DataFrame:
    """(metric, value): who writes the reviews and who receives them.

    The reviews are read once: counts a (user, business) pair give those of
    users and of businesses, and the counts' histograms all that is asked.
    """
    pairs = cut(reviews.groupBy("user_id", "business_id").agg(F.count("*").alias("n")), "pairs")
    per_user = pairs.groupBy("user_id").agg(F.sum("n").alias("n"))
    per_business = pairs.groupBy("business_id").agg(F.sum("n").alias("n"))
    all_business = business.select("business_id").join(per_business, "business_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    elite = users.where("is_elite").select("user_id").distinct().withColumn("_elite", F.lit(1))
    of_users = cut(per_user.join(elite, "user_id", "left").groupBy(F.col("n").alias("x")).agg(F.count("*").alias("n"), F.count("_elite").alias("elite")), "of-users")
    mine = spread(of_users.select("x", "n")).select("single", "top_share", "gini")
    theirs = spread(cut(grouped(all_business, "n"), "of-business")).select(F.col("below_10"), F.col("gini").alias("gini_b"))
    received = spread(cut(grouped(per_business, "n"), "of-reviewed")).select(F.col("top_share").alias("top_b"))
    shares = of_users.agg((F.sum(F.col("elite") * F.col("x")) / F.sum(F.col("n") * F.col("x"))).alias("elite_reviews"))
    elites = users.agg(F.avg(F.col("is_elite").cast("double")).alias("elite_users"))
    row = mine.crossJoin(theirs).crossJoin(received).crossJoin(shares).crossJoin(elites)  # one row each
    metrics = {"single_review_users": "single", "top_users_share": "top_share", "top_business_share": "top_b", "elite_users": "elite_users", "elite_reviews": "elite_reviews", "small_business": "below_10", "gini_users": "gini", "gini_business": "gini_b"}
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in metrics.items()])
    return row.select(F.explode(each).alias("x")).select("x.metric", "x.value")


def chains(business: DataFrame, min_locations: int = 5) -> DataFrame:
    """Names with at least so many locations; a null name is no chain."""
    return business.where(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= min_locations)


def chains_vs_small(business: DataFrame, reviews: DataFrame, min_locations: int = 5) -> DataFrame:
    """Both groups: size, mean stars, median review count, mean reviews, share open, rounded half-even to 2 places."""
    names = chains(business, min_locations).select("name", F.lit(True).alias("_chain"))
    counts = reviews.groupBy("business_id").agg(F.count("*").alias("_reviews"))
    rows = business.join(names, "name", "left").join(counts, "business_id", "left")
    group = F.when(F.col("_chain"), F.lit(f"chain (>= {min_locations} locations)")).otherwise("independent")
    return rows.groupBy(group.alias("kind")).agg(
        F.count("*").alias("n"),
        F.bround(F.avg("stars"), 2).alias("mean_stars"),
        F.bround(F.median("review_count"), 2).alias("median_review_count"),
        F.bround(F.avg(F.coalesce("_reviews", F.lit(0))), 2).alias("mean_reviews"),
        F.bround(F.avg(F.col("is_open").cast("double")), 2).alias("share_open"),
    )


#: Time and space of this engine's operators: n rows, d features, k clusters, V/E graph, N stream, w CMS width.
COSTS = [
    ("I", "stratified sample", "O(N log N) per stratum", "O(strata)", "one shuffle by stratum"),
    ("II", "PageRank", "O(iterations (V + E))", "O(V + E)", "a join and a sum an iteration"),
    ("II", "HITS", "O(iterations E)", "O(V + E)", "two joins an iteration"),
    ("II", "communities", "O(rounds E)", "O(V + E)", "joins by node and community"),
    ("II", "force layout", "O(iterations n^2)", "O(n^2)", "samples only"),
    ("III", "k-means", "O(iterations n k d)", "O(n d + k d)", "centroids are broadcast"),
    ("III", "DBSCAN", "O(pairs in neighbouring cells)", "O(edges)", "eps-join, then components"),
    ("III", "silhouette", "O(n^2)", "O(n clusters)", "blocks of rows"),
    ("IV", "item similarity", "O(sum of squared user degrees)", "O(pairs)", "self-join by user"),
    ("IV", "TF-IDF profiles", "O(tokens)", "O(terms per item)", "aggregates"),
    ("V", "sliding window", "O(N log N)", "O(events in window)", "range frames in buckets"),
    ("V", "Count-Min", "O(depth) an event", "O(e/eps ln(1/delta))", "sums merge"),
    ("V", "LogLog", "O(1) an event", "O(registers)", "maxima merge"),
    ("VI", "PCA", "O(n d^2 + d^3)", "O(d^2)", "covariance is one aggregate"),
    ("VI", "SVD", "O(nonzeros per row squared + t^3)", "O(t^2)", "Gram matrix of terms"),
]


def complexity_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join("(" + ", ".join(f"'{c}'" for c in row) + ")" for row in COSTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(part, algorithm, time, space, scaling)")
