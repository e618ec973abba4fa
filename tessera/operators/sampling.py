"""Exact stratified samples and per-group heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratum(city: str = "city", state: str = "state") -> Column:
    """City without case and outer spaces, and state; null counts as empty."""
    return F.concat(F.lower(F.trim(F.coalesce(F.col(city), F.lit("")))), F.lit("|"), F.coalesce(F.col(state), F.lit("")))


def stratified_sample(rows: DataFrame, key: str, target: int, seed: int = 42) -> DataFrame:
    """From each stratum exactly the half-even rounding of its share of `target` rows, without replacement.

    The order in a stratum is a hash of key and seed, so the choice is the same
    at every run.  Counts of (stratum, leading hash bits) say which hash ranges
    are taken whole; only the range that the last row falls into is ranked, so
    even a stratum with most rows is never sorted in one task.
    """
    marked = rows.withColumn("_stratum", stratum()).withColumn("_hash", F.xxhash64(key, F.lit(seed)))
    marked = marked.withColumn("_range", F.shiftright("_hash", 50))
    ranges = marked.groupBy("_stratum", "_range").agg(F.count("*").alias("_in"))
    sizes = ranges.groupBy("_stratum").agg(F.sum("_in").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    share = sizes.crossJoin(F.broadcast(total)).select(
        "_stratum", F.bround(F.least(F.lit(1.0), F.lit(float(target)) / F.col("_all")) * F.col("_n"), 0).cast("long").alias("_take")
    )
    upto = F.sum("_in").over(Window.partitionBy("_stratum").orderBy("_range"))
    left = ranges.withColumn("_upto", upto).join(share, "_stratum").withColumn("_left", F.col("_take") - (F.col("_upto") - F.col("_in")))
    wanted = left.where("_left > 0").select("_stratum", "_range", "_left", (F.col("_left") >= F.col("_in")).alias("_whole"))
    chosen = marked.join(wanted, ["_stratum", "_range"])
    rank = F.row_number().over(Window.partitionBy("_stratum", "_range").orderBy("_hash", key))
    last = chosen.where("not _whole").withColumn("_rank", rank).where("_rank <= _left").drop("_rank")
    return chosen.where("_whole").unionByName(last).select(*rows.columns)


def sample_report(population: DataFrame, sample: DataFrame, means: list[str], top: int = 8) -> DataFrame:
    """(item, population, sample): shares of the largest strata, then means of the named columns."""
    shares = []
    for frame, name in ((population, "population"), (sample, "sample")):
        counts = frame.groupBy(stratum().alias("item")).count()
        total = counts.agg(F.sum("count").alias("_all"))
        shares.append(counts.crossJoin(F.broadcast(total)).select("item", F.col("count").alias(f"n_{name}"), (F.col("count") / F.col("_all")).alias(name)))
    largest = shares[0].join(shares[1], "item", "left").orderBy(F.desc("n_population"), "item").limit(top)
    strata = largest.select("item", "population", F.coalesce("sample", F.lit(0.0)).alias("sample"))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("item"), F.col(m).alias("v")) for m in means]))
    both = [f.agg(*[F.avg(m).alias(m) for m in means]).select(pairs.alias("x")).select("x.item", F.col("x.v").alias(n)) for f, n in ((population, "population"), (sample, "sample"))]
    return strata.unionByName(both[0].join(both[1], "item"))


def head_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group in an order (WindowGroupLimit prunes before the shuffle)."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def largest_groups_sample(rows: DataFrame, group: str, key: str, groups: int, per_group: int, seed: int = 42) -> DataFrame:
    """Up to `per_group` rows, in hash order, of each of the `groups` biggest groups."""
    biggest = rows.groupBy(group).count().orderBy(F.desc("count"), group).limit(groups).select(group)
    return head_per_group(rows.join(F.broadcast(biggest), group), group, [F.xxhash64(key, F.lit(seed)), F.col(key)], per_group)
