"""Mergeable sketches as tables: Count-Min sums, LogLog maxima."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2_147_483_647
# The hash constants that the seeded generators give.
CMS_A = [2029167940, 1342382292, 1469265226, 1926751965, 1241873584]
CMS_B = [1665772334, 1790251936, 483628757, 119253154, 644602188]
LOGLOG_A, LOGLOG_B = 287335975, 276102407
ALPHA = 0.39701


def key_hash(column: str, kind: str) -> Column:
    """A key as 31 bits: integers keep theirs, other keys are hashed."""
    c = F.col(column)
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    return (c.cast("long") if whole else F.xxhash64(c)).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def hash_constants(row: int) -> tuple[int, int]:
    """Factor and summand of a row's hash: the fixed ones, beyond them by rule (a mixed Weyl sequence)."""
    if row < len(CMS_A):
        return CMS_A[row], CMS_B[row]

    def mix(x: int) -> int:
        x = x * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        return x ^ x >> 31

    return 1 + mix(2 * row) % (PRIME - 1), mix(2 * row + 1) % PRIME


def width_and_depth(eps: float, delta: float) -> tuple[int, int]:
    return math.ceil(math.e / eps), math.ceil(math.log(1 / delta))


def cells(rows: DataFrame, key: str, eps: float, delta: float) -> DataFrame:
    """Rows with an array of (row, col) cells of their key."""
    width, depth = width_and_depth(eps, delta)
    factors = [hash_constants(i) for i in range(depth)]
    x = key_hash(key, rows.schema[key].dataType.simpleString())
    at = [F.struct(F.lit(i).alias("row"), F.pmod(F.pmod(F.lit(a).cast("long") * x + b, F.lit(PRIME)), F.lit(width)).cast("int").alias("col")) for i, (a, b) in enumerate(factors)]
    return rows.withColumn("_cells", F.array(*at))


def count_min(rows: DataFrame, key: str, eps: float = 0.001, delta: float = 0.01) -> DataFrame:
    """(row, col, n).  Keys are counted first, so a frequent key is one row before cells are dealt."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return cells(counts, key, eps, delta).select(F.explode("_cells").alias("c"), "_n").groupBy("c.row", "c.col").agg(F.sum("_n").alias("n"))


def merge_count_min(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "col").agg(F.sum("n").alias("n"))


def estimate(keys: DataFrame, key: str, table: DataFrame, eps: float = 0.001, delta: float = 0.01) -> DataFrame:
    """(key, estimate): the least of a key's cells, 0 for an untouched one."""
    each = cells(keys.select(key).distinct(), key, eps, delta).select(key, F.explode("_cells").alias("c")).select(key, "c.row", "c.col")
    return each.join(table, ["row", "col"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def against_exact(rows: DataFrame, key: str, eps: float = 0.001, delta: float = 0.01) -> DataFrame:
    """(key, exact, estimate, error) of every key."""
    exact = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("exact"))
    found = estimate(exact, key, count_min(rows, key, eps, delta), eps, delta)
    return exact.join(found, key).withColumn("error", F.col("estimate") - F.col("exact"))


def eps_sweep(rows: DataFrame, key: str, values=(0.01, 0.005, 0.001, 0.0005), delta: float = 0.01) -> DataFrame:
    """(eps, cells, bound, mean_error, max_error, min_error, within_bound) of each eps."""
    n = rows.where(F.col(key).isNotNull()).agg(F.count("*").alias("_total"))
    out = None
    for eps in values:
        width, depth = width_and_depth(eps, delta)
        found = against_exact(rows, key, eps, delta).crossJoin(F.broadcast(n))
        row = found.agg(
            F.lit(eps).alias("eps"),
            F.lit(width * depth).alias("cells"),
            (F.first("_total") * eps).alias("bound"),
            F.avg("error").alias("mean_error"),
            F.max("error").alias("max_error"),
            F.min("error").alias("min_error"),
            F.avg((F.col("error") <= F.col("_total") * eps).cast("double")).alias("within_bound"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def loglog_registers(rows: DataFrame, key: str, m: int = 256, by: Column | None = None) -> DataFrame:
    """(period, bucket, rho): the largest place of the lowest set bit in each bucket, 32 for zero."""
    x = key_hash(key, rows.schema[key].dataType.simpleString())
    hashed = F.pmod(F.lit(LOGLOG_A).cast("long") * x + LOGLOG_B, F.lit(PRIME))
    rest = F.floor(hashed / m)
    rho = F.when(rest == 0, 32).otherwise(F.bit_count(rest.bitwiseAND(-rest) - 1) + 1)
    named = rows.where(F.col(key).isNotNull()).select((by if by is not None else F.lit("all")).alias("period"), F.pmod(hashed, F.lit(m)).cast("int").alias("bucket"), rho.cast("int").alias("rho"))
    return named.groupBy("period", "bucket").agg(F.max("rho").alias("rho"))


def merge_loglog(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("period", "bucket").agg(F.max("rho").alias("rho"))


def loglog_estimate(registers: DataFrame, m: int = 256) -> DataFrame:
    """(period, estimate): ALPHA m 2^(mean over all m registers, empty ones 0)."""
    return registers.groupBy("period").agg((ALPHA * m * F.pow(F.lit(2.0), F.sum("rho") / m)).alias("estimate"))


def distinct_by_period(rows: DataFrame, key: str, period: Column, m: int = 256) -> DataFrame:
    """(period, exact, estimate, relative_error)."""
    exact = rows.groupBy(period.alias("period")).agg(F.count_distinct(key).alias("exact"))
    found = loglog_estimate(loglog_registers(rows, key, m, period), m)
    return exact.join(found, "period").select(
        "period", "exact", F.bround("estimate", 0).cast("long").alias("estimate"), F.bround(F.abs(F.col("estimate") - F.col("exact")) / F.col("exact"), 3).alias("relative_error")
    )
