"""PCA and SVD: the reduced matrices are distributed aggregates, the driver only solves the small problem."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Largest matrix that the driver solves.
MAX_WIDTH = 4000


def covariance(points: DataFrame, width: int) -> DataFrame:
    """(i, j, v): X'X / (n - 1) of z-scored rows, not centred again, upper triangle.

    X'X is summed batch by batch; a task gives one triangle, and the triangles are added.
    """

    def run(batches):
        total, n = np.zeros((width, width)), 0
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, width))
            total += rows.T @ rows
            n += len(rows)
        i, j = np.triu_indices(width)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j]), pa.array(np.full(len(i), n, np.int64))], names=["i", "j", "s", "n"])

    parts = points.select("features").mapInArrow(run, "i int, j int, s double, n long")
    return parts.groupBy("i", "j").agg((F.sum("s") / (F.sum("n") - 1)).alias("v"))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    for r in rows:
        out[r[0], r[1]] = out[r[1], r[0]] = r[2]
    return out


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    at = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def pca(points: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors as columns, explained share), largest first."""
    if width > MAX_WIDTH:
        raise ValueError(f"{width} columns are too many for the driver")
    values, vectors = np.linalg.eigh(_matrix(covariance(points, width).collect(), width))
    order = np.argsort(values)[::-1]
    values = np.maximum(values[order], 0.0)
    total = values.sum()
    return values, _signed(vectors[:, order]), values / total if total else values


def components_for(shares, target: float = 0.9) -> int:
    """The least number of components that reach the target; all if none does."""
    reached = np.flatnonzero(np.cumsum(shares) >= target - 1e-12)
    return int(reached[0]) + 1 if len(reached) else len(shares)


def scree(spark, shares) -> DataFrame:
    """(component, share, cumulative)."""
    rows = ", ".join(f"({k}, {float(s)!r}D, {float(c)!r}D)" for k, (s, c) in enumerate(zip(shares, np.cumsum(shares), strict=True), 1))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(component, share, cumulative)")


def project(points: DataFrame, vectors: np.ndarray, k: int, key: str = "id") -> DataFrame:
    """(key, projected): dot products with the first k vectors."""
    columns = [F.array(*[F.lit(float(x)) for x in vectors[:, c]]) for c in range(k)]
    dots = [F.aggregate(F.zip_with("features", c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for c in columns]
    return points.select(key, F.array(*dots).alias("projected"))


def loadings(spark, names: list[str], vectors: np.ndarray, components: int = 5, top: int = 6) -> DataFrame:
    """(component, loadings): the largest entries as text, such as `stars (+0.40)`."""
    rows = []
    for c in range(min(components, vectors.shape[1])):
        order = sorted(range(len(names)), key=lambda i: (-abs(vectors[i, c]), names[i]))[:top]
        text = ", ".join(f"{names[i]} ({vectors[i, c]:+.2f})" for i in order)
        rows.append(f"({c + 1}, '" + text.replace("'", "''") + "')")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(component, loadings)")


def gram(entries: DataFrame) -> DataFrame:
    """(i, j, v): M'M of sparse (row, term, w) entries: a self-join by row, summed by pair of terms."""
    a = entries.select("row", F.col("term").alias("i"), F.col("w").alias("wi"))
    b = entries.select("row", F.col("term").alias("j"), F.col("w").alias("wj"))
    return a.join(b, "row").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("v"))


def numbered(entries: DataFrame, column: str, names: list[str]) -> DataFrame:
    """The entries with the places of the column's names in their list."""
    places = pa.table({"_name": pa.array(names, pa.string()), "_n": pa.array(range(len(names)), pa.int32())})
    frame = entries.sparkSession.createDataFrame(places)
    return entries.join(F.broadcast(frame), entries[column].cast("string") == frame["_name"]).withColumn(column, F.col("_n")).drop("_name", "_n")


def _dense(cells: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The matrix of (i int, j int, v double), on the driver: cells come as packed numbers, 16 bytes each, a partition at a time."""
    kinds = ("<i4", "<i4", "<f8")

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype(k).tobytes()], pa.binary()) for c, k in zip(batch.columns, kinds, strict=True)], names=["i", "j", "v"])

    out = np.zeros(shape)
    for row in cells.mapInArrow(packed, "i binary, j binary, v binary").toLocalIterator(prefetchPartitions=True):
        i, j, v = (np.frombuffer(x, k) for x, k in zip(row, kinds, strict=True))
        np.add.at(out, (i, j), v)
    return out


def svd(entries: DataFrame, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns) of the sparse matrix with these terms as columns.

    With fewer rows than terms the matrix itself is the small problem: its
    values past the number of rows are 0 and have no vectors.  Else the Gram
    matrix of the terms is solved.  Either has at most MAX_WIDTH squared cells.
    """
    known = entries.where("row is not null")
    rows = [r[0] for r in known.select(F.col("row").cast("string")).distinct().limit(len(terms)).collect()] if len(terms) else []
    width = min(len(rows), len(terms))
    if width * len(terms) > MAX_WIDTH**2:
        raise ValueError(f"{len(terms)} terms of {width} rows or more are too many for the driver")
    if len(rows) < len(terms):
        cells = numbered(numbered(known, "term", terms), "row", sorted(rows)).select("row", "term", "w")
        _, values, right = np.linalg.svd(_dense(cells, (len(rows), len(terms))), full_matrices=False)
        return np.concatenate((values, np.zeros(len(terms) - len(values)))), _signed(right.T)
    upper = _dense(gram(numbered(known, "term", terms)), (len(terms), len(terms)))
    values, vectors = np.linalg.eigh(upper, UPLO="U")
    return np.sqrt(np.maximum(values[::-1], 0.0)), _signed(vectors[:, ::-1])


def singular_values(spark, values) -> DataFrame:
    """(place, s)."""
    return spark.createDataFrame(pa.table({"place": pa.array(range(1, len(values) + 1), pa.int32()), "s": pa.array(values, pa.float64())}))


def latent_factors(spark, vectors: np.ndarray, terms: list[str], factors: int = 6, top: int = 8) -> DataFrame:
    """(factor, terms): the terms with the largest absolute weights."""
    rows = []
    for k in range(min(factors, vectors.shape[1])):
        order = sorted(range(len(terms)), key=lambda i: (-round(abs(vectors[i, k]), 9), terms[i]))[:top]
        rows.append(f"({k + 1}, '{', '.join(terms[i] for i in order)}')")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(factor, terms)")


def reconstruction(values: DataFrame, n: int, m: int, ks: list[int]) -> DataFrame:
    """(k, error, captured, stored, compression) from a (place, s) frame of all singular values."""
    total = values.agg(F.sum(F.col("s") * F.col("s")).alias("_all"))
    out = values.crossJoin(F.broadcast(total))
    sums = [F.sum(F.when(F.col("place") <= k, F.col("s") * F.col("s")).otherwise(0.0)).alias(f"_k{k}") for k in ks]
    row = out.agg(F.first("_all").alias("_all"), *sums)
    each = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"_k{k}") / F.col("_all")).alias("captured")) for k in ks])
    stored = (F.col("x.k") * (n + m + 1)).cast("long")
    return row.select(F.explode(each).alias("x")).select(
        "x.k", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("x.captured"))).alias("error"), "x.captured", stored.alias("stored"), F.concat(F.bround(F.lit(float(n * m)) / stored, 0).cast("long").cast("string"), F.lit("x")).alias("compression")
    )


def running_share(values: DataFrame) -> DataFrame:
    """(place, cumulative share of squares) of singular values; one row a value, so one window is enough."""
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    total = values.agg(F.sum(F.col("s") * F.col("s")).alias("_all"))
    return values.crossJoin(F.broadcast(total)).select("place", (F.sum(F.col("s") * F.col("s")).over(w) / F.col("_all")).alias("cumulative"))
