"""Queries over feature matrices: features, clusters, dimensionality reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.checkpoint import cut
from tessera.operators import cleaning, cluster, features, linalg, recommend
from tessera.plans.profiles import business, latest, rounded
from tessera.plans.registry import query
from tessera.sources import roles
from tessera.sources.roles import sql

_DOT = "list_sum(list_transform(range(1, len(a.features) + 1), lambda k: power(a.features[k] - b.features[k], 2)))"
_PAIRS = f", d AS (SELECT a.id AS a, b.id AS b, sqrt({_DOT}) AS d FROM points a, points b)"


def points(spark, sf: str):
    return roles.points(spark, sf)


def checkins(spark, sf: str):
    return cleaning.clean_checkins(roles.checkins(spark, sf))


_BEHAVIOUR = """, bh AS (SELECT business_id, coalesce(stddev_samp(stars), 0) AS rating_std, floor(date_diff('microsecond', min(date), (SELECT max(date) FROM latest)) / 86400000000.0) / 365.25 AS business_age_years, avg(text_len) AS avg_review_length FROM latest GROUP BY 1)"""


@query("behavioural_features", sql("latest", tail=_BEHAVIOUR + " SELECT business_id, round(rating_std, 6) AS rating_std, round(business_age_years, 6) AS business_age_years, round(avg_review_length, 6) AS avg_review_length FROM bh"))
def behavioural_features(spark, sf):
    return rounded(features.behaviour(latest(spark, sf)))


_MATRIX = (
    _BEHAVIOUR
    + """, f AS (SELECT b.business_id, CAST(stars AS DOUBLE) AS c0, ln(1 + review_count) AS c1, coalesce(CAST(price_range AS DOUBLE), (SELECT median(price_range) FROM business)) AS c2, CAST(len(categories_list) AS DOUBLE) AS c3,
    CAST(n_days_open AS DOUBLE) AS c4, ln(1 + coalesce(n_checkins, 0)) AS c5, CAST(is_open AS DOUBLE) AS c6, coalesce(rating_std, 0) AS c7, coalesce(business_age_years, 0) AS c8, coalesce(avg_review_length, 0) AS c9, categories_list
    FROM business b LEFT JOIN checkins USING (business_id) LEFT JOIN bh ON bh.business_id = b.business_id),
    top AS (SELECT c, row_number() OVER (ORDER BY n DESC, c) + 9 AS pos FROM (SELECT c, count(*) AS n FROM (SELECT unnest(categories_list) AS c FROM business) GROUP BY 1) ORDER BY n DESC, c LIMIT 18),
    long AS (SELECT business_id, unnest([0,1,2,3,4,5,6,7,8,9]) AS pos, unnest([c0,c1,c2,c3,c4,c5,c6,c7,c8,c9]) AS v FROM f UNION ALL SELECT business_id, pos, CASE WHEN list_contains(categories_list, c) THEN 1.0 ELSE 0.0 END FROM f, top),
    s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM long GROUP BY 1)"""
)


@query("feature_matrix_z", sql("latest", "business", "checkins", tail=_MATRIX + " SELECT business_id, CAST(long.pos AS INT) AS pos, round(CASE WHEN sd > 0 THEN (v - m) / sd ELSE v - m END, 6) AS z FROM long JOIN s ON s.pos = long.pos"))
def feature_matrix_z(spark, sf):
    matrix, _, _ = features.business_features(business(spark, sf), latest(spark, sf), checkins(spark, sf))
    return rounded(matrix.select("business_id", F.posexplode("features").alias("pos", "z")))


def _first(points, k: int) -> list:
    """The points with ids 0..k-1 as centroids."""
    return [r["features"] for r in points.where(F.col("id") < k).orderBy("id").collect()]


def _lloyd_ctes(k: int, steps: int) -> str:
    text = (f", x AS (SELECT id, features FROM points), c0 AS (SELECT id AS cluster, features FROM x WHERE id < {k})")
    for n in range(steps + 1):
        text += f", l{n} AS MATERIALIZED (SELECT id, features, cluster FROM (SELECT a.id, a.features, b.cluster, row_number() OVER (PARTITION BY a.id ORDER BY round({_DOT}, 12), b.cluster) AS r FROM x a, c{n} b) WHERE r = 1)"
        if n < steps:
            means = f"SELECT cluster, list(m ORDER BY p) AS features FROM (SELECT cluster, p, avg(v) AS m FROM (SELECT cluster, unnest(features) AS v, unnest(range(1, 65)) AS p FROM l{n}) GROUP BY 1, 2) GROUP BY 1"
            text += f", m{n} AS ({means}), c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.features, c.features) AS features FROM c{n} c LEFT JOIN m{n} m USING (cluster))"
    return text


def _lloyd_sql(k: int, steps: int) -> str:
    return sql("points", tail=_lloyd_ctes(k, steps)) + f" SELECT id, CAST(cluster AS INT) AS cluster FROM l{steps}"


@query("lloyd_fixed", _lloyd_sql(5, 4))
def lloyd_fixed(spark, sf):
    rows = points(spark, sf)
    centroids, _ = cluster.lloyd(rows, _first(rows, 5), max_iter=4, tol=0)
    return cluster.assign(rows, centroids).select("id", "cluster")


@query("kmeans_best")
def kmeans_best(spark, sf):
    labelled, _, inertia = cluster.kmeans(points(spark, sf), 5)
    return cluster.cluster_sizes(labelled).withColumn("inertia", F.lit(float(inertia)))


@query("choose_k")
def choose_k(spark, sf):
    return cluster.choose_k(cut(points(spark, sf), "points"))


@query(
    "silhouette",
    sql("points", tail=_PAIRS + """, m AS (SELECT d.a, x.label AS la, y.label AS lb, avg(d) AS m FROM d JOIN points x ON x.id = d.a JOIN points y ON y.id = d.b WHERE d.a <> d.b GROUP BY 1, 2, 3),
    s AS (SELECT a, min(m) FILTER (la = lb) AS ai, min(m) FILTER (la <> lb) AS bi FROM m GROUP BY 1)
    SELECT round(avg(CASE WHEN ai IS NULL OR bi IS NULL OR greatest(ai, bi) = 0 THEN 0 ELSE (bi - ai) / greatest(ai, bi) END), 6) AS silhouette FROM s"""),
)
def silhouette(spark, sf):
    return rounded(cluster.silhouette_score(points(spark, sf).withColumnRenamed("label", "cluster")))


@query("k_distance", sql("points", tail=_PAIRS + " SELECT a AS id, round(d, 6) AS d FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d WHERE a <> b) WHERE r = 5"))
def k_distance(spark, sf):
    return rounded(cluster.k_distance(points(spark, sf), 5))


@query("k_distance_quantiles", sql("points", tail=_PAIRS + """, k AS (SELECT d FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d WHERE a <> b) WHERE r = 5)
    SELECT CAST(q AS DOUBLE) AS q, round((SELECT list_extract(quantile_cont(d, [0.0, 0.5, 0.9, 1.0]), i) FROM k), 6) AS value FROM (VALUES (0.0, 1), (0.5, 2), (0.9, 3), (1.0, 4)) t(q, i)"""))
def k_distance_quantiles(spark, sf):
    return rounded(cluster.quantiles(cluster.k_distance(points(spark, sf), 5), "d"))


@query("eps_pairs", sql("points", tail=_PAIRS + " SELECT a, b, round(d, 6) AS d FROM d WHERE d <= 1.1"))
def eps_pairs(spark, sf):
    return rounded(cluster.pairs_within(points(spark, sf), 1.1))


@query("all_pairs_distance", sql("points", tail=_PAIRS + " SELECT a, round(avg(d), 6) AS mean_d, round(max(d), 6) AS max_d FROM d GROUP BY a"))
def all_pairs_distance(spark, sf):
    return rounded(cluster.distance_stats(points(spark, sf)))


_DBSCAN = (
    _PAIRS
    + """, near AS MATERIALIZED (SELECT a, b FROM d WHERE d <= 1.19), core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 5),
    ce AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach AS (SELECT id, id AS root FROM core UNION SELECT r.id, ce.b FROM reach r JOIN ce ON ce.a = r.root), lab AS (SELECT id, min(root) AS component FROM reach GROUP BY id),
    num AS (SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS cluster FROM lab)
    SELECT p.id, coalesce(n.cluster, (SELECT min(num.cluster) FROM near JOIN num ON num.id = near.b WHERE near.a = p.id), -1) AS cluster FROM points p LEFT JOIN num n ON n.id = p.id"""
)


@query("dbscan", sql("points", tail=_DBSCAN).replace("WITH ", "WITH RECURSIVE ", 1))
def dbscan(spark, sf):
    return cluster.dbscan(points(spark, sf), 1.19, 5)


@query("dbscan_summary", "SELECT cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (" + sql("points", tail=_DBSCAN).replace("WITH ", "WITH RECURSIVE ", 1) + ") GROUP BY 1")
def dbscan_summary(spark, sf):
    return rounded(cluster.cluster_sizes(cluster.dbscan(points(spark, sf), 1.19, 5)))


def _silhouette_sql(labels: str) -> str:
    """The mean silhouette of (id, cluster) rows, noise left out, over the distances d."""
    return f"""(WITH lb AS MATERIALIZED (SELECT id, cluster FROM {labels} WHERE cluster >= 0), m AS (SELECT d.a, x.cluster AS la, y.cluster AS ly, avg(d) AS m FROM d JOIN lb x ON x.id = d.a JOIN lb y ON y.id = d.b WHERE d.a <> d.b GROUP BY 1, 2, 3),
    s AS (SELECT a, min(m) FILTER (la = ly) AS ai, min(m) FILTER (la <> ly) AS bi FROM m GROUP BY 1) SELECT avg(CASE WHEN ai IS NULL OR bi IS NULL OR greatest(ai, bi) = 0 THEN 0 ELSE (bi - ai) / greatest(ai, bi) END) FROM lb LEFT JOIN s ON s.a = lb.id)"""


def _compared(name: str, labels: str) -> str:
    n = f"(SELECT count(DISTINCT cluster) FROM {labels} WHERE cluster >= 0)"
    return f"SELECT '{name}' AS method, {n} AS clusters, (SELECT count(*) FROM {labels} WHERE cluster < 0) AS noise, CASE WHEN {n} >= 2 THEN round({_silhouette_sql(labels)}, 6) END AS silhouette"


@query(
    "compare_clusters",
    sql("points", tail=_PAIRS.replace("d AS (", "d AS MATERIALIZED (") + _DBSCAN.removeprefix(_PAIRS).replace(" SELECT p.id, coalesce(n.cluster", ", db AS MATERIALIZED (SELECT p.id, coalesce(n.cluster") + ")" + _lloyd_ctes(5, 4)).replace("WITH ", "WITH RECURSIVE ", 1)
    + f" {_compared('kmeans', 'l4')} UNION ALL {_compared('dbscan', 'db')}",
)
def compare_clusters(spark, sf):
    rows = cut(points(spark, sf), "points")
    centroids, _ = cluster.lloyd(rows, _first(rows, 5), max_iter=4, tol=0)
    return rounded(cluster.compare(rows.select("id", "features"), cluster.assign(rows, centroids), cluster.dbscan(rows, 1.19, 5)))


@query("cluster_profile")
def cluster_profile(spark, sf):
    matrix, _, wide = features.business_features(business(spark, sf), latest(spark, sf), checkins(spark, sf), cat_weight=0.0)
    rows = cut(matrix.withColumnRenamed("business_id", "id"), "matrix")
    centroids, _ = cluster.lloyd(rows, _first(rows, 5), max_iter=10)
    labels = cluster.assign(rows, centroids).select(F.col("id").alias("business_id"), "cluster")
    return cluster.characterise(wide.join(labels, "business_id"))


@query(
    "pca_covariance",
    sql("points", tail=""", v AS (SELECT id, unnest(features) AS x, unnest(range(0, 64)) AS pos FROM points), s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM v GROUP BY 1), z AS (SELECT id, v.pos, (x - m) / sd AS z FROM v JOIN s USING (pos))
    SELECT CAST(a.pos AS INT) AS i, CAST(b.pos AS INT) AS j, round(sum(a.z * b.z) / ((SELECT count(*) FROM points) - 1), 6) AS v FROM z a JOIN z b ON a.id = b.id AND a.pos <= b.pos GROUP BY 1, 2"""),
)
def pca_covariance(spark, sf):
    return rounded(linalg.covariance(_standardised(spark, sf), 64))


def _standardised(spark, sf):
    rows = points(spark, sf).select("id", *[F.col("features")[k].alias(f"c{k}") for k in range(64)])
    return cut(features.standardised(rows, "id", [f"c{k}" for k in range(64)]), "standardised")


@query("pca_explained")
def pca_explained(spark, sf):
    _, _, shares = linalg.pca(_standardised(spark, sf), 64)
    return linalg.scree(spark, shares).withColumn("needed", F.lit(linalg.components_for(shares)))


@query("pca_loadings")
def pca_loadings(spark, sf):
    matrix, names, _ = features.business_features(business(spark, sf), latest(spark, sf), checkins(spark, sf))
    _, vectors, _ = linalg.pca(cut(matrix, "matrix"), len(names))
    return linalg.loadings(spark, names, vectors)


@query("pca_projection")
def pca_projection(spark, sf):
    rows = _standardised(spark, sf)
    _, vectors, _ = linalg.pca(rows, 64)
    return rounded(linalg.project(rows, vectors, 3).select("id", *[F.col("projected")[k].alias(f"pc{k + 1}") for k in range(3)]))


def _text_matrix(spark, sf, terms: int = 2000):
    docs = roles.item_texts(spark, sf)
    weights = cut(recommend.tfidf(docs, docs, terms, normalise=False), "tfidf")
    names = sorted(r["term"] for r in weights.select("term").distinct().collect())  # at most `terms`
    return weights.withColumnRenamed("item", "row"), names, docs.select("item").distinct().count()


@query("svd_curve")
def svd_curve(spark, sf):
    weights, names, n = _text_matrix(spark, sf)
    values, _ = linalg.svd(weights, names)
    frame = linalg.singular_values(spark, values)
    return rounded(linalg.reconstruction(frame, n, len(names), [5, 10, 25, 50, 100, 200, 400]))


@query("latent_factors")
def latent_factors(spark, sf):
    weights, names, _ = _text_matrix(spark, sf)
    _, vectors = linalg.svd(weights, names)
    return linalg.latent_factors(spark, vectors, names, 8, 8)


@query("singular_decay")
def singular_decay(spark, sf):
    weights, names, _ = _text_matrix(spark, sf)
    values, _ = linalg.svd(weights, names)
    frame = linalg.singular_values(spark, values)
    return rounded(frame.join(linalg.running_share(frame), "place").where("place <= 200"))
