"""Queries that put operators together: drawing frames, samples of groups, SQL over the roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.checkpoint import cut
from tessera.operators import cluster, community, drawing, graph, sampling, sketch
from tessera.plans.clusters import points
from tessera.plans.graphs import component_graph
from tessera.plans.profiles import latest, rounded
from tessera.plans.registry import query
from tessera.sources import roles, views
from tessera.sources.roles import sql


@query("community_drawing")
def community_drawing(spark, sf):
    edges, lcc = component_graph(spark, sf)
    degree = cut(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("score")), "degree")
    found = cut(community.louvain(edges, lcc), "found")
    nodes = cut(community.bfs_sample(edges, found, degree).select("id"), "sample")
    inner = cut(graph.induced(edges, nodes), "inner")
    layout = cut(community.spring_layout(inner, nodes, 60), "layout")
    return drawing.communities(inner, layout, found, degree)[0]


@query("clusters_plane")
def clusters_plane(spark, sf):
    rows = cut(points(spark, sf).select("id", "features"), "points")
    centroids, _ = cluster.lloyd(rows, [r["features"] for r in rows.orderBy("id").limit(5).collect()], max_iter=4, tol=0)
    return drawing.plane(rows, cluster.assign(rows, centroids).select("id", "cluster"), 64)


@query("group_sample", sql("users", tail=" SELECT state, least(count(*), 20) AS n FROM users GROUP BY 1 ORDER BY count(*) DESC, state LIMIT 3"))
def group_sample(spark, sf):
    found = sampling.largest_groups_sample(roles.users(spark, sf), "state", "user_id", 3, 20)
    return found.groupBy("state").agg(F.count("*").alias("n"))


_MONTHLY = """SELECT u.state, year(r.date) AS year, count(*) AS n, round(avg(r.stars), 6) AS mean_stars
FROM reviews r JOIN users u ON u.user_id = r.user_id WHERE r.stars >= 2 GROUP BY u.state, year(r.date) HAVING count(*) > 5"""


@query("sql_view", sql("reviews", "users", tail=" " + _MONTHLY))
def sql_view(spark, sf):
    return views.run(spark, sf, _MONTHLY).withColumn("year", F.col("year").cast("long"))


@query("grouping_sets", sql("business", tail=" SELECT state, is_open, count(*) AS n, round(avg(stars), 6) AS mean_stars FROM business GROUP BY GROUPING SETS ((state, is_open), (state), ())"))
def grouping_sets(spark, sf):
    return rounded(views.run(spark, sf, "SELECT state, is_open, count(*) AS n, avg(stars) AS mean_stars FROM business GROUP BY GROUPING SETS ((state, is_open), (state), ())"))


@query("sketch_union", "SELECT 'all' AS period, CAST(h % 256 AS INT) AS bucket, CAST(max(CASE WHEN h // 256 = 0 THEN 32 ELSE bit_count(((h // 256) & (-(h // 256))) - 1) + 1 END) AS INT) AS rho FROM (SELECT (%d * (CAST(user_id AS BIGINT) & 2147483647) + %d) %% %d AS h FROM events) GROUP BY 2".replace("h % 256", "h %% 256") % (sketch.LOGLOG_A, sketch.LOGLOG_B, sketch.PRIME))
def sketch_union(spark, sf):
    events = roles.events(spark, sf)
    parts = [sketch.loglog_registers(events.where(c), "user_id") for c in ("event_type = 'view'", "event_type <> 'view'")]
    return sketch.merge_loglog(*parts)


@query("inner_lens", sql("latest", "business", tail=" SELECT round(corr(n, review_count), 6) AS corr, count(*) AS n FROM business b JOIN (SELECT business_id, count(*) AS n FROM latest GROUP BY 1) c ON c.business_id = b.business_id"))
def inner_lens(spark, sf):
    counts = latest(spark, sf).groupBy("business_id").agg(F.count("*").alias("n"))
    rows = roles.business(spark, sf).join(counts, "business_id")
    return rounded(rows.agg(F.corr("n", "review_count").alias("corr"), F.count("*").alias("n")))
