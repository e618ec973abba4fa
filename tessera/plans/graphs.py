"""Queries over the friendship and review graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.checkpoint import cut
from tessera.operators import community, graph
from tessera.plans.profiles import latest, rounded
from tessera.plans.registry import ORACLES, query
from tessera.sources import roles
from tessera.sources.roles import sql

#: Reachability by recursion; fine for the small tables that the comparison runs on.
_COMPONENTS = """, reach AS (SELECT id, id AS root FROM nodes UNION SELECT r.id, e.dst FROM reach r JOIN edges e ON e.src = r.root),
labels AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""
_LCC = """, lcc AS (SELECT id FROM labels WHERE component = (SELECT component FROM labels GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)),
inner_edges AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM lcc) AND dst IN (SELECT id FROM lcc))"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def component_graph(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """The friendship graph of the largest component."""
    edges, nodes = roles.friendship(spark, sf)
    edges, nodes = cut(edges, "friends"), cut(nodes, "customers")
    lcc = cut(graph.largest_component(graph.components(edges, nodes)), "lcc")
    return cut(graph.induced(edges, lcc), "lcc-edges"), lcc


@query("bipartite_stats", sql("latest", tail=" SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT business_id) AS n_business, count(*) AS edges, round(count(*) / (count(DISTINCT user_id) * count(DISTINCT business_id)), 9) AS density FROM latest"))
def bipartite_stats(spark, sf):
    return rounded(graph.bipartite_stats(latest(spark, sf)), 9)


@query("friendship_edges", sql("edges", tail=" SELECT src, dst FROM edges"))
def friendship_edges(spark, sf):
    rows = roles.users_with_friends(spark, sf).withColumn("friends_subset", F.when(F.col("friends") == "None", "").otherwise(F.regexp_replace("friends", " ", "")))
    return graph.friendship(rows)[0]


@query("union_edges", sql("pairs", tail=" SELECT a AS src, b AS dst FROM pairs UNION SELECT b, a FROM pairs"))
def union_edges(spark, sf):
    return graph.symmetric(roles.friend_pairs(spark, sf))


@query("components", recursive(sql("edges", "nodes", tail=_COMPONENTS + " SELECT id, component FROM labels")))
def components(spark, sf):
    return graph.components(*roles.friendship(spark, sf))


@query("induced_subgraph", sql("edges", "nodes", tail=" SELECT src, dst FROM edges WHERE src IN (SELECT id FROM nodes WHERE community <> 'BUILDING') AND dst IN (SELECT id FROM nodes WHERE community <> 'BUILDING')"))
def induced_subgraph(spark, sf):
    edges, nodes = roles.friendship(spark, sf)
    return graph.induced(edges, nodes.where("community <> 'BUILDING'"))


@query(
    "bfs_distances",
    recursive(sql("edges", "nodes", tail=", bfs AS (SELECT min(id) AS id, 0 AS depth FROM nodes UNION SELECT e.dst, depth + 1 FROM bfs JOIN edges e ON e.src = bfs.id WHERE depth < 150) SELECT id, CAST(min(depth) AS INT) AS depth FROM bfs GROUP BY id")),
)
def bfs_distances(spark, sf):
    edges, nodes = roles.friendship(spark, sf)
    return graph.distances(cut(edges, "friends"), nodes.agg(F.min("id")).first()[0])


def _sweep(start: str, name: str) -> str:
    return f", {name} AS ({start} UNION SELECT e.dst, depth + 1 FROM {name} b JOIN inner_edges e ON e.src = b.id WHERE depth < 150), {name}_d AS (SELECT id, min(depth) AS depth FROM {name} GROUP BY id)"


@query(
    "friendship_metrics",
    recursive(
        sql(
            "edges",
            "nodes",
            tail=_COMPONENTS
            + _LCC
            + _sweep("SELECT min(id) AS id, 0 AS depth FROM lcc", "s1")
            + ", far AS (SELECT id FROM s1_d ORDER BY depth DESC, id LIMIT 1)"
            + _sweep("SELECT id, 0 AS depth FROM far", "s2")
            + """ SELECT n, edges, round(2.0 * edges / (n * (n - 1)), 9) AS density, n_components, lcc_size, round(lcc_size / n, 9) AS lcc_fraction, diameter
            FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) // 2 FROM edges) AS edges, (SELECT count(DISTINCT component) FROM labels) AS n_components, (SELECT count(*) FROM lcc) AS lcc_size, (SELECT CAST(max(depth) AS INT) FROM s2_d) AS diameter)""",
        )
    ),
)
def friendship_metrics(spark, sf):
    edges, nodes = roles.friendship(spark, sf)
    return rounded(graph.friendship_metrics(cut(edges, "friends"), cut(nodes, "customers")), 9)


@query("build_graphs", f"SELECT a.n_users, a.n_business, a.edges AS review_edges, a.density AS review_density, b.* FROM ({ORACLES['bipartite_stats']}) a, ({ORACLES['friendship_metrics']}) b")
def build_graphs(spark, sf):
    edges, nodes = roles.friendship(spark, sf)
    return rounded(graph.build_graphs(latest(spark, sf), cut(edges, "friends"), cut(nodes, "customers")), 9)


def _pagerank_ctes(iterations: int) -> str:
    """CTEs up to p{iterations} (id, s), after the friendship roles."""
    text = _COMPONENTS + _LCC.replace("lcc AS (", "lcc AS MATERIALIZED (", 1).replace("inner_edges AS (", "inner_edges AS MATERIALIZED (", 1)
    text += ", deg AS MATERIALIZED (SELECT src, count(*) AS d FROM inner_edges GROUP BY src), p0 AS (SELECT id, 1.0 / (SELECT count(*) FROM lcc) AS s FROM lcc)"
    for k in range(iterations):
        text += f", p{k + 1} AS MATERIALIZED (SELECT l.id, 0.15 / (SELECT count(*) FROM lcc) + 0.85 * (coalesce(g.s, 0) + (SELECT coalesce(sum(s), 0) FROM p{k} WHERE id NOT IN (SELECT src FROM deg)) / (SELECT count(*) FROM lcc)) AS s FROM lcc l LEFT JOIN (SELECT e.dst AS id, sum(p.s / deg.d) AS s FROM inner_edges e JOIN p{k} p ON p.id = e.src JOIN deg ON deg.src = e.src GROUP BY 1) g ON g.id = l.id)"
    return text


@query("pagerank", recursive(sql("edges", "nodes", tail=_pagerank_ctes(8))) + " SELECT id, round(s, 9) AS score FROM p8")
def pagerank(spark, sf):
    edges, lcc = component_graph(spark, sf)
    return rounded(graph.pagerank(edges, lcc, max_iter=8, tol=0)[0], 9)


def fans(users: DataFrame) -> DataFrame:
    """Users with `fans`, a number by rule."""
    return users.withColumn("fans", F.pmod(F.col("user_id") * 7, F.lit(101)))


_FRIENDS = "(SELECT src, count(*) AS n_friends FROM edges GROUP BY 1)"


def friends(spark, sf) -> DataFrame:
    return roles.friendship(spark, sf)[0].groupBy(F.col("src").alias("user_id")).agg(F.count("*").alias("n_friends"))


@query(
    "pagerank_top",
    recursive(sql("edges", "nodes", "users", tail=_pagerank_ctes(20)))
    + f" SELECT id, round(s, 9) AS score, name, review_count, (id * 7) % 101 AS fans, n_friends FROM (SELECT id, s FROM p20 ORDER BY round(s, 12) DESC, id LIMIT 15) t LEFT JOIN users u ON u.user_id = t.id LEFT JOIN {_FRIENDS} f ON f.src = t.id",
)
def pagerank_top(spark, sf):
    scores, _ = graph.pagerank(*component_graph(spark, sf), max_iter=20, tol=0)
    profiles = fans(roles.users(spark, sf)).select("user_id", "name", "review_count", "fans").join(friends(spark, sf), "user_id", "left")
    return rounded(graph.top_scores(rounded(scores, 12), profiles, "user_id"), 9)


@query("pagerank_converged")
def pagerank_converged(spark, sf):
    """Until the scores move less than 1e-6 in sum."""
    return graph.pagerank(*component_graph(spark, sf))[0]


@query(
    "pagerank_users",
    recursive(sql("edges", "nodes", "users", tail=_pagerank_ctes(8)))
    + f" SELECT count(*) AS n, round(corr(s, n_friends), 6) AS corr_friends, round(corr(s, (id * 7) % 101), 6) AS corr_fans, round(corr(s, review_count), 6) AS corr_reviews FROM p8 LEFT JOIN users u ON u.user_id = p8.id LEFT JOIN {_FRIENDS} f ON f.src = p8.id",
)
def pagerank_users(spark, sf):
    """PageRank with the profiles of all its users: three correlations."""
    scores, _ = graph.pagerank(*component_graph(spark, sf), max_iter=8, tol=0)
    rows = scores.withColumnRenamed("id", "user_id").join(fans(roles.users(spark, sf)), "user_id", "left").join(friends(spark, sf), "user_id", "left")
    return rounded(rows.agg(F.count("*").alias("n"), F.corr("score", "n_friends").alias("corr_friends"), F.corr("score", "fans").alias("corr_fans"), F.corr("score", "review_count").alias("corr_reviews")))


def _hits_ctes(iterations: int) -> str:
    """CTEs up to h{iterations} and a{iterations} (id, s), after the latest reviews."""
    text = ", w AS MATERIALIZED (SELECT user_id, business_id, count(*) AS w FROM latest GROUP BY 1, 2), h0 AS (SELECT DISTINCT user_id AS id, 1.0 AS s FROM latest)"
    for k in range(iterations):
        text += f", ra{k} AS MATERIALIZED (SELECT business_id AS id, sum(w * s) AS s FROM w JOIN h{k} ON id = user_id GROUP BY 1), a{k + 1} AS MATERIALIZED (SELECT id, s / (SELECT sqrt(sum(s * s)) FROM ra{k}) AS s FROM ra{k})"
        text += f", rh{k} AS MATERIALIZED (SELECT user_id AS id, sum(w * s) AS s FROM w JOIN a{k + 1} ON id = business_id GROUP BY 1), h{k + 1} AS MATERIALIZED (SELECT id, s / (SELECT sqrt(sum(s * s)) FROM rh{k}) AS s FROM rh{k})"
    return text


def _hits_sql(iterations: int) -> str:
    return sql("latest", tail=_hits_ctes(iterations)) + f" SELECT 'hub' AS side, id, round(s, 8) AS score FROM h{iterations} UNION ALL SELECT 'authority', id, round(s, 8) FROM a{iterations}"


@query("hits", _hits_sql(5))
def hits(spark, sf):
    hubs, auths, _ = graph.hits(latest(spark, sf), max_iter=5, tol=0)
    return rounded(hubs.select(F.lit("hub").alias("side"), "*").unionByName(auths.select(F.lit("authority").alias("side"), "*")), 8)


@query(
    "hits_top",
    sql("latest", "business", "users", tail=_hits_ctes(10))
    + """ SELECT 'authority' AS side, id, round(s, 8) AS score, name, review_count FROM (SELECT id, s FROM a10 ORDER BY round(s, 12) DESC, id LIMIT 15) t LEFT JOIN business b ON b.business_id = t.id
    UNION ALL SELECT 'hub', id, round(s, 8), name, review_count FROM (SELECT id, s FROM h10 ORDER BY round(s, 12) DESC, id LIMIT 15) t LEFT JOIN users u ON u.user_id = t.id""",
)
def hits_top(spark, sf):
    hubs, auths, _ = graph.hits(latest(spark, sf), max_iter=10, tol=0)
    columns = ["side", "id", "score", "name", "review_count"]
    top = graph.top_scores(rounded(auths, 12), roles.business(spark, sf).select("business_id", "name", "review_count"), "business_id").withColumn("side", F.lit("authority")).select(*columns)
    return rounded(top.unionByName(graph.top_scores(rounded(hubs, 12), roles.users(spark, sf).select("user_id", "name", "review_count"), "user_id").withColumn("side", F.lit("hub")).select(*columns)), 8)


@query("hits_converged")
def hits_converged(spark, sf):
    """Until the scores of both sides move less than 1e-8 in sum."""
    hubs, auths, _ = graph.hits(latest(spark, sf))
    return hubs.select(F.lit("hub").alias("side"), "*").unionByName(auths.select(F.lit("authority").alias("side"), "*"))


@query("authority_business", sql("latest", "business", tail=_hits_ctes(5)) + " SELECT count(*) AS n, round(corr(s, review_count), 6) AS corr FROM a5 JOIN business b ON b.business_id = a5.id")
def authority_business(spark, sf):
    """Authority against the profiles' review counts."""
    _, auths, _ = graph.hits(latest(spark, sf), max_iter=5, tol=0)
    rows = auths.withColumnRenamed("id", "business_id").join(roles.business(spark, sf), "business_id")
    return rounded(rows.agg(F.count("*").alias("n"), F.corr("score", "review_count").alias("corr")))


@query(
    "modularity",
    sql("edges", "nodes", tail=""", p AS (SELECT id, community FROM nodes), j AS (SELECT a.community AS c1, b.community AS c2 FROM edges JOIN p a ON a.id = src JOIN p b ON b.id = dst),
    t AS (SELECT c1, count(*) AS tot, count(*) FILTER (c1 = c2) AS ins FROM j GROUP BY 1) SELECT round(sum(ins / m - (tot / m) * (tot / m)), 9) AS modularity FROM t, (SELECT count(*) AS m FROM j)"""),
)
def modularity(spark, sf):
    edges, nodes = roles.friendship(spark, sf)
    return rounded(graph.modularity(edges, nodes), 9)


@query(
    "community_summary",
    sql("edges", "nodes", "users", tail=""", p AS (SELECT id, community FROM nodes), s AS (SELECT community, count(*) AS size FROM p GROUP BY 1 ORDER BY size DESC, community LIMIT 5), deg AS (SELECT src AS id, count(*) AS d FROM edges GROUP BY 1),
    e AS (SELECT a.community, count(*) FILTER (a.community = b.community) // 2 AS edges_in, count(*) FILTER (a.community <> b.community) AS edges_out FROM edges JOIN p a ON a.id = src JOIN p b ON b.id = dst GROUP BY 1),
    k AS (SELECT community, name, row_number() OVER (PARTITION BY community ORDER BY coalesce(d, 0) DESC, p.id) AS r FROM p LEFT JOIN deg USING (id) JOIN users u ON u.user_id = p.id),
    m AS (SELECT community, string_agg(name, ', ' ORDER BY r) AS key_members FROM k WHERE r <= 5 GROUP BY 1)
    SELECT s.community, size, edges_in, round_even(2.0 * edges_in / (size * (size - 1)), 4) AS density, edges_out, key_members FROM s JOIN e USING (community) JOIN m USING (community)"""),
)
def community_summary(spark, sf):
    edges, nodes = roles.friendship(spark, sf)
    names = roles.users(spark, sf).select(F.col("user_id").alias("id"), "name")
    return graph.community_summary(edges, nodes, names=names)


@query("louvain")
def louvain(spark, sf):
    return community.louvain(*component_graph(spark, sf))


@query("louvain_parallel")
def louvain_parallel(spark, sf):
    edges, lcc = component_graph(spark, sf)
    found = community.louvain(edges, lcc, mode="parallel")
    return graph.modularity(edges, found).crossJoin(found.agg(F.count_distinct("community").alias("communities")))


@query("bfs_sample")
def bfs_sample(spark, sf):
    edges, lcc = component_graph(spark, sf)
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("score"))
    return community.bfs_sample(edges, cut(community.louvain(edges, lcc), "found"), degree)


@query("force_layout")
def force_layout(spark, sf):
    edges, lcc = component_graph(spark, sf)
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("score"))
    nodes = cut(community.bfs_sample(edges, cut(community.louvain(edges, lcc), "found"), degree).select("id"), "sample")
    return community.spring_layout(graph.induced(edges, nodes), nodes, 60)


_LENSES = recursive(sql("edges", "nodes", "latest", "users", tail=_pagerank_ctes(8) + _hits_ctes(5))) + ", lens AS MATERIALIZED (SELECT p.id, round(p.s, 12) AS pr, round(h.s, 12) AS hub FROM p8 p JOIN h5 h ON h.id = p.id), ranked AS MATERIALIZED (SELECT *, rank() OVER (ORDER BY pr DESC) AS pr_rank, rank() OVER (ORDER BY hub DESC) AS hub_rank FROM lens)"


def lenses(spark, sf) -> tuple[DataFrame, DataFrame]:
    scores, _ = graph.pagerank(*component_graph(spark, sf), max_iter=8, tol=0)
    hubs, _, _ = graph.hits(latest(spark, sf), max_iter=5, tol=0)
    return rounded(scores, 12), rounded(hubs, 12)


@query(
    "lens_overlap",
    _LENSES
    + """, shared AS (SELECT id FROM (SELECT id FROM ranked ORDER BY pr_rank, id LIMIT 15) INTERSECT SELECT id FROM (SELECT id FROM ranked ORDER BY hub_rank, id LIMIT 15))
    SELECT (SELECT count(*) FROM ranked) AS n, (SELECT round(corr(pr, hub), 6) FROM ranked) AS corr, (SELECT count(*) FROM shared) AS overlap, (SELECT coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)), '') FROM shared) AS pillars""",
)
def lens_overlap(spark, sf):
    return rounded(graph.influence_lenses(*lenses(spark, sf)))


@query("influence_ranks", _LENSES + f" SELECT r.id, pr_rank, hub_rank, name, review_count, (r.id * 7) % 101 AS fans, n_friends FROM ranked r LEFT JOIN users u ON u.user_id = r.id LEFT JOIN {_FRIENDS} f ON f.src = r.id")
def influence_ranks(spark, sf):
    """Both lenses' ranks of each user that has both, with their profiles."""
    profiles = fans(roles.users(spark, sf)).select(F.col("user_id").alias("id"), "name", "review_count", "fans").join(friends(spark, sf).withColumnRenamed("user_id", "id"), "id", "left")
    return graph.joined_lenses(*lenses(spark, sf), profiles).drop("pr", "hub")


@query(
    "rank_correlation",
    sql("edges", "latest", "users", tail=""" SELECT round(corr(d, review_count), 6) AS corr_profile, round(corr(d, n), 6) AS corr_reviews FROM users u
    JOIN (SELECT src, count(*) AS d FROM edges GROUP BY 1) e ON src = u.user_id LEFT JOIN (SELECT user_id, count(*) AS n FROM latest GROUP BY 1) c ON c.user_id = u.user_id"""),
)
def rank_correlation(spark, sf):
    edges, _ = roles.friendship(spark, sf)
    degree = edges.groupBy(F.col("src").alias("user_id")).agg(F.count("*").alias("d"))
    counts = latest(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    rows = degree.join(roles.users(spark, sf), "user_id").join(counts, "user_id", "left")
    return rounded(rows.agg(F.corr("d", "review_count").alias("corr_profile"), F.corr("d", "n").alias("corr_reviews")))
