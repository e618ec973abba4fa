"""Graphs as edge tables; iterations cut their lineage in the shared folder."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoint import counted, cut, drop

#: Directed edges up to which components are found, and PageRank is iterated, in one task, with the same result.
FEW_EDGES = 2_000_000


def build_graphs(reviews: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: the sizes and densities of the review graph and of the friendship graph."""
    review = bipartite_stats(reviews).withColumnRenamed("edges", "review_edges").withColumnRenamed("density", "review_density")
    return review.crossJoin(F.broadcast(friendship_metrics(edges, nodes)))


def dealt(frame: DataFrame, key: str) -> DataFrame:
    """The frame dealt by a key and held, so that joins on the key in each round of a loop shuffle only the other side.

    What is lost with an executor is read and dealt again; give it back with unpersist().
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(parts, key).persist(StorageLevel.MEMORY_AND_DISK)


def symmetric(pairs: DataFrame) -> DataFrame:
    """(src, dst) in both directions, distinct, of (a, b) pairs."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a")).distinct()


def friendship(users: DataFrame, key: str = "user_id", friends: str = "friends_subset") -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of users whose friends are a comma-separated text; friends that are no users become nodes."""
    each = users.select(F.col(key).alias("a"), F.explode(F.split(friends, ",")).alias("b")).where("b <> ''")
    edges = symmetric(each.withColumn("b", F.col("b").cast(users.schema[key].dataType)))
    return edges, users.select(F.col(key).alias("id")).union(edges.select("src")).distinct()


def bipartite_stats(reviews: DataFrame) -> DataFrame:
    """(n_users, n_business, edges, density) of all reviews, repeated ones too."""
    row = reviews.agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("business_id").alias("n_business"), F.count("*").alias("edges"))
    cells = F.col("n_users") * F.col("n_business")
    return row.withColumn("density", F.when(cells > 0, F.col("edges") / cells).otherwise(0.0))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable; nodes without edges are their own.

    Edges stand in both directions.  Few of them are joined up in one task, more
    of them in rounds: a round gives each node, and the node that its label
    names, the least label that the labels of its neighbours have, so trees of
    labels merge at their roots and long paths take few rounds.  Labels only
    fall; a round that changes none is the last.
    """
    links, size = counted(edges.where("src <> dst").select("src", "dst"), "edges", n=F.count("*"))
    if size["n"] <= FEW_EDGES:
        ids = nodes.select("id").distinct()
        found = cut(_joined_up(induced(links, ids).where("src < dst")), "linked")
        return cut(ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels")
    held = dealt(links, "src")
    labels = cut(nodes.select("id").distinct().withColumn("component", F.col("id")), "labels")
    before = None
    while True:
        further = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        both = labels.join(further, "component").select("id", "component", "further")
        told = held.join(both.select("id", "further"), held.src == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min("further").alias("near"))
        nearer = both.join(told, "id", "left")
        roots = nearer.where("near < component").groupBy(F.col("component").alias("id")).agg(F.min("near").alias("root"))
        moved = nearer.join(roots, "id", "left").select("id", F.least("component", "further", "near", "root").alias("component"))
        old = labels
        labels, now = counted(moved, "labels", digest=F.sum(F.xxhash64("id", "component").cast("decimal(38,0)")))
        drop(old)
        if now == before:
            held.unpersist()
            return labels
        before = now


def _joined_up(links: DataFrame) -> DataFrame:
    """(id, component) of the linked nodes, in one task: the greater of two linked labels takes the lesser, then paths are shortened."""
    kind = links.schema["src"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, ids = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True), sort=True)
        a, b = codes[: len(pdf)], codes[len(pdf) :]
        labels = np.arange(len(ids))
        while True:
            low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
            if (low == high).all():
                return pd.DataFrame({"id": ids, "component": ids[labels]})
            np.minimum.at(labels, high, low)
            while (labels != (further := labels[labels])).any():
                labels = further

    return links.groupBy(F.lit(1).alias("one")).applyInPandas(run, f"id {kind}, component {kind}")


def largest_component(labels: DataFrame) -> DataFrame:
    """(id) of the biggest component; of equal ones the least label."""
    biggest = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return labels.join(F.broadcast(biggest), "component", "left_semi").select("id")


#: Hops of one pass of a search whose frontier is small, and nodes of a small frontier.
HOPS, SMALL_FRONTIER = 8, 10_000


def distances(edges: DataFrame, source, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of all nodes reachable from a source (in max_depth steps, if given).

    A pass takes one hop from a large frontier and several from a small one; a
    pass of several hops may meet nodes again, which keep their least depth.
    """
    kind = edges.schema["src"].dataType
    held = dealt(edges.select("src", "dst"), "src")
    frontier = cut(edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("id"), F.lit(0).alias("depth")), "frontier")
    seen, depth, size = [frontier], 0, 1
    while size and (max_depth is None or depth < max_depth):
        hops = HOPS if size <= SMALL_FRONTIER else 1
        if max_depth is not None:
            hops = min(hops, max_depth - depth)
        at, met = frontier.select("id"), None
        for h in range(1, hops + 1):
            at = held.join(at, held.src == at.id).select(F.col("dst").alias("id")).distinct()
            here = at.withColumn("depth", F.lit(depth + h))
            met = here if met is None else met.unionByName(here)
        known = reduce(DataFrame.unionByName, seen).select("id")
        fresh = met.groupBy("id").agg(F.min("depth").alias("depth")).join(known, "id", "left_anti")
        depth += hops
        fresh, found = counted(fresh, "frontier", last=F.count_if(F.col("depth") == depth))
        seen.append(fresh)
        if len(seen) > 10:
            seen = [cut(reduce(DataFrame.unionByName, seen), "seen")]
        frontier, size = fresh.where(F.col("depth") == depth), found["last"]
    held.unpersist()
    return reduce(DataFrame.unionByName, seen)


def farthest(edges: DataFrame, source) -> tuple[object, int]:
    """The node of greatest depth (of equal ones the least id) and its depth."""
    row = distances(edges, source).orderBy(F.desc("depth"), "id").first()
    return row["id"], row["depth"]


def approx_diameter(edges: DataFrame, nodes: DataFrame) -> int:
    """Double sweep from the least node: a lower bound of the diameter."""
    start = nodes.agg(F.min("id")).first()[0]
    if start is None:
        return 0
    far, _ = farthest(edges, start)
    return farthest(edges, far)[1]


def friendship_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: n, edges, density, n_components, lcc_size, lcc_fraction, diameter."""
    labels = components(edges, nodes)
    lcc = cut(largest_component(labels), "lcc")
    diameter = approx_diameter(cut(induced(edges, lcc), "lcc-edges"), lcc)
    row = nodes.select("id").distinct().agg(F.count("*").alias("n")).crossJoin(edges.agg(F.floor(F.count("*") / 2).alias("edges")))
    row = row.crossJoin(labels.agg(F.count_distinct("component").alias("n_components"))).crossJoin(lcc.agg(F.count("*").alias("lcc_size")))
    n = F.col("n")
    return row.select(
        "n", "edges", F.when(n > 1, 2 * F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"), "n_components", "lcc_size", (F.col("lcc_size") / n).alias("lcc_fraction"), F.lit(diameter).alias("diameter")
    )


def pagerank(edges: DataFrame, nodes: DataFrame, d: float = 0.85, max_iter: int = 100, tol: float = 1e-6, every: int = 8) -> tuple[DataFrame, int]:
    """((id, score), iterations) on the nodes' subgraph; what dangling nodes hold is spread evenly.

    Links are dealt by their source once and nodes by their id, so a round
    shuffles what links give, summed a target and task, and nothing else.  tol 0
    runs all iterations without comparing.  Scores are cut to the shared folder
    every few rounds, and at each comparison.  Few links are iterated in one
    task, up to the order in which sums are added.
    """
    nodes = cut(nodes.select("id").distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0)), 0
    links, size = counted(induced(edges, nodes).select("src", "dst"), "links", n=F.count("*"))
    if 0 < size["n"] <= FEW_EDGES and max_iter > 0:
        return _few_links(links, nodes, n, d, max_iter, tol)
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    every_node = dealt(nodes.join(degree.withColumnRenamed("src", "id"), "id", "left"), "id")
    links = dealt(links, "src")
    has_dangling = not every_node.where("degree is null").isEmpty()
    scores = every_node.select("id", F.lit(1.0 / n).alias("score"))
    done = 0
    for done in range(1, max_iter + 1):
        # a node's score over its degree is worked out before the join, so a hot source only repeats a number
        each = every_node.where("degree is not null").join(scores, "id").select("id", (F.col("score") / F.col("degree")).alias("share"))
        given = links.join(each, links.src == each.id).groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        base = F.lit((1 - d) / n)
        after = every_node.select("id").join(given, "id", "left")
        if has_dangling:
            lost = scores.join(every_node.where("degree is null").select("id"), "id").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
            after = after.crossJoin(F.broadcast(lost))
            base = base + d * F.col("lost") / n
        after = after.select("id", (base + d * F.coalesce("got", F.lit(0.0))).alias("score"))
        if tol > 0 or done % every == 0 or done == max_iter:
            after = cut(after, "scores")
        if tol > 0:
            moved = after.join(scores.withColumnRenamed("score", "old"), "id").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
            scores = after
            if moved < tol:
                break
        else:
            scores = after
    links.unpersist()
    every_node.unpersist()
    return scores, done


def _few_links(links: DataFrame, nodes: DataFrame, n: int, d: float, max_iter: int, tol: float) -> tuple[DataFrame, int]:
    """pagerank() of few links: linked nodes in one task; the others all have the score that a node without links into it has."""
    kind = links.schema["src"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, ids = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
        src, dst = codes[: len(pdf)], codes[len(pdf) :]
        degree = np.bincount(src, minlength=len(ids))
        ends, others = degree == 0, n - len(ids)
        scores, other = np.full(len(ids), 1.0 / n), 1.0 / n
        for done in range(1, max_iter + 1):
            share = scores / np.maximum(degree, 1)
            base = (1 - d) / n + d * (scores[ends].sum() + others * other) / n
            after = base + d * np.bincount(dst, share[src], len(ids))
            moved = np.abs(after - scores).sum() + others * abs(base - other)
            scores, other = after, base
            if tol > 0 and moved < tol:
                break
        return pd.DataFrame({"id": ids, "score": scores, "other": other, "done": done})

    found = links.groupBy(F.lit(1).alias("one")).applyInPandas(run, f"id {kind}, score double, other double, done int")
    found, seen = counted(found, "ranked", other=F.max("other"), done=F.max("done"))
    return cut(nodes.join(found.select("id", "score"), "id", "left").select("id", F.coalesce("score", F.lit(seen["other"])).alias("score")), "scores"), seen["done"]


def top_scores(scores: DataFrame, profiles: DataFrame, key: str, k: int = 15) -> DataFrame:
    """The k highest scores (of equal ones the least id) with the profiles of their ids."""
    top = scores.orderBy(F.desc("score"), "id").limit(k)
    return F.broadcast(top).join(profiles, top.id == profiles[key], "left").drop(key)


def hits(pairs: DataFrame, max_iter: int = 100, tol: float = 1e-8) -> tuple[DataFrame, DataFrame, int]:
    """(hubs, authorities, iterations) of (user_id, business_id) pairs, repeated ones counted.

    Authorities first, then hubs from the new authorities, each with length 1.
    """
    weighted = cut(pairs.groupBy("user_id", "business_id").agg(F.count("*").alias("w")), "pairs")
    hubs = weighted.select(F.col("user_id").alias("id")).distinct().withColumn("score", F.lit(1.0))
    auths = weighted.select(F.col("business_id").alias("id")).distinct().withColumn("score", F.lit(1.0))
    done = 0

    def step(scores: DataFrame, side: str, other: str) -> DataFrame:
        raw = weighted.join(scores, weighted[side] == scores.id).groupBy(F.col(other).alias("id")).agg(F.sum(F.col("w") * F.col("score")).alias("raw"))
        raw = cut(raw, "raw")  # read twice: for the length and for the scores
        norm = raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        return raw.crossJoin(F.broadcast(norm)).select("id", (F.col("raw") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("score"))

    def moved(a: DataFrame, b: DataFrame) -> float:
        return a.join(b.withColumnRenamed("score", "old"), "id").agg(F.coalesce(F.sum(F.abs(F.col("score") - F.col("old"))), F.lit(0.0))).first()[0]

    for done in range(1, max_iter + 1):
        new_auths = step(hubs, "user_id", "business_id")
        new_hubs = step(new_auths, "business_id", "user_id")
        change = moved(new_auths, auths) + moved(new_hubs, hubs) if tol > 0 else float("inf")
        hubs, auths = new_hubs, new_auths
        if change < tol:
            break
    return hubs, auths, done


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: the partition's modularity over weighted edges (both directions; w, or 1 without it)."""
    weighted = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))
    a = partition.select(F.col("id").alias("src"), F.col("community").alias("c1"))
    b = partition.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    named = weighted.join(a, "src").join(b, "dst")
    per = named.groupBy("c1").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("inside"))
    whole = per.agg(F.sum("tot").alias("two_m"))
    share = F.col("inside") / F.col("two_m") - F.pow(F.col("tot") / F.col("two_m"), 2)
    return per.crossJoin(F.broadcast(whole)).agg(F.coalesce(F.sum(F.when(F.col("two_m") > 0, share)), F.lit(0.0)).alias("modularity"))


def community_summary(edges: DataFrame, partition: DataFrame, scores: DataFrame | None = None, names: DataFrame | None = None, top_k: int = 5, n_key: int = 5) -> DataFrame:
    """The biggest communities: size, inner edges, density, outer edge ends, names of the highest members.

    `scores` (id, score) ranks members, else their degree does; `names` (id,
    name) names them, else the id does.
    """
    sizes = partition.groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community").limit(top_k)
    members = partition.join(F.broadcast(sizes.select("community")), "community")
    a = members.select(F.col("id").alias("src"), "community")
    other = partition.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    ends = edges.join(a, "src").join(other, "dst", "left").groupBy("community").agg(
        F.floor(F.sum(F.when(F.col("community") == F.col("c2"), 1).otherwise(0)) / 2).alias("edges_in"),
        F.sum(F.when(F.col("community") == F.col("c2"), 0).otherwise(1)).alias("edges_out"),
    )
    rank = scores if scores is not None else edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("score"))
    ranked = members.join(rank, "id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("score"), "id"))
    best = ranked.withColumn("place", place).where(F.col("place") <= n_key)
    if names is not None:
        best = best.join(names.select("id", F.col("name").alias("_name")), "id", "left")
        label = F.coalesce("_name", F.col("id").cast("string"))
    else:
        label = F.col("id").cast("string")
    key = best.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", label.alias("name")))), lambda x: x["name"]), ", ").alias("key_members"))
    n = F.col("size")
    out = sizes.join(ends, "community", "left").join(key, "community", "left")
    inside = F.coalesce("edges_in", F.lit(0))
    return out.select("community", "size", inside.alias("edges_in"), F.when(n > 1, F.bround(2 * inside / (n * (n - 1)), 4)).otherwise(0.0).alias("density"), F.coalesce("edges_out", F.lit(0)).alias("edges_out"), "key_members")


def joined_lenses(pagerank_scores: DataFrame, hub_scores: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(id, pr, hub, pr_rank, hub_rank and the profiles' columns) of the ids that have both scores; ranks from the highest, ties share the least."""
    both = cut(pagerank_scores.select("id", F.col("score").alias("pr")).join(hub_scores.select("id", F.col("score").alias("hub")), "id"), "lenses")
    ranked = ranks(ranks(both, "pr", "pr_rank"), "hub", "hub_rank")
    return ranked if profiles is None else ranked.join(profiles, "id", "left")


def influence_lenses(pagerank_scores: DataFrame, hub_scores: DataFrame, k: int = 15) -> DataFrame:
    """One row: correlation of the two scores over shared ids and how many of the top k they share, with the ids."""
    both = joined_lenses(pagerank_scores, hub_scores)
    both = cut(both, "ranked")
    tops = [both.orderBy(c, "id").limit(k).select("id") for c in ("pr_rank", "hub_rank")]
    shared = tops[0].intersect(tops[1]).agg(F.count("*").alias("overlap"), F.coalesce(F.array_join(F.sort_array(F.collect_list(F.col("id").cast("string"))), ","), F.lit("")).alias("pillars"))
    return both.agg(F.count("*").alias("n"), F.corr("pr", "hub").alias("corr")).crossJoin(shared)


def ranks(scores: DataFrame, column: str = "score", name: str = "rank") -> DataFrame:
    """Descending ranks, ties share the least: counted per distinct score, not in one big window."""
    from tessera.operators.audit import running

    groups = scores.groupBy(column).agg(F.count("*").alias("_n")).withColumn("_down", -F.col(column))
    ranked = running(groups, "_down", {"_upto": F.col("_n")}).select(column, (F.col("_upto") - F.col("_n") + 1).alias(name))
    return scores.join(ranked, column)
