"""Louvain communities: synchronous moves in DataFrames, an exact sequential mode for graphs that fit one task."""

from __future__ import annotations

import itertools
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoint import counted, cut
from tessera.operators.audit import running
from tessera.operators.graph import modularity

#: Directed edges of the largest graph that one task may hold.
EXACT_EDGES = 2_000_000
#: Directed edges of a level from which on synchronous rounds run in one task, with the same result.
FEW_EDGES = 2_000_000


def weighted(edges: DataFrame) -> DataFrame:
    return edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))


def _moves(edges: DataFrame, labels: DataFrame, two_m: float, resolution: float, half: int, rounds: int) -> DataFrame:
    """One synchronous round: nodes of one hash half go to the neighbour community with the largest gain.

    Of two nodes alone in their communities only one goes to the other, or they
    would change places for ever.
    """
    strength = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    totals = labels.join(strength, "id", "left").groupBy("community").agg(F.sum(F.coalesce("k", F.lit(0.0))).alias("tot"), F.count("*").alias("size"))
    around = edges.where("src <> dst").join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("into"))
    own = labels.join(totals.select("community", F.col("size").alias("own_size")), "community").withColumnRenamed("community", "own")
    active = F.pmod(F.xxhash64("id", F.lit(rounds // 2)), F.lit(2)) == half
    options = around.join(own.where(active), "id").join(strength, "id").join(totals, "community")
    without = F.when(F.col("community") == F.col("own"), F.col("tot") - F.col("k")).otherwise(F.col("tot"))
    gained = options.select("id", "own", "own_size", "community", "size", (F.col("into") - resolution * without * F.col("k") / two_m).alias("gain"))
    best = gained.groupBy("id", "own", "own_size").agg(F.max_by(F.struct("community", "size"), F.struct("gain", -F.xxhash64("community"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("stay"))
    best = best.select("id", "own", "own_size", "to.community", "to.size", "gain", "stay")
    # a node alone in its community loses nothing by leaving it: its own gain is what its strength costs, 0
    swap = (F.col("own_size") == 1) & (F.col("size") == 1) & (F.xxhash64("community") > F.xxhash64("own"))
    moved = best.where((F.col("gain") > F.coalesce("stay", F.lit(0.0)) + 1e-12) & (F.col("community") != F.col("own")) & ~swap).select("id", F.col("community").alias("to"))
    return labels.join(moved, "id", "left").select("id", F.coalesce("to", "community").alias("community"))


def louvain(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, max_levels: int = 50, max_rounds: int = 24, mode: str = "parallel") -> DataFrame:
    """(id, community) with communities numbered by size, the biggest 0.

    mode "parallel": synchronous rounds and DataFrame aggregation by community,
    at every size; "exact": sequential sweeps in node order inside one task,
    refused over EXACT_EDGES.  Without edges all nodes get 0.
    """
    if mode not in ("parallel", "exact"):
        raise ValueError(f"no mode {mode}")
    edges = cut(weighted(edges).select("src", "dst", F.col("w").cast("double").alias("w")), "edges")
    nodes = nodes.select("id").distinct()
    size = edges.count()
    if not size:
        return nodes.withColumn("community", F.lit(0).cast("long"))
    if mode == "exact" and size > EXACT_EDGES:
        raise ValueError(f"{size} edges are too many for one task")
    found = _sequential(edges, nodes, resolution, max_levels) if mode == "exact" else _parallel(edges, nodes, resolution, max_levels, max_rounds)
    found = cut(found, "communities")
    sizes = found.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    numbered = running(sizes.withColumn("_order", F.struct((-F.col("n")).alias("n"), "least")), "_order", {"number": F.lit(1)})
    return found.join(numbered.select("community", "number"), "community").select("id", (F.col("number") - 1).alias("community"))


def _warn(limit: int, what: str) -> None:
    warnings.warn(f"communities may still improve: {limit} {what} are over", stacklevel=4)


def _parallel(edges: DataFrame, nodes: DataFrame, resolution: float, max_levels: int, max_rounds: int) -> DataFrame:
    two_m = edges.agg(F.sum("w")).first()[0]
    whole = nodes.select("id", F.col("id").alias("community"))
    level, best, size = edges, -1.0, edges.count()
    for deeper in reversed(range(max_levels)):
        if size <= FEW_EDGES:
            step, over = counted(_few(level, two_m, resolution, best, deeper + 1, max_rounds), "merged", rounds=F.max("rounds"), levels=F.max("levels"))
            if over["rounds"]:
                _warn(max_rounds, "rounds of a level")
            if over["levels"]:
                _warn(max_levels, "levels")
            step = step.select(F.col("id").alias("community"), F.col("community").alias("next"))
            return whole.join(step, "community", "left").select("id", F.coalesce("next", "community").alias("community"))
        labels = cut(level.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")), "labels")
        quality = modularity(level, labels).first()[0]
        for r in range(max_rounds):
            moved = cut(_moves(level, labels, two_m, resolution, r % 2, r), "labels")
            now = modularity(level, moved).first()[0]
            if now > quality + 1e-9:
                labels, quality = moved, now
            elif r % 2:
                break
        else:
            _warn(max_rounds, "rounds of a level")
        if quality <= best + 1e-9:
            break
        best = quality
        step = labels.select(F.col("id").alias("community"), F.col("community").alias("next"))
        whole = cut(whole.join(step, "community", "left").select("id", F.coalesce("next", "community").alias("community")), "whole")
        a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("s")), labels.select(F.col("id").alias("dst"), F.col("community").alias("d"))
        if not deeper:
            _warn(max_levels, "levels")
        level, found = counted(level.join(a, "src").join(b, "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")), "level", n=F.count("*"))
        size = found["n"]
    return whole


def _few(level: DataFrame, two_m: float, resolution: float, best: float, max_levels: int, max_rounds: int) -> DataFrame:
    """(id, community, rounds, levels) of a small level's nodes: all its rounds and levels in one task; the last two are 1 where a limit ended them."""
    kind = level.schema["src"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, ids = pd.factorize(pdf["src"])
        to = pd.Index(ids).get_indexer(pdf["dst"])
        hashes = np.zeros(len(ids), np.int64)
        hashes[codes] = pdf["hash"].to_numpy()
        found, rounds, levels = synchronous_levels(codes, to, pdf["w"].to_numpy(float), hashes, two_m, resolution, best, max_levels, max_rounds)
        return pd.DataFrame({"id": ids, "community": ids[found], "rounds": int(rounds), "levels": int(levels)})

    rows = level.select("src", "dst", "w", F.xxhash64("src").alias("hash"))
    return rows.groupBy(F.lit(1).alias("one")).applyInPandas(run, f"id {kind}, community {kind}, rounds int, levels int")


def _hash_int(value: int, seeds: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int after columns whose hashes are the seeds."""
    u = np.uint64
    p1, p2, p3, p5 = u(0x9E3779B185EBCA87), u(0xC2B2AE3D27D4EB4F), u(0x165667B19E3779F9), u(0x27D4EB2F165667C5)
    with np.errstate(over="ignore"):
        h = (seeds.view(u) + p5 + u(4)) ^ (u(value) * p1)
        h = ((h << u(23)) | (h >> u(41))) * p2 + p3
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        return h ^ (h >> u(32))


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below n and the sums of their weights."""
    keys, place = np.unique(a.astype(np.int64) * n + b, return_inverse=True)
    return keys // n, keys % n, np.bincount(place, w, len(keys))


def synchronous_levels(src, dst, w, hashes, two_m: float, resolution: float, best: float, max_levels: int, max_rounds: int) -> tuple[np.ndarray, bool, bool]:
    """The rounds and levels of _parallel over arrays; (a node of the community each node ends in, whether rounds, whether levels were over).

    Nodes are numbers, communities are named by a node; -1 in dst is no node.
    """
    whole, rounds_over, nodes = np.arange(len(hashes)), False, np.unique(src)
    n = len(hashes)
    for deeper in reversed(range(max_levels)):
        known = dst >= 0
        strength = np.bincount(src, w, n)
        a, b, inner = src[known], dst[known], w[known]
        apart = a != b

        def quality(labels, a=a, b=b, inner=inner):
            total = np.bincount(labels[a], inner, n)
            inside = np.bincount(labels[a], np.where(labels[a] == labels[b], inner, 0.0), n)
            m = total.sum()
            return float((inside / m - (total / m) ** 2).sum()) if m > 0 else 0.0

        labels = np.arange(n)
        here = quality(labels)
        for r in range(max_rounds):
            moving = apart & ((_hash_int(r // 2, hashes) & np.uint64(1)) == r % 2)[a]
            total, size = np.bincount(labels[nodes], strength[nodes], n), np.bincount(labels[nodes], minlength=n)
            node, to, into = _summed(a[moving], labels[b[moving]], inner[moving], n)
            own = labels[node]
            gain = into - resolution * np.where(to == own, total[to] - strength[node], total[to]) * strength[node] / two_m
            stay = np.zeros(n)
            stay[node[to == own]] = gain[to == own]
            order = np.lexsort((-hashes[to], gain, node))
            last = order[np.flatnonzero(np.diff(node[order], append=-1))]
            node, to, own, gain = node[last], to[last], own[last], gain[last]
            swap = (size[own] == 1) & (size[to] == 1) & (hashes[to] > hashes[own])
            go = (gain > stay[node] + 1e-12) & (to != own) & ~swap
            moved = labels.copy()
            moved[node[go]] = to[go]
            now = quality(moved)
            if now > here + 1e-9:
                labels, here = moved, now
            elif r % 2:
                break
        else:
            rounds_over = True
        if here <= best + 1e-9:
            return whole, rounds_over, False
        best = here
        whole = labels[whole]
        src, dst, w = _summed(labels[a], labels[b], inner, n)
        nodes = np.unique(src)
    return whole, rounds_over, True


def _sequential(edges: DataFrame, nodes: DataFrame, resolution: float, max_levels: int) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["src"]) | set(pdf["dst"]))
        place = {v: k for k, v in enumerate(ids)}
        graph: list[dict[int, float]] = [{} for _ in ids]
        for s, d, w in sorted(zip(pdf["src"].map(place), pdf["dst"].map(place), pdf["w"], strict=True)):
            graph[s][d] = graph[s].get(d, 0.0) + w
        found = sweep_levels(graph, resolution, max_levels)
        return pd.DataFrame({"id": ids, "community": found})

    grouped = edges.groupBy(F.lit(1).alias("one")).applyInPandas(run, f"id {kind}, community long")
    linked = grouped.select("id", F.col("community"))
    alone = nodes.join(linked, "id", "left_anti")
    return linked.select("id", F.concat(F.lit("c"), F.col("community").cast("string")).alias("community")).unionByName(alone.select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("community")))


def sweep_levels(graph: list[dict[int, float]], resolution: float = 1.0, max_levels: int = 50) -> list[int]:
    """Communities of nodes 0..n-1 by repeated sweeps in node order and merging."""
    two_m = sum(map(sum, (row.values() for row in graph)))
    member = list(range(len(graph)))
    for _ in range(max_levels):
        of = list(range(len(graph)))
        strength = [sum(row.values()) for row in graph]
        total = strength[:]
        improved, moving = False, True
        while moving:
            moving = False
            for node, row in enumerate(graph):
                into: dict[int, float] = {of[node]: 0.0}
                for other, w in row.items():
                    if other != node:
                        into[of[other]] = into.get(of[other], 0.0) + w
                total[of[node]] -= strength[node]
                here = of[node]
                gain = {c: w - resolution * total[c] * strength[node] / two_m for c, w in into.items()}
                best = max(gain, key=lambda c: (gain[c], -c))
                if gain[best] > gain[here] + 1e-12:
                    of[node], moving, improved = best, True, True
                total[of[node]] += strength[node]
        if not improved:
            break
        names = {c: k for k, c in enumerate(dict.fromkeys(of))}
        merged: list[dict[int, float]] = [{} for _ in names]
        for node, row in enumerate(graph):
            mine = merged[names[of[node]]]
            for other, w in row.items():
                c = names[of[other]]
                mine[c] = mine.get(c, 0.0) + w
        member = [names[of[m]] for m in member]
        graph = merged
    return member


def bfs_sample(edges: DataFrame, partition: DataFrame, scores: DataFrame, n_communities: int = 6, per_community: int = 50) -> DataFrame:
    """(id, community, depth): from each big community up to `per_community` nodes nearest its best-scored one."""
    biggest = partition.groupBy("community").count().orderBy(F.desc("count"), "community").limit(n_communities).select("community")
    members = cut(partition.join(F.broadcast(biggest), "community"), "members")
    a, b = members.select(F.col("id").alias("src"), "community"), members.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    inner = cut(edges.join(a, "src").join(b, "dst").where("community = c2").select("src", "dst", "community"), "inner")
    ranked = members.join(scores, "id", "left").withColumn("_r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc_nulls_last("score"), "id")))
    frontier = cut(ranked.where("_r = 1").select("id", "community", F.lit(0).alias("depth")), "frontier")
    seen = frontier
    for depth in itertools.count(1):
        step = inner.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"), "community").distinct()
        frontier, found = counted(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier", n=F.count("*"))
        if not found["n"]:
            break
        seen = cut(seen.unionByName(frontier), "seen")
        if seen.groupBy("community").count().where(F.col("count") < per_community).isEmpty():
            break
    place = F.row_number().over(Window.partitionBy("community").orderBy("depth", "id"))
    return seen.withColumn("_r", place).where(F.col("_r") <= per_community).drop("_r")


def spring_layout(edges: DataFrame, nodes: DataFrame, iterations: int = 100, seed: int = 0, limit: int = 2000) -> DataFrame:
    """(id, x, y) of a force-directed layout of a small graph (at most `limit` nodes), in one task."""
    if nodes.count() > limit:
        raise ValueError(f"a layout of more than {limit} nodes: sample first")
    kind = nodes.schema["id"].dataType.simpleString()
    rows = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(nodes.select(F.col("id").alias("a"), F.col("id").alias("b")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        ids = sorted(set(pdf["a"]) | set(pdf["b"]))
        place = {v: k for k, v in enumerate(ids)}
        pairs = sorted({(place[a], place[b]) for a, b in zip(pdf["a"], pdf["b"], strict=True) if a != b})
        n = len(ids)
        at = np.random.default_rng(seed).random((n, 2))
        ideal, heat = (1 / n) ** 0.5, 0.1
        s = np.array([p[0] for p in pairs], int)
        d = np.array([p[1] for p in pairs], int)
        for step in range(iterations):
            gap = at[:, None] - at[None]
            far = np.maximum(np.hypot(gap[..., 0], gap[..., 1]), 1e-9)
            push = (gap / far[..., None] * (ideal**2 / far)[..., None]).sum(axis=1)
            if len(pairs):
                line = at[s] - at[d]
                long = np.maximum(np.hypot(line[:, 0], line[:, 1]), 1e-9)
                pull = line / long[:, None] * (long**2 / ideal)[:, None]
                np.add.at(push, s, -pull / 2)
                np.add.at(push, d, pull / 2)
            size = np.maximum(np.hypot(push[:, 0], push[:, 1]), 1e-9)
            at += push / size[:, None] * np.minimum(size, heat)[:, None]
            heat -= 0.1 / (iterations + 1)
        return pd.DataFrame({"id": ids, "x": at[:, 0], "y": at[:, 1]})

    return rows.groupBy(F.lit(1).alias("one")).applyInPandas(run, f"id {kind}, x double, y double")
