"""Queries without SQL against plain versions over the whole tables."""

import itertools
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.operators import cluster, community, features, sampling
from tessera.plans import catalogue, clusters, graphs, recommendations
from tessera.plans.profiles import business, latest
from tessera.sources import roles

Q = catalogue.QUERIES


def hash_of(*values: int) -> int:
    """Spark's xxhash64 of longs (and ints, as four bytes, where given as a tuple)."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def points(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([[float(x) for x in r.embedding] for r in rows])


def plain_kmeans(ids, x, k, seed, max_iter=100, tol=1e-4):
    hashes = np.array([hash_of(i) for i in ids], np.int64)
    chosen: list = []
    for n in range(k):
        weight = np.ones(len(x)) if n == 0 else ((x[:, None] - np.array(chosen)[None]) ** 2).sum(2).min(1)
        race = np.where(weight > 0, -np.log(cluster._uniform(hashes, seed * 1000 + n)) / np.where(weight > 0, weight, 1), np.inf)
        chosen.append(x[np.lexsort((ids, race))[0]])
    c = np.array(chosen)
    for _ in range(max_iter):
        of = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        after = np.array([x[of == j].mean(0) if (of == j).any() else c[j] for j in range(k)])
        moved, c = np.sqrt(((after - c) ** 2).sum()), after
        if moved < tol:
            break
    d2 = ((x[:, None] - c[None]) ** 2).sum(2)
    return d2.min(1).sum(), d2.argmin(1)


def plain_silhouette(x, of):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = (of == of[i]) & (np.arange(len(x)) != i)
        others = [d[i, of == c].mean() for c in set(of.tolist()) - {of[i]}]
        if not own.any() or not others:
            out.append(0.0)
            continue
        a, b = d[i, own].mean(), min(others)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.fixture(scope="module")
def best_runs(spark, sf):
    ids, x = points(spark, sf)
    return x, {k: min((plain_kmeans(ids, x, k, s) for s in range(5)), key=lambda r: r[0]) for k in range(2, 11)}


def test_choose_k(spark, sf, best_runs):
    x, best = best_runs
    found = {r.k: (r.inertia, r.silhouette) for r in Q["choose_k"](spark, sf).collect()}
    assert set(found) == set(range(2, 11))
    for k, (inertia, of) in best.items():
        assert found[k] == (pytest.approx(inertia), pytest.approx(plain_silhouette(x, of), abs=1e-6))


def test_kmeans_best(spark, sf, best_runs):
    _, best = best_runs
    inertia, of = best[5]
    rows = Q["kmeans_best"](spark, sf).collect()
    assert all(r.inertia == pytest.approx(inertia) for r in rows) and sorted(r.n for r in rows) == sorted(Counter(of.tolist()).values())
    assert sum(r.share for r in rows) == pytest.approx(1)


def test_best_k(spark):
    sweep = spark.createDataFrame([(2, 5.0, 0.3), (3, 4.0, 0.5), (4, 3.0, 0.5)], "k int, inertia double, silhouette double")
    assert cluster.best_k(sweep).first().k == 3


def test_tiles_of_many_blocks(spark, monkeypatch):
    """The same distances, clusters and silhouettes however many blocks the points are dealt into."""
    monkeypatch.setattr(cluster, "TILE", 7)
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.normal(m, 0.4, (20, 3)) for m in (0, 2, 5)] + [np.zeros((6, 3))]), 3)
    rows = spark.createDataFrame([(f"p{k:02}", v.tolist(), k % 4) for k, v in enumerate(x)], "id string, features array<double>, cluster int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    eps, need = 0.5, 4
    got = {(r.a, r.b): r.d for r in cluster.pairs_within(rows, eps).collect()}
    assert got == {(f"p{i:02}", f"p{j:02}"): pytest.approx(d[i, j]) for i, j in np.argwhere(d <= eps).tolist()}
    assert cluster.all_distances(rows).count() == len(x) ** 2
    near = d <= eps
    core = near.sum(1) >= need
    label = np.arange(len(x))
    for _ in range(len(x)):
        for i in np.flatnonzero(core):
            label[i] = label[core & near[i]].min()
    number = {c: n for n, c in enumerate(sorted({label[i] for i in np.flatnonzero(core)}))}
    wanted = [number[label[i]] if core[i] else min((number[label[j]] for j in np.flatnonzero(core & near[i])), default=-1) for i in range(len(x))]
    for few in (200_000, 0):  # joined up in one task, and in rounds
        monkeypatch.setattr(cluster, "FEW_LINKS", few)
        assert [r.cluster for r in cluster.dbscan(rows, eps, need).orderBy("id").collect()] == wanted
    assert cluster.silhouette_score(rows).first()[0] == pytest.approx(plain_silhouette(x, np.arange(len(x)) % 4))
    assert {r.id: r.d for r in cluster.k_distance(rows, 3).collect()} == {f"p{i:02}": pytest.approx(np.sort(d[i][np.arange(len(x)) != i])[2]) for i in range(len(x))}
    stats = {r.a: (r.mean_d, r.max_d) for r in cluster.distance_stats(rows).collect()}
    assert stats == {f"p{i:02}": (pytest.approx(d[i].mean()), pytest.approx(d[i].max())) for i in range(len(x))}


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0, 2.0, 7.0, None], list(map(float, range(101)))])
def test_quantiles(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    held = [v for v in values if v is not None]
    wanted = {q: float(np.quantile(held, q)) if held else None for q in (0.0, 0.5, 0.9, 1.0)}
    assert {r.q: r.value for r in cluster.quantiles(rows, "x").collect()} == {q: v if v is None else pytest.approx(v) for q, v in wanted.items()}


def matrix_of(spark, sf, cat_weight=1.0):
    matrix, names, wide = features.business_features(business(spark, sf), latest(spark, sf), clusters.checkins(spark, sf), cat_weight=cat_weight)
    rows = matrix.orderBy("business_id").collect()
    return [r.business_id for r in rows], np.array([r.features for r in rows]), names, wide


def test_cluster_profile(spark, sf):
    ids, x, _, wide = matrix_of(spark, sf, 0.0)
    c = x[[k for k, i in enumerate(ids) if i < 5]]
    for _ in range(10):
        of = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        after = np.array([x[of == j].mean(0) if (of == j).any() else c[j] for j in range(len(c))])
        moved, c = np.sqrt(((after - c) ** 2).sum()), after
        if moved < 1e-4:
            break
    label = dict(zip(ids, ((x[:, None] - c[None]) ** 2).sum(2).argmin(1).tolist(), strict=True))
    held = defaultdict(list)
    for r in wide.collect():
        held[label[r.business_id]].append(r)
    found = {r.cluster: r for r in Q["cluster_profile"](spark, sf).collect()}
    assert set(found) == set(held)
    for k, rows in held.items():
        r = found[k]
        top = sorted(Counter(c for b in rows for c in b.categories_list).items(), key=lambda i: (-i[1], i[0]))[:4]
        assert (r.n, r.median_reviews, r.top_categories) == (len(rows), int(np.median([b.review_count for b in rows])), ", ".join(c for c, _ in top))
        assert (r.stars, r.price, r.share_open) == tuple(pytest.approx(np.mean([float(v) for v in vs]), abs=0.00501) for vs in ([b.stars for b in rows], [b.price_range_imp for b in rows], [b.is_open for b in rows]))


def components_of(z):
    values, vectors = np.linalg.eigh(z.T @ z / (len(z) - 1))
    order = np.argsort(values)[::-1]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return np.maximum(values[order], 0), vectors


def test_pca(spark, sf):
    ids, x = points(spark, sf)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = components_of(z)
    share = values / values.sum()
    rows = Q["pca_explained"](spark, sf).orderBy("component").collect()
    assert np.allclose([r.share for r in rows], share) and np.allclose([r.cumulative for r in rows], np.cumsum(share))
    assert {r.needed for r in rows} == {int(np.argmax(np.cumsum(share) >= 0.9 - 1e-12)) + 1}
    found = np.array([[r.pc1, r.pc2, r.pc3] for r in Q["pca_projection"](spark, sf).orderBy("id").collect()])
    assert np.allclose(found, z @ vectors[:, :3], atol=2e-6)


def test_pca_loadings(spark, sf):
    _, x, names, _ = matrix_of(spark, sf)
    _, vectors = components_of(x)
    for r in Q["pca_loadings"](spark, sf).collect():
        v = vectors[:, r.component - 1]
        for text in r.loadings.split(", "):
            name, value = text[:-1].rsplit(" (", 1)
            assert abs(abs(v[names.index(name)]) - abs(float(value))) < 0.006
        told = [abs(float(t[:-1].rsplit(" (", 1)[1])) for t in r.loadings.split(", ")]
        assert len(told) == 6 and told == sorted(told, reverse=True) and min(told) >= np.sort(np.abs(v))[-6] - 0.006


def test_clusters_plane(spark, sf):
    ids, x = points(spark, sf)
    centred = x - x.mean(0)
    _, vectors = components_of(centred)
    found = {r.id: (r.x, r.y) for r in Q["clusters_plane"](spark, sf).collect()}
    assert np.allclose([found[i] for i in ids], centred @ vectors[:, :2], atol=1e-6)


def text_matrix(spark, sf):
    weights, names, n = clusters._text_matrix(spark, sf)
    place, rows = {t: k for k, t in enumerate(names)}, {}
    out = np.zeros((n, len(names)))
    for r in weights.collect():
        out[rows.setdefault(r.row, len(rows)), place[r.term]] = r.w
    return out, names


def test_svd(spark, sf):
    m, names = text_matrix(spark, sf)
    _, s, right = np.linalg.svd(m, full_matrices=False)
    total = (s**2).sum()
    decay = Q["singular_decay"](spark, sf).orderBy("place").collect()
    assert [r.place for r in decay] == list(range(1, min(200, len(names)) + 1))
    head = min(len(s), len(decay))
    assert np.allclose([r.s for r in decay[:head]], s[:head], atol=2e-6) and np.allclose([r.cumulative for r in decay[:head]], (np.cumsum(s**2) / total)[:head], atol=2e-6)
    for r in Q["svd_curve"](spark, sf).collect():
        captured = (s[: r.k] ** 2).sum() / total
        assert r.captured == pytest.approx(captured, abs=2e-6) and r.error == pytest.approx(np.sqrt(max(0, 1 - captured)), abs=2e-3) and r.stored == r.k * (m.shape[0] + m.shape[1] + 1)
    for r in Q["latent_factors"](spark, sf).collect():
        if r.factor <= len(s) and (r.factor == len(s) or s[r.factor - 1] - s[r.factor] > 1e-9) and s[r.factor - 1] > 1e-9:
            weight = np.abs(right[r.factor - 1])
            told = [weight[names.index(t)] for t in r.terms.split(", ")]
            assert np.allclose(told, np.sort(weight)[::-1][:8], atol=1e-7)


def friend_graph(spark, sf):
    edges, nodes = graphs.component_graph(spark, sf)
    around = defaultdict(set)
    for r in edges.collect():
        around[r.src].add(r.dst)
    return around, sorted(r.id for r in nodes.collect())


def test_pagerank_converged(spark, sf):
    around, nodes = friend_graph(spark, sf)
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(100):
        after = dict.fromkeys(nodes, 0.15 / len(nodes))
        for u in nodes:
            for v in around[u]:
                after[v] += 0.85 * score[u] / len(around[u])
        lost = 0.85 * sum(score[u] for u in nodes if not around[u]) / len(nodes)
        after = {u: s + lost for u, s in after.items()}
        moved, score = sum(abs(after[u] - score[u]) for u in nodes), after
        if moved < 1e-6:
            break
    assert {r.id: r.score for r in Q["pagerank_converged"](spark, sf).collect()} == {u: pytest.approx(s) for u, s in score.items()}


def test_hits_converged(spark, sf):
    pairs = [(r.user_id, r.business_id) for r in latest(spark, sf).select("user_id", "business_id").collect()]
    hubs, auths = dict.fromkeys((u for u, _ in pairs), 1.0), dict.fromkeys((b for _, b in pairs), 1.0)

    def unit(raw):
        size = sum(v * v for v in raw.values()) ** 0.5
        return {k: v / size for k, v in raw.items()}

    for _ in range(100):
        a = defaultdict(float)
        for u, b in pairs:
            a[b] += hubs[u]
        a = unit(a)
        h = defaultdict(float)
        for u, b in pairs:
            h[u] += a[b]
        h = unit(h)
        moved = sum(abs(a[k] - auths[k]) for k in a) + sum(abs(h[k] - hubs[k]) for k in h)
        hubs, auths = h, a
        if moved < 1e-8:
            break
    found = {(r.side, r.id): r.score for r in Q["hits_converged"](spark, sf).collect()}
    assert found == {("hub", k): pytest.approx(v, abs=1e-7) for k, v in hubs.items()} | {("authority", k): pytest.approx(v, abs=1e-7) for k, v in auths.items()}


def plain_modularity(around, of):
    m = sum(map(len, around.values()))
    inside, total = Counter(), Counter()
    for u, vs in around.items():
        total[of[u]] += len(vs)
        inside[of[u]] += sum(of[v] == of[u] for v in vs)
    return sum(inside[c] / m - (total[c] / m) ** 2 for c in total)


@pytest.fixture(scope="module")
def found_communities(spark, sf):
    return {r.id: r.community for r in Q["louvain"](spark, sf).collect()}


def test_louvain(spark, sf, found_communities):
    around, nodes = friend_graph(spark, sf)
    of = found_communities
    assert set(of) == set(nodes)
    place = {u: k for k, u in enumerate(nodes)}
    plain = community.sweep_levels([{place[v]: 1.0 for v in sorted(around[u])} for u in nodes])
    quality, other = plain_modularity(around, of), plain_modularity(around, dict(zip(nodes, plain, strict=True)))
    assert quality >= other - 0.03
    sizes = Counter(of.values())
    assert [sizes[c] for c in range(len(sizes))] == sorted(sizes.values(), reverse=True)
    for c in sizes:  # no node would gain by going to a neighbour's community by more than the last level's merging hides
        members = {u for u in nodes if of[u] == c}
        seen, open_ = set(), [min(members)]
        while open_:
            u = open_.pop()
            if u not in seen:
                seen.add(u)
                open_ += around[u] & members
        assert len(seen) >= 0.5 * len(members)
    row = Q["louvain_parallel"](spark, sf).first()
    assert row.modularity == pytest.approx(quality) and row.communities == len(sizes)


def test_bfs_sample(spark, sf, found_communities):
    around, nodes = friend_graph(spark, sf)
    of = found_communities
    biggest = sorted(Counter(of.values()).items(), key=lambda i: (-i[1], i[0]))[:6]
    wanted = {}
    for c, _ in biggest:
        members = {u for u in nodes if of[u] == c}
        start = min(members, key=lambda u: (-len(around[u]), u))
        depth, frontier = {start: 0}, [start]
        while frontier:
            reached = {v for u in frontier for v in around[u] & members} - depth.keys()
            depth |= dict.fromkeys(reached, depth[frontier[0]] + 1)
            frontier = sorted(reached)
        for u, d in sorted(depth.items(), key=lambda i: (i[1], i[0]))[:50]:
            wanted[u] = (c, d)
    assert {r.id: (r.community, r.depth) for r in Q["bfs_sample"](spark, sf).collect()} == wanted


def test_force_layout_and_drawing(spark, sf, found_communities):
    around, _ = friend_graph(spark, sf)
    ids = sorted(r.id for r in Q["bfs_sample"](spark, sf).collect())
    n, place = len(ids), {u: k for k, u in enumerate(ids)}
    at = np.random.default_rng(0).random((n, 2))
    ideal, heat = (1 / n) ** 0.5, 0.1
    links = [(place[u], place[v]) for u in ids for v in around[u] if v in place]
    for _ in range(60):
        move = np.zeros((n, 2))
        for i in range(n):
            gap = at[i] - at
            far = np.maximum(np.hypot(*gap.T), 1e-9)
            move[i] = (gap / far[:, None] * (ideal**2 / far)[:, None]).sum(0)
        for i, j in links:
            gap = at[i] - at[j]
            far = max(np.hypot(*gap), 1e-9)
            move[i] -= gap / far * far**2 / ideal / 2
            move[j] += gap / far * far**2 / ideal / 2
        size = np.maximum(np.hypot(*move.T), 1e-9)
        at = at + move / size[:, None] * np.minimum(size, heat)[:, None]
        heat -= 0.1 / 61
    layout = {r.id: (r.x, r.y) for r in Q["force_layout"](spark, sf).collect()}
    assert set(layout) == set(ids)
    assert np.allclose([layout[u] for u in ids], at, atol=1e-3)
    top = max(len(around[u]) for u in ids)
    drawn = {r.id: r for r in Q["community_drawing"](spark, sf).collect()}
    assert set(drawn) == set(ids)
    for u in ids:
        assert drawn[u].community == found_communities[u] and drawn[u].size == pytest.approx(15 + 220 * len(around[u]) / top)


def test_representativity(spark, sf):
    rows = roles.users(spark, sf)
    every = rows.collect()
    ids = {r.user_id for r in sampling.stratified_sample(rows, "user_id", 300).collect()}
    name = lambda r: f"{(r.city or '').strip().lower()}|{r.state or ''}"
    counts = Counter(map(name, every))
    mine = Counter(name(r) for r in every if r.user_id in ids)
    wanted = {c: (n / len(every), mine[c] / len(ids)) for c, n in sorted(counts.items(), key=lambda i: (-i[1], i[0]))[:8]}
    for m in ("review_count", "average_stars"):
        wanted[m] = tuple(float(np.mean([float(r[m]) for r in part])) for part in (every, [r for r in every if r.user_id in ids]))
    found = {r["item"]: (r.population, r.sample) for r in Q["stratified_representativity"](spark, sf).collect()}
    assert found == {k: (pytest.approx(a), pytest.approx(b)) for k, (a, b) in wanted.items()}


def random_ranks(spark, sf):
    train, test = recommendations.split(spark, sf)
    seen, held = defaultdict(set), defaultdict(dict)
    for r in train.where("stars > 0").collect():
        seen[r.user_id].add(r.business_id)
    for r in test.collect():
        held[r.user_id][r.business_id] = r.stars
    items = sorted(set().union(*seen.values()))
    prime = next(p for p in itertools.count(max(2, len(items))) if all(p % d for d in range(2, int(p**0.5) + 1)))
    out = {}
    for u in held:
        a, b = hash_of(u, (0,)) % (prime - 1) + 1, hash_of(u, (1,)) % prime
        order = [items[k] for k in ((a * j + b) % prime for j in range(1, prime + 1)) if k < len(items)]
        out[u] = [i for i in order if i not in seen[u]][:10]
    return out, held, set(items)


def test_random_baseline(spark, sf):
    wanted, held, items = random_ranks(spark, sf)
    found = defaultdict(dict)
    for r in Q["random_baseline"](spark, sf).collect():
        found[r.u][r.place] = r.i
    assert {u: [places[k] for k in sorted(places)] for u, places in found.items()} == wanted
    precision, recall, ndcg = [], [], []
    for u, stars in held.items():
        good = {i for i, s in stars.items() if s >= 4 and i in items}
        if good:
            hits = [k for k, i in enumerate(wanted[u], 1) if i in good]
            precision.append(len(hits) / 10)
            recall.append(len(hits) / len(good))
            ndcg.append(sum(1 / np.log2(k + 1) for k in hits) / sum(1 / np.log2(k + 1) for k in range(1, min(10, len(good)) + 1)))
    row = Q["random_eval"](spark, sf).first()
    assert (row.precision, row.recall, row.ndcg, row.users) == (*(pytest.approx(np.mean(v), abs=1e-6) for v in (precision, recall, ndcg)), len(precision))


def test_every_query_has_sql_or_a_plain_version():
    plain = {"choose_k", "kmeans_best", "cluster_profile", "pca_explained", "pca_projection", "pca_loadings", "clusters_plane", "singular_decay", "svd_curve", "latent_factors", "pagerank_converged", "hits_converged", "louvain", "louvain_parallel"}
    plain |= {"bfs_sample", "force_layout", "community_drawing", "stratified_representativity", "random_baseline", "random_eval"}
    assert set(Q) - set(catalogue.ORACLES) == plain
