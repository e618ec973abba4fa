"""What a reviewer found on larger tables, as small tables of the same kind."""

import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import community, content, graph, linalg, recommend
from tessera.plans import catalogue, recommendations
from tests.helpers import same


@pytest.fixture
def busy(tmp_path):
    """Events of which several have one time, some without a value."""
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m) for m in (0, 0, 0, 30, 30, 59, 60, 60, 241, 241, 300)]
    values = [1.5, 2.25, None, 3.0, 4.0, None, 5.0, 6.0, None, None, None]
    table = pa.table({"event_id": pa.array(range(11), pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array([1] * 11, pa.int64()), "event_type": ["view", "error"] * 5 + ["late"], "value": values, "props": ["{}"] * 11})
    pq.write_table(table, tmp_path / "events.parquet")
    return str(tmp_path)


def test_windows_hold_all_events_of_their_time(spark, busy):
    same(spark, busy, catalogue.QUERIES["sliding_windows"], catalogue.ORACLES["sliding_windows"])


def test_snapshots_hold_all_events_of_their_time(spark, busy):
    from tessera.operators import windows
    from tessera.plans.profiles import rounded

    text = catalogue.ORACLES["window_snapshots"].replace("% 500 = 0", "% 1 = 0")
    same(spark, busy, lambda s, d: rounded(windows.snapshots(windows.stream(s.read.parquet(f"{d}/events.parquet")), (1, 4, 24), 1, peers=True), 8), text)


def test_live_windows_hold_all_events_of_their_time(spark, busy):
    same(spark, busy, catalogue.QUERIES["live_trailing"], catalogue.ORACLES["live_trailing"])


@pytest.mark.parametrize("shape", [(3, 9), (9, 3), (5, 5)])
def test_svd_of_either_side(spark, monkeypatch, shape):
    """No row object a cell comes to the driver, few rows need no matrix of all pairs of terms, and both sides give the same."""
    m = np.random.default_rng(4).normal(size=shape)
    names = [f"t{j}" for j in range(shape[1])]
    rows = spark.createDataFrame([(f"r{i}", names[j], float(m[i, j])) for i in range(shape[0]) for j in range(shape[1])], "row string, term string, w double")
    monkeypatch.setattr(linalg, "_matrix", None)
    if shape[0] < shape[1]:
        monkeypatch.setattr(linalg, "gram", None)
    values, vectors = linalg.svd(rows, names)
    _, s, right = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(values[: len(s)], s) and not values[len(s) :].any() and len(values) == shape[1]
    assert np.allclose(np.abs(vectors[:, : len(s)]), np.abs(right.T))
    assert [r.s for r in linalg.singular_values(spark, values).orderBy("place").collect()] == values.tolist()


def test_latent_factors_of_few_rows(spark, tmp_path, monkeypatch):
    """Three items of four words: three factors, and no matrix of all pairs of terms."""
    texts = ["alpha alpha alpha beta gamma", "beta gamma gamma gamma gamma", "delta delta delta beta alpha"]
    pq.write_table(pa.table({"doc_id": pa.array(range(3), pa.int64()), "text": texts, "lang": ["en"] * 3, "source": ["a", "b", "c"]}), tmp_path / "documents.parquet")
    monkeypatch.setattr(linalg, "gram", None)
    found = {r.factor: r.terms.split(", ") for r in catalogue.QUERIES["latent_factors"](spark, str(tmp_path)).collect()}
    assert len(found) == 3 and all(sorted(t) == ["alpha", "beta", "delta", "gamma"] for t in found.values())
    assert found[1][0] == "delta"


def test_louvain_in_one_task_and_in_rounds(spark, monkeypatch):
    """Small levels run in one task; the communities are those of the rounds over tables, wherever the limit lies."""
    rng = np.random.default_rng(6)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 90, (160, 2))} | {(7, 7)}
    rows = [(f"n{a}", f"n{b}", 1.0 + (a + b) % 3) for a, b in sorted(pairs | {(b, a) for a, b in pairs})]
    edges = spark.createDataFrame(rows, "src string, dst string, w double")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(92)], "id string")
    found = []
    for few in (0, 150, 10**6):
        monkeypatch.setattr(community, "FEW_EDGES", few)
        if few > 1000:
            monkeypatch.setattr(community, "_moves", None)
        found.append({r.id: r.community for r in community.louvain(edges, nodes).collect()})
    assert len(found[0]) == 92 and found[0] == found[1] == found[2]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, kind):
    """Nodes outside `nodes` join nothing, a path of many nodes is one component."""
    rng = np.random.default_rng(8)
    pairs = [(k, k + 1) for k in range(40)] + [(int(a), int(b)) for a, b in rng.integers(50, 120, (40, 2))] + [(200, 300), (300, 201), (7, 7)]
    edges = graph.symmetric(spark.createDataFrame(pairs, "a long, b long")).selectExpr(f"cast(src as {kind}) src", f"cast(dst as {kind}) dst")
    nodes = spark.range(250).selectExpr(f"cast(id as {kind}) id")
    found = []
    for few in (0, 10**6):
        monkeypatch.setattr(graph, "FEW_EDGES", few)
        if few:
            monkeypatch.setattr(graph, "dealt", None)
        found.append({r.id: r.component for r in graph.components(edges, nodes).collect()})
    assert found[0] == found[1] and len(found[0]) == 250
    assert found[0]["201" if kind == "string" else 201] == ("201" if kind == "string" else 201)


@pytest.mark.parametrize("tol", [0, 1e-6])
def test_pagerank_in_one_task_and_in_rounds(spark, monkeypatch, tol):
    """With nodes that lead nowhere, nodes without links, repeated links and a link to itself."""
    rng = np.random.default_rng(9)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 30, (70, 2))] + [(1, 2), (1, 2), (3, 3), (4, 31), (99, 1)]
    edges, nodes = spark.createDataFrame(rows, "src long, dst long"), spark.range(35)
    found = []
    for few in (0, 10**6):
        monkeypatch.setattr(graph, "FEW_EDGES", few)
        if few:
            monkeypatch.setattr(graph, "dealt", None)
        scores, done = graph.pagerank(edges, nodes, max_iter=6 if tol == 0 else 40, tol=tol)
        found.append((done, {r.id: r.score for r in scores.collect()}))
    assert found[0][0] == found[1][0] and found[0][1] == {k: pytest.approx(v, rel=1e-12) for k, v in found[1][1].items()}
    assert len(found[1][1]) == 35 and sum(found[1][1].values()) == pytest.approx(1)


@pytest.fixture
def rated(spark, monkeypatch):
    """Ratings, item vectors and other scores: equal items, items of a score of 0, pairs that share no term, users and items in one of the two scores only; tiles of a few users and items."""
    monkeypatch.setattr(content, "USERS", 3)
    monkeypatch.setattr(content, "ITEMS", 4)
    rng = np.random.default_rng(11)
    vectors = [(f"i{k:02}", f"w{j}", round(float(rng.normal()), 2)) for k in range(24) for j in range(6) if k % 4 == j % 4] + [("i24", "lone", 1.0)]
    vectors += [(f"i{k}", "w0", 0.5) for k in range(25, 40)]
    r = [(u, f"i{int(i):02}", float(rng.integers(1, 6))) for u in range(10) for i in rng.choice(24, 4, replace=False)] + [(10, "i24", 3.0)]
    cf = [(u, f"i{int(i):02}", float(rng.integers(1, 6))) for u in range(1, 12) for i in rng.choice(45, 9, replace=False)]
    t, r, cf = (spark.createDataFrame(x, s) for x, s in ((vectors, "item string, term string, w double"), (r, "u long, i string, r double"), (cf, "u long, i string, score double")))
    return t, r, cf, spark.range(12).toDF("u")


def top(scores):
    return {(x.u, x.place): (x.i, pytest.approx(x.score, abs=1e-9)) for x in recommend.top_per_user(scores.withColumn("score", F.round("score", 6)), 5).collect()}


def test_best_by_content_in_tiles(rated, monkeypatch):
    t, r, _, users = rated
    wanted = top(recommend.content_scores(t, r, users))
    monkeypatch.setattr(recommend, "content_scores", None)
    assert top(content.Tiles(t, r, users).best(5)) == wanted and len({u for u, _ in wanted}) == 11


def test_best_mixes_in_tiles(rated):
    t, r, cf, users = rated
    mixes = {"content": None} | {str(a): a for a in (0.0, 0.3, 1.0)}
    best = content.Tiles(t, r, users, cf).best_mixes(cf, r, mixes, 5).cache()
    plain = recommend.content_scores(t, r, users)
    for name, alpha in mixes.items():
        scores = plain if alpha is None else recommend.hybrid(cf, plain, alpha)
        assert top(best.where(F.col("method") == name)) == top(scores.join(r.select("u", "i"), ["u", "i"], "left_anti")), name


def test_rank_table_is_rank_eval(spark, rated):
    _, r, cf, _ = rated
    test = cf.where("score > 2").selectExpr("u user_id", "i business_id", "score + 1 stars")
    items = cf.select("i").distinct()
    both = cf.withColumn("method", F.lit("a")).unionByName(cf.withColumn("score", -F.col("score")).withColumn("method", F.lit("b")))
    found = {x.method: tuple(x)[1:] for x in recommend.rank_table(both, ["a", "b", "none"], r, test, items).collect()}
    for name in found:
        assert found[name] == pytest.approx(tuple(recommend.rank_eval(both.where(F.col("method") == name), r, test, items).first()))
    assert set(found) == {"a", "b", "none"}


def test_pairs_of_content_are_never_a_table(spark, sf, monkeypatch):
    """The three queries rank without a row a user and item."""
    monkeypatch.setattr(recommend, "content_scores", None)
    monkeypatch.setattr(recommend, "mixed", None)
    for name in ("content_scores", "method_table", "alpha_sweep"):
        assert not catalogue.QUERIES[name](spark, sf).isEmpty()


def test_only_the_best_of_a_user_leave(rated):
    """Tiles are not shuffled, equal items are scored once, and k rows a user come of all tiles together."""
    t, r, _, users = rated
    tiles = content.Tiles(t, r, users)
    assert tiles.items.agg(F.sum("classes")).first()[0] == t.select("item").distinct().count() - 14  # fifteen items are equal
    plan = tiles.pairs()._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan[: plan.index("CartesianProduct")]
    found = tiles.best(5).groupBy("u").count().collect()
    assert tiles.nu * tiles.ni > 4 and len(found) == 11 and max(x["count"] for x in found) == 5


def test_item_vectors_need_no_review_ids(spark, sf):
    """Texts meet the parts' words by item, and reviews are dealt once, by user."""
    plan = recommendations.latest(spark, sf, "user_id")
    windows = recommend.temporal_split(plan)._jdf.queryExecution().executedPlan().toString()
    assert windows.count("Exchange hashpartitioning(o_custkey") == 1 and "Exchange hashpartitioning(user_id" not in windows
    train, _ = recommendations.split(spark, sf)
    twice = train.unionByName(train.withColumn("review_id", F.lit("same")))
    assert recommendations.item_vectors(spark, sf, twice).select("item").distinct().count() == train.select("business_id").distinct().count()


def test_candidates_do_not_grow_with_the_mixes(spark, rated, monkeypatch):
    """Mixes share the candidates of a tile, and places of wanted items are all that leaves."""
    t, r, cf, users = rated
    monkeypatch.setattr(content, "MERGED", 1)
    wanted = spark.createDataFrame([(u, f"i{k:02}") for u in range(12) for k in range(0, 40, 3)], "u long, i string")
    mixes = {str(a / 10): a / 10 for a in range(11)} | {"content": None}
    tiles = content.Tiles(t, r, users, cf)
    scores = tiles.best_mixes(cf, None, mixes, 5)
    hits = tiles.best_mixes(cf, None, mixes, 5, wanted)
    found = recommend.hit_table(hits, list(mixes), wanted, 5).orderBy("method").collect()
    place = F.row_number().over(Window.partitionBy("method", "u").orderBy(F.desc("score"), "i"))
    plain = scores.withColumn("place", place).join(wanted, ["u", "i"], "left_semi").select("method", "u", "place")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, plain.collect())) and hits.count() > 50 and len(found) == 12
    assert scores.groupBy("method", "u").count().agg(F.max("count")).first()[0] == 5


def test_similarities_in_rounds(spark):
    """Pairs in rounds are the pairs at once."""
    rng = np.random.default_rng(3)
    c = recommend.centred(spark.createDataFrame([(u, int(i), float(rng.integers(1, 6))) for u in range(30) for i in rng.choice(12, 6, replace=False)], "u long, i long, r double"))
    once, rounds = ({(x.i, x.j): pytest.approx(x.sim) for x in recommend.item_similarity(c, rounds=n).collect()} for n in (1, 3))
    assert once == rounds and len(once) > 50
