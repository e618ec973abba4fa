"""Small cases with known results."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import audit, cleaning, cluster, community, graph, linalg, recommend, sampling, sketch, windows
from tessera.sources import artifacts, ndjson


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize("given, wanted", [(" Bars, ,Food ", ["Bars", "Food"]), (None, [])])
def test_categories(spark, given, wanted):
    assert one(spark, cleaning.parse_categories(text(given))) == wanted


@pytest.mark.parametrize("given, wanted", [('{"Mon":"9-5","Tue":"9-5"}', 2), ("bad", 0), (None, 0), ("null", 0)])
def test_days_open(spark, given, wanted):
    assert one(spark, cleaning.days_open(text(given))) == wanted


@pytest.mark.parametrize("given, wanted", [("2010,2011, ", 2), ("None", 0), (None, 0), ("", 0)])
def test_elite_years(spark, given, wanted):
    assert one(spark, cleaning.parts(text(given))) == wanted


@pytest.mark.parametrize("given, wanted", [("a,b", 2), ("a,b,", 3), ("", 0), (None, 0)])
def test_csv_count(spark, given, wanted):
    assert one(spark, cleaning.csv_count(text(given))) == wanted


def test_attributes(spark):
    given = json.dumps({"a": "2", "b": "None", "c": "True", "d": "u'free'", "e": "{'garage': True, 'lot': False}"})
    m = cleaning.parse_attributes(text(given))
    assert one(spark, cleaning.as_int(F.element_at(m, "a"))) == 2
    assert one(spark, F.element_at(m, "b")) is None
    assert one(spark, cleaning.as_bool(F.element_at(m, "c"))) is True
    assert one(spark, F.element_at(m, "d")) == "u'free'"
    assert one(spark, cleaning.nested(F.element_at(m, "e"))) == {"garage": "True", "lot": "False"}
    assert one(spark, cleaning.as_int(text("--5"))) is None
    assert one(spark, cleaning.parse_attributes(text("bad"))) == {}


def test_undated_review_stays(spark):
    rows = spark.sql("SELECT * FROM VALUES ('r1','u','b',1D,timestamp'2020-01-01'),('r2','u','b',2D,timestamp'2021-01-01'),('r3','u','b',3D,null) AS t(review_id,user_id,business_id,stars,date)")
    assert [r.review_id for r in cleaning.latest_pair(rows).collect()] == ["r3"]


def test_tokens(spark):
    assert one(spark, tokens(text("El niño comió 3 tacos-al ab pastor The pastor"))) == ["niño", "comió", "tacos", "pastor", "pastor"]


def test_split_sizes(spark):
    sizes = {4: 0, 5: 1, 7: 1, 8: 2, 12: 2, 13: 3}
    rows = spark.createDataFrame([(f"r{n}-{k}", n, k, 3.0, k) for n in sizes for k in range(n)], "review_id string, user_id long, business_id long, stars double, date long")
    found = {r.user_id: r.n for r in recommend.temporal_split(rows).groupBy("user_id").agg(F.sum(F.col("test").cast("int")).alias("n")).collect()}
    assert found == sizes


def test_ndcg(spark):
    scores = spark.createDataFrame([(1, i, 10.0 - i) for i in range(1, 11)], "u long, i long, score double")
    test = spark.createDataFrame([(1, 1, 5.0), (1, 3, 4.0)], "user_id long, business_id long, stars double")
    train = spark.createDataFrame([(1, 99)], "u long, i long")
    row = recommend.rank_eval(scores, train, test, scores.select("i")).first()
    assert row.ndcg == pytest.approx(0.9197207891) and row.precision == pytest.approx(0.2) and row.recall == 1.0


@pytest.mark.parametrize("values, wanted", [([1, 1, 1, 1], 0), ([0, 0, 0, 4], 0.75), ([1, 2, 3, 4], 0.25), ([], 0)])
def test_gini(spark, values, wanted):
    assert audit.gini(spark.createDataFrame([(v,) for v in values], "n long"), "n").first()[0] == pytest.approx(wanted)


def events(spark, seconds):
    return spark.createDataFrame([(k, s, 1.0) for k, s in enumerate(seconds)], "event_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s"))


@pytest.mark.parametrize("seconds, hours, wanted", [([0, 9 * 3600, 10 * 3600, 19 * 3600], 10, [1, 2, 2, 2]), ([5, 5, 5], 1, [1, 2, 3]), ([], 1, [])])
def test_trailing(spark, seconds, hours, wanted):
    found = windows.trailing(events(spark, seconds), hours).orderBy("event_id").collect()
    assert [r.n for r in found] == wanted


def test_trailing_against_replay(spark):
    rng = np.random.default_rng(3)
    seconds = sorted(rng.integers(0, 60_000, 300).tolist())
    found = [r.n for r in windows.trailing(events(spark, seconds), 2).orderBy("event_id").collect()]
    assert found == [sum(s - 7200 < x <= s for x in seconds[: k + 1]) for k, s in enumerate(seconds)]


def test_count_min_shape_and_hash(spark):
    assert [math.prod(sketch.width_and_depth(e, 0.01)) for e in (0.01, 0.005, 0.001, 0.0005)] == [1360, 2720, 13595, 27185]
    keys = spark.createDataFrame([(42,), (0,), (1,)], "k long")
    found = {r.k: [c.col for c in r._cells] for r in sketch.cells(keys, "k", 0.001, 0.01).collect()}
    assert found == {42: [2022, 2485, 2710, 2425, 29], 0: [1455, 2518, 227, 533, 701], 1: [314, 2501, 2142, 1123, 944]}


def test_count_min_merges_and_never_underestimates(spark):
    rows = spark.range(3000).select((F.col("id") * F.col("id") % 97).alias("k"))
    a, b = rows.where("k < 40"), rows.where("k >= 40")
    merged = sketch.merge_count_min(sketch.count_min(a, "k", 0.05), sketch.count_min(b, "k", 0.05))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, sketch.count_min(rows, "k", 0.05).collect()))
    assert sketch.against_exact(rows, "k", 0.05).where("error < 0").isEmpty()


def test_loglog(spark):
    found = sketch.loglog_registers(spark.createDataFrame([(0,), (1,), (42,)], "k long"), "k")
    assert sorted((r.bucket, r.rho) for r in found.collect()) == [(7, 1), (46, 1), (114, 1)]
    estimate = sketch.loglog_estimate(sketch.loglog_registers(spark.range(20_000).select(F.col("id").cast("string").alias("k")), "k")).first().estimate
    assert abs(estimate - 20_000) / 20_000 < 4 * 1.3 / 16


def edges(spark, pairs):
    return graph.symmetric(spark.createDataFrame(pairs, "a long, b long"))


def nodes(spark, n):
    return spark.range(n)


def test_pagerank_star(spark):
    scores, _ = graph.pagerank(edges(spark, [(0, 1), (0, 2), (0, 3)]), nodes(spark, 4), tol=1e-10)
    found = {r.id: r.score for r in scores.collect()}
    assert found[0] == pytest.approx(0.4797297297) and found[1] == pytest.approx(0.1734234234)


def test_pagerank_spreads_what_dangles(spark):
    scores, _ = graph.pagerank(edges(spark, [(0, 1)]), nodes(spark, 3), tol=1e-10)
    assert sum(r.score for r in scores.collect()) == pytest.approx(1)


def test_hits(spark):
    pairs = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u2", "a")], "user_id string, business_id string")
    hubs, auths, _ = graph.hits(pairs)
    assert {r.id: round(r.score, 6) for r in auths.collect()} == {"a": 0.850651, "b": 0.525731}
    assert {r.id: round(r.score, 6) for r in hubs.collect()} == {"u1": 0.850651, "u2": 0.525731}


TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]


def test_modularity(spark):
    partition = spark.range(6).withColumn("community", F.floor(F.col("id") / 3))
    assert graph.modularity(edges(spark, TRIANGLES), partition).first()[0] == pytest.approx(0.3571428571)


@pytest.mark.parametrize("mode", ["exact", "parallel"])
def test_louvain(spark, mode):
    found = community.louvain(edges(spark, TRIANGLES), nodes(spark, 7), mode=mode)
    if mode == "exact":
        groups = {}
        for r in found.collect():
            groups.setdefault(r.community, set()).add(r.id)
        assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3, 4, 5], [6]]
    else:
        assert -0.5 <= graph.modularity(edges(spark, TRIANGLES), found).first()[0] <= 1


def test_diameter_and_components(spark):
    path = edges(spark, [(0, 1), (1, 2), (2, 3), (3, 4)])
    assert graph.approx_diameter(path, nodes(spark, 5)) == 4
    found = {r.id: r.component for r in graph.components(edges(spark, [(0, 1), (1, 2), (5, 4)]), nodes(spark, 7)).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}


def points(spark, xs):
    return spark.createDataFrame([(k, [float(x)]) for k, x in enumerate(xs)], "id long, features array<double>")


def test_silhouette(spark):
    rows = points(spark, [0, 1, 10, 11]).withColumn("cluster", F.when(F.col("id") < 2, 0).otherwise(1))
    assert cluster.silhouette_score(rows).first()[0] == pytest.approx(0.8997493734)


@pytest.mark.parametrize("xs, wanted", [([0, 1, 2, 10, 11, 12, 50], [0, 0, 0, 1, 1, 1, -1]), ([0, 1, 2, 3, 4], [0] * 5)])
def test_dbscan(spark, xs, wanted):
    assert [r.cluster for r in cluster.dbscan(points(spark, xs), 1, 3).orderBy("id").collect()] == wanted


def test_k_distance(spark):
    assert sorted(r.d for r in cluster.k_distance(points(spark, [0, 1, 3]), 1).collect()) == [1, 1, 2]


def test_kmeans_is_deterministic_and_splits(spark):
    labelled, _, inertia = cluster.kmeans(points(spark, [0, 1, 10, 11]), 2, n_init=2)
    found = [r.cluster for r in labelled.orderBy("id").collect()]
    assert found[0] == found[1] != found[2] == found[3] and inertia == pytest.approx(1.0)


def test_components_for_target():
    assert linalg.components_for([0.5, 0.3, 0.2], 0.8) == 2 and linalg.components_for([0.5, 0.3, 0.2], 0.9) == 3
    assert linalg.components_for([0.5, 0.3], 0.99) == 2


def test_pca_equals_svd(spark):
    x = np.random.default_rng(1).normal(size=(50, 4))
    z = (x - x.mean(0)) / x.std(0)
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(z)], "id long, features array<double>")
    _, _, shares = linalg.pca(rows, 4)
    s = np.linalg.svd(z - z.mean(0), compute_uv=False) ** 2
    assert np.allclose(shares, s / s.sum(), atol=1e-8)


def test_svd_and_reconstruction(spark):
    m = np.random.default_rng(2).normal(size=(6, 4))
    rows = spark.createDataFrame([(i, str(j), float(m[i, j])) for i in range(6) for j in range(4)], "row long, term string, w double")
    values, _ = linalg.svd(rows, list("0123"))
    assert np.allclose(values, np.linalg.svd(m, compute_uv=False))
    frame = spark.createDataFrame([(k, float(s)) for k, s in enumerate(values, 1)], "place long, s double")
    errors = [r.error for r in linalg.reconstruction(frame, 2943, 2000, [1, 2, 3, 4, 100]).orderBy("k").collect()]
    assert errors == sorted(errors, reverse=True)
    last = linalg.reconstruction(frame, 2943, 2000, [100]).first()
    assert (last.stored, last.compression) == (494400, "12x")


def test_sample_sizes(spark):
    rows = spark.range(1000).select("id", F.concat(F.lit(" C"), (F.col("id") % 7).cast("string")).alias("city"), F.lit("S").alias("state"))
    found = sampling.stratified_sample(rows, "id", 100)
    assert {r.city: r.n for r in found.groupBy("city").agg(F.count("*").alias("n")).collect()} == {f" C{k}": 14 for k in range(7)}
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in sampling.stratified_sample(rows.repartition(3), "id", 100).collect())


def test_prediction_and_similarity_are_symmetric(spark):
    r = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(8) for i in range(5)], "u long, i long, r double")
    sim = recommend.item_similarity(recommend.centred(r), 3)
    found = {(x.j, x.i): x.sim for x in sim.collect()}
    assert all(found[j, i] == pytest.approx(found[i, j]) for j, i in found)
    pruned = recommend.topk_prune(sim, 2)
    assert pruned.groupBy("i").count().agg(F.max("count")).first()[0] <= 2
    assert recommend.predict(recommend.centred(r), pruned).where("score < 1 or score > 5").isEmpty()


def test_build_is_one_generation(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    business = [{"business_id": f"b{k}", "name": "n", "city": " X ", "state": "S", "stars": 3.0, "review_count": 5, "is_open": 1, "attributes": {"a": "1"}, "categories": "A, B", "hours": None, "extra": 1} for k in range(10)]
    review = [{"review_id": f"r{k}", "user_id": f"u{k % 3}", "business_id": f"b{k % 12}", "stars": 4.0, "text": "t", "date": "2020-01-01 10:00:00" if k % 4 else "bad"} for k in range(30)]
    user = [{"user_id": f"u{k}", "name": "x", "friends": "u1, u2, u9, u1" if k == 0 else "None", "yelping_since": "2010-01-01"} for k in range(4)]
    checkin, tip = [{"business_id": "b1", "date": "x,y"}], [{"user_id": "u0", "business_id": "b1", "text": None, "date": "2020-01-01"}]
    for name, rows in {"business": business, "review": review, "user": user, "checkin": checkin, "tip": tip}.items():
        (raw / f"data_{name}.json").write_text("\n".join(map(json.dumps, rows)))
    base = f"file://{tmp_path}/artifacts"
    built = artifacts.build(spark, f"file://{raw}", base, target=5)
    assert built.business.count() == 5 and built.reviews.where("date is null").count() > 0
    ids = {r.business_id for r in built.business.collect()}
    assert {r.business_id for r in built.reviews.collect()} <= ids
    first = built.users.where("user_id = 'u0'").first()
    assert (first.n_friends_total, first.n_friends_subset, first.friends_subset) == (4, 3, "u1,u2,u1")
    again = artifacts.build(spark, f"file://{raw}", base, target=5)
    assert sorted(map(str, again.users.collect())) == sorted(map(str, built.users.collect()))
    clean = cleaning.clean_all(built)
    assert {r.metric for r in cleaning.report(built, clean).collect()} >= {"reviews_raw", "business_without_price"}
    assert ndjson.find_raw(spark, f"file://{raw}", "nothing") is None


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "user_id long, business_id long, stars double, review_id string, date timestamp, text_len int")
    assert recommend.rank_eval(spark.createDataFrame([], "u long, i long, score double"), spark.createDataFrame([], "u long, i long"), empty, spark.createDataFrame([], "i long")).first().users == 0
    assert graph.bipartite_stats(empty).first() == Row(n_users=0, n_business=0, edges=0, density=0.0)
    assert graph.components(spark.createDataFrame([], "src long, dst long"), spark.range(2)).count() == 2


def test_coerced_values(spark):
    import json as J

    cases = {
        "None": None, "": None, " True ": True, "False": False, "12": 12, "-3": -3, "007": 7, "1.5": "1.5", "u'free'": "u'free'", 'say "hi"': 'say "hi"',
        "{'a': True, 'b': \"it's\", 'c': {'d': 2, 'e': None}, 'f': '3', 'g': 1.5}": {"a": True, "b": "it's", "c": {"d": 2, "e": None}, "f": 3, "g": "1.5"},
        "{'broken'": "{'broken'", "{1, 2}": "{1, 2}", "{'x': '{bad}'}": {"x": "{bad}"},
    }
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*cases, None])], "k long, t string")
    found = {r.k: r.v for r in rows.select("k", cleaning.coerce_value(F.col("t")).alias("v")).collect()}
    assert [None if found[k] is None else J.loads(found[k]) for k in range(len(cases))] == list(cases.values()) and found[len(cases)] is None


def test_more_rows_of_a_sketch(spark):
    rows = spark.range(2000).select((F.col("id") % 150).alias("k"))
    assert sketch.width_and_depth(0.01, 1e-4)[1] == 10 and len({sketch.hash_constants(i) for i in range(40)}) == 40
    found = sketch.against_exact(rows, "k", 0.01, 1e-4)
    assert found.count() == 150 and found.where("error < 0 or error > 20").isEmpty()


def test_late_events_find_their_window(spark, tmp_path):
    """An event that comes in a later batch than newer ones still counts its whole window."""
    from tessera.streaming import live

    base = 1_700_000_000
    batches = [[(1, 0), (2, 1800), (3, 3700)], [(4, 1900), (5, 3800), (6, 3700)]]
    path = tmp_path / "in"
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame([(i, base + s, "a", 1.0) for i, s in rows], "event_id long, s long, event_type string, value double")
        frame.select("event_id", F.timestamp_seconds("s").alias("ts"), "event_type", "value").coalesce(1).write.parquet(f"{path}/b{k}")
    schema = spark.read.parquet(f"{path}/b0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/b*")
    found = {r.event_id: r.n for r in live.drained(live.trailing(stream, 1), "late", "append").collect()}
    assert found == {1: 1, 2: 2, 3: 2, 4: 3, 5: 5, 6: 4}


def test_more_empty_inputs(spark):
    edges, nodes = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "id long")
    assert graph.components(edges, nodes).isEmpty() and graph.pagerank(edges, nodes)[0].isEmpty()
    assert [(r.id, r.depth) for r in graph.distances(edges, 5).collect()] == [(5, 0)]
    assert sorted(r.score for r in graph.pagerank(edges, spark.range(3))[0].collect()) == pytest.approx([1 / 3] * 3)
    none = spark.createDataFrame([], "id long, features array<double>, cluster int")
    assert cluster.silhouette_score(none).first()[0] == 0
    assert all(f.isEmpty() for f in (cluster.dbscan(none, 1.0, 2), cluster.k_distance(none, 2), cluster.pairs_within(none, 1.0), cluster.distance_stats(none)))
    assert windows.trailing(spark.createDataFrame([], "event_id long, ts timestamp, value double"), 1).isEmpty()
    counts = audit.concentration(spark.createDataFrame([], "user_id long, business_id long"), spark.createDataFrame([], "user_id long, is_elite boolean"), spark.createDataFrame([], "business_id long"))
    assert {r.metric: r.value for r in counts.collect()}["gini_users"] == 0


def test_depths_of_a_path(spark):
    """Passes of several hops and of one hop give the same depths."""
    rows = [(k, k + 1) for k in range(30)] + [(5, 20)]
    edges = spark.createDataFrame(rows + [(b, a) for a, b in rows], "src long, dst long")
    whole = {r.id: r.depth for r in graph.distances(edges, 0).collect()}
    assert whole == {k: min(k, 6 + abs(k - 20)) for k in range(31)}
    assert {r.id: r.depth for r in graph.distances(edges, 0, 7).collect()} == {k: d for k, d in whole.items() if d <= 7}
