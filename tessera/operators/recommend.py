"""Recommendations on coordinate tables; a missing row means no score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.checkpoint import cut, sweep
from tessera.functions.text import tokens


#: Ratings of a user that meet in one key.
USER_BLOCK = 1000
#: Pairs of ratings of one user that are shuffled at once: so many a rating, and so many at least.
PAIRS, FEW_PAIRS = 3, 10_000_000


def temporal_split(reviews: DataFrame, min_reviews: int = 5, test_frac: float = 0.2) -> DataFrame:
    """Reviews with `test`: the last max(1, half-even n*f) of users with enough reviews."""
    mine = Window.partitionBy("user_id")
    place = F.row_number().over(mine.orderBy("date", "review_id")) - 1
    rows = reviews.withColumn("_n", F.count("*").over(mine)).withColumn("_p", place)
    held = F.greatest(F.lit(1), F.rint(F.col("_n") * test_frac).cast("int"))
    return rows.withColumn("test", (F.col("_n") >= min_reviews) & (F.col("_p") >= F.col("_n") - held)).drop("_n", "_p")


def ratings(train: DataFrame) -> DataFrame:
    """(u, i, r): one positive rating a pair, the last by date and id."""
    best = train.groupBy(F.col("user_id").alias("u"), F.col("business_id").alias("i")).agg(F.max_by("stars", F.struct("date", "review_id")).alias("r"))
    return best.where("r > 0")


def centred(r: DataFrame) -> DataFrame:
    """(u, i, c, mu): ratings minus the user's mean."""
    mu = r.groupBy("u").agg(F.avg("r").alias("mu"))
    return r.join(mu, "u").select("u", "i", (F.col("r") - F.col("mu")).alias("c"), "mu")


def item_similarity(c: DataFrame, min_common: int = 3, rounds: int = 1) -> DataFrame:
    """(j, i, sim) for i <> j: adjusted cosine over common raters, norms over all raters (0 counts as 1).

    One self-join by user makes each unordered pair once; the pair sums are
    combined before the shuffle.  A user with more than USER_BLOCK ratings is
    dealt into blocks of items, and each two blocks are a key of their own.  In
    several rounds, each takes the pairs of some items, and its shuffle files go.
    """
    norm = c.groupBy("i").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm")).select("i", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0).alias("norm"))
    blocks = c.groupBy("u").agg(F.floor(F.count("*") / USER_BLOCK + 1).cast("int").alias("blocks"))
    dealt = c.join(blocks, "u").withColumn("block", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = dealt.select("u", "i", F.col("c").alias("ci"), F.col("block").alias("x"), each.alias("y"))
    b = dealt.select("u", F.col("i").alias("j"), F.col("c").alias("cj"), F.col("block").alias("y"), each.alias("x"))

    def common(a: DataFrame) -> DataFrame:
        return a.join(b, ["u", "x", "y"]).where("i < j").groupBy("i", "j").agg(F.sum(F.col("ci") * F.col("cj")).alias("dot"), F.count("*").alias("n")).where(F.col("n") >= min_common)

    pairs = common(a) if rounds == 1 else None
    for k in range(rounds if rounds > 1 else 0):
        part = cut(common(a.where(F.pmod(F.xxhash64("i", F.lit(1)), F.lit(rounds)) == k)), "pairs")
        sweep(c.sparkSession)
        pairs = part if pairs is None else pairs.unionByName(part)
    half = pairs.join(norm, "i").join(norm.select(F.col("i").alias("j"), F.col("norm").alias("nj")), "j").select("j", "i", (F.col("dot") / (F.col("norm") * F.col("nj"))).alias("sim"))
    return half.select(F.explode(F.array(F.struct("j", "i", "sim"), F.struct(F.col("i").alias("j"), F.col("j").alias("i"), "sim"))).alias("x")).select("x.*")


def pair_rounds(c: DataFrame) -> int:
    """Rounds of item_similarity() whose shuffled pairs grow with the ratings only."""
    n = c.groupBy("u").agg(F.count("*").cast("double").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
    return max(1, math.ceil((n["pairs"] or 0) / max(FEW_PAIRS, PAIRS * (n["n"] or 0))))


def topk_prune(sim: DataFrame, k: int = 30) -> DataFrame:
    """For each i its k largest similarities (of equal ones the least j), then only positive ones."""
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j"))
    return sim.withColumn("_r", place).where((F.col("_r") <= k) & (F.col("sim") > 0)).drop("_r")


def predict(c: DataFrame, sk: DataFrame, users: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(u, i, score) of the users: their mean plus the weighted mean of what they rated, within 1..5.

    `pairs` (u, i): only these are scored, from the few neighbours of each item.
    """
    if pairs is not None:
        rated = pairs.select("u", "i").distinct().join(sk, "i").join(c.select("u", F.col("i").alias("j"), "c", "mu"), ["u", "j"])
    else:
        own = c.join(users.select("u").distinct(), "u", "left_semi") if users is not None else c
        rated = own.select("u", F.col("i").alias("j"), "c", "mu").join(sk, "j")
    sums = rated.groupBy("u", "i").agg(F.sum(F.col("sim") * F.col("c")).alias("num"), F.sum(F.abs("sim")).alias("den"), F.first("mu").alias("mu"))
    return sums.where("den > 1e-8").select("u", "i", F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.col("mu") + F.col("num") / F.col("den"))).alias("score"))


def rating_metrics(scores: DataFrame, test: DataFrame, items: DataFrame) -> DataFrame:
    """One row: n_test, n_cold_items, n_without_neighbours, n_predicted, rmse, mae."""
    known = items.select("i").distinct().withColumn("_known", F.lit(True))
    rows = test.select(F.col("user_id").alias("u"), F.col("business_id").alias("i"), "stars").join(known, "i", "left").join(scores, ["u", "i"], "left")
    error = F.col("score") - F.col("stars")
    return rows.agg(
        F.count("*").alias("n_test"),
        F.count_if(F.col("_known").isNull()).alias("n_cold_items"),
        F.count_if(F.col("_known").isNotNull() & F.col("score").isNull()).alias("n_without_neighbours"),
        F.count("score").alias("n_predicted"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )


def show_topk(scores: DataFrame, seen: DataFrame, business: DataFrame, k: int = 10) -> DataFrame:
    """The k best unseen items of each user with their profiles, scores rounded half-even to 3 places."""
    fresh = scores.join(seen.select("u", "i").distinct(), ["u", "i"], "left_anti")
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("score"), "i"))
    best = fresh.withColumn("place", place).where(F.col("place") <= k).withColumn("score", F.bround("score", 3))
    return best.join(business, best.i == business.business_id, "left").drop("business_id")


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(item, term, c) of (item, text) rows."""
    return docs.select("item", F.explode(tokens(F.col(text))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("c"))


def tfidf(docs: DataFrame, items: DataFrame, terms: int = 2000, normalise: bool = True, text: str = "text") -> DataFrame:
    """(item, term, w): term share of all the item's tokens times ln(N / (1 + df)) over the most frequent terms.

    `docs` has (item, text) rows; N counts all `items`, those without text too.
    """
    return weights(words(docs, text), items, terms, normalise)


def weights(words: DataFrame, items: DataFrame, terms: int = 2000, normalise: bool = True) -> DataFrame:
    """tfidf() of counted words; items of equal words get equal weights to the last bit."""
    totals = words.groupBy("item").agg(F.sum("c").alias("total"))
    vocabulary = words.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(terms)
    n = items.select("item").distinct().agg(F.count("*").alias("n"))
    rows = words.join(F.broadcast(vocabulary.crossJoin(F.broadcast(n))), "term").join(totals, "item")
    raw = rows.select("item", "term", (F.col("c") / F.col("total") * F.log(F.col("n") / (1 + F.col("df")))).alias("w"))
    if not normalise:
        return raw
    squares = F.sort_array(F.collect_list(F.col("w") * F.col("w")))  # at most one a term, added in one order
    norm = raw.groupBy("item").agg(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("norm"))
    return raw.join(norm, "item").select("item", "term", (F.col("w") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("w"))


def profiles(t: DataFrame, r: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(u, term, p): users' sums of (r - 3) times item vectors, with length 1."""
    own = r.join(users.select("u").distinct(), "u", "left_semi") if users is not None else r
    profile = own.join(t.withColumnRenamed("item", "i"), "i").groupBy("u", "term").agg(F.sum((F.col("r") - 3) * F.col("w")).alias("p"))
    norm = profile.groupBy("u").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("norm"))
    return profile.join(norm, "u").select("u", "term", (F.col("p") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("p"))


def content_scores(t: DataFrame, r: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(u, i, score): cosine of the user's profile, the sum of (r - 3) times item vectors, with items that share a term."""
    return profiles(t, r, users).join(t.withColumnRenamed("item", "i"), "term").groupBy("u", "i").agg(F.sum(F.col("p") * F.col("w")).alias("score"))


def relevant(test: DataFrame, items: DataFrame) -> DataFrame:
    """(u, i): test pairs of 4 stars or more with a known item."""
    return test.where("stars >= 4").select(F.col("user_id").alias("u"), F.col("business_id").alias("i")).distinct().join(items.select("i").distinct(), "i", "left_semi")


def rank_table(scores: DataFrame, methods: list[str], train: DataFrame, test: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(method, precision, recall, ndcg, users): rank_eval of (method, u, i, score) for all methods in one pass."""
    wanted = relevant(test, items)
    return hit_table(hits(scores, wanted, train, k), methods, wanted, k)


def hits(scores: DataFrame, wanted: DataFrame, train: DataFrame, k: int = 10) -> DataFrame:
    """(method, u, place) of wanted pairs among the k best unseen ones of (method, u, i, score)."""
    fresh = scores.join(wanted.select("u").distinct(), "u", "left_semi").join(train.select("u", "i").distinct(), ["u", "i"], "left_anti")
    place = F.row_number().over(Window.partitionBy("method", "u").orderBy(F.desc("score"), "i"))
    return fresh.withColumn("place", place).where(F.col("place") <= k).join(wanted, ["u", "i"], "left_semi").select("method", "u", "place")


def hit_table(hits: DataFrame, methods: list[str], wanted: DataFrame, k: int = 10) -> DataFrame:
    """(method, precision, recall, ndcg, users) of the places of hits (method, u, place)."""
    hit = hits.groupBy("method", "u").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("place") + 1)).alias("dcg"))
    need = wanted.groupBy("u").agg(F.count("*").alias("n")).withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), lambda p: 1 / F.log2(p + 1)), F.lit(0.0), lambda s, x: s + x)
    per = need.join(hit, ["method", "u"], "left").select("method", (F.coalesce("hits", F.lit(0)) / k).alias("p"), (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("r"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("g"))
    return per.groupBy("method").agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("g").alias("ndcg"), F.count("*").alias("users"))


def rank_eval(scores: DataFrame, train: DataFrame, test: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """One row: precision, recall and NDCG at k over users with a relevant (4 stars or more, known) test item.

    Only scored unseen items are ranked, ties by item.
    """
    relevant = test.where("stars >= 4").select(F.col("user_id").alias("u"), F.col("business_id").alias("i")).distinct().join(items.select("i").distinct(), "i", "left_semi")
    fresh = scores.join(relevant.select("u").distinct(), "u", "left_semi").join(train.select("u", "i").distinct(), ["u", "i"], "left_anti")
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("score"), "i"))
    top = fresh.withColumn("place", place).where(F.col("place") <= k)
    hit = top.join(relevant, ["u", "i"], "left_semi").groupBy("u").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("place") + 1)).alias("dcg"))
    need = relevant.groupBy("u").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), lambda p: 1 / F.log2(p + 1)), F.lit(0.0), lambda s, x: s + x)
    per = need.join(hit, "u", "left").select((F.coalesce("hits", F.lit(0)) / k).alias("p"), (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("r"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("g"))
    return per.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("g").alias("ndcg"), F.count("*").alias("users"))


def _wanted(train: DataFrame, users: DataFrame, k: int, spare: int = 0) -> DataFrame:
    """(u, place): places 1..k plus as many as the user has rated, so that k unseen items are among them."""
    seen = train.groupBy("u").agg(F.count("*").alias("n"))
    many = users.select("u").distinct().join(seen, "u", "left").select("u", (F.coalesce("n", F.lit(0)) + k + spare).cast("int").alias("n"))
    return many.select("u", F.explode(F.sequence(F.lit(1), "n")).alias("place"))


def popular(train: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """(u, i, score): for each user enough of the items with most raters that k unseen ones are among them.

    Ranks are joined by place, so a user meets k items more than they rated, not
    all.  Places come from running sums, not from one window.
    """
    from tessera.operators.audit import running

    counts = train.groupBy("i").agg(F.count("*").cast("double").alias("score")).withColumn("_order", F.struct((-F.col("score")).alias("s"), "i"))
    top = running(counts, "_order", {"place": F.lit(1)})
    return _wanted(train, users, k).join(top, "place").select("u", "i", "score")


def random_scores(train: DataFrame, items: DataFrame, users: DataFrame, k: int = 10, seed: int = 0) -> DataFrame:
    """(u, i, score): enough items in an order of each user's own that k unseen ones are among them.

    The order is (a j + b) modulo the least prime that is not below the number
    of items, with a and b hashed from user and seed, so no item comes twice;
    numbers without an item are skipped; score falls with j.
    """
    numbered = cut_numbered(items)
    n = numbered.count()
    prime = next(p for p in range(max(2, n), 2 * n + 3) if all(p % d for d in range(2, int(p**0.5) + 1)))
    a = F.pmod(F.xxhash64("u", F.lit(seed)), F.lit(prime - 1)) + 1
    b = F.pmod(F.xxhash64("u", F.lit(seed + 1)), F.lit(prime))
    wanted = _wanted(train, users, k, prime - n).withColumn("number", F.pmod(a * F.col("place") + b, F.lit(prime)))
    return wanted.join(numbered, "number").select("u", "i", (1 / F.col("place")).alias("score"))


def cut_numbered(items: DataFrame) -> DataFrame:
    """(i, number): items numbered from 0 in their order."""
    from tessera.operators.audit import running

    return running(items.select("i").distinct(), "i", {"number": F.lit(1)}).withColumn("number", F.col("number") - 1)


def top_per_user(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k best-scored items of each user, ties by item."""
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("score"), "i"))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def normalise_rows(scores: DataFrame) -> DataFrame:
    """(u, i, score) scaled to 0..1 for each user; the range is at least 1e-8."""
    span = scores.groupBy("u").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return scores.join(span, "u").select("u", "i", ((F.col("score") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8))).alias("score"))


def mixed(cf: DataFrame, cb: DataFrame) -> DataFrame:
    """(u, i, a, b): both normalised scores, 0 where one has none."""
    a, b = normalise_rows(cf).withColumnRenamed("score", "a"), normalise_rows(cb).withColumnRenamed("score", "b")
    return a.join(b, ["u", "i"], "full").select("u", "i", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def blend(alpha: float) -> Column:
    return alpha * F.col("a") + (1 - alpha) * F.col("b")


def hybrid(cf: DataFrame, cb: DataFrame, alpha: float) -> DataFrame:
    return mixed(cf, cb).select("u", "i", blend(alpha).alias("score"))


def alpha_sweep(cf: DataFrame, cb: DataFrame, train: DataFrame, test: DataFrame, items: DataFrame, alphas=tuple(k / 10 for k in range(11)), k: int = 10, places: int = 12) -> DataFrame:
    """(alpha, precision, recall, ndcg, users) of each mix, scores to so many places; the mixed scores are made once."""
    from tessera.checkpoint import cut

    both, out = cut(mixed(cf, cb).join(train.select("u", "i").distinct(), ["u", "i"], "left_anti"), "mixed"), None
    for a in alphas:
        row = rank_eval(both.select("u", "i", F.round(blend(a), places).alias("score")), train, test, items, k).select(F.lit(a).alias("alpha"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def method_table(methods: dict[str, DataFrame], train: DataFrame, test: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(method, precision, recall, ndcg, users) of each method's scores."""
    out = None
    for name, scores in methods.items():
        row = rank_eval(scores, train, test, items, k).select(F.lit(name).alias("method"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def cold_start(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: test pairs with a new user, with a new item, and users with one training review and their share."""
    new_users = test.join(train.select("user_id").distinct(), "user_id", "left_anti").agg(F.count("*").alias("cold_users"))
    new_items = test.join(train.select("business_id").distinct(), "business_id", "left_anti").agg(F.count("*").alias("cold_items"))
    single = train.groupBy("user_id").count().agg(F.count_if(F.col("count") == 1).alias("single_users"), F.avg((F.col("count") == 1).cast("double")).alias("single_share"))
    return new_users.crossJoin(new_items).crossJoin(single)
