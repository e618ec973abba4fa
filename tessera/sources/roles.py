"""The warehouse tables in the roles that the operators expect, and the same roles as SQL.

reviews: lines of orders (user: customer, business: part, stars: a tenth of the
quantity, rounded up).  business: parts.  users: customers.  friendships: the
customers of two successive orders of one priority and status.  checkins: returned
lines.  stream: events.  item texts: documents by source and language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(ts: str):
    return F.unix_date(F.col(ts).cast("date"))


def reviews(spark: SparkSession, sf_dir: str, dealt: str | None = None) -> DataFrame:
    """Lines of orders as reviews; dealt by user_id or business_id before ids are made as text."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    quantity = F.floor("l_quantity")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).drop("o_orderkey")
    if dealt:
        rows = rows.repartition({"user_id": "o_custkey", "business_id": "l_partkey"}[dealt])
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", quantity.cast("string"), days("l_shipdate").cast("string")).alias("review_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("business_id"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("stars"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
    )


def business(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    price = F.concat(F.lit('{"RestaurantsPriceRange2": "'), (1 + size % 4).cast("string"), F.lit('", "WiFi": "free"}'))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("business_id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit(" City"), (F.col("p_partkey") % 12).cast("string")).alias("city"),
        F.col("p_type").alias("state"),
        (size % 9 / 2.0 + 1).alias("stars"),
        (size.cast("long") * 3).alias("review_count"),
        F.when(size % 10 < 8, 1).otherwise(0).alias("is_open"),
        F.concat(F.regexp_replace("p_name", " ", ", "), F.lit(", "), F.col("p_type")).alias("categories"),
        F.when(size % 5 != 0, price).alias("attributes"),
        F.when(size % 7 == 0, None).when(size % 2 == 0, '{"Mon":"9-5","Tue":"9-5"}').otherwise('{"Mon":"9-5","Tue":"9-5","Sat":"9-12"}').alias("hours"),
        F.col("p_retailprice").alias("longitude"),
        (F.col("p_partkey") % 90).cast("double").alias("latitude"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    nation = read(spark, sf_dir, "nation")
    customer = read(spark, sf_dir, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("city"),
        F.col("c_mktsegment").alias("state"),
        F.floor(F.abs(balance) / 10).alias("review_count"),
        F.when(balance > 7000, "2018,2019").when(balance > 5000, "2020, ").when(balance < 0, "None").otherwise("").alias("elite"),
        ((F.col("c_custkey") % 9) / 2.0 + 1).alias("average_stars"),
    )


def friend_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): distinct friends, in one direction as they come."""
    same = ["o_orderpriority", "o_orderstatus"]
    orders = read(spark, sf_dir, "orders")
    first = orders.select((F.col("o_orderkey") + 1).alias("k"), F.col("o_custkey").alias("a"), *same)
    after = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("b"), *same)
    return first.join(after, ["k", *same]).where("a <> b").select("a", "b").distinct()


def users_with_friends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users with `friends`: ids as comma-separated text, 'None' without any."""
    listed = friend_pairs(spark, sf_dir).groupBy(F.col("a").alias("user_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b.cast("string")), ", ").alias("friends"))
    return users(spark, sf_dir).join(listed, "user_id", "left").withColumn("friends", F.coalesce("friends", F.lit("None")))


def friendship(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges in both directions, nodes)."""
    pairs = friend_pairs(spark, sf_dir)
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a")).distinct()
    return edges, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("community"))


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """business_id and a comma-separated text of the days of its lines."""
    lines = read(spark, sf_dir, "lineitem")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(days("l_shipdate"))), lambda d: d.cast("string")), ",")
    return lines.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("business_id")).agg(text.alias("date"))


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("business_id"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("date"), F.floor("value").alias("compliment_count"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, doc_id, text): documents of a source and language."""
    return read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("item"), "doc_id", "text")


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(business_id, words): a part's own words, a small vocabulary that items share."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("business_id"), F.concat_ws(" ", "p_name", "p_type", F.regexp_replace("p_brand", "#", "")).alias("words"))


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reviews with a text of the part's own words."""
    return reviews(spark, sf_dir).join(part_words(spark, sf_dir), "business_id").withColumn("text", F.concat_ws(" ", "words", "text")).drop("words")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features) of the embeddings."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


_CTES = {
    "reviews": """reviews AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT), date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS review_id,
         o_custkey AS user_id, l_partkey AS business_id, ceil(l_quantity / 10) AS stars, o_orderpriority || ' ' || o_orderstatus AS text, l_shipdate AS date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "latest": """latest AS (
  SELECT *, length(text) AS text_len FROM reviews QUALIFY row_number() OVER (PARTITION BY user_id, business_id ORDER BY date DESC NULLS FIRST, review_id DESC) = 1)""",
    "business": """business AS (
  SELECT p_partkey AS business_id, p_name AS name, ' City' || (p_partkey % 12) AS city, p_type AS state, (p_size % 9) / 2.0 + 1 AS stars, CAST(p_size AS BIGINT) * 3 AS review_count,
         CASE WHEN p_size % 10 < 8 THEN 1 ELSE 0 END AS is_open, replace(p_name, ' ', ', ') || ', ' || p_type AS categories,
         CASE WHEN p_size % 5 <> 0 THEN 1 + p_size % 4 END AS price_range,
         CASE WHEN p_size % 7 = 0 THEN 0 WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS n_days_open,
         list_concat(string_split(p_name, ' '), [p_type]) AS categories_list, p_retailprice AS longitude, CAST(p_partkey % 90 AS DOUBLE) AS latitude
  FROM part)""",
    "users": """users AS (
  SELECT c_custkey AS user_id, c_name AS name, n_name AS city, c_mktsegment AS state, CAST(floor(abs(c_acctbal) / 10) AS BIGINT) AS review_count,
         CASE WHEN c_acctbal > 7000 THEN 2 WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS n_elite_years, c_acctbal > 5000 AS is_elite, (c_custkey % 9) / 2.0 + 1 AS average_stars
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)""",
    "pairs": """pairs AS (
  SELECT DISTINCT a.o_custkey AS a, b.o_custkey AS b FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 AND b.o_orderpriority = a.o_orderpriority AND b.o_orderstatus = a.o_orderstatus WHERE a.o_custkey <> b.o_custkey)""",
    "edges": "edges AS (SELECT a AS src, b AS dst FROM pairs UNION SELECT b, a FROM pairs)",
    "nodes": "nodes AS (SELECT c_custkey AS id, c_mktsegment AS community FROM customer)",
    "checkins": """checkins AS (
  SELECT l_partkey AS business_id, string_agg(CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS VARCHAR), ',') AS date, count(*) AS n_checkins FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)""",
    "points": "points AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features, label FROM embeddings)",
    "split": """split AS (
  SELECT *, n >= 5 AND p >= n - greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) AS test FROM (
    SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY date, review_id) - 1 AS p FROM latest))""",
    "ratings": "ratings AS (SELECT user_id AS u, business_id AS i, stars AS r FROM split WHERE NOT test AND stars > 0)",
    "centred": "centred AS (SELECT u, i, r - avg(r) OVER (PARTITION BY u) AS c, avg(r) OVER (PARTITION BY u) AS mu FROM ratings)",
    "sim": """norms AS (SELECT i, CASE WHEN sqrt(sum(c * c)) > 0 THEN sqrt(sum(c * c)) ELSE 1 END AS norm FROM centred GROUP BY i),
sim AS (SELECT d.j, d.i, dot / (a.norm * b.norm) AS sim FROM (SELECT x.i AS i, y.i AS j, sum(x.c * y.c) AS dot FROM centred x JOIN centred y ON x.u = y.u AND x.i <> y.i GROUP BY 1, 2 HAVING count(*) >= 3) d
  JOIN norms a ON a.i = d.i JOIN norms b ON b.i = d.j)""",
    "pruned": "pruned AS (SELECT j, i, sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS rk FROM sim) WHERE rk <= 30 AND round(sim, 9) > 0)",
}
_NEEDS = {"latest": ["reviews"], "edges": ["pairs"], "split": ["latest"], "ratings": ["split"], "centred": ["ratings"], "sim": ["centred"], "pruned": ["sim"]}


def sql(*names: str, tail: str) -> str:
    """WITH the named roles (and what they need) the rest of a query."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(_CTES[n] for n in order) + tail
